"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A token budget flows down a domain, language and source tree. Each node takes its weight's share of its
parent's budget; a node whose leaves cannot supply that much takes what they have, and its siblings
share the shortage by weight, so that a shortage leaves a subtree only when the whole subtree is dry.
Budgets are integers and add up exactly. A leaf's budget is then cut from its seeded epochs: whole epochs
first, then the prefix, in the order of a seeded hash, of one more epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import clear_of, cut, settle

LEVELS = ("domain", "lang", "source")
#: A token is a run of characters other than space and the controls tab to carriage return; the second form is for Java, which reads it faster.
WORD, JAVA_WORD = "[^\\x20\\x09-\\x0D]+", "\\S++"
#: Hexadecimal digits of the order hash that one refinement step resolves, and the steps: 2^24 cells a leaf.
DIGITS, STEPS = 2, 3
#: Least rows in a part of a leaf, by which joins deal a hot leaf to tasks, and the number of parts that all hot leaves have together, about.
PART_ROWS, MOST_HOT = 256, 4_096
#: Leaves up to which the tree is one partition.
ONE_TASK = 20_000


def weight_of(column: Column, weights: dict[str, int]) -> Column:
    """A label's integer weight; 1 for labels without one."""
    if not weights:
        return F.lit(1)
    pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(pairs[column], F.lit(1))


def running(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with, for each of ``values``, ``<value>_before``: its sum over those rows of equal ``keys`` that come earlier in ``order``.

    ``bucket`` must not fall along ``order``. Buckets are summed first, so that no task sorts more than one bucket of a key.
    """
    rows = rows.withColumn("bucket", bucket)
    past = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "bucket").agg(*[F.sum(v).alias(v) for v in values])
    offsets = sums.select(*keys, "bucket", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"{v}_offset") for v in values])
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return own.join(offsets, [*keys, "bucket"]).withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"{v}_offset") for v in values}).drop("bucket", *[f"{v}_offset" for v in values])


def share_in_one(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """:func:`share_out` for a tree of bounded size, by windows over whole families."""
    wide, product = "decimal(38,0)", "decimal(19,0)"
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rows = nodes.withColumns({"w": F.col("w").cast(wide), "cap": F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast(wide), "b": F.col("b").cast(wide), "tie": F.md5(F.col(name))})
    before = family.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(0.0), "tie", name).rowsBetween(Window.unboundedPreceding, -1)
    c_before, w_rest = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("full", F.col("cap").cast(product) * w_rest.cast(product) <= F.col("w").cast(product) * (F.col("b") - c_before).cast(product))
    rows = rows.withColumns({"rest": F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)), "w_open": F.sum(F.when(~F.col("full"), F.col("w"))).over(family)})
    due = F.col("w").cast(product) * F.col("rest").cast(product)
    rows = rows.withColumn("over", F.when(~F.col("full"), due % F.col("w_open")).cast(wide))
    rows = rows.withColumn("whole", F.when(F.col("full"), F.col("cap")).otherwise(F.floor((due - F.col("over")) / F.col("w_open"))).cast(wide))
    spare = F.col("rest") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("whole"))).over(family), F.lit(0))
    turn = F.row_number().over(family.orderBy("full", F.col("over").desc(), "tie", name))
    rows = rows.withColumns({"spare": spare, "turn": turn})
    return rows.select(*parent, name, (F.col("whole") + F.when(~F.col("full") & (F.col("turn") <= F.col("spare")), 1).otherwise(0)).cast("long").alias("quota"))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes(*parent, name, w, cap, b)`` to ``(*parent, name, quota)``: budget ``b`` of each parent, filled to caps by weight.

    Nodes are filled in the order of cap over weight; equal ones fill together. What whole shares leave over goes, one token
    each, to the largest remainders, ties by the hash of the name, then the name.
    """
    wide, product = "decimal(38,0)", "decimal(19,0)"
    keys = ["top", *parent]
    rows = nodes.withColumns({"top": F.lit(0), "w": F.col("w").cast(wide), "cap": F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast(wide), "b": F.col("b").cast(wide)})
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(0.0))
    steps = rows.groupBy(*keys, "ratio").agg(F.sum("cap").cast(wide).alias("cap"), F.sum("w").cast(wide).alias("w"), F.first("b").alias("b"))
    octave = F.when(F.col("ratio") > 0, F.floor(64 * F.log2("ratio"))).otherwise(-1_000_000)
    whole_w = steps.groupBy(*keys).agg(F.sum("w").alias("w_all"))
    steps = running(steps, keys, octave, [F.col("ratio")], ["cap", "w"]).join(whole_w, keys)
    full = F.col("cap").cast(product) * (F.col("w_all") - F.col("w_before")).cast(product) <= F.col("w").cast(product) * (F.col("b") - F.col("cap_before")).cast(product)
    last = steps.withColumn("full", full).groupBy(*keys).agg(F.max(F.when(F.col("full"), F.col("ratio"))).alias("last"), (F.first("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("rest"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("w_open"))
    rows = rows.join(last, keys).withColumn("full", F.coalesce(F.col("ratio") <= F.col("last"), F.lit(False)))
    done = rows.where("full").select(*parent, name, F.col("cap").alias("quota"))
    due = F.col("w").cast(product) * F.col("rest").cast(product)
    some = rows.where("NOT full").withColumns({"over": (due % F.col("w_open")).cast(wide), "one": F.lit(1), "tie": F.md5(F.col(name))})
    some = some.withColumn("whole", F.floor((due - F.col("over")) / F.col("w_open")).cast(wide))
    spare = some.groupBy(*keys).agg((F.first("rest") - F.sum("whole")).alias("spare"))
    bucket = -F.floor(F.col("over") * 1024 / F.col("w_open")) * 4096 + F.conv(F.substring("tie", 1, 3), 16, 10).cast("long")
    some = running(some, keys, bucket, [F.col("over").desc(), F.col("tie"), F.col(name)], ["one"]).join(spare, keys)
    open_ = some.select(*parent, name, (F.col("whole") + F.when(F.col("one_before") < F.col("spare"), 1).otherwise(0)).alias("quota"))
    return done.unionByName(open_).withColumn("quota", F.col("quota").cast("long"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, supply)`` to the same with ``quota``; the budget is ``share`` of the supply."""
    # A tree of bounded size is worked on as one partition, without exchanges; the shares are the same.
    small = leaves.count() <= ONE_TASK
    near = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    capped = near(leaves).withColumn("cap", F.col("supply") * epochs)
    quota = near(leaves).agg((F.expr(f"sum(supply) * {share[0]}L div {share[1]}L")).alias("quota"))
    for depth, name in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = capped.groupBy(*parent, name).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col(name), weights.get(name, {})))
        above = quota.withColumnRenamed("quota", "b")
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(above)  # one row: the whole budget
        quota = near(cut((share_in_one if small else share_out)(nodes, parent, name)))
    return leaves.join(quota, list(LEVELS))


def _deal(base: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base`` and ``leaves`` with a ``part`` of each leaf: rows are spread over the parts, and a leaf has a row for each.

    Only leaves with more than a 4,096th of all rows have several parts, so the table of these, which is broadcast, has fewer rows than that.
    """
    rows = leaves.agg(F.sum("n")).first()[0] or 0
    size = max(PART_ROWS, -(-rows // MOST_HOT))
    hot = F.broadcast(leaves.where(F.col("n") > size).select("leaf", F.ceil(F.col("n") / size).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    spread = base.join(hot, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "k"), parts).cast("int")).drop("parts")
    return spread, leaves.join(hot, "leaf", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def _prefix(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Of ``rows(leaf, part, h, rest, ...)``, those within the first ``rest`` tokens of each leaf in the order of ``h``, with ``taken``.

    Step by step, token sums of hash cells find the cell in which a leaf's prefix ends: rows of earlier
    cells are taken whole, rows of later ones are not, and only rows of that cell are looked at further.
    No step sorts or gathers a leaf's rows. ``parts(leaf, part)`` lists the parts of each leaf.
    """
    done: list[DataFrame] = []
    for step in range(STEPS):
        cell = F.substring("h", 1 + step * DIGITS, DIGITS)
        sums = rows.groupBy("leaf", cell.alias("cell")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
        past = Window.partitionBy("leaf").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = sums.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0))).where("before < rest AND before + n >= rest").select("leaf", F.col("cell").alias("end"), "before")
        split = rows.join(ends.join(parts, "leaf"), ["leaf", "part"]).withColumn("cell", cell)
        done.append(split.where("cell < end").withColumn("taken", F.col("n_tokens")).drop("cell", "end", "before"))
        rows = split.where("cell = end").withColumn("rest", F.col("rest") - F.col("before")).drop("cell", "end", "before")
    past = Window.partitionBy("leaf").orderBy("h", "doc_id", "k").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(past), F.lit(0))).where("before < rest").withColumn("taken", F.least("n_tokens", F.col("rest") - F.col("before"))).drop("before")
    out = last
    for part in done:
        out = out.unionByName(part)
    return out


def selection(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 42) -> DataFrame:
    """What each leaf gives: ``(doc_id, k, domain, lang, source, epoch, n_tokens, taken)``, a row for each document and epoch.

    ``share`` is the budget as a fraction of all tokens, ``epochs`` the most often a token may be used. Rows
    that repeat doc_id and text are one document. Missing labels form leaves of their own with weight 1; a
    null or wordless text has no tokens and is never selected; if the tree cannot supply the budget,
    all of it is used ``epochs`` times; an empty table gives an empty result.
    """
    leaf = F.struct(F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k"), leaf.alias("leaf"), F.coalesce(F.regexp_count("text", F.lit(JAVA_WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    base = cut(base.where("n_tokens > 0").distinct())
    leaves = cut(base.groupBy("leaf").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n")).select("leaf", "leaf.*", "supply", "n"))
    spread, parts = _deal(base, leaves)
    quotas = budgets(leaves, weights, share, epochs).select("leaf", F.expr("quota div supply").cast("int").alias("whole"), F.expr("quota % supply").alias("rest"))
    parts = cut(parts.select("leaf", "part"))
    rows = spread.join(quotas.join(parts, "leaf"), ["leaf", "part"])
    every = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("taken", F.col("n_tokens"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    partial = _prefix(cut(rows.where("rest > 0").withColumn("h", h)), parts).withColumn("epoch", F.col("whole"))
    wanted = ["doc_id", "k", *[F.col("leaf")[x].alias(x) for x in LEVELS], "epoch", "n_tokens", "taken"]
    return every.select(wanted).unionByName(partial.select(wanted))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], **options) -> DataFrame:
    """The selected documents with the columns of ``docs``, one row for each epoch that uses a document.

    The document at the end of a leaf's prefix is cut to its first ``taken`` words, joined by one space.
    Other edge cases are those of :func:`selection`; repeated rows are returned as often as given, and
    columns of any other name stay as they are.
    """
    id_, key, n, taken = clear_of(docs, "id", "k", "n", "taken")
    chosen = settle(lambda: selection(docs, domain, weights, **options).select(F.col("doc_id").alias(id_), F.col("k").alias(key), F.col("n_tokens").alias(n), F.col("taken").alias(taken)))
    joined = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({JAVA_WORD})")), 1, F.col(taken).cast("int")), " ")
    text = F.when(F.col(taken) < F.col(n), short).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _share_sql(source: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    return f"""(
  SELECT {keys}, whole + CASE WHEN NOT saturated AND turn <= spare THEN 1 ELSE 0 END AS quota FROM (
    SELECT *, rest - coalesce(sum(whole) FILTER (WHERE NOT saturated) OVER ({part}), 0) AS spare,
      row_number() OVER ({part} ORDER BY saturated, over_ DESC, md5({name}), {name}) AS turn FROM (
      SELECT *, CASE WHEN saturated THEN cap ELSE w * rest // w_open END AS whole, CASE WHEN saturated THEN -1 ELSE w * rest % w_open END AS over_ FROM (
        SELECT *, b - coalesce(sum(cap) FILTER (WHERE saturated) OVER ({part}), 0) AS rest, sum(w) FILTER (WHERE NOT saturated) OVER ({part}) AS w_open FROM (
          SELECT *, cap * w_rest <= w * (b - c_before) AS saturated FROM (
            SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
              sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest FROM {source})))))
)"""


def oracle_sql(domain: str, weights: dict[str, dict[str, int]], share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 42) -> str:
    """The same selection in DuckDB, by plain running sums over each leaf."""
    w = lambda name: "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.get(name, {}).items()) + " ELSE 1 END::HUGEINT" if weights.get(name) else "1::HUGEINT"
    return f"""
WITH base AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents
), worded AS (SELECT * FROM base WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply FROM worded GROUP BY ALL),
d AS (SELECT domain, sum(supply) * {epochs} AS cap, {w('domain')} AS w, (SELECT sum(supply) * {share[0]} // {share[1]} FROM leaf) AS b FROM leaf GROUP BY domain),
dq AS {_share_sql('d', '', 'domain')},
l AS (SELECT domain, lang, sum(supply) * {epochs} AS cap, {w('lang')} AS w, any_value(quota) AS b FROM leaf JOIN dq USING (domain) GROUP BY domain, lang),
lq AS {_share_sql('l', 'domain', 'lang')},
s AS (SELECT domain, lang, source, supply * {epochs} AS cap, {w('source')} AS w, quota AS b FROM leaf JOIN lq USING (domain, lang)),
sq AS {_share_sql('s', 'domain, lang', 'source')},
q AS (SELECT domain, lang, source, quota // supply AS whole, quota % supply AS rest FROM leaf JOIN sq USING (domain, lang, source)),
r AS (
  SELECT worded.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole::VARCHAR || ':' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM worded JOIN q USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS taken FROM r, range(whole::BIGINT) AS e(epoch)
UNION ALL
SELECT doc_id, domain, lang, source, whole::BIGINT, n_tokens::BIGINT, least(n_tokens, rest - before)::BIGINT FROM r WHERE before < rest
"""
