"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

Two lines are at most one edit apart exactly if deleting at most one character from each, at one place,
makes them equal. Emitting a variant for every character of every line would be far more data than the
text, so the neighbourhood is emitted coarse to fine, each step only for lines that still have a possible
partner: first variants without one half, then without one of about sqrt(n) blocks, then, inside such a
block, without one character. Every step is a join of equal hashed variants, and each is lossless: of two
lines that are one edit apart, what lies before and after the edited block is equal. At last the edit distance of
the whole lines is verified.

A variant belongs to a length class ``L``, the longer line's length: a line of ``n`` characters takes part
in the classes ``n`` and ``n + 1``. Groups of equal variants are linked to their earliest line only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import clear_of, cut

#: Characters from which lines are compared within the edit bound: by default all are.
MIN_CHARS = 1
#: The prefilter's bitmap: bits for each sought line, and its greatest size (a broadcast of at most 32 MB).
BITS_A_LINE, MOST_BITS = 16, 1 << 26

#: Spaces and the control characters tab to carriage return, at a line's ends.
_TRIMMED = "trim(BOTH ' \\t\\r\\f\\u000B' FROM __line)"


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, k, line_no, t, n, h, g)``: each non-blank line, trimmed, its length and two hashes; ``k`` tells rows of one doc_id apart."""
    each = docs.select(F.col("doc_id"), F.xxhash64("text").alias("k"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "__line"))
    return each.select("doc_id", "k", "line_no", F.expr(_TRIMMED).alias("t")).where("t <> ''").select("*", F.char_length("t").alias("n"), F.xxhash64("t").alias("h"), F.hash("t").alias("g"))


def _halves() -> list:
    """Of a line of ``n`` characters, in the classes n and n + 1: what stays when one half goes."""
    out = []
    for name in ("n", "n + 1"):
        out.append(F.expr(f"xxhash64({name}, 0, right(t, ({name}) - ({name}) div 2))"))
        out.append(F.expr(f"xxhash64({name}, 1, left(t, ({name}) div 2))"))
    return out


def _several(pairs: DataFrame) -> DataFrame:
    """The keys of ``(key, h)`` that more than one line has, without gathering them."""
    return pairs.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")


def _sought(all_lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``all_lines`` whose hash may be in ``wanted(h)``: a bitmap of bounded size, or all rows if it would be larger."""
    n = wanted.count()
    bits = 1 << max(10, (n * BITS_A_LINE).bit_length())
    if bits > MOST_BITS:
        return all_lines
    at = F.pmod("h", F.lit(bits))
    words = wanted.select(at.alias("bit")).groupBy(F.expr("bit div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("__bits"))
    return all_lines.withColumn("__at", at).join(F.broadcast(words), F.expr("__at div 64 = __word")).where("shiftright(__bits, cast(__at % 64 as int)) & 1L = 1L").drop("__at", "__word", "__bits")


def kept_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, k, line_no)`` of the non-blank lines of which no equal or near line comes earlier.

    Lines are ordered by doc_id, k and line number. ``max_edits`` is 1, or 0 for exact comparison.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    everything = lines(docs)
    order = F.struct("doc_id", "k", "line_no")
    if not max_edits:
        return everything.groupBy("h", "g", "n").agg(F.min(order).alias("o")).select("o.*")
    keyed = everything.select("h", "g", "n", order.alias("o"), *[F.when(F.col("n") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(_halves())])
    distinct = cut(keyed.groupBy("h", "g", "n", "k0", "k1", "k2", "k3").agg(F.min("o").alias("o")))
    halves = distinct.where(F.col("n") >= min_chars).select("h", "g", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    some = cut(halves.join(_several(halves), "key").select("h", "g").distinct())

    first = distinct.join(some, ["h", "g"], "left_semi").select("h", "g", "o")
    found = _sought(everything.where(F.col("n") >= min_chars).select("doc_id", "k", "line_no", "t", "n", "h", "g"), some)
    texts = cut(found.join(first, ["h", "g"]).where(F.struct("doc_id", "k", "line_no").eqNullSafe(F.col("o"))).select("h", "g", "n", "o", "t").dropDuplicates(["h", "g"]))

    # Blocks of about sqrt(L) characters; b and e bound a block in the class's longer line.
    classes = texts.select("h", "g", "n", "o", "t", F.explode(F.array("n", F.col("n") + 1)).alias("L")).withColumn("m", F.ceil(F.sqrt("L")).cast("int"))
    cuts = F.expr("transform(sequence(0, m - 1), i -> struct(i, cast(bigint(i) * L div m as int) as b, cast(bigint(i + 1) * L div m as int) as e))")
    blocks = classes.select("h", "g", "n", "o", "t", "L", F.explode(cuts).alias("c")).select(
        "h", "g", "o", "n", "L", F.expr("c.e - c.b").alias("width"),
        F.expr("xxhash64(L, c.i, left(t, c.b), right(t, L - c.e))").alias("key"),
        F.expr("substring(t, c.b + 1, n - c.b - (L - c.e))").alias("mid"),
    )
    near = blocks.join(_several(blocks), "key")
    one_less = F.expr("if(n = L, concat(left(mid, j), substring(mid, j + 2)), mid)")
    variants = near.select("key", "h", "g", "o", "n", "L", "mid", F.explode(F.expr("sequence(0, width - 1)")).alias("j")).select(F.xxhash64("key", "j", one_less).alias("v"), "h", "g", "o", "mid")
    earliest = variants.groupBy("v").agg(F.min(F.struct("o", "mid", "h", "g")).alias("first"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("v", "first")
    pairs = variants.join(earliest, "v").where("o > first.o AND levenshtein(mid, first.mid, 1) >= 0").select("h", "g", F.col("first.h").alias("fh"), F.col("first.g").alias("fg")).distinct()
    own, other = texts.select("h", "g", "t"), texts.select(F.col("h").alias("fh"), F.col("g").alias("fg"), F.col("t").alias("ft"))
    gone = pairs.join(own, ["h", "g"]).join(other, ["fh", "fg"]).where("levenshtein(t, ft, 1) >= 0").select("h", "g").distinct()
    return distinct.join(gone, ["h", "g"], "left_anti").select("o.*")


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with its repeated lines gone, and the columns ``n_lines`` and ``n_removed``.

    A line goes if an earlier line, of any document, is equal to it or at most ``max_edits`` insertions,
    deletions or substitutions away, white space at the ends aside. Blank lines stay, lines of fewer
    than ``min_chars`` characters are compared exactly, and the earliest of a set of equal lines stays.
    Rows that repeat doc_id and text are one document and are returned as often as given; a null doc_id
    comes before all others; a null text stays null, with no lines; an empty table gives an empty result.
    Columns of ``docs`` named ``n_lines`` or ``n_removed`` are replaced, others stay whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    id_, key, mask, lines_, stay, n_lines, n_removed = clear_of(docs, "id", "k", "mask", "lines", "stay", "n_lines", "n_removed")
    kept = kept_lines(docs, max_edits, min_chars).select("doc_id", "k", F.expr("line_no div 64").cast("int").alias("w"), F.expr("shiftleft(1L, line_no % 64)").alias("bit"))
    words = kept.groupBy("doc_id", "k", "w").agg(F.bit_or("bit").alias("bits"))
    masks = words.groupBy("doc_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias(mask)).select(F.col("doc_id").alias(id_), F.col("k").alias(key), mask)
    joined = docs.join(masks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    stays = F.expr(f"filter({lines_}, (x, i) -> {_TRIMMED.replace('__line', 'x')} = '' OR shiftright(coalesce({mask}[i div 64], 0L), i % 64) & 1L = 1L)")
    done = joined.withColumn(lines_, F.split("text", "\n", -1)).withColumn(stay, stays)
    n = F.coalesce(F.size(lines_), F.lit(0))
    done = done.withColumns({n_lines: F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), n_removed: F.when(F.col("text").isNull(), 0).otherwise(n - F.size(stay)).cast("long")})
    return done.withColumn("text", F.array_join(stay, "\n")).select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, n_removed)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS line_no, trim(unnest(s), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), f AS (
  SELECT t, length(t) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS o, doc_id, line_no
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, line_no) AS r FROM l WHERE t <> '') WHERE r = 1
), near AS (
  SELECT DISTINCT b.doc_id, b.line_no FROM f a JOIN f b ON a.n IN (b.n - 1, b.n, b.n + 1) AND a.o < b.o
  WHERE (left(a.t, least(a.n, b.n) // 2) = left(b.t, least(a.n, b.n) // 2) OR right(a.t, least(a.n, b.n) // 2) = right(b.t, least(a.n, b.n) // 2))
    AND len(list_filter(range(greatest(a.n, b.n)), lambda i:
      left(a.t, i) = left(b.t, i) AND substr(a.t, i + 1 + (a.n >= b.n)::INT) = substr(b.t, i + 1 + (b.n >= a.n)::INT))) > 0
), kept AS (
  SELECT doc_id, line_no FROM f ANTI JOIN near USING (doc_id, line_no)
), every_line AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS x
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), done AS (
  SELECT e.doc_id, count(*) AS n_lines,
    count(*) FILTER (WHERE NOT (k.doc_id IS NOT NULL OR trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) = '')) AS n_removed,
    coalesce(string_agg(x, chr(10) ORDER BY e.line_no) FILTER (WHERE k.doc_id IS NOT NULL OR trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) = ''), '') AS t
  FROM every_line e LEFT JOIN kept k ON e.doc_id = k.doc_id AND e.line_no = k.line_no GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(done.t) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""
