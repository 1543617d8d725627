"""Branches: every prefix of a hierarchy path, what lies below it, and what leads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the shortest first."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda d: F.slice(path, 1, d))).otherwise(F.array().cast("array<array<string>>"))


def branch_id(prefix: Column) -> Column:
    """A stable identifier of a branch, from its folded labels."""
    return F.md5(F.array_join(F.transform(prefix, lambda x: F.lower(F.trim(x))), " > "))


def branches(rows: DataFrame, key: str, path: str) -> DataFrame:
    """``(branch, branch_key, depth, members, first_key, last_key)`` for every prefix of every row's path."""
    each = rows.select(key, F.explode(prefixes(F.col(path))).alias("p"))
    return each.groupBy(F.array_join("p", "/").alias("branch"), branch_id(F.col("p")).alias("branch_key"), F.size("p").alias("depth")).agg(F.count("*").alias("members"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def child_labels(rows: DataFrame, key: str, path: str, most: int = 4) -> DataFrame:
    """``(branch, labels)``: the labels right below each branch, most frequent first, then in order of first appearance."""
    each = rows.select(key, F.explode(prefixes(F.col(path))).alias("p")).where(F.size("p") > 1)
    counted = each.groupBy(F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("branch"), F.element_at("p", -1).alias("label")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    order = Window.partitionBy("branch").orderBy(F.col("n").desc(), "first", "label")
    best = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return best.groupBy("branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("labels"))


def leads(rows: DataFrame, key: str, path: str, priority: str) -> DataFrame:
    """``(branch, lead)``: in each branch the row of least priority number, then least depth below it, then least key."""
    each = rows.select(key, priority, F.size(path).alias("n"), F.explode(prefixes(F.col(path))).alias("p"))
    return each.groupBy(F.array_join("p", "/").alias("branch")).agg(F.min(F.struct(priority, F.col("n") - F.size("p"), key)).alias("m")).select("branch", F.col(f"m.{key}").alias("lead"))


def prune_ancestors(selected: DataFrame, path: str) -> DataFrame:
    """The paths that no other selected path extends: each proper prefix is looked up, not compared pairwise."""
    proper = selected.select(F.explode(prefixes(F.col(path))).alias("a"), path).where(F.size("a") < F.size(path)).select("a").distinct()
    return selected.join(proper, selected[path] == F.col("a"), "left_anti")


def expand_children(selected: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """The distinct branches right below the selected ones: each path's prefixes are looked up, not compared pairwise."""
    below = paths.select(F.explode(prefixes(F.col(path))).alias("__child")).where(F.size("__child") > 1).distinct()
    parent = below.withColumn("__parent", F.slice("__child", 1, F.size("__child") - 1))
    return parent.join(selected.select(F.col(path).alias("__parent")).distinct(), "__parent", "left_semi").select(F.col("__child").alias(path))


def diversify(hits: DataFrame, query_id: str, branch: str, rank: str, window: int) -> DataFrame:
    """Up to ``window`` best hits of different branches first, then the others, each in order; adds ``position``."""
    own = Window.partitionBy(query_id, branch).orderBy(rank)
    first = hits.withColumn("__first", (F.row_number().over(own) == 1) & F.col(branch).isNotNull())
    seen = F.sum(F.col("__first").cast("int")).over(Window.partitionBy(query_id).orderBy(rank))
    lead = first.withColumn("__lead", F.col("__first") & (seen <= window))
    order = Window.partitionBy(query_id).orderBy(F.col("__lead").desc(), rank)
    return lead.withColumn("position", F.row_number().over(order)).drop("__first", "__lead")


def boost_by_branches(hits: DataFrame, branch_hits: DataFrame, query_id: str, keys: str, score: str, most: int = 4, share: float = 0.22) -> DataFrame:
    """``hits`` with ``score`` raised by the best of the query's ``most`` best branches that a hit belongs to.

    ``branch_hits(query_id, branch_key, rank, structural)``: a branch scores 1/rank and 0.4 of its structural match, over its hits.
    """
    sums = branch_hits.groupBy(query_id, "branch_key").agg(F.sum(1 / F.col("rank") + 0.4 * F.col("structural")).alias("s"))
    order = Window.partitionBy(query_id).orderBy(F.col("s").desc(), "branch_key")
    best = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(query_id, "branch_key", "s")
    held = best.groupBy(query_id).agg(F.collect_list(F.struct("branch_key", "s")).alias("__b"))  # ``most`` entries
    gain = F.coalesce(F.array_max(F.transform(F.filter("__b", lambda b: F.array_contains(F.col(keys), b["branch_key"])), lambda b: b["s"])), F.lit(0.0))
    return hits.join(held, query_id, "left").withColumn(score, F.col(score) + share * gain).drop("__b")


# The words before a number that name a unit in a table of references, and heads of columns that name none.
UNIT_LABEL = r"(?iu)^(?:secci[oó]n|section|ap[eé]ndice|appendix|anexo|recomendaci[oó]n|cap[ií]tulo|t[íi]tulo|libro|p[áa]rrafo|art(?:\.|o\.)?|articulo)\s+[A-Z0-9]+"
COLUMN_HEADS = ("numero", "numero anterior", "fuentes", "fuente", "source", "sources", "pagina", "page", "seccion de la niif para las pymes")
TABLES = ("table", "reference_table")


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unit_of_row(line: Column, technical: Column) -> Column:
    """``struct(label, cells)`` of the unit that a row of a table names in its first or second cell, else null."""
    strip = lambda x: F.regexp_replace(_flat(F.translate(x, "`*", "  ")), r"^[ \-:;,.]+|[ \-:;,.]+$", "")
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), strip), lambda x: x != "")

    def named(cells: Column) -> Column:
        first, second = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
        topic, label = F.substring(second, 1, 140), F.substring(first, 1, 160)
        titled = F.when(F.contains(F.lower(label), F.lower(topic)), label).otherwise(F.concat_ws(" ", label, topic))
        numbered = technical & first.rlike(r"^\d+(\.\d+)?$") & ~fold(topic).isin(*COLUMN_HEADS) & topic.rlike(r"\S\s\S") & topic.rlike(r"\p{L}")
        found = F.when(first.rlike(UNIT_LABEL), titled).when(second.rlike(UNIT_LABEL), F.substring(second, 1, 160)).when(numbered, F.concat_ws(" ", F.lit("Sección"), first, topic))
        return F.when((F.size(cells) >= 2) & found.isNotNull(), F.struct(found.alias("label"), cells.alias("cells")))

    return F.when(F.contains(line, F.lit("|")), F.transform(F.array(cells), named)[0])


def inventory(blocks: DataFrame, document: str, path: str, order: str, page: str, kind: str, text: str, family: Column | None = None, document_class: Column | None = None, labels: int = 6, snippets: int = 4) -> DataFrame:
    """``(document, unit_path, depth, inferred_only, blocks, first_order, page_start, page_end, child_labels, snippets)``: every unit of a document once.

    Units are the prefixes of blocks' paths, labels compared folded, and in normative documents also those that rows of
    tables name. Counts meet before any list is built, so a unit with most of the blocks is no hot group.
    """
    family = F.lit("normative") if family is None else family
    technical = F.coalesce((F.lit("") if document_class is None else document_class) == "technical_standard", F.lit(False))
    clean = F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(F.col(document).alias("document"), clean.alias("p"), F.col(order).alias("o"), F.col(page).alias("g"), F.col(kind).alias("k"), F.coalesce(text, F.lit("")).alias("t"), family.alias("f"), technical.alias("technical")).where(F.size("p") > 0)
    short = F.when(F.length(_flat(F.col("t"))) > 260, F.concat(F.rtrim(F.substring(_flat(F.col("t")), 1, 257)), F.lit("..."))).otherwise(_flat(F.col("t")))
    stated = rows.select("document", "o", "g", F.explode(prefixes(F.col("p"))).alias("u"), F.col("p"), F.when(F.col("k").isin(*TABLES), "").otherwise(short).alias("t"))
    stated = stated.select("document", "o", "g", "u", F.lit(False).alias("i"), F.get("p", F.size("u")).alias("child"), F.when(F.size("u") == F.size("p"), F.col("t")).otherwise("").alias("s"))
    parent = F.when(F.col("technical"), F.slice("p", 1, 1)).when(F.size("p") > 1, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))
    lines = rows.where((F.col("f") == "normative") & F.col("k").isin(*TABLES)).select("document", "o", "g", parent.alias("up"), "technical", F.posexplode(F.split("t", r"\R")).alias("n", "line"))
    named = lines.withColumn("unit", unit_of_row(F.col("line"), F.col("technical"))).where("unit IS NOT NULL")
    told = F.substring(F.concat(F.col("unit.label"), F.lit(". Fuente estructural: "), F.array_join(F.slice("unit.cells", 1, 3), " | ")), 1, 320)
    inferred = named.select("document", "o", "g", F.concat("up", F.array("unit.label")).alias("u"), F.lit(True).alias("i"), F.lit(None).cast("string").alias("child"), told.alias("s"))
    units = stated.unionByName(inferred).withColumn("key", F.array_join(F.transform("u", lambda x: _flat(fold(x))), "\n"))
    by = ["document", "key"]
    seen = F.struct("i", "o", "u")
    main = units.groupBy(*by).agg(F.min(seen)["u"].alias("unit_path"), F.min("i").alias("inferred_only"), F.countDistinct("o").alias("blocks"), F.min("o").alias("first_order"), F.min("g").alias("page_start"), F.max("g").alias("page_end"))

    def best(counted: DataFrame, order: list, most: int, value: str) -> DataFrame:
        few = counted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= most)
        return few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(value))

    children = units.where("child IS NOT NULL").groupBy(*by, "child").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    said = units.where("s <> ''").groupBy(*by, "s").agg(F.min(F.struct("i", "o")).alias("first"))
    out = main.join(best(children, [F.col("n").desc(), "first", "child"], labels, "child"), by, "left").join(best(said, ["first", "s"], snippets, "s"), by, "left")
    none = F.array().cast("array<string>")
    return out.select("document", "unit_path", F.size("unit_path").alias("depth"), "inferred_only", "blocks", "first_order", "page_start", "page_end", F.coalesce("child", none).alias("child_labels"), F.coalesce("s", none).alias("snippets"))
