"""Queries of unit inventories, branch selection, isolation, repair and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.repair import repair
from brindle.operators import branches, evaluate, hierarchy, isolation
from brindle.plans import sql
from brindle.plans.corpus import _P, _paths
from brindle.plans.ranking import _hits
from brindle.plans.search import _NEAR, _fused, _with_texts, table


def unit_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each host: pages as blocks by their path, every fifth of them a table that names a unit."""
    tab = F.col("page_id") % 5 == 0
    text = F.when(tab, F.concat(F.lit("| *Anexo* "), F.col("page_id") % 4, F.lit(" | Cuadro de  datos "), F.col("page_id") % 3, F.lit(" |\n| :-- | -- |"))).otherwise(F.concat(F.lit("Pagina "), F.col("page_id") % 6, F.lit("  en "), F.element_at("path", -1)))
    rows = _paths(spark, sf_dir).where(F.size("path") > 0).select("page_id", "path", F.col("path")[0].alias("host"), (F.col("page_id") % 7).alias("page"), F.when(tab, "table").otherwise("text").alias("kind"), text.alias("text"))
    found = hierarchy.inventory(rows, "host", "path", "page_id", "page", "kind", "text")
    return found.select("document", F.array_join("unit_path", "/").alias("unit"), "depth", "inferred_only", "blocks", "first_order", "page_start", "page_end", F.array_join("child_labels", "|").alias("child_labels"), F.array_join("snippets", "|").alias("snippets"))


def _branch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.element_at(F.array(*[F.lit(x) for x in branches.SELECTED]), (F.col("query_id") % 3 + 1).cast("int"))
    return _hits(spark, sf_dir).withColumns({"strategy": strategy, "probability": F.when(F.col("query_id") % 2 == 0, (F.col("vec_id") % 13) / 13.0)})


def branch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of near vectors as branches, chosen by a model for half of the questions."""
    return branches.select(_branch_hits(spark, sf_dir), "query_id", "label", "rank", "score", "probability", "strategy").select("query_id", "label", "branch_rank")


def branch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's first hits, and later ones as branch rows of more weight."""
    hits = _branch_hits(spark, sf_dir)
    later = hits.where("rank > 3").withColumns({"score": F.col("score") * 1.1, "specific": F.col("vec_id") % 2 == 0})
    added = branches.candidates(later, "query_id", "label", "rank", "strategy", "specific")
    return branches.add_candidates(hits.where("rank <= 5"), added, "query_id", "vec_id", "score").withColumn("score", F.round("score", 6))


def hit_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_texts(_fused(spark, sf_dir), spark, sf_dir).select("item_id", "doc_id", "rank", "text")
    return evaluate.previews(rows, "item_id", "rank", "text")


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a scanned legal text would be repaired."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(repair(F.col("text"))).alias("repaired_md5"))


def isolated_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a law in a gazette, after a summary and before a decree: the gazette's name asks for the law."""
    n = (F.col("doc_id") % 900 + 100).cast("string")
    text = F.concat_ws("\n", F.lit("# LA GACETA\n# SUMARIO"), F.concat(F.lit("## LEY No. "), n), F.concat(F.lit("Artículo 12. "), F.coalesce("text", F.lit(""))), F.lit("# DISPOSICIONES FINALES"), F.lit("## DECRETO No. 7\nEl Presidente de la República, considerando, acuerda\nArtículo 1. Objeto."))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ley "), n, F.lit(".md")).alias("name"), text.alias("text"))
    return isolation.isolate(docs, "doc_id", "name", "text").select("doc_id", "isolated", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_SELECT = f"""WITH {_NEAR}, h AS (SELECT near.*, label::VARCHAR AS label, ['focal', 'multi_branch', 'global'][query_id % 3 + 1] AS strategy, CASE WHEN query_id % 2 = 0 THEN (vec_id % 13) / 13::DOUBLE END AS p FROM near JOIN v USING (vec_id))"""

QUERIES = {f.__name__: f for f in (unit_inventory, branch_selection, branch_candidates, hit_previews, repaired_texts, isolated_instruments)}
ORACLE_SQL = {
    "unit_inventory": f"""WITH {_P}, k AS (SELECT page_id AS o, path, page_id % 7 AS g, page_id % 5 = 0 AS tab, 'Anexo ' || page_id % 4 || ' Cuadro de datos ' || page_id % 3 AS label, 'Anexo ' || page_id % 4 || ' | Cuadro de datos ' || page_id % 3 AS cells, 'Pagina ' || page_id % 6 || ' en ' || path[len(path)] AS said FROM p WHERE len(path) > 0),
s AS (SELECT path[1] AS document, o, g, false AS i, path[1:d] AS u, CASE WHEN d < len(path) THEN path[d + 1] END AS child, CASE WHEN d = len(path) AND NOT tab THEN said END AS s FROM (SELECT *, unnest(range(1, len(path) + 1)) AS d FROM k)
  UNION ALL SELECT path[1], o, g, true, CASE WHEN len(path) > 1 THEN path[1:len(path) - 1] ELSE path END || [label], NULL, label || '. Fuente estructural: ' || cells FROM k WHERE tab),
y AS (SELECT *, {sql.fold("array_to_string(u, chr(10))")} AS key FROM s),
m AS (SELECT document, key, arg_min(array_to_string(u, '/'), (i::INT, o)) AS unit, len(any_value(u))::INT AS depth, bool_and(i) AS inferred_only, count(DISTINCT o) AS blocks, min(o) AS first_order, min(g) AS page_start, max(g) AS page_end FROM y GROUP BY ALL),
c AS (SELECT document, key, string_agg(child, '|' ORDER BY r) AS child_labels FROM (SELECT *, row_number() OVER (PARTITION BY document, key ORDER BY n DESC, f, child) AS r FROM (SELECT document, key, child, count(*) AS n, min(o) AS f FROM y WHERE child IS NOT NULL GROUP BY ALL)) WHERE r <= 6 GROUP BY ALL),
t AS (SELECT document, key, string_agg(s, '|' ORDER BY r) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY document, key ORDER BY f, s) AS r FROM (SELECT document, key, s, min((i::INT, o)) AS f FROM y WHERE s IS NOT NULL GROUP BY ALL)) WHERE r <= 4 GROUP BY ALL)
SELECT document, unit, depth, inferred_only, blocks, first_order, page_start, page_end, coalesce(child_labels, '') AS child_labels, coalesce(snippets, '') AS snippets FROM m LEFT JOIN c USING (document, key) LEFT JOIN t USING (document, key)""",
    "branch_selection": f"""{_SELECT}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM h WHERE label <> '') WHERE r = 1), j AS (SELECT *, max((p IS NOT NULL)::INT) OVER (PARTITION BY query_id) = 1 AS judged FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judged THEN 0.88::DOUBLE * p + 0.12::DOUBLE * greatest(0, score) ELSE 0 END DESC, rank)::INT AS branch_rank FROM j WHERE NOT judged OR p IS NOT NULL)
SELECT query_id, label, branch_rank FROM n WHERE branch_rank <= CASE strategy WHEN 'focal' THEN 4 WHEN 'multi_branch' THEN 6 ELSE 8 END""",
    "branch_candidates": f"""{_SELECT}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM h WHERE rank > 3 AND label <> '' AND (strategy = 'global' OR vec_id % 2 = 0)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM l WHERE r = 1),
b AS (SELECT query_id, vec_id, score FROM h WHERE rank <= 5 UNION ALL SELECT query_id, vec_id, score * 1.1::DOUBLE FROM n WHERE n <= CASE strategy WHEN 'focal' THEN 2 WHEN 'multi_branch' THEN 4 ELSE 5 END) SELECT query_id, vec_id, round(max(score), 6) AS score FROM b GROUP BY ALL""",
    "hit_previews": rf"""WITH {sql.fused('fused')}, t AS (SELECT item_id, doc_id, rank, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM fused JOIN documents USING (doc_id) WHERE rank <= 5) SELECT item_id, doc_id, rank, CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 217)) || '...' ELSE t END AS preview FROM t""",
}
