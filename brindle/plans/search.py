"""Search queries: the benchmark's texts are the questions, the documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import embedding
from brindle.functions.text import content_tokens, overlap
from brindle.operators import answer, evaluate, hierarchy, rank, retrieval, understand
from brindle.plans import sql

DENSE_K = SPARSE_K = 12
FINAL_K = 8
#: Characters of all questions up to which what follows from them (words, hits) is broadcast to the documents.
MOST_CHARS = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.components(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "idx", (F.round("value", 6) + 0.0).alias("value"))  # no negative zeros


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query")
    return retrieval.bm25_top(docs, questions, "doc_id", ["text"], "item_id", "query", SPARSE_K)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embedding.vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    questions = embedding.vectors(table(spark, sf_dir, "benchmark"), "item_id", "text")
    # Questions and documents have ids of their own: a question's id is shifted so that it never hides a document.
    shifted = questions.select((-F.col("item_id") - 1).alias("item_id"), "vector")
    found = retrieval.dense_topk(shifted, vectors, DENSE_K, query_id="item_id", vector_id="doc_id", vector="vector")
    return found.select((-F.col("query_id") - 1).alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(retrieval.rrf(_dense(spark, sf_dir), _sparse(spark, sf_dir), "item_id", "doc_id"), "item_id", "rrf", "doc_id", FINAL_K)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


def hash_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors.where("vec_id % 50 = 0"), vectors, DENSE_K, query_id="vec_id")


def dense_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = dense_topk(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return found.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 6).alias("precision"), F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("first_hit"))


def variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense and the sparse list of a question as two variants of one modality."""
    lists = _dense(spark, sf_dir).withColumn("variant", F.lit(0)).unionByName(_sparse(spark, sf_dir).withColumn("variant", F.lit(1)))
    return retrieval.merge_lists(lists, "item_id", "doc_id")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a question's whole text; candidates come from the rarest token inside it, which stands in them as a whole word."""
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where("text <> ''")
    small = F.broadcast if (questions.agg(F.sum(F.length("text"))).first()[0] or 0) <= MOST_CHARS else lambda df: df
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"))
    inner = questions.select("item_id", F.col("text").alias("question"), words(F.col("text")).alias("w")).withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    index = docs.select("doc_id", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    whole = inner.select("item_id", "question", F.explode(F.array_distinct("w")).alias("term"))
    df = index.select("term").join(small(whole.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    rare = whole.join(df, "term").groupBy("item_id", "question").agg(F.min(F.struct("df", "term")).alias("m")).select("item_id", "question", F.col("m.term").alias("term"))
    found = index.join(small(rare), "term").where(F.contains("text", F.col("question"))).select("item_id", "doc_id")
    short = inner.where(F.size("w") == 0).select("item_id", "question")  # too short for an inner word: looked for in every text
    return found.unionByName(docs.join(short, F.contains("text", F.col("question"))).select("item_id", "doc_id")) if not short.isEmpty() else found


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark")
    return evaluate.case_metrics(questions, _fused(spark, sf_dir), _relevant(spark, sf_dir), "item_id", "doc_id")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("item_id", "n_targets", "hit_1", "hit_3", "hit_5", "all_5", F.round("rr", 6).alias("rr"), F.round("precision", 6).alias("precision"))


def hit_rate_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages for questions with and without a target, and over all."""
    rows = _metrics(spark, sf_dir).withColumn("suite", F.when(F.col("n_targets") > 0, "answerable").otherwise("unanswerable"))
    return evaluate.rollup(rows, "suite", {"hit_1": F.col("hit_1"), "hit_3": F.col("hit_3"), "hit_5": F.col("hit_5"), "mrr": F.col("rr"), "precision_3": F.col("precision")})


def _with_texts(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    few = questions.agg(F.sum(F.length("question"))).first()[0] or 0
    hits = F.broadcast(hits) if few <= MOST_CHARS else hits  # some rows a question: texts are not shuffled for them
    return docs.join(hits, "doc_id").join(questions, "item_id")


def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_texts(_fused(spark, sf_dir), spark, sf_dir)
    hard = overlap(content_tokens(F.col("question")), content_tokens(F.col("text")))
    scored = rows.withColumn("rerank_score", F.round(F.col("rrf") + 0.8 * hard, 6))
    return retrieval.top(scored, "item_id", "rerank_score", "doc_id", FINAL_K, "rerank_rank").select("item_id", "doc_id", "rerank_score", "rerank_rank")


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and soft overlap with text and path (source and language stand for the path), references and their penalties."""
    rows = understand.structure(_with_texts(_fused(spark, sf_dir), spark, sf_dir), "question")
    empty = {c: F.lit("") for c in ("unit_key", "article_label", "section_label", "subsection_label", "canonical_label", "retrieval_context")}
    rows = rows.withColumns(empty | {"path_text": F.concat_ws(" > ", "source", "lang"), "raw_text": F.col("text")})
    extra = F.when(rank.exact_reference(F.col("question"), F.col("raw_text")), 0.2).otherwise(0.0) + rank.structural_score(F.col("refs")) - rank.mismatch_penalty(F.col("refs"))
    return rank.rerank(rows, "item_id", "doc_id", F.col("rrf"), F.col("text"), F.col("path_text"), F.col("question"), extra).select("item_id", "doc_id", "rerank_score", "rerank_rank")


def answer_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.outcome(_fused(spark, sf_dir), "item_id", "doc_id", "rank", "rrf")


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_texts(_fused(spark, sf_dir), spark, sf_dir)
    rows = rows.withColumn("evidence", answer.best_fragment(F.col("question"), F.col("text"))).withColumn("style", F.lit("summary"))
    said = answer.answers(rows, "item_id", "rank", "evidence", "source", "style")
    cited = answer.citations(rows.where("rank <= 3"), rows, "item_id", "doc_id", "rank").groupBy("item_id").agg(F.count("*").alias("citations"))
    return said.join(cited, "item_id")


def question_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = understand.structure(table(spark, sf_dir, "benchmark"), "text")
    return rows.select("item_id", F.md5("normalised").alias("normalised_md5"), F.size("refs").alias("n_refs"), F.size("document_markers").alias("n_markers"), F.array_join("topic_terms", " ").alias("topics"), F.array_join("queries", "|").alias("queries"))


def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understand.variants(understand.structure(table(spark, sf_dir, "benchmark"), "text"), "item_id", "text").select("item_id", "variant", F.md5("query").alias("query_md5"))


def diversify_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("branch"))
    return hierarchy.diversify(dense_topk(spark, sf_dir).join(branch, "vec_id"), "query_id", "branch", "rank", 3).select("query_id", "vec_id", "rank", "position")


_NEAR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(coalesce(list_cosine_similarity(q.e, v.e), 0), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 12)"""
_CASES = f"""{sql.fused('fused')},
relevant AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE b.text <> '' AND contains(d.text, b.text)),
marked AS (SELECT f.item_id, f.doc_id, f.rank, r.doc_id IS NOT NULL AS good FROM fused f LEFT JOIN relevant r ON f.item_id = r.item_id AND f.doc_id = r.doc_id),
per AS (SELECT item_id, min(rank) FILTER (WHERE good) AS first, count(*) FILTER (WHERE rank <= 3) AS top, count(*) FILTER (WHERE good AND rank <= 3) AS g3, count(*) FILTER (WHERE good AND rank <= 1) AS g1, count(*) FILTER (WHERE good AND rank <= 5) AS g5 FROM marked GROUP BY item_id),
sizes AS (SELECT item_id, count(*) AS n FROM relevant GROUP BY item_id),
cases AS (SELECT item_id, coalesce(n, 0) AS n_targets, coalesce(g1, 0) > 0 AS hit_1, coalesce(g3, 0) > 0 AS hit_3, coalesce(g5, 0) > 0 AS hit_5, coalesce(n, 0) > 0 AND coalesce(g5, 0) = n AS all_5,
  coalesce(1::DOUBLE / first, 0) AS rr, CASE WHEN top > 0 THEN g3::DOUBLE / top ELSE 0 END AS precision FROM benchmark LEFT JOIN per USING (item_id) LEFT JOIN sizes USING (item_id))"""

QUERIES = {f.__name__: f for f in (hybrid_topk, hash_embedding, bm25_topk, hash_dense_topk, dense_topk, dense_label_precision, variant_merge, retrieval_metrics, hit_rate_mrr, overlap_rerank, heuristic_rerank, answer_outcome, extractive_answers, question_structure, question_variants, diversify_branches)}
ORACLE_SQL = {
    "hybrid_topk": f"WITH {sql.fused('fused')} SELECT item_id, doc_id, dense_rank, sparse_rank, rrf, rank FROM fused",
    "hash_embedding": f"WITH {sql.embedding('d', 'documents', 'doc_id')} SELECT k AS doc_id, idx::INT AS idx, round(v, 6) + 0::DOUBLE AS value FROM de",
    "bm25_topk": f"WITH {sql.bm25('r')} SELECT item_id, doc_id, score, rank FROM r",
    "hash_dense_topk": f"WITH {sql.dense('r')} SELECT item_id, doc_id, score, rank FROM r",
    "dense_topk": f"WITH {_NEAR} SELECT query_id, vec_id, score, rank FROM near",
    "dense_label_precision": f"WITH {_NEAR}, m AS (SELECT near.query_id, rank, a.label = b.label AS good FROM near JOIN v a ON a.vec_id = near.vec_id JOIN v b ON b.vec_id = near.query_id) SELECT query_id, round(avg(good::INT::DOUBLE), 6) AS precision, min(rank) FILTER (WHERE good) AS first_hit FROM m GROUP BY query_id",
    "variant_merge": f"WITH {sql.bm25('sparse')}, {sql.dense('near')}, u AS (SELECT *, 0 AS variant FROM near UNION ALL SELECT *, 1 FROM sparse), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank, variant) AS r FROM u) WHERE r = 1) SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY rank, variant, doc_id)::INT AS rank FROM b",
    "retrieval_metrics": f"WITH {_CASES} SELECT item_id, n_targets, hit_1, hit_3, hit_5, all_5, round(rr, 6) AS rr, round(precision, 6) AS precision FROM cases",
    "hit_rate_mrr": f"WITH {_CASES} SELECT CASE WHEN grouping(s) = 0 THEN s END AS suite, count(*) AS cases, round(avg(hit_1::INT::DOUBLE), 3) AS hit_1, round(avg(hit_3::INT::DOUBLE), 3) AS hit_3, round(avg(hit_5::INT::DOUBLE), 3) AS hit_5, round(avg(rr), 3) AS mrr, round(avg(precision), 3) AS precision_3 FROM (SELECT *, CASE WHEN n_targets > 0 THEN 'answerable' ELSE 'unanswerable' END AS s FROM cases) GROUP BY GROUPING SETS ((s), ())",
    "overlap_rerank": f"""WITH {sql.fused('fused')}, t AS (SELECT item_id, doc_id, rrf, {sql.content_tokens("coalesce(b.text, '')")} AS q, {sql.content_tokens("coalesce(d.text, '')")} AS w FROM fused JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
o AS (SELECT item_id, doc_id, round(rrf + 0.8::DOUBLE * (CASE WHEN len(q) > 0 AND len(w) > 0 THEN len(list_intersect(q, w)) / len(q)::DOUBLE ELSE 0 END), 6) AS rerank_score FROM t)
SELECT item_id, doc_id, rerank_score, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id)::INT AS rerank_rank FROM o""",
    "answer_outcome": f"WITH {sql.fused('fused')} SELECT item_id, round(least(0.95::DOUBLE, 0.35::DOUBLE + 3 * max(rrf)), 2) AS confidence, coalesce(max(doc_id) FILTER (WHERE rank = 1) <> max(doc_id) FILTER (WHERE rank = 2), false) AS source_conflict, NULL::VARCHAR AS fallback_reason FROM fused GROUP BY item_id",
    "diversify_branches": f"WITH {_NEAR}, o AS (SELECT near.*, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1 AS first FROM near JOIN v USING (vec_id)), c AS (SELECT *, first AND sum(first::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 3 AS lead FROM o) SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, rank)::INT AS position FROM c",
}
