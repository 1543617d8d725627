"""Queries over documents, versions, pages and conversations: text measures, classification, chunking, catalogue, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import embedding
from brindle.functions.text import approximate_tokens, segments, token_estimate
from brindle.operators import catalog, chunking, classify, enrich, hierarchy, models
from brindle.plans import sql
from brindle.plans.search import table
from brindle.sources import extract


def doc_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(text).alias("tokens"), approximate_tokens(text).alias("approximate_tokens"))


def focus_terms_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.focus_terms(table(spark, sf_dir, "documents"), "doc_id", ["text"])


def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify(table(spark, sf_dir, "documents"), "source", "text")
    return found.select("doc_id", "document_class", "document_family", "chunking_strategy", "confidence", "rule")


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin or end at least five in a hundred of a source's documents."""
    return chunking.boilerplate(table(spark, sf_dir, "documents"), "source", "text", share=0.05)


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    furniture = chunking.boilerplate(docs, "source", "text", share=0.05)
    return chunking.clean(docs, "source", "text", furniture).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segments(F.coalesce("text", F.lit("")))).alias("segment", "s"))
    return each.select("doc_id", "segment", token_estimate(F.col("s")).alias("tokens"), F.md5("s").alias("segment_md5"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the strategy that its class asks for."""
    found = classify.classify(table(spark, sf_dir, "documents"), "source", "text")
    return chunking.chunk_documents(found, "doc_id", "text", "chunking_strategy").select("doc_id", "chunk_order", "kind", "path", "tokens", "chunk_id", F.md5("chunk").alias("chunk_md5"))


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as index documents."""
    found = classify.classify(table(spark, sf_dir, "documents"), "source", "text")
    chunks = chunking.chunk_documents(found.select("doc_id", "text", "chunking_strategy"), "doc_id", "text", "chunking_strategy")
    rows = enrich.index_documents(chunks.withColumn("title", F.col("doc_id").cast("string")), "title", "path", "chunk")
    return rows.select("doc_id", "chunk_order", "canonical_label", "unit_type", "unit_key", "unit_topic", "reference_variants", "sample_questions", F.md5("embedding_text").alias("embedding_md5"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions: one a document of each source; every seventh is superseded, and short ones wait for review."""
    docs = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return docs.select(
        F.concat(F.lit("v"), "doc_id").alias("version_id"), F.coalesce("source", F.lit("")).alias("document_id"), F.when(F.col("doc_id") % 7 == 0, "superseded").otherwise("active").alias("version_status"),
        F.coalesce("lang", F.lit("")).alias("document_class"), F.concat(F.lit("store/"), F.coalesce("source", F.lit("")), F.lit("/"), "doc_id", F.lit(".txt")).alias("storage_uri"),
        (F.length(F.trim(F.coalesce("text", F.lit("")))) < extract.LEAST_CHARS).alias("review_required"), created.alias("created_at"), "doc_id",
    )


def _parents(versions: DataFrame) -> DataFrame:
    return catalog.latest_versions(versions)


def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    return catalog.list_versions(versions, _parents(versions), limit=500, status="active", q="SRC1").select("version_id", "document_id", "document_class", "latest_for_document")


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(_versions(spark, sf_dir))


def status_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the newest active version of each has been archived."""
    versions = _versions(spark, sf_dir)
    documents = _parents(versions)
    changes = documents.where("latest_version_id IS NOT NULL").select(F.col("latest_version_id").alias("version_id"), F.lit("archived").alias("version_status"))
    return catalog.update_status(versions, documents, changes)[1]


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and labels left by document after every version that needs review or is labelled toxic has been deleted."""
    versions = _versions(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("v"), "doc_id").alias("version_id"), "quality", "toxic")
    gone = versions.where("review_required").select("version_id").unionByName(labels.where("toxic = 1").select("version_id")).distinct()
    left = catalog.delete_versions({"versions": versions, "documents": _parents(versions), "labels": labels}, gone)
    per = left["versions"].join(left["labels"], "version_id", "left").groupBy("document_id").agg(F.count("*").alias("versions"), F.count("quality").alias("labels"))
    return left["documents"].join(per, "document_id")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.review_queue(_versions(spark, sf_dir)).select("version_id", "document_id")


def reindex_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents count as indexed: quality 1 under the current profile, quality 0 under another; the others are not."""
    versions = _versions(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    chunks = versions.join(labels, "doc_id", "left").select("version_id", F.when(F.col("quality").isNull(), "pending").otherwise("indexed").alias("index_status"), F.when(F.col("quality") == 1, "hash256").when(F.col("quality") == 0, "other").alias("indexed_profile"))
    return catalog.reindex_targets(chunks, versions, "hash256", document_class="en", limit=200).select("version_id", "position")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("version_id"), F.lit("html").alias("suffix"), F.encode("html", "UTF-8").alias("content"))
    return extract.extract(pages).select(F.col("version_id").cast("long").alias("page_id"), "block_order", "block_type", "section_path", "text", "review_reason")


def html_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_blocks(spark, sf_dir).withColumn("version_id", F.col("page_id").cast("string"))
    return extract.quality_gate(blocks)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user question carried forward to each turn, and the number of turns since."""
    at = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    rows = table(spark, sf_dir, "conversations").withColumn("q", F.last(asked, True).over(at))
    return rows.select("conv_id", "turn", F.md5("q.text").alias("question_md5"), (F.col("turn") - F.col("q.turn")).alias("since"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their URL's host and directories as a hierarchy."""
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").isNull(), F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.lower(x))).alias("path"), F.length(F.coalesce("html", F.lit(""))).alias("size"))


def path_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.branches(_paths(spark, sf_dir), "page_id", "path")


def branch_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.child_labels(_paths(spark, sf_dir), "page_id", "path").select("branch", F.array_join("labels", "|").alias("labels"))


def branch_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.leads(_paths(spark, sf_dir), "page_id", "path", "size")


def ancestor_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches but those that another one extends."""
    every = _paths(spark, sf_dir).select(F.explode(hierarchy.prefixes(F.col("path"))).alias("path")).distinct()
    return hierarchy.prune_ancestors(every, "path").select(F.array_join("path", "/").alias("branch"))


def role_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as role probabilities, averaged by source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("source", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("substantive"), F.when(F.col("quality").isNull(), 1.0).otherwise(0.0).alias("reference"), F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)).alias("editorial"))
    return enrich.role_profile(rows, "source")


def text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' languages by hash embeddings, fitted on the rows whose id's checksum is not divisible by five."""
    docs = table(spark, sf_dir, "documents")
    vectors = embedding.vectors(docs, "doc_id", "text").join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fitted = models.TextClassifier().fit(vectors.where(~held))
    return fitted.predict(vectors).select("doc_id", held.alias("held_out"), "predicted", F.round("probability", 3).alias("probability"))


_V = f"""v AS (SELECT 'v' || doc_id AS version_id, coalesce(source, '') AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS version_status, coalesce(lang, '') AS document_class,
  'store/' || coalesce(source, '') || '/' || doc_id || '.txt' AS storage_uri, length(trim(coalesce(text, ''))) < {extract.LEAST_CHARS} AS review_required, doc_id FROM documents)"""
_P = """p AS (SELECT page_id, list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> ''), lambda x: lower(x)) AS path, length(coalesce(html, '')) AS size FROM pages),
x AS (SELECT page_id, path, size, unnest(range(1, len(path) + 1)) AS d FROM p), b AS (SELECT page_id, path, size, d, path[1:d] AS pre FROM x)"""
_FURNITURE = f"""l AS (SELECT doc_id, source, {sql.lines("coalesce(text, '')")} AS l FROM documents),
z AS (SELECT source, count(*) AS pages FROM l GROUP BY source),
e AS (SELECT source, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):])) AS line FROM l),
n AS (SELECT source, lower(regexp_replace(line, '\\s+', ' ', 'g')) AS line, count(*) AS n FROM e GROUP BY ALL),
furniture AS (SELECT source, line, n.n FROM n JOIN z USING (source) WHERE NOT regexp_matches(line, '{chunking.PAGE_NUMBER_SQL}') AND pages >= 3 AND n.n >= greatest(3, ceil(pages * 0.05::DOUBLE)))"""


def _hits(c: str, patterns: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches({c}, '{p}')::INT" for p in patterns)


def _classify_sql() -> str:
    words = lambda some: " + ".join(f"contains(hay, '{w}')::INT * 2" for w in some)
    count = lambda p: f"len(regexp_extract_all(hay, '{p}'))"
    return f"""
WITH h AS (SELECT doc_id, lower(coalesce(source, '') || chr(10) || coalesce(text, '')) AS hay, coalesce(text, '') AS body FROM documents),
m AS (SELECT doc_id, hay, {_hits('hay', classify.MEETING)} AS meet, {_hits('hay', classify.MEETING_KIND)} AS meet2, {_hits('hay', classify.TECHNICAL)} AS tech,
  {count(classify.ARTICLE)} AS art, {count(classify.CHAPTER)} AS chap, {count(classify.TITLE)} AS ti, {count(classify.BOOK)} AS bo, len(regexp_extract_all(body, '(?m)^[0-9]+\\)')) AS items,
  len(list_filter(list_transform(string_split_regex(body, '{sql.LINE_END}')[1:40], lambda x: trim(x)), lambda x: x = upper(x) AND length(x) > 6)) AS caps, {_hits('lower(body)', classify.STRUCTURED_MARKERS)} AS marks FROM h),
s AS (SELECT *, {words(classify.LEGAL_WORDS)} + least(8, art * 2) + least(4, chap * 2) + least(3, ti) + least(2, bo) AS a,
  {words(classify.STRUCTURED_WORDS)} + least(3, caps) + CASE WHEN items >= 4 AND art = 0 THEN 2 ELSE 0 END AS b, 2 + CASE WHEN art = 0 AND chap = 0 THEN 3 ELSE 0 END AS c FROM m),
t AS (SELECT *, greatest(a, b, c) AS top, greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)) AS margin FROM s),
r AS (SELECT *, CASE WHEN meet >= 2 OR (meet >= 1 AND meet2 >= 1) THEN 'meeting' WHEN tech >= 3 THEN 'technical' WHEN top >= 3 AND NOT (margin < 2 AND top < 7) THEN 'scores' ELSE 'fallback' END AS rule FROM t),
k AS (SELECT *, CASE WHEN rule = 'meeting' THEN 'generic_structural' WHEN rule = 'technical' THEN 'technical_structural' WHEN rule = 'scores' THEN CASE WHEN a = top THEN 'normative_hierarchical' WHEN b = top THEN 'generic_structural' ELSE 'generic_freeform' END
  WHEN caps >= 2 OR marks >= 2 THEN 'generic_structural' ELSE 'generic_freeform' END AS chunking_strategy FROM r),
d AS (SELECT *, CASE chunking_strategy WHEN 'normative_hierarchical' THEN 'legal_normative' WHEN 'technical_structural' THEN 'technical_standard' ELSE 'general_document' END AS document_class FROM k)
SELECT doc_id, document_class, CASE WHEN document_class = 'general_document' THEN 'general' ELSE 'normative' END AS document_family, chunking_strategy,
  round(CASE rule WHEN 'meeting' THEN 0.94::DOUBLE WHEN 'technical' THEN least(0.97::DOUBLE, 0.68::DOUBLE + tech * 0.04::DOUBLE) WHEN 'scores' THEN least(0.97::DOUBLE, 0.55::DOUBLE + margin * 0.08::DOUBLE + top * 0.02::DOUBLE) ELSE 0.45::DOUBLE END, 2) AS confidence, rule FROM d"""


QUERIES = {f.__name__: f for f in (doc_token_estimate, focus_terms_top12, rule_classify, boilerplate_lines, clean_text, segment_rows, chunk_documents, index_documents, catalog_list, latest_versions, status_repair, delete_cascade, review_queue, reindex_targets, html_blocks, html_quality_gate, conversation_turns, path_prefix_rollup, branch_children, branch_lead, ancestor_prune, role_profile, text_classifier)}
ORACLE_SQL = {
    "doc_token_estimate": r"SELECT doc_id, greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.1::DOUBLE))::BIGINT AS tokens, greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '\S+')) * 1.2::DOUBLE))::BIGINT AS approximate_tokens FROM documents",
    "focus_terms_top12": f"""WITH a AS (SELECT doc_id, {sql.tokens("coalesce(text, '')")} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM a),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM t WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({', '.join(repr(w) for w in enrich.FOCUS_STOPWORDS)}) GROUP BY doc_id, term)
SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank FROM c) WHERE rank <= 12""",
    "rule_classify": _classify_sql(),
    "boilerplate_lines": f"WITH {_FURNITURE} SELECT source, line, n FROM furniture",
    "clean_text": f"""WITH {_FURNITURE}, u AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l), k AS (SELECT doc_id, i, u.line FROM u LEFT JOIN furniture f ON f.source = u.source AND f.line = lower(regexp_replace(u.line, '\\s+', ' ', 'g')) WHERE f.line IS NULL AND NOT regexp_matches(lower(regexp_replace(u.line, '\\s+', ' ', 'g')), '{chunking.PAGE_NUMBER_SQL}')),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id) SELECT doc_id, length(coalesce(t, ''))::BIGINT AS n_chars, sha256(coalesce(t, '')) AS text_sha256 FROM documents LEFT JOIN t USING (doc_id)""",
    "catalog_list": f"WITH {_V}, latest AS (SELECT document_id, arg_max(version_id, doc_id) AS latest FROM v WHERE version_status = 'active' GROUP BY document_id) SELECT version_id, document_id, document_class, coalesce(version_id = latest, false) AS latest_for_document FROM v LEFT JOIN latest USING (document_id) WHERE version_status = 'active' AND (storage_uri ILIKE '%SRC1%' OR version_id ILIKE '%SRC1%' OR document_id ILIKE '%SRC1%') ORDER BY doc_id DESC LIMIT 500",
    "latest_versions": f"WITH {_V} SELECT document_id, arg_max(version_id, doc_id) FILTER (WHERE version_status = 'active') AS latest_version_id FROM v GROUP BY document_id",
    "status_repair": f"WITH {_V}, a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY doc_id DESC) AS r FROM v WHERE version_status = 'active') SELECT DISTINCT v.document_id, a.version_id AS latest_version_id FROM v LEFT JOIN a ON a.document_id = v.document_id AND r = 2",
    "delete_cascade": f"WITH {_V}, k AS (SELECT v.*, quality FROM v LEFT JOIN labels USING (doc_id) WHERE NOT review_required AND coalesce(toxic, 0) <> 1) SELECT document_id, arg_max(version_id, doc_id) FILTER (WHERE version_status = 'active') AS latest_version_id, count(*) AS versions, count(quality) AS labels FROM k GROUP BY document_id",
    "review_queue": f"WITH {_V} SELECT version_id, document_id FROM v WHERE review_required",
    "reindex_targets": f"WITH {_V} SELECT version_id, row_number() OVER (ORDER BY doc_id DESC)::INT AS position FROM v LEFT JOIN labels USING (doc_id) WHERE document_class = 'en' AND coalesce(quality, 0) <> 1 ORDER BY doc_id DESC LIMIT 200",
    "conversation_turns": "SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w) AS question_md5, turn - last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS since FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "path_prefix_rollup": f"WITH {_P} SELECT array_to_string(pre, '/') AS branch, md5(array_to_string(list_transform(pre, lambda x: lower(trim(x))), ' > ')) AS branch_key, d::INT AS depth, count(*) AS members, min(page_id) AS first_key, max(page_id) AS last_key FROM b GROUP BY pre, d",
    "branch_children": f"WITH {_P}, c AS (SELECT array_to_string(pre[1:d - 1], '/') AS branch, pre[d] AS label, count(*) AS n, min(page_id) AS first FROM b WHERE d > 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY n DESC, first, label) AS r FROM c) SELECT branch, string_agg(label, '|' ORDER BY r) AS labels FROM r WHERE r <= 4 GROUP BY branch",
    "branch_lead": f"WITH {_P} SELECT array_to_string(pre, '/') AS branch, arg_min(page_id, (size, len(path) - d, page_id)) AS lead FROM b GROUP BY pre",
    "ancestor_prune": f"WITH {_P}, every AS (SELECT DISTINCT pre FROM b) SELECT array_to_string(pre, '/') AS branch FROM every e WHERE NOT EXISTS (SELECT 1 FROM every o WHERE len(o.pre) > len(e.pre) AND o.pre[1:len(e.pre)] = e.pre)",
    "role_profile": """WITH r AS (SELECT source, round(avg(coalesce(quality, 0)::DOUBLE), 6) AS substantive, round(avg(CASE WHEN quality IS NULL THEN 1::DOUBLE ELSE 0 END), 6) AS reference, round(avg(coalesce(toxic, 0)::DOUBLE), 6) AS editorial FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN greatest(substantive, reference, editorial) <= 0 THEN 'substantive' WHEN substantive = greatest(substantive, reference, editorial) THEN 'substantive' WHEN reference = greatest(substantive, reference, editorial) THEN 'reference' ELSE 'editorial' END AS role, greatest(substantive, reference, editorial) AS confidence, substantive, reference, editorial FROM r""",
}
