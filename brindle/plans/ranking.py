"""Queries of ranking, routing, evaluation and catalogue operators, each with SQL that states the fixed values anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import answer, catalog, classify, evaluate, hierarchy, rank, retrieval, understand
from brindle.plans import search, sql
from brindle.plans.corpus import _V, _versions
from brindle.plans.search import _NEAR, _fused, _with_texts, table
from brindle.sources import extract


def payload_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows of two classes and a family on some branches."""
    rows = _versions(spark, sf_dir).withColumns({"document_family": F.when(F.col("doc_id") % 2 == 0, "normative").otherwise("general"), "chunk_kind": F.lit("text"), "branch_keys": F.array("document_id", "document_class")})
    found = rank.payload_filter(rows, classes=["en", "fr"], equal={"document_family": "normative"}, branches=["src1", "src3", "fr"])
    return found.select("version_id", "document_id", "document_class")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return search.dense_topk(spark, sf_dir).join(labels, "vec_id")


def branch_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits raised by the branches (labels) that a question's first hits point to."""
    hits = _hits(spark, sf_dir)
    branch = hits.where("rank <= 6").select("query_id", F.col("label").alias("branch_key"), "rank", (F.col("vec_id") % 2).cast("double").alias("structural"))
    done = hierarchy.boost_by_branches(hits.withColumn("keys", F.array("label")), branch, "query_id", "keys", "score", most=2)
    return done.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def role_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("substantive", "reference", "mixed")]), (F.col("doc_id") % 3 + 1).cast("int"))
    align = rank.role_alignment(wanted, F.col("quality").cast("double"), F.when(F.col("quality").isNull(), 0.4), F.col("toxic") * 0.7)
    return rows.select("doc_id", F.round(align, 6).alias("alignment"))


def provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that scored two hits of three, by another measure than ours."""
    hits = search.dense_topk(spark, sf_dir).withColumn("role", (F.col("vec_id") % 5 - 2) / 2.0)
    provided = hits.where("vec_id % 3 <> 0").select("query_id", "vec_id", (F.col("vec_id") % 17).cast("double").alias("provider_score"))
    return rank.merge_provider(hits, provided, "query_id", "vec_id").select("query_id", "vec_id", F.round("merged_score", 6).alias("merged_score"), "merged_rank")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_texts(_fused(spark, sf_dir), spark, sf_dir)


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and soft overlap with the text and the path."""
    rows = _scored(spark, sf_dir)
    return rank.rerank(rows, "item_id", "doc_id", F.col("rrf"), F.col("text"), F.concat_ws(" > ", "source", "lang"), F.col("question")).select("item_id", "doc_id", "rerank_score", "rerank_rank")


def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits that an answer may cite: by focus and score, one a source."""
    rows = _scored(spark, sf_dir).withColumns({"depth": F.col("doc_id") % 4, "unit": F.when(F.col("doc_id") % 3 == 0, "document").otherwise("section"), "kind": F.when(F.col("doc_id") % 5 == 0, "preamble").otherwise("text"), "role": F.lit(0.0), "style": F.lit("summary")})
    rows = rows.withColumn("focus", F.round(answer.focus_score(F.col("question"), F.col("text"), F.col("depth"), F.col("unit"), F.col("kind")), 6))
    return answer.candidates(rows, "item_id", "source", "focus", "role", "rrf", "doc_id", "style").select("item_id", "doc_id", "focus", "answer_rank")


def question_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = understand.structure(table(spark, sf_dir, "benchmark"), "text")
    return rows.select("item_id", F.md5("normalised").alias("normalised_md5"), F.array_join(F.array_sort(F.transform("refs", lambda r: F.concat_ws(":", r["kind"], r["value"]))), ",").alias("refs"), F.array_join("document_markers", ",").alias("markers"), F.array_join("topic_terms", " ").alias("topics"))


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, plan and intent, where a model's class and strategy come with a confidence."""
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    sure = (F.col("doc_id") % 11) / 10.0
    kind, targets = understand.route(pick(None, None, None, "general_document", None), pick(None, None, "normative", None, None, None, "general"), pick("legal_normative", "technical_standard", "none"), sure)
    strategy, style, confidence = understand.plan(pick("focal", "multi_branch", "global", "other"), sure)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("query_type"), F.array_join(targets, ",").alias("targets"), strategy.alias("strategy"), style.alias("style"), F.round(confidence, 6).alias("confidence"), understand.intent(pick("substantive", "reference", "editorial"), sure).alias("intent"))


def gateway_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule results, and a provider that is sure of some."""
    docs = table(spark, sf_dir, "documents")
    rules = docs.select("doc_id", F.lit("general_document").alias("document_class"), F.lit("general").alias("document_family"), F.lit("generic_freeform").alias("chunking_strategy"), (0.45 + (F.col("doc_id") % 6) / 10.0).alias("confidence"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("legal_normative").alias("document_class"), F.lit("normative").alias("document_family"), F.lit("normative_hierarchical").alias("chunking_strategy"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"))
    return classify.gateway(rules, labels, "doc_id").withColumn("confidence", F.round("confidence", 6))


def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active version of each source, of a language of each source, and by a part of the path."""
    v = _versions(spark, sf_dir).withColumn("document_family", F.lit("general"))
    none = F.lit(None).cast("string")
    source = v.select("document_id").distinct()
    base = {"version_id": none, "storage_uri_contains": none, "document_class": none, "document_family": none}
    every = source.withColumns(base | {"selector": F.lit(0)}).unionByName(source.withColumns(base | {"selector": F.lit(1), "document_class": F.lit("fr")})).unionByName(source.withColumns(base | {"selector": F.lit(2), "storage_uri_contains": F.concat(F.lit("STORE/"), "document_id", F.lit("/1")), "document_id": none, "key": F.col("document_id")}).drop("key"))
    cases = every.withColumn("case_id", F.concat_ws(":", "selector", F.coalesce("document_id", "storage_uri_contains")))
    return evaluate.resolve_targets(cases, v)


def evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts hold what an evaluation case asks for, and what fails."""
    some = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rows = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    done = evaluate.verdict(rows, {"all": evaluate.contains_all(F.col("t"), some("QUE", "el")), "any": evaluate.contains_any(F.col("t"), some("Über", "mênt", "tion")), "lang": F.col("lang").isNotNull()})
    return done.select("doc_id", "passed", F.array_join("failed", ",").alias("failed"))


def classification_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as blocks."""
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id"), F.col("turn").alias("block_order"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("block_type"), "text")
    return classify.sample(blocks).select("version_id", F.md5("sample").alias("sample_md5"), "headings")


def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one version, in order."""
    chunks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("version_id"), F.col("turn").alias("chunk_order"), F.md5("text").alias("chunk_md5"))
    return catalog.list_chunks(chunks, "c3")


def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the blocks of a conversation, and whether they have enough text."""
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id"), "text", F.when(F.col("turn") == 0, "short").alias("review_reason"))
    return extract.quality_gate(blocks, 1_200).withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))


def access_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.array(F.concat(F.lit("g"), F.col("doc_id") % 4))).alias("acl_groups"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("ana"), F.col("source"))).alias("acl_users"))
    return catalog.visible(rows, ["g1"], ["ana"]).select("doc_id")


def bm25_fields_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields with boosts, of which the better one counts."""
    docs = table(spark, sf_dir, "documents").withColumn("label", F.concat_ws(" ", "lang", "source", F.lit("the de")))
    questions = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query")
    return retrieval.bm25_top(docs, questions, "doc_id", ["text", "label"], "item_id", "query", search.SPARSE_K, {"text": 1.0, "label": 40.0})


def child_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions' first branches (hosts of pages), the children below them, and of both those that no other extends."""
    from brindle.plans.corpus import _paths

    paths = _paths(spark, sf_dir)
    picked = paths.where("size(path) >= 1").select(F.slice("path", 1, 1).alias("path")).distinct()
    below = hierarchy.expand_children(picked, paths, "path")
    return hierarchy.prune_ancestors(picked.unionByName(below).distinct(), "path").select(F.array_join("path", "/").alias("branch"))


_SOFT = "greatest(CASE WHEN len({q}) > 0 AND len({t}) > 0 THEN len(list_intersect({q}, {t})) / len({q})::DOUBLE ELSE 0 END, CASE WHEN len({q}) > 0 AND len({t}) > 0 THEN len(list_filter({q}, lambda a: len(list_filter({t}, lambda b: a = b OR (length(a) >= 5 AND length(b) >= 5 AND (starts_with(a, b) OR starts_with(b, a))))) > 0)) / len({q})::DOUBLE ELSE 0 END)"
_TOKENS = f"""{sql.fused('fused')}, tk AS (SELECT item_id, doc_id, rrf, source, {sql.content_tokens("coalesce(b.text, '')")} AS q, {sql.content_tokens("coalesce(d.text, '')")} AS w, {sql.content_tokens("concat_ws(' > ', source, lang)")} AS p FROM fused JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))"""
_ESTIMATE = r"greatest(1, ceil(len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) * 1.1::DOUBLE))::BIGINT"
_REFS = " || ".join(f"list_transform(regexp_extract_all(n, '{p}', 1), lambda x: '{k}:' || upper(x))" for k, p in (
    ("article", r"\b(?:art\.?|arto\.?|articulo)\s*([0-9]+(?:\.[0-9]+)?)\b"), ("section", r"\bseccion\s*([0-9]+(?:\.[0-9]+)?)\b"), ("recommendation", r"\brecomendacion\s*([0-9]+(?:\.[0-9]+)?)\b"), ("recommendation", r"\br\.?\s*([0-9]+(?:\.[0-9]+)?)\b"),
    ("annex", r"\banexo\s+([ivxlcdm]+|[0-9]+)\b"), ("chapter", r"\bcapitulo\s+([ivxlcdm]+|[0-9]+)\b"), ("title", r"\btitulo\s+([ivxlcdm]+|[0-9]+)\b"), ("book", r"\blibro\s+([ivxlcdm]+|[0-9]+)\b"), ("paragraph", r"\bparr?afo\s*([0-9]+(?:\.[0-9]+)?)\b"), ("law", r"\bley\s*([0-9]+)\b"),
))
_NAMES = "map {'article': 'arto.', 'section': 'seccion', 'recommendation': 'recomendacion', 'annex': 'anexo', 'chapter': 'capitulo', 'title': 'titulo', 'book': 'libro', 'paragraph': 'parrafo', 'law': 'ley'}"
_NO_TOPIC = "'a al ante como con cual cuales cuando de del donde el ella ellas ellos en entre es esa ese esta este estas estos la las lo los mas menos para pero por que respecto segun si sin sobre solo su sus un una uno unas unos y art arto articulo seccion recomendacion anexo capitulo titulo libro parrafo ley codigo niif nic gafi metodologia'"

QUERIES = {f.__name__: f for f in (payload_filtered, branch_boost, role_alignment, provider_merge, lexical_rerank, answer_candidates, question_topics, question_routes, gateway_decision, resolve_targets, evidence_verdict, classification_sample, chunk_listing, text_quality_gate, access_visible, bm25_fields_topk, child_expansion)}
ORACLE_SQL = {
    "payload_filtered": f"WITH {_V} SELECT version_id, document_id, document_class FROM v WHERE version_status = 'active' AND document_class IN ('en', 'fr') AND doc_id % 2 = 0 AND (document_id IN ('src1', 'src3', 'fr') OR document_class IN ('src1', 'src3', 'fr'))",
    "branch_boost": f"""WITH {_NEAR}, h AS (SELECT near.*, label FROM near JOIN v USING (vec_id)), b AS (SELECT query_id, label, sum(1 / rank::DOUBLE + 0.4::DOUBLE * (vec_id % 2)) AS s FROM h WHERE rank <= 6 GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label::VARCHAR) AS r FROM b) WHERE r <= 2) SELECT query_id, vec_id, round(score + 0.22::DOUBLE * coalesce(s, 0), 6) AS score FROM h LEFT JOIN t USING (query_id, label)""",
    "role_alignment": """WITH r AS (SELECT doc_id, doc_id % 3 AS i, coalesce(quality, 0)::DOUBLE AS s, CASE WHEN quality IS NULL THEN 0.4::DOUBLE ELSE 0 END AS r, coalesce(toxic * 0.7::DOUBLE, 0) AS e FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(greatest(-1, least(1, CASE i WHEN 0 THEN s - greatest(r, e) WHEN 1 THEN r - greatest(s, e) ELSE greatest(s, r) - e END)), 6) AS alignment FROM r""",
    "provider_merge": f"""WITH {_NEAR}, h AS (SELECT query_id, vec_id, rank, (vec_id % 5 - 2) / 2::DOUBLE AS role, CASE WHEN vec_id % 3 <> 0 THEN (vec_id % 17)::DOUBLE END AS p FROM near),
y AS (SELECT *, min(p) OVER w AS low, max(p) OVER w AS high, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, vec_id, rank, CASE WHEN p IS NOT NULL THEN CASE WHEN high > low THEN (p - low) / (high - low) ELSE 1 END + 0.25::DOUBLE * (1 - (rank - 1) / n::DOUBLE) + 0.15::DOUBLE * role END AS x FROM y)
SELECT query_id, vec_id, round(x, 6) AS merged_score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC NULLS LAST, rank)::INT AS merged_rank FROM m""",
    "lexical_rerank": f"WITH {_TOKENS}, o AS (SELECT item_id, doc_id, round(rrf + 0.8::DOUBLE * {_SOFT.format(q='q', t='w')} + 0.3::DOUBLE * {_SOFT.format(q='q', t='p')}, 6) AS rerank_score FROM tk) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id)::INT AS rerank_rank FROM o",
    "answer_candidates": f"""WITH {_TOKENS}, o AS (SELECT item_id, doc_id, rrf, source, round({_SOFT.format(q='q', t='w')} + least(0.35::DOUBLE, 0.08::DOUBLE * (doc_id % 4)) + CASE WHEN doc_id % 3 <> 0 THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <= 1 THEN 0.22::DOUBLE ELSE 0 END, 6) AS focus FROM tk),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY focus DESC, rrf DESC, doc_id) AS r FROM o) SELECT item_id, doc_id, focus, answer_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY focus DESC, rrf DESC, doc_id)::INT AS answer_rank FROM b WHERE r = 1 OR source IS NULL) WHERE answer_rank <= 10""",
    "question_topics": rf"""WITH n AS (SELECT item_id, trim(regexp_replace({sql.fold("coalesce(text, '')")}, '\s+', ' ', 'g')) AS n FROM benchmark), r AS (SELECT *, list_distinct({_REFS}) AS refs FROM n),
m AS (SELECT *, list_distinct(list_filter([CASE WHEN contains(n, 'niif') AND contains(n, 'pymes') THEN 'niif para las pymes' WHEN contains(n, 'niif') THEN 'niif' END, CASE WHEN contains(n, 'gafi') THEN 'gafi' END, CASE WHEN contains(n, 'metodologia') THEN 'metodologia' END, CASE WHEN contains(n, 'codigo') AND contains(n, 'trabajo') THEN 'codigo del trabajo' END, CASE WHEN contains(n, 'nic 39') THEN 'nic 39' END, CASE WHEN contains(n, 'apnfd') THEN 'apnfd' END] || list_transform(list_filter(refs, lambda x: starts_with(x, 'law:')), lambda x: 'ley ' || lower(substr(x, 5))), lambda x: x IS NOT NULL)) AS marks FROM r),
w AS (SELECT *, regexp_extract_all(lower(array_to_string(list_transform(refs, lambda x: {_NAMES}[split_part(x, ':', 1)] || ' ' || split_part(x, ':', 2)), ' ') || ' ' || array_to_string(marks, ' ')), '[\p{{L}}\p{{N}}_]+') AS taken FROM m),
t AS (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_filter(regexp_extract_all(n, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains(string_split({_NO_TOPIC}, ' '), x) AND NOT list_contains(taken, x)) AS l FROM w)),
f AS (SELECT item_id, x, min(i) AS i FROM t GROUP BY ALL), k AS (SELECT item_id, string_agg(x, ' ' ORDER BY i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM f) WHERE r <= 8 GROUP BY item_id)
SELECT item_id, md5(n) AS normalised_md5, coalesce(array_to_string(list_sort(refs), ','), '') AS refs, coalesce(array_to_string(marks[1:4], ','), '') AS markers, coalesce(topics, '') AS topics FROM w LEFT JOIN k USING (item_id)""",
    "question_routes": """WITH r AS (SELECT doc_id, (doc_id % 11) / 10::DOUBLE AS c, CASE WHEN doc_id % 5 = 3 THEN 'general_document' WHEN doc_id % 7 = 6 THEN 'general_document' WHEN doc_id % 7 = 2 THEN 'normative' WHEN (doc_id % 11) / 10::DOUBLE >= 0.45 AND doc_id % 3 < 2 THEN ['legal_normative', 'technical_standard'][doc_id % 3 + 1] ELSE 'all_domains' END AS k FROM documents),
s AS (SELECT *, c >= 0.55 AND doc_id % 4 < 3 AS sure FROM r), t AS (SELECT *, CASE WHEN sure THEN ['focal', 'multi_branch', 'global'][doc_id % 4 + 1] ELSE 'focal' END AS strategy FROM s)
SELECT doc_id, k AS query_type, CASE k WHEN 'normative' THEN 'legal_normative,technical_standard' WHEN 'all_domains' THEN 'legal_normative,technical_standard,general_document' ELSE k END AS targets, strategy, CASE strategy WHEN 'focal' THEN 'single_branch' WHEN 'global' THEN 'summary' ELSE 'grouped_by_branch' END AS style,
  CASE WHEN sure THEN c ELSE 0.34::DOUBLE END AS confidence, CASE WHEN c >= 0.55 THEN ['substantive', 'reference', 'editorial'][doc_id % 3 + 1] ELSE 'mixed' END AS intent FROM t""",
    "gateway_decision": """WITH r AS (SELECT doc_id, 0.45::DOUBLE + (doc_id % 6) / 10::DOUBLE AS c, quality FROM documents LEFT JOIN labels USING (doc_id)), u AS (SELECT *, c < 0.93 AND coalesce(quality, 0) = 1 AS use FROM r)
SELECT doc_id, CASE WHEN use THEN 'legal_normative' ELSE 'general_document' END AS document_class, CASE WHEN use THEN 'normative' ELSE 'general' END AS document_family, CASE WHEN use THEN 'normative_hierarchical' ELSE 'generic_freeform' END AS chunking_strategy, round(CASE WHEN use THEN 0.9::DOUBLE ELSE c END, 6) AS confidence FROM u""",
    "resolve_targets": f"""WITH {_V}, a AS (SELECT * FROM v WHERE version_status = 'active'), d AS (SELECT DISTINCT document_id AS s FROM v),
p AS (SELECT '0:' || s AS case_id, a.* FROM d JOIN a ON document_id = s UNION ALL SELECT '1:' || s, a.* FROM d JOIN a ON document_id = s AND document_class = 'fr' UNION ALL SELECT '2:STORE/' || s || '/1', a.* FROM d JOIN a ON contains(lower(storage_uri), lower('STORE/' || s || '/1')))
SELECT case_id, arg_max(version_id, doc_id) AS version_id, count(*) > 1 AS ambiguous FROM p GROUP BY case_id""",
    "evidence_verdict": f"""WITH t AS (SELECT doc_id, lang, {sql.fold("coalesce(text, '')")} AS h FROM documents), c AS (SELECT doc_id, contains(h, 'que') AND contains(h, 'el') AS a, contains(h, 'uber') OR contains(h, 'ment') OR contains(h, 'tion') AS b, lang IS NOT NULL AS l FROM t)
SELECT doc_id, a AND b AND l AS passed, array_to_string(list_filter([CASE WHEN NOT a THEN 'all' END, CASE WHEN NOT b THEN 'any' END, CASE WHEN NOT l THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS failed FROM c""",
    "classification_sample": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE coalesce(text, '') <> ''), s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY r) AS t FROM k WHERE r <= 8 GROUP BY conv_id), h AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS headings FROM conversations GROUP BY conv_id)
SELECT conv_id AS version_id, md5(substr(coalesce(t, ''), 1, 12000)) AS sample_md5, headings FROM h LEFT JOIN s USING (conv_id)""",
    "chunk_listing": "SELECT 'c' || conv_id AS version_id, turn AS chunk_order, md5(text) AS chunk_md5 FROM conversations WHERE conv_id = 3",
    "text_quality_gate": """WITH g AS (SELECT conv_id, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS n_blocks, sum(length(trim(coalesce(text, ''))))::BIGINT AS n_chars, max(CASE WHEN turn = 0 THEN 'short' END) AS reason FROM conversations GROUP BY conv_id)
SELECT conv_id AS version_id, n_blocks, n_chars, n_chars < 1200 AS review_required, CASE WHEN n_chars < 1200 THEN coalesce(reason, 'low_text_yield') END AS review_reason FROM g""",
    "access_visible": "SELECT doc_id FROM documents WHERE (doc_id % 3 = 0 AND doc_id % 5 <> 0) OR (doc_id % 3 > 0 AND doc_id % 4 = 1) OR doc_id % 5 = 0",
    "bm25_fields_topk": f"""WITH f AS (SELECT doc_id, 'text' AS field, {sql.tokens("coalesce(text, '')")} AS l FROM documents UNION ALL SELECT doc_id, 'label', {sql.tokens("concat_ws(' ', lang, source, 'the de')")} FROM documents),
z AS (SELECT field, sum(len(l)) / count(*)::DOUBLE AS avg, count(*) AS n FROM f GROUP BY field), u AS (SELECT doc_id, field, len(l) AS len, unnest(l) AS term FROM f), p AS (SELECT doc_id, field, term, len, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({sql.tokens("coalesce(text, '')")}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, field, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) AS s FROM q JOIN p USING (term) JOIN d USING (field, term) JOIN z USING (field) GROUP BY ALL),
b AS (SELECT item_id, doc_id, round(max(CASE WHEN field = 'label' THEN 40 ELSE 1 END * s), 6) AS score FROM s GROUP BY ALL) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM b) WHERE rank <= 12""",
    "child_expansion": """WITH p AS (SELECT list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> ''), lambda x: lower(x)) AS path FROM pages), h AS (SELECT DISTINCT path[1:1] AS b FROM p WHERE len(path) >= 1), c AS (SELECT DISTINCT path[1:2] AS b FROM p WHERE len(path) >= 2)
SELECT array_to_string(b, '/') AS branch FROM c UNION ALL SELECT array_to_string(b, '/') FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.b[1:1] = h.b)""",
}
ORACLE_SQL["segment_rows"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS c FROM documents), s AS (SELECT doc_id, c, list_filter(list_transform(string_split_regex(c, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p, list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS t FROM d),
l AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p WHEN len(t) > 1 THEN t ELSE [trim(c)] END AS l FROM s), u AS (SELECT doc_id, unnest(l) AS x, (generate_subscripts(l, 1) - 1)::INT AS segment FROM l)
SELECT doc_id, segment, {_ESTIMATE.format(c='x')} AS tokens, md5(x) AS segment_md5 FROM u"""
