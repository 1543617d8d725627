"""Commands that write: ingest files, chunk versions, index chunks, delete versions, and answer questions from the index.

Ids follow from content, so a command that is repeated, or begun again after a failure, changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import embedding
from brindle.functions.text import compress
from brindle.operators import answer, branches, catalog, chunking, classify, enrich, hierarchy, rank, retrieval, understand
from brindle.sources import extract
from brindle.sources.store import Store

PROFILE = "hash256"
#: The index's text fields and the boosts of the best one.
FIELDS = {"contextualised_text": 4.0, "chunk_summary": 5.0, "variants_text": 6.0, "canonical_label": 4.0, "unit_topic": 5.0, "path_text": 2.0}


def ingest(store: Store, files: DataFrame, source: str = "upload", status: str = catalog.ACTIVE) -> DataFrame:
    """Files to blocks, quality gate and classification; writes ``blocks``, ``versions`` and ``documents`` and returns the versions of these files.

    A document is a path without its suffix; files of equal content are one version. A version with too little text waits for review.
    """
    files = files.dropDuplicates(["version_id"])
    blocks = store.replace("blocks", extract.extract(files), "version_id").join(files.select("version_id"), "version_id", "left_semi")
    sample = classify.sample(blocks)
    named = files.select("version_id", "checksum", F.col("path").alias("storage_uri"), "created_at", F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = named.join(sample, "version_id", "left").join(extract.quality_gate(blocks).drop("n_blocks"), "version_id", "left")
    known = classify.classify(rows.withColumn("headings", F.coalesce("headings", F.lit(0))), "name", "sample", headings="headings")
    versions = known.select("version_id", F.md5(F.regexp_replace("storage_uri", r"\.[A-Za-z0-9]+$", "")).alias("document_id"), "checksum", F.lit(source).alias("source"), F.lit(status).alias("version_status"), "storage_uri", "created_at", "name", "document_class", "document_family", "chunking_strategy", "confidence", F.coalesce("review_required", F.lit(True)).alias("review_required"), "review_reason")
    written = store.merge("versions", versions, "version_id")
    store.write("documents", catalog.latest_versions(written))
    return written.join(files.select("version_id"), "version_id", "left_semi")


def chunk(store: Store, force: bool = False, window: chunking.Window | None = None) -> DataFrame:
    """Chunks of all versions that have none, or of all with ``force``, by the strategy that their row holds; writes ``chunks``. Versions under review are left out."""
    versions, blocks, old = store.read("versions").where("NOT review_required"), store.read("blocks"), store.read("chunks")
    if old is not None and not force:
        versions = versions.join(old.select("version_id").distinct(), "version_id", "left_anti")
    ordered = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("block_order", "text"))))
    texts = blocks.groupBy("version_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))  # a document's own blocks
    made = chunking.chunk_documents(versions.select("version_id", "chunking_strategy").join(texts, "version_id"), "version_id", "text", "chunking_strategy", window)
    pending = made.withColumns({"index_status": F.lit("pending"), "indexed_profile": F.lit(None).cast("string")})
    return store.replace("chunks", pending, "version_id")


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with ``title`` and ``path`` as rows of the index, vectors included."""
    docs = enrich.index_documents(chunks, "title", "path", "chunk").withColumns({"variants_text": F.array_join("reference_variants", " "), "branch_keys": F.transform(hierarchy.prefixes(F.col("path")), hierarchy.branch_id)})
    return docs.join(embedding.vectors(docs, "chunk_id", "embedding_text"), "chunk_id")


def reindex(store: Store, profile: str = PROFILE, limit: int = 100, force: bool = False, document_class: str | None = None) -> DataFrame:
    """Indexes the versions that are not indexed for ``profile``, the newest first; writes ``index`` and the chunks' status, and returns ``(version_id, chunks, status)``."""
    chunks, versions = store.read("chunks"), store.read("versions")
    targets = catalog.reindex_targets(chunks, versions, profile, document_class, limit, force).select("version_id", "document_id", "document_class", "document_family", "version_status", F.col("name").alias("title"))
    rows = chunks.drop("index_status", "indexed_profile").join(targets, "version_id")
    index = store.replace("index", index_rows(rows), "version_id")
    done = index.select("chunk_id").withColumn("__done", F.lit(True))
    hit = F.col("__done").isNotNull() & F.col("version_id").isNotNull()
    mine = chunks.join(targets.select("version_id"), "version_id", "left_semi").join(done, "chunk_id", "left")
    marked = mine.withColumns({"index_status": F.when(hit, "indexed").otherwise("failed"), "indexed_profile": F.when(hit, profile)}).drop("__done")
    store.replace("chunks", marked.select(chunks.columns), "version_id")
    return marked.groupBy("version_id").agg(F.count("*").alias("chunks"), F.max("index_status").alias("status"))


def delete(store: Store, gone: DataFrame) -> None:
    """Versions ``gone(version_id)`` go from every table, and their documents are re-pointed."""
    for name in ("index", "chunks", "blocks", "versions"):
        store.remove(name, gone, "version_id")
    store.write("documents", catalog.latest_versions(store.read("versions")))


def branch_rows(index: DataFrame) -> DataFrame:
    """Every branch of the index as a row of the index's own form: its key is the branch's, its text that of the chunk nearest to it."""
    each = index.select("chunk_id", F.size("path").alias("n"), F.explode(hierarchy.prefixes(F.col("path"))).alias("p"))
    lead = each.groupBy(hierarchy.branch_id(F.col("p")).alias("branch_key")).agg(F.min(F.struct(F.col("n") - F.size("p"), "chunk_id"))["chunk_id"].alias("chunk_id"), F.min("p").alias("__path"), F.count("*").alias("members"), F.max(F.col("n") > F.size("p")).alias("has_children"))
    payload = index.select("chunk_id", "title", "chunk", "version_id", "document_id", "document_class", "document_family", "version_status")
    rows = lead.join(payload, "chunk_id").drop("chunk_id").withColumnsRenamed({"branch_key": "chunk_id", "__path": "path"})
    parent = F.when(F.size("path") > 1, hierarchy.branch_id(F.slice("path", 1, F.size("path") - 1)))
    return index_rows(rows.withColumn("parent_branch_key", parent))


def reindex_branches(store: Store) -> DataFrame:
    """Writes ``branches`` from the whole index and returns it."""
    return store.write("branches", branch_rows(store.read("index")))


def _lists(index: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists ``(query_id, variant, __n, score, rank)`` of every rewrite of the questions."""
    rewrites = understand.variants(asked, "query_id", "question").withColumn("__q", F.xxhash64("query_id", "variant"))
    near = retrieval.dense_topk(embedding.vectors(rewrites, "__q", "query"), index, k, query_id="__q", vector_id="__n", vector="vector")
    near = near.select(F.col("query_id").alias("__q"), F.col("vec_id").alias("__n"), "score", "rank")
    sparse = retrieval.bm25_top(index, rewrites, "__n", list(FIELDS), "__q", "query", k, FIELDS)
    by_variant = rewrites.select("__q", "query_id", "variant")
    return near.join(by_variant, "__q"), sparse.join(by_variant, "__q")


def _met(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits with their question and references, under the names that reference scores read."""
    kept = [c for c in ("query_id", "question", "refs", "strategy") if c in asked.columns]
    return rows.join(asked.select(*kept), "query_id").withColumns({"retrieval_context": F.col("chunk_summary"), "raw_text": F.col("chunk")})


def find_branches(branches_table: DataFrame, asked: DataFrame, k: int = 12) -> DataFrame:
    """Ranked branches for questions as :func:`understand.structure` gives them, as many as ``strategy`` allows; adds ``structural`` and ``specific``."""
    table = branches_table.where("version_status = 'active'").withColumn("__n", F.xxhash64("chunk_id"))
    found = branches.fuse(*_lists(table, asked, k), asked, "query_id", "__n")
    rows = _met(found.join(table, "__n"), asked)
    return rows.withColumns({"structural": rank.structural_score(F.col("refs")), "specific": branches.is_specific(F.col("unit_type"), F.col("unit_number"), F.col("canonical_label"), F.col("path"))})


def _guided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Hits raised by the branches that were found, and the selected branches' own rows beside them."""
    guide = found.select("query_id", F.col("chunk_id").alias("branch_key"), "rank", "structural")
    rows = hierarchy.boost_by_branches(rows, guide, "query_id", "branch_keys", "rrf")
    selected = branches.select(found.withColumn("__p", F.lit(None).cast("double")), "query_id", "chunk_id", "rank", "rrf", "__p", "strategy")
    added = branches.candidates(selected, "query_id", "chunk_id", "rank", "strategy", "specific")
    return rows.unionByName(added.drop("rank", "structural", "specific", "branch_rank", "__p"), allowMissingColumns=True)



def find(index: DataFrame, questions: DataFrame, k: int = 12, final: int = 8, branch_table: DataFrame | None = None) -> DataFrame:
    """``questions(query_id, question)`` to ranked chunks of the table ``index``: dense and sparse lists of every rewrite, merged and fused, scored by overlap and references, spread over branches.

    With the table of branches, these are searched too: chunks below the best ones rise, and some enter as hits of their
    own. ``questions`` may hold a ``strategy``; without one it is focal.
    """
    index = rank.payload_filter(index).withColumn("__n", F.xxhash64("chunk_id"))
    asked = understand.structure(questions, "question")
    asked = asked if "strategy" in asked.columns else asked.withColumn("strategy", F.lit("focal"))
    near, sparse = _lists(index, asked, k)
    merged = lambda lists: retrieval.merge_lists(lists, "query_id", "__n").where(F.col("rank") <= k)
    rows = _met(retrieval.rrf(merged(near), merged(sparse), "query_id", "__n").join(index, "__n"), asked)
    rows = rows if branch_table is None else _guided(rows, find_branches(branch_table, asked, k))
    extra = F.when(rank.exact_reference(F.col("question"), F.col("chunk")), rank.WEIGHTS["exact"]).otherwise(0.0) + rank.structural_score(F.col("refs")) - rank.mismatch_penalty(F.col("refs"))
    scored = rank.rerank(rows, "query_id", "chunk_id", F.col("rrf"), F.col("contextualised_text"), F.col("path_text"), F.col("question"), extra)
    spread = hierarchy.diversify(scored.withColumn("branch", F.element_at("branch_keys", -1)), "query_id", "branch", "rerank_rank", 3)
    return spread.where(F.col("position") <= final).withColumnRenamed("position", "final_rank")


def answer_questions(index: DataFrame, questions: DataFrame, style: str = "single_branch", branch_table: DataFrame | None = None) -> DataFrame:
    """``(query_id, answer, confidence, source_conflict, fallback_reason, citations)`` for each question; one without hits says so."""
    hits = find(index, questions, branch_table=branch_table)
    cited = hits.withColumns({"evidence": answer.best_fragment(F.col("question"), F.col("chunk"), F.col("canonical_label")), "style": F.lit(style)})
    said = answer.answers(cited, "query_id", "final_rank", "evidence", "path_text", "style")
    sure = rank.outcome(hits, "query_id", "document_id", "final_rank", "rrf")
    label = F.concat(F.lit("["), F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank")).cast("string"), F.lit("] "), F.col("title"), F.lit(": "), compress(F.col("path_text"), 120))
    labels = hits.withColumn("label", label).groupBy("query_id").agg(F.array_sort(F.collect_list("label")).alias("citations"))  # a few a question
    rows = questions.select("query_id").join(said, "query_id", "left").join(sure, "query_id", "left").join(labels, "query_id", "left")
    return rows.select("query_id", F.coalesce("answer", F.lit(answer.NO_ANSWER)).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source_conflict", F.lit(False)).alias("source_conflict"), F.when(F.col("answer").isNull(), "no_retrieval_hits").otherwise(F.col("fallback_reason")).alias("fallback_reason"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
