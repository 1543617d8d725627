"""Ranking of hits: filters, reference clauses, heuristic scores, provider merge, visibility, comparison cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import content_tokens, fold, overlap, soft_overlap
from brindle.shipping import by_value

by_value(__name__)

# The weights of the heuristic score and the reference boosts.
WEIGHTS = {"lexical": 0.8, "path": 0.3, "exact": 0.2, "role": 0.55}
FIELD_BOOSTS = {"contextualized_text": 4.0, "chunk_summary_context": 5.0, "reference_variants_text": 6.0, "canonical_label": 4.0, "unit_topic": 5.0, "unit_key": 5.0, "document_title": 2.0, "focus_terms_text": 3.0, "retrieval_context": 3.0, "path_text": 2.0, "raw_text": 1.0}
EXACT = r"(art\.?\s*[0-9]+|arto\.?\s*[0-9]+|articulo\s+[0-9]+|seccion\s+[0-9]+|recomendacion\s+[0-9]+|r\.?\s*[0-9]+|ley\s+[0-9]+)"
TERM_BOOSTS = {"article": 13.0, "section": 13.0, "recommendation": 13.0, "annex": 13.0, "chapter": 12.0, "title": 12.0, "book": 12.0, "paragraph": 12.0}
PHRASE_BOOSTS = {
    "article": {"canonical_label": 12.0, "reference_variants_text": 12.0, "path_text": 8.0, "retrieval_context": 7.0, "raw_text": 6.0},
    "section": {"canonical_label": 12.0, "reference_variants_text": 12.0, "path_text": 9.0, "retrieval_context": 8.0, "raw_text": 7.0},
    "recommendation": {"canonical_label": 11.0, "reference_variants_text": 11.0, "path_text": 10.0, "retrieval_context": 9.0, "raw_text": 8.0},
    "annex": {"canonical_label": 12.0, "reference_variants_text": 12.0, "path_text": 10.0, "retrieval_context": 8.0},
    "chapter": {"canonical_label": 10.0, "reference_variants_text": 10.0, "path_text": 8.0, "retrieval_context": 7.0},
    "title": {"canonical_label": 10.0, "reference_variants_text": 10.0, "path_text": 8.0, "retrieval_context": 7.0},
    "book": {"canonical_label": 10.0, "reference_variants_text": 10.0, "path_text": 8.0, "retrieval_context": 7.0},
    "paragraph": {"canonical_label": 10.0, "reference_variants_text": 10.0, "path_text": 8.0, "retrieval_context": 7.0},
    "law": {"path_text": 4.0, "retrieval_context": 4.0, "raw_text": 4.0},
}


def payload_filter(rows: DataFrame, classes: list[str] | None = None, equal: dict[str, str] | None = None, branches: list[str] | None = None, parents: list[str] | None = None) -> DataFrame:
    """Active rows of the routed classes that meet the equality filters and lie on one of the branches."""
    out = rows.where("version_status = 'active'")
    if classes:
        out = out.where(F.col("document_class").isin(*classes))
    for name in ("document_class", "document_family", "document_id", "version_id", "chunk_kind"):
        if (equal or {}).get(name) is not None:
            out = out.where(F.col(name) == equal[name])
    if branches:
        out = out.where(F.arrays_overlap("branch_keys", F.array(*[F.lit(b) for b in branches])))
    if parents:
        out = out.where(F.col("parent_branch_key").isin(*parents))
    return out


def reference_bonus(refs: Column, kinds: dict[str, str]) -> Column:
    """The sum of boosts of a question's references that an index document meets: its unit key, and phrases in its fields.

    ``kinds`` maps the fields of ``PHRASE_BOOSTS`` to the columns that hold them.
    """
    hay = {f: fold(F.coalesce(F.col(c), F.lit(""))) for f, c in kinds.items()}

    def of(r: Column) -> Column:
        key = F.coalesce(F.lower("unit_key") == F.lower(F.concat_ws(":", r["kind"], r["value"])), F.lit(False))
        total = F.lit(0.0)
        for kind, boost in TERM_BOOSTS.items():
            total = total + F.when((r["kind"] == kind) & key, boost).otherwise(0.0)
        for kind, fields in PHRASE_BOOSTS.items():
            for f, boost in fields.items():
                if f in hay:
                    total = total + F.when((r["kind"] == kind) & F.contains(hay[f], fold(r["label"])), boost).otherwise(0.0)
        return total

    return F.aggregate(refs, F.lit(0.0), lambda a, r: a + of(r))


def structural_score(refs: Column) -> Column:
    """How well a hit's unit, path and context meet the references; needs ``unit_key, article_label, section_label, subsection_label, canonical_label, path_text, retrieval_context, raw_text``."""
    text = lambda name: fold(F.coalesce(F.col(name), F.lit("")))
    path, context, raw = fold(F.regexp_replace(F.coalesce(F.col("path_text"), F.lit("")), " > ", " ")), text("retrieval_context"), F.substring(text("raw_text"), 1, 500)

    def of(r: Column) -> Column:
        n, kind = F.lower(r["value"]), r["kind"]
        key = F.lower(F.coalesce(F.col("unit_key"), F.lit(""))) == F.concat_ws(":", kind, n)
        has = lambda hay, word: F.contains(hay, F.concat(F.lit(word + " "), n))
        spelled = F.array(*[F.concat(F.lit(w + " "), n) for w in ("arto.", "art.", "articulo")])
        article = F.when(key, 0.75).otherwise(0.0) + F.when(F.array_contains(spelled, text("article_label")), 0.7).when(F.exists(spelled, lambda s: F.contains(path, s)), 0.45).otherwise(0.0)
        section = F.when(key, 0.75).otherwise(0.0) + F.when(F.startswith(text("section_label"), F.concat(F.lit("seccion "), n)), 0.7).when(has(path, "seccion") | has(context, "seccion"), 0.45).otherwise(0.0)
        dotted = F.concat(n, F.lit("."))
        recommendation = F.when(key, 0.75).otherwise(0.0) + F.when(has(path, "recomendacion") | has(context, "recomendacion"), 0.6).when(F.startswith(text("subsection_label"), dotted) | F.startswith(text("section_label"), dotted), 0.35).when(has(raw, "recomendacion") | has(raw, "r."), 0.3).otherwise(0.0)
        annex = F.when(key, 0.75).when(has(path, "anexo") | has(text("canonical_label"), "anexo"), 0.5).otherwise(0.0)
        words = {"chapter": "capitulo", "title": "titulo", "book": "libro", "paragraph": "parrafo"}
        other = F.coalesce(*[F.when((kind == k) & has(text("canonical_label"), w), F.lit(0.4)) for k, w in words.items()], F.lit(0.0))
        other = F.when(kind.isin(*words) & key, 0.65).otherwise(other)
        law = F.when(has(context, "ley") | has(raw, "ley"), 0.15).otherwise(0.0)
        return F.when(kind == "article", article).when(kind == "section", section).when(kind == "recommendation", recommendation).when(kind == "annex", annex).when(kind == "law", law).otherwise(other)

    return F.aggregate(refs, F.lit(0.0), lambda a, r: a + of(r))


def mismatch_penalty(refs: Column) -> Column:
    """What a hit loses for naming another article, section or recommendation than asked for."""
    text = lambda name: fold(F.coalesce(F.col(name), F.lit("")))
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    path, raw = fold(F.regexp_replace(F.coalesce(F.col("path_text"), F.lit("")), " > ", " ")), F.substring(text("raw_text"), 1, 300)
    article = F.regexp_extract(some(text("article_label"), path), r"\b(?:arto\.|art\.|articulo)\s*([0-9]+)\b", 1)
    section = F.regexp_extract(some(text("section_label"), path, raw), r"\bseccion\s*([0-9]+)\b", 1)
    recommendation = F.regexp_extract(F.concat_ws(" ", path, text("subsection_label"), text("section_label"), raw), r"\brecomendacion\s*([0-9]+)\b", 1)
    leading = F.regexp_extract(text("subsection_label"), r"^([0-9]{1,2})\.", 1)
    off = lambda found, r: (found != "") & (found != r["value"])
    of = lambda r: F.when((r["kind"] == "article") & off(article, r), 0.6).when((r["kind"] == "section") & off(section, r), 0.45).when((r["kind"] == "recommendation") & off(recommendation, r), 0.75).when((r["kind"] == "recommendation") & off(leading, r), 0.35).otherwise(0.0)
    return F.aggregate(refs, F.lit(0.0), lambda a, r: a + of(r))


def exact_reference(question: Column, payload: Column) -> Column:
    """Whether a reference of the question stands in the payload literally."""
    hay = fold(payload)
    return F.exists(F.regexp_extract_all(fold(question), F.lit(EXACT), F.lit(1)), lambda r: F.contains(hay, r))


def role_alignment(intent: Column, substantive: Column, reference: Column, editorial: Column) -> Column:
    """From -1 to 1: how far the evidence's role is the one the question wants."""
    s, r, e = (F.coalesce(x, F.lit(0.0)) for x in (substantive, reference, editorial))
    raw = F.when(intent == "substantive", s - F.greatest(r, e)).when(intent == "reference", r - F.greatest(s, e)).otherwise(F.greatest(s, r) - e)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def lexical(question: Column, text: Column) -> Column:
    q, t = content_tokens(F.coalesce(question, F.lit(""))), content_tokens(F.coalesce(text, F.lit("")))
    return F.greatest(overlap(q, t), soft_overlap(q, t))


def rerank(hits: DataFrame, query_id: str, key: str, base: Column, text: Column, path: Column, question: Column, extra: Column | None = None, digits: int = 6) -> DataFrame:
    """``hits`` with ``rerank_score`` and ``rerank_rank``: the fused score, lexical and path overlap, and what ``extra`` adds."""
    score = base + WEIGHTS["lexical"] * lexical(question, text) + WEIGHTS["path"] * lexical(question, path) + (extra if extra is not None else F.lit(0.0))
    order = Window.partitionBy(query_id).orderBy(F.col("rerank_score").desc(), key)
    return hits.withColumn("rerank_score", F.round(score, digits)).withColumn("rerank_rank", F.row_number().over(order))


def merge_provider(hits: DataFrame, provided: DataFrame, query_id: str, key: str) -> DataFrame:
    """Order by a provider's scores, min-max normalised, with 0.25 for position and 0.15 for role; hits it did not score follow.

    ``hits(query_id, key, rank, role)``, ``provided(query_id, key, provider_score)``; adds ``merged_score, merged_rank``.
    """
    own = Window.partitionBy(query_id)
    rows = hits.join(provided, [query_id, key], "left")
    low, high = F.min("provider_score").over(own), F.max("provider_score").over(own)
    n = F.count("*").over(own)
    unit = F.when(high > low, (F.col("provider_score") - low) / (high - low)).otherwise(1.0)
    rows = rows.withColumn("merged_score", F.when(F.col("provider_score").isNotNull(), unit + 0.25 * (1 - (F.col("rank") - 1) / n) + 0.15 * F.col("role")))
    order = own.orderBy(F.col("merged_score").desc_nulls_last(), "rank")
    return rows.withColumn("merged_rank", F.row_number().over(order))


def visibility(hits: DataFrame, query_id: str, window: int = 3, least: float = 0.35) -> DataFrame:
    """Order of a focal question's few hits: weak evidence at the top gives way, then the first hit's branch fills the window.

    ``hits(query_id, key, rank, role, score, branch, selected, lead)`` with the hits of a question already cut to a few dozen.
    A position whose role is below ``least`` takes the best later hit of a selected branch and role; others move down.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        top = min(window, len(rows))
        if any(r["selected"] for r in rows):
            for at in range(top):
                if rows[at]["role"] >= least:
                    continue
                later = [(r["role"], r["score"], -i, i) for i, r in enumerate(rows) if i > at and r["selected"] and r["role"] >= least]
                if later:
                    rows.insert(at, rows.pop(max(later)[-1]))
            if rows[0]["selected"] and rows[0]["branch"] is not None:
                for at in range(1, top):
                    if rows[at]["branch"] != rows[0]["branch"]:
                        later = [(r["score"] + (1.0 if r["lead"] else 0.0), -i, i) for i, r in enumerate(rows) if i > at and r["branch"] == rows[0]["branch"]]
                        if later:
                            rows.insert(at, rows.pop(max(later)[-1]))
        out = pd.DataFrame(rows, columns=pdf.columns)
        out["position"] = range(1, len(out) + 1)
        return out

    from pyspark.sql import types as T

    return hits.groupBy(query_id).applyInPandas(of, T.StructType([*hits.schema.fields, T.StructField("position", T.LongType())]))


def cover_clauses(hits: DataFrame, query_id: str, key: str, clauses: str, text: str, least: float = 0.45) -> DataFrame:
    """Comparison questions: the best hit of each clause comes first, in the order of clauses, then the others; adds ``position``.

    ``hits(query_id, key, rank, clauses array, text)``; a hit stands for the first clause it is best for.
    """
    each = hits.select(query_id, key, "rank", F.posexplode(clauses).alias("__c", "__clause"), text).withColumn("__o", lexical(F.col("__clause"), F.col(text))).where(F.col("__o") >= least)
    best = each.withColumn("r", F.row_number().over(Window.partitionBy(query_id, "__c").orderBy(F.col("__o").desc(), "rank"))).where("r = 1").groupBy(query_id, key).agg(F.min("__c").alias("__c"))
    order = Window.partitionBy(query_id).orderBy(F.col("__c").asc_nulls_last(), "rank")
    return hits.join(best, [query_id, key], "left").withColumn("position", F.row_number().over(order)).drop("__c")


def outcome(hits: DataFrame, query_id: str, document: str, rank: str, score: str) -> DataFrame:
    """``(query_id, confidence, source_conflict, fallback_reason)``: by the first hit's score, and whether the first two come from different documents."""
    rows = hits.groupBy(query_id).agg(F.max(score).alias("best"), F.max(F.when(F.col(rank) == 1, F.col(document))).alias("a"), F.max(F.when(F.col(rank) == 2, F.col(document))).alias("b"))
    sure = F.round(F.least(F.lit(0.95), 0.35 + 3 * F.col("best")), 2)
    return rows.select(query_id, F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("source_conflict"), F.when(F.col("a").isNull(), "no_retrieval_hits").alias("fallback_reason"))
