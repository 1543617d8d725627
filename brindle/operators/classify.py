"""Rule classification of documents into classes and chunking strategies, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import LINE_END

# The markers, keywords and thresholds that define the classes.
MEETING = (r"\bacta\b", r"\bsesi[oó]n\b", r"\breuni[oó]n\b", r"\bpuntos?\s+de\s+agenda\b", r"\borden\s+del\s+d[ií]a\b", r"\blectura\s+de\s+acuerdos?\s+anteriores\b")
MEETING_KIND = (r"\bconsejo\s+directivo\b", r"\breuni[oó]n\s+ordinaria\b", r"\breuni[oó]n\s+extraordinaria\b")
TECHNICAL = (r"\bniif\b", r"\bifrs\b", r"\bnic\b", r"\bnorma\s+de\s+contabilidad\b", r"\bm[oó]dulo\s+educativo\b", r"\bestudio\s+de\s+caso\b", r"\bpreguntas?\s+de\s+autoevaluaci[oó]n\b", r"\bconsejo\s+de\s+normas\s+internacionales\s+de\s+contabilidad\b", r"\bfundaci[oó]n\s+ifrs\b", r"\bsecci[oó]n\s+[0-9]+\b")
LEGAL_WORDS = ("ley", "código", "codigo", "reglamento", "normativa", "resolución", "resolucion", "decreto", "arto.", "artículo", "articulo", "capítulo", "capitulo", "título", "titulo", "libro")
STRUCTURED_WORDS = ("manual", "procedimiento", "instructivo", "política", "politica", "guía", "guia", "objetivo", "alcance", "responsabilidades", "anexo", "agenda")
ARTICLE, CHAPTER = r"\bart(?:[íi]culo|o)?\.?\s+[0-9]+", r"\bcap[íi]tulo\s+[ivxlc0-9]+"
TITLE, BOOK = r"\bt[íi]tulo\s+[ivxlc0-9]+|\bt[íi]tulo\s+preliminar", r"\blibro\s+[ivxlc0-9]+|\blibro\s+(?:primero|segundo|tercero|cuarto)"
STRUCTURED_MARKERS = (r"\bacta\b", r"\bsesi[oó]n\b", r"\breuni[oó]n\b", r"\bmanual\b", r"\bprocedimiento\b", r"\bobjetivo\b", r"\balcance\b", r"\bresponsabilidades\b", r"\banexo\b", r"\bagenda\b", r"\bestado de resultados\b", r"\bestado de situaci[oó]n financiera\b")
MEETING_CONFIDENCE, FALLBACK_CONFIDENCE = 0.94, 0.45
SAMPLE_BLOCKS, SAMPLE_CHARS, HEADING_LINES = 8, 12_000, 40


def sample(blocks: DataFrame, key: str = "version_id", most_blocks: int = SAMPLE_BLOCKS, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``(key, sample, headings)``: the first non-empty blocks' texts in order, joined and cut, and the number of heading and table blocks."""
    first = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("block_order", "text"))))
    return blocks.groupBy(key).agg(
        F.substring(F.array_join(F.transform(F.slice(first, 1, most_blocks), lambda b: b["text"]), "\n"), 1, most_chars).alias("sample"),
        F.count_if(F.col("block_type").isin("heading", "table")).alias("headings"),
    )


def literal(pattern: str) -> str:
    """The longest text that every match of a pattern without groups and alternatives holds."""
    return max(re.split(r"\[[^\]]*\][+*?]?|\\.[+*?]?|.[*?]", pattern), key=len)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns are found; one is sought only where its literal is, which is much cheaper to see."""
    found = [(F.contains(text, F.lit(literal(p))) & text.rlike(p)).cast("int") for p in patterns]
    return sum(found[1:], found[0])


def capital_lines(text: Column) -> Column:
    """Lines of more than six characters, among the first forty, that have no lower-case letter."""
    head = F.transform(F.slice(F.split(text, LINE_END, HEADING_LINES + 1), 1, HEADING_LINES), lambda x: F.trim(x))
    return F.size(F.filter(head, lambda x: (x == F.upper(x)) & (F.length(x) > 6)))


def classify(docs: DataFrame, name: str, text: str, mime: str | None = None, headings: str | None = None) -> DataFrame:
    """``docs`` with ``document_class, document_family, chunking_strategy, confidence, rule``.

    Meeting markers win over technical ones, technical ones over scores; where no rule decides, the document
    is a general one of low confidence whose strategy follows its markers. A null text is empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hay = F.lower(F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("\n"), body))
    n_headings = F.col(headings) if headings else F.lit(0)
    kind = F.col(mime) if mime else F.lit("text/plain")
    rows = docs.withColumns({"__hay": hay, "__body": body}).withColumn("__low", F.lower("__body"))
    hay = F.col("__hay")
    count = lambda p, held: F.when(F.contains(hay, F.lit(held)), F.regexp_count(hay, F.lit(p))).otherwise(0)
    rows = rows.withColumns({
        "__meet": hits(hay, MEETING), "__meet2": hits(hay, MEETING_KIND), "__tech": hits(hay, TECHNICAL),
        "__art": count(ARTICLE, "art"), "__chap": count(CHAPTER, "tulo"), "__title": count(TITLE, "tulo"), "__book": count(BOOK, "libro"),
        "__items": F.regexp_count("__body", F.lit(r"(?m)^[0-9]+\)")), "__caps": capital_lines(F.col("__body")), "__marks": hits(F.col("__low"), STRUCTURED_MARKERS),
    })
    words = lambda some: sum((F.contains(hay, F.lit(w)).cast("int") * 2 for w in some[1:]), F.contains(hay, F.lit(some[0])).cast("int") * 2)
    c = F.col
    rows = rows.withColumns({
        "__legal": words(LEGAL_WORDS) + F.least(F.lit(8), c("__art") * 2) + F.least(F.lit(4), c("__chap") * 2) + F.least(F.lit(3), c("__title")) + F.least(F.lit(2), c("__book")),
        "__struct": words(STRUCTURED_WORDS) + F.least(F.lit(4), n_headings) + F.least(F.lit(3), c("__caps")) + F.when((c("__items") >= 4) & (c("__art") == 0), 2).otherwise(0),
        "__free": F.when(kind.startswith("text/") & (n_headings == 0), 2).otherwise(0) + F.when((c("__art") == 0) & (c("__chap") == 0) & (n_headings == 0), 3).otherwise(0),
    })
    top = F.greatest("__legal", "__struct", "__free")
    second = c("__legal") + c("__struct") + c("__free") - top - F.least("__legal", "__struct", "__free")
    rows = rows.withColumns({"__top": top, "__margin": top - second})
    label = F.when(c("__legal") == c("__top"), "legal_normative").when(c("__struct") == c("__top"), "generic_structural").otherwise("generic_freeform")
    decided = (c("__top") >= 3) & ~((c("__margin") < 2) & (c("__top") < 7))
    rule = F.when((c("__meet") >= 2) | ((c("__meet") >= 1) & (c("__meet2") >= 1)), "meeting").when(c("__tech") >= 3, "technical").when(decided, "scores").otherwise("fallback")
    rows = rows.withColumns({"rule": rule, "__label": label})
    strategy = F.when(c("rule") == "meeting", "generic_structural").when(c("rule") == "technical", "technical_structural").when((c("rule") == "scores") & (c("__label") == "legal_normative"), "normative_hierarchical").when(c("rule") == "scores", c("__label")).when((n_headings > 0) | (c("__caps") >= 2) | (c("__marks") >= 2), "generic_structural").otherwise("generic_freeform")
    rows = rows.withColumn("chunking_strategy", strategy)
    klass = F.when(c("chunking_strategy") == "normative_hierarchical", "legal_normative").when(c("chunking_strategy") == "technical_structural", "technical_standard").otherwise("general_document")
    confidence = F.when(c("rule") == "meeting", F.lit(MEETING_CONFIDENCE)).when(c("rule") == "technical", F.least(F.lit(0.97), 0.68 + c("__tech") * 0.04)).when(c("rule") == "scores", F.least(F.lit(0.97), 0.55 + c("__margin") * 0.08 + c("__top") * 0.02)).otherwise(F.lit(FALLBACK_CONFIDENCE))
    rows = rows.withColumns({"document_class": klass, "confidence": F.round(confidence, 2)})
    rows = rows.withColumn("document_family", F.when(c("document_class") == "general_document", "general").otherwise("normative"))
    return rows.select(*docs.columns, "document_class", "document_family", "chunking_strategy", "confidence", "rule")


def gateway(rows: DataFrame, provider: DataFrame | None, key: str, enough: float = 0.93, trusted: float = 0.60) -> DataFrame:
    """Rule results of ``enough`` confidence stand; below, a provider's result of ``trusted`` confidence replaces them.

    ``provider(key, document_class, document_family, chunking_strategy, confidence)``; without one the rules stand.
    """
    if provider is None:
        return rows
    names = ["document_class", "document_family", "chunking_strategy", "confidence"]
    other = provider.select(F.col(key), *[F.col(n).alias(f"__{n}") for n in names])
    joined = rows.join(other, key, "left")
    use = (F.col("confidence") < enough) & (F.coalesce("__confidence", F.lit(0.0)) >= trusted)
    mixed = {f"__new_{n}": F.when(use, F.col(f"__{n}")).otherwise(F.col(n)) for n in names}
    return joined.withColumns(mixed).select(*[F.col(f"__new_{c}").alias(c) if c in names else F.col(c) for c in rows.columns])
