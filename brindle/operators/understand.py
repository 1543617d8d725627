"""Questions as rows: references, markers, topics, comparison clauses, route, plan and rewrites, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold

# Reference forms in order of precedence, markers and words that are no topic.
REFERENCES = (
    ("article", r"\b(?:art\.?|arto\.?|articulo)\s*([0-9]+(?:\.[0-9]+)?)\b", "Arto."),
    ("section", r"\bseccion\s*([0-9]+(?:\.[0-9]+)?)\b", "Seccion"),
    ("recommendation", r"\brecomendacion\s*([0-9]+(?:\.[0-9]+)?)\b", "Recomendacion"),
    ("recommendation", r"\br\.?\s*([0-9]+(?:\.[0-9]+)?)\b", "Recomendacion"),
    ("annex", r"\banexo\s+([ivxlcdm]+|[0-9]+)\b", "Anexo"),
    ("chapter", r"\bcapitulo\s+([ivxlcdm]+|[0-9]+)\b", "Capitulo"),
    ("title", r"\btitulo\s+([ivxlcdm]+|[0-9]+)\b", "Titulo"),
    ("book", r"\blibro\s+([ivxlcdm]+|[0-9]+)\b", "Libro"),
    ("paragraph", r"\bparr?afo\s*([0-9]+(?:\.[0-9]+)?)\b", "Parrafo"),
    ("law", r"\bley\s*([0-9]+)\b", "Ley"),
)
NO_TOPIC = tuple("art arto articulo seccion recomendacion anexo capitulo titulo libro parrafo ley codigo niif nic gafi metodologia".split())
QUESTION_WORDS = tuple("a al ante como con cual cuales cuando de del donde el ella ellas ellos en entre es esa ese esta este estas estos la las lo los mas menos para pero por que respecto segun si sin sobre solo su sus un una uno unas unos y".split())
CLASSES = ("legal_normative", "technical_standard", "general_document")
STYLES = {"focal": "single_branch", "multi_branch": "grouped_by_branch", "global": "summary"}


def normal(c: Column) -> Column:
    """Folded, with single spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"\s+", " "))


def references(question: Column) -> Column:
    """``array<struct<kind, value, label>>`` in order of form and place, each once; ``question`` is normalised."""

    def found(kind: str, pattern: str, label: str) -> Column:
        values = F.regexp_extract_all(question, F.lit(pattern), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.upper(v).alias("value"), F.concat(F.lit(label + " "), F.upper(v)).alias("label")))

    return F.array_distinct(F.concat(*[found(*r) for r in REFERENCES]))


def markers(question: Column, refs: Column, most: int = 4) -> Column:
    has = lambda *words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(question, w))
    known = F.array_compact(F.array(
        F.when(has("niif", "pymes"), F.lit("niif para las pymes")).when(has("niif"), F.lit("niif")),
        F.when(has("gafi"), F.lit("gafi")), F.when(has("metodologia"), F.lit("metodologia")), F.when(has("codigo", "trabajo"), F.lit("codigo del trabajo")),
        F.when(has("nic 39"), F.lit("nic 39")), F.when(has("apnfd"), F.lit("apnfd")),
    ))
    laws = F.transform(F.filter(refs, lambda r: r["kind"] == "law"), lambda r: F.lower(r["label"]))
    return F.slice(F.array_distinct(F.concat(known, laws)), 1, most)


def topics(question: Column, refs: Column, marks: Column, most: int = 8) -> Column:
    words = F.regexp_extract_all(question, F.lit(r"([\p{L}\p{N}_]+)"))
    taken = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.transform(refs, lambda r: r["label"]), marks)), F.lit(r"([\p{L}\p{N}_]+)"))
    keep = F.filter(words, lambda w: ~w.isin(*QUESTION_WORDS, *NO_TOPIC) & ~w.rlike("^[0-9]+$") & (F.length(w) >= 3))
    return F.slice(F.array_except(keep, taken), 1, most)


def is_comparison(question: Column) -> Column:
    return F.contains(question, F.lit(" y cual ")) | question.startswith("que documento") | question.startswith("que norma") | F.contains(question, F.lit(" diferencia "))


def clauses(question: Column, targets: Column) -> Column:
    """The two sides of a comparison between technical standards; empty otherwise."""
    strip = lambda c: F.regexp_replace(c, r"^[ ?]+|[ ?]+$", "")
    which, between = r"^(que\s+(?:documento|norma|parte))\s+(.+?)\s+y\s+cual\s+(.+)$", r"^que\s+diferencia\s+hay\s+entre\s+(.+?)\s+y\s+(.+)$"
    part = lambda p, i: F.regexp_extract(question, p, i)
    sides = F.when(question.rlike(which), F.array(*[F.concat_ws(" ", part(which, 1), strip(part(which, i))) for i in (2, 3)])).when(question.rlike(between), F.array(strip(part(between, 1)), strip(part(between, 2))))
    return F.when(is_comparison(question) & F.array_contains(targets, "technical_standard"), F.coalesce(sides, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def search_queries(refs: Column, marks: Column, terms: Column, most: int = 8) -> Column:
    """Combinations of markers, reference labels and topics, the most specific first."""
    m, t = F.array_join(F.slice(marks, 1, 2), " "), F.array_join(F.slice(terms, 1, 5), " ")
    both = (m != "") & (t != "")
    of_label = lambda r: F.array(F.when(both, F.concat_ws(" ", m, r["label"], t)), F.when(m != "", F.concat_ws(" ", m, r["label"])), F.when(t != "", F.concat_ws(" ", r["label"], t)), r["label"])
    named = F.transform(F.filter(F.slice(refs, 1, 2), lambda r: r["kind"].isin("article", "section", "recommendation", "annex", "paragraph")), lambda r: F.when(m != "", F.concat_ws(" ", r["kind"], r["value"], m)))
    every = F.concat(F.array(F.when(both, F.concat_ws(" ", m, t))), F.flatten(F.transform(refs, of_label)), named)
    return F.slice(F.array_distinct(F.array_compact(every)), 1, most)


def route(document_class: Column, document_family: Column, predicted: Column, confidence: Column, least: float = 0.45) -> tuple[Column, Column]:
    """``(query_type, target_classes)``: an explicit class, else an explicit family, else a confident prediction, else all classes."""
    some = lambda *names: F.array(*[F.lit(n) for n in names])
    sure = predicted.isin(*CLASSES) & (confidence >= least)
    kind = F.when(document_class.isin(*CLASSES), document_class).when(document_family == "general", F.lit("general_document")).when(document_family == "normative", F.lit("normative")).when(sure, predicted).otherwise("all_domains")
    targets = F.when(kind == "normative", some(*CLASSES[:2])).when(kind == "all_domains", some(*CLASSES)).otherwise(F.array(kind))
    return kind, targets


def plan(strategy: Column, confidence: Column, least: float = 0.55) -> tuple[Column, Column, Column]:
    """``(strategy, style, confidence)``: an unsure strategy falls back to focal at 0.34."""
    sure = strategy.isin(*STYLES) & (confidence >= least)
    use = F.when(sure, strategy).otherwise("focal")
    style = F.when(use == "global", STYLES["global"]).when(use == "multi_branch", STYLES["multi_branch"]).otherwise(STYLES["focal"])
    return use, style, F.when(sure, confidence).otherwise(F.lit(0.34))


def intent(predicted: Column, confidence: Column, least: float = 0.55) -> Column:
    return F.when(confidence >= least, predicted).otherwise("mixed")


def structure(questions: DataFrame, text: str, targets: Column | None = None) -> DataFrame:
    """``questions`` with ``normalised, refs, document_markers, topic_terms, clauses, queries``; without ``targets`` all classes are searched."""
    rows = questions.withColumn("normalised", normal(F.col(text)))
    rows = rows.withColumn("refs", references(F.col("normalised")))
    rows = rows.withColumn("document_markers", markers(F.col("normalised"), F.col("refs")))
    rows = rows.withColumn("topic_terms", topics(F.col("normalised"), F.col("refs"), F.col("document_markers")))
    rows = rows.withColumn("clauses", clauses(F.col("normalised"), targets if targets is not None else F.array(*[F.lit(c) for c in CLASSES])))
    return rows.withColumn("queries", search_queries(F.col("refs"), F.col("document_markers"), F.col("topic_terms")))


def variants(structured: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, variant, query)``: the question itself as variant 0, then its search queries and clauses, each folded text once."""
    every = structured.select(key, F.posexplode(F.concat(F.array(F.coalesce(F.col(text), F.lit(""))), "queries", "clauses")).alias("p", "query"))
    order = Window.partitionBy(key, normal(F.col("query"))).orderBy("p")
    once = every.withColumn("r", F.row_number().over(order)).where("r = 1")
    return once.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1).alias("variant"), "query")
