"""One instrument out of a gazette that holds several: where it begins, where the next one may begin, and where to cut.

Only texts that qualify are taken apart. Their lines are dealt by document for offsets, then only marks (headings and
articles) are kept; a text is joined to its few candidates once more for what stands around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold

# The words that begin an instrument, that go on with one, and that stand in its preface; folded text.
INSTRUMENTS = (r"ley\s*n", r"decreto\s*n", r"acuerdo\s+presidencial", r"resolucion", r"reglamento\b", r"codigo\b")
CONTINUATIONS = (r"titulo\b", r"capitulo\b", r"seccion\b", r"articulo\b", r"art\.", r"anexo\b")
PREFACES = (r"\bel presidente de la republica\b", r"\bla asamblea nacional\b", r"\bconsiderando\b", r"\bpor tanto\b", r"\bha dictado\b", r"\bacuerda\b", r"\ben uso de sus facultades\b")
NAMES = (("LEY", r"\bley\b.*?\b(\d{2,5})\b"), ("DECRETO", r"\bdecreto\b.*?\b(\d{1,4}(?:-\d{2,4})?)\b"), ("RESOLUCION", r"\bresolucion\b.*?\b(\d{1,5}(?:-\d{2,4})?)\b"))
SUMMARY = r"(?im)^\s*#{0,6}\s*SUMARIO\b"
HEADING = r"^#{1,6}\s+(\S.*?)\s*$"
ARTICLE = r"(?iu)^\s*#{0,6}\s*(?:art[íi]culo|art\.)\s*\.?\s*(\d{1,9})\b"
LEAST_TEXT, LEAST_TAIL, LEAST_RESULT, FIRST_AT, NEAR = 1_500, 2_000, 200, 1_500, 250
SURE, TRUSTED = 6.0, 0.7

_BLANK = " \t\r\n\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANK))


def _begins(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(r"^\s*(?:" + "|".join(words) + ")")


def target(name: Column) -> Column:
    """``struct(kind, number)`` of the instrument that a file name asks for, else null: a law before a decree before a resolution."""
    stem = fold(F.regexp_replace(name, r"\.[^./]*$", ""))
    found = None
    for kind, pattern in NAMES:
        number = F.regexp_extract(stem, pattern, 1)
        hit = number != ""
        row = F.struct(F.lit(kind).alias("kind"), number.alias("number"))
        found = F.when(hit, row) if found is None else found.when(hit, row)
    return found


def tail(text: Column, wanted: Column) -> Column:
    """The text from the heading of the wanted instrument on; empty if it has none."""
    word = F.when(wanted["kind"] == "RESOLUCION", "RESOLUCI[ÓO]N").otherwise(wanted["kind"])
    pattern = F.concat(F.lit(r"(?isu)(?:\A|\n)\s*#{0,6}\s*"), word, F.lit(r"\s*N\s*[Oº°0]?\s*[.\-:]?\s*"), wanted["number"], F.lit(r"\b.*"))
    return F.coalesce(_strip(F.regexp_substr(text, pattern)), F.lit(""))


def applicable(text: Column) -> Column:
    """Long enough, with a summary, and with four headings or more."""
    return (F.length(text) >= LEAST_TEXT) & text.rlike(SUMMARY) & (F.regexp_count(text, F.lit("(?m)" + HEADING)) >= 4)


def salient(heading: Column) -> Column:
    """Eight to 120 characters, at least seven in ten letters of them capitals."""
    letters = F.regexp_count(heading, F.lit(r"\p{L}"))
    return F.length(heading).between(8, 120) & (letters > 0) & (F.regexp_count(heading, F.lit(r"\p{Lu}")) >= letters * 0.7)


def _marks(tails: DataFrame, key: str) -> DataFrame:
    """``(key, start, heading, article)`` with what windows over a text's marks tell of each."""
    lines = tails.select(key, F.posexplode(F.split("__tail", "\n")).alias("__i", "__line"))
    before = Window.partitionBy(key).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("__line") + 1).over(before), F.lit(0)))
    text = lambda p: F.regexp_extract("__line", p, 1)
    marks = placed.select(key, "start", F.when(text(HEADING) != "", text(HEADING)).alias("heading"), F.when(text(ARTICLE) != "", text(ARTICLE).cast("long")).alias("article")).where("heading IS NOT NULL OR article IS NOT NULL")
    order = Window.partitionBy(key).orderBy("start")
    near, after = order.rangeBetween(-NEAR, -1), order.rangeBetween(1, NEAR)
    goes_on = _begins(fold("heading"), CONTINUATIONS)
    marks = marks.withColumns({"opens": F.col("heading").isNotNull() & ~goes_on, "salient": salient(F.col("heading")) & ~goes_on, "instrument": _begins(fold("heading"), INSTRUMENTS) & ~goes_on})
    hard = F.col("instrument") & (F.col("start") >= FIRST_AT)
    return marks.withColumns({
        "last_article": F.coalesce(F.max("article").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "next_article": F.first("article", True).over(order.rangeBetween(0, 1599)),
        "gap": F.min(F.when(F.col("heading").isNotNull(), F.col("start"))).over(order.rangeBetween(1, Window.unboundedFollowing)) - F.col("start"),
        "cut": F.coalesce(F.min(F.when(F.col("salient"), F.col("start"))).over(near), F.col("start")),
        "leads_in": F.col("salient") & F.coalesce(F.max(F.when(hard, 1)).over(after) == 1, F.lit(False)),
    })


def boundaries(tails: DataFrame, key: str) -> DataFrame:
    """``(key, start, heading, hard, score, reasons, cut)``: headings at which the next instrument may begin.

    Eight signals add up; headings of three points or more stay, and salient headings right before an instrument's.
    """
    marks = _marks(tails.where(F.length("__tail") >= LEAST_TAIL), key).where("opens AND (start >= 1500 OR leads_in)")
    around = marks.join(tails.select(key, "__tail"), key)
    before = _strip(F.expr("substr(__tail, greatest(1, start - 499), least(500, start))"))
    after = _strip(F.expr("substr(__tail, start + 1, 1200)"))
    pipes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|")))
    rows = around.withColumns({"wall": (pipes(before) >= 10) | (pipes(after) >= 10), "preface": sum((fold(after).rlike(p).cast("int") for p in PREFACES), F.lit(0))}).drop("__tail")
    last, following = F.col("last_article"), F.col("next_article")
    restart = (last >= 10) & (following <= 5)
    signals = (
        ("instrument_heading", F.col("instrument"), 4.0),
        ("high_salience_heading", F.col("salient"), 1.5),
        ("legal_preface_after", F.col("preface") >= 2, 3.5),
        ("single_preface_marker_after", F.col("preface") == 1, 1.0),
        ("article_number_restart", restart, 4.0),
        ("article_discontinuity", ~F.coalesce(restart, F.lit(False)) & (last >= 25) & (following < last / 2), 1.5),
        ("structural_transition", F.col("wall"), 1.0),
        ("heading_cluster_after", F.col("gap") <= 220, 1.5),
        ("heading_after_table_wall", F.col("salient") & F.col("wall"), 1.5),
    )
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test, _ in signals]))
    score = sum((F.when(test, points).otherwise(0.0) for _, test, points in signals), F.lit(0.0))
    scored = rows.select(key, "start", "heading", F.col("instrument").alias("hard"), score.alias("score"), reasons.alias("reasons"), "cut", "leads_in")
    own = scored.where((F.col("score") >= 3.0) & (F.col("start") >= FIRST_AT)).drop("leads_in")
    lead = scored.where("leads_in").select(key, "start", "heading", F.lit(False).alias("hard"), F.lit(5.0).alias("score"), F.array(F.lit("preboundary_heading_cluster"), F.lit("high_salience_heading")).alias("reasons"), "cut")
    return own.unionByName(lead)


def shortlist(found: Column, first: int = 12, best: int = 6) -> Column:
    """Of an array of boundaries: one within 250 characters of another goes, the better one stays; then the first, the best and those before an instrument."""
    ordered = F.array_sort(found)

    def join(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        near = x["start"] - last["start"] < NEAR
        return F.when(F.size(kept) == 0, F.array(x)).when(~near, F.concat(kept, F.array(x))).when(x["score"] > last["score"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    def cap(kept: Column) -> Column:
        order = F.transform(kept, lambda x: F.struct((-x["score"]).alias("worst"), x["start"].alias("start")))
        places = F.transform(F.slice(F.array_sort(order), 1, best), lambda x: x["start"])
        limit = F.when(F.size(kept) > first, F.get(kept, F.lit(first - 1))["start"])
        return F.filter(kept, lambda x: limit.isNull() | (x["start"] <= limit) | F.array_contains(places, x["start"]) | F.array_contains(x["reasons"], "preboundary_heading_cluster"))

    return cap(F.aggregate(ordered, F.slice(ordered, 1, 0), join))


def choice(short: Column, provided: Column | None = None) -> Column:
    """The boundary to cut at, null for none: a trusted provider's, else the first of six points or more; a continuity break right before it is preferred."""
    first = F.get(F.filter(short, lambda x: x["score"] >= SURE), F.lit(0))
    if provided is not None:
        first = F.coalesce(F.get(F.filter(short, lambda x: x["start"] == provided), F.lit(0)), first)
    earlier = F.filter(short, lambda x: (x["start"] < first["start"]) & (first["start"] - x["start"] <= NEAR) & ~x["hard"] & (x["score"] >= 4.0))
    return F.when(first["hard"] & (F.size(earlier) > 0), F.element_at(earlier, -1)).otherwise(first)


def isolate(docs: DataFrame, key: str, name: str, text: str, provider: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text`` cut to the instrument that ``name`` asks for, and ``isolated`` true where it was.

    Texts without a target, a summary or the target's heading stay as they are, null ones too; so do those of which fewer
    than 200 characters would be left. ``key`` is unique. ``provider(key, start, confidence)`` may choose a boundary by
    its offset from the target's heading.
    """
    wanted = docs.withColumn("__want", target(F.col(name))).where(F.col("__want").isNotNull() & applicable(F.col(text)))
    tails = wanted.select(key, tail(F.col(text), F.col("__want")).alias("__tail")).where("__tail <> ''")
    boundary = F.struct("start", "heading", "hard", "score", "reasons", "cut")
    short = boundaries(tails, key).groupBy(key).agg(shortlist(F.collect_list(boundary)).alias("__short"))  # a text's own headings
    rows = tails.join(short, key, "left")
    if provider is not None:
        rows = rows.join(provider.where(F.col("confidence") >= TRUSTED).select(key, F.col("start").alias("__given")), key, "left")
    chosen = choice(F.col("__short"), F.col("__given") if provider is not None else None)
    at = F.when(chosen["hard"], chosen["cut"]).otherwise(chosen["start"])
    cut = rows.withColumn("__at", at).withColumn("__cut", _strip(F.expr("substr(__tail, 1, __at)")))
    done = cut.select(key, F.when(F.length("__cut") >= LEAST_RESULT, F.col("__cut")).when(F.length("__tail") >= LEAST_RESULT, F.col("__tail")).alias("__new"))
    joined = docs.join(done, key, "left")
    return joined.withColumns({text: F.coalesce("__new", text), "isolated": F.col("__new").isNotNull() & (F.col("__new") != F.col(text))}).select(*docs.columns, "isolated")
