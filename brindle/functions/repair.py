"""Repairs of legal texts after character recognition: one chain of Column expressions, nothing leaves the task."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.operators.outline import NUMBER, ORDINALS

# Forms of headings, the words of a gazette's front page, and words that recognition runs together.
LEVEL = r"libro|t[ií]tulo|cap[ií]tulo"
ARTICLE = r"art(?:[ií]culo|o)?\.?"
LAW = r"ley\s+N(?:\.|°|º|O)?\s*\.?\s*\d+"
GAZETTE = "SUMARIO|LA ?GACETA|DIARIO OFICIAL|CASA DE GOBIERNO"
PROMULGATED = (r"HA\s*DICTADO", r"La\s+siguiente:")
JOINED = (
    (r"(?i)\bdelaley\b", "de la ley"),
    (r"\bObjetodelaley\b", "Objeto de la ley"),
    (r"(?i)\bInstituciony\b", "Institucion y"),
    (r"\bInstitutoocon\b", "Instituto o con"),
    (r"\bSocialy\b", "Social y"),
    (r"(?i)\blapresente\b", "la presente"),
    (r"Conformealodispuestoen", "Conforme a lo dispuesto en"),
    (r"Consejo Directivoseran", "Consejo Directivo seran"),
)
#: What every heading that is spaced holds, in lower case and without the letter i, whose cases are many; and what every joined word holds.
HEADS, RUN_TOGETHER = ("bro", "tulo", "art", "ley"), ("delaley", "instituciony", "institutoocon", "socialy", "lapresente", "conformealodispuestoen", "directivoseran")
#: A law's body is sought behind the formula of its promulgation within this many characters, and behind a front page beyond so many.
PROMULGATED_WITHIN, FRONT_PAGE = 1_500, 300

_CAPITAL = "A-ZÁÉÍÓÚÑ"
_OPENING = rf"(?:{LAW}|libro\s+(?:{NUMBER}|{ORDINALS})|t[ií]tulo\s+(?:{NUMBER}|PRELIMINAR|{ORDINALS})|cap[ií]tulo\s+{NUMBER}|{ARTICLE}\s*1\b)"


def _each(c: Column, *changes: tuple[str, str]) -> Column:
    for pattern, by in changes:
        c = F.regexp_replace(c, pattern, by)
    return c


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _holds(c: Column, *literals: str) -> Column:
    """Whether one of some lower-case literals is in a text: a test that a pattern can match, much cheaper than the pattern."""
    return _let(F.lower(c), lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in literals)))


def body(text: Column) -> Column:
    """From the promulgated law on, if the formula stands early; else from the first heading, if laws are many or a gazette's front page precedes it."""

    def behind(t: Column) -> Column:
        rest = lambda prefix: F.substring(t, F.length(prefix) + 1, F.length(t))
        laws = F.regexp_count(t, F.lit(rf"(?imu)^\s*{LAW}"))
        paged = lambda front: (F.length(front) > FRONT_PAGE) & F.upper(front).rlike(GAZETTE)
        out = _let(F.regexp_extract(t, rf"(?imsu)\A(.*?)^\s*{_OPENING}", 1), lambda front: F.when(paged(front) | (laws >= 2), rest(front)).otherwise(t))
        early = lambda before: (before != "") & (F.length(before) <= PROMULGATED_WITHIN)
        for formula in reversed(PROMULGATED):
            before = F.regexp_extract(t, rf"(?isu)\A(.*?{formula}.*?){LAW}", 1)
            out = _let(before, partial(lambda other, b: F.when(early(b), rest(b)).otherwise(other), out))
        return out

    return _let(text, behind)


def repair(text: Column, markdown: Column | None = None) -> Column:
    """Headings spaced and on lines of their own, the body alone, joined words parted, blank lines one at a time.

    Markdown marks and image comments go where ``markdown`` is true. Null stays null and a blank text as it is.
    """
    bare = _each(F.replace(text, F.lit("<!-- image -->"), F.lit("\n")), (r"(?m)^\s*#+\s*", ""))
    c = text if markdown is None else F.when(markdown, bare).otherwise(text)
    c = _let(c, lambda t: F.when(_holds(t, *HEADS), _each(
        t,
        (rf"(?iu)\b({LEVEL})\s*({NUMBER})\b", "$1 $2"),
        (rf"(?iu)\b({ARTICLE})\s*([0-9]+)\s*([{_CAPITAL}])", "$1 $2 $3"),
        (rf"(?iu)\b({ARTICLE})\s*([0-9]+)\b", "$1 $2"),
        (r"(?iu)\b(ley)\s*N[°ºO.]?\s*\.?\s*([0-9]+)\b", "$1 N. $2"),
        (rf"(?iu)(?<!\n)(?=ley\s+N[°ºO.]|(?:{LEVEL})\s+{NUMBER}|{ARTICLE}\s*\d+(?:\s+(?:bis|ter|quater|quinquies))?\s*(?:[.:\-]|\s[{_CAPITAL}(]))", "\n"),
    )).otherwise(t))
    c = _each(body(c), (rf"(?<=[a-záéíóúñ0-9])(?=[{_CAPITAL}])", " "))
    c = _let(c, lambda t: F.when(_holds(t, *RUN_TOGETHER), _each(t, *JOINED)).otherwise(t))
    c = _each(c, (r"[ \t]{2,}", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))
    return F.when(F.trim(text, F.lit(" \t\r\n")) == "", text).otherwise(F.trim(c, F.lit(" \t\r\n")))
