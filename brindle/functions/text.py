"""Column functions over text: folding, tokens, budgets, overlaps, lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the letter below the marks."""
    letters = (chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in letters if c == c.lower()}
    return {c: b for c, b in bases.items() if b != c and b.isascii()}


_ACCENTED, _PLAIN = ("".join(x) for x in zip(*_bases().items(), strict=True))
#: Marks that stand alone after their letter.
MARKS = r"\p{Mn}+"
TOKEN = r"([\p{L}\p{N}_]+)"
#: Words that carry no topic, in the languages of the corpora.
STOPWORDS = tuple("a al and as at be by con cual cuales de del des die das der du el ella en es est et for from fur ist la las le les los mit of on or para pas por que qui se sin sobre su sur the to un una und une von was with y zu".split())
#: Everything that ends a line in Unicode text.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def fold(c: Column | str) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), MARKS, "")


def tokens(c: Column | str) -> Column:
    """Folded runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN))


def content_tokens(c: Column | str, least: int = 2) -> Column:
    """Distinct tokens of at least ``least`` characters that are not stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS)))


def token_estimate(c: Column | str) -> Column:
    """Words and single punctuation marks, times 1.1, rounded up; at least 1."""
    n = F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    return F.greatest(F.lit(1), F.ceil(n * F.lit(1.1))).cast("long")


def approximate_tokens(c: Column | str) -> Column:
    """White-space words times 1.2, rounded up; at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.regexp_count(c, F.lit(r"\S+")) * F.lit(1.2))).cast("long")


def lines(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(c, LINE_END), lambda x: F.trim(x)), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def segments(c: Column) -> Column:
    """Paragraphs if blank lines part the text, else sentences, else the text."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(sentences(c)) > 1, sentences(c)).otherwise(F.array(F.trim(c)))


def overlap(left: Column, right: Column) -> Column:
    """The share of ``left``'s tokens that ``right`` has; 0 if either is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(F.lit(0.0))


def soft_overlap(left: Column, right: Column, least: int = 5) -> Column:
    """Like :func:`overlap`, where a token also matches one that it begins or that begins it, both of ``least`` characters or more."""
    same = lambda a, b: (a == b) | ((F.length(a) >= least) & (F.length(b) >= least) & (a.startswith(b) | b.startswith(a)))
    hits = F.size(F.filter(left, lambda a: F.exists(right, lambda b: same(a, b))))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), hits / F.size(left)).otherwise(F.lit(0.0))


def compress(c: Column, limit: int) -> Column:
    """White space collapsed; longer texts cut at ``limit`` characters, less three for an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)
