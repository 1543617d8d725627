"""Information-theoretic sanitisation of personal data.

Direct identifiers (email, ip, card, phone) are found by rule. Corpus co-occurrence then says which words give
such an entity away: a word near an entity discloses it by PMI(entity; word) / IC(entity), which is 1 if the word
never stands in a document without the entity and 0 if the two are independent. Words whose disclosure reaches a
threshold, with enough different contexts behind it, are spans too: generalised, or removed when they disclose
nearly everything. Counts cover all documents; exact copies of a context support a word only once. An entity that
few contexts mention is estimated by its pools: its group (mail domain, network, card issuer, phone area) and its
kind. Every word must also be unlikely to stand there by chance, however many words are tested.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_value, cut, in_batches, record_batch

by_value(__name__)

KINDS = ("email", "ip", "card", "phone", "term")
#: Words to each side of an entity that are its context, and the different contexts of it that must agree on a word.
REACH, SUPPORT = 8, 2
#: Disclosure from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.98
#: Words up to which a list is broadcast (some 20 MB); beyond it the words are joined.
MOST_TERMS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits only matches from its start, so nothing is lost by looking there alone.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")
_LONG = re.compile(r"[^\W\d_]{3,}")
#: Likelihood ratio (G squared) that a word must exceed: chance in one of a thousand; twice the log of the number of tested pairs is added.
LEAST_G2 = 10.83


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start, in code points: leftmost matches that do not overlap within a kind; failing matches go, without a second try."""
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:  # the longest run of address characters that ends at an @ and starts after the last address
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def spans_string(spans: list[tuple]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in sorted(spans)])


def _outside(words, spans: list[tuple]) -> list:
    """The word matches that touch no span; both in order of start."""
    spans, out, i = sorted((a, b) for _, a, b in spans), [], 0
    for m in words:
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        if i == len(spans) or m.end() <= spans[i][0]:
            out.append(m)
    return out


def pools(kind: int, entity: str) -> tuple[str, str]:
    """The group and the kind that an entity's contexts also count for."""
    if kind == 0:
        group = entity[entity.index("@") :].lower()
    elif kind == 1:
        group = entity[: entity.rindex(".")]
    else:
        group = "".join(c for c in entity if c.isdigit())[:6]
    return f"pool:{KINDS[kind]}:{group}", f"pool:{KINDS[kind]}"


def contexts(text: str, reach: int = REACH) -> list[tuple[str, str, int]]:
    """``(entity, word, context)`` of a text, each entity, pool and word once; with the empty word for the entity or pool itself.

    Near an entity are, to each side, ``reach`` words of three letters or more, and ``reach`` words of any kind.
    """
    spans = base_spans(text)
    if not spans:
        return []
    from bisect import bisect

    words = _outside(_WORD.finditer(text), spans)
    longs = _outside(_LONG.finditer(text), spans)
    starts, long_starts = [m.start() for m in words], [m.start() for m in longs]

    out: dict[tuple[str, str], int] = {}
    for k, a, b in spans:
        i, j = bisect(starts, a), bisect(long_starts, a)
        any_near = [m[0].lower() for m in words[max(0, i - reach) : i + reach]]
        long_near = [m[0].lower() for m in longs[max(0, j - reach) : j + reach]]
        context = xxhash.xxh3_64_intdigest(" ".join(long_near or any_near)) >> 1
        for entity in (f"{KINDS[k]}:{text[a:b]}", *pools(k, text[a:b])):
            for word in ("", *any_near, *long_near):
                out.setdefault((entity, word), context)
    return [(e, w, c) for (e, w), c in out.items()]


def words_of(text: str) -> set[str]:
    """The words of a text: runs of letters and digits, and the runs of three letters or more within them."""
    return {w.lower() for w in _WORD.findall(text)} | {w.lower() for w in _LONG.findall(text)}


def _counts(docs: DataFrame, wanted) -> DataFrame:
    """``(word, n)``: the documents that hold each word, of those in ``wanted`` (a broadcast set) or of all words."""
    schema = pa.schema([("word", pa.string()), ("m", pa.int64())])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = words_of(text or "")
                seen.update(words if wanted is None else words & wanted.value)
            if len(seen) > 500_000:
                yield record_batch(list(zip(*seen.items(), strict=True)), schema)
                seen.clear()
        if seen:
            yield record_batch(list(zip(*seen.items(), strict=True)), schema)

    return in_batches(docs.select(F.col("text").cast("string")), run, "word string, m long").groupBy("word").agg(F.sum("m").alias("n"))


def disclosing_words(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, least: float = GENERALISE, most_terms: int = MOST_TERMS) -> DataFrame:
    """``(word, disclosure)``: words near protected entities, with the most that each discloses of one, from ``least``."""
    schema = pa.schema([("entity", pa.string()), ("word", pa.string()), ("context", pa.int64())])

    def run(batches):
        for b in batches:
            rows = [r for text in b.column(0).to_pylist() for r in contexts(text or "", reach)]
            if rows:
                yield record_batch(list(zip(*rows, strict=True)), schema)

    pairs = cut(in_batches(docs.select(F.col("text").cast("string")), run, "entity string, word string, context long"))
    joint = cut(pairs.where("word <> ''").groupBy("entity", "word", "context").agg(F.count("*").alias("m")).groupBy("entity", "word").agg(F.sum("m").alias("both"), F.count("*").alias("contexts")).where(F.col("contexts") >= support))
    entities = pairs.where("word = ''").groupBy("entity").agg(F.count("*").alias("of_entity"))
    terms = joint.select("word").distinct()
    n, tested = terms.count(), joint.count()
    if not n:
        return joint.select("word", F.lit(0.0).alias("disclosure"))
    wanted = docs.sparkSession.sparkContext.broadcast({r.word for r in terms.collect()}) if n <= most_terms else None
    total = docs.count()
    pmi = F.log(F.col("both") * F.lit(float(total)) / (F.col("of_entity") * F.col("n")))
    told = joint.join(entities, "entity").join(_counts(docs, wanted), "word").withColumn("ic", F.log(F.lit(float(total)) / F.col("of_entity"))).where("ic > 0").withColumn("disclosure", pmi / F.col("ic"))
    apart, share = F.col("n") - F.col("both"), F.col("of_entity") / F.lit(float(total))
    g2 = 2 * (F.col("both") * pmi + F.when(apart > 0, apart * F.log(apart / (F.col("n") * (1 - share)))).otherwise(0.0))
    told = told.where(g2 > LEAST_G2 + 2 * math.log(tested))
    return told.groupBy("word").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= least)


def told_words(text: str, spans: list[tuple], known: dict[str, float]) -> list[tuple]:
    """The spans of known words: whole ones, and the runs of letters in other words."""
    found = [(4, m.start(), m.end(), known[m[0].lower()]) for m in _outside(_WORD.finditer(text), spans) if m[0].lower() in known]
    taken = [(4, a, b) for _, a, b, _ in found]
    return sorted(found + [(4, m.start(), m.end(), known[m[0].lower()]) for m in _outside(_LONG.finditer(text), [*spans, *taken]) if m[0].lower() in known])


def sanitise(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, least: float = GENERALISE, remove: float = REMOVE, most_terms: int = MOST_TERMS, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, sanitised])`` for each row.

    Spans are written ``kind:start:end``, in code points, by kind and start. In ``sanitised`` an identifier becomes its kind in angle
    brackets, a generalised word ``<term>``, and a removed word nothing. A null text is empty; repeated rows
    are returned as often as given, and count as documents that hold the same context; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = cut(disclosing_words(rows, reach, support, least, most_terms))
    n = told.count()
    fields = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string())] + [("sanitised", pa.string())] * with_text
    schema = pa.schema(fields)
    if n <= most_terms:
        shared = rows.sparkSession.sparkContext.broadcast({r.word: r.disclosure for r in told.collect()})
        joined = rows.withColumn("own", F.lit(None).cast("map<string,double>"))
    else:
        shared = None
        pair = pa.schema([("__key", pa.int64()), ("__id", pa.int64()), ("word", pa.string())])

        def spread(batches):
            for b in batches:
                out = [(k, d, w) for k, d, text in zip(*[c.to_pylist() for c in b.columns], strict=True) for w in words_of(text or "")]
                if out:
                    yield record_batch(list(zip(*out, strict=True)), pair)

        held = in_batches(rows.select(F.xxhash64("text"), "doc_id", "text"), spread, "__key long, __id long, word string").distinct().join(told, "word")
        own = held.groupBy("__key", "__id").agg(F.map_from_entries(F.collect_list(F.struct("word", "disclosure"))).alias("own"))
        joined = rows.join(own, (F.xxhash64("text") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "own")

    def run(batches):
        for b in batches:
            out = []
            for doc, text, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                text, known = text or "", shared.value if shared else dict(own or ())
                spans = base_spans(text)
                amounts = Counter(k for k, _, _ in spans)
                words = told_words(text, spans, known) if known else []
                row = [doc, *[amounts[k] for k in range(4)], hashlib.sha256(spans_string(spans).encode()).hexdigest(), spans_string([*spans, *words])]
                if with_text:
                    parts, at = [], 0
                    for k, a, e, *d in sorted([*spans, *words], key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            parts += [text[at:a], "" if d and d[0] >= remove else f"<{KINDS[k]}>"]
                            at = e
                        elif e > at:  # overlapping kinds: hide both
                            at = e
                    row.append("".join([*parts, text[at:]]))
                out.append(row)
            yield record_batch(list(zip(*out, strict=True)) if out else [[] for _ in fields], schema)

    return in_batches(joined, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", sanitised string" * with_text)
