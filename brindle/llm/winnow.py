"""Document fingerprints by winnowing.

Hashes of the k-grams of a text's characters (case folded, white space left out) are taken, and of every window
of consecutive hashes the minimum is selected, the rightmost of equal ones. The hashes are built from those of
runs of 1, 2, 4, ... characters, for all places of a text at once, where a rolling hash would go from place to place;
equal k-grams have equal hashes either way. Any passage of ``k + window - 1`` such characters that two texts share, 47 by
default, gives both the same selected hash. Positions, in code points of the original text, are kept. A text of
fewer than ``k`` characters has one hash, of all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import by_value, in_batches, record_batch

by_value(__name__)

GRAM, WINDOW = 16, 32
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive code points, from hashes of runs of powers of two."""
    with np.errstate(over="ignore"):
        power, out, at, length = _mix(c.astype(np.uint64) + np.uint64(1)), None, 0, 1
        while True:
            if k & length:
                if out is None:
                    out = power
                else:
                    m = len(power) - at
                    out = _mix(out[:m] * _B + power[at : at + m])
                at += length
            length *= 2
            if length > k:
                return out
            half = length // 2
            power = power[:-half] * _B ** np.uint64(half + 1) + power[half:]
            power ^= power >> np.uint64(31)


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 32-bit hashes and their positions, in order of position."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = raw | np.where((raw >= 65) & (raw <= 90), np.uint32(32), np.uint32(0))
    where = np.nonzero((raw > 32) & (raw != 133) & (raw != 160) & (raw != 0x2028) & (raw != 0x2029) & (raw != 0x3000))[0]
    if not len(where):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = low[where]
    h = gram_hashes(c, min(k, len(c))) >> np.uint64(32)
    out = []
    step = 1 << 22
    for at in range(0, max(1, len(h) - window + 1), step):  # pieces of bounded size; a piece's windows start in it
        part = h[at : at + step + window - 1]
        keyed = part << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(part), dtype=np.uint64))  # of equal hashes the rightmost is least
        n, length = min(window, len(part)), 1
        while length * 2 <= n:
            keyed = np.minimum(keyed[:-length], keyed[length:])
            length *= 2
        if n > length:
            keyed = np.minimum(keyed[: len(keyed) - (n - length)], keyed[n - length :])
        keep = np.ones(len(keyed), bool)
        keep[1:] = keyed[1:] != keyed[:-1]
        out.append(at + (np.uint64(0xFFFFFFFF) - (keyed[keep] & np.uint64(0xFFFFFFFF))).astype(np.int64))
    chosen = np.unique(np.concatenate(out))
    return h[chosen].astype(np.uint32), where[chosen]


def as_string(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:position`` pairs, eight hexadecimal digits and a decimal number, comma-joined."""
    return ",".join([f"{h:08x}:{p}" for h, p in zip(print_[0].tolist(), print_[1].tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - shared
    return shared / whole if whole else 1.0


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row; a null text counts as empty and has an empty fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            yield record_batch([b.column(0), [as_string(winnow(x or "", k, window)) for x in b.column(1).to_pylist()]], schema)

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``(part, guest, id, text)``: each row in a range of ids, and beside it, as a guest, the row after the range's last.

    The order is by descending doc_id (a missing one last), then by text hash and text; after the last row comes the first.
    Bounds are approximate quantiles of the ids, so that ranges hold about as many rows each; ids alone are
    read for them, and texts are shuffled once.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("text").cast("string").alias("text"))
    only = ids.select("id")
    cuts = only.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def ranges(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, values, side="right")


    @F.pandas_udf(T.IntegerType())
    def part_of(ids):
        import pandas as pd

        return pd.Series(ranges(ids.to_numpy(np.int64)).astype(np.int32))

    tops = sorted((r["p"], r["id"]) for r in only.select(part_of("id").alias("p"), "id").groupBy("p").agg(F.max("id").alias("id")).collect())  # a row for each range
    heads = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(ids):
        import pandas as pd

        values = ids.to_numpy(np.int64)
        return pd.Series([[2 * p] if v not in heads else [2 * p, 2 * heads[v] + 1] for p, v in zip(ranges(values).tolist(), values.tolist(), strict=True)])

    placed = ids.select(F.explode(places("id")).alias("place"), "id", "text")
    return placed.select(F.expr("place div 2").cast("int").alias("part"), F.expr("place % 2").cast("int").alias("guest"), "id", "text")


def compare_edited(docs: DataFrame, k: int = GRAM, window: int = WINDOW, rows_a_part: int = 2_000) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    The edited text is the text with its last third, in code points and rounded down, replaced by as many first code
    points of the next document (all of it, if it is shorter); documents are ordered by descending doc_id, and the
    first follows the last. Repeated rows follow one another in the order of text hash and text; a row without a
    doc_id comes last; a null text is empty; a single row follows itself; an empty table gives an empty result.
    """
    total = docs.count()
    schema_text = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    if not total:
        return docs.sparkSession.createDataFrame([], schema_text)
    parts = max(1, min(100_000, total // rows_a_part))
    placed = with_next(docs, parts)
    dealt = placed.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("id").desc(), F.xxhash64("text"), "text")

    def row(doc, text, own, next_text, next_own):
        n = len(text) // 3
        edited = text[: len(text) - n] + next_text[:n]
        other = winnow(edited, k, window)
        return (None if doc == -(2**63) else doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(own), as_string(other), likeness(own[0], other[0]), likeness(own[0], next_own[0]))

    def run(batches):
        held = done = None  # the row that waits for its next; the part whose guest has come
        for b in batches:
            out = []
            for part, guest, doc, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if guest and done == part:
                    continue
                text = text or ""
                own = winnow(text, k, window)
                if held is not None:
                    out.append(row(*held, text, own))
                held = None if guest else (doc, text, own)
                if guest:
                    done = part
            yield record_batch(list(zip(*out, strict=True)) if out else [[] for _ in schema], schema)

    return in_batches(dealt, run, schema_text)
