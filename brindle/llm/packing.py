"""Packing documents into fixed sequences as a cutting-stock problem solved by column generation.

Documents are tokenised once and cut at every ``width`` ids; the pieces' lengths, rounded up to classes of
``grain`` ids, form a histogram of bounded size. The linear program over cutting patterns of that
histogram is solved on the driver: its columns come from a knapsack dynamic program priced with the
duals. Rounded patterns are handed to the pieces by rank within their class, in a distributed join.
"""

from __future__ import annotations

import base64
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import by_value, cut, in_batches

by_value(__name__)


def encoder(tokenizer: str, ranks: str | None, pattern: str | None):
    """``text -> ids`` of the tokenizer file; the faster library reads the same vocabulary from ``ranks``.

    Loaded once in each Python worker. A text that spells one of the tokenizer's special tokens goes
    to the tokenizer itself, as the two libraries treat it differently.
    """
    import tokenizers

    held = sys.modules["tokenizers"].__dict__.setdefault("_brindle", {})
    if (tokenizer, ranks) in held:
        return held[tokenizer, ranks]
    plain = tokenizers.Tokenizer.from_file(tokenizer)
    exact = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")
    encode = exact
    if ranks:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        special = [t.content for t in plain.get_added_tokens_decoder().values()]
        encode = lambda text: exact(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), "<u4")
    held[tokenizer, ranks] = encode
    return encode


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, width: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut at every ``width``: ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        encode = encoder(tokenizer, ranks, pattern)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.array([end_id], "<u4"))
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int64)] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def _fill(value: np.ndarray, sizes: np.ndarray, room: int, most: np.ndarray | None = None) -> np.ndarray:
    """The counts of ``sizes`` of the largest total value within ``room``; ``most`` bounds each count."""
    best = np.zeros(room + 1)
    if most is None:
        worth = np.full(room + 1, -1.0)
        worth[sizes] = value
        took = [0] * (room + 1)
        for c in range(1, room + 1):
            v = best[c - 1 :: -1] + worth[1 : c + 1]
            i = int(v.argmax())
            if v[i] > best[c - 1] + 1e-12:
                best[c], took[c] = v[i], i + 1
            else:
                best[c] = best[c - 1]
        out, c, place = np.zeros(len(sizes), np.int64), room, {int(s): i for i, s in enumerate(sizes)}
        while c > 0:
            if took[c]:
                out[place[took[c]]] += 1
                c -= took[c]
            else:
                c -= 1
        return out
    last = []
    for size, v, n in zip(sizes, value, most, strict=True):  # bounded: powers of two of each size
        k = 1
        while n > 0:
            k = min(k, n)
            if size * k <= room:
                moved = best.copy()
                moved[size * k :] = best[: room + 1 - size * k] + v * k
                better = moved > best + 1e-12
                best = np.where(better, moved, best)
                last.append((size * k, better, k, size))
            n -= k
            k *= 2
    out, c = np.zeros(len(sizes), np.int64), room
    place = {s: i for i, s in enumerate(sizes)}
    for total, better, k, size in reversed(last):
        if better[c]:
            out[place[size]] += k
            c -= total
    return out


def plan(counts: dict[int, int], room: int, gap: float = 1e-3, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({size: count}, times)`` that use each size exactly as often as ``counts`` says.

    The master program keeps a basis inverse; a knapsack over the duals prices columns, and the rounds
    end when Farley's bound or the bound by volume is within ``gap``. Solutions are rounded down; what remains, at most as many
    patterns as sizes, is packed one sequence at a time, largest piece first, by bounded knapsacks.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([counts[int(s)] for s in sizes], np.float64)
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    # Known patterns are priced first; the knapsack is solved only when none of them improves.
    pool, known = np.zeros((1024, m)), 0
    for i in range(m):  # to start with, each size and the fullest rest that larger sizes allow
        row, room_left = np.zeros(m), room - int(sizes[i])
        row[i] = 1
        for j in range(m - 1, -1, -1):
            fits = room_left // int(sizes[j])
            row[j] += fits
            room_left -= fits * int(sizes[j])
        pool[known] = row
        known += 1
    for _ in range(rounds):  # sums, not BLAS calls, whose threads stall beside a JVM
        if x.sum() <= (1 + gap) * (sizes * need).sum() / room:
            break
        duals = inverse.sum(axis=0)
        price = (pool[:known] * duals).sum(axis=1)
        best = int(price.argmax())
        if price[best] > 1 + 1e-4:
            column = pool[best]
        else:
            column = _fill(duals, sizes, room).astype(float)
            worth = float((duals * column).sum())
            if worth <= 1 + 1e-9 or x.sum() <= (1 + gap) * (duals * need).sum() / worth:
                break
            if known == len(pool):
                pool = np.concatenate([pool, np.zeros_like(pool)])
            pool[known] = column
            known += 1
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    left, found = need.astype(np.int64), []
    for j in np.argsort(-(columns.T * sizes).sum(axis=1), kind="stable"):  # fullest first
        use = columns[:, j].astype(np.int64)
        held = use > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[held] // use[held]).min())) if held.any() else 0
        if times > 0:
            left -= use * times
            found.append(({int(s): int(n) for s, n in zip(sizes[held], use[held], strict=True)}, times))
    while left.any():
        first = int(np.nonzero(left)[0][-1])
        left[first] -= 1
        use = _fill(sizes.astype(float), sizes, room - int(sizes[first]), left)
        left -= use
        use[first] += 1
        times = 1
        while (left >= use).all():
            left -= use
            times += 1
        found.append(({int(s): int(n) for s, n in zip(sizes, use, strict=True) if n}, times))
    return found


def assign(cuts: DataFrame, width: int = 2048, grain: int = 8) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``width`` ids."""
    spark = cuts.sparkSession
    size = F.ceil(F.col("length") / grain).cast("int")
    counts = {r["size"]: r["n"] for r in cuts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # at most width / grain rows
    taken, first, ranges = dict.fromkeys(counts, 0), 0, []
    for use, times in plan(counts, width // grain):
        slot = 0
        for s in sorted(use, reverse=True):
            ranges.append((s, taken[s], taken[s] + use[s] * times, use[s], first, slot))
            taken[s] += use[s] * times
            slot += use[s]
        first += times
    # Rank of a piece in its class: by buckets of hashes, about as many as a bucket has pieces.
    parts = max(1, int(max(counts.values(), default=1) ** 0.5))
    dealt = cuts.withColumns({"__size": size, "__part": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")})
    sums = dealt.groupBy("__size", "__part").agg(F.count("*").alias("n"))
    before = sums.withColumn("__before", F.sum("n").over(Window.partitionBy("__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__size", "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    order = Window.partitionBy("__size", "__part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("__row", F.row_number().over(order)).join(before, ["__size", "__part"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    # At most a few thousand ranges, whatever the input: patterns are bounded by the classes.
    table = spark.createDataFrame(ranges, "__of int, __lo long, __hi long, __each long, __first long, __slot long")
    placed = ranked.join(F.broadcast(table), (F.col("__size") == F.col("__of")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    at = F.col("__rank") - F.col("__lo")
    placed = placed.withColumns({"sequence_id": F.col("__first") + F.floor(at / F.col("__each")).cast("long"), "__slot": F.col("__slot") + F.pmod(at, F.col("__each"))})
    inside = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select(*cuts.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, width: int = 2048, end_id: int = 1, grain: int = 8, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and offset.

    A null text is packed as an empty one (its end id alone), a repeated row as often as given, a long text
    as many pieces, and a null doc_id like any other; an empty table gives an empty result; columns other
    than ``doc_id`` and ``text`` are ignored.
    """
    return assign(cut(pieces(docs, tokenizer, ranks, pattern, width, end_id, with_ids)), width, grain)
