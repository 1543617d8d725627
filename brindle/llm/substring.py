"""Substring dedup behind a count-min prefilter.

A window is 50 consecutive words. Pass one sketches, in each partition, how many documents hold each
window's anchor: the smallest hash of the 8-word grams in the window. A repeated window repeats its anchor,
so anchor counts are at least the windows' counts, and one anchor stands for some twenty windows. The
partition sketches are merged cell by cell. Pass two emits only windows whose every sketch cell was seen in two or
more documents, and groups these by 96 bits of their words' hash, so nothing is lost; a third step removes the
covered words. The sketch's cells grow with the text. Up to a bound it is broadcast; beyond it stays distributed, and
each document's anchors are looked up by joins with its blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_value, cut, discard, in_batches, record_batch, settle, utf8

by_value(__name__)

#: Words of an anchor; rows of the sketch; its cells for each kilobyte of text; the width up to which it is broadcast (two bitmaps of 32 MB each).
ANCHOR, DEPTH, CELLS_A_KB, MOST_BITS = 8, 2, 64, 28
#: Cells of a block, in which partition sketches are merged.
BLOCK_BITS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _runs(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` values, built from runs of powers of two."""
    power, out, at, length = h, None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if n & length:
                if out is None:
                    out = power
                else:
                    m = len(power) - at
                    out = _mix(out[:m] * np.uint64(0x9E3779B97F4A7C15) + power[at : at + m] + np.uint64(salt + length))
                at += length
            length *= 2
            if length > n:
                return out
            half = length // 2
            power = _mix(power[:-half] * np.uint64(0xD6E8FEB86659FD93) + power[half:] + np.uint64(salt))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` consecutive values."""
    length = 1
    while length * 2 <= n:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return np.minimum(h[: len(h) - (n - length)], h[n - length :]) if n > length else h


def word_hashes(text: bytes | None, size: int) -> np.ndarray | None:
    """A hash of each word of a text; None if it has fewer than ``size`` words."""
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) if len(words) >= size else None


def anchors(h: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window."""
    span = min(ANCHOR, size)
    with np.errstate(over="ignore"):
        return _least(_runs(h, span, 7), size - span + 1)


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(anchor + np.uint64(0x632BE59BD9B4E019 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """The merged count-min sketch as ``(row, block, bitmap)``: the cells that two or more documents fall into.

    A partition counts, saturating at two, the documents of each cell and emits the cells it has seen; their
    sums meet block by block. A document adds one to a cell however many of its windows fall there.
    """
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])

    def count(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        room = 0

        def flush():
            for row in range(DEPTH):
                cell, n = np.unique(np.concatenate(held[row] or [np.zeros(0, np.uint64)]), return_counts=True)
                held[row].clear()
                block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
                low = (cell & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u4") | (n > 1).astype("<u4") << np.uint32(31)
                edges = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(block)]]) if len(block) else [0]
                rows = [(row, int(block[a]), low[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                if rows:
                    yield record_batch(list(zip(*rows, strict=True)), schema)

        for b in batches:
            for text in utf8(b.column(0)):
                h = word_hashes(text, size)
                if h is not None:
                    anchor = np.unique(anchors(h, size))
                    for row in range(DEPTH):
                        held[row].append(np.unique(cells(anchor, row, bits)))
                    room += len(anchor)
            if room > 4_000_000:
                yield from flush()
                room = 0
        yield from flush()

    merged_schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bitmap", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        seen, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
        for chunk in table.column("cells").to_pylist():
            low = np.frombuffer(chunk, "<u4")
            at = low & np.uint32((1 << BLOCK_BITS) - 1)
            twice[at] |= seen[at] | (low >> np.uint32(31) > 0)
            seen[at] = True
        return pa.table([table.column("row")[:1], table.column("block")[:1], [np.packbits(twice, bitorder="little").tobytes()]], schema=merged_schema)

    return in_batches(docs.select(F.col("text").cast("string")), count, "row int, block int, cells binary").groupBy("row", "block").applyInArrow(merge, "row int, block int, bitmap binary")


def _emit(rows: DataFrame, size: int, keep) -> DataFrame:
    """``(doc_id, start, w, x)`` of the windows of ``rows(doc_id, text, ...)`` whose anchors ``keep(other columns of the row, distinct anchors)`` marks; ``w`` and ``x`` are 96 bits of the words' hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("w", pa.int64()), ("x", pa.int32())])

    def emit(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            others = zip(*[c.to_pylist() for c in b.columns[2:]], strict=True) if b.num_columns > 2 else ((),) * b.num_rows
            for doc, text, other in zip(b.column(0).to_pylist(), utf8(b.column(1)), others, strict=True):
                h = word_hashes(text, size) if doc is not None else None
                if h is None:
                    continue
                anchor, where = np.unique(anchors(h, size), return_inverse=True)
                start = np.nonzero(keep(other, anchor)[where])[0]
                if len(start):
                    with np.errstate(over="ignore"):
                        w, x = _runs(h, size, 11)[start], _runs(h, size, 13)[start] >> np.uint64(32)
                    out[0].append(np.full(len(start), doc, np.int64))
                    out[1].append(start.astype(np.int32))
                    out[2].append(w.view(np.int64))
                    out[3].append(x.astype(np.uint32).view(np.int32))
            if out[0]:
                yield record_batch([np.concatenate(c) for c in out], schema)

    return in_batches(rows, emit, "doc_id long, start int, w long, x int")


def _by_broadcast(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Windows whose anchors the whole sketch, at most DEPTH * 2^MOST_BITS bits, has seen in two documents."""
    maps = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
    for r in sketch(rows, size, bits).toLocalIterator():
        at = r["block"] << (BLOCK_BITS - 3)
        maps[r["row"], at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(r["bitmap"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(maps)

    def keep(_, anchor):
        marked = np.ones(len(anchor), bool)
        for row in range(DEPTH):
            c = cells(anchor, row, bits)
            marked &= (shared.value[row, c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return marked

    return _emit(rows.select("doc_id", "text"), size, keep)


def _by_joins(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """The same by joins of each document's distinct anchors with the blocks of the sketch; a hot block's rows are split as any skewed join's."""
    merged = cut(sketch(rows, size, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), *[(f"c{row}", pa.int64()) for row in range(DEPTH)]])

    def list_anchors(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                h = word_hashes(text, size) if doc is not None else None
                if h is not None:
                    anchor = np.unique(anchors(h, size))
                    out.append((np.full(len(anchor), doc, np.int64), anchor.view(np.int64), *[cells(anchor, row, bits).view(np.int64) for row in range(DEPTH)]))
            if out:
                yield record_batch([np.concatenate(c) for c in zip(*out, strict=True)], schema)

    asked = in_batches(rows.select("doc_id", "text"), list_anchors, "doc_id long, anchor long, " + ", ".join(f"c{row} long" for row in range(DEPTH)))
    for row in range(DEPTH):
        blocks = merged.where(F.col("row") == row).select("block", "bitmap")
        inside = F.col(f"c{row}") % (1 << BLOCK_BITS)
        byte = F.conv(F.hex(F.substring("bitmap", (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.expr(f"shiftright(__byte, cast(c{row} % 8 AS int)) & 1 = 1")
        asked = asked.withColumn("block", F.shiftright(f"c{row}", BLOCK_BITS).cast("int")).join(blocks, "block").withColumn("__byte", byte).where(bit).drop("block", "bitmap", "__byte")
    wanted = asked.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("anchor").alias("wanted"))  # bounded by the document's own words
    known = rows.join(wanted, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "wanted")
    return _emit(known, size, lambda other, anchor: np.isin(anchor, np.array(other[0], np.int64).view(np.uint64)))


def repeated_windows(docs: DataFrame, size: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """``(doc_id, start)`` of each window that also starts in a document with a smaller doc_id, and the written tables that it reads."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BLOCK_BITS, int(chars // 1024 * CELLS_A_KB).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = settle(lambda: (_by_broadcast if bits <= most_bits else _by_joins)(rows, size, bits))
    # Counts meet before the shuffle; only windows of two documents or more come back.
    first = some.groupBy("w", "x").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "x", "first")
    first = cut(first)  # the join then has plain exchanges on both sides, whose hot windows Spark can split
    return some.join(first, ["w", "x"]).where("doc_id > first").select("doc_id", "start"), [some, first]


def removals(docs: DataFrame, size: int = 50, most_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, starts)``: the distinct starts of a document's repeated windows, as little-endian 32-bit numbers in order."""
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary())])
    repeated, written = repeated_windows(docs, size, most_bits)
    found = repeated.groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("s"))  # bounded by the document's own words

    def pack(batches):
        for b in batches:
            s = b.column(1)
            flat, ends = np.asarray(s.flatten()).astype("<i4"), np.cumsum([len(x) for x in s])
            yield record_batch([b.column(0), [x.tobytes() for x in np.split(flat, ends[:-1])]], schema)

    out = cut(found.mapInArrow(pack, "doc_id long, starts binary"))
    for table in written:  # their space is free before the texts are read again
        discard(table)
    return out


def covered(n: int, starts: bytes | None, size: int) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    step = np.zeros(n + 1, np.int64)
    if starts:
        at = np.frombuffer(starts, "<i4")
        at = at[at + size <= n]
        np.add.at(step, at, 1)
        np.add.at(step, at + size, -1)
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame, size: int = 50, with_text: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` for each row.

    A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are judged on
    the input. Kept words are joined by one space. A null text has no words; rows without a doc_id keep all of
    theirs and repeat nobody; rows that share a doc_id are one document, so each loses what any of them would lose where it
    has that many words; texts of fewer than ``size`` words stay whole; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    schema = pa.schema(fields)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(batches):
        for b in batches:
            out = []
            for doc, text, starts in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(len(words), starts, size) if starts else np.zeros(0, bool)
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if len(gone) else words)
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            yield record_batch(list(zip(*out, strict=True)) if out else [[] for _ in fields], schema)

    joined = rows.join(removals(rows, size, most_bits).withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "starts")
    return in_batches(joined, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS s FROM documents)
), x AS (
  SELECT doc_id, i, word, count(*) OVER r AS n, md5(string_agg(word, ' ') OVER r) AS h FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), m AS (SELECT h, min(doc_id) AS first FROM x WHERE n = 50 GROUP BY h HAVING min(doc_id) < max(doc_id)
), f AS (
  SELECT x.doc_id, x.i, x.word, (m.first IS NOT NULL AND m.first < x.doc_id AND x.n = 50)::INT AS starts FROM x LEFT JOIN m USING (h)
), c AS (
  SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f
), s AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
