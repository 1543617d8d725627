"""SimHash near-dedup: fingerprints meet in the shards of vantage-point trees.

Two fingerprints at ``k`` bits or fewer differ in at most ``k // PARTS`` bits of one of their parts, so there is a tree
for each part, over the Hamming distance of that part alone. A node of a tree has a vantage fingerprint and a radius
``mu``; its inner shard takes what lies within ``mu + k // PARTS`` of the vantage point and its outer shard what lies
beyond ``mu``. By the triangle inequality any two fingerprints at ``k`` or fewer bits share a shard of some tree, so
shards are searched on their own and no pair is lost. What lies in the boundary band goes to both sides; the band
of a part is narrow beside the spread of its distances, which keeps the copies of a fingerprint few. The
top of a tree comes from a bounded sample of distinct fingerprints; its lower levels are built inside each shard.
A shard returns one star per local component, never all of its pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_value, clear_of, cut, hex64, in_batches, record_batch, settle, utf8
from brindle.llm.graph import connected_components

by_value(__name__)

#: Distinct fingerprints aimed at in a shard; a shard above BLOCK_ROWS is searched block by block.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 32_768, 131_072, 512
#: Parts of a fingerprint, each with a tree of its own.
PARTS = 2
#: Bound on the fingerprints sampled for vantage points, and the largest share of all that a sample takes.
SAMPLE_ROWS, SAMPLE_SHARE = 65_536, 0.25


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero if the text has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, with_key: bool = False) -> DataFrame:
    """``(doc_id, fp[, k])`` for each row of ``docs``, ``k`` a hash of the text; a null text counts as one without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [("k", pa.int64())] * with_key)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in utf8(b.column(1))], np.uint64)
            yield record_batch([b.column(0), fps.view(np.int64), *b.columns[2:]], schema)

    text = F.col("text").cast("string")
    key = [F.xxhash64(F.coalesce(text, F.lit(""))).alias("k")] * with_key
    return in_batches(docs.select(F.col("doc_id").cast("long"), text, *key), run, "doc_id long, fp long" + ", k long" * with_key)


def masks(parts: int = PARTS) -> list[np.uint64]:
    """The bits of each part: every ``parts``-th bit, so that parts spread alike."""
    return [np.uint64(sum(1 << b for b in range(i, 64, parts))) for i in range(parts)]


def apart(fps: np.ndarray, v, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(v)) & mask).astype(np.int16)


def _vantage(points: np.ndarray, band: int, mask: np.uint64) -> tuple[np.uint64, int, float]:
    """Of some candidates the vantage point and radius that leave the fewest copies, and the larger side's share."""
    best = (points[0], 0, 2.0, 9.0)
    for v in points[np.linspace(0, len(points) - 1, 12).astype(int)]:
        have = np.bincount(apart(points, v, mask), minlength=65 + band)
        within = np.cumsum(have) / len(points)
        mid = int(np.searchsorted(within, 0.5))
        for mu in range(max(0, mid - 5), mid + 2):
            inner, outer = within[mu + band], 1 - within[mu]
            cost = inner**1.25 + outer**1.25
            if max(inner, outer) < 0.95 and cost < best[3]:
                best = (v, mu, max(inner, outer), cost)
    return best[:3]


def build(sample: np.ndarray, total: int, shard_rows: int, band: int, mask: np.uint64) -> list[tuple]:
    """Nodes ``(vantage, mu, inner, outer)``; a child below zero is the shard ``-1 - child``."""
    nodes: list[tuple] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        if len(points) >= 32 and len(points) * total / max(1, len(sample)) > shard_rows:
            v, mu, share = _vantage(points, band, mask)
            if share < 1:
                at, d = len(nodes), apart(points, v, mask)
                nodes.append(())
                nodes[at] = (int(v), mu, grow(points[d <= mu + band]), grow(points[d > mu]))
                return at
        shards += 1
        return -shards

    grow(sample)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple], band: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fps`` and the shards of one tree that they go to."""
    rows, shards, work = [], [], [(0 if nodes else -1, np.arange(len(fps)))]
    while work:
        node, at = work.pop()
        if node < 0:
            rows.append(at)
            shards.append(np.full(len(at), -1 - node))
        elif len(at):
            v, mu, inner, outer = nodes[node]
            d = apart(fps[at], v, mask)
            work += [(inner, at[d <= mu + band]), (outer, at[d > mu])]
    return np.concatenate(rows), np.concatenate(shards)


def local_roots(fps: np.ndarray, reach: int) -> np.ndarray:
    """For each of some distinct fingerprints, the position of the first one that it reaches among them."""
    label = np.arange(len(fps))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)

    band = reach // PARTS
    work = [(np.arange(len(fps)), mask) for mask in masks()] if len(fps) > LEAF_ROWS else [(np.arange(len(fps)), masks()[0])]
    while work:
        at, mask = work.pop()
        if len(at) < 2:
            continue
        if len(at) > LEAF_ROWS:
            v, mu, share = _vantage(fps[at], band, mask)
            if share < 1:
                d = apart(fps[at], v, mask)
                work += [(at[d <= mu + band], mask), (at[d > mu], mask)]
                continue
        # Grow one component at a time and drop what is reached: a dense ball costs little more than one scan.
        rest = at
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            if len(rest) <= LEAF_ROWS and len(at) <= LEAF_ROWS:
                near = np.bitwise_count(fps[at][:, None] ^ fps[at][None, :]) <= reach
                a, b = np.nonzero(np.triu(near, 1))
                if len(a) > 16 * len(at):  # dense: only a spanning part of the links is needed
                    _, keep = np.unique(b, return_index=True)
                    for x, y in zip(at[a[keep]], at[b[keep]], strict=True):
                        join(x, y)
                    linked = np.array([find(x) for x in at])
                    more = linked[a] != linked[b]
                    a, b = a[more], b[more]
                for x, y in zip(at[a], at[b], strict=True):
                    join(x, y)
                break
            while len(front) and len(rest):
                some, front = front[:32], front[32:]
                near = (np.bitwise_count(fps[some][:, None] ^ fps[rest][None, :]) <= reach).any(axis=0)
                for y in rest[near]:
                    join(some[0], y)
                hit = rest[near]
                if len(some) > 1:  # those reached by another of the block are of the same component all the same
                    for x in some[1:]:
                        join(some[0], x)
                front, rest = np.concatenate([front, hit]), rest[~near]
    return np.array([find(x) for x in range(len(fps))], int)


def links(distinct: DataFrame, total: int, reach: int = 3, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(u, v)`` links between distinct fingerprints ``distinct(fp)`` that join exactly those at ``reach`` bits."""
    band, trees = reach // PARTS, []
    if total > shard_rows:
        share = min(SAMPLE_SHARE, SAMPLE_ROWS / total)
        sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit("vantage")), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE_ROWS)
        found = np.sort(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64))
        if len(found):
            trees = [(build(found, total, shard_rows, band, mask), mask) for mask in masks()]

    routed_schema, link_schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64())]), pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i, (nodes, mask) in enumerate(trees or [([], masks()[0])]):
                rows, shards = route(fps.view(np.uint64), nodes, band, mask)
                yield record_batch([shards * PARTS + i, fps[rows]], routed_schema)

    def search(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy())
        roots = local_roots(fps.view(np.uint64), reach)
        moved = roots != np.arange(len(fps))
        return pa.table([fps[moved], fps[roots[moved]]], schema=link_schema)

    routed = distinct.select("fp").mapInArrow(spread, "shard int, fp long")
    if not trees:
        return routed.withColumn("lo", F.lit(0)).groupBy("shard", "lo").applyInArrow(search, "u long, v long")
    routed = cut(_deepened(cut(routed), reach, shard_rows, block_rows))  # read twice below
    # What is still too large for one task is dealt out as blocks; every two blocks of it meet in one task.
    large = routed.groupBy("shard", "sub").count().where(F.col("count") > block_rows).select("shard", "sub", F.ceil(F.col("count") * 2 / block_rows).cast("int").alias("parts"))
    n = F.coalesce("parts", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = routed.join(large, ["shard", "sub"], "left").select("shard", "sub", "fp", block.alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("o")).select("shard", "sub", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp")
    return dealt.groupBy("shard", "sub", "lo", "hi").applyInArrow(search, "u long, v long")


def _deepened(routed: DataFrame, reach: int, shard_rows: int, block_rows: int) -> DataFrame:
    """``routed(shard, fp)`` with ``sub``: shards of more than ``block_rows`` get a tree of their own, from a sample of their own rows that meets on an executor."""
    band = reach // PARTS
    large = routed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    large = cut(large.withColumn("chunks", F.ceil(F.col("n") / block_rows).cast("int")))
    if large.isEmpty():
        return routed.withColumn("sub", F.lit(0))
    tree_schema, out_schema = pa.schema([("shard", pa.int32()), ("tree", pa.binary())]), pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("sub", pa.int32())])
    most = SAMPLE_ROWS // 4

    def grow(table: pa.Table) -> pa.Table:
        shard, n = table.column("shard")[0].as_py(), table.column("n")[0].as_py()
        nodes = build(np.sort(table.column("fp").to_numpy().view(np.uint64)), n, shard_rows, band, masks()[shard % PARTS])
        return pa.table([[shard], [pickle.dumps(nodes)]], schema=tree_schema)

    def deal(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tree = right.column("tree").to_pylist()
        nodes = pickle.loads(tree[0]) if tree and tree[0] else []  # made by this job's own tasks
        fps = left.column("fp").to_numpy()
        rows, subs = route(fps.view(np.uint64), nodes, band, masks()[key[0].as_py() % PARTS]) if len(fps) else (np.zeros(0, int), np.zeros(0, int))
        return pa.table([np.full(len(rows), key[0].as_py()), fps[rows], subs], schema=out_schema)

    joined = routed.join(large, "shard")
    picked = joined.where(F.pmod(F.xxhash64("fp", F.lit("second")), F.lit(1_000_000)) < 1_000_000.0 * most / F.col("n"))
    trees = picked.groupBy("shard").applyInArrow(grow, "shard int, tree binary")
    spread = large.join(trees, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    chunked = joined.select("shard", "fp", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = chunked.groupBy("shard", "chunk").cogroup(spread.groupBy("shard", "chunk")).applyInArrow(deal, "shard int, fp long, sub int")
    small = routed.join(large.select("shard"), "shard", "left_anti").withColumn("sub", F.lit(0))
    return small.unionByName(dealt)


def near_duplicates(docs: DataFrame, reach: int = 3, shingle: int = 3, seed: int = 42, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row's fingerprint and component: ``(doc_id, fp, fingerprint, component_id)``.

    Rows whose fingerprints differ in ``reach`` or fewer bits are linked, and a component is all that links
    reach; its id is its smallest doc_id. Null and wordless texts have fingerprint zero and are linked like
    others; repeated rows are returned as often as given; a null doc_id is never a component's id unless
    all of its rows lack one; an empty table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(docs, shingle, seed))
    known = _components(fps, reach, shard_rows, block_rows)
    return fps.join(known.select("fp", "component_id"), "fp").select("doc_id", "fp", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _components(fps: DataFrame, reach: int, shard_rows: int, block_rows: int) -> DataFrame:
    """``(fp, root, component_id)`` of each distinct fingerprint."""

    def found() -> DataFrame:
        distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
        linked = connected_components(links(distinct, distinct.count(), reach, shard_rows, block_rows))
        return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))

    known = settle(found)
    return known.select("fp", "root").join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def keep_first(docs: DataFrame, reach: int = 3, shingle: int = 3, seed: int = 42, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id, then text hash; a missing id comes last.

    Rows that share an id but not a text are different documents. Of rows that repeat both, the one with the smallest hash of all
    its columns stays. Null and wordless texts are copies of one another. Columns stay as they are, whatever their names;
    an empty table gives an empty result.
    """
    id_, key, n = clear_of(docs, "id", "k", "n")

    def chosen() -> DataFrame:
        keyed = cut(fingerprints(docs.select("doc_id", "text"), shingle, seed, with_key=True))
        roots = _components(keyed, reach, shard_rows, block_rows)
        rows = keyed.groupBy("doc_id", "k", "fp").agg(F.count("*").alias("n")).join(roots.select("fp", "root"), "fp")
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "n")).alias("m"))
        return first.select(F.col("m.doc_id").alias(id_), F.col("m.k").alias(key), F.col("m.n").alias(n))

    kept = docs.join(settle(chosen), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(key)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*columns)
    once = kept.where(F.col(n) > 1).groupBy(id_, key).agg(F.min_by(row, F.md5(F.to_json(row))).alias("row"))
    return kept.where(F.col(n) == 1).select(*columns).unionByName(once.select("row.*"))
