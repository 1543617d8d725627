"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product; a vector gets one more coordinate, sqrt(M^2 - |x|^2) with M the longest vector's length,
under which the largest inner product is the smallest distance. Trees are fitted on a bounded sample and every
vector is indexed: it is routed to one leaf of each tree. A query takes leaves of all trees in the order of one
priority queue that they share, until these hold a budget of rows; its leaf candidates are scored exactly. A
leaf's priority is the chance that a neighbour lies there: each plane that parts it from the query's side costs
softplus(sharpness * margin). Sharpness and budget are measured, not guessed: for a bounded set of probe queries
the true neighbours are found by brute force, and the budget is the least one whose leaves hold the wanted share of them.

Leaves are dealt out by blocks, the subtrees of some thousand rows. A vector travels once for each tree, a query
once for each block in which it wants a leaf, with a bitmap of the leaves that it wants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import by_value, cut, discard, record_batch

by_value(__name__)

#: Trees, and rows aimed at in a leaf; a leaf needs some sampled rows, so a tree has at most log2(SAMPLE / LEAF_SAMPLE) levels.
TREES, LEAF_ROWS, LEAF_SAMPLE = 8, 24, 16
#: Bounds of the fitting sample and the probe queries; the share of true neighbours that probes must reach.
SAMPLE, PROBES, REACH = 65_536, 128, 0.94
#: Vectors and queries that meet in one task at most; larger blocks are dealt out as a grid. A block returns ``k`` rows for each query, so few large ones are better.
GROUP_ROWS, GROUP_QUERIES = 65_536, 4_096
#: Multiples of the projections' spread that are tried as the softness of a margin.
SOFTNESS = (0.25, 0.5, 1.0, 2.0)


@dataclass
class Forest:
    """Planes ``(trees, nodes, width)`` and thresholds of complete binary trees; leaf numbers are read off the path."""

    planes: np.ndarray
    limits: np.ndarray
    depth: int
    longest: float
    spread: float
    sharp: float = 1.0

    def margins(self, v: np.ndarray, queries: bool) -> np.ndarray:
        """Signed distance of each row to each plane: ``(rows, trees, nodes)``."""
        flat = self.planes.reshape(-1, self.planes.shape[2])
        return (widened(v, 0.0 if queries else self.longest) @ flat.T).reshape(len(v), *self.limits.shape) - self.limits

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: ``(rows, trees)``."""
        out, wide = np.zeros((len(v), len(self.planes)), int), widened(v, self.longest)
        for t in range(len(self.planes)):
            for level in range(self.depth):
                node = (1 << level) - 1 + out[:, t]
                out[:, t] = 2 * out[:, t] + ((wide * self.planes[t, node]).sum(axis=1) > self.limits[t, node])
        return out

    def costs(self, q: np.ndarray) -> np.ndarray:
        """What it costs each query to go to each leaf of each tree: ``(queries, trees, leaves)``."""
        g = (self.sharp * self.margins(q, queries=True)).astype(np.float32)
        right = np.log1p(np.exp(-np.abs(g))) + np.maximum(-g, 0)  # softplus(-g); softplus(g) is g more
        cost = np.zeros((*g.shape[:2], 1), np.float32)
        for level in range(self.depth):
            at, deeper = slice((1 << level) - 1, (2 << level) - 1), np.empty((*g.shape[:2], 2 << level), np.float32)
            np.add(cost, right[:, :, at], out=deeper[:, :, 1::2])
            np.add(deeper[:, :, 1::2], g[:, :, at], out=deeper[:, :, ::2])
            cost = deeper
        return cost

    def reached(self, q: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows held by the leaves before each one in a query's queue, as :meth:`costs`' shape."""
        flat = self.costs(q).reshape(len(q), -1)
        order = np.argsort(flat, axis=1)
        held = sizes.ravel()[order]
        out = np.empty(flat.shape)
        out[np.arange(len(q))[:, None], order] = np.cumsum(held, axis=1) - held
        return out.reshape(len(q), *sizes.shape)


def widened(v: np.ndarray, longest: float) -> np.ndarray:
    last = np.sqrt(np.maximum(0, longest**2 - (v**2).sum(axis=1))) if longest else np.zeros(len(v))
    return np.column_stack([v, last])


def usable(table: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: vectors with components, all finite and some not zero."""
    rows = table.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which change no inner product."""
    flat, n = np.asarray(column.flatten(), np.float64), len(column)
    sizes = np.diff(np.asarray(column.offsets))
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, always summed in the same order."""
    return (np.ascontiguousarray(q) * np.ascontiguousarray(v)).sum(axis=1)


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest finite values, and of those that rounding may have put behind them."""
    if s.shape[1] > k:
        least = np.partition(s, -k, axis=1)[:, -k]
        least = least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        return np.nonzero((s >= least[:, None]) & np.isfinite(s))
    return np.nonzero(np.isfinite(s))


def grow(sample: np.ndarray, trees: int, depth: int, longest: float, seed: int) -> Forest:
    """At each node two random differences of its rows are tried as a plane, and the one of larger spread is cut at its median."""
    rng, wide = np.random.default_rng(seed), widened(sample, longest)
    planes, limits = np.zeros((trees, (1 << depth) - 1, wide.shape[1])), np.zeros((trees, (1 << depth) - 1))
    spread = 0.0
    for t in range(trees):
        at = np.zeros(len(wide), int)
        for level in range(depth):
            nodes, order = 1 << level, np.argsort(at, kind="stable")
            begin = np.searchsorted(at[order], np.arange(nodes + 1))
            have = np.diff(begin)
            chosen = x = most = None
            for _ in range(2):
                a, b = (order[np.minimum(begin[:-1] + (rng.random(nodes) * have).astype(int), len(order) - 1)] for _ in range(2))
                w = wide[a] - wide[b]
                length = np.linalg.norm(w, axis=1, keepdims=True)
                flat = length[:, 0] < 1e-12
                w[flat], length[flat] = rng.standard_normal((int(flat.sum()), w.shape[1])), wide.shape[1] ** 0.5
                w = w / length
                y = (wide * w[at]).sum(axis=1)
                n = np.maximum(1, have)
                mean = np.bincount(at, y, nodes) / n
                wide_by = np.bincount(at, (y - mean[at]) ** 2, nodes) / n
                if chosen is None:
                    chosen, x, most = w, y, wide_by
                else:
                    better = wide_by > most
                    chosen, x, most = np.where(better[:, None], w, chosen), np.where(better[at], y, x), np.maximum(most, wide_by)
            order = np.lexsort((x, at))
            middle = np.where(have > 0, x[order[np.minimum(begin[:-1] + (have - 1) // 2, len(order) - 1)]], 0.0)
            planes[t, nodes - 1 : 2 * nodes - 1], limits[t, nodes - 1 : 2 * nodes - 1] = chosen, middle
            spread = max(spread, float(np.sqrt(most.max())))
            at = 2 * at + (x > middle[at])
    return Forest(planes, limits, depth, longest, spread or 1.0)


@dataclass
class Plan:
    """A fitted forest, its leaves' sizes, the rows a query may visit, and the share of the probes' neighbours which that reaches."""

    forest: Forest
    sizes: np.ndarray
    budget: float
    reach: float
    rows: int


def _pick(df: DataFrame, rows: int, of: int, salt: str) -> DataFrame:
    """Some ``rows`` rows by the hash of their id."""
    return df.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1_000_000)) < int(1e6 * min(1.0, 1.2 * rows / max(1, of)))).limit(rows)


def true_neighbours(base: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """``(query_id, score, vec_id, v)`` by brute force: each partition returns ``k`` for each of a bounded number of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def scan(batches):
        best = (np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, q.shape[1])))
        for b in batches:
            if b.num_rows:
                v, owner = matrix(b.column(1), q.shape[1]), b.column(0).to_numpy(zero_copy_only=False)
                s = q @ v.T
                s[ids[:, None] == owner[None, :]] = -np.inf
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                new = np.take_along_axis(s, at, 1), owner[at], v[at]
                held = [np.concatenate(x, axis=1) for x in zip(best, new, strict=True)]
                top = np.argsort(-held[0], axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(held[0], top, 1), np.take_along_axis(held[1], top, 1), np.take_along_axis(held[2], top[:, :, None], 1)
        i, j = np.nonzero(np.isfinite(best[0]))
        if len(i):
            yield record_batch([ids[i], best[0][i, j], best[1][i, j], best[2][i, j].tolist()], schema)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return base.mapInArrow(scan, "query_id long, score double, vec_id long, v array<double>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def fit(queries: DataFrame, base: DataFrame, k: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, reach: float = REACH, seed: int = 42) -> Plan | None:
    """Trees on a sample of ``base``, and the budget that the probes among ``queries`` need; None if ``base`` is empty."""
    spark = base.sparkSession
    found = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + double(x) * double(x))"))).alias("longest")).first()
    n, d = found["n"], found["d"]
    if not n:
        return None
    some = _pick(base, SAMPLE, n, "sample").select("v").toArrow() if n > SAMPLE else base.select("v").toArrow()
    if not some.num_rows:
        some = base.select("v").limit(SAMPLE).toArrow()
    sample = matrix(some.column(0).combine_chunks(), d)
    depth = int(np.clip(round(np.log2(n / leaf_rows)), 1, max(1, np.log2(len(sample) / LEAF_SAMPLE)))) if n > 1 else 1
    forest = grow(sample, trees, depth, found["longest"], seed)
    held = spark.sparkContext.broadcast(vars(forest))
    count_schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("n", pa.int64())])

    def count(batches):
        forest, sizes = Forest(**held.value), np.zeros((trees, 1 << depth), np.int64)
        for b in batches:
            if b.num_rows:
                at = forest.leaves(matrix(b.column(0), d))
                for t in range(trees):
                    sizes[t] += np.bincount(at[:, t], minlength=1 << depth)
        t, leaf = np.nonzero(sizes)
        yield record_batch([t, leaf, sizes[t, leaf]], count_schema)

    sizes = np.zeros((trees, 1 << depth))
    counted = base.select("v").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most trees * SAMPLE / LEAF_SAMPLE rows
        sizes[r["tree"], r["leaf"]] = r["n"]

    asked = _pick(queries, PROBES, queries.count(), "probe").toArrow()
    if not asked.num_rows:
        asked = queries.limit(PROBES).toArrow()
    if not asked.num_rows:
        return Plan(forest, sizes, np.inf, 1.0, n)
    ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("v").combine_chunks(), d)
    true = true_neighbours(base, ids, q, k).toArrow()  # at most PROBES * k rows
    if not true.num_rows:
        return Plan(forest, sizes, np.inf, 1.0, n)
    leaves = forest.leaves(matrix(true.column("v").combine_chunks(), d))
    where = {i: row for row, i in enumerate(ids.tolist())}
    owner = np.array([where[i] for i in true.column("query_id").to_pylist()])
    options = []
    for softness in SOFTNESS:
        forest.sharp = 1.702 / (softness * forest.spread)
        before = forest.reached(q, sizes)
        cost = np.array([before[o, np.arange(trees), at].min() for o, at in zip(owner, leaves, strict=True)])
        budget = float(np.quantile(cost, reach, method="higher"))
        options.append((budget, forest.sharp, float((cost <= budget).mean())))
    budget, forest.sharp, share = min(options)
    return Plan(forest, sizes, budget, share, n)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, reach: float = REACH, seed: int = 42, group_rows: int = GROUP_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(vec_id, v)`` its ``k`` nearest found among ``vectors(vec_id, v)``.

    A query's own id is no candidate; ties go to the smaller vec_id; with fewer candidates than ``k`` all are returned. Equal
    vectors beyond the ``k + 1`` smallest ids cannot be among any ``k`` nearest and are left out of the index, so a
    hot vector fills no leaf. An id that repeats counts once for each different vector and is ranked by the
    best. A shorter vector counts as filled up with zeros. Empty inputs give an empty result.
    """
    copies = Window.partitionBy("v").orderBy("vec_id")
    base = cut(vectors.distinct().withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1).drop("r"))
    asking = cut(queries.distinct())
    plan = fit(asking, base, k, trees, leaf_rows, reach, seed)
    if plan is None:
        discard(base)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(asking, base, plan, k, group_rows, group_queries)


def search(asking: DataFrame, base: DataFrame, plan: Plan, k: int, group_rows: int = GROUP_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The ``k`` nearest that the plan's budget reaches."""
    spark = base.sparkSession
    depth, trees = plan.forest.depth, len(plan.sizes)
    budget = plan.budget if plan.rows > k + 1 else np.inf
    high = int(np.clip(np.ceil(np.log2(max(1, plan.rows / group_rows))), 0, depth))  # the level at which blocks are cut off
    below = depth - high
    width = plan.forest.planes.shape[2] - 1
    held = spark.sparkContext.broadcast((vars(plan.forest), plan.sizes))
    real = base.schema["v"].dataType.simpleString()
    routed_schema = pa.schema([("tree", pa.int32()), ("block", pa.int32()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_({"float": pa.float32()}.get(base.schema["v"].dataType.elementType.simpleString(), pa.float64())))])
    routed_type = "tree int, block int, leaf int, vec_id long, v " + (real if real == "array<float>" else "array<double>")

    def route(batches):
        forest = Forest(**held.value[0])
        for b in batches:
            if b.num_rows:
                at = forest.leaves(matrix(b.column(1), width))
                for t in range(trees):
                    yield record_batch([np.full(len(at), t), at[:, t] >> below, at[:, t] & ((1 << below) - 1), b.column(0), b.column(1).cast(routed_schema.field("v").type)], routed_schema)

    asked_schema = pa.schema([("tree", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("wanted", pa.binary()), ("q", pa.list_(pa.float64()))])

    def ask(batches):
        forest, sizes = Forest(**held.value[0]), held.value[1]
        piece = max(1, (1 << 22) // sizes.size)
        for b in batches:
            owner = b.column(0).to_numpy(zero_copy_only=False)
            vectors = matrix(b.column(1), width) if b.num_rows else np.zeros((0, width))
            for at in range(0, len(owner), piece):
                q = vectors[at : at + piece]
                wanted = ((forest.reached(q, sizes) <= budget) & (sizes > 0)).reshape(len(q), trees, 1 << high, 1 << below)
                i, t, block = np.nonzero(wanted.any(axis=3))
                bits = np.packbits(wanted[i, t, block], axis=1, bitorder="little")
                yield record_batch([t, block, owner[at + i], [x.tobytes() for x in bits], q[i].tolist()], asked_schema)

    hit_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_schema.empty_table()
        right = right.sort_by("leaf")
        q, v = matrix(left.column("q").combine_chunks(), width), matrix(right.column("v").combine_chunks(), width)
        asking_ids, ids, leaf = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("leaf").to_numpy()
        wanted = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=1 << below, bitorder="little") for x in left.column("wanted").to_pylist()], bool)
        begin = np.searchsorted(leaf, np.arange((1 << below) + 1))
        held_by = np.diff(begin)
        room = wanted @ held_by  # rows that each query looks at; they are laid side by side
        out, piece = [], int(max(1, (1 << 22) // max(1, room.max())))
        for at in range(0, len(q), piece):
            some, want = q[at : at + piece], wanted[at : at + piece]
            s = np.full((len(some), int(room[at : at + piece].max())), -np.inf)
            column, filled = np.zeros(s.shape, np.int32), np.zeros(len(some), int)
            for one in np.nonzero((held_by > 0) & want.any(axis=0))[0]:
                who, span = np.nonzero(want[:, one])[0], np.arange(begin[one], begin[one + 1])
                to = filled[who][:, None] + np.arange(len(span))
                s[who[:, None], to] = some[who] @ v[span[0] : span[-1] + 1].T
                column[who[:, None], to] = span
                filled[who] += len(span)
            s[(asking_ids[at : at + piece, None] == ids[column])] = -np.inf
            i, place = best_of(s, k)
            j = column[i, place]
            exactly = exact(some[i], v[j])
            order = np.lexsort((ids[j], -exactly, i))
            i, j, exactly = i[order], j[order], exactly[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((asking_ids[at + i[keep]], ids[j[keep]], exactly[keep]))
        return pa.table([np.concatenate([o[c] for o in out]) for c in range(3)], schema=hit_schema)

    routed = base.mapInArrow(route, routed_type)
    asked = asking.mapInArrow(ask, "tree int, block int, query_id long, wanted binary, q array<double>")
    # A block is dealt out as a grid of row and query parts, so that no task holds more than a bounded group.
    rows_in = plan.sizes.reshape(trees, 1 << high, -1).sum(axis=2)
    parts = max(1, -(-asking.count() // group_queries))
    cells = [(t, block, int(max(1, -(-rows_in[t, block] // group_rows)))) for t in range(trees) for block in range(1 << high)]  # at most trees * SAMPLE / LEAF_SAMPLE
    grid = lambda: F.broadcast(spark.createDataFrame(cells, "tree int, block int, vp int"))
    rows = routed.join(grid(), ["tree", "block"]).selectExpr("tree", "block", "leaf", "vec_id", "v", "pmod(xxhash64(vec_id), vp) AS a", f"explode(sequence(0L, {parts - 1}L)) AS b")
    seeks = asked.join(grid(), ["tree", "block"]).selectExpr("tree", "block", "query_id", "wanted", "q", f"pmod(xxhash64(query_id), {parts}L) AS b", "explode(sequence(0L, vp - 1L)) AS a")
    cell = ["tree", "block", "a", "b"]
    hits = seeks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(score, "query_id long, vec_id long, score double")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
