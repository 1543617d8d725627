import heapq

import numpy as np
import pytest

from brindle.llm import annforest

KIND = "vec_id long, embedding array<double>"


def brute(made, k=20):
    """``query -> [(vec_id, score)]`` over all pairs, shorter vectors filled up with zeros."""
    width = max(len(v) for _, v in made)
    full = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in made]
    out = {}
    for q, x in full:
        if q % 20 == 0:
            out[q] = [(i, s) for s, i in sorted((-float((x * y).sum()), i) for i, y in full if i != q)[:k]]
    return out


def test_recall_at_a_real_depth(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    made = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(1500, None), (1501, [0.0] * 16), (1502, [float("nan")] * 16), (1503, [float("inf")] + [1.0] * 15), (1504, [])]
    table = annforest.usable(spark.createDataFrame(made + bad, KIND))
    assert table.count() == 1500
    asking = table.where("vec_id % 20 = 0")
    plan = annforest.fit(asking, table, 20)
    assert plan.forest.depth == 6 and plan.reach >= 0.93 and plan.budget < 1500 * annforest.TREES / 2
    found, want = {}, brute(made)
    for x in annforest.nearest(asking, table, group_rows=400, group_queries=30).collect():
        found.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        true = dict((i, -s) for i, s in want[q])
        assert [x[0] for x in rows] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        assert all(x[2] == pytest.approx(float((v[x[1]] * v[q]).sum()), abs=1e-12) for x in rows)
        hits += sum(x[1] in true for x in rows)
    assert hits / (20 * len(want)) >= 0.9


def test_queue_order():
    """What leaves the queue before a leaf is what a heap that all trees share would have popped before it."""
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8))
    forest = annforest.grow(v, 3, 4, float(np.linalg.norm(v, axis=1).max()), 7)
    forest.sharp = 2.0
    at = forest.leaves(v)
    sizes = np.array([np.bincount(at[:, t], minlength=16) for t in range(3)], float)
    assert sizes.sum() == 900 and sizes.max() <= 60
    got, g = forest.reached(v[:5], sizes), forest.margins(v[:5], queries=True)
    for q in range(5):
        heap, taken = [(0.0, t, 0) for t in range(3)], 0.0
        while heap:
            cost, t, node = heapq.heappop(heap)
            if node >= 15:
                assert got[q, t, node - 15] == pytest.approx(taken)
                taken += sizes[t, node - 15]
            else:
                m = 2.0 * g[q, t, node]
                heapq.heappush(heap, (cost + np.logaddexp(0, m), t, 2 * node + 1))
                heapq.heappush(heap, (cost + np.logaddexp(0, -m), t, 2 * node + 2))


def test_small_tables_ties_copies_and_lengths(spark):
    def run(made, kind=KIND):
        table = annforest.usable(spark.createDataFrame(made, kind))
        return [(x.query_id, x["rank"], x.vec_id, x.score) for x in annforest.nearest(table.where("vec_id % 20 = 0"), table).orderBy("query_id", "rank").collect()]

    assert run([]) == [] and run([(1, [1.0])]) == [] and run([(20, [1.0])]) == []
    assert run([(0, [1.0]), (20, [2.0])]) == [(0, 1, 20, 2.0), (20, 1, 0, 2.0)]
    # Equal scores go to smaller ids, a third of all rows is one vector, rows repeat, and shorter vectors count as filled up.
    made = [(i, [1.0, 2.0]) for i in range(1, 60)] + [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (70, [9.0]), (71, [1.0, 1.0, 5.0]), (None, [1.0, 1.0])] + [(100 + i, [float(i % 7), -1.0]) for i in range(30)] + [(3, [1.0, 2.0])] * 25
    found = run(made)
    want = brute(sorted({(i, tuple(v)) for i, v in made if i is not None}))
    assert [(q, i) for q, _, i, _ in found if q == 0] == [(0, i) for i, _ in want[0]]
    assert [i for q, _, i, _ in found if q == 20] == [i for i, _ in want[20]]
    extra = spark.createDataFrame([(0, [1.0], 3), (1, [2.0], 4)], "vec_id long, embedding array<float>, v int")
    table = annforest.usable(extra)
    assert [x.vec_id for x in annforest.nearest(table.where("vec_id = 0"), table).collect()] == [1]
