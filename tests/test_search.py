import numpy as np
import pytest

from brindle.operators import retrieval
from brindle.plans import search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 8))
    v[100:160], v[200] = v[0], 0  # many equal scores, and a vector without length
    return v, spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def nearest(v, k):
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, where=n > 0, out=np.zeros_like(v))
    s = np.round(u @ u.T, 6)
    return {(i * 3, j * 3): (r, s[i, j]) for i in range(len(v)) for r, j in enumerate(sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:k], 1)}


@pytest.mark.parametrize("block, most", [(1024, 32_768), (64, 32_768), (16, 50)])
def test_dense_topk_in_one_block_in_several_and_in_rounds(spark, points, block, most):
    v, df = points
    found = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in retrieval.dense_topk(df, df, 5, query_id="vec_id", block=block, most=most).collect()}
    wanted = nearest(v, 5)
    assert {p: r for p, (r, _) in found.items()} == {p: r for p, (r, _) in wanted.items()} and all(abs(found[p][1] - wanted[p][1]) < 1e-9 for p in wanted)


@pytest.mark.parametrize("boosts", [None, {"a": 1.0, "b": 7.0}])
def test_bm25_in_whole_documents_equals_bm25_by_joins(spark, boosts, monkeypatch):
    words = "uno dos tres cuatro cinco seis siete ocho".split()
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(words, n))
    docs = spark.createDataFrame([(i, text(rng.integers(0, 12)) if i % 9 else None, text(2)) for i in range(200)] + [(1_000 + i, "dos tres", "uno") for i in range(50)], "id long, a string, b string")
    asked = spark.createDataFrame([("p", "uno dos"), ("q", "Tres tres NUEVE"), ("r", None), ("s", "nada"), ("t", " ".join(words))], "q string, said string")
    found = retrieval.bm25_top(docs, asked, "id", ["a", "b"], "q", "said", 6, boosts)
    wanted = retrieval.top(retrieval.bm25(docs, asked, "id", ["a", "b"], "q", "said", boosts), "q", "score", "id", 6)
    got = sorted(map(tuple, found.select("q", "id", "score", "rank").collect()))
    assert got and got == sorted(map(tuple, wanted.select("q", "id", "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "bm25", None)  # pairs are not scored by joins
    monkeypatch.setattr(retrieval, "CELLS", 10)
    assert sorted(map(tuple, retrieval.bm25_top(docs, asked, "id", ["a", "b"], "q", "said", 6, boosts).select("q", "id", "score", "rank").collect())) == got
    assert retrieval.bm25_top(docs, asked.where("false"), "id", ["a"], "q", "said", 6).count() == retrieval.bm25_top(docs.where("false"), asked, "id", ["a"], "q", "said", 6).count() == 0


def test_texts_are_not_shuffled_for_a_few_questions(spark):
    sf, kept = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spark.createDataFrame([(0, 1, 1)], "item_id long, doc_id long, rank int")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (search._with_texts(hits, spark, sf), search._relevant(spark, sf))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin [doc_id" not in plans[0] and plans[1].count("SortMergeJoin") == 1  # terms with their counts
