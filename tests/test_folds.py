"""Folds over rows go by slices: what they give does not depend on how many rows a batch has."""

import pyarrow as pa
import pytest

from brindle.functions import embedding
from brindle.operators import enrich
from brindle.sources import extract

TEXTS = [(0, "Casa casa perro 1234 PERRO gato entre"), (1, None), (2, ""), (3, "beta beta alfa alfa gamma zz"), (4, "uno dos tres")]
DOCS = [(i * 10 + k, t) for i in range(30) for k, t in TEXTS]


def test_focus_terms_are_counted_inside_the_row(spark, monkeypatch):
    monkeypatch.setattr(enrich, "ROWS", 7)
    df = enrich.focus_terms(spark.createDataFrame(DOCS, "id long, text string").coalesce(1), "id", ["text"], most=2)
    assert "Exchange hash" not in df._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r["rank"])):
        found.setdefault(r.id, []).append((r.term, r.n, r["rank"]))
    wanted = {0: [("casa", 2, 1), ("perro", 2, 2)], 3: [("beta", 2, 1), ("alfa", 2, 2)], 4: [("tres", 1, 1)]}
    assert found == {i * 10 + k: v for i in range(30) for k, v in wanted.items()}


def fold(monkeypatch, frame, of):
    """The function that a mapInArrow is given."""
    taken = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema, *a: taken.append(f) or self)
    of(frame)
    return taken[0]


def test_blocks_of_a_bounded_number_of_files(spark, monkeypatch):
    run = fold(monkeypatch, spark.createDataFrame([], "version_id string, suffix string, content binary"), extract.extract)
    n = 1_000
    files = pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array(["html"] * n), pa.array([b"<p>a</p><p>b</p>"] * n)], names=["version_id", "suffix", "content"])
    given = [b.num_rows for b in run([files])]
    assert max(given) == 2 * extract.ROWS and sum(given) == 2 * n


@pytest.mark.parametrize("of, rows", [(embedding.components, 1.5), (embedding.vectors, 1)])
def test_embeddings_of_a_bounded_number_of_texts(spark, monkeypatch, of, rows):
    run = fold(monkeypatch, spark.createDataFrame([], "id long, text string"), lambda df: of(df, "id", "text"))
    n = 3_000
    tokens = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([["a", "b", "a"], []] * (n // 2))], names=["id", "tokens"])
    given = [b.num_rows for b in run([tokens])]
    assert max(given) == embedding.ROWS * rows and sum(given) == n * rows
