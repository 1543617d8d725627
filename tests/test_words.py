"""Words cut from bytes are the words that Spark's expressions give."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import embedding
from brindle.functions import text as T
from brindle.functions import words
from brindle.operators import retrieval

ODD = ["", None, "a", "é", "é", "́", "́a", "ấb", " x ", "—", "a—b", "ΑΣ ΟΔΟΣ", "İstanbul", "\U0001d400b \U0001f600", "à", "ß_1 ½²", "퟿", "ÅÅNGSTRÖM ﬁ Ǆ"]


@pytest.mark.parametrize("letters, old", [(None, lambda c: F.regexp_extract_all(F.lower(c), F.lit(T.TOKEN))), (words.LETTERS, T.tokens)])
def test_words_equal_those_of_expressions(spark, letters, old):
    dice = random.Random(5)
    pool = [chr(c) for c in [*range(0x20, 0x600), *range(0x300, 0x370), *range(0x1E00, 0x2100), *range(0x1D400, 0x1D440)]] + [" ", "a", "É"] * 200
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ["".join(dice.choices(pool, k=dice.randrange(40))) for _ in range(2_000)])], "id int, text string")
    told = rows.select("id", words.lowered("text").alias("low"), old(F.coalesce("text", F.lit(""))).alias("wanted")).orderBy("id").toArrow().combine_chunks()
    kinds = words.alphabet(spark)
    for first, n in ((0, told.num_rows), (3, 9), (500, 512), (5, 0)):  # slices too
        low, wanted = (told.column(c).combine_chunks().slice(first, n) for c in ("low", "wanted"))
        assert words.cut(low, kinds, letters).to_pylist() == wanted.to_pylist() == words.cut(low.cast(pa.large_string()), kinds, letters).to_pylist()


def test_digests_do_not_depend_on_what_a_worker_knows(monkeypatch):
    monkeypatch.setattr(embedding, "_known", [])
    lists = pa.array([["a", "b", "a"], [], ["c", "é"], ["b"]])
    fresh = embedding._fold(lists, 16)[0]
    for most in (0, 3, 100):
        monkeypatch.setattr(embedding, "MOST_KNOWN", most)
        for _ in range(3):
            assert (embedding._fold(lists, 16)[0] == fresh).all() and (embedding._fold(lists.slice(2, 2), 16)[0] == fresh[2:]).all()
        assert not embedding._known or len(embedding._known[0][0]) <= max(4, most)


def test_texts_and_not_tokens_go_to_the_workers(spark):
    docs = spark.createDataFrame([(1, "Él vive")], "id long, text string")
    asked = spark.createDataFrame([("q", "el")], "q string, said string")
    for df in (embedding.vectors(docs, "id", "text"), retrieval.bm25_top(docs, asked, "id", ["text"], "q", "said", 3)):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 1
