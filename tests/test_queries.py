import pytest
from compare import duck, rows

from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toArrow()) == rows(duck(catalogue.ORACLE_SQL[name], SF))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"text_classifier"}))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).toArrow().num_rows


def test_text_classifier_held_out_accuracy(spark):
    found = catalogue.QUERIES["text_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (found.predicted == found.lang).mean() > 0.75


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() and set(entry.oracle_sql()) <= set(entry.queries())
