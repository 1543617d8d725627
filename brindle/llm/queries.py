"""The queries op1 to op10 and the pipeline, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import annforest, langid, licenses, linededup, mixing, packing, pii, simhash, substring, winnow
from brindle.llm.common import documents


#: The mixing tree: four domains by source number, languages, and sources of equal weight.
DOMAINS = ("web", "books", "code", "reference")
WEIGHTS = {"domain": {"web": 40, "books": 30, "code": 10, "reference": 20}, "lang": {"en": 50, "fr": 20, "de": 20, "es": 10}}
DOMAIN_SQL = "coalesce(CASE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 " + "".join(f"WHEN {i} THEN '{d}' " for i, d in enumerate(DOMAINS)) + "END, '')"


def domain_of() -> Column:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 4
    return F.coalesce(*[F.when(number == i, d) for i, d in enumerate(DOMAINS)])


def op1_mixing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(documents(spark, sf_dir), domain_of(), WEIGHTS).withColumn("epoch", F.col("epoch").cast("long")).drop("k")


def op2_langid_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = annforest.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return annforest.nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_substring_countmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir), with_text=False)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(documents(spark, sf_dir))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def tokenizer_files() -> dict[str, str]:
    """The public vocabulary that the packing query counts with, and the same vocabulary as ranks."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), **tokenizer_files())


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(documents(spark, sf_dir), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing_budget, op2_langid_kneser_ney, op3_simhash_vptree, op4_ann_forest, op5_line_dedup, op6_substring_countmin, op7_winnowing, op8_license_rules, op9_packing, op10_pii_disclosure)}
ORACLE_SQL: dict[str, str] = {"op1_mixing_budget": mixing.oracle_sql(DOMAIN_SQL, WEIGHTS), "op5_line_dedup": linededup.ORACLE_SQL, "op6_substring_countmin": substring.ORACLE_SQL}
