"""Retrieval metrics over ranked hits, per case and rolled up by suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import compress, fold


def case_metrics(cases: DataFrame, hits: DataFrame, relevant: DataFrame, case_id: str = "case_id", key: str = "doc_id", ks: tuple[int, ...] = (1, 3, 5), precision_at: int = 3) -> DataFrame:
    """One row a case: ``hit_k`` (any target) and ``all_k`` (every target) for each k, ``rr``, ``precision``, ``n_targets``, ``n_hits``.

    ``hits(case, key, rank)``, ``relevant(case, key)``. A case without targets scores 0 everywhere.
    """
    wanted = relevant.select(case_id, key).distinct()
    marked = hits.select(case_id, key, "rank").join(wanted.withColumn("__good", F.lit(1)), [case_id, key], "left")
    good = F.col("__good") == 1
    per = marked.groupBy(case_id).agg(
        F.min(F.when(good, F.col("rank"))).alias("__first"), F.count("*").alias("n_hits"),
        F.count_if(good & (F.col("rank") <= precision_at)).alias("__good_top"), F.count_if(F.col("rank") <= precision_at).alias("__top"),
        *[F.count_if(good & (F.col("rank") <= k)).alias(f"__in_{k}") for k in ks],
    )
    sizes = wanted.groupBy(case_id).agg(F.count("*").alias("n_targets"))
    rows = cases.select(case_id).distinct().join(per, case_id, "left").join(sizes, case_id, "left").fillna(0, ["n_hits", "n_targets", "__good_top", "__top", *[f"__in_{k}" for k in ks]])
    return rows.select(
        case_id, "n_targets", "n_hits",
        *[(F.col(f"__in_{k}") > 0).alias(f"hit_{k}") for k in ks],
        *[((F.col("n_targets") > 0) & (F.col(f"__in_{k}") == F.col("n_targets"))).alias(f"all_{k}") for k in ks],
        F.coalesce(1.0 / F.col("__first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("__top") > 0, F.col("__good_top") / F.col("__top")).otherwise(0.0).alias("precision"),
    )


def rollup(cases: DataFrame, suite: str, metrics: dict[str, Column], digits: int = 3) -> DataFrame:
    """Averages of ``metrics`` for each suite and, with a null suite, over all cases; ``cases`` counts them."""
    rows = cases.select(F.col(suite).alias("suite"), *[m.cast("double").alias(n) for n, m in metrics.items()])
    each = [F.round(F.avg(n), digits).alias(n) for n in metrics]
    return rows.groupBy("suite").agg(F.count("*").alias("cases"), *each).unionByName(rows.agg(F.count("*").alias("cases"), *each).withColumn("suite", F.lit(None).cast("string")))


def contains_all(text: Column, needles: Column) -> Column:
    """Whether every needle is in the text, accents and case aside; true without needles."""
    hay = fold(text)
    return F.forall(F.coalesce(needles, F.array().cast("array<string>")), lambda n: F.contains(hay, fold(n)))


def contains_any(text: Column, needles: Column) -> Column:
    """Whether some needle is in the text, accents and case aside; true without needles."""
    hay, some = fold(text), F.coalesce(needles, F.array().cast("array<string>"))
    return (F.size(some) == 0) | F.exists(some, lambda n: F.contains(hay, fold(n)))


def resolve_targets(selectors: DataFrame, versions: DataFrame, case_id: str = "case_id") -> DataFrame:
    """``(case_id, version_id, ambiguous)``: for each selector the newest active version that meets all its non-null fields.

    ``selectors(case_id, selector, version_id, document_id, storage_uri_contains, document_class, document_family)``.
    """
    from pyspark.sql import Window

    v = versions.where("version_status = 'active'").select(*[F.col(c).alias(f"v_{c}") for c in ("version_id", "document_id", "storage_uri", "document_class", "document_family", "created_at")])
    same = lambda name: F.col(name).isNull() | (F.col(name) == F.col(f"v_{name}"))
    fits = F.col("storage_uri_contains").isNull() | F.contains(F.lower("v_storage_uri"), F.lower("storage_uri_contains"))
    pairs = v.join(F.broadcast(selectors), same("version_id") & same("document_id") & same("document_class") & same("document_family") & fits)  # selectors are hand-written
    own = Window.partitionBy(case_id, "selector")
    ranked = pairs.withColumns({"__r": F.row_number().over(own.orderBy(F.col("v_created_at").desc(), "v_version_id")), "ambiguous": F.count("*").over(own) > 1})
    return ranked.where("__r = 1").select(case_id, F.col("v_version_id").alias("version_id"), "ambiguous")


def verdict(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Adds ``passed``, true if all conditions hold, and ``failed``, the names of those that don't."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return rows.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def filter_cases(cases: DataFrame, suites: list[str] | None = None, ids: list[str] | None = None, suite: str = "suite_id", case_id: str = "case_id") -> DataFrame:
    """The cases of some suites, and of those the ones of some ids; None for all."""
    for column, wanted in ((suite, suites), (case_id, ids)):
        cases = cases.where(F.col(column).isin(*wanted)) if wanted else cases
    return cases


def previews(hits: DataFrame, query_id: str, rank: str, text: str, most: int = 5, limit: int = 220) -> DataFrame:
    """The first hits of each case with their text shortened as ``preview``."""
    return hits.where(F.col(rank) <= most).withColumn("preview", compress(F.coalesce(text, F.lit("")), limit)).select(query_id, rank, *[c for c in hits.columns if c not in (query_id, rank, text)], "preview")


def traced(trace: Column, name: str) -> Column:
    """What a trace of ``name=value`` entries tells of a name, by its first entry; null if nothing."""
    entry = F.get(F.filter(trace, lambda x: x.startswith(f"{name}=")), F.lit(0))
    value = F.trim(F.substring(entry, F.lit(len(name) + 2), F.length(entry)))
    return F.when(value != "", value)
