"""Branches as search results: fusing their lists, choosing some by score or model, and adding them to a question's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold
from brindle.operators import retrieval

# By strategy, how many branches are found, selected and added as candidates; words of specific labels.
FOUND = {"focal": 12, "multi_branch": 14, "global": 16}
SELECTED = {"focal": 4, "multi_branch": 6, "global": 8}
ADDED = {"focal": 2, "multi_branch": 4, "global": 5}
SPECIFIC = ("art", "seccion", "recomendacion", "anexo", "capitulo", "titulo", "libro", "parrafo")
MODEL_SHARE, SCORE_SHARE = 0.88, 0.12


def limit(strategy: Column, limits: dict[str, int], default: int) -> Column:
    c = F.lit(default)
    for name, n in limits.items():
        c = F.when(strategy == name, n).otherwise(c)
    return c


def fuse(near: DataFrame, sparse: DataFrame, strategies: DataFrame, query_id: str, key: str) -> DataFrame:
    """Ranked lists ``(query_id, variant, key, score, rank)`` of every rewrite merged by modality and fused; as many as ``strategies(query_id, strategy)`` allows."""
    fused = retrieval.rrf(retrieval.merge_lists(near, query_id, key), retrieval.merge_lists(sparse, query_id, key), query_id, key)
    best = retrieval.top(fused, query_id, "rrf", key, max(FOUND.values()))
    kept = best.join(strategies.select(query_id, "strategy"), query_id, "left").where(F.col("rank") <= limit(F.col("strategy"), FOUND, FOUND["focal"]))
    return kept.drop("strategy")


def is_specific(unit_type: Column, unit_number: Column, label: Column, path: Column) -> Column:
    """A branch that is a numbered or typed unit, is named like one, or lies below another."""
    kind, number = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (unit_type, unit_number))
    named = fold(F.coalesce(label, F.lit(""))).rlike("|".join(SPECIFIC))
    return ((kind != "") & ~kind.isin("document", "unknown")) | (number != "") | named | F.coalesce(F.size(path) > 1, F.lit(False))


def select(hits: DataFrame, query_id: str, branch: str, rank: str, score: str, probability: str, strategy: str) -> DataFrame:
    """The branches that a question goes on with, a row each; adds ``branch_rank``.

    A branch counts by its first hit. Where a model gave any of the question's branches a probability, those with one are
    ordered by it and, for a share, by score; else the order of the hits decides.
    """
    once = hits.where(F.col(branch) != "").withColumn("__r", F.row_number().over(Window.partitionBy(query_id, branch).orderBy(rank))).where("__r = 1")
    judged = F.max(F.col(probability).isNotNull()).over(Window.partitionBy(query_id))
    value = MODEL_SHARE * F.col(probability) + SCORE_SHARE * F.greatest(F.lit(0.0), F.coalesce(F.col(score), F.lit(0.0)))
    rows = once.withColumn("__judged", judged).where(~F.col("__judged") | F.col(probability).isNotNull()).withColumn("__v", F.when(F.col("__judged"), value).otherwise(0.0))
    order = Window.partitionBy(query_id).orderBy(F.col("__v").desc(), rank)
    return rows.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= limit(F.col(strategy), SELECTED, SELECTED["focal"])).drop("__r", "__judged", "__v")


def candidates(branch_hits: DataFrame, query_id: str, branch: str, rank: str, strategy: str, specific: str) -> DataFrame:
    """The selected branches that become candidates themselves, each once, the first of a question by strategy; only specific ones unless the strategy is global."""
    fit = branch_hits.where((F.col(branch) != "") & ((F.col(strategy) == "global") | F.col(specific)))
    once = fit.withColumn("__r", F.row_number().over(Window.partitionBy(query_id, branch).orderBy(rank))).where("__r = 1")
    few = once.withColumn("__n", F.row_number().over(Window.partitionBy(query_id).orderBy(rank))).where(F.col("__n") <= limit(F.col(strategy), ADDED, 3))
    return few.drop("__r", "__n")


def add_candidates(hits: DataFrame, added: DataFrame, query_id: str, key: str, score: str) -> DataFrame:
    """Hits and candidates as ``(query_id, key, score)``; of equal keys the higher score stays."""
    both = hits.select(query_id, key, score).unionByName(added.select(query_id, key, score))
    return both.groupBy(query_id, key).agg(F.max(score).alias(score))
