"""Commands over the catalogue tables ``documents``, ``versions`` and ``chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = "active"


def list_versions(versions: DataFrame, documents: DataFrame, limit: int = 50, status: str | None = None, document_class: str | None = None, q: str | None = None) -> DataFrame:
    """Versions with their document, newest first, filtered; ``limit`` is kept within 1 and 500."""
    latest = documents.select("document_id", F.col("latest_version_id").alias("__latest"))
    rows = versions.join(latest, "document_id").withColumn("latest_for_document", F.coalesce(F.col("version_id") == F.col("__latest"), F.lit(False))).drop("__latest")
    if status:
        rows = rows.where(F.col("version_status") == status)
    if document_class:
        rows = rows.where(F.col("document_class") == document_class)
    if q and q.strip():
        term = F.lower(F.lit(q.strip()))
        rows = rows.where(F.contains(F.lower("storage_uri"), term) | F.contains(F.lower("version_id"), term) | F.contains(F.lower("document_id"), term))
    return rows.orderBy(F.col("created_at").desc(), "version_id").limit(max(1, min(limit, 500)))


def review_queue(versions: DataFrame) -> DataFrame:
    """Versions that wait for a person, newest first."""
    return versions.where("review_required").orderBy(F.col("created_at").desc(), "version_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """``(document_id, latest_version_id)``: the newest active version of each document, null without one."""
    newest = F.max(F.when(F.col("version_status") == ACTIVE, F.struct("created_at", "version_id")))
    return versions.groupBy("document_id").agg(newest.getField("version_id").alias("latest_version_id"))


def update_status(versions: DataFrame, documents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after ``changes(version_id, version_status)``: statuses replaced, latest versions repaired."""
    new = changes.select("version_id", F.col("version_status").alias("__status"))
    after = versions.join(new, "version_id", "left").withColumn("version_status", F.coalesce("__status", "version_status")).select(versions.columns)
    repaired = documents.drop("latest_version_id").join(latest_versions(after), "document_id", "left").select(documents.columns)
    return after, repaired


def delete_versions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``gone(version_id)``; documents without versions go, the others are re-pointed.

    ``tables`` has ``versions`` and ``documents`` and any others that carry a version_id.
    """
    out = {name: t.join(gone, "version_id", "left_anti") for name, t in tables.items() if name != "documents"}
    left = latest_versions(out["versions"])
    out["documents"] = tables["documents"].drop("latest_version_id").join(left, "document_id").select(tables["documents"].columns)
    return out


def list_chunks(chunks: DataFrame, version_id: str) -> DataFrame:
    return chunks.where(F.col("version_id") == version_id).orderBy("chunk_order")


def reindex_targets(chunks: DataFrame, versions: DataFrame, profile: str, document_class: str | None = None, limit: int = 100, force: bool = False, version_ids: list[str] | None = None) -> DataFrame:
    """Versions to index again, with ``position``: those given, in their order, or the newest that have a chunk not indexed for ``profile``."""
    rows = versions if document_class is None else versions.where(F.col("document_class") == document_class)
    if version_ids:
        spark = versions.sparkSession
        wanted = spark.createDataFrame(list(enumerate(dict.fromkeys(version_ids), 1)), "position int, version_id string")
        return rows.join(F.broadcast(wanted), "version_id")  # the caller's own list
    stale = chunks if force else chunks.where("index_status <> 'indexed' OR indexed_profile IS NULL").unionByName(chunks.where(F.col("indexed_profile") != profile))
    found = rows.join(stale.select("version_id").distinct(), "version_id", "left_semi").orderBy(F.col("created_at").desc(), "version_id").limit(max(1, limit))
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.col("created_at").desc(), "version_id")))  # at most ``limit`` rows


def upsert(table: DataFrame, rows: DataFrame, key: str, width: int | None = None, vector: str = "vector") -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key; a vector of another width than ``width`` fails the job."""
    if width is not None:
        rows = rows.withColumn(vector, F.when(F.size(vector) == width, F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors must have {width} components")).cast(rows.schema[vector].dataType)))
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def visible(rows: DataFrame, groups: list[str], users: list[str]) -> DataFrame:
    """Optional access filter: rows open to all, or shared with one of the groups or users."""
    mine = lambda column, names: F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    everyone = (F.coalesce(F.size("acl_groups"), F.lit(0)) <= 0) & (F.coalesce(F.size("acl_users"), F.lit(0)) <= 0)
    return rows.where(everyone | mine(F.col("acl_groups"), groups) | mine(F.col("acl_users"), users))
