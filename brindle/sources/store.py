"""Catalogue and index tables as generations of Parquet files below one folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.catalog import upsert


def profiled(name: str, profile: str) -> str:
    """A table's name for an embedding profile: the profile in lower case, with hyphens for all but letters and digits."""
    return f"{name}__{re.sub('[^a-z0-9]+', '-', profile.strip().lower()).strip('-') or 'default'}"


class Store:
    """Named tables. A write makes a new generation and then marks it, so a job that dies leaves the last marked one in force.

    Readers take the marked generation of the highest number; the last ``keep`` stay for readers that have begun.
    One writer a table at a time.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self, name: str) -> list[int]:
        path, fs = self._path(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(x[5:]) for x in found if x.startswith("done-"))

    def read(self, name: str) -> DataFrame | None:
        """The table, or None before its first write."""
        known = self.generations(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{known[-1]}") if known else None

    def read_profiled(self, name: str, profile: str) -> DataFrame | None:
        """The table of an embedding profile, or the one without a profile where there is none."""
        found = self.read(profiled(name, profile))
        return self.read(name) if found is None else found

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as the table's next generation."""
        known = self.generations(name)
        new = known[-1] + 1 if known else 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{new}")  # what a dead job left under this number goes
        mark, fs = self._path(name, f"done-{new}")
        fs.create(mark, True).close()
        for old in known[: 1 - self.keep] if self.keep > 1 else known:
            for part in (f"done-{old}", str(old)):
                path, fs = self._path(name, part)
                fs.delete(path, True)
        return self.read(name)

    def merge(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """The table with ``rows`` in place of those of equal key."""
        old = self.read(name)
        return self.write(name, rows if old is None else upsert(old, rows, key))

    def replace(self, name: str, rows: DataFrame, group: str) -> DataFrame:
        """The table with ``rows`` in place of all rows of the groups that ``rows`` has."""
        old = self.read(name)
        return self.write(name, rows if old is None else old.join(rows.select(group).distinct(), group, "left_anti").unionByName(rows))

    def remove(self, name: str, gone: DataFrame, key: str) -> DataFrame | None:
        old = self.read(name)
        return None if old is None else self.write(name, old.join(gone.select(key).distinct(), key, "left_anti"))

    def count(self, name: str, condition: str = "true") -> int:
        table = self.read(name)
        return 0 if table is None else table.where(F.expr(condition)).count()
