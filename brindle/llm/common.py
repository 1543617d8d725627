"""Helpers that the corpus operators share: shared-folder cuts, Arrow batches, code shipping."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function over texts sees at once; Spark bounds the bytes of the Arrow batches that they are taken from.
BATCH_ROWS = 256
#: Folders written by :func:`cut` and not yet deleted, in order.
_written: list[str] = []


def by_value(name: str) -> None:
    """Ship a module's functions inside the task, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``, or the checkpoint folder already set on the context.
    Only in local mode, where both are unset, a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, executors may be lost.

    The files lie below one folder for each application, ``brindle-<application id>``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/brindle-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(df: DataFrame | None) -> None:
    """Delete what :func:`cut` wrote for ``df``; later reads of it fail."""
    path = getattr(df, "_brindle_path", None)
    if path:
        _delete(df.sparkSession, path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`cut` of what ``make`` returns; whatever was cut on the way there is deleted."""
    start = len(_written)
    out = cut(make())
    for path in _written[start:-1]:
        _delete(out.sparkSession, path)
    return out


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has cut; results that are still lazy can no longer be read."""
    for path in list(_written):
        _delete(spark, path)


def in_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` in pieces small enough for long texts; no setting of the session is changed."""

    def pieces(batches):
        return fn(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(pieces, schema)


def clear_of(df: DataFrame, *names: str) -> list[str]:
    """``names`` as column names that ``df`` does not have, whatever it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def record_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hex64(column):
    """A long's unsigned value as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
