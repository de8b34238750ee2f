"""Reading inputs and moving Arrow batches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.scale import freeze, shared_dir

__all__ = ["bounded_batches", "drop", "freeze", "in_batches", "read", "remainder", "remainder_of", "rows_of", "store"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let a Python worker get 1000 rows and 8 MB at a time: Spark's 10000 and 64 MB are held on both sides of the pipe,
    and a row can be a whole document or all its shingles. A longer row is a batch of its own.

    Settings of the session, read when a query runs; for applications, not called by the operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``freeze`` that also tells the table's path, for ``drop`` once every table made from it is written."""
    path = f"{shared_dir(df.sparkSession)}/sigspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``store`` wrote."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the decimal id modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def remainder_of(value: int | None, divisor: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


def in_batches(df: DataFrame, step, schema: str) -> DataFrame:
    """Apply ``step(iterator of record batches) -> iterator of dicts of columns`` to each partition.

    The dicts are cut to the fields of ``schema``, in its order.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    target = pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in step(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in
                 ((columns[f.name], f.type) for f in target)], schema=target)
        # idle workers live on: give back what this task took
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, fields)


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def rows_of(batch: pa.RecordBatch, size: int, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into row ranges of at most ``size`` rows and about ``limit`` bytes of text (one row at least)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and (total + n > limit or i - first >= size):
            yield first, i
            first, total = i, 0
        total += n
    if lengths:
        yield first, len(lengths)
