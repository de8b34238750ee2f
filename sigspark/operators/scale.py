"""Helpers that keep one hot key from landing in one task.

A window over ``partitionBy(key)`` sorts all rows of a key in a single task. The helpers here split each key into
*cells* - consecutive ranges of the ordering value, sized from the key's own row count - so the sort runs per
(key, cell), and only one summary row per cell is ordered per key.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows one (key, cell) window may hold on average before a key is split into more cells.
ROWS_PER_CELL = 1_000_000
# A cell this many times too large means the cells do not fit the values.
_LOPSIDED = 8
# A frozen summary table is broadcast only up to this many rows and bytes on disk; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="sigspark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor cannot make two uses of ``df`` disagree, and gives the planner real sizes.
    """
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/sigspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _bytes(spark: SparkSession, path: str) -> int:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def small_side(df: DataFrame) -> DataFrame:
    """Freeze a narrow per-key summary; mark it for broadcast only if its counted rows and bytes are within the limits."""
    return small_side_and_max(df)[0]


def small_side_and_max(df: DataFrame, column: str | None = None) -> tuple[DataFrame, int]:
    """The same, with the largest value of a count column (0 if there are no rows)."""
    frozen, path = _stored(df)
    largest = F.lit(0) if column is None else F.coalesce(F.max(column), F.lit(0))
    rows, top = frozen.agg(F.count(F.lit(1)), largest).first()
    small = rows <= BROADCAST_ROWS and _bytes(df.sparkSession, path) <= BROADCAST_BYTES
    return (F.broadcast(frozen) if small else frozen), top


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null key meets a null key, so no row is lost."""
    other = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, name in other.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(other), same).drop(*other.values())


def _offsets(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*keys, "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def with_cells(
    df: DataFrame, keys: Sequence[str], lead: Column, total: str = "n", rows_per_cell: int | None = None
) -> tuple[DataFrame, bool]:
    """Add the key's row count and ``_cell``; also tell whether every key fits one cell.

    Keys larger than ``rows_per_cell`` are cut into equal-width ranges of ``lead``, which must be numeric. Rows whose
    ``lead`` is null have the first cell to themselves, those with NaN the last, as a sort puts them. A null key is a key.
    """
    limit = ROWS_PER_CELL if rows_per_cell is None else rows_per_cell
    x = lead.cast("double")
    known = F.when(~F.isnan(x), x)
    summary = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    stats, longest = small_side_and_max(summary, total)
    joined = join_keys(df, stats, keys)
    if longest <= limit:
        return joined.withColumn("_cell", F.lit(0).cast("long")).drop("_lo", "_hi"), True
    share = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    cells = F.ceil(F.col(total) / limit)
    inside = F.when(F.col("_hi") > F.col("_lo"), F.floor(share * cells)).otherwise(0)
    cell = F.when(x.isNull(), -1).when(F.isnan(x), cells + 1).otherwise(inside)
    return joined.withColumn("_cell", cell.cast("long")).drop("_lo", "_hi"), False


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str = "idx",
    total: str = "n",
    rows_per_cell: int | None = None,
) -> DataFrame:
    """Number the rows of every key 0..n-1 by ``order`` and add the key's row count.

    ``order[0]`` must be numeric; the rest break ties. A key holding most of the data is sorted by many tasks.
    """
    limit = ROWS_PER_CELL if rows_per_cell is None else rows_per_cell
    celled, single = with_cells(df, keys, F.col(order[0]), total, limit)
    if single:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return celled.withColumn(position, rank.cast("long") - 1).drop("_cell")
    celled, sizes = evened(celled, keys, order, limit)
    return _shift(celled, sizes, keys, order, position)


def evened(celled: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with cells that hold about ``limit`` of them, and the cells' sizes.

    Where equal widths do not fit the values (an outlier, or many ties), cells become sampled ranges of the whole order.
    """
    sizes, largest = small_side_and_max(_cell_sizes(celled, keys), "_rows")
    if largest > _LOPSIDED * limit:
        ranges = math.ceil(sizes.agg(F.sum("_rows")).first()[0] / limit)
        ranged = celled.repartitionByRange(ranges, *keys, *order)
        celled = freeze(ranged.withColumn("_cell", F.spark_partition_id().cast("long")))
        sizes = small_side(_cell_sizes(celled, keys))
    return celled, sizes


def _cell_sizes(celled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))


def _shift(celled: DataFrame, sizes: DataFrame, keys: Sequence[str], order: Sequence[str], position: str) -> DataFrame:
    """Rank rows within their cell and add the sizes of the key's cells before it."""
    group = [*keys, "_cell"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long") - 1
    return (
        join_keys(celled.withColumn("_rank", rank), _offsets(sizes, keys), group)
        .withColumn(position, F.col("_before") + F.col("_rank"))
        .drop("_cell", "_rank", "_before")
    )


def rank_by_hash(df: DataFrame, keys: Sequence[str], hashed: str, tie: str, position: str) -> DataFrame:
    """0-based rank within ``keys`` by a hex digest column; the digest's first digits are the cells."""
    celled = df.withColumn("_cell", hash_cell(F.col(hashed), hash_digits(df)))
    return _shift(celled, small_side(_cell_sizes(celled, keys)), keys, [hashed, tie], position)


def hash_digits(df: DataFrame) -> int:
    """Leading hex digits that leave about a tenth of a full cell per hash cell, if one key held all rows."""
    return min(max(math.ceil(math.log(max(df.count(), 1) / (ROWS_PER_CELL / 10), 16)), 1), 8)


def hash_cell(hashed: Column, digits: int) -> Column:
    """Cell of a hex digest: its first digits, so order by cell agrees with order by digest."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("long")


def dense_ranks(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Distinct values of ``column`` with their 0-based place in sorted order.

    Values are range-partitioned and frozen; each range is ranked on its own and shifted by the sizes of the ranges
    before it (one row per range).
    """
    ranged = freeze(
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(column)
        .withColumn("_cell", F.spark_partition_id().cast("long"))
    )
    sizes = F.broadcast(_cell_sizes(ranged, []))  # one row per shuffle partition
    return small_side(_shift(ranged, sizes, [], [column], rank).select(column, rank))
