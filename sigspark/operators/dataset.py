"""Labelled feature sets: ``row_id``, ``features`` (array), ``label`` and the keys they came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.blocks import collect_in_order
from sigspark.operators.scale import dense_ranks, hash_cell, hash_digits, rank_by_hash, small_side
from sigspark.operators.signal import series_keys


def make_dataset(series: DataFrame) -> DataFrame:
    """One row per series with its values in order. Series should be shrunk first: a row holds the whole vector."""
    keys = series_keys(series)
    rows = collect_in_order(series, keys, ["value"])
    row_id = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return rows.select(row_id.alias("row_id"), *keys, F.col("values").alias("features"))


def features_of(dataset: DataFrame) -> DataFrame:
    """The rows without their label."""
    return dataset.drop("label")


def filter_labels(dataset: DataFrame, labels: Sequence[object], on: str = "label") -> DataFrame:
    """Keep rows whose label, as text, is listed."""
    return dataset.where(F.col(on).cast("string").isin([str(v) for v in labels]))


def rename_labels(dataset: DataFrame, mapping: Mapping[str, str], on: str = "label") -> DataFrame:
    """Replace labels by the mapping, compared as text; others stay."""
    if not mapping:
        return dataset
    pairs = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    text = F.col(on).cast("string")
    return dataset.withColumn(on, F.coalesce(pairs[text], text))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both sets, duplicates kept. The columns must be the same, in the same order."""
    if first.columns != second.columns:
        raise ValueError("the two datasets must have the same columns in the same order")
    return first.union(second)


def describe_dataset(dataset: DataFrame) -> DataFrame:
    """Row count and number of columns of the wide form (features plus label)."""
    width = F.max(F.size("features")) if "features" in dataset.columns else F.lit(len(dataset.columns) - 1)
    return dataset.agg(F.count(F.lit(1)).alias("n_rows"), (width + 1).cast("long").alias("n_columns"))


def distinct_values(dataset: DataFrame, column: str, limit: int = 50, proceed: bool = False) -> DataFrame:
    """Distinct values of a column; stops when there are more than ``limit`` unless ``proceed``."""
    values = dataset.select(column).distinct()
    if proceed:
        return values
    if values.limit(limit + 1).count() > limit:
        raise ValueError(f"column {column} has more than {limit} distinct values; pass proceed=True to list them")
    return values


def encode_labels(dataset: DataFrame, on: str = "label", code: str = "label_code") -> DataFrame:
    """Number the labels 0.. in alphabetical order. One row per label is ranked, then joined back."""
    return dataset.join(dense_ranks(dataset, on, code), on, "left")


def shuffle_hash(row_id: str, seed: object) -> Column:
    """Repeatable pseudo-random order key of a row."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(str(seed))))


def _split_marks(dataset: DataFrame, ratio: float, seed: object, row_id: str, on: str) -> DataFrame:
    """Per label, the last (hash, row id) that still belongs to the train side, and how many rows of it do.

    Hash cells are counted per label; only the rows of the one cell that holds the boundary are ranked.
    """
    rows = dataset.select(F.col(on).alias("_label"), F.col(row_id).alias("_id"), shuffle_hash(row_id, seed).alias("_h"))
    rows = rows.withColumn("_cell", hash_cell(F.col("_h"), hash_digits(rows)))
    counts = rows.groupBy("_label", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    label = Window.partitionBy("_label")
    running = label.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("_through", F.sum("_rows").over(running))
        .withColumn("_take", F.floor(F.lit(float(ratio)) * F.sum("_rows").over(label)))
        .where((F.col("_take") <= F.col("_through")) & (F.col("_take") > F.col("_through") - F.col("_rows")))
        .select("_label", "_cell", (F.col("_take") - F.col("_through") + F.col("_rows")).alias("_left"))
    )
    inside = rows.join(small_side(placed), ["_label", "_cell"])
    order = label.orderBy("_h", "_id")
    ranked = inside.withColumn("_rank", F.row_number().over(order)).withColumn("_first", F.rank().over(order))
    marks = ranked.where(F.col("_rank") == F.col("_left"))
    ties = (F.col("_left") - F.col("_first") + 1).alias("_ties")
    return small_side(marks.select("_label", F.struct("_h", "_id").alias("_mark"), ties))


def split(
    dataset: DataFrame, ratio: float = 0.7, seed: object = 0, row_id: str = "row_id", on: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: exactly floor(ratio * n) of every label train, chosen by a seeded hash of the row id.

    The rows themselves are not shuffled: each is compared with its label's boundary, a table of one row per label.
    Only rows that share the boundary's id are ordered among themselves, by their content. Rows without a label are test.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    marks = _split_marks(dataset, ratio, seed, row_id, on)
    here = F.struct(shuffle_hash(row_id, seed).alias("_h"), F.col(row_id).alias("_id"))
    joined = dataset.join(marks.withColumnRenamed("_label", on), on, "left")
    train = F.coalesce(here < F.col("_mark"), F.lit(False))
    at_mark = F.coalesce(here == F.col("_mark"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(on).orderBy(F.xxhash64(*dataset.columns)))
    tied = joined.where(at_mark).withColumn("_place", place)
    names = dataset.columns
    return (
        joined.where(train).select(*names).union(tied.where(F.col("_place") <= F.col("_ties")).select(*names)),
        joined.where(~train & ~at_mark).select(*names).union(tied.where(F.col("_place") > F.col("_ties")).select(*names)),
    )


def assign_folds(dataset: DataFrame, k: int, seed: object = 0, row_id: str = "row_id", on: str = "label") -> DataFrame:
    """Add ``fold`` 0..k-1, dealt out evenly within every label in hash order; rows without a label are a label's."""
    hashed = dataset.withColumn("_h", shuffle_hash(row_id, seed))
    ranked = rank_by_hash(hashed, [on], "_h", row_id, "_place")
    return ranked.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_h", "_place")


def profile(dataset: DataFrame, on: str = "label") -> DataFrame:
    """Mean, sample standard deviation and mean +- deviation of every feature position, per label."""
    values = dataset.select(F.col(on).cast("string").alias("label"), F.posexplode("features").alias("pos", "value"))
    stats = values.groupBy("label", "pos").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return stats.withColumn("lower", F.col("mean") - F.col("std")).withColumn("upper", F.col("mean") + F.col("std"))


def profile_range(profiles: DataFrame) -> DataFrame:
    """Lowest and highest edge over all labels, never short of zero."""
    return profiles.agg(
        F.least(F.lit(0.0), F.min("lower")).alias("ymin"), F.greatest(F.lit(0.0), F.max("upper")).alias("ymax")
    )
