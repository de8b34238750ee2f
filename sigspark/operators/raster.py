"""Queries on the spike table: raster, nearest spike, neighbours, waveforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.scale import dense_ranks, evened, join_keys, ROWS_PER_CELL, small_side, with_cells

NUMERIC_COLOURS = ("peak_value", "min_value", "max_value", "slope", "extrema_ratio")
_CELL = ["column_id", "_cell"]


def filter_spikes(spikes: DataFrame, by: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """Keep spikes whose ``file`` or ``target`` is listed; no column given keeps all."""
    if by is None:
        return spikes
    if by not in ("file", "target"):
        raise ValueError("spikes are filtered by 'file' or 'target'")
    return spikes.where(F.col(by).isin(list(values)))


def channel_rows(spikes: DataFrame) -> DataFrame:
    """Raster row of every channel: its place among the sorted channel names."""
    return dense_ranks(spikes, "column_id", "y")


def raster(
    spikes: DataFrame, color_by: str | None = None, by: str | None = None, values: Sequence[str] = ()
) -> DataFrame:
    """One mark per spike: ``x`` = peak index, ``y`` = channel row, and a colour.

    Rows are numbered over all spikes, colours scaled over the filtered ones. A numeric colour is min-max scaled into
    ``color_value``, an uncomputable slope counting as 1.1 times the largest; ``file`` or ``target`` gives the class
    number ``color_class`` and its ``legend`` text.
    """
    chosen = filter_spikes(spikes, by, values)
    marks = chosen.join(channel_rows(spikes), "column_id").withColumn("x", F.col("peak_idx"))
    if color_by is None:
        return marks
    if color_by in ("file", "target"):
        classes = dense_ranks(chosen, color_by, "color_class")
        text = F.col(color_by)
        if color_by == "file":
            text = F.when(F.length(text) > 30, F.right(F.element_at(F.split(text, "/"), -1), F.lit(30))).otherwise(text)
        return marks.join(classes, color_by).withColumn("legend", text)
    if color_by not in NUMERIC_COLOURS:
        raise ValueError(f"color_by must be file, target or one of {NUMERIC_COLOURS}")
    v = F.col(color_by)
    missing = 1.1 * F.max(v) if color_by == "slope" else F.lit(None).cast("double")
    stand_in = F.when(F.max(v.isNull()), missing)
    limits = chosen.agg(
        F.struct(
            missing.alias("missing"),
            F.least(F.min(v), stand_in).alias("low"),
            F.greatest(F.max(v), stand_in).alias("high"),
        ).alias("limits")
    ).scalar()
    scaled = marks.withColumn("_limits", limits).withColumn("color_raw", F.coalesce(v, F.col("_limits.missing")))
    span = F.col("_limits.high") - F.col("_limits.low")
    value = F.when(span > 0, (F.col("color_raw") - F.col("_limits.low")) / span).otherwise(F.lit(0.0))
    return scaled.withColumn("color_value", value).drop("_limits")


def raster_limits(spikes: DataFrame, by: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """Axis limits: number of channels over all spikes, largest recording length among the filtered ones."""
    keep = F.col(by).isin(list(values)) if by else F.lit(True)
    return spikes.agg(
        F.countDistinct("column_id").alias("n_channels"), F.max(F.when(keep, F.col("n_values"))).alias("max_values")
    )


def _beside(rows: DataFrame, site: Column) -> DataFrame:
    """Per (channel, cell): nearest site in the cells before and after, through one summary row per cell."""
    at = F.when(site.isNotNull(), F.col("_pos"))
    cells = rows.groupBy(*_CELL).agg(F.min_by(site, at).alias("_first"), F.max_by(site, at).alias("_last"))
    order = Window.partitionBy("column_id").orderBy("_cell")
    before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return small_side(cells.select(*_CELL, before.alias("_cell_before"), after.alias("_cell_after")))


def nearest_spike(points: DataFrame, spikes: DataFrame, rows_per_cell: int | None = None) -> DataFrame:
    """For points (``column_id``, ``x``): key and peak index of the channel's nearest spike, the earlier on a tie.

    Spikes are reduced to one per position; busy channels are cut into position ranges, and a point looks into its own
    range and at the edges of its neighbours. Points on channels without spikes get nulls.
    """
    sites = spikes.groupBy("column_id", F.col("peak_idx").alias("_pos")).agg(F.min("key").alias("_key"))
    asked = points.select("column_id", F.col("x").cast("long").alias("_pos")).distinct()
    both = sites.select("column_id", "_pos", "_key").unionByName(asked.withColumn("_key", F.lit(None).cast("string")))
    celled, single = with_cells(both, ["column_id"], F.col("_pos"), "_n", rows_per_cell)
    if not single:
        celled, _ = evened(celled, ["column_id"], ["_pos", "_key"], rows_per_cell or ROWS_PER_CELL)

    site = F.when(F.col("_key").isNotNull(), F.struct("_pos", "_key"))
    order = Window.partitionBy(*_CELL).orderBy("_pos", F.col("_key").isNull())
    before = F.last(site, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(site, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = celled.withColumn("_before", before).withColumn("_after", after)
    if not single:
        found = (
            join_keys(found, _beside(celled, site), _CELL)
            .withColumn("_before", F.coalesce("_before", "_cell_before"))
            .withColumn("_after", F.coalesce("_after", "_cell_after"))
        )
    earlier = F.col("_after").isNull() | (
        F.col("_pos") - F.col("_before._pos") <= F.col("_after._pos") - F.col("_pos")
    )
    best = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    answers = found.where(F.col("_key").isNull()).withColumn("_best", best).select(
        "column_id",
        F.col("_pos").alias("x"),
        F.col("_best._key").alias("nearest_key"),
        F.col("_best._pos").alias("nearest_idx"),
    )
    return points.withColumn("x", F.col("x").cast("long")).join(answers, ["column_id", "x"], "left")


def neighbours(spikes: DataFrame, rows_per_cell: int | None = None) -> DataFrame:
    """Each spike's next and previous spike on its channel; at the ends, the spike itself."""
    rows = spikes.select("column_id", "key", F.col("peak_idx").alias("_pos"))
    celled, single = with_cells(rows, ["column_id"], F.col("_pos"), "_n", rows_per_cell)
    if not single:
        celled, _ = evened(celled, ["column_id"], ["_pos", "key"], rows_per_cell or ROWS_PER_CELL)
    site = F.struct(F.col("_pos"), F.col("key").alias("_key"))
    order = Window.partitionBy(*_CELL).orderBy("_pos", "key")
    found = celled.withColumn("_next", F.lead(site).over(order)).withColumn("_prev", F.lag(site).over(order))
    if not single:
        cells = celled.groupBy(*_CELL).agg(F.min(site).alias("_first"), F.max(site).alias("_last"))
        by_cell = Window.partitionBy("column_id").orderBy("_cell")
        edges = cells.select(
            *_CELL, F.lead("_first").over(by_cell).alias("_cell_next"), F.lag("_last").over(by_cell).alias("_cell_prev")
        )
        found = (
            join_keys(found, small_side(edges), _CELL)
            .withColumn("_next", F.coalesce("_next", "_cell_next"))
            .withColumn("_prev", F.coalesce("_prev", "_cell_prev"))
        )
    return found.select(
        "column_id",
        "key",
        F.col("_pos").alias("peak_idx"),
        F.coalesce("_next._key", "key").alias("next_key"),
        F.coalesce("_next._pos", "_pos").alias("next_idx"),
        F.coalesce("_prev._key", "key").alias("prev_key"),
        F.coalesce("_prev._pos", "_pos").alias("prev_idx"),
    )


def waveforms(spikes: DataFrame, keys: Sequence[str] | DataFrame) -> DataFrame:
    """Samples of the chosen spikes' waveforms, one row each."""
    if isinstance(keys, DataFrame):
        chosen = spikes.join(keys.select("key").distinct(), "key", "left_semi")
    else:
        chosen = spikes.where(F.col("key").isin(list(keys)))
    return chosen.select("key", "target", F.posexplode("extracted").alias("pos", "value"))
