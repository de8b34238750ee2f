"""Operators on long signals.

A signal has one row per sample: ``recording_id``, ``channel``, ``channel_pos``, ``idx`` (0-based place in the
channel), ``n`` (samples in the channel or segment), ``value`` and optionally ``segment_id`` and ``t``. Carrying ``n``
lets segmenting, windowing and resampling run without another pass to count rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.columns import hann_weight
from sigspark.operators.scale import small_side, with_position

CHANNEL_KEYS = ["recording_id", "channel"]


def series_keys(signal: DataFrame) -> list[str]:
    """Columns that identify one series: recording, segment (once cut) and channel (until averaged)."""
    return [c for c in ("recording_id", "segment_id", "channel") if c in signal.columns]


def drop_channels(signal: DataFrame, text: str) -> DataFrame:
    """Drop channels whose name contains ``text`` (case-sensitive). Empty text drops nothing."""
    return signal.where(~F.contains("channel", F.lit(text))) if text else signal


def to_signal(
    wide: DataFrame,
    order: Sequence[str],
    time_like: str = "Time",
    recording: str = "recording_id",
    rows_per_cell: int | None = None,
) -> DataFrame:
    """Turn a wide table (one column per channel) into a long signal.

    Columns whose name contains ``time_like`` are left out of the channels; the first of them becomes ``t``. Rows are
    numbered once per recording, before the channels are unpivoted.
    """
    times = [c for c in wide.columns if time_like and time_like in c]
    channels = [c for c in wide.columns if c != recording and c not in times and c not in order]
    numbered = with_position(wide, [recording], order, rows_per_cell=rows_per_cell)
    ids = [F.col(recording).alias("recording_id"), "idx", "n"]
    ids += [F.col(f"`{times[0]}`").cast("double").alias("t")] if times else []
    samples = F.array(*[
        F.struct(
            F.lit(c).alias("channel"), F.lit(i).cast("long").alias("channel_pos"),
            F.col(f"`{c}`").cast("double").alias("value"),
        )
        for i, c in enumerate(channels)
    ])
    return numbered.select(*ids, F.inline(samples))


def index_signal(df: DataFrame, order: Sequence[str], rows_per_cell: int | None = None) -> DataFrame:
    """Number the samples of an already long table by ``order`` within (recording, channel)."""
    return with_position(df, CHANNEL_KEYS, order, rows_per_cell=rows_per_cell)


def channel_stats(signal: DataFrame) -> DataFrame:
    """Per channel: samples, population standard deviation, largest magnitude."""
    return signal.groupBy(*CHANNEL_KEYS).agg(
        F.min("channel_pos").alias("channel_pos"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop("value").alias("std"),
        F.max(F.abs("value")).alias("max_abs"),
    )


def rank_channels(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` channels with the largest standard deviation per recording; ties go to the earlier column."""
    by_std = Window.partitionBy("recording_id").orderBy(F.col("std").desc(), "channel_pos")
    return stats.withColumn("rank", F.row_number().over(by_std).cast("long")).where(F.col("rank") <= n)


def top_n_channels(signal: DataFrame, n: int, metric: str = "std", stats: DataFrame | None = None) -> DataFrame:
    """Keep the samples of each recording's ``n`` most variable channels.

    The signal is read twice (statistics, then filter) instead of being shuffled: the kept channel list is small and
    broadcast when its counted size allows.
    """
    if metric != "std":
        raise ValueError("the only metric is 'std'")
    if n < 1:
        raise ValueError("n must be positive")
    kept = rank_channels(channel_stats(signal) if stats is None else stats, n).select(*CHANNEL_KEYS)
    return signal.join(small_side(kept), CHANNEL_KEYS, "left_semi")


def segment(signal: DataFrame, n: int) -> DataFrame:
    """Cut every channel into ``n`` equal consecutive pieces; up to n-1 trailing samples are left over and dropped."""
    if n < 1:
        raise ValueError("n must be positive")
    size = F.expr(f"n div {int(n)}")
    return (
        signal.withColumn("_size", size)
        .where(F.col("idx") < F.col("_size") * n)
        .withColumn("segment_id", F.expr("idx div _size"))
        .withColumn("idx", F.expr("idx % _size"))
        .withColumn("n", F.col("_size"))
        .drop("_size")
    )


def channel_mean(signal: DataFrame, digits: int = 3) -> DataFrame:
    """Average all channels sample by sample into one series named ``mean``, rounded half-even.

    Sums differ in their last bits with the order of the rows, so the average is first cut to 9 digits: a tie then
    rounds the same way in every run.
    """
    keys = [c for c in ("recording_id", "segment_id") if c in signal.columns]
    extra = [F.bround(F.min("t"), digits).alias("t")] if "t" in signal.columns else []
    return (
        signal.groupBy(*keys, "idx")
        .agg(F.bround(F.round(F.avg("value"), 9), digits).alias("value"), F.max("n").alias("n"), *extra)
        .withColumn("channel", F.lit("mean"))
        .withColumn("channel_pos", F.lit(0).cast("long"))
    )


def resample(signal: DataFrame, n: int, mode: str = "mean") -> DataFrame:
    """Shrink every series to ``n`` values: ``mean`` of n consecutive bins, or ``linear`` interpolation on a grid.

    Both are one aggregation with map-side combine: a sample knows its bin (or the grid points it feeds, and with
    what weight) from ``idx`` and ``n`` alone.
    """
    if mode not in ("mean", "linear"):
        raise ValueError("mode must be 'mean' or 'linear'")
    if n < (2 if mode == "linear" else 1):
        raise ValueError("too few values to shrink to")
    keys = series_keys(signal)
    checked = signal.withColumn(
        "n",
        F.when(F.col("n") >= n, F.col("n")).otherwise(
            F.raise_error(F.format_string("cannot shrink a series of %s samples to %s", F.col("n"), F.lit(n)))
        ).cast("long"),
    )
    names = [c for c in ("value", "t") if c in signal.columns]
    position = [F.min("channel_pos").alias("channel_pos")] if "channel_pos" in signal.columns else []
    if mode == "mean":
        binned = checked.withColumn("_bin", F.expr(f"(idx * {n}) div n"))
        out = binned.groupBy(*keys, "_bin").agg(*[F.avg(c).alias(c) for c in names], *position)
    else:
        # Grid point k sits at k*(n_in-1)/(n-1). As points are at least one sample apart, a sample is the left
        # neighbour of at most one point and the right neighbour of at most one.
        span, steps = "(n - 1)", n - 1
        left = f"((idx * {steps} + {span} - 1) div {span})"
        right = f"(((idx - 1) * {steps} + {span} - 1) div {span})"
        left_ok = f"{left} * {span} < (idx + 1) * {steps}"
        right_ok = f"idx > 0 and {right} * {span} < idx * {steps} and {right} * {span} > (idx - 1) * {steps}"
        left_part = f"({left} * {span} - idx * {steps}) / cast({steps} as double)"
        right_part = f"({right} * {span} - (idx - 1) * {steps}) / cast({steps} as double)"
        shares = F.expr(
            f"filter(array("
            f"  if({left_ok}, struct({left} as _bin, 1d - {left_part} as _w), null),"
            f"  if({right_ok}, struct({right} as _bin, {right_part} as _w), null)), x -> x is not null)"
        )
        spread = checked.where(F.col("n") > 1).select("*", F.inline(shares))
        out = spread.groupBy(*keys, "_bin").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names], *position)
    return out.withColumnRenamed("_bin", "idx").withColumn("n", F.lit(n).cast("long"))


def hann(signal: DataFrame) -> DataFrame:
    """Weight every series with a Hann window."""
    return signal.withColumn("value", F.col("value") * hann_weight(F.col("idx"), F.col("n")))


def spectrum_bins(signal: DataFrame, fs: float, bins: Sequence[int], window: bool = True) -> DataFrame:
    """Magnitude of chosen frequency bins, as one aggregation over the samples.

    Each bin is a pair of sums with map-side combine, so no series is ever gathered. Meant for a handful of bins; use
    ``spectrum`` for all of them.
    """
    keys = series_keys(signal)
    data = hann(signal) if window else signal
    turn = {k: 2 * F.pi() * (F.col("idx") * k % F.col("n")) / F.col("n") for k in bins}
    sums = [F.max("n").alias("n")]
    for k in bins:
        sums.append(F.sum(F.col("value") * F.cos(turn[k])).alias(f"_c{k}"))
        sums.append(F.sum(F.col("value") * F.sin(turn[k])).alias(f"_s{k}"))
    rows = F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("bin"),
            (F.lit(float(k)) * float(fs) / F.col("n")).alias("freq_hz"),
            (F.sqrt(F.col(f"_c{k}") ** 2 + F.col(f"_s{k}") ** 2) / F.col("n")).alias("magnitude"),
        )
        for k in bins
    ])
    return data.groupBy(*keys).agg(*sums).select(*keys, F.inline(rows))
