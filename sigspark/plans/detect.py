"""Recordings to a spike table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.columns import label_from_text
from sigspark.operators import signal as ops
from sigspark.operators import spikes as sp
from sigspark.operators.scale import small_side_and_max
from sigspark.plans.config import SpikeConfig
from sigspark.sources.recordings import read_recordings


def accepted_spikes(
    signal: DataFrame, cfg: SpikeConfig, block: int | None = None, blocks_per_group: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Crossings that spike, with their peaks, and the blocks they came from."""
    cfg.validate()
    out = ops.drop_channels(signal, cfg.time_like)
    stats, longest = small_side_and_max(ops.channel_stats(out), "n")
    if cfg.top_channels:
        out = ops.top_n_channels(out, cfg.top_channels, stats=stats)
    length = max(sp.BLOCK_SAMPLES if block is None else block, 2 * (cfg.dead + cfg.before + cfg.after))
    blocks = sp.spike_blocks(out, cfg, stats, length, longest)
    chosen = sp.refractory(
        sp.peaks(blocks, cfg),
        length=length,
        dead_reach=cfg.dead + cfg.after + 1,
        longest=longest,
        lag_reach=2 * (cfg.before + cfg.after) + 1 if cfg.replay_lag else 0,
        replay_lag=cfg.replay_lag,
        blocks_per_group=blocks_per_group,
    )
    return chosen, blocks


def detect_spikes(
    signal: DataFrame, cfg: SpikeConfig, block: int | None = None, blocks_per_group: int | None = None
) -> DataFrame:
    """The full spike table, one row per spike."""
    chosen, blocks = accepted_spikes(signal, cfg, block, blocks_per_group)
    spikes = sp.with_key(sp.shape_features(sp.extract(chosen, blocks)))
    target = F.coalesce(label_from_text(F.col("recording_id"), cfg.targets, "last"), F.lit(""))
    return (
        spikes.withColumn("target", target)
        .withColumn("sampling_hz", F.lit(cfg.fs))
        .withColumnsRenamed({"recording_id": "file", "channel": "column_id", "idx": "crossing_idx", "n": "n_values"})
        .select(*sp.SPIKE_COLUMNS)
    )


def detect_files(
    spark: SparkSession, paths: str | Sequence[str], cfg: SpikeConfig, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Read recordings - files, or a folder with rules on paths - and detect their spikes."""
    return detect_spikes(read_recordings(spark, paths, cfg.skip_rows, cfg.time_like, include=include, exclude=exclude), cfg)
