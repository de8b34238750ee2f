"""Recordings to features: the processing steps in their fixed order."""

from __future__ import annotations

import dataclasses
import hashlib
import re
import secrets
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sigspark.functions.harmonics import harmonics
from sigspark.operators import signal as ops
from sigspark.operators.dataset import make_dataset
from sigspark.operators.filters import apply_filters, design_chain
from sigspark.operators.fourier import spectrum
from sigspark.operators.scale import small_side_and_max
from sigspark.plans.config import ProcessConfig
from sigspark.sources.files import assign_target
from sigspark.sources.recordings import read_recordings


def process(signal: DataFrame, cfg: ProcessConfig) -> DataFrame:
    """Select channels, segment, filter, transform, average, shrink - each step only if configured.

    Channels named like the time column are left alone by every step, so they are dropped first. After ``fft`` the
    samples are spectrum bins and ``t`` is the frequency.
    """
    cfg.validate()
    out = ops.drop_channels(signal, cfg.time_like)
    longest = None
    if cfg.top_channels or cfg.fft:
        stats, longest = small_side_and_max(ops.channel_stats(out), "n")
        longest //= cfg.segments or 1
    if cfg.top_channels:
        out = ops.top_n_channels(out, cfg.top_channels, stats=stats)
    if cfg.segments:
        out = ops.segment(out, cfg.segments)
    wanted = harmonics(cfg.harmonic_freq, cfg.harmonic_nth, cfg.harmonic_mode) if cfg.harmonic_freq else []
    if cfg.filter_type or wanted:
        chain = design_chain(cfg.filter_order, cfg.filter_type, cfg.cuts, wanted, cfg.fs)
        out = apply_filters(out, chain, longest=longest)
    if cfg.fft:
        bins = spectrum(out, cfg.fs, longest=longest)
        out = bins.withColumnsRenamed({"bin": "idx", "freq_hz": "t", "magnitude": "value", "n_bins": "n"})
    if cfg.average:
        out = ops.channel_mean(out)
    if cfg.shrink:
        out = ops.resample(out, cfg.shrink, cfg.shrink_mode)
    return out


def process_to_dataset(signal: DataFrame, cfg: ProcessConfig) -> DataFrame:
    """The same, gathered into one labelled feature row per recording, segment and output channel."""
    rows = make_dataset(process(signal, cfg))
    labelled = assign_target(rows, cfg.targets, on="recording_id", match="first", untargeted=cfg.untargeted)
    return labelled.withColumnRenamed("target", "label")


def process_files(
    spark: SparkSession, paths: str | Sequence[str], cfg: ProcessConfig, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Read recordings - files, or a folder with rules on paths - then ``process_to_dataset`` or ``process`` as configured."""
    signal = read_recordings(spark, paths, cfg.skip_rows, cfg.time_like, include=include, exclude=exclude)
    return process_to_dataset(signal, cfg) if cfg.dataset else process(signal, cfg)


# Settings that name a run rather than change its result.
_NAMING = ("file_name", "keyword", "random_key", "timestamp")


def run_name(cfg: ProcessConfig) -> str:
    """Folder name of a run's output: the settings that differ from their defaults, and a digest of all of them.

    Equal settings give equal names, unless ``timestamp`` or ``random_key`` ask for more. ``file_name`` stands for the listed settings, ``keyword`` is put before them.
    Characters that a path cannot hold everywhere become ``-``.
    """
    settings = {f.name: getattr(cfg, f.name) for f in dataclasses.fields(cfg) if f.name not in _NAMING}
    plain = ProcessConfig()
    changed = [f"{k}={v}" for k, v in settings.items() if v != getattr(plain, k) and not isinstance(v, (dict, list, tuple))]
    digest = hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:10]
    parts = [cfg.keyword, cfg.file_name or ",".join(changed) or "plain", digest]
    if cfg.timestamp:
        parts.append(time.strftime("%Y%m%dT%H%M%S"))
    if cfg.random_key:
        parts.append(secrets.token_hex(4))
    return "__".join(re.sub(r"[^\w=.,+-]", "-", str(p)) for p in parts if p)
