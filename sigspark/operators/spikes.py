"""Threshold-crossing events ("spikes") and their waveforms.

Channels are cut into overlapping blocks, so peak windows never cross a task boundary and no channel is gathered. The
dead window makes the choice of spikes sequential along a channel; it is resolved with a per-block table of how the
block maps an entry state to an exit state, composed over blocks, then over groups of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.blocks import BLOCK_SAMPLES, to_blocks
from sigspark.operators.scale import freeze, small_side
from sigspark.operators.signal import CHANNEL_KEYS, channel_stats
from sigspark.plans.config import SpikeConfig

# Blocks composed into one group when resolving dead windows along a long channel.
_BLOCKS_PER_GROUP = 1024
# Candidates whose windows are looked at together inside a task.
_WINDOWS_AT_ONCE = 4096
# Samples of short blocks that a task looks at together; a longer block comes alone.
_SAMPLES_AT_ONCE = 1 << 18


def _live(signal: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Deviation of the channels that hold any non-zero sample."""
    base = small_side(channel_stats(signal)) if stats is None else stats
    return base.where(F.col("max_abs") > 0).select(*CHANNEL_KEYS, "std")


def crossings(signal: DataFrame, k: float = 5.5, stats: DataFrame | None = None) -> DataFrame:
    """Samples at or beyond ``k`` population standard deviations from zero; all-zero channels give none.

    The value is not mean-centred. A constant non-zero channel has deviation 0, so all its samples cross.
    """
    return signal.join(_live(signal, stats), CHANNEL_KEYS).where(F.abs("value") >= k * F.col("std"))


def edge_rule(crossed: DataFrame, before: int, after: int, mode: str = "ignore") -> DataFrame:
    """Add the window ``[low, high)`` around each crossing.

    A window fits when ``low >= 0`` and ``high < n``. Otherwise the crossing is dropped (``ignore``) or its window is
    trimmed to the channel (``trim``; a window ending exactly at n keeps its end).
    """
    low, high = F.col("idx") - before, F.col("idx") + after
    if mode == "ignore":
        return crossed.withColumn("low", low).withColumn("high", high).where((low >= 0) & (high < F.col("n")))
    if mode == "trim":
        trimmed = F.when(high > F.col("n"), F.col("n") - 1).otherwise(high)
        return crossed.withColumn("low", F.greatest(low, F.lit(0))).withColumn("high", trimmed)
    raise ValueError("mode must be 'ignore' or 'trim'")


def spike_blocks(
    signal: DataFrame,
    cfg: SpikeConfig,
    stats: DataFrame | None = None,
    block: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Blocks of every channel that is not all zero, with the channel's deviation.

    A spike found at i peaks within ``before``/``after`` of i and is cut out around that peak, hence double margins.
    """
    before, after = cfg.before, cfg.after
    length = max(BLOCK_SAMPLES if block is None else block, 2 * max(before, after, 1))
    blocks = to_blocks(signal, CHANNEL_KEYS, length, 2 * before, 2 * after, longest=longest)
    return blocks.join(_live(signal, stats), CHANNEL_KEYS).withColumn("length", F.lit(length).cast("long"))


_CANDIDATE = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("idx", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("peak_idx", T.LongType()),
    T.StructField("peak_value", T.DoubleType()),
    T.StructField("abs_peak_idx", T.LongType()),
    T.StructField("abs_peak_value", T.DoubleType()),
    T.StructField("first_idx", T.LongType()),
    T.StructField("last_idx", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("ignored", T.BooleanType()),
])


def peaks(blocks: DataFrame, cfg: SpikeConfig) -> DataFrame:
    """Every threshold crossing with its peak, its absolute peak and the window re-centred on the peak.

    The peak is the largest value in the crossing's window for a positive crossing, else the smallest; the absolute
    peak is the largest magnitude; the earliest sample wins ties. ``step`` is how far past the crossing the dead window
    reaches, ``ignored`` marks crossings whose window does not fit.
    """
    k, before, after, dead, trim = cfg.threshold, cfg.before, cfg.after, cfg.dead, cfg.edge == "trim"

    def windows(at: np.ndarray, n: np.ndarray):
        """Bounds of [at-before, at+after) after the edge rule, and which of them fit."""
        low, high = at - before, at + after
        fits = (low >= 0) & (high < n)
        if trim:
            low, high = np.maximum(low, 0), np.where(high > n, n - 1, high)
        return low, high, fits

    def search(x: np.ndarray, shift: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, positive: np.ndarray):
        """Positions of the peak and the absolute peak of each window, a bounded number of windows at a time."""
        peak, extreme = np.empty(len(low), dtype=np.int64), np.empty(len(low), dtype=np.int64)
        reach = np.arange(max(before + after, 1))
        for s in range(0, len(low), _WINDOWS_AT_ONCE):
            part = slice(s, s + _WINDOWS_AT_ONCE)
            place = low[part, None] + reach
            inside = place < high[part, None]
            w = x[np.minimum(place + shift[part, None], end[part, None])]
            inside &= ~np.isnan(w)
            signed = np.where(positive[part, None], w, -w)
            peak[part] = low[part] + np.argmax(np.where(inside, signed, -np.inf), axis=1)
            extreme[part] = low[part] + np.argmax(np.where(inside, np.abs(w), -np.inf), axis=1)
        return peak, extreme

    def found(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Crossings of a few blocks, whose samples lie one after another."""
        x, sizes = _flat(rows.column("values"))
        block, n, start, length = (rows.column(c).to_numpy().astype(np.int64) for c in ("block", "n", "start", "length"))
        std = rows.column("std").to_numpy(zero_copy_only=False)
        base = np.cumsum(sizes) - sizes
        place = np.arange(len(x)) - np.repeat(base, sizes)
        least = np.repeat(k * std, sizes)
        lo = block * length - start
        hit = ((x >= least) | (x <= -least)) & (place >= np.repeat(lo, sizes)) & (place < np.repeat(lo + length, sizes))
        spot = np.flatnonzero(hit)
        if not len(spot):
            return None
        row = np.searchsorted(base + sizes, spot, side="right")
        n, std, shift, end = n[row], std[row], (base - start)[row], (base + sizes - 1)[row]
        at, value = spot - shift, x[spot]
        low, high, fits = windows(at, n)
        usable = fits if not trim else low < high
        safe_low, safe_high = np.where(usable, low, at), np.where(usable, high, at + 1)
        peak, extreme = search(x, shift, end, safe_low, safe_high, value >= k * std)
        first, last, peak_fits = windows(peak, n)
        keys = [rows.column(c).take(pa.array(row)) for c in CHANNEL_KEYS]
        rest = (block[row], n, std, at, value, peak, x[peak + shift], extreme, x[extreme + shift], first, last,
                dead + last - high, ~usable if trim else ~(fits & peak_fits))
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, rest)], names=_CANDIDATE.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(_flat(batch.column("values"))[1])
            done, samples = 0, 0
            while done < len(ends):
                upto = max(int(np.searchsorted(ends, samples + _SAMPLES_AT_ONCE, side="right")), done + 1)
                out = found(batch.slice(done, upto - done))
                if out is not None:
                    yield out
                done, samples = upto, int(ends[upto - 1])

    columns = [*CHANNEL_KEYS, "block", "n", "std", "start", "length", "values"]
    return blocks.select(*columns).mapInArrow(scan, _CANDIDATE)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all lists, one list after another, and the lists' sizes."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)


# --- dead window -----------------------------------------------------------------------------------------------

_LONGS = T.ArrayType(T.LongType())
_PLACES = T.ArrayType(T.IntegerType())
_TABLE = T.StructType([T.StructField("ends", _LONGS), T.StructField("outs", _LONGS)])


def _advance(i: int, step: int, ignored: bool, nxt: np.ndarray, lag: np.ndarray) -> None:
    """Pass one crossing, with lags, for many states at once. ``nxt``: first index that may spike. Updates in place."""
    ready = nxt <= i
    if ignored:
        lag[ready] += 1
        return
    then = i - lag + step
    behind = np.maximum(i + 1 - then, 0)
    nxt[ready] = np.maximum(then, i + 1)[ready]
    lag[ready] = behind[ready]


def _successors(idx: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Place of the crossing that spikes next if the one at each place does; the number of crossings if none."""
    return np.searchsorted(idx, idx + np.maximum(step, 1))


def _chain(idx: np.ndarray, step: np.ndarray, nxt: int) -> list[int]:
    """Places that spike when the first index that may is ``nxt``: one step per spike, whatever lies between them."""
    follow, out, p = _successors(idx, step).tolist(), [], int(np.searchsorted(idx, nxt))
    while p < len(follow):
        out.append(p)
        p = follow[p]
    return out


def _exits(idx: np.ndarray, step: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """First index that may spike after all crossings, for each one before them.

    Links to successors are doubled until they reach the last spike of their chain: log2 of the crossings passes for
    all entry states together.
    """
    follow = _successors(idx, step)
    link = np.where(follow < len(idx), follow, np.arange(len(idx)))
    while True:
        further = link[link]
        if np.array_equal(further, link):
            break
        link = further
    after = np.append(idx[link] + np.maximum(step[link], 1), 0)
    first = np.searchsorted(idx, nxt)
    return np.where(first < len(idx), after[first], nxt)


def _replay(lists: Sequence, nxt: int, lag: int) -> list[int]:
    """The same as ``_chain`` where ignored crossings shorten the next dead window."""
    out = []
    for p, (i, step, ignored) in enumerate(zip(*(x.tolist() for x in lists))):
        if i < nxt:
            continue
        if ignored:
            lag += 1
            continue
        then = i - lag + step
        nxt, lag = max(then, i + 1), max(i + 1 - then, 0)
        out.append(p)
    return out


def _enter(d: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """State offset at a block start -> (next eligible index, lag). Positive: still dead; negative: lagging."""
    return start + np.maximum(d, 0), np.maximum(-d, 0)


def _leave(nxt: np.ndarray, lag: np.ndarray, end: int) -> np.ndarray:
    return np.where(nxt > end, nxt - end, -lag)


def _encode(outs: np.ndarray, lowest: int) -> dict:
    """Run-length form of a table over the states lowest, lowest+1, ..."""
    last = np.append(np.flatnonzero(np.diff(outs)), len(outs) - 1)
    return {"ends": last + lowest, "outs": outs[last]}


def _lookup(d: np.ndarray, ends, outs) -> np.ndarray:
    return np.asarray(outs)[np.searchsorted(np.asarray(ends), d)]


def _skip(d: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks without crossings end any dead window and leave a lag as it is."""
    return np.minimum(d, 0) if blocks > 0 else d


def refractory(
    candidates: DataFrame,
    length: int,
    dead_reach: int,
    longest: int,
    lag_reach: int = 0,
    replay_lag: bool = False,
    blocks_per_group: int | None = None,
) -> DataFrame:
    """Keep the crossings that spike: after one at i, the next needs an index of at least ``i + step``.

    ``candidates`` carry (recording, channel, block, idx, step, ignored), with block = idx // length; ``dead_reach``
    bounds how far past a block's end a dead window can last. A channel of one block is walked directly. Longer
    channels take an up-sweep of entry-to-exit tables (block, then group of blocks) and a down-sweep of entry states,
    so each task sees one block or one group. Within a block each crossing links to its successor: tables follow links
    by doubling them, spikes are read off one link at a time. Only tables under ``replay_lag`` pass every crossing.

    Ignored crossings never spike. With ``replay_lag`` each one also shortens the next dead window by one sample.
    """
    if length < dead_reach + 1:
        raise ValueError("blocks must be longer than the dead window")
    fan = _BLOCKS_PER_GROUP if blocks_per_group is None else blocks_per_group
    lowest, states = -lag_reach, dead_reach + lag_reach + 1
    keys = CHANNEL_KEYS
    rows = candidates if replay_lag else candidates.where(~F.col("ignored"))
    rest = [c for c in candidates.columns if c not in (*keys, "block", "idx", "step", "ignored")]
    per_block = rows.groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("idx", "step", "ignored", *rest))).alias("_crossed")
    )
    crossed = ["block", "_crossed.idx", "_crossed.step", "_crossed.ignored"]

    @F.pandas_udf(_PLACES)
    def accept(block: pd.Series, idx: pd.Series, step: pd.Series, ignored: pd.Series, entry: pd.Series) -> pd.Series:
        """Places, within the block's list, of the crossings that spike."""
        out = []
        for b, *lists, d in zip(block, idx, step, ignored, entry):
            nxt, lag = b * length + max(d, 0), max(-d, 0)
            out.append(_replay(lists, nxt, lag) if replay_lag else _chain(lists[0], lists[1], nxt))
        return pd.Series(out)

    def pick(df: DataFrame, entry: Column) -> DataFrame:
        hits = F.transform(accept(*crossed, entry), lambda p: F.get("_crossed", p))
        return df.select(*keys, "block", F.inline(hits)).select(*candidates.columns)

    zero = F.lit(0).cast("long")
    if longest <= length:
        return pick(per_block, zero)

    @F.pandas_udf(_TABLE)
    def block_table(block: pd.Series, idx: pd.Series, step: pd.Series, ignored: pd.Series) -> pd.DataFrame:
        tables = []
        for b, *lists in zip(block, idx, step, ignored):
            nxt, lag = _enter(np.arange(lowest, lowest + states, dtype=np.int64), b * length)
            if replay_lag:
                for c in zip(*lists):
                    _advance(*c, nxt, lag)
            else:
                nxt = _exits(lists[0], lists[1], nxt)
            tables.append(_encode(_leave(nxt, lag, (b + 1) * length), lowest))
        return pd.DataFrame(tables)

    @F.pandas_udf(_TABLE)
    def group_table(group: pd.Series, tables: pd.Series) -> pd.DataFrame:
        out = []
        for g, items in zip(group, tables):
            d, at = np.arange(lowest, lowest + states, dtype=np.int64), int(g) * fan
            for t in items:
                d, at = _lookup(_skip(d, t["at"] - at), t["ends"], t["outs"]), t["at"] + 1
            out.append(_encode(_skip(d, (int(g) + 1) * fan - at), lowest))
        return pd.DataFrame(out)

    @F.pandas_udf(_LONGS)
    def entries(first: pd.Series, entry: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for at, d, items in zip(first, entry, tables):
            at, d, found = int(at), np.array([d], dtype=np.int64), []
            for t in items:
                d = _skip(d, t["at"] - at)
                found.append(int(d[0]))
                d, at = _lookup(d, t["ends"], t["outs"]), t["at"] + 1
            out.append(found)
        return pd.Series(out)

    def gather(df: DataFrame, by: Sequence[str], at: str) -> DataFrame:
        row = F.struct(F.col(at).alias("at"), F.col("_t.ends").alias("ends"), F.col("_t.outs").alias("outs"))
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_tables"))

    def spread(df: DataFrame, by: Sequence[str], at: str, first: Column) -> DataFrame:
        pairs = F.arrays_zip(F.col("_tables.at").alias("at"), entries(first, "_entry", "_tables").alias("entry"))
        return df.select(*by, F.inline(pairs)).withColumnRenamed("at", at).withColumnRenamed("entry", "_entry")

    frozen = freeze(per_block)
    tables = frozen.select(*keys, "block", block_table(*crossed).alias("_t"))
    groups = freeze(gather(tables.withColumn("_group", F.expr(f"block div {fan}")), [*keys, "_group"], "block"))
    tops = gather(groups.select(*keys, "_group", group_table("_group", "_tables").alias("_t")), keys, "_group")
    top_entry = spread(tops.withColumn("_entry", zero), keys, "_group", zero)
    entry = spread(groups.join(top_entry.hint("merge"), [*keys, "_group"]), keys, "block", F.col("_group") * fan)
    return pick(frozen.join(entry.hint("merge"), [*keys, "block"]), F.col("_entry"))


# --- features --------------------------------------------------------------------------------------------------

SPIKE_COLUMNS = [
    "key", "file", "sampling_hz", "n_values", "target", "column_id", "crossing_idx", "peak_value", "peak_idx",
    "min_value", "max_value", "slope", "extrema_ratio", "first_idx", "last_idx", "extracted",
]


def extract(spikes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add waveform ``extracted`` (samples first_idx..last_idx-1) and its extremes to accepted spikes.

    Spikes are gathered per block, so a block's samples are joined once and sliced per spike.
    """
    fields = [c for c in spikes.columns if c not in (*CHANNEL_KEYS, "block")]
    hits = spikes.groupBy(*CHANNEL_KEYS, "block").agg(F.collect_list(F.struct(*fields)).alias("_hits"))
    held = blocks.select(*CHANNEL_KEYS, "block", "start", "values")
    rows = held.join(hits, [*CHANNEL_KEYS, "block"]).withColumn("_hit", F.explode("_hits"))
    offset = (F.col("_hit.first_idx") - F.col("start") + 1).cast("int")
    count = F.greatest(F.col("_hit.last_idx") - F.col("_hit.first_idx"), F.lit(0)).cast("int")
    return (
        rows.select(*CHANNEL_KEYS, "_hit.*", F.slice("values", offset, count).alias("extracted"))
        .withColumn("min_value", F.array_min("extracted"))
        .withColumn("max_value", F.array_max("extracted"))
    )


def shape_features(spikes: DataFrame) -> DataFrame:
    """Slope from the crossing to the absolute peak (null when they coincide) and the extrema ratio."""
    run = F.col("abs_peak_idx") - F.col("idx")
    slope = F.when(run != 0, (F.col("abs_peak_value") - F.col("value")) / run)
    below, above = F.abs(F.col("min_value") - F.col("std")), F.abs(F.col("max_value") - F.col("std"))
    return spikes.withColumn("slope", slope).withColumn("extrema_ratio", F.try_divide(below, above))


def with_key(spikes: DataFrame, length: int = 32) -> DataFrame:
    """Repeatable spike key: hex digest of recording, channel and crossing. Shorter keys may collide."""
    text = F.concat_ws("\x1f", "recording_id", "channel", F.col("idx").cast("string"))
    return spikes.withColumn("key", F.substring(F.md5(text), 1, length))
