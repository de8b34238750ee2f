"""Full magnitude spectrum of every series.

Series up to ``DIRECT_SAMPLES`` are transformed one row each. Longer ones are never gathered. Where the length has two
factors that fit a task, columns and then rows of a grid of just these sides are transformed; real samples let half the
rows do. Other lengths (primes, or with too large a prime factor) become a chirp convolution on a power-of-two grid.
Tasks hold a few columns or a few rows and pass tiles on: about ``_TASK_CELLS`` values however long the series.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.functions.columns import hann_weight
from sigspark.operators.blocks import collect_in_order
from sigspark.operators.scale import freeze, small_side
from sigspark.operators.signal import series_keys

DIRECT_SAMPLES = 1 << 18
_TASK_CELLS = 1 << 20
_REALS = T.ArrayType(T.DoubleType())
_TILES = T.ArrayType(_REALS)


def _half_turns(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-i*pi*j*j/n), with j*j reduced modulo 2n in 20-bit steps so that long series keep full precision."""
    m = 2 * n
    j = np.abs(np.asarray(j, dtype=np.int64)) % m
    low, high = j & 0xFFFFF, j >> 20
    square = (((high * j) % m << 20) % m + low * j % m) % m
    return np.exp(-1j * np.pi * (square / n))


@F.pandas_udf(_REALS)
def _direct(values: pd.Series) -> pd.Series:
    out = []
    for x in values:
        x = np.asarray(x, dtype=float)
        out.append(np.abs(np.fft.rfft(x))[: len(x) // 2] / len(x))
    return pd.Series(out)


def _magnitude_rows(df: DataFrame, keys: list[str], fs: float) -> DataFrame:
    return df.select(
        *keys,
        "bin",
        (F.col("bin") * float(fs) / F.col("n")).alias("freq_hz"),
        "magnitude",
        F.expr("n div 2").alias("n_bins"),
    )


def _series_spectrum(data: DataFrame, keys: list[str], fs: float) -> DataFrame:
    series = collect_in_order(data, keys, ["value"])
    bins = series.select(*keys, "n", F.posexplode(_direct("values")).alias("bin", "magnitude"))
    return _magnitude_rows(bins.withColumn("bin", F.col("bin").cast("long")), keys, fs)


# --- grid of rows x cols cells, in tiles of side x side; complex values travel as pairs of doubles -----------------


def _cut(block: np.ndarray, side: int, axis: int) -> list[np.ndarray]:
    """Square tiles of a block of whole columns (axis 0) or whole rows (axis 1), as pairs of doubles."""
    parts = np.split(block, block.shape[axis] // side, axis=axis)
    return [np.ascontiguousarray(p).view(float).ravel() for p in parts]


def _paste(places, tiles, side: int, axis: int) -> np.ndarray:
    """The block that square tiles at the given places make up, along an axis."""
    order = np.argsort(np.asarray(places))
    parts = [np.asarray(tiles[i], dtype=float).view(complex).reshape(side, side) for i in order]
    return np.concatenate(parts, axis=axis)


def _turn(first: int, side: int, length: int, cells: int, sign: int) -> np.ndarray:
    """exp(sign * 2i*pi * k*j / cells) for k < length (rows) and j = first .. first+side-1 (columns)."""
    return np.exp(sign * 2j * np.pi * np.outer(np.arange(length), np.arange(first, first + side)) / cells)


@F.pandas_udf(_TILES)
def _signal_columns(idx: pd.Series, value: pd.Series, shape: pd.DataFrame, tile: pd.Series) -> pd.Series:
    """Chirped samples of a few grid columns -> their transforms, turned for the row step."""
    out = []
    for i, v, (n, rows, cols, side), at in zip(idx, value, shape.itertuples(index=False), tile):
        i = np.asarray(i, dtype=np.int64)
        x = np.zeros((rows, side), dtype=complex)
        x[i // cols, i % cols - at * side] = np.asarray(v, dtype=float) * _half_turns(i, n)
        out.append(_cut(np.fft.fft(x, axis=0) * _turn(at * side, side, rows, rows * cols, -1), side, 0))
    return pd.Series(out)


@F.pandas_udf(_TILES)
def _chirp_columns(shape: pd.DataFrame, tile: pd.Series) -> pd.Series:
    """The same for the chirp itself, which depends on the series length only."""
    out = []
    for (n, rows, cols, side), at in zip(shape.itertuples(index=False), tile):
        i = np.arange(rows, dtype=np.int64)[:, None] * cols + np.arange(at * side, (at + 1) * side)
        i = np.minimum(i, rows * cols - i)
        x = np.where(i < n, np.conj(_half_turns(i, n)), 0)
        out.append(_cut(np.fft.fft(x, axis=0) * _turn(at * side, side, rows, rows * cols, -1), side, 0))
    return pd.Series(out)


@F.pandas_udf(_REALS)
def _chirp_rows(places: pd.Series, tiles: pd.Series, shape: pd.DataFrame) -> pd.Series:
    """Transform of the chirp on a few grid rows."""
    return pd.Series([
        np.fft.fft(_paste(p, t, s.side, 1), axis=1).view(float).ravel()
        for p, t, s in zip(places, tiles, shape.itertuples(index=False))
    ])


@F.pandas_udf(_TILES)
def _convolve_rows(places: pd.Series, tiles: pd.Series, chirp: pd.Series, shape: pd.DataFrame, tile: pd.Series) -> pd.Series:
    """Transform of the signal on a few grid rows, times that of the chirp -> first half of the inverse."""
    out = []
    for p, t, c, (_, rows, cols, side), at in zip(places, tiles, chirp, shape.itertuples(index=False), tile):
        product = np.fft.fft(_paste(p, t, side, 1), axis=1) * np.asarray(c, dtype=float).view(complex).reshape(side, cols)
        turned = np.fft.ifft(product, axis=1) * _turn(at * side, side, cols, rows * cols, 1).T
        out.append(_cut(turned, side, 1))
    return pd.Series(out)


@F.pandas_udf(_REALS)
def _magnitudes(places: pd.Series, tiles: pd.Series, shape: pd.DataFrame) -> pd.Series:
    """Second half of the inverse on a few grid columns: magnitudes, row by row, of the rows that hold wanted bins."""
    out = []
    for p, t, (n, _, cols, side) in zip(places, tiles, shape.itertuples(index=False)):
        whole = np.fft.ifft(_paste(p, t, side, 0), axis=0)
        out.append((np.abs(whole[: -(-(n // 2) // cols)]) / n).ravel())
    return pd.Series(out)


def _regroup(df: DataFrame, keys: list[str], held: str, tile: str) -> DataFrame:
    """Send tile number ``tile`` of every block to one place; ``held`` is the block it comes from."""
    tiles = df.select(*keys, held, F.posexplode("_tiles").alias(tile, "_cells"))
    return tiles.groupBy(*keys, tile).agg(F.collect_list(F.struct(held, "_cells")).alias("_parts"))


def _grid_spectrum(data: DataFrame, keys: list[str], fs: float) -> DataFrame:
    bits = "cast(ceil(log2(2.0d * n)) as int)"
    shape = F.struct("n", "rows", "cols", "side").alias("_shape")
    shaped = (
        data.withColumn("rows", F.expr(f"shiftleft(1L, {bits} div 2)"))
        .withColumn("cols", F.expr(f"shiftleft(1L, {bits} - {bits} div 2)"))
        .withColumn("side", F.expr(f"least(rows, greatest(1L, {_TASK_CELLS}L div cols))"))
        .withColumn("_shape", shape)
        .drop("n", "rows", "cols", "side")
    )
    grid = [*keys, "_shape"]
    columns = (
        shaped.groupBy(*grid, F.expr("idx % _shape.cols div _shape.side").alias("_col"))
        .agg(F.collect_list(F.struct("idx", "value")).alias("_s"))
        .withColumn("_tiles", _signal_columns("_s.idx", "_s.value", "_shape", "_col"))
    )
    rows = _regroup(columns, grid, "_col", "_row")

    shapes = freeze(shaped.select("_shape").distinct())
    last = F.expr("_shape.cols div _shape.side - 1")
    chirp = shapes.withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("_shape", "_col")
    chirp = _regroup(chirp.withColumn("_tiles", _chirp_columns("_shape", "_col")), ["_shape"], "_col", "_row")
    chirp = chirp.select("_shape", "_row", _chirp_rows("_parts._col", "_parts._cells", "_shape").alias("_chirp"))

    # The planner sees one row per length and would broadcast the chirp; it is as large as the padded series.
    both = rows.join(chirp.hint("merge"), ["_shape", "_row"])
    back = both.withColumn("_tiles", _convolve_rows("_parts._col", "_parts._cells", "_chirp", "_shape", "_row"))
    bins = _regroup(back, grid, "_row", "_col").select(
        *grid, "_col", F.posexplode(_magnitudes("_parts._row", "_parts._cells", "_shape")).alias("_place", "magnitude")
    )
    place = "_col * _shape.side + _place % _shape.side + _shape.cols * (_place div _shape.side)"
    found = bins.select(*keys, F.col("_shape.n").alias("n"), F.expr(place).cast("long").alias("bin"), "magnitude")
    return _magnitude_rows(found.where(F.col("bin") < F.expr("n div 2")), keys, fs)


# --- two factors -----------------------------------------------------------------------------------------------


@F.pandas_udf(T.LongType())
def _factor(n: pd.Series) -> pd.Series:
    """Largest divisor up to the square root."""
    out = []
    for x in n.tolist():
        d = np.arange(1, math.isqrt(x) + 1)
        out.append(int(d[x % d == 0][-1]))
    return pd.Series(out)


@F.pandas_udf(_TILES)
def _factor_columns(idx: pd.Series, value: pd.Series, shape: pd.DataFrame, tile: pd.Series) -> pd.Series:
    """A few grid columns -> first half of their transforms, turned for the row step, in tiles of ``tall`` rows."""
    out = []
    for i, v, (n, rows, cols, wide, tall), at in zip(idx, value, shape.itertuples(index=False), tile):
        i, first = np.asarray(i, dtype=np.int64), at * wide
        x = np.zeros((rows, min(wide, cols - first)))
        x[i // cols, i % cols - first] = np.asarray(v, dtype=float)
        half = np.fft.rfft(x, axis=0)
        half *= _turn(first, half.shape[1], len(half), n, -1)
        out.append([np.ascontiguousarray(p).view(float).ravel() for p in np.split(half, range(tall, len(half), tall))])
    return pd.Series(out)


@F.pandas_udf(_REALS)
def _factor_rows(places: pd.Series, tiles: pd.Series, shape: pd.DataFrame) -> pd.Series:
    """Magnitudes of a few grid rows, row by row."""
    out = []
    for p, t, (n, _, cols, wide, _) in zip(places, tiles, shape.itertuples(index=False)):
        order = np.argsort(np.asarray(p))
        parts = [np.asarray(t[i], dtype=float).view(complex).reshape(-1, min(wide, cols - p[i] * wide)) for i in order]
        out.append((np.abs(np.fft.fft(np.concatenate(parts, axis=1), axis=1)) / n).ravel())
    return pd.Series(out)


def _factor_spectrum(data: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Spectrum of series of n = rows * cols samples. Grid row k holds the bins k, k + rows, ...

    Bin n - b mirrors bin b and lies in row rows - k, so rows up to rows / 2 give all bins; the first row, and the
    middle one of an even number, hold both.
    """
    shaped = (
        data.withColumn("cols", F.expr("n div rows"))
        .withColumn("wide", F.expr(f"greatest(1L, least(cols, {_TASK_CELLS}L div rows))"))
        .withColumn("tall", F.expr(f"greatest(1L, least(rows, {_TASK_CELLS}L div cols))"))
        .withColumn("_shape", F.struct("n", "rows", "cols", "wide", "tall"))
        .drop("n", "rows", "cols", "wide", "tall")
    )
    grid = [*keys, "_shape"]
    columns = (
        shaped.groupBy(*grid, F.expr("idx % _shape.cols div _shape.wide").alias("_col"))
        .agg(F.collect_list(F.struct("idx", "value")).alias("_s"))
        .withColumn("_tiles", _factor_columns("_s.idx", "_s.value", "_shape", "_col"))
    )
    found = _regroup(columns, grid, "_col", "_row").select(
        *keys, "_shape.*", "_row", F.posexplode(_factor_rows("_parts._col", "_parts._cells", "_shape")).alias("_place", "magnitude")
    )
    found = found.withColumn("_k", F.expr("_row * tall + _place div cols")).withColumn("_at", F.expr("_k + rows * (_place % cols)"))
    mirrored = F.expr("_k <> 0 AND 2 * _k <> rows AND n - _at < n div 2")
    found = found.withColumn("bin", F.when(F.expr("_at < n div 2"), F.col("_at")).when(mirrored, F.col("n") - F.col("_at")))
    return _magnitude_rows(found.where("bin IS NOT NULL").withColumn("bin", F.col("bin").cast("long")), keys, fs)


def spectrum(
    signal: DataFrame, fs: float, window: bool = True, longest: int | None = None, direct: int | None = None
) -> DataFrame:
    """Magnitude ``abs(fft)/n`` of the first ``n // 2`` bins of every series, Hann-weighted unless ``window=False``.

    ``longest`` is the largest series length if the caller knows it; otherwise one job reads it.
    """
    limit = DIRECT_SAMPLES if direct is None else direct
    keys = series_keys(signal)
    data = signal.select(*keys, "idx", "n", "value")
    weighted = data.withColumn("value", F.col("value") * hann_weight(F.col("idx"), F.col("n"))) if window else data
    if longest is None:
        longest = data.agg(F.max("n")).first()[0] or 0
    if longest <= limit:
        return _series_spectrum(weighted, keys, fs)
    # a scan of the lengths tells which of the three ways there are series for
    lengths = small_side(data.select("n").where("n > 0").distinct().withColumn("rows", _factor(F.col("n").cast("long"))))
    splits = F.expr(f"rows > 1 AND n div rows <= {_TASK_CELLS}L")
    some = lengths.agg(*(F.coalesce(F.bool_or(c), F.lit(False)) for c in (
        F.col("n") <= limit, (F.col("n") > limit) & splits, (F.col("n") > limit) & ~splits))).first()
    long = weighted.where(F.col("n") > limit).join(lengths, "n")
    ways = [
        _series_spectrum(weighted.where(F.col("n") <= limit), keys, fs) if some[0] else None,
        _factor_spectrum(long.where(splits), keys, fs) if some[1] else None,
        _grid_spectrum(long.where(~splits).drop("rows"), keys, fs) if some[2] else None,
    ]
    return reduce(DataFrame.unionByName, [w for w in ways if w is not None])
