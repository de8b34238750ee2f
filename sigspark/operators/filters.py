"""Butterworth filters, zero-phase, on long signals.

Coefficients are designed on the driver from the textbook analog prototype and the bilinear transform. A series is cut
into blocks of bounded length, without margins, whatever the filter. A pass over a block is an affine map of the state
it is entered with: a power of the filter's step matrix, and a push that depends on the samples. The pushes of a series
are small rows; they are folded in groups, the groups among each other, and the entry states handed back down - forward
along the series, then backward. So the blocks of one long series are filtered by many tasks, exactly as if in one.
Only the two true ends of a series get the usual odd extension.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.blocks import collect_in_order
from sigspark.operators.scale import freeze
from sigspark.operators.signal import series_keys

# A series' last block takes what is left over, so blocks hold fewer than twice as many samples.
BLOCK = 1 << 17
# Blocks whose pushes are folded by one task.
_GROUP = 1024
# Entry states are sent to every task up to this size.
_BROADCAST_BYTES = 32 << 20
_ROWS = 128


class Filter(NamedTuple):
    """A digital filter as second-order sections ``(b0, b1, b2, a1, a2)``, with its poles."""

    sections: tuple[tuple[float, ...], ...]
    poles: tuple[complex, ...]

    @property
    def pad(self) -> int:
        """Samples of odd extension at each end: three times the number of coefficients."""
        return 3 * (len(self.poles) + 1)


def design_butterworth(order: int, btype: str, cuts: Sequence[float], fs: float) -> Filter:
    """Digital Butterworth filter (lowpass, highpass, bandpass or bandstop) of the given order.

    Kept as sections rather than one long polynomial: narrow bands at a high sampling rate put all poles next to the
    unit circle, where the polynomial form loses its digits.
    """
    edges = [2 * fs * math.tan(math.pi * f / fs) for f in cuts]
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    c = 2 * fs
    if btype == "lowpass":
        analog, zeros, gain = proto * edges[0], [], edges[0] ** order
    elif btype == "highpass":
        analog, zeros, gain = edges[0] / proto, [0.0] * order, np.real(1 / np.prod(-proto))
    elif btype in ("bandpass", "bandstop"):
        width, centre2 = edges[1] - edges[0], edges[0] * edges[1]
        half = proto * width / 2 if btype == "bandpass" else (width / 2) / proto
        root = np.sqrt(half * half - centre2 + 0j)
        analog = np.concatenate([half + root, half - root])
        if btype == "bandpass":
            zeros, gain = [0.0] * order, width**order
        else:
            centre = 1j * math.sqrt(centre2)
            zeros, gain = [centre, -centre] * order, np.real(1 / np.prod(-proto))
    else:
        raise ValueError(f"unknown filter type {btype!r}")
    zeros = np.array(zeros, dtype=complex)
    gain = gain * np.real(np.prod((c - zeros) / c) / np.prod((c - analog) / c)) * c ** (len(zeros) - len(analog))
    poles = (c + analog) / (c - analog)
    zeros = np.append((c + zeros) / (c - zeros), -np.ones(len(analog) - len(zeros)))
    return Filter(_sections(zeros, poles, float(gain)), tuple(poles))


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> tuple[tuple[float, ...], ...]:
    """Group conjugate (or real) poles in twos, each with two zeros; a single left-over pole gets one."""
    upper = sorted((p for p in poles if p.imag > 1e-14), key=abs)
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-14), key=abs)
    groups = [[p, p.conjugate()] for p in upper] + [real[i : i + 2] for i in range(0, len(real), 2)]
    pool = list(zeros)
    # Opposite ends of this order meet in one section: +1 with -1 for a band-pass, a conjugate pair for a band-stop.
    pool.sort(key=lambda z: (round(z.imag, 12), z.real))
    share = abs(gain) ** (1 / len(groups))
    out = []
    for i, group in enumerate(groups):
        picked = [pool.pop(0)] + ([pool.pop()] if len(group) == 2 else [])
        scale = share * (np.sign(gain) if i == 0 else 1.0)
        b = np.pad(scale * np.real(np.poly(picked)), (0, 2 - len(picked)))
        a = np.pad(np.real(np.poly(group)), (0, 2 - len(group)))
        out.append((*b, a[1], a[2]))
    return tuple(tuple(float(v) for v in row) for row in out)


def design_chain(
    order: int, btype: str | None, cuts: Sequence[float], harmonics: Sequence[float], fs: float
) -> list[Filter]:
    """The main filter, if any, followed by a 4 Hz wide band-stop at each harmonic."""
    chain = [design_butterworth(order, btype, cuts, fs)] if btype else []
    return chain + [design_butterworth(order, "bandstop", (h - 2, h + 2), fs) for h in harmonics]


class _Kernel(NamedTuple):
    """Matrices that advance a filter by a row of samples at a time."""

    pad: int
    toeplitz: np.ndarray
    observe: np.ndarray
    carry: np.ndarray
    jumps: np.ndarray  # over 0 to _ROWS samples
    rest: np.ndarray


def prepare(filt: Filter) -> _Kernel:
    """State-space form of the section cascade, raised to whole rows."""
    size = 2 * len(filt.sections)
    step, feed = np.zeros((size, size)), np.zeros(size)
    out, through = np.zeros(size), 1.0  # output of the cascade so far: out . state + through * input
    for i, (b0, b1, b2, a1, a2) in enumerate(filt.sections):
        s = 2 * i
        for row, (b, a) in enumerate(((b1, a1), (b2, a2))):
            step[s + row] = (b - a * b0) * out
            step[s + row, s] -= a
            feed[s + row] = (b - a * b0) * through
        step[s, s + 1] += 1.0
        out, through = b0 * out, b0 * through
        out[s] += 1.0
    rest = np.linalg.solve(np.eye(size) - step, feed)
    powers = [np.eye(size)]
    for _ in range(_ROWS):
        powers.append(step @ powers[-1])
    observe = np.array([out @ p for p in powers[:_ROWS]])  # state at row start -> output k
    response = np.concatenate([[through], observe[:-1] @ feed])  # input k samples ago -> output
    lag = np.subtract.outer(np.arange(_ROWS), np.arange(_ROWS))
    toeplitz = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    carry = np.array([powers[_ROWS - 1 - j] @ feed for j in range(_ROWS)])  # row of inputs -> next state
    return _Kernel(filt.pad, toeplitz.T.copy(), observe.T.copy(), carry, np.array([p.T for p in powers]), rest)


def _pass(kernel: _Kernel, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One causal pass from a state: output and last state. ``x``: one block, or blocks of one length with a state each."""
    length, size = x.shape[-1], len(kernel.rest)
    rows, left = divmod(length, _ROWS)
    grid = np.zeros((*x.shape[:-1], (rows + 1) * _ROWS))
    grid[..., :length] = x
    grid = grid.reshape(*x.shape[:-1], rows + 1, _ROWS)
    pushes = grid[..., :rows, :] @ kernel.carry
    states = np.empty((*x.shape[:-1], rows + 1, size))
    jump = kernel.jumps[_ROWS]
    for r in range(rows):
        states[..., r, :] = state
        state = state @ jump + pushes[..., r, :]
    states[..., rows, :] = state
    last = state @ kernel.jumps[left] + grid[..., rows, :left] @ kernel.carry[_ROWS - left :]
    out = grid.reshape(-1, _ROWS) @ kernel.toeplitz + states.reshape(-1, size) @ kernel.observe
    return out.reshape(*x.shape[:-1], -1)[..., :length], last


def _run(kernel: _Kernel, x: np.ndarray) -> np.ndarray:
    """One causal pass, starting at rest on the first sample's level."""
    return _pass(kernel, x, kernel.rest * x[0])[0]


def _before(kernel: _Kernel, x: np.ndarray) -> np.ndarray:
    """Odd extension in front of a series."""
    return 2 * x[..., :1] - x[..., kernel.pad : 0 : -1]


def _after(kernel: _Kernel, x: np.ndarray) -> np.ndarray:
    return 2 * x[..., -1:] - x[..., -2 : -kernel.pad - 2 : -1]


def zero_phase(kernel: _Kernel, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd extension at both ends."""
    pad = kernel.pad
    if len(x) <= pad:
        raise ValueError(f"a series of {len(x)} samples is too short to filter: more than {pad} are needed")
    ext = np.concatenate([_before(kernel, x), x, _after(kernel, x)])
    return _run(kernel, _run(kernel, ext)[::-1])[::-1][pad:-pad]


def _forward(kernel: _Kernel, x: np.ndarray, state, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward pass over a block, or blocks of one length, and the state it leaves; a series' first block starts at rest."""
    if first:
        x = np.concatenate([_before(kernel, x), x], axis=-1)
        state = kernel.rest * x[..., :1]
    return _pass(kernel, np.concatenate([x, _after(kernel, x)], axis=-1) if last else x, state)


def _backward(kernel: _Kernel, y: np.ndarray, state, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Backward pass over forward output, cut to the blocks' own samples, and the state it leaves."""
    y = y[..., ::-1]
    z, state = _pass(kernel, y, kernel.rest * y[..., :1] if last else state)
    z = z[..., ::-1][..., kernel.pad if first else 0 :]
    return z[..., : z.shape[-1] - kernel.pad] if last else z, state


def _samples(values) -> np.ndarray:
    x = np.asarray(values, dtype=float)
    if np.isnan(x).any():
        raise ValueError("a series to be filtered holds a null or NaN sample: drop or fill it before")
    return x


def _handed(pushes: np.ndarray, counts: np.ndarray, entry: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each push and after the last one of each group. ``pushes`` of the groups lie one after another."""
    states, out, first = entry.copy(), np.empty_like(pushes), np.cumsum(counts) - counts
    for i in range(counts.max(initial=0)):
        going = np.flatnonzero(counts > i)
        at = first[going] + i
        out[at] = states[going]
        states[going] = states[going] @ jump + pushes[at]
    return out, states


def _stacked(lists: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat lists of states as one matrix, and how many states each list holds."""
    flat = [np.asarray(x, dtype=float) for x in lists]
    return np.concatenate([*flat, np.zeros(0)]).reshape(-1, size), np.array([len(x) // size for x in flat], dtype=np.int64)


def _entry_states(pushes: DataFrame, kernel: _Kernel, length: int, group: int) -> DataFrame:
    """``series, block, state``: what each block is entered with. ``pushes``: ``series, block, place, push``, ``place``
    the block's number in the direction of the pass; the first one's push is the whole state that it leaves.

    A push per block, folded in groups of ``group`` blocks, then one row per group. A task folds many groups at once.
    """
    step = np.linalg.matrix_power(kernel.jumps[1], length)
    far = np.linalg.matrix_power(step, group)
    size = len(kernel.rest)
    doubles = T.ArrayType(T.DoubleType())

    @F.pandas_udf(doubles)
    def folded(lists: pd.Series) -> pd.Series:
        rows, counts = _stacked(lists, size)
        return pd.Series(list(_handed(rows, counts, np.zeros((len(counts), size)), step)[1]))

    def entered(jump: np.ndarray):
        @F.pandas_udf(doubles)
        def states(lists: pd.Series, entry: pd.Series) -> pd.Series:
            rows, counts = _stacked(lists, size)
            out = _handed(rows, counts, np.stack(entry.to_list()) if len(entry) else np.zeros((0, size)), jump)[0]
            return pd.Series([x.reshape(-1) for x in np.split(out, np.cumsum(counts)[:-1])][: len(counts)])

        return states

    def gathered(rows: DataFrame, by: Sequence[str], *fields: str) -> DataFrame:
        held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_held"))
        return held.withColumn("_pushes", F.flatten("_held.push"))

    def spread(rows: DataFrame, to: str) -> DataFrame:
        """One row for each state of the flat list ``_states``, beside its place in ``_held``."""
        each = F.transform("_held", lambda h, i: F.struct(h[to].alias(to), F.slice("_states", i * size + 1, size).alias("state")))
        return rows.withColumn("_each", F.explode(each)).select("series", *([] if to == "part" else ["part"]), f"_each.{to}", "_each.state")

    groups = gathered(pushes.withColumn("part", F.expr(f"place DIV {group}")), ["series", "part"], "place", "block", "push")
    tops = gathered(groups.select("series", "part", folded("_pushes").alias("push")), ["series"], "part", "push")
    rest = F.array_repeat(F.lit(0.0), size)
    entries = spread(tops.withColumn("_states", entered(far)("_pushes", rest)), "part").withColumnRenamed("state", "entry")
    within = groups.join(entries, ["series", "part"]).withColumn("_states", entered(step)("_pushes", "entry"))
    states = freeze(spread(within, "block").drop("part"))
    small = states.count() * (8 * size + 64) <= _BROADCAST_BYTES
    return F.broadcast(states) if small else states.hint("shuffle_hash")


def _alike(lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Rows of one length and place, at most about ``BLOCK`` samples at a time."""
    kinds = np.stack([lengths, first, last], axis=1).astype(np.int64)
    out = []
    for n, head, tail in np.unique(kinds, axis=0):
        rows, most = np.flatnonzero((kinds == (n, head, tail)).all(axis=1)), max(1, BLOCK // max(int(n), _ROWS))
        out += [rows[i : i + most] for i in range(0, len(rows), most)]
    return out


def _filter_long(blocks: DataFrame, kernels: Sequence[_Kernel], length: int, group: int) -> DataFrame:
    """``blocks`` of series of several blocks, filtered. Each pass is stored, so that its pushes and its samples agree."""
    kind = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("push", T.ArrayType(T.DoubleType()))])

    def step(pass_: str, kernel: _Kernel, then: _Kernel | None):
        """A pass over a block, and the push of the pass that follows it."""

        @F.pandas_udf(kind)
        def done(values: pd.Series, states: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
            size, (values, states) = len(kernel.rest), (values.to_list(), states.to_list())
            first, last = first.to_numpy(dtype=bool), last.to_numpy(dtype=bool)
            out, pushes = [None] * len(values), [None] * len(values)
            for rows in _alike(np.array([len(x) for x in values], dtype=np.int64), first, last):
                x, head, tail = np.stack([np.asarray(values[r], dtype=float) for r in rows]), first[rows[0]], last[rows[0]]
                if pass_ != "none":
                    state = np.stack([np.asarray(states[r], dtype=float) for r in rows])
                if pass_ == "forward":
                    y = _forward(kernel, x, state, head, tail)[0]
                    push = _backward(kernel, y, np.zeros((len(rows), size)), head, tail)[1]
                else:
                    y = _samples(x) if pass_ == "none" else _backward(kernel, x, state, head, tail)[0]
                    push = np.zeros((len(rows), 0)) if then is None else _forward(
                        then, y, np.zeros((len(rows), len(then.rest))), head, tail)[1]
                for i, r in enumerate(rows):
                    out[r], pushes[r] = y[i], push[i]
            return pd.DataFrame({"values": out, "push": pushes})

        return done

    def through(rows: DataFrame, udf, states: DataFrame | None, stored: bool = True) -> DataFrame:
        rows = rows.withColumn("state", F.lit(None).cast("array<double>")) if states is None else rows.join(states, ["series", "block"])
        rows = rows.withColumn("done", udf("values", "state", F.col("block") == 0, F.col("block") == F.col("blocks") - 1))
        rows = rows.withColumns({"values": F.col("done.values"), "push": F.col("done.push")}).drop("done", "state")
        return freeze(rows) if stored else rows

    rows = through(blocks, step("none", kernels[0], kernels[0]), None)
    for kernel, then in zip(kernels, [*kernels[1:], None]):
        place = rows.select("series", "block", F.col("block").alias("place"), "push")
        rows = through(rows, step("forward", kernel, None), _entry_states(place, kernel, length, group))
        place = rows.select("series", "block", (F.col("blocks") - 1 - F.col("block")).alias("place"), "push")
        rows = through(rows, step("backward", kernel, then), _entry_states(place, kernel, length, group), then is not None)
    return rows


def apply_filters(
    signal: DataFrame, chain: Sequence[Filter], block: int | None = None, longest: int | None = None, group: int = _GROUP
) -> DataFrame:
    """Apply filters in sequence to every series; samples are shuffled once. ``longest``: largest series length, if known.

    Blocks hold ``block`` samples (2^17 if not given), the last one of a series fewer than twice as many. A null or NaN
    sample would reach the whole series through the recursion: it raises an error, whatever the blocks. Drop or fill
    such samples before.
    """
    if not chain:
        return signal
    length = max(BLOCK if block is None else block, 2 + max(f.pad for f in chain))
    keys = series_keys(signal)
    carry = ["t"] if "t" in signal.columns else []
    if "channel_pos" in signal.columns:
        keys = [*keys, "channel_pos"]
    count = F.greatest(F.expr(f"n DIV {length}"), F.lit(1))
    own = F.least(F.expr(f"idx DIV {length}"), count - 1)
    held = signal.select(*keys, "idx", "n", "value", *carry, own.alias("block"))
    blocks = collect_in_order(held, [*keys, "block"], ["value", *carry])
    kernels = [prepare(f) for f in chain]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def filtered(values: pd.Series) -> pd.Series:
        out = []
        for x in values:
            y = _samples(x)
            for kernel in kernels:
                y = zero_phase(kernel, y)
            out.append(y)
        return pd.Series(out)

    done = blocks
    if longest is None or longest >= 2 * length:
        done = freeze(blocks)
        longest = done.agg(F.max("n")).first()[0] or 0
    long = done.where(F.col("n") >= 2 * length)
    done = (done if longest < 2 * length else done.where(F.col("n") < 2 * length)).withColumn("values", filtered("values"))
    if longest >= 2 * length:
        # a name for each series that is never null
        long = long.withColumn("series", F.to_json(F.struct(*keys))).withColumn("blocks", count)
        done = done.unionByName(_filter_long(long, kernels, length, group).select(*done.columns))
    columns = [F.col("values").alias("value"), *[F.col("ts").alias("t") for _ in carry]]
    rows = done.select(*keys, "n", "block", F.posexplode(F.arrays_zip(*columns)).alias("_pos", "_row"))
    return rows.select(
        *keys, (F.col("block") * length + F.col("_pos")).alias("idx"), "n", "_row.value",
        *[F.when(~F.isnan("_row.t"), F.col("_row.t")).alias("t") for _ in carry]
    )


def butter_filter(
    signal: DataFrame, order: int, btype: str, cuts: Sequence[float], fs: float, block: int | None = None
) -> DataFrame:
    """Zero-phase Butterworth filter on every series."""
    return apply_filters(signal, design_chain(order, btype, cuts, (), fs), block)


def notch_harmonics(
    signal: DataFrame, harmonics: Sequence[float], order: int, fs: float, block: int | None = None
) -> DataFrame:
    """Band-stop from 2 Hz below to 2 Hz above each harmonic, one after the other."""
    return apply_filters(signal, design_chain(order, None, (), harmonics, fs), block)
