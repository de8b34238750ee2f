"""Spike detection against a sample-by-sample loop."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import spikes as sp
from sigspark.plans.config import SpikeConfig
from sigspark.plans.detect import accepted_spikes, detect_spikes


def by_loop(x, cfg):
    """Walk the samples one by one; returns (crossing, peak, first, last, min, max, slope, ratio)."""
    x = np.asarray(x, dtype=float)
    n, std, out = len(x), x.std(), []
    if not x.any():
        return out
    allowed = 0
    for i in range(n):
        if allowed > i:
            continue
        if not (x[i] >= cfg.threshold * std or x[i] <= -cfg.threshold * std):
            allowed = allowed + 1 if cfg.replay_lag else allowed
            continue

        def window(at):
            lo, hi = at - cfg.before, at + cfg.after
            if lo >= 0 and hi < n:
                return lo, hi
            if cfg.edge == "ignore":
                return None
            return max(lo, 0), n - 1 if hi > n else hi

        w = window(i)
        if w is None or w[0] >= w[1]:
            continue
        part = x[w[0] : w[1]]
        peak = w[0] + int(np.argmax(part) if x[i] >= cfg.threshold * std else np.argmin(part))
        top = w[0] + int(np.argmax(np.abs(part)))
        v = window(peak)
        if v is None:
            continue
        cut = x[v[0] : v[1]]
        slope = None if top == i else (x[top] - x[i]) / (top - i)
        below, above = abs(cut.min() - std), abs(cut.max() - std)
        out.append((i, peak, v[0], v[1], cut.min(), cut.max(), slope, below / above if above else None))
        jump = cfg.dead + v[1] - w[1]
        allowed = allowed + jump if cfg.replay_lag else max(i + jump, i + 1)
    return out


def found(df):
    cols = ["crossing_idx", "peak_idx", "first_idx", "last_idx", "min_value", "max_value", "slope", "extrema_ratio"]
    out = {}
    for r in df.select("file", "column_id", "extracted", *cols).collect():
        out.setdefault((r["file"], r["column_id"]), []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def same(got, want):
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        for a, b in zip(g[4:], w[4:]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))


def series():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=900)
    noise[[0, 2, 5, 300, 302, 450, 895, 899]] += [9, -8, 7, 9, 9, -12, 9, 9]
    bursts = rng.normal(size=1200) * (rng.random(1200) < 0.2) * 5
    return {
        ("r/a.csv", "noise"): noise,
        ("r/a.csv", "bursts"): bursts,
        ("r/a.csv", "dense"): 5 + rng.random(700),  # offset channel: every sample crosses
        ("r/b.csv", "zero"): np.zeros(200),
        ("r/b.csv", "constant"): np.full(150, 2.0),
        ("r/b.csv", "ties"): np.tile([0, 0, 0, 4.0, 4.0, 0, 0, -4.0, -4.0, 0], 40),
        ("r/b.csv", "short"): np.array([5.0, 0, 0, 1]),
    }


@pytest.mark.parametrize("edge", ["ignore", "trim"])
@pytest.mark.parametrize("dead,before,after,k", [(12, 3, 5, 2.0), (0, 4, 6, 1.5), (30, 0, 4, 1.0)])
@pytest.mark.parametrize("block,fan", [(None, None), (80, 3)])
def test_against_loop(spark, long_signal, edge, dead, before, after, k, block, fan):
    cfg = SpikeConfig(1, k, dead, before, after, edge)
    data = series()
    got = found(detect_spikes(long_signal(data), cfg, block, fan))
    for key, x in data.items():
        same(got.get(key, []), by_loop(x, cfg))


@pytest.mark.parametrize("block,fan", [(None, None), (90, 3)])
def test_replay_lag(spark, long_signal, block, fan):
    data = series()
    rng = np.random.default_rng(9)
    lead = rng.normal(size=800)
    lead[:10] = 20  # many ignored crossings at the start
    lead[12:400:7] = 15
    data[("r/c.csv", "lead")] = lead
    cfg = SpikeConfig(1, 1.2, 12, 6, 5, "ignore", replay_lag=True)
    got = found(detect_spikes(long_signal(data), cfg, block, fan))
    for key, x in data.items():
        same(got.get(key, []), by_loop(x, cfg))
    assert by_loop(lead, cfg) != by_loop(lead, SpikeConfig(1, 1.2, 12, 6, 5, "ignore"))


@pytest.mark.parametrize("edge", ["ignore", "trim"])
def test_blocks_are_searched_in_bounded_pieces(spark, long_signal, monkeypatch, edge):
    """Samples of many short blocks lie one after another, a few blocks at a time; windows stay within their block."""
    monkeypatch.setattr(sp, "_SAMPLES_AT_ONCE", 150)
    data = series()
    rng = np.random.default_rng(4)
    for i in range(60):
        data[("r/many.csv", f"c{i}")] = rng.normal(size=12 + i)
    cfg = SpikeConfig(1, 1.2, 4, 3, 5, edge)
    got = found(detect_spikes(long_signal(data), cfg, 40, 3))
    for key, x in data.items():
        same(got.get(key, []), by_loop(x, cfg))


def test_long_channel_blocks(spark, long_signal):
    rng = np.random.default_rng(1)
    data = {("r", "long"): rng.normal(size=6000) * (1 + 4 * (rng.random(6000) < 0.05))}
    cfg = SpikeConfig(1, 2.0, 9, 3, 4)
    want = by_loop(data[("r", "long")], cfg)
    same(found(detect_spikes(long_signal(data), cfg, 64, 4))[("r", "long")], want)
    assert len(want) > 50


def test_table_columns_and_keys(spark, long_signal):
    cfg = SpikeConfig(1, 2.0, 12, 3, 5, targets={"a.csv": "A", "r/": "R"})
    table = detect_spikes(long_signal(series()), cfg)
    assert table.columns == sp.SPIKE_COLUMNS
    rows = table.collect()
    assert len({r["key"] for r in rows}) == len(rows)
    assert {r["target"] for r in rows} == {"R"}  # last matching key wins
    for r in rows:
        assert len(r["extracted"]) == r["last_idx"] - r["first_idx"]
        assert r["n_values"] in (900, 1200, 700, 150, 400)
    again = {r["key"] for r in detect_spikes(long_signal(series()), cfg).collect()}
    assert again == {r["key"] for r in rows}


def test_crossings_and_edges(spark, long_signal):
    sig = long_signal(series())
    data = series()
    crossed = sp.crossings(sig, 2.0)
    for (rec, ch), x in data.items():
        want = set(np.flatnonzero(np.abs(x) >= 2.0 * x.std())) if x.any() else set()
        got = {r["idx"] for r in crossed.where((F.col("recording_id") == rec) & (F.col("channel") == ch)).collect()}
        assert got == want
    inside = sp.edge_rule(crossed, 3, 5)
    assert inside.where((F.col("low") < 0) | (F.col("high") >= F.col("n"))).count() == 0
    trimmed = sp.edge_rule(crossed, 3, 5, "trim")
    assert trimmed.count() == crossed.count()
    assert trimmed.agg(F.min("low")).first()[0] == 0
    ends = trimmed.where(F.col("idx") + 5 > F.col("n"))
    assert ends.where(F.col("high") != F.col("n") - 1).count() == 0


def test_top_channels_before_detection(spark, long_signal):
    cfg = SpikeConfig(1, 1.5, 12, 3, 5, top_channels=1)
    chosen, _ = accepted_spikes(long_signal(series()), cfg)
    assert {(r[0], r[1]) for r in chosen.select("recording_id", "channel").distinct().collect()} == {
        ("r/a.csv", "bursts"), ("r/b.csv", "ties"),
    }


def test_config_checks():
    for bad in ({"after": 0}, {"edge": "x"}, {"threshold": -1.0}):
        kw = {"max_margin": 0.0} if "after" in bad else bad
        with pytest.raises(ValueError):
            SpikeConfig(**kw).validate()
    with pytest.raises(ValueError):
        SpikeConfig(1, 2, 3, 6, 5, replay_lag=True).validate()


def test_exits_and_chains_equal_a_walk():
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 40, 300):
        idx = np.sort(rng.choice(1000, size, replace=False)).astype(np.int64)
        step = rng.integers(-3, 25, size)
        states = np.arange(0, 60, dtype=np.int64)
        want = []
        for nxt in states.tolist():
            kept = []
            for p, (i, s) in enumerate(zip(idx.tolist(), step.tolist())):
                if i >= nxt:
                    kept.append(p)
                    nxt = max(i + s, i + 1)
            assert sp._chain(idx, step, int(states[len(want)])) == kept
            lists = idx, step, np.zeros(size, bool)
            if (step > 0).all():
                assert sp._replay(lists, int(states[len(want)]), 0) == kept
            want.append(nxt)
        assert sp._exits(idx, step, states).tolist() == want


def test_a_block_that_crosses_throughout_is_quick():
    idx = np.arange(1 << 18, dtype=np.int64)
    for step in (1, 2, 40):
        began = time.process_time()
        steps = np.full(len(idx), step)
        exits = sp._exits(idx, steps, np.arange(41, dtype=np.int64))
        assert len(sp._chain(idx, steps, 0)) == -(-len(idx) // step) and (exits >= len(idx)).all()
        assert time.process_time() - began < 1
