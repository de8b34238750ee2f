"""Signal operators, filters and spectra on small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions.harmonics import harmonic_rows, harmonics
from sigspark.operators import blocks as bl
from sigspark.operators import filters as fl
from sigspark.operators import fourier as fo
from sigspark.operators import signal as sg
from sigspark.plans.config import ProcessConfig
from sigspark.plans.process import process, process_to_dataset, run_name


def arrays(df, column="value", order="idx"):
    rows = df.groupBy(*sg.series_keys(df)).agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("s")).collect()
    keys = sg.series_keys(df)
    return {tuple(r[k] for k in keys): np.array([x[1] for x in r["s"]]) for r in rows}


@pytest.fixture(scope="module")
def noise(long_signal):
    rng = np.random.default_rng(0)
    data = {("r0", "a"): rng.normal(size=1003), ("r0", "b"): 3 * rng.normal(size=1003), ("r1", "a"): rng.normal(size=640)}
    return data, long_signal(data, 0.001)


def test_to_signal(spark):
    wide = spark.createDataFrame([("r", 2.0, 5.0, 1), ("r", 1.0, 6.0, 3), ("q", 0.0, 7.0, 2)], "recording_id string, `TimeStamp [s]` double, `E.1` double, E2 long")
    rows = sg.to_signal(wide, ["TimeStamp [s]"]).orderBy("recording_id", "channel", "idx").collect()
    assert [(r.recording_id, r.channel, r.channel_pos, r.idx, r.n, r.t, r.value) for r in rows] == [
        ("q", "E.1", 0, 0, 1, 0.0, 7.0), ("q", "E2", 1, 0, 1, 0.0, 2.0),
        ("r", "E.1", 0, 0, 2, 1.0, 6.0), ("r", "E.1", 0, 1, 2, 2.0, 5.0),
        ("r", "E2", 1, 0, 2, 1.0, 3.0), ("r", "E2", 1, 1, 2, 2.0, 1.0),
    ]


def test_drop_channels(noise):
    _, sig = noise
    assert {r[0] for r in sg.drop_channels(sig, "a").select("channel").distinct().collect()} == {"b"}
    assert sg.drop_channels(sig, "").count() == sig.count()
    assert sg.drop_channels(sig, "A").count() == sig.count()


def test_top_channels_ties_and_order(long_signal):
    sig = long_signal({("r", "x"): [0, 1, 0, 1], ("r", "y"): [1, 0, 1, 0], ("r", "z"): [0, 0, 0, 0.1]})
    assert {r[0] for r in sg.top_n_channels(sig, 1).select("channel").distinct().collect()} == {"x"}
    assert {r[0] for r in sg.top_n_channels(sig, 2).select("channel").distinct().collect()} == {"x", "y"}


def test_segment_drops_the_remainder(noise):
    data, sig = noise
    got = arrays(sg.segment(sig, 4))
    for (rec, ch), x in data.items():
        size = len(x) // 4
        for s in range(4):
            np.testing.assert_array_equal(got[(rec, s, ch)], x[s * size : (s + 1) * size])
    assert len(got) == 12


def test_channel_mean(noise):
    data, sig = noise
    got = arrays(sg.channel_mean(sig))
    np.testing.assert_allclose(got[("r0", "mean")], np.round((data[("r0", "a")] + data[("r0", "b")]) / 2, 3), atol=1e-12)


def test_resample(noise):
    data, sig = noise
    mean, linear = arrays(sg.resample(sig, 7)), arrays(sg.resample(sig, 11, "linear"))
    times = arrays(sg.resample(sig, 11, "linear"), "t")
    for key, x in data.items():
        n = len(x)
        bins = np.arange(n) * 7 // n
        np.testing.assert_allclose(mean[key], [x[bins == b].mean() for b in range(7)])
        grid = np.linspace(0, n - 1, 11)
        np.testing.assert_allclose(linear[key], np.interp(grid, np.arange(n), x))
        np.testing.assert_allclose(times[key], grid * 0.001)


def test_resample_same_length_and_too_long(noise, long_signal):
    sig = long_signal({("r", "a"): [1.0, 5.0, 2.0]})
    for mode in ("mean", "linear"):
        np.testing.assert_allclose(arrays(sg.resample(sig, 3, mode))[("r", "a")], [1, 5, 2])
        with pytest.raises(Exception, match="cannot shrink"):
            sg.resample(sig, 4, mode).collect()
    with pytest.raises(ValueError):
        sg.resample(sig, 1, "linear")


def test_hann(noise):
    data, sig = noise
    got = arrays(sg.hann(sig))
    for key, x in data.items():
        np.testing.assert_allclose(got[key], x * np.hanning(len(x)), atol=1e-12)


def test_blocks_hold_their_margins(noise):
    data, sig = noise
    rows = bl.to_blocks(sig, ["recording_id", "channel"], 100, 30, 50).collect()
    assert len(rows) == 11 + 11 + 7
    for r in rows:
        x = data[(r["recording_id"], r["channel"])]
        lo, hi = max(r["block"] * 100 - 30, 0), min((r["block"] + 1) * 100 + 50, len(x))
        assert r["start"] == lo
        np.testing.assert_array_equal(r["values"], x[lo:hi])


@pytest.mark.parametrize("window", [True, False])
def test_spectrum(noise, window):
    data, sig = noise
    whole = fo.spectrum(sig, 1000, window)
    pieces = fo.spectrum(sig, 1000, window, direct=700)  # the 1003-sample channels are split, 17 by 59
    few = sg.spectrum_bins(sig, 1000, [0, 3, 40], window)
    a, b, c = (arrays(x, "magnitude", "bin") for x in (whole, pieces, few))
    freq = arrays(whole, "freq_hz", "bin")
    for key, x in data.items():
        n = len(x)
        want = np.abs(np.fft.fft(x * (np.hanning(n) if window else 1)))[: n // 2] / n
        np.testing.assert_allclose(a[key], want, atol=1e-12)
        np.testing.assert_allclose(b[key], want, atol=1e-12)
        np.testing.assert_allclose(c[key], want[[0, 3, 40]], atol=1e-12)
        np.testing.assert_allclose(freq[key], np.arange(n // 2) * 1000 / n)


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_long_spectra_by_factors_and_by_chirp(long_signal, monkeypatch, cells):
    monkeypatch.setattr(fo, "_TASK_CELLS", cells)
    rng = np.random.default_rng(8)
    # two factors of any parity, equal ones, powers of two, twice a prime, a prime, and one that is transformed whole
    data = {("r", f"c{n}"): rng.standard_normal(n) for n in (60, 61, 64, 81, 90, 122, 49, 105, 12)}
    data[("q", "c60")] = rng.standard_normal(60)
    got = arrays(fo.spectrum(long_signal(data), 1000, False, direct=16), "magnitude", "bin")
    assert set(got) == set(data)
    for key, x in data.items():
        np.testing.assert_allclose(got[key], np.abs(np.fft.fft(x))[: len(x) // 2] / len(x), atol=1e-12)


def test_sine_peaks_at_its_bin(long_signal):
    x = np.sin(2 * np.pi * 50 * np.arange(400) / 1000)
    s = fo.spectrum(long_signal({("r", "a"): x}), 1000)
    assert s.orderBy(F.desc("magnitude")).first()["freq_hz"] == 50.0


def test_half_turns_for_long_series():
    n = (1 << 40) + 15
    j = np.array([0, 1, 12345, (1 << 39) + 7, n - 1], dtype=np.int64)
    want = [np.exp(-1j * np.pi * ((int(v) * int(v)) % (2 * n)) / n) for v in j]
    np.testing.assert_allclose(fo._half_turns(j, n), want, atol=1e-9)


TYPES = [(3, "lowpass", (50,)), (4, "highpass", (50,)), (2, "bandpass", (20, 60)), (3, "bandstop", (90, 110))]


@pytest.mark.parametrize("order,btype,cuts", TYPES)
def test_design(order, btype, cuts):
    f = fl.design_butterworth(order, btype, cuts, 1000)

    def gain(freq):
        z = np.exp(-2j * np.pi * freq / 1000)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in f.sections]))

    for c in cuts:
        assert gain(c) == pytest.approx(2**-0.5, rel=1e-9)
    inside = {"lowpass": 0, "highpass": 500, "bandpass": None, "bandstop": 0}[btype]
    if inside is not None:
        assert gain(inside) == pytest.approx(1, rel=1e-9)
    assert f.pad == 3 * (order * len(cuts) + 1)


def test_recurrence_matches_a_plain_loop():
    x = np.random.default_rng(4).normal(size=700).cumsum()
    f = fl.design_butterworth(3, "bandpass", (20, 400), 1000)
    y, level = x.copy(), x[0]
    for b0, b1, b2, a1, a2 in f.sections:
        g = (b0 + b1 + b2) / (1 + a1 + a2)
        s1, s2, out = (g - b0) * level, (b2 - a2 * g) * level, np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        y, level = out, g * level
    np.testing.assert_allclose(fl._run(fl.prepare(f), x), y, atol=1e-9)


@pytest.mark.parametrize("order,btype,cuts", TYPES)
def test_filter_blocks_agree_with_whole_series(noise, order, btype, cuts):
    data, sig = noise
    f = fl.design_butterworth(order, btype, cuts, 1000)
    got = arrays(fl.butter_filter(sig, order, btype, cuts, 1000))
    for key, x in data.items():
        np.testing.assert_allclose(got[key], fl.zero_phase(fl.prepare(f), x), atol=1e-10)


@pytest.mark.parametrize("block, group", [(1000, 2), (333, 1024), (50, 3)])
def test_filter_many_blocks(long_signal, block, group):
    """Blocks without margins, of narrow filters that settle far slower than a block is long."""
    rng = np.random.default_rng(6)
    data = {("r", "a"): rng.normal(size=16000).cumsum(), ("r", "b"): rng.normal(size=999), ("s", "a"): rng.normal(size=2 * block)}
    sig = long_signal(data, 0.001)
    chain = fl.design_chain(2, "bandpass", (20, 150), [100, 200], 1000)
    out = fl.apply_filters(sig, chain, block, group=group)
    got, times = arrays(out), arrays(out, "t")
    for key, x in data.items():
        for f in chain:
            x = fl.zero_phase(fl.prepare(f), x)
        np.testing.assert_allclose(got[key], x, atol=1e-8)
        np.testing.assert_allclose(times[key], np.arange(len(x)) * 0.001)


def test_many_groups_of_blocks_at_once():
    """Groups of any sizes are folded together, and blocks of one length filtered together, as one by one."""
    rng = np.random.default_rng(5)
    kernel = fl.prepare(fl.design_butterworth(2, "highpass", [5], 1000))
    jump, counts = kernel.jumps[50], rng.integers(0, 4, 500)
    pushes, entry = rng.normal(size=(int(counts.sum()), 2)), rng.normal(size=(500, 2))
    before, after = fl._handed(pushes, counts, entry, jump)
    at = 0
    for g, n in enumerate(counts):
        state = entry[g]
        for _ in range(n):
            assert np.allclose(before[at], state)
            state, at = state @ jump + pushes[at], at + 1
        assert np.allclose(after[g], state)
    x = rng.normal(size=(7, 300))
    for head in (False, True):
        for tail in (False, True):
            many = fl._forward(kernel, x, entry[:7], head, tail)
            back = fl._backward(kernel, many[0], entry[7:14], head, tail)
            for i in range(7):
                one = fl._forward(kernel, x[i], entry[i], head, tail)
                alone = fl._backward(kernel, one[0], entry[7 + i], head, tail)
                assert all(np.allclose(a[i], b) for a, b in zip((*many, *back), (*one, *alone)))
    parts = fl._alike(np.array([5, 9, 5, 5]), np.array([True, False, True, False]), np.zeros(4, dtype=bool))
    assert sorted(p.tolist() for p in parts) == [[0, 2], [1], [3]]


def test_filter_blocks_are_bounded():
    narrow = fl.design_chain(2, None, (), [50 * k for k in range(1, 9)], 30_000)
    assert max(f.pad for f in narrow) < fl.BLOCK and 2 * fl.BLOCK == 1 << 18


def test_filter_keeps_null_keys_apart(spark):
    rows = [(r, c, i, 400, float((i * (7 if c else 3)) % 11)) for r in ("r", None) for c in ("a", None) for i in range(400)]
    sig = spark.createDataFrame(rows, "recording_id string, channel string, idx long, n long, value double")
    got = {}
    for r in fl.butter_filter(sig, 2, "lowpass", [50], 1000, 60).orderBy("idx").collect():
        got.setdefault((r["recording_id"], r["channel"]), []).append(r["value"])
    kernel = fl.prepare(fl.design_butterworth(2, "lowpass", [50], 1000))
    for (_, c), values in got.items():
        x = np.array([float((i * (7 if c else 3)) % 11) for i in range(400)])
        np.testing.assert_allclose(values, fl.zero_phase(kernel, x), atol=1e-9)
    assert len(got) == 4


def test_filter_properties(long_signal):
    t = np.arange(4000) / 1000
    sig = long_signal({("r", "flat"): np.full(4000, 2.5), ("r", "hum"): np.sin(2 * np.pi * 100 * t), ("r", "fast"): np.sin(2 * np.pi * 300 * t)})
    low = arrays(fl.butter_filter(sig, 3, "lowpass", (50,), 1000))
    np.testing.assert_allclose(low[("r", "flat")], 2.5, atol=1e-9)
    assert np.abs(low[("r", "fast")][500:-500]).max() < 1e-4
    notch = arrays(fl.notch_harmonics(sig, [100], 2, 1000))
    assert np.abs(notch[("r", "hum")][1500:-1500]).max() < 0.1
    assert np.abs(notch[("r", "fast")][1500:-1500]).max() > 0.9


def test_filter_refuses_short_series(long_signal):
    with pytest.raises(Exception, match="too short"):
        fl.butter_filter(long_signal({("r", "a"): [1.0] * 12}), 3, "lowpass", (50,), 1000).collect()


def test_harmonics(spark):
    assert harmonics(100, 10, "Odd") == [100, 300, 500, 700, 900]
    assert harmonics(50, 4, "Even") == [100, 200] and harmonics(50, 3) == [50, 100, 150]
    rows = harmonic_rows(spark.createDataFrame([(10,)], "f long"), "f", 1, "Even").collect()
    assert rows == []


def test_process_chain_follows_the_steps(long_signal):
    rng = np.random.default_rng(2)
    data = {("d/condA/r1.csv", "E1"): rng.normal(size=900), ("d/condA/r1.csv", "E2"): 2 * rng.normal(size=900),
            ("d/condA/r1.csv", "E3"): 0.1 * rng.normal(size=900), ("d/condB/r2.csv", "E1"): rng.normal(size=900),
            ("d/condB/r2.csv", "E2"): rng.normal(size=900), ("d/other/r3.csv", "E1"): rng.normal(size=900)}
    cfg = ProcessConfig(top_channels=2, segments=3, filter_order=2, filter_type="highpass", cuts=(30,), harmonic_freq=100,
                        harmonic_nth=2, fs=1000, fft=True, average=True, shrink=15, dataset=True,
                        targets={"condA": "A", "condB": ""})
    rows = process_to_dataset(long_signal(data, 0.001), cfg).collect()
    assert len(rows) == 6 and {r["label"] for r in rows} == {"A", "condB"}
    chain = fl.design_chain(2, "highpass", (30,), [100, 200], 1000)

    def expect(rec, seg, channels):
        spectra = []
        for ch in channels:
            y = data[(rec, ch)][seg * 300 : (seg + 1) * 300]
            for f in chain:
                y = fl.zero_phase(fl.prepare(f), y)
            spectra.append(np.abs(np.fft.fft(y * np.hanning(300)))[:150] / 300)
        mean = np.round(np.mean(spectra, axis=0), 3)
        return mean.reshape(15, 10).mean(axis=1)

    for r in rows:
        channels = ["E1", "E2"]
        np.testing.assert_allclose(r["features"], expect(r["recording_id"], r["segment_id"], channels), atol=1.1e-4)


def test_untargeted(long_signal):
    sig = long_signal({("x/r.csv", "E"): [1.0, 2.0], ("y/r.csv", "E"): [1.0, 2.0]})
    base = {"average": True, "dataset": True, "targets": {"x/": "X"}}
    assert process_to_dataset(sig, ProcessConfig(**base)).count() == 1
    kept = process_to_dataset(sig, ProcessConfig(**base, untargeted="keep")).collect()
    assert sorted((r["label"] or "") for r in kept) == ["", "X"]
    with pytest.raises(Exception, match="no target"):
        process_to_dataset(sig, ProcessConfig(**base, untargeted="error")).collect()


def test_process_without_steps(noise):
    _, sig = noise
    assert process(sig, ProcessConfig(time_like="")).count() == sig.count()


def test_run_name():
    cfg = ProcessConfig(top_channels=35, segments=20, keyword="a/b")
    name = run_name(cfg)
    assert name.startswith("a-b__") and "top_channels=35" in name and "segments=20" in name
    assert name == run_name(ProcessConfig(top_channels=35, segments=20, keyword="a/b"))
    assert name != run_name(ProcessConfig(top_channels=35, segments=21, keyword="a/b"))
    assert run_name(ProcessConfig(file_name="x")).startswith("x__") and run_name(ProcessConfig()).startswith("plain__")


@pytest.mark.parametrize("bad", [
    {"segments": 0}, {"fft": True}, {"filter_type": "lowpass", "fs": 100}, {"filter_type": "bandpass", "cuts": (5, 2), "fs": 100},
    {"filter_type": "lowpass", "cuts": (60,), "fs": 100}, {"dataset": True}, {"harmonic_freq": 50, "fs": 1000},
    {"harmonic_freq": 50, "harmonic_nth": 20, "fs": 1000}, {"untargeted": "x"}, {"shrink_mode": "x"}, {"skip_rows": -1},
])
def test_process_config_checks(bad):
    with pytest.raises(ValueError):
        ProcessConfig(**bad).validate()
