"""Files in, files out."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions.columns import label_from_text
from sigspark.operators import raster as ra
from sigspark.plans.config import ProcessConfig, SpikeConfig
from sigspark.plans.detect import detect_files, detect_spikes
from sigspark.plans.process import process_files
from sigspark.sources import files as fs
from sigspark.sources import recordings as rec
from sigspark.sources import tables as tb


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Recordings of two layouts, one with CRLF ends, one with trailing blank lines, plus files to leave out."""
    root = tmp_path_factory.mktemp("DATA")
    rng = np.random.default_rng(0)
    data = {}
    for cond, name, channels, end, tail in (
        ("condA", "rec1_Analog.csv", ["E1", "E2", "E3"], "\n", ""),
        ("condA", "rec2_Analog.csv", ["E1", "E2", "E3"], "\r\n", ""),
        ("condB", "rec3_Analog.csv", ["E9", "E1"], "\n", "\n\n"),
    ):
        path = root / cond / "sample1" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        x = np.round(rng.normal(size=(400, len(channels))), 3)
        lines = ["Recording of today, 1,2", "", "7", "meta", "meta", "meta", ",".join(["TimeStamp [µs]", *channels])]
        lines += [",".join([str(i * 100.0), *map(str, row)]) for i, row in enumerate(x)]
        path.write_text(end.join(lines) + end + tail, newline="")
        data[(name, *channels)] = x
    (root / "condA" / "sample1" / "notes.txt").write_text("x")
    (root / "condB" / "T30_Analog.csv").write_text("a,b\n1,2\n")
    return str(root), data


def test_find_select_label(spark, folder):
    root, _ = folder
    paths = fs.list_files(spark, root)
    assert paths.count() == 5
    chosen = fs.select_paths(paths, ["Analog.csv"], ["T30"])
    assert chosen.count() == 3 and fs.select_paths(paths, ["analog.csv"]).count() == 0
    labels = fs.assign_target(chosen, {"condA": "A", "rec": "R"}).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in labels} == {"A": 2, "R": 1}
    last = fs.assign_target(chosen, {"condA": "A", "rec": ""}, match="last").select("target").distinct().collect()
    assert [r[0] for r in last] == ["rec"]
    counts = {r["targeted"]: r["files"] for r in fs.count_by_target(paths, {"condB": ""}).collect()}
    assert counts == {True: 2, False: 3}
    with pytest.raises(Exception, match="no target"):
        fs.assign_target(paths, {"condB": ""}, untargeted="error").collect()


def test_many_label_rules(spark):
    rules = {f"k{i:03d}": f"v{i}" for i in range(150)}
    df = spark.createDataFrame([("a k007 k009",), ("none",)], "path string")
    first = [r[0] for r in df.select(label_from_text(F.col("path"), rules)).collect()]
    last = [r[0] for r in df.select(label_from_text(F.col("path"), rules, "last")).collect()]
    assert first == ["v7", None] and last == ["v9", None]


def check_signal(sig, data):
    rows = sig.collect()
    assert len(rows) == sum(x.size for x in data.values())
    for (name, *channels), x in data.items():
        for pos, ch in enumerate(channels):
            mine = sorted((r["idx"], r["value"], r["t"], r["n"]) for r in rows if name in r["recording_id"] and r["channel"] == ch)
            assert [m[0] for m in mine] == list(range(400)) and {m[3] for m in mine} == {400}
            np.testing.assert_array_equal([m[1] for m in mine], x[:, pos])
            np.testing.assert_array_equal([m[2] for m in mine], np.arange(400) * 100.0)


def test_read_recordings(spark, folder):
    root, data = folder
    paths = [r[0] for r in fs.select_paths(fs.list_files(spark, root), ["Analog.csv"], ["T30"]).collect()]
    check_signal(rec.read_recordings(spark, paths, 6), data)


def test_read_recordings_in_many_splits(spark, folder):
    root, data = folder
    paths = [r[0] for r in fs.select_paths(fs.list_files(spark, root), ["Analog.csv"], ["T30"]).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        check_signal(rec.read_recordings(spark, paths, 6), data)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_read_folder_by_rules(spark, folder):
    """A folder is read by rules on its paths; files that break them are not opened."""
    root, data = folder
    check_signal(rec.read_recordings(spark, root, 6, include=["Analog.csv"], exclude=["T30"]), data)
    lines, _ = rec.numbered_lines(spark, root, ["rec2_Analog.csv"])
    assert {r[0].rsplit("/", 1)[1] for r in lines.select("path").distinct().collect()} == {"rec2_Analog.csv"}
    cfg = ProcessConfig(skip_rows=6, segments=2)
    assert process_files(spark, root, cfg, ["rec3"]).select("channel").distinct().count() == 2


def test_quoted_and_surplus_cells(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('"Time, s","E ""1""", E2\n0,"1.5",2\n1, "2.5" ,""\n')
    rows = rec.read_recordings(spark, [str(path)]).collect()
    assert {(r["channel"], r["idx"], r["t"], r["value"]) for r in rows} == {
        ('E "1"', 0, 0.0, 1.5), ('E "1"', 1, 1.0, 2.5), ("E2", 0, 0.0, 2.0), ("E2", 1, 1.0, None)}
    more = tmp_path / "more.csv"
    more.write_text("Time,E\n0,1,2\n")
    with pytest.raises(Exception, match="too many values"):
        rec.read_recordings(spark, [str(more)]).collect()


def test_reading_leaves_the_session_alone(spark, folder):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    rec.read_recordings(spark, folder[0], 6, include=["rec1"]).count()
    after = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    assert {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)} <= {"spark.checkpoint.dir"}


def test_row_ids_of_a_csv_are_repeatable(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    text = "a,label\n" + "".join(f"{i},{'xy'[i % 2]}\n" for i in range(500))
    one.write_text(text)
    two.write_text(text)
    ids = [{r["features"][0]: r["row_id"] for r in tb.read_dataset(spark, str(one)).collect()}]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        ids.append({r["features"][0]: r["row_id"] for r in tb.read_dataset(spark, str(one)).collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 500
    other = {r["row_id"] for r in tb.read_dataset(spark, str(two)).collect()}
    assert not other & set(ids[0].values())


def test_read_pair(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 4.0], "b")], "row_id long, features array<double>, label string")
    paths = tb.write_split(df.where("row_id = 1"), df, str(tmp_path / "set.csv"))
    for path in paths:
        train, test = tb.read_pair(spark, path)
        assert (train.count(), test.count()) == (1, 2)
    with pytest.raises(ValueError):
        tb.read_pair(spark, str(tmp_path / "set.csv"))
    with pytest.raises(FileNotFoundError):
        tb.read_pair(spark, str(tmp_path / "none_Xy_train.csv"))


def test_segments_have_a_file_for_each_range(spark, long_signal, tmp_path):
    sig = long_signal({("r", "a"): range(100), ("r", "b"): range(100), ("s", "a"): range(40)}).repartition(7)
    tb.write_signal(sig, str(tmp_path / "sig"), samples=30)
    files = list((tmp_path / "sig").rglob("*.parquet"))
    assert len(files) <= 4 + 2 and spark.read.parquet(str(tmp_path / "sig")).count() == 240


def test_read_with_given_header(spark, folder):
    root, data = folder
    only = {k: v for k, v in data.items() if k[0] == "rec1_Analog.csv"}
    sig = rec.read_recordings(spark, [f"{root}/condA/sample1/rec1_Analog.csv"], 6, header=["TimeStamp", "E1", "E2", "E3"])
    check_signal(sig, only)


def test_read_errors(spark, tmp_path):
    gap = tmp_path / "gap.csv"
    gap.write_text("Time,E\n0,1\n\n1,2\n")
    with pytest.raises(Exception, match="too few values"):
        rec.read_recordings(spark, [str(gap)]).collect()
    text = tmp_path / "text.csv"
    text.write_text("Time,E\n0,abc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rec.read_recordings(spark, [str(text)]).collect()
    empty = tmp_path / "empty_cell.csv"
    empty.write_text("E,F\n,2\n1,3\n")
    rows = rec.read_recordings(spark, [str(empty)]).collect()
    assert {(r["channel"], r["idx"], r["value"], r["t"]) for r in rows} == {
        ("E", 0, None, None), ("E", 1, 1.0, None), ("F", 0, 2.0, None), ("F", 1, 3.0, None)}


def test_process_files(spark, folder, tmp_path):
    root, _ = folder
    paths = [r[0] for r in fs.select_paths(fs.list_files(spark, root), ["Analog.csv"], ["T30"]).collect()]
    cfg = ProcessConfig(skip_rows=6, top_channels=2, segments=4, average=True, shrink=5, dataset=True, targets={"condA": "A", "condB": "B"})
    out = process_files(spark, paths, cfg)
    rows = out.collect()
    assert len(rows) == 12 and {len(r["features"]) for r in rows} == {5}
    assert {r["label"] for r in rows if "condB" in r["recording_id"]} == {"B"}
    tb.write_dataset(out, str(tmp_path / "set"))
    assert tb.read_dataset(spark, str(tmp_path / "set")).count() == 12
    tb.write_dataset(out, str(tmp_path / "set.csv"))
    back = tb.read_dataset(spark, str(tmp_path / "set.csv"))
    assert sorted((list(r["features"]), r["label"]) for r in back.collect()) == sorted((list(r["features"]), r["label"]) for r in rows)
    parts = process_files(spark, paths, ProcessConfig(skip_rows=6, segments=2))
    tb.write_signal(parts, str(tmp_path / "sig"))
    assert spark.read.parquet(str(tmp_path / "sig")).where("segment_id = 1").count() == parts.count() // 2


def test_spike_table_round_trip(spark, folder, tmp_path, long_signal):
    root, _ = folder
    cfg = SpikeConfig(10_000, 2.5, 0.002, 0.0005, 0.0005, targets={"condA": "A"})
    spikes = detect_files(spark, [f"{root}/condA/sample1/rec1_Analog.csv"], cfg)
    assert spikes.count() > 5
    rows = sorted(map(tuple, spikes.collect()))
    for name in ("spikes", "spikes.csv"):
        tb.write_spikes(spikes, str(tmp_path / name), "pV")
        back = tb.read_spikes(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.collect())) == rows
    header = spark.read.csv(str(tmp_path / "spikes.csv"), header=True).columns
    assert "Peak value [pV]" in header and len(header) == 16
    spark.range(3).write.csv(str(tmp_path / "bad.csv"), header=True)
    with pytest.raises(ValueError):
        tb.read_spikes(spark, str(tmp_path / "bad.csv"))


def test_label_column_and_siblings():
    assert tb.find_label_col(["a_target", "x", "label", "y"]) == "label" and tb.find_label_col(["a"]) is None
    assert fs.sibling_path("/d/set_Xy_train.csv") == "/d/set_Xy_test.csv" and fs.sibling_path("/d/set.csv") is None


def test_dataset_csv_by_hand(spark, tmp_path):
    path = tmp_path / "default.csv"
    path.write_text("col0,col1,targets\n0, 1,target0\n1,0,target1\n")
    rows = tb.read_dataset(spark, str(path)).orderBy("row_id").collect()
    assert [(list(r["features"]), r["label"]) for r in rows] == [([0, 1], "target0"), ([1, 0], "target1")]
    with pytest.raises(ValueError):
        tb.read_dataset(spark, str(path), "nope")


def test_write_split_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([([1.0], "a"), ([2.0], "b")], "features array<double>, label string")
    train, test = tb.write_split(df.limit(1), df, str(tmp_path / "set.csv"))
    assert train.endswith("set_Xy_train.csv") and fs.sibling_path(train) == test
    assert tb.read_dataset(spark, test).count() == 2
    tb.write_metrics(df.select("label"), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


@pytest.fixture(scope="module")
def spikes(spark, long_signal):
    rng = np.random.default_rng(5)
    data = {(f"d/{'x' * 30}/r{i}.csv", ch): rng.normal(size=300) for i in range(2) for ch in ("E10", "E2", "E3")}
    return detect_spikes(long_signal(data), SpikeConfig(1, 2.2, 6, 2, 3, targets={"r0": "P", "r1": "Q"})).cache()


def test_raster(spikes):
    rows = ra.raster(spikes).collect()
    assert {(r["column_id"], r["y"]) for r in rows} == {("E10", 0), ("E2", 1), ("E3", 2)}
    assert all(r["x"] == r["peak_idx"] for r in rows) and len(rows) == spikes.count()
    slopes = [r["slope"] for r in rows]
    known = [s for s in slopes if s is not None]
    assert None in slopes
    values = [1.1 * max(known) if s is None else s for s in slopes]
    lo, hi = min(values), max(values)
    for r in ra.raster(spikes, "slope").collect():
        raw = 1.1 * max(known) if r["slope"] is None else r["slope"]
        assert r["color_value"] == pytest.approx((raw - lo) / (hi - lo))
    one = ra.raster(spikes, "peak_value", "target", ["Q"]).collect()
    assert {r["target"] for r in one} == {"Q"} and min(r["color_value"] for r in one) == 0
    files = {(r["color_class"], r["legend"]) for r in ra.raster(spikes, "file").collect()}
    assert files == {(0, "r0.csv"), (1, "r1.csv")}
    assert {(r["color_class"], r["legend"]) for r in ra.raster(spikes, "target").collect()} == {(0, "P"), (1, "Q")}
    with pytest.raises(ValueError):
        ra.raster(spikes, "nope")
    assert ra.raster_limits(spikes).first().asDict() == {"n_channels": 3, "max_values": 300}


def test_waveforms(spikes):
    keys = [r["key"] for r in spikes.limit(3).collect()]
    got = ra.waveforms(spikes, keys)
    assert got.count() == 15 and ra.waveforms(spikes, spikes.limit(3)).count() == 15
    want = {r["key"]: list(r["extracted"]) for r in spikes.collect()}
    for r in got.collect():
        assert want[r["key"]][r["pos"]] == r["value"]
    assert json.dumps(want[keys[0]])


def test_filter_spikes(spikes):
    assert ra.filter_spikes(spikes).count() == spikes.count()
    assert ra.filter_spikes(spikes, "target", ["P"]).where("target <> 'P'").count() == 0
    with pytest.raises(ValueError):
        ra.filter_spikes(spikes, "key", ["x"])


def test_files_of_recordings_share_a_folder_of_their_task(spark, tmp_path):
    """One file for each recording, also for lines without one, with its lines in order; none of them in a folder of its own."""
    lines = [(r, at, f"{r};{at}" if at % 7 else "") for r in (3, 4, 30, None) for at in range(25)]
    df = spark.createDataFrame(lines, "recording long, at long, line string").repartition(5)
    for root in (str(tmp_path / "plain"), (tmp_path / "uri").as_uri()):
        rec.write_lines(df, root, "at")
        files = {p.name: p.read_text() for p in (tmp_path / root.rsplit("/", 1)[1]).glob("*/*")}
        assert files == {f"recording={'__HIVE_DEFAULT_PARTITION__' if r is None else r}.csv": "".join(
            t + "\n" for q, _, t in lines if q == r) for r in (3, 4, 30, None)}
        assert fs.list_files(spark, root).count() == 4


def test_lines_of_a_recording_may_fill_many_batches(spark, tmp_path):
    df = spark.range(30_000).selectExpr("id % 2 AS recording", "id AS at", "concat('ü', id) AS line")
    rec.write_lines(df, str(tmp_path / "r"), "at")
    for r in (0, 1):
        (path,) = (tmp_path / "r").glob(f"*/recording={r}.csv")
        assert path.read_text().splitlines() == [f"ü{i}" for i in range(r, 30_000, 2)]
