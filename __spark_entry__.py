"""Registered queries and the SQL each of them must agree with.

``events`` serves as the signal table: recording = user_id % 4, channel = user_id, samples in (ts, event_id) order.
``lineitem`` per supplier gives longer channels and training-run-like score tables, ``embeddings`` the feature sets,
``pages.url`` the file paths, and a nearest-centroid guess on ``embeddings`` the predictions.
"""

from __future__ import annotations

import importlib.util
import math
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sigspark.functions import columns as fn  # noqa: E402
from sigspark.functions.harmonics import harmonic_rows  # noqa: E402
from sigspark.learning import models as ml  # noqa: E402
from sigspark.learning.trees import forest_nodes  # noqa: E402
from sigspark.operators import dataset as ds  # noqa: E402
from sigspark.operators import evaluate as ev  # noqa: E402
from sigspark.operators import filters as fl  # noqa: E402
from sigspark.operators import fourier as fo  # noqa: E402
from sigspark.operators import pca as pc  # noqa: E402
from sigspark.operators import raster as ra  # noqa: E402
from sigspark.operators import runs as rn  # noqa: E402
from sigspark.operators import signal as sg  # noqa: E402
from sigspark.operators import spikes as sp  # noqa: E402
from sigspark.operators.scale import freeze, shared_dir  # noqa: E402
from sigspark.plans.config import LearnConfig, ProcessConfig, SpikeConfig  # noqa: E402
from sigspark.plans.detect import accepted_spikes, detect_spikes  # noqa: E402
from sigspark.plans.learn import learn  # noqa: E402
from sigspark.plans.process import process, process_to_dataset  # noqa: E402
from sigspark.sources import files as fs  # noqa: E402
from sigspark.sources import recordings as rec  # noqa: E402
from sigspark.sources import tables as tb  # noqa: E402

LABELS = [str(i) for i in range(10)]
MAPPING = {"/fr/": "french", "/de/": "german", "page=": "paged", "example": ""}
# Samples are counted, not timed: one sample per second.
SPIKES = SpikeConfig(fs=1, threshold=2.5, dead_window=5, min_margin=3, max_margin=4, targets={"rec0": "A", "rec": "B"})
LONG_SPIKES = SpikeConfig(fs=1, threshold=2.2, dead_window=9, min_margin=3, max_margin=6, edge="trim")


def r6(column) -> object:
    """Round for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark: SparkSession, sf: str, rows_per_cell: int | None = None) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("rec"), F.col("user_id") % 4).alias("recording_id"),
        F.col("user_id").cast("string").alias("channel"),
        F.col("user_id").alias("channel_pos"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        "event_id",
        "value",
    )
    return sg.index_signal(rows, ["t", "event_id"], rows_per_cell).drop("event_id")


def long_signal(spark: SparkSession, sf: str) -> DataFrame:
    rest = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate"]
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("rec"), F.col("l_suppkey") % 4).alias("recording_id"),
        F.col("l_suppkey").cast("string").alias("channel"),
        F.col("l_suppkey").alias("channel_pos"),
        "l_orderkey",
        *rest,
        (F.col("l_extendedprice") - 35000.0).alias("value"),
    )
    return sg.index_signal(rows, ["l_orderkey", *rest]).select(
        "recording_id", "channel", "channel_pos", "idx", "n", F.col("l_orderkey").cast("double").alias("t"), "value"
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("string").alias("label"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest label centroid; confidence falls with the distance."""
    rows = features(spark, sf)
    means = ds.profile(rows).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centre")
    )
    centres = means.agg(F.sort_array(F.collect_list(F.struct("label", "centre")))).scalar()  # one row per label
    far = F.transform(
        "_centres",
        lambda c: F.struct(
            F.aggregate(
                F.zip_with("features", c["centre"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, v: a + v
            ).alias("d"),
            c["label"].alias("label"),
        ),
    )
    return rows.withColumn("_centres", centres).withColumn("_near", F.array_min(far)).select(
        "row_id", F.col("_near.label").alias("predicted"), F.col("label").alias("actual"),
        (1 / (1 + F.sqrt("_near.d"))).alias("confidence"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Score tables shaped like training runs: one per supplier, five folds by line number."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        (F.col("l_linenumber") % 5).alias("fold"),
        (F.col("l_returnflag") != "R").cast("double").alias("kept"),
        (F.col("l_discount") < 0.09).cast("double").alias("cheap"),
        (F.col("l_quantity") > 12).cast("double").alias("many"),
    )
    folds = rows.groupBy("run_id", "fold").agg(
        F.avg("kept").alias("score"), F.sum("cheap").alias("cheap"), F.sum("many").alias("many"),
        F.count(F.lit(1)).alias("rows"),
    )
    scores = F.transform(F.sort_array(F.collect_list(F.struct("fold", "score"))), lambda x: x["score"])
    return folds.groupBy("run_id").agg(
        F.create_map(F.lit("supplier"), F.col("run_id").cast("string")).alias("params"),
        scores.alias("cv_scores"),
        F.round(F.sum("cheap") / F.sum("rows"), 3).alias("train_acc"),
        F.round(F.sum("many") / F.sum("rows"), 3).alias("test_acc"),
    )


def spike_table(spark: SparkSession, sf: str) -> DataFrame:
    """Detected spikes, stored and read back: the queries on the spike table run over it several times."""
    return freeze(detect_spikes(signal(spark, sf), SPIKES))


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors can reach."""
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


def recording_files(spark: SparkSession, sf: str) -> str:
    """A folder of recordings: per supplier a CSV with a line of notes, a header with a quoted name, and a line per order."""
    rows = (
        table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("recording"), F.col("l_orderkey").alias("at"))
        .agg(F.sum("l_quantity").cast("string").alias("e1"), F.max("l_partkey").cast("string").alias("e2"))
        .select("recording", "at", F.concat_ws(",", "at", "e1", "e2").alias("line"))
    )
    heads = F.array(F.struct(F.lit(-2).cast("long").alias("at"), F.lit("notes, of any kind").alias("line")),
                    F.struct(F.lit(-1).cast("long").alias("at"), F.lit('TimeStamp [s],E1,"E, 2"').alias("line")))
    named = rows.select("recording").distinct().select("recording", F.inline(heads))
    path = _folder(spark)
    rec.write_lines(rows.unionByName(named), path, "at")
    return path


# --- queries ---------------------------------------------------------------------------------------------------


def q_signal_positions(spark, sf):
    return signal(spark, sf).select("recording_id", "channel", "idx", "n", "value")


# The same with cells, blocks and tiles so small that these tables take the paths of very long series.


def q_signal_positions_cells(spark, sf):
    return signal(spark, sf, 50).select("recording_id", "channel", "idx", "n", "value")


def q_spike_features_blocks(spark, sf):
    return _spike_columns(detect_spikes(signal(spark, sf), SPIKES, block=32, blocks_per_group=2))


def q_spectrum_grid(spark, sf):
    return fo.spectrum(signal(spark, sf), 1000.0, direct=16).select(
        "recording_id", "channel", "bin", r6("freq_hz").alias("freq_hz"), r6("magnitude").alias("magnitude")
    )


def q_nearest_spike_cells(spark, sf):
    return _nearest(spark, sf, 5)


def q_spike_neighbours_cells(spark, sf):
    return ra.neighbours(spike_table(spark, sf), 5)


def q_wide_to_long(spark, sf):
    wide = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("recording_id"), F.col("l_orderkey").alias("TimeStamp"))
        .agg(F.sum("l_quantity").alias("E1"), F.max("l_partkey").alias("E2"))
    )
    return sg.to_signal(wide, ["TimeStamp"]).select("recording_id", "channel", "channel_pos", "idx", "n", "t", "value")


def _recording():
    return F.regexp_extract("recording_id", r"recording=(\d+)", 1)


def q_recording_files(spark, sf):
    """Recordings found in a folder and read: files of different lengths, notes skipped, names from each header."""
    out = rec.read_recordings(spark, recording_files(spark, sf), 1, include=["recording="])
    return out.withColumn("recording_id", _recording())


def q_recording_single(spark, sf):
    """One file, chosen from the listing of its folder."""
    path = fs.select_paths(fs.list_files(spark, recording_files(spark, sf)), ["recording=3."]).first()["path"]
    return rec.read_recordings(spark, [path], 1).withColumn("recording_id", _recording())


def q_listed_files(spark, sf):
    """The files of a folder at any depth, by the recording that their path names."""
    files = fs.list_files(spark, recording_files(spark, sf)).withColumnRenamed("path", "recording_id")
    return files.groupBy(_recording().alias("recording_id")).agg(F.count(F.lit(1)).alias("files"))


def q_dataset_file(spark, sf):
    """A feature set written as CSV and read back, its label column found by name; the row's number is feature 0."""
    rows = features(spark, sf)
    path = _folder(spark) + "/set.csv"
    tb.write_dataset(rows.withColumn("features", F.concat(F.array(F.col("row_id").cast("double")), "features")), path)
    back = tb.read_dataset(spark, path)
    return back.select(F.col("features")[0].cast("long").alias("row_id"), "label", F.posexplode("features").alias("pos", "v")).where(
        "pos > 0").select("row_id", "label", (F.col("pos") - 1).alias("pos"), r6("v").alias("value"))


def q_split_files(spark, sf):
    """A split written as two CSV files and read back from the path of the second."""
    numbered = features(spark, sf).withColumn("features", F.array(F.col("row_id").cast("double")))
    paths = tb.write_split(*ds.split(numbered, 0.7, "s1"), _folder(spark) + "/set.csv")
    parts = [rows.withColumn("part", F.lit(name)) for name, rows in zip(("train", "test"), tb.read_pair(spark, paths[1]))]
    return parts[0].unionByName(parts[1]).select("part", F.col("features")[0].cast("long").alias("row_id"), "label")


def q_signal_files(spark, sf):
    """Segments written and read back, with the number of files that each has."""
    path = _folder(spark)
    tb.write_signal(sg.segment(signal(spark, sf), 4), path)
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return back.groupBy("recording_id", F.col("segment_id").cast("long").alias("segment_id")).agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("samples"), r6(F.avg("value")).alias("mean"))


def q_spike_file(spark, sf):
    """The spike table written as CSV with units in its headers and read back."""
    path = _folder(spark) + "/spikes.csv"
    tb.write_spikes(detect_spikes(signal(spark, sf), SPIKES), path, "pV")
    units = sum("[pV]" in c for c in spark.read.csv(path, header=True).columns)
    return _spike_columns(tb.read_spikes(spark, path)).withColumn("unit_headers", F.lit(units).cast("long"))


def q_channel_stats(spark, sf):
    return sg.channel_stats(signal(spark, sf)).select(
        "recording_id", "channel", "n", r6("std").alias("std"), r6("max_abs").alias("max_abs")
    )


def q_top_channels(spark, sf):
    return sg.rank_channels(sg.channel_stats(signal(spark, sf)), 5).select(
        "recording_id", "channel", "rank", r6("std").alias("std")
    )


def q_top_channel_samples(spark, sf):
    return sg.top_n_channels(signal(spark, sf), 3).select("recording_id", "channel", "idx", "value")


def q_drop_channels(spark, sf):
    return sg.drop_channels(signal(spark, sf), "1").groupBy("recording_id", "channel").agg(
        F.count(F.lit(1)).alias("samples")
    )


def q_segments(spark, sf):
    return sg.segment(signal(spark, sf), 4).groupBy("recording_id", "channel", "segment_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("idx").alias("last_idx"), r6(F.avg("value")).alias("mean")
    )


def q_channel_mean(spark, sf):
    return sg.channel_mean(sg.segment(signal(spark, sf), 4)).select("recording_id", "segment_id", "idx", "value")


def q_resample_mean(spark, sf):
    return sg.resample(signal(spark, sf), 8).select("recording_id", "channel", "idx", r6("value").alias("value"))


def q_resample_linear(spark, sf):
    return sg.resample(signal(spark, sf), 9, "linear").select(
        "recording_id", "channel", "idx", r6("value").alias("value")
    )


def q_feature_rows(spark, sf):
    rows = ds.make_dataset(sg.resample(sg.segment(signal(spark, sf), 2), 6))
    return rows.select("row_id", F.posexplode("features").alias("pos", "v")).select("row_id", "pos", r6("v").alias("value"))


def q_dataset_pipeline(spark, sf):
    cfg = ProcessConfig(top_channels=5, segments=4, average=True, shrink=4, dataset=True,
                        targets={"rec0": "zero", "rec1": "one", "rec2": ""})
    rows = process_to_dataset(signal(spark, sf), cfg)
    return rows.select("recording_id", "segment_id", "label", F.posexplode("features").alias("pos", "v")).select(
        "recording_id", "segment_id", "label", "pos", r6("v").alias("value")
    )


def q_hann_window(spark, sf):
    return sg.hann(signal(spark, sf)).select("recording_id", "channel", "idx", r6("value").alias("value"))


def q_spectrum_bins(spark, sf):
    return sg.spectrum_bins(signal(spark, sf), 1000.0, [1, 2, 5]).select(
        "recording_id", "channel", "bin", r6("freq_hz").alias("freq_hz"), r6("magnitude").alias("magnitude")
    )


def q_spectrum(spark, sf):
    return fo.spectrum(signal(spark, sf), 1000.0).select(
        "recording_id", "channel", "bin", r6("freq_hz").alias("freq_hz"), r6("magnitude").alias("magnitude")
    )


def q_harmonics(spark, sf):
    base = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("p_size")).agg(
        F.count(F.lit(1)).alias("parts")
    )
    return harmonic_rows(base, "p_size", 9, "Odd").select("p_size", "parts", "order", "harmonic")


def q_butterworth(spark, sf):
    out = fl.butter_filter(long_signal(spark, sf), 2, "lowpass", [50], 1000)
    return out.select("recording_id", "channel", "idx", (F.round("value", 3) + F.lit(0.0)).alias("value"))


def q_butterworth_blocks(spark, sf):
    """Blocks far shorter than the filter takes to settle."""
    out = fl.apply_filters(long_signal(spark, sf), fl.design_chain(2, "highpass", [5], [], 1000), 50, group=3)
    return out.select("recording_id", "channel", "idx", (F.round("value", 3) + F.lit(0.0)).alias("value"))


def q_notch_harmonics(spark, sf):
    out = fl.notch_harmonics(long_signal(spark, sf), [100, 300], 2, 1000)
    return out.select("recording_id", "channel", "idx", (F.round("value", 2) + F.lit(0.0)).alias("value"))


def q_process_chain(spark, sf):
    cfg = ProcessConfig(top_channels=8, segments=2, filter_order=2, filter_type="bandpass", cuts=(20, 200),
                        harmonic_freq=100, harmonic_nth=2, fs=1000, fft=True, average=True, shrink=10)
    value = F.bround(F.round("value", 9), 3) + F.lit(0.0)
    return process(long_signal(spark, sf), cfg).select("recording_id", "segment_id", "idx", value.alias("value"))


def q_path_select(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return fs.select_paths(pages, ["http", "example"], ["/fr/", "ref=x"])


def q_path_target_first(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return fs.assign_target(pages, MAPPING, match="first").select("page_id", "target")


def q_path_target_last(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return fs.assign_target(pages, MAPPING, match="last", untargeted="drop").select("page_id", "target")


def q_path_counts(spark, sf):
    return fs.count_by_target(table(spark, sf, "pages"), {"/fr/": "", "/de/": ""}, on="url")


def q_filter_labels(spark, sf):
    return ds.features_of(ds.filter_labels(features(spark, sf), [1, 3, 5])).select("row_id", F.size("features").alias("width"))


def q_rename_labels(spark, sf):
    out = ds.rename_labels(features(spark, sf), {"0": "zero", "1": "one", "2": "zero"})
    return out.select("row_id", "label")


def q_encode_labels(spark, sf):
    named = ds.rename_labels(features(spark, sf), {"0": "zero", "1": "one"})
    return ds.encode_labels(named).select("row_id", "label", "label_code")


def q_split_train(spark, sf):
    return ds.split(features(spark, sf), 0.7, "s1")[0].select("row_id", "label")


def q_split_test(spark, sf):
    return ds.split(features(spark, sf), 0.7, "s1")[1].select("row_id", "label")


def q_merge_sets(spark, sf):
    rows = features(spark, sf)
    return ds.merge(ds.filter_labels(rows, [1, 2]), ds.filter_labels(rows, [2, 3])).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def q_describe(spark, sf):
    return ds.describe_dataset(features(spark, sf))


def q_distinct_values(spark, sf):
    return ds.distinct_values(features(spark, sf), "label", 50)


def q_fold_assignment(spark, sf):
    return ds.assign_folds(features(spark, sf), 5, "k").select("row_id", "label", F.col("fold").cast("long").alias("fold"))


def q_label_profile(spark, sf):
    return ds.profile(features(spark, sf)).select(
        "label", F.col("pos").cast("long").alias("pos"), *[r6(c).alias(c) for c in ("mean", "std", "lower", "upper")]
    )


def q_profile_range(spark, sf):
    return ds.profile_range(ds.profile(features(spark, sf))).select(r6("ymin").alias("ymin"), r6("ymax").alias("ymax"))


def q_spike_crossings(spark, sf):
    out = sp.edge_rule(sp.crossings(signal(spark, sf), 2.5), 3, 4)
    return out.select("recording_id", "channel", "idx", "value", r6("std").alias("std"), "low", "high")


def q_spike_crossings_trimmed(spark, sf):
    out = sp.edge_rule(sp.crossings(long_signal(spark, sf), 2.2), 3, 6, "trim")
    return out.select("recording_id", "channel", "idx", r6("value").alias("value"), "low", "high")


def q_spike_peaks(spark, sf):
    found = sp.peaks(sp.spike_blocks(signal(spark, sf), SPIKES), SPIKES).where(~F.col("ignored"))
    return found.select("recording_id", "channel", "idx", "peak_idx", "peak_value", "abs_peak_idx", "abs_peak_value",
                        "first_idx", "last_idx")


def q_spike_refractory(spark, sf):
    return accepted_spikes(signal(spark, sf), SPIKES)[0].select("recording_id", "channel", "idx", "peak_idx")


def q_spike_features(spark, sf):
    return _spike_columns(detect_spikes(signal(spark, sf), SPIKES))


def _spike_columns(spikes):
    return spikes.select(
        "key", "file", "sampling_hz", "n_values", "target", "column_id", "crossing_idx", "peak_value", "peak_idx",
        "min_value", "max_value", r6("slope").alias("slope"), r6("extrema_ratio").alias("extrema_ratio"), "first_idx", "last_idx",
    )


def q_spike_features_trimmed(spark, sf):
    return detect_spikes(long_signal(spark, sf), LONG_SPIKES).select(
        "file", "column_id", "crossing_idx", "peak_idx", r6("peak_value").alias("peak_value"), "first_idx", "last_idx",
        r6("min_value").alias("min_value"), r6("max_value").alias("max_value"),
        F.round("slope", 4).alias("slope"), F.round("extrema_ratio", 4).alias("extrema_ratio"),
    )


def q_spike_waveforms(spark, sf):
    spikes = spike_table(spark, sf)
    return ra.waveforms(spikes, spikes.where(F.col("file") == "rec1")).select("key", "pos", "value")


def q_filter_spikes(spark, sf):
    return ra.filter_spikes(spike_table(spark, sf), "file", ["rec0", "rec3"]).groupBy("file", "column_id").agg(
        F.count(F.lit(1)).alias("spikes")
    )


def q_raster_slope(spark, sf):
    return ra.raster(spike_table(spark, sf), "slope").select(
        "key", "x", "y", r6("color_raw").alias("color_raw"), r6("color_value").alias("color_value")
    )


def q_raster_file(spark, sf):
    return ra.raster(spike_table(spark, sf), "file", "file", ["rec1", "rec2"]).select(
        "key", "x", "y", "color_class", "legend"
    )


def q_raster_limits(spark, sf):
    return ra.raster_limits(spike_table(spark, sf), "file", ["rec1", "rec2"])


def q_nearest_spike(spark, sf):
    return _nearest(spark, sf)


def _nearest(spark, sf, rows_per_cell=None):
    points = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 150).cast("string").alias("column_id"), (F.col("o_orderkey") % 80).alias("x")
    )
    return ra.nearest_spike(points, spike_table(spark, sf), rows_per_cell).select("o_orderkey", "nearest_key", "nearest_idx")


def q_spike_neighbours(spark, sf):
    return ra.neighbours(spike_table(spark, sf))


def q_accuracy(spark, sf):
    return ev.accuracy(predictions(spark, sf))


def q_macro_metrics(spark, sf):
    return ev.macro_metrics(predictions(spark, sf))


def q_cup_stats(spark, sf):
    return ev.cup_stats(predictions(spark, sf), "testing")


def q_confusion(spark, sf):
    return ev.confusion(predictions(spark, sf), LABELS[:8], LABELS[:6])


def q_confusion_cells(spark, sf):
    order = {v: 9 - i for i, v in enumerate(LABELS)}
    placed = ev.reorder(ev.confusion(predictions(spark, sf), LABELS), order, order)
    return ev.annotate(placed, "percent", "with").select("row_index", "column_index", "annotation")


def q_confusion_matrix(spark, sf):
    wide = ev.pivot_confusion(ev.confusion(predictions(spark, sf), LABELS), LABELS)
    return wide.withColumnsRenamed({v: f"actual_{v}" for v in LABELS})


def q_label_confusion(spark, sf):
    pred = table(spark, sf, "labels").select(
        F.col("quality").cast("string").alias("predicted"), F.col("toxic").cast("string").alias("actual"),
        (0.5 + (F.col("doc_id") % 50) / 100).alias("confidence"),
    )
    return ev.confusion(pred, ["0", "1"])


def q_run_scores(spark, sf):
    scored = rn.with_scores(runs(spark, sf), absolute_gap=True)
    return scored.select(
        "run_id", r6("cv_mean").alias("cv_mean"), r6("cv_std").alias("cv_std"), r6("trust").alias("trust"),
        fn.score_band(F.col("train_acc")).alias("band"),
    )


def q_run_gaps(spark, sf):
    scored = rn.with_scores(runs(spark, sf), absolute_gap=True)
    return scored.select("run_id", "gap", "risk", fn.score_band(F.col("gap"), "kfold").alias("band"))


def q_best_runs(spark, sf):
    return rn.best_runs(runs(spark, sf), ["trust", "relative_cv", "cv", "train", "test"]).select("score", "run_id")


def q_runs_summary(spark, sf):
    return rn.runs_summary(runs(spark, sf))


def q_run_report(spark, sf):
    return rn.report(runs(spark, sf)).select("section", "name", "value", "std", "text", "band")


def q_report_file(spark, sf):
    """The report written as CSV and read back."""
    path = _folder(spark)
    tb.write_metrics(rn.report(runs(spark, sf)), path)
    kinds = "section string, name string, value double, std double, text string, band string"
    return spark.read.schema(kinds).csv(path, header=True)


def q_standardized(spark, sf):
    out = pc.standardize(features(spark, sf)).select("row_id", F.posexplode("features").alias("pos", "v"))
    return out.select("row_id", "pos", r6("v").alias("value"))


def _scores(spark, sf):
    rows = features(spark, sf)
    return pc.apply_pca(pc.fit_pca(rows, LABELS[:5], 2), rows, LABELS[5:])


def q_ellipse(spark, sf):
    """Of the scores of the labels that the components were not fitted on."""
    out = pc.ellipse(_scores(spark, sf))
    return out.select("label", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in out.columns if c != "label"])


def q_pca_scores(spark, sf):
    return _scores(spark, sf).select(
        "row_id", "label", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("pc1", "pc2")])


def q_pca_explained(spark, sf):
    """Percent of the variance that each component explains, and its loading of each feature."""
    rows = features(spark, sf)
    fit = pc.fit_pca(rows, LABELS[:5], 2)
    loads = [(i + 1, p, float(share), float(v)) for i, share in enumerate(fit.explained()) for p, v in enumerate(fit.components()[:, i])]
    out = spark.createDataFrame(loads, "component int, pos long, explained double, loading double")
    return out.withColumn("loading", F.round("loading", 5) + F.lit(0.0))


def q_forest_confusion(spark, sf):
    train, test = ds.split(features(spark, sf), 0.7, "s1")
    model = ml.train_rf(train, {"n_estimators": 10, "max_depth": 5, "criterion": "entropy"}, seed=1)
    return ev.confusion(ml.predict(model, test), LABELS)


def q_forest_importance_sum(spark, sf):
    model = ml.train_rf(features(spark, sf), {"n_estimators": 5, "max_depth": 4}, seed=1)
    return ml.feature_importance(spark, model).agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 9).alias("total"))


def q_forest_saved(spark, sf):
    """Predictions of a forest and of the same one saved and loaded, by label."""
    train, test = ds.split(features(spark, sf), 0.7, "s1")
    model, path = ml.train_rf(train, {"n_estimators": 5, "max_depth": 5}, seed=1), _folder(spark)
    ml.save_model(spark, model, path)
    here, there = (ml.predict(m, test).select("row_id", F.col("actual").alias("label"), "predicted", "probabilities")
                   for m in (model, ml.load_model(spark, path)))
    there = there.select("row_id", F.col("predicted").alias("again"), F.col("probabilities").alias("chances"))
    same = (F.col("predicted") == F.col("again")) & (F.col("probabilities") == F.col("chances"))
    return here.join(there, "row_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(same.cast("long")).alias("same"))


#: Values to try; the data decide on none of them.
GRID = {"n_estimators": "2, 3", "max_depth": "2, 4", "criterion": ["gini"]}


def q_learn_runs(spark, sf):
    """A grid searched: per run its settings, the number of fold scores, and whether all scores are shares."""
    train, test = ds.split(features(spark, sf), 0.7, "s1")
    got = learn(train, test, LearnConfig(grid=GRID, fixed={"bootstrap": True}, folds=2))
    scores = F.concat("cv_scores", F.array("train_acc", "test_acc", "f1", "recall", "precision"))
    params = [F.col("params")[name].alias(name) for name in ("n_estimators", "max_depth", "criterion", "bootstrap")]
    return got.runs.select(*params, F.size("cv_scores").alias("folds"),
                           F.forall(scores, lambda x: (x >= 0) & (x <= 1)).alias("shares"))


def q_param_grid(spark, sf):
    """All combinations of settings whose values come from the data, with the fixed ones."""
    parts = table(spark, sf, "part")
    values = {c: [r[0] for r in parts.select(c).distinct().orderBy(c).limit(4).collect()] for c in ("p_size", "p_brand")}
    combos = ml.param_grid({k: v for k, v in values.items()}, {"n_estimators": "100", "p_size": 0})
    return spark.createDataFrame([(int(c["p_size"]), str(c["p_brand"]), int(c["n_estimators"])) for c in combos],
                                 "p_size long, p_brand string, n_estimators long")


def q_forest_importance(spark, sf):
    model = ml.train_rf(features(spark, sf), {"n_estimators": 10, "max_depth": 5}, seed=1)
    return ml.feature_importance(spark, model)


def q_forest_nodes(spark, sf):
    """What must hold of every tree: the limit on its leaves, weights that add up, and impurities that fit them."""
    limits = {"n_estimators": 8, "max_depth": 9, "max_leaf_nodes": 12, "ccp_alpha": 0.001, "min_samples_split": 4}
    model = ml.train_rf(features(spark, sf), limits, seed=1)
    nodes = forest_nodes(model.pipeline.stages[0]).withColumn("weight", F.aggregate("stats", F.lit(0.0), lambda a, x: a + x))
    parts = nodes.select("tree", F.col("id").alias("child"), F.col("weight").alias("part"))
    below = nodes.select("tree", "id", F.explode(F.array("left", "right")).alias("child")).where("child >= 0")
    below = below.join(parts, ["tree", "child"]).groupBy("tree", "id").agg(F.sum("part").alias("below"))
    gini = 1 - F.aggregate("stats", F.lit(0.0), lambda a, x: a + x * x) / (F.col("weight") * F.col("weight"))
    return nodes.join(below, ["tree", "id"], "left").groupBy(F.col("tree").cast("long").alias("tree")).agg(
        (F.sum((F.col("left") < 0).cast("int")) <= 12).alias("few_leaves"),
        F.min(F.coalesce(F.abs(F.col("below") - F.col("weight")) < 1e-6, F.lit(True))).alias("weights_add_up"),
        F.min(F.abs(gini - F.col("impurity")) < 1e-9).alias("impurity_fits"),
        F.min((F.col("left") < 0) | (F.col("rows") >= 4)).alias("splits_have_rows"))


def q_svc_confusion(spark, sf):
    train, test = ds.split(features(spark, sf), 0.7, "s1")
    model = ml.train_svc(train, {"kernel": "rbf", "C": 1.0}, seed=1)
    return ev.confusion(ml.predict(model, test), LABELS)


def q_svc_probabilities(spark, sf):
    """Predicted rows by their label, and how many have a distribution over the labels with its maximum as confidence."""
    train, test = ds.split(features(spark, sf), 0.7, "s1")
    out = ml.predict(ml.train_svc(train, {"kernel": "poly", "degree": 2, "coef0": 1.0}), test)
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    sound = (F.abs(total - 1) < 1e-9) & (F.array_min(p) >= 0) & (F.size(p) == 10) & (F.col("confidence") == F.array_max(p))
    return out.groupBy(F.col("actual").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(
        (sound & F.col("predicted").isin(LABELS)).cast("long")).alias("sound"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: raw samples to a labelled feature set."""
    cfg = ProcessConfig(top_channels=3, segments=4, average=True, shrink=4, dataset=True,
                        targets={"rec0": "zero", "rec1": "one", "rec": "more"})
    return process_to_dataset(signal(spark, "/root/testdata/sf0.001"), cfg)


def _corpus() -> tuple[dict, dict]:
    """Queries of the text corpus operators and their SQL, if that subpackage is there."""
    for name in ("sigspark.llm", "corpus_pipeline"):
        found = importlib.util.find_spec(name)
        if found is None or found.origin is None:  # an emptied folder has a name, but no origin
            return {}, {}
    import corpus_pipeline
    from sigspark.llm import queries as corpus

    sql = corpus.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return corpus.queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")} | _corpus()[0]


# --- the same in SQL -------------------------------------------------------------------------------------------

_SIG = """sig AS (
  SELECT 'rec' || (user_id % 4) AS recording_id, CAST(user_id AS VARCHAR) AS channel, user_id AS channel_pos,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY user_id) AS n, value
  FROM events)"""
_LONG = """sig AS (
  SELECT 'rec' || (l_suppkey % 4) AS recording_id, CAST(l_suppkey AS VARCHAR) AS channel, l_suppkey AS channel_pos,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx,
         count(*) OVER (PARTITION BY l_suppkey) AS n, l_extendedprice - 35000.0::DOUBLE AS value
  FROM lineitem)"""
_WIDE = """WITH w AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, l_orderkey AS t, sum(l_quantity) AS E1, max(l_partkey) AS E2
  FROM lineitem{where} GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS idx,
               count(*) OVER (PARTITION BY recording_id) AS n FROM w)
SELECT recording_id, 'E1' AS channel, CAST({first} AS BIGINT) AS channel_pos, idx, n, t::DOUBLE AS t, E1::DOUBLE AS value FROM num
UNION ALL SELECT recording_id, '{e2}', {first} + 1, idx, n, t::DOUBLE, E2::DOUBLE FROM num"""
_STATS = """st AS (
  SELECT recording_id, channel, min(channel_pos) AS channel_pos, count(*) AS n, stddev_pop(value) AS std,
         max(abs(value)) AS max_abs
  FROM sig GROUP BY ALL_KEYS),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY std DESC, channel_pos) AS rank FROM st)""".replace(
    "ALL_KEYS", "recording_id, channel"
)
_FEAT = """feat AS (
  SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, unnest(embedding)::DOUBLE AS v,
         generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings)"""
_PRED = f"""{_FEAT},
cen AS (SELECT label AS c, pos, avg(v) AS m FROM feat GROUP BY label, pos),
dist AS (SELECT row_id, label, c, sum((v - m) * (v - m)) AS d FROM feat JOIN cen USING (pos) GROUP BY row_id, label, c),
near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS r FROM dist),
pred AS (SELECT row_id, c AS predicted, label AS actual, 1 / (1 + sqrt(d)) AS confidence FROM near WHERE r = 1)"""
# The leading eigenvector as a column of a high power of the correlations, the next one of what is left without it.
def _power_sql(source: str, to: str) -> str:
    return f"""{to}_p(step, i, j, v) AS (
  SELECT 0, i, j, v / (SELECT sum(v) FROM {source} WHERE i = j) FROM {source}
  UNION ALL SELECT step, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.step + 1 AS step, a.i, b.j, sum(a.v * b.v) AS v FROM {to}_p a JOIN {to}_p b ON a.j = b.i WHERE a.step < 22 GROUP BY ALL)),
{to}_c AS (SELECT i, v FROM {to}_p WHERE step = 22 AND j = (SELECT arg_max(i, v) FROM {to}_p WHERE step = 22 AND i = j)),
{to}_u AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {to}_c),
{to} AS MATERIALIZED (SELECT i, v * sign((SELECT arg_max(v, abs(v)) FROM {to}_u)) AS v,
  (SELECT sum(x.v * m.v * y.v) FROM {source} m JOIN {to}_u x ON x.i = m.i JOIN {to}_u y ON y.i = m.j) AS power FROM {to}_u)"""


_PCA = f"""{_FEAT},
z AS MATERIALIZED (SELECT row_id, label, pos, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS v,
        label::INTEGER < 5 AS fitted FROM feat WINDOW w AS (PARTITION BY label::INTEGER < 5, pos)),
cor AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS v FROM z a JOIN z b USING (row_id) WHERE a.fitted GROUP BY 1, 2),
{_power_sql("cor", "e1")},
rest AS MATERIALIZED (SELECT cor.i, cor.j, cor.v - x.power * x.v * y.v AS v FROM cor JOIN e1 x ON x.i = cor.i JOIN e1 y ON y.i = cor.j),
{_power_sql("rest", "e2")},
parts AS (SELECT 1 AS component, i AS pos, v, power / (SELECT sum(v) FROM cor WHERE i = j) AS share FROM e1
          UNION ALL SELECT 2, i, v, power / (SELECT sum(v) FROM cor WHERE i = j) FROM e2),
scores AS (SELECT row_id, label, sum(z.v * e1.v) AS pc1, sum(z.v * e2.v) AS pc2
           FROM z JOIN e1 ON e1.i = pos JOIN e2 ON e2.i = pos WHERE NOT fitted GROUP BY row_id, label)"""
_RUNS = """folds AS (
  SELECT l_suppkey AS run_id, l_linenumber % 5 AS fold,
         avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score,
         sum(CASE WHEN l_discount < 0.09 THEN 1 ELSE 0 END) AS cheap,
         sum(CASE WHEN l_quantity > 12 THEN 1 ELSE 0 END) AS many, count(*) AS rws
  FROM lineitem GROUP BY 1, 2),
runs AS (
  SELECT run_id, round(sum(cheap)::DOUBLE / sum(rws)::DOUBLE, 3) AS tr, round(sum(many)::DOUBLE / sum(rws)::DOUBLE, 3) AS te,
         avg(score) AS cm, stddev_pop(score) AS cs
  FROM folds GROUP BY 1),
scored AS (
  SELECT *, (te - 0.5::DOUBLE * abs(tr - te) - 0.2::DOUBLE * cs - 0.3::DOUBLE * (abs(te - cm) + abs(tr - cm)) / 2
             + 0.9::DOUBLE) / 1.9::DOUBLE AS trust,
         round_even(round_even(tr - cm, 3) / tr * 100, 2) AS gap
  FROM runs)"""


def _band(x: str) -> str:
    return (f"CASE WHEN {x} < 0.65 THEN 'red' WHEN {x} < 0.79 THEN 'orange' WHEN {x} < 0.9 THEN 'yellow' "
            f"WHEN {x} IS NOT NULL THEN 'green' END")


def _gap_band(x: str) -> str:
    return (f"CASE WHEN {x} < 3 THEN 'green' WHEN {x} < 5 THEN 'yellow' WHEN {x} < 10 THEN 'orange' "
            f"WHEN {x} IS NOT NULL THEN 'red' END")


def _edges(at: str, before: int, after: int, trim: bool) -> tuple[str, str, str]:
    if not trim:
        return f"{at} - {before}", f"{at} + {after}", f"{at} - {before} >= 0 AND {at} + {after} < n"
    return (f"greatest({at} - {before}, 0)", f"CASE WHEN {at} + {after} > n THEN n - 1 ELSE {at} + {after} END", "true")


def _spike_ctes(sig: str, cfg: SpikeConfig) -> str:
    k, b, a, trim = f"{cfg.threshold}::DOUBLE", cfg.before, cfg.after, cfg.edge == "trim"
    low, high, fits = _edges("idx", b, a, trim)
    first, last, peak_fits = _edges("peak_idx", b, a, trim)
    return f"""{sig},
st AS (SELECT channel, stddev_pop(value) AS std, max(abs(value)) AS ma FROM sig GROUP BY channel),
cr AS (SELECT sig.*, st.std FROM sig JOIN st USING (channel) WHERE ma > 0 AND abs(value) >= {k} * std),
ew AS (SELECT *, {low} AS low, {high} AS high FROM cr WHERE {fits}),
win AS (SELECT ew.channel, ew.idx, ew.value, ew.std, s.idx AS si, s.value AS sv
        FROM ew JOIN sig s ON s.channel = ew.channel AND s.idx >= ew.low AND s.idx < ew.high),
ext AS (SELECT channel, idx, max(sv) AS mx, min(sv) AS mn, max(abs(sv)) AS ma FROM win GROUP BY channel, idx),
hit AS (SELECT win.channel, win.idx,
               min(CASE WHEN win.value >= {k} * win.std THEN CASE WHEN sv = mx THEN si END
                        ELSE CASE WHEN sv = mn THEN si END END) AS peak_idx,
               min(CASE WHEN abs(sv) = ext.ma THEN si END) AS abs_peak_idx
        FROM win JOIN ext ON ext.channel = win.channel AND ext.idx = win.idx GROUP BY win.channel, win.idx),
fit AS (SELECT *, {first} AS first_idx, {last} AS last_idx
        FROM (SELECT ew.*, hit.peak_idx, hit.abs_peak_idx FROM ew
              JOIN hit ON hit.channel = ew.channel AND hit.idx = ew.idx) WHERE {peak_fits}),
pk AS (SELECT fit.*, p.value AS peak_value, q.value AS abs_peak_value FROM fit
       JOIN sig p ON p.channel = fit.channel AND p.idx = fit.peak_idx
       JOIN sig q ON q.channel = fit.channel AND q.idx = fit.abs_peak_idx),
suc AS (SELECT p.channel, p.idx, min(q.idx) AS nxt FROM pk p JOIN pk q
          ON q.channel = p.channel AND q.idx >= greatest(p.idx + {cfg.dead} + p.last_idx - p.high, p.idx + 1)
        GROUP BY p.channel, p.idx),
pick(channel, idx) AS (
  SELECT channel, min(idx) FROM pk GROUP BY channel
  UNION ALL
  SELECT suc.channel, suc.nxt FROM pick JOIN suc ON suc.channel = pick.channel AND suc.idx = pick.idx),
acc AS (SELECT pk.* FROM pk JOIN pick ON pick.channel = pk.channel AND pick.idx = pk.idx),
cut AS (SELECT acc.channel, acc.idx, min(s.value) AS min_value, max(s.value) AS max_value
        FROM acc JOIN sig s ON s.channel = acc.channel AND s.idx >= acc.first_idx AND s.idx < acc.last_idx
        GROUP BY acc.channel, acc.idx),
spk AS (
  SELECT md5(concat_ws(chr(31), recording_id, acc.channel, CAST(acc.idx AS VARCHAR))) AS key, recording_id AS file,
         CAST({cfg.fs} AS INTEGER) AS sampling_hz, n AS n_values,
         CASE WHEN contains(recording_id, 'rec') THEN 'B' ELSE '' END AS target,
         acc.channel AS column_id, acc.idx AS crossing_idx, peak_value, peak_idx, min_value, max_value,
         CASE WHEN abs_peak_idx <> acc.idx THEN (abs_peak_value - value) / (abs_peak_idx - acc.idx) END AS slope,
         abs(min_value - std) / abs(max_value - std) AS extrema_ratio, first_idx, last_idx
  FROM acc JOIN cut ON cut.channel = acc.channel AND cut.idx = acc.idx)"""


def _polynomials(btype: str, cuts: list[float], fs: float) -> tuple[list[float], list[float]]:
    """Digital second-order Butterworth filter as one fraction of polynomials in 1/z, by substitution into
    1 / (s^2 + sqrt(2) s + 1) and s = c (z - 1) / (z + 1)."""
    w = [2 * fs * math.tan(math.pi * f / fs) for f in cuts]
    r = math.sqrt(2)
    if btype == "lowpass":
        top, under = [w[0] ** 2, 0, 0], [w[0] ** 2, r * w[0], 1]
    elif btype == "highpass":
        top, under = [0, 0, 1], [w[0] ** 2, r * w[0], 1]
    else:
        wide, mid = w[1] - w[0], w[0] * w[1]
        under = [mid**2, r * wide * mid, 2 * mid + wide**2, r * wide, 1]
        top = [0, 0, wide**2, 0, 0] if btype == "bandpass" else [mid**2, 0, 2 * mid, 0, 1]

    def digital(poly: list[float]) -> list[float]:
        m, total = len(poly) - 1, [0.0] * len(poly)
        for k, c in enumerate(poly):
            term = [1.0]
            for sign in [-1] * k + [1] * (m - k):
                term = [a + sign * b for a, b in zip([*term, 0], [0, *term])]
            total = [a + c * (2 * fs) ** k * b for a, b in zip(total, term)]
        return total

    b, a = digital(top), digital(under)
    return [x / a[0] for x in b], [x / a[0] for x in a]


def _zero_phase_sql(source: str, to: str, btype: str, cuts: list[float], fs: float = 1000.0) -> str:
    """CTE ``to`` (sk, idx, value): ``source`` filtered sample by sample, forwards and backwards, odd ends."""
    b, a = _polynomials(btype, cuts, fs)
    m, pad = len(b) - 1, 3 * len(b)
    gain = {"lowpass": 1.0, "bandstop": 1.0}.get(btype, 0.0)
    rest = [0.0] * (m + 2)
    for k in range(m, 0, -1):
        rest[k] = b[k] - a[k] * gain + rest[k + 1]
    held = ", ".join(f"s{k}" for k in range(1, m + 1))

    def recursion(name: str, values: str) -> str:
        y = f"({b[0]!r}::DOUBLE * xs[j + 2] + s1)"
        then = ", ".join(f"{b[k]!r}::DOUBLE * xs[j + 2] - {a[k]!r}::DOUBLE * {y}" + (f" + s{k + 1}" if k < m else "")
                         for k in range(1, m + 1))
        first = ", ".join(f"{rest[k]!r}::DOUBLE * xs[1]" for k in range(1, m + 1))
        return f"""{name}(sk, j, y, {held}) AS (
  SELECT sk, 0::BIGINT, {gain!r}::DOUBLE * xs[1], {first} FROM {values}
  UNION ALL SELECT sk, j + 1, {y}, {then} FROM {name} JOIN {values} USING (sk) WHERE j + 1 < len(xs))"""

    return f"""{to}_v AS MATERIALIZED (SELECT sk, list(value::DOUBLE ORDER BY idx) AS v FROM {source} GROUP BY sk),
{to}_x AS MATERIALIZED (SELECT sk, [2 * v[1] - v[i] for i in range({pad} + 1, 1, -1)] || v || [2 * v[-1] - v[len(v) - i] for i in range(1, {pad} + 1)] AS xs FROM {to}_v),
{recursion(to + "_f", to + "_x")},
{to}_y AS MATERIALIZED (SELECT sk, list(y ORDER BY j DESC) AS xs FROM {to}_f GROUP BY sk),
{recursion(to + "_b", to + "_y")},
{to} AS MATERIALIZED (SELECT sk, len(xs) - 1 - j - {pad} AS idx, y AS value FROM {to}_b JOIN {to}_y USING (sk)
  WHERE j >= {pad} AND j < len(xs) - {pad})"""


def _filtered_sql(*steps: tuple[str, list[float]], digits: int = 3) -> str:
    """Steps of (type, cuts) on the long signal."""
    ctes, source = [], "src"
    for i, (btype, cuts) in enumerate(steps):
        ctes.append(_zero_phase_sql(source, f"z{i}", btype, cuts))
        source = f"z{i}"
    return f"""WITH RECURSIVE {_LONG}, src AS (SELECT channel AS sk, idx, value FROM sig),
{", ".join(ctes)}
SELECT recording_id, channel, idx, round({source}.value, {digits}) + 0.0::DOUBLE AS value
FROM {source} JOIN (SELECT DISTINCT recording_id, channel FROM sig) c ON channel = sk"""


def _chain_sql() -> str:
    """The process_chain query: eight channels, two segments, band-pass, two notches, spectrum, mean, ten values."""
    steps = [("bandpass", [20, 200]), ("bandstop", [98, 102]), ("bandstop", [198, 202])]
    ctes, source = [], "src"
    for i, (btype, cuts) in enumerate(steps):
        ctes.append(_zero_phase_sql(source, f"z{i}", btype, cuts))
        source = f"z{i}"
    return f"""WITH RECURSIVE {_LONG}, {_STATS},
seg AS (SELECT sig.recording_id, sig.channel, idx // (sig.n // 2) AS segment_id, idx % (sig.n // 2) AS idx, sig.n // 2 AS n, value
        FROM sig JOIN rk USING (recording_id, channel) WHERE rank <= 8 AND idx < 2 * (sig.n // 2)),
src AS (SELECT channel || '/' || segment_id AS sk, idx, value FROM seg),
{", ".join(ctes)},
hw AS (SELECT c.*, z.idx, value * (0.5 - 0.5 * cos(2 * pi() * z.idx / (n - 1))) AS v
       FROM {source} z JOIN (SELECT DISTINCT recording_id, segment_id, channel, n FROM seg) c ON sk = channel || '/' || segment_id),
sp AS (SELECT recording_id, segment_id, channel, k, n // 2 AS bins,
              sqrt(power(sum(v * cos(2 * pi() * k * idx / n)), 2) + power(sum(v * sin(2 * pi() * k * idx / n)), 2)) / n AS m
       FROM hw JOIN (SELECT unnest(generate_series(0, (SELECT max(n) FROM seg) // 2)) AS k) b ON k < n // 2
       GROUP BY recording_id, segment_id, channel, k, n),
mean AS (SELECT recording_id, segment_id, k, max(bins) AS bins, round_even(avg(m)::DECIMAL(18, 9), 3)::DOUBLE AS m
         FROM sp GROUP BY recording_id, segment_id, k)
SELECT recording_id, segment_id, (k * 10) // bins AS idx, round_even(avg(m)::DECIMAL(18, 9), 3)::DOUBLE + 0.0::DOUBLE AS value
FROM mean GROUP BY recording_id, segment_id, (k * 10) // bins"""


def _confusion_sql(source: str, train: list[str], test: list[str]) -> str:
    def values(labels: list[str]) -> str:
        return "(VALUES " + ", ".join(f"('{v}')" for v in labels) + ")"

    def listed(column: str, labels: list[str]) -> str:
        return f"CASE WHEN {column} IN (" + ", ".join(f"'{v}'" for v in labels) + f") THEN {column} ELSE 'other' END"

    return f"""grid AS (SELECT p.v AS predicted, a.v AS actual FROM {values(train)} p(v), {values(test)} a(v)),
found AS (SELECT {listed("predicted", train)} AS predicted, {listed("actual", test)} AS actual, count(*) AS c,
                 avg(confidence) AS conf FROM {source} GROUP BY 1, 2),
cells AS (SELECT predicted, actual, coalesce(c, 0) AS n, coalesce(conf, 0) AS conf
          FROM grid FULL JOIN found USING (predicted, actual)),
conf AS (SELECT predicted, actual, CAST(n AS BIGINT) AS n,
                CASE WHEN n > 0 THEN round_even(n::DOUBLE / sum(n) OVER (PARTITION BY actual)::DOUBLE * 100, 1)
                     ELSE 0.0::DOUBLE END AS percent, round_even(conf::DOUBLE, 3) AS cup
         FROM cells)"""


def _r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


def oracle_sql() -> dict[str, str]:
    keys = "recording_id, channel"
    seg = f"""{_SIG}, seg AS (
  SELECT recording_id, channel, channel_pos, idx // (n // 4) AS segment_id, idx % (n // 4) AS idx, n // 4 AS n, value
  FROM sig WHERE idx < 4 * (n // 4))"""
    hann = f"{_SIG}, hw AS (SELECT {keys}, idx, n, value * (0.5 - 0.5 * cos(2 * pi() * idx / (n - 1))) AS v FROM sig)"
    spikes = "WITH RECURSIVE " + _spike_ctes(_SIG, SPIKES)
    trimmed = "WITH RECURSIVE " + _spike_ctes(_LONG, LONG_SPIKES)
    crossing = """SELECT recording_id, channel, idx, {value}, low, high FROM ew"""
    labels = ", ".join(f"max(CASE WHEN actual = '{v}' THEN n END) AS actual_{v}" for v in LABELS)
    split = """feat AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label,
  row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || 's1'), vec_id) AS r,
  count(*) OVER (PARTITION BY label) AS c FROM embeddings)"""
    named = """SELECT vec_id AS row_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' {two} ELSE CAST(label AS VARCHAR) END AS label
FROM embeddings"""
    profile = f"""{_FEAT}, prof AS (
  SELECT label, pos, avg(v) AS mean, stddev_samp(v) AS std FROM feat GROUP BY label, pos)"""
    url_case = "CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/de/') THEN 'german' " \
               "WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, 'example') THEN 'example' END"
    url_last = "CASE WHEN contains(url, 'example') THEN 'example' WHEN contains(url, 'page=') THEN 'paged' " \
               "WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, '/fr/') THEN 'french' END"
    report = f"""WITH {_RUNS}, best AS (SELECT * FROM scored ORDER BY trust DESC, run_id LIMIT 1),
x AS (SELECT 'train' AS metric, tr AS x FROM runs UNION ALL SELECT 'test', te FROM runs UNION ALL SELECT 'kfold', score FROM folds),
m AS (SELECT metric, round_even(avg(x), 3) AS mean, round_even(stddev_pop(x), 3) AS std FROM x GROUP BY metric), v AS (
  SELECT 'best' AS section, 'train_acc' AS name, tr AS value, NULL::DOUBLE AS std, NULL AS text, {_band('tr')} AS band FROM best
  UNION ALL SELECT 'best', 'test_acc', te, NULL, NULL, {_band('te')} FROM best
  UNION ALL SELECT 'best', 'kfold', round_even(cm, 3), round_even(cs, 3), NULL, {_band('round_even(cm, 3)')} FROM best
  UNION ALL SELECT 'best', 'kfold_difference', round_even(tr - round_even(cm, 3), 3), NULL, NULL, NULL FROM best
  UNION ALL SELECT 'best', 'kfold_gap', gap, NULL, NULL, {_gap_band('gap')} FROM best
  UNION ALL SELECT 'best', 'trust', round_even(trust, 3), NULL, NULL, {_band('round_even(trust, 3)')} FROM best
  UNION ALL SELECT 'params', 'supplier', NULL, NULL, CAST(run_id AS VARCHAR), NULL FROM best
  UNION ALL SELECT 'average', metric, mean, std, NULL, {_band('mean')} FROM m
  UNION ALL SELECT 'all', 'runs', count(*)::DOUBLE, NULL, NULL, NULL FROM runs)
SELECT section, name, value, std, text, band FROM v"""
    sql = _corpus()[1] | {
        "signal_positions": f"WITH {_SIG} SELECT {keys}, idx, n, value FROM sig",
        "wide_to_long": _WIDE.format(e2="E2", where="", first=0),
        "recording_files": _WIDE.format(e2="E, 2", where="", first=1),
        "recording_single": _WIDE.format(e2="E, 2", where=" WHERE l_suppkey = 3", first=1),
        "listed_files": "SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, 1::BIGINT AS files FROM lineitem GROUP BY l_suppkey",
        "dataset_file": f"""WITH {_FEAT} SELECT row_id, label, pos::INTEGER AS pos, {_r6('v', 'value')} FROM feat""",
        "split_files": f"""WITH {split} SELECT CASE WHEN r <= floor(0.7 * c) THEN 'train' ELSE 'test' END AS part, row_id, label FROM feat""",
        "signal_files": f"""WITH {seg} SELECT recording_id, segment_id, 1::BIGINT AS files, count(*) AS samples, {_r6('avg(value)', 'mean')}
FROM seg GROUP BY recording_id, segment_id""",
        "channel_stats": f"WITH {_SIG}, {_STATS} SELECT {keys}, n, {_r6('std', 'std')}, {_r6('max_abs', 'max_abs')} FROM st",
        "top_channels": f"WITH {_SIG}, {_STATS} SELECT {keys}, rank, {_r6('std', 'std')} FROM rk WHERE rank <= 5",
        "top_channel_samples": f"""WITH {_SIG}, {_STATS} SELECT sig.recording_id, sig.channel, sig.idx, sig.value
FROM sig JOIN rk ON rk.channel = sig.channel AND rk.recording_id = sig.recording_id WHERE rank <= 3""",
        "drop_channels": f"""WITH {_SIG} SELECT {keys}, count(*) AS samples FROM sig
WHERE NOT contains(channel, '1') GROUP BY {keys}""",
        "segments": f"""WITH {seg} SELECT {keys}, segment_id, count(*) AS samples, max(idx) AS last_idx,
{_r6('avg(value)', 'mean')} FROM seg GROUP BY {keys}, segment_id""",
        "channel_mean": f"""WITH {seg} SELECT recording_id, segment_id, idx, round_even(avg(value)::DECIMAL(18, 9), 3)::DOUBLE AS value
FROM seg GROUP BY recording_id, segment_id, idx""",
        "resample_mean": f"""WITH {_SIG} SELECT {keys}, (idx * 8) // n AS idx, {_r6('avg(value)', 'value')}
FROM sig GROUP BY {keys}, (idx * 8) // n""",
        "resample_linear": f"""WITH {_SIG},
nxt AS (SELECT *, lead(value) OVER (PARTITION BY channel ORDER BY idx) AS v2 FROM sig),
pts AS (SELECT {keys}, n, k, (k * (n - 1)) // 8 AS lo, ((k * (n - 1)) % 8) / 8.0::DOUBLE AS f
        FROM (SELECT DISTINCT {keys}, n FROM sig), generate_series(0, 8) g(k))
SELECT pts.recording_id, pts.channel, k AS idx,
       {_r6('value + CASE WHEN f > 0 THEN f * (v2 - value) ELSE 0 END', 'value')}
FROM pts JOIN nxt ON nxt.channel = pts.channel AND nxt.idx = lo""",
        "feature_rows": f"""WITH {_SIG}, seg AS (
  SELECT {keys}, idx // (n // 2) AS segment_id, idx % (n // 2) AS idx, n // 2 AS n, value FROM sig WHERE idx < 2 * (n // 2))
SELECT recording_id || '/' || segment_id || '/' || channel AS row_id, (idx * 6) // n AS pos, {_r6('avg(value)', 'value')}
FROM seg GROUP BY recording_id, segment_id, channel, (idx * 6) // n""",
        "dataset_pipeline": f"""WITH {_SIG}, {_STATS},
seg AS (SELECT sig.recording_id, sig.idx // (sig.n // 4) AS segment_id, sig.idx % (sig.n // 4) AS idx, sig.n // 4 AS n, value
        FROM sig JOIN rk ON rk.channel = sig.channel WHERE rank <= 5 AND sig.idx < 4 * (sig.n // 4)),
mean AS (SELECT recording_id, segment_id, idx, round_even(avg(value)::DECIMAL(18, 9), 3)::DOUBLE AS value, max(n) AS n
         FROM seg GROUP BY recording_id, segment_id, idx)
SELECT recording_id, segment_id,
       CASE recording_id WHEN 'rec0' THEN 'zero' WHEN 'rec1' THEN 'one' WHEN 'rec2' THEN 'rec2' END AS label,
       (idx * 4) // n AS pos, {_r6('avg(value)', 'value')}
FROM mean WHERE recording_id <> 'rec3' GROUP BY recording_id, segment_id, (idx * 4) // n""",
        "butterworth": _filtered_sql(("lowpass", [50])),
        "butterworth_blocks": _filtered_sql(("highpass", [5])),
        "notch_harmonics": _filtered_sql(("bandstop", [98, 102]), ("bandstop", [298, 302]), digits=2),
        "process_chain": _chain_sql(),
        "hann_window": f"WITH {hann} SELECT {keys}, idx, {_r6('v', 'value')} FROM hw",
        "spectrum_bins": f"""WITH {hann} SELECT {keys}, k AS bin, {_r6('k * 1000.0::DOUBLE / max(n)', 'freq_hz')},
{_r6('sqrt(power(sum(v * cos(2 * pi() * k * idx / n)), 2) + power(sum(v * sin(2 * pi() * k * idx / n)), 2)) / max(n)', 'magnitude')}
FROM hw, (VALUES (1::BIGINT), (2), (5)) b(k) GROUP BY {keys}, k""",
        "spectrum": f"""WITH {hann} SELECT {keys}, k AS bin, {_r6('k * 1000.0::DOUBLE / max(n)', 'freq_hz')},
{_r6('sqrt(power(sum(v * cos(2 * pi() * k * idx / n)), 2) + power(sum(v * sin(2 * pi() * k * idx / n)), 2)) / max(n)', 'magnitude')}
FROM hw JOIN (SELECT unnest(generate_series(0, (SELECT max(n) FROM sig) // 2)) AS k) b ON k < n // 2 GROUP BY {keys}, k""",
        "harmonics": """SELECT p_size, parts, k AS "order", p_size * k AS harmonic
FROM (SELECT CAST(p_size AS BIGINT) AS p_size, count(*) AS parts FROM part GROUP BY 1), generate_series(1, 9, 2) g(k)""",
        "path_select": """SELECT page_id, url AS path FROM pages WHERE contains(url, 'http') AND contains(url, 'example')
AND NOT contains(url, '/fr/') AND NOT contains(url, 'ref=x')""",
        "path_target_first": f"SELECT page_id, {url_case} AS target FROM pages",
        "path_target_last": f"SELECT page_id, {url_last} AS target FROM pages WHERE {url_last} IS NOT NULL",
        "path_counts": """SELECT contains(url, '/fr/') OR contains(url, '/de/') AS targeted, count(*) AS files
FROM pages GROUP BY 1""",
        "filter_labels": "SELECT vec_id AS row_id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE label IN (1, 3, 5)",
        "rename_labels": named.format(two="WHEN 2 THEN 'zero'"),
        "encode_labels": f"WITH x AS ({named.format(two='')}) SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS label_code FROM x",
        "split_train": f"WITH {split} SELECT row_id, label FROM feat WHERE r <= floor(0.7 * c)",
        "split_test": f"WITH {split} SELECT row_id, label FROM feat WHERE r > floor(0.7 * c)",
        "forest_nodes": """SELECT unnest(range(8)) AS tree, true AS few_leaves, true AS weights_add_up, true AS impurity_fits,
true AS splits_have_rows""",
        "svc_probabilities": f"WITH {split} SELECT label, count(*) AS n, count(*) AS sound FROM feat WHERE r > floor(0.7 * c) GROUP BY label",
        "merge_sets": """SELECT label, count(*) AS n FROM (
  SELECT CAST(label AS VARCHAR) AS label FROM embeddings WHERE label IN (1, 2)
  UNION ALL SELECT CAST(label AS VARCHAR) FROM embeddings WHERE label IN (2, 3)) GROUP BY label""",
        "describe": "SELECT count(*) AS n_rows, CAST(max(len(embedding)) + 1 AS BIGINT) AS n_columns FROM embeddings",
        "distinct_values": "SELECT DISTINCT CAST(label AS VARCHAR) AS label FROM embeddings",
        "fold_assignment": """SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label,
(row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || 'k'), vec_id) - 1) % 5 AS fold FROM embeddings""",
        "label_profile": f"""WITH {profile} SELECT label, pos, {_r6('mean', 'mean')}, {_r6('std', 'std')},
{_r6('mean - std', 'lower')}, {_r6('mean + std', 'upper')} FROM prof""",
        "profile_range": f"""WITH {profile} SELECT {_r6('least(0.0::DOUBLE, min(mean - std))', 'ymin')},
{_r6('greatest(0.0::DOUBLE, max(mean + std))', 'ymax')} FROM prof""",
        "spike_crossings": f"{spikes} {crossing.format(value='value, ' + _r6('std', 'std'))}",
        "spike_crossings_trimmed": f"{trimmed} {crossing.format(value=_r6('value', 'value'))}",
        "spike_peaks": f"""{spikes} SELECT recording_id, channel, idx, peak_idx, peak_value, abs_peak_idx, abs_peak_value,
first_idx, last_idx FROM pk""",
        "spike_refractory": f"{spikes} SELECT recording_id, channel, idx, peak_idx FROM acc",
        "spike_features": f"""{spikes} SELECT key, file, sampling_hz, n_values, target, column_id, crossing_idx, peak_value,
peak_idx, min_value, max_value, {_r6('slope', 'slope')}, {_r6('extrema_ratio', 'extrema_ratio')}, first_idx, last_idx FROM spk""",
        "spike_file": f"""{spikes} SELECT key, file, sampling_hz, n_values, target, column_id, crossing_idx, peak_value,
peak_idx, min_value, max_value, {_r6('slope', 'slope')}, {_r6('extrema_ratio', 'extrema_ratio')}, first_idx, last_idx,
4::BIGINT AS unit_headers FROM spk""",
        "spike_features_trimmed": f"""{trimmed} SELECT file, column_id, crossing_idx, peak_idx, {_r6('peak_value', 'peak_value')},
first_idx, last_idx, {_r6('min_value', 'min_value')}, {_r6('max_value', 'max_value')}, round(slope, 4) AS slope,
round(extrema_ratio, 4) AS extrema_ratio FROM spk""",
        "spike_waveforms": f"""{spikes} SELECT key, CAST(s.idx - first_idx AS INTEGER) AS pos, s.value
FROM spk JOIN sig s ON s.channel = column_id AND s.idx >= first_idx AND s.idx < last_idx WHERE file = 'rec1'""",
        "filter_spikes": f"""{spikes} SELECT file, column_id, count(*) AS spikes FROM spk
WHERE file IN ('rec0', 'rec3') GROUP BY file, column_id""",
        "raster_slope": f"""{spikes},
ras AS (SELECT key, peak_idx AS x, dense_rank() OVER (ORDER BY column_id) - 1 AS y,
               coalesce(slope, 1.1::DOUBLE * max(slope) OVER ()) AS c FROM spk)
SELECT key, x, y, {_r6('c', 'color_raw')}, {_r6('(c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ())', 'color_value')} FROM ras""",
        "raster_file": f"""{spikes},
ras AS (SELECT key, file, peak_idx AS x, dense_rank() OVER (ORDER BY column_id) - 1 AS y FROM spk)
SELECT key, x, y, dense_rank() OVER (ORDER BY file) - 1 AS color_class, file AS legend FROM ras
WHERE file IN ('rec1', 'rec2')""",
        "raster_limits": f"""{spikes} SELECT count(DISTINCT column_id) AS n_channels,
max(CASE WHEN file IN ('rec1', 'rec2') THEN n_values END) AS max_values FROM spk""",
        "nearest_spike": f"""{spikes},
pts AS (SELECT o_orderkey, CAST(o_custkey % 150 AS VARCHAR) AS column_id, o_orderkey % 80 AS x FROM orders),
cand AS (SELECT o_orderkey, key, peak_idx,
                row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(peak_idx - x), peak_idx, key) AS r
         FROM pts LEFT JOIN spk USING (column_id))
SELECT o_orderkey, key AS nearest_key, peak_idx AS nearest_idx FROM cand WHERE r = 1""",
        "spike_neighbours": f"""{spikes} SELECT column_id, key, peak_idx,
coalesce(lead(key) OVER w, key) AS next_key, coalesce(lead(peak_idx) OVER w, peak_idx) AS next_idx,
coalesce(lag(key) OVER w, key) AS prev_key, coalesce(lag(peak_idx) OVER w, peak_idx) AS prev_idx
FROM spk WINDOW w AS (PARTITION BY column_id ORDER BY peak_idx, key)""",
        "accuracy": f"WITH {_PRED} SELECT round_even(avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS accuracy FROM pred",
        "macro_metrics": f"""WITH {_PRED},
per AS (SELECT l, sum(CASE WHEN predicted = l AND actual = l THEN 1 ELSE 0 END)::DOUBLE AS tp,
               sum(CASE WHEN actual = l THEN 1 ELSE 0 END)::DOUBLE AS was,
               sum(CASE WHEN predicted = l THEN 1 ELSE 0 END)::DOUBLE AS said
        FROM pred, (SELECT predicted AS l FROM pred UNION SELECT actual FROM pred) GROUP BY l)
SELECT round_even(avg(CASE WHEN was + said > 0 THEN 2 * tp / (was + said) ELSE 0 END), 3) AS f1,
       round_even(avg(CASE WHEN was > 0 THEN tp / was ELSE 0 END), 3) AS recall,
       round_even(avg(CASE WHEN said > 0 THEN tp / said ELSE 0 END), 3) AS "precision" FROM per""",
        "cup_stats": f"""WITH {_PRED}, c AS (SELECT predicted AS target FROM pred UNION SELECT actual FROM pred)
SELECT 'testing' AS phase, target,
count(*) FILTER (WHERE predicted = actual) AS n_true,
round_even(avg(confidence) FILTER (WHERE predicted = actual), 3) AS mean_cup_true,
round_even(stddev_pop(confidence) FILTER (WHERE predicted = actual), 3) AS std_cup_true,
count(*) FILTER (WHERE predicted <> actual) AS n_false,
round_even(avg(confidence) FILTER (WHERE predicted <> actual), 3) AS mean_cup_false,
round_even(stddev_pop(confidence) FILTER (WHERE predicted <> actual), 3) AS std_cup_false
FROM c LEFT JOIN pred ON predicted = target GROUP BY target""",
        "confusion": f"WITH {_PRED}, {_confusion_sql('pred', LABELS[:8], LABELS[:6])} SELECT predicted, actual, n, percent, cup FROM conf",
        "confusion_cells": f"""WITH {_PRED}, {_confusion_sql('pred', LABELS, LABELS)}
SELECT 9 - CAST(predicted AS BIGINT) AS row_index, 9 - CAST(actual AS BIGINT) AS column_index,
       CASE WHEN n > 0 THEN CAST(percent AS VARCHAR) ELSE '0' END || '%' || chr(10) || 'CUP='
         || CASE WHEN n > 0 THEN CAST(cup AS VARCHAR) ELSE '0' END AS annotation FROM conf""",
        "confusion_matrix": f"WITH {_PRED}, {_confusion_sql('pred', LABELS, LABELS)} SELECT predicted, {labels} FROM conf GROUP BY predicted",
        "label_confusion": f"""WITH pred AS (SELECT CAST(quality AS VARCHAR) AS predicted, CAST(toxic AS VARCHAR) AS actual,
0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS confidence FROM labels), {_confusion_sql('pred', ['0', '1'], ['0', '1'])}
SELECT predicted, actual, n, percent, cup FROM conf""",
        "run_scores": f"""WITH {_RUNS} SELECT run_id, {_r6('cm', 'cv_mean')}, {_r6('cs', 'cv_std')}, {_r6('trust', 'trust')},
{_band('tr')} AS band FROM scored""",
        "run_gaps": f"""WITH {_RUNS}, g AS (SELECT run_id, round_even(abs(round_even(tr - cm, 3)) / tr * 100, 2) AS gap FROM runs)
SELECT run_id, gap, CASE WHEN gap <= 2 THEN 'minor' WHEN gap <= 5 THEN 'moderate' WHEN gap <= 10 THEN 'significant'
ELSE 'very high' END AS risk, {_gap_band('gap')} AS band FROM g""",
        "best_runs": f"WITH {_RUNS} " + " UNION ALL ".join(
            f"(SELECT '{name}' AS score, run_id FROM scored ORDER BY {expr} DESC, run_id LIMIT 1)"
            for name, expr in (("trust", "trust"), ("relative_cv", "-gap"), ("cv", "cm"), ("train", "tr"), ("test", "te"))
        ),
        "runs_summary": f"""WITH {_RUNS}, v AS (SELECT 'train' AS metric, tr AS x FROM runs
  UNION ALL SELECT 'test', te FROM runs UNION ALL SELECT 'kfold', score FROM folds)
SELECT metric, round_even(avg(x), 3) AS mean, round_even(stddev_pop(x), 3) AS std FROM v GROUP BY metric""",
        "run_report": report,
        "report_file": report,
        "forest_importance_sum": "SELECT max(len(embedding))::BIGINT AS features, 1.0::DOUBLE AS total FROM embeddings",
        "forest_saved": f"WITH {split} SELECT label, count(*) AS n, count(*) AS same FROM feat WHERE r > floor(0.7 * c) GROUP BY label",
        "learn_runs": """SELECT n_estimators, max_depth, 'gini' AS criterion, 'True' AS bootstrap, 2 AS folds, true AS shares
FROM (VALUES ('2'), ('3')) a(n_estimators), (VALUES ('2'), ('4')) b(max_depth)""",
        "param_grid": """SELECT p_size::BIGINT AS p_size, p_brand, 100::BIGINT AS n_estimators
FROM (SELECT DISTINCT p_size FROM part ORDER BY 1 LIMIT 4), (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 4)""",
        "standardized": f"""WITH {_FEAT}, s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM feat GROUP BY pos)
SELECT row_id, CAST(pos AS INTEGER) AS pos, {_r6('(v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 'value')} FROM feat JOIN s USING (pos)""",
        "ellipse": f"""WITH RECURSIVE {_PCA}, st AS (SELECT label, avg(pc1) AS center_x, avg(pc2) AS center_y, var_samp(pc1) AS var_x,
  var_samp(pc2) AS var_y, covar_samp(pc1, pc2) AS cov_xy, corr(pc1, pc2) AS pearson FROM scores GROUP BY label)
SELECT label, {", ".join(f"round({x}, 5) + 0.0::DOUBLE AS {name}" for x, name in (
    ("center_x", "center_x"), ("center_y", "center_y"), ("var_x", "var_x"), ("var_y", "var_y"), ("cov_xy", "cov_xy"),
    ("pearson", "pearson"), ("sqrt(1 + pearson)", "radius_x"), ("sqrt(1 - pearson)", "radius_y"), ("sqrt(var_x)", "scale_x"),
    ("sqrt(var_y)", "scale_y")))} FROM st""",
        "pca_scores": f"""WITH RECURSIVE {_PCA}
SELECT row_id, label, round(pc1, 5) + 0.0::DOUBLE AS pc1, round(pc2, 5) + 0.0::DOUBLE AS pc2 FROM scores""",
        "pca_explained": f"""WITH RECURSIVE {_PCA}
SELECT component, pos, round(100 * share, 2) AS explained, round(v, 5) + 0.0::DOUBLE AS loading FROM parts""",

    }
    for name in ("signal_positions_cells", "spike_features_blocks", "spectrum_grid", "nearest_spike_cells", "spike_neighbours_cells"):
        sql[name] = sql[name.rpartition("_")[0]]
    return sql
