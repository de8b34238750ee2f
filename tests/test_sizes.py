"""Answers must not depend on the sizes of cells and blocks, nor lose rows with nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sigspark.learning import models
from sigspark.operators import dataset as ds
from sigspark.operators import evaluate as ev
from sigspark.operators import filters as fl
from sigspark.operators import raster as ra
from sigspark.operators.scale import with_position


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("limit", [1000, 10, 3])
def test_positions_keep_nulls_in_order_and_key(spark, limit):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1e12, 5.0, *map(float, range(30))]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    got = with_position(df, ["k"], ["x", "i"], "at", "n", limit).collect()
    want = set()
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (
            (0, 0.0) if r[1] is None else (2, 0.0) if math.isnan(r[1]) else (1, r[1]), r[2]))
        want |= {(key, i, at, len(own)) for at, (_, _, i) in enumerate(own)}
    assert {(r["k"], r["i"], r["at"], r["n"]) for r in got} == want and len(got) == len(rows)


def test_an_outlier_does_not_change_nearest_or_neighbours(spark):
    rng = random.Random(2)
    spikes = [("c", f"k{i}", rng.randrange(500)) for i in range(300)] + [("c", "far", 10**9), ("d", "one", 4), (None, "none", 7)]
    table = spark.createDataFrame(spikes, "column_id string, key string, peak_idx long")
    points = spark.createDataFrame([("c", rng.randrange(-50, 700)) for _ in range(150)] + [("d", 9), ("e", 1)], "column_id string, x long")
    assert rows_of(ra.nearest_spike(points, table)) == rows_of(ra.nearest_spike(points, table, 4))
    assert rows_of(ra.neighbours(table)) == rows_of(ra.neighbours(table, 4))


@pytest.mark.parametrize("block", [None, 1000])
def test_filters_refuse_null_samples(spark, long_signal, block):
    df = long_signal({("r", "c"): [math.sin(i / 9) for i in range(4000)]})
    spoilt = df.withColumn("value", F.when(F.col("idx") != 17, F.col("value")))
    with pytest.raises(Exception, match="null or NaN sample"):
        fl.butter_filter(spoilt, 2, "lowpass", [50], 1000, block).collect()


def test_folds_and_split_keep_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"l{i % 3}", [float(i)]) for i in range(100)],
                               "row_id long, label string, features array<double>")
    assert ds.assign_folds(df, 4).count() == 100
    train, test = ds.split(df, 0.5)
    assert train.where("label IS NULL").count() == 0 and test.where("label IS NULL").count() == 20
    assert train.count() + test.count() == 100


def test_split_of_a_set_merged_with_itself_is_exact(spark):
    df = spark.createDataFrame([(i, f"l{i % 2}", [float(i)]) for i in range(100)], "row_id long, label string, features array<double>")
    twice = df.union(df)
    train, test = ds.split(twice, 0.33)
    assert {(r["label"], r["count"]) for r in train.groupBy("label").count().collect()} == {("l0", 33), ("l1", 33)}
    assert rows_of(train.union(test)) == rows_of(twice)


def test_reports_keep_every_class(spark):
    pred = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.6), ("a", "z", 0.5)], "predicted string, actual string, confidence double")
    stats = {r["target"]: (r["n_true"], r["n_false"]) for r in ev.cup_stats(pred, "testing").collect()}
    assert stats == {"a": (1, 2), "b": (0, 0), "z": (0, 0)}
    wide = ev.pivot_confusion(ev.confusion(pred, ["a", "b"], ["a", "b"]), ["a", "b"]).where("predicted = 'a'").first()
    assert (wide["a"], wide["b"], wide["other"]) == (1, 1, 1)


def test_a_depth_beyond_the_deepest_is_refused(spark):
    df = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "row_id long, label string, features array<double>")
    with pytest.raises(ValueError, match="max_depth"):
        models.train_rf(df, {"max_depth": 50})
