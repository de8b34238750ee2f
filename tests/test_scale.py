"""Helpers that split hot keys must give the same answer as one plain window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigspark.operators import dataset as ds
from sigspark.operators import raster as ra
from sigspark.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds most rows; many rows share an ordering value."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", float(int(rng.gauss(0, 40))), i) for i in range(3000)]
    rows += [("one", 1.0, 9001), ("flat", 2.0, 9002), ("flat", 2.0, 9003)]
    return spark.createDataFrame(rows, "k string, t double, id long")


@pytest.mark.parametrize("limit", [10_000, 50, 7])
def test_with_position(skewed, limit):
    got = scale.with_position(skewed, ["k"], ["t", "id"], rows_per_cell=limit)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.withColumn("n", F.count("*").over(Window.partitionBy("k"))).withColumn(
        "idx", (F.row_number().over(w) - 1).cast("long")
    )
    cols = ["k", "t", "id", "n", "idx"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_position_with_an_outlier_and_ties(spark):
    """One far value would put all others into one equal-width cell."""
    rows = [("hot", 1e12, 0)] + [("hot", float(i % 3), i) for i in range(1, 1500)] + [("k", 0.0, 1)]
    df = spark.createDataFrame(rows, "k string, t double, id long")
    got = scale.with_position(df, ["k"], ["t", "id"], rows_per_cell=100)
    want = sorted((t, i) for k, t, i in rows if k == "hot")
    mine = sorted((r["idx"], r["t"], r["id"]) for r in got.where("k = 'hot'").collect())
    assert mine == [(n, *row) for n, row in enumerate(want)]


def test_hash_rank_with_many_cells(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("a").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    monkeypatch.setattr(scale, "ROWS_PER_CELL", 100)
    assert scale.hash_digits(df) == 3
    got = [r["row_id"] for r in scale.rank_by_hash(df, ["k"], "h", "row_id", "p").orderBy("p").collect()]
    assert got == [r["row_id"] for r in df.orderBy("h").collect()]


def test_cells_bound_a_hot_key(skewed):
    celled, single = scale.with_cells(skewed, ["k"], F.col("t"), rows_per_cell=50)
    assert not single
    hot = celled.where("k = 'hot'").groupBy("_cell").count().collect()
    assert len(hot) > 20 and max(r["count"] for r in hot) < 500


def test_dense_ranks(spark, skewed):
    got = {r["k"]: r["rank"] for r in scale.dense_ranks(skewed, "k", "rank").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 8


def test_small_side_hint_depends_on_count(spark, monkeypatch):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(100).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = big.join(scale.small_side(small), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 5)
        plan = big.join(scale.small_side(small), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_shared_dir_needs_setting_off_local(spark):
    assert scale.shared_dir(spark)


@pytest.fixture(scope="module")
def spikes(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        ch = "hot" if rng.random() < 0.7 else f"c{rng.randrange(4)}"
        rows.append((f"{i:05d}", ch, rng.randrange(4000)))
    return spark.createDataFrame(rows, "key string, column_id string, peak_idx long")


@pytest.mark.parametrize("limit", [None, 40])
def test_neighbours(spikes, limit):
    got = {r["key"]: r for r in ra.neighbours(spikes, limit).collect()}
    by = {}
    for r in spikes.collect():
        by.setdefault(r["column_id"], []).append((r["peak_idx"], r["key"]))
    for rows in by.values():
        rows.sort()
        for i, (_, key) in enumerate(rows):
            nxt, prev = rows[min(i + 1, len(rows) - 1)], rows[max(i - 1, 0)]
            g = got[key]
            assert (g["next_idx"], g["next_key"], g["prev_idx"], g["prev_key"]) == (*nxt, *prev)


@pytest.mark.parametrize("limit", [None, 40])
def test_nearest(spark, spikes, limit):
    rng = random.Random(8)
    points = [(i, rng.choice(["hot", "c0", "c1", "none"]), rng.randrange(-500, 6000)) for i in range(700)]
    df = spark.createDataFrame(points, "p long, column_id string, x long")
    by = {}
    for r in spikes.collect():
        by.setdefault(r["column_id"], {}).setdefault(r["peak_idx"], []).append(r["key"])
    got = {r["p"]: r for r in ra.nearest_spike(df, spikes, limit).collect()}
    assert len(got) == len(points)
    for p, ch, x in points:
        if ch not in by:
            assert got[p]["nearest_key"] is None
            continue
        idx = min(by[ch], key=lambda v: (abs(v - x), v))
        assert (got[p]["nearest_idx"], got[p]["nearest_key"]) == (idx, min(by[ch][idx]))


def test_split_is_exact_disjoint_repeatable(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("label"))
    train, test = ds.split(df, 0.7, "x")
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    got = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert got == {k: int(0.7 * v) for k, v in counts.items()}
    a, b = {r[0] for r in train.select("row_id").collect()}, {r[0] for r in test.select("row_id").collect()}
    assert not a & b and len(a | b) == 1003
    assert a == {r[0] for r in ds.split(df.repartition(7), 0.7, "x")[0].select("row_id").collect()}
    assert a != {r[0] for r in ds.split(df, 0.7, "y")[0].select("row_id").collect()}


def test_split_of_tiny_label_is_all_test(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "row_id long, label string")
    train, test = ds.split(df, 0.5)
    assert train.count() == 1 and test.where("label = 'a'").count() == 1


def test_folds_are_even(spark):
    df = spark.range(503).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("string").alias("label"))
    sizes = ds.assign_folds(df, 5).groupBy("label", "fold").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} <= {50, 51}
