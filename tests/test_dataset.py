"""Feature sets, evaluation tables, runs, PCA and models."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import columns as fn
from sigspark.learning import models as ml
from sigspark.operators import dataset as ds
from sigspark.operators import evaluate as ev
from sigspark.operators import pca as pc
from sigspark.operators import runs as rn
from sigspark.plans.config import LearnConfig
from sigspark.plans.learn import kfold_scores, learn


@pytest.fixture(scope="module")
def blobs(spark):
    """Three well separated classes of 5 features."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        label = "low mid high".split()[i % 3]
        centre = {"low": 0.0, "mid": 4.0, "high": 8.0}[label]
        rows.append((i, [float(v) for v in rng.normal(centre, 1.0, 5)], label))
    return spark.createDataFrame(rows, "row_id long, features array<double>, label string").cache()


def test_make_dataset(long_signal):
    sig = long_signal({("r", "b"): [3.0, 1.0, 2.0], ("r", "a"): [9.0, 8.0, 7.0]})
    rows = ds.make_dataset(sig).orderBy("row_id").collect()
    assert [(r["row_id"], list(r["features"])) for r in rows] == [("r/a", [9, 8, 7]), ("r/b", [3, 1, 2])]


def test_labels(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 5)], "row_id long, label long")
    assert ds.filter_labels(df, ["5"]).count() == 2
    assert {r["label"] for r in ds.rename_labels(df, {"5": "five", "x": "y"}).collect()} == {"five", "7"}
    assert ds.rename_labels(df, {}).schema == df.schema
    coded = {r["label"]: r["label_code"] for r in ds.encode_labels(df).collect()}
    assert coded == {5: 0, 7: 1}


def test_merge(blobs):
    assert ds.merge(blobs, blobs).count() == 480
    with pytest.raises(ValueError):
        ds.merge(blobs, blobs.select("label", "row_id", "features"))


def test_explore(blobs):
    assert ds.describe_dataset(blobs).first().asDict() == {"n_rows": 240, "n_columns": 6}
    assert {r[0] for r in ds.distinct_values(blobs, "label", 3).collect()} == {"low", "mid", "high"}
    with pytest.raises(ValueError):
        ds.distinct_values(blobs, "label", 2)
    assert ds.distinct_values(blobs, "label", 2, proceed=True).count() == 3


def test_profile(blobs):
    rows = blobs.collect()
    got = {(r["label"], r["pos"]): r for r in ds.profile(blobs).collect()}
    lows, highs = [0.0], [0.0]
    for label in ("low", "mid", "high"):
        x = np.array([r["features"] for r in rows if r["label"] == label])
        for pos in range(5):
            r = got[(label, pos)]
            assert r["mean"] == pytest.approx(x[:, pos].mean()) and r["std"] == pytest.approx(x[:, pos].std(ddof=1))
            lows.append(r["lower"])
            highs.append(r["upper"])
    assert ds.profile_range(ds.profile(blobs)).first().asDict() == {"ymin": min(lows), "ymax": max(highs)}


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(3)
    rows = [(str(p), str(a), float(c)) for p, a, c in zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.random(300))]
    return spark.createDataFrame(rows, "predicted string, actual string, confidence double").cache()


def test_macro_metrics(pred):
    rows = [(r[0], r[1]) for r in pred.collect()]
    f1, rec, pre = [], [], []
    for label in sorted({v for r in rows for v in r}):
        tp = sum(p == a == label for p, a in rows)
        said, was = sum(p == label for p, _ in rows), sum(a == label for _, a in rows)
        f1.append(2 * tp / (said + was) if said + was else 0)
        rec.append(tp / was if was else 0)
        pre.append(tp / said if said else 0)
    got = ev.macro_metrics(pred).first()
    assert got["f1"] == pytest.approx(np.mean(f1), abs=6e-4)
    assert got["recall"] == pytest.approx(np.mean(rec), abs=6e-4)
    assert got["precision"] == pytest.approx(np.mean(pre), abs=6e-4)
    assert ev.accuracy(pred).first()[0] == pytest.approx(np.mean([p == a for p, a in rows]), abs=6e-4)


def test_cup_stats(pred):
    rows = pred.collect()
    for r in ev.cup_stats(pred, "testing").collect():
        right = [x[2] for x in rows if x[0] == r["target"] and x[0] == x[1]]
        wrong = [x[2] for x in rows if x[0] == r["target"] and x[0] != x[1]]
        assert (r["n_true"], r["n_false"]) == (len(right), len(wrong))
        if right:
            assert r["mean_cup_true"] == pytest.approx(np.mean(right), abs=6e-4)
            assert r["std_cup_true"] == pytest.approx(np.std(right), abs=6e-4)


def test_confusion(pred):
    rows = pred.collect()
    table = ev.confusion(pred, ["0", "1", "2", "9"], ["0", "1"])
    got = {(r["predicted"], r["actual"]): r for r in table.collect()}
    assert sum(r["n"] for r in got.values()) == 300
    assert set(got) >= set(itertools.product(["0", "1", "2", "9"], ["0", "1"])) and ("other", "other") in got
    for (p, a), r in got.items():
        same = [x[2] for x in rows if (x[0] if x[0] in "012" else "other") == p and (x[1] if x[1] in "01" else "other") == a]
        assert r["n"] == len(same)
        if same:
            total = sum(v["n"] for (_, b), v in got.items() if b == a)
            assert r["percent"] == pytest.approx(100 * len(same) / total, abs=0.051)
            assert r["cup"] == pytest.approx(np.mean(same), abs=6e-4)
        else:
            assert (r["percent"], r["cup"]) == (0, 0)


def test_confusion_display(spark, pred):
    table = ev.confusion(pred, ["0", "1", "2", "3"], ["0", "1", "2"])
    placed = ev.reorder(table, {"0": 3, "1": 2, "2": 1, "3": 0}, {"0": 1, "1": 0, "2": 2})
    first = placed.first()
    assert (first["predicted"], first["actual"]) == ("3", "1")
    with pytest.raises(ValueError):
        ev.reorder(table, {"0": 0, "1": 0}, {"0": 0})
    with pytest.raises(ValueError):
        ev.reorder(table, {"0": 0, "1": 2}, {"0": 0})
    one = spark.createDataFrame([("a", "b", 3, 12.5, 0.9), ("a", "c", 0, 0.0, 0.0)], "predicted string, actual string, n long, percent double, cup double")
    texts = [[r["annotation"] for r in ev.annotate(one, *m).orderBy("actual").collect()] for m in
             (("percent", "with"), ("numeric", "without"), ("percent", "only"))]
    assert texts == [["12.5%\nCUP=0.9", "0%\nCUP=0"], ["3", "0"], ["0.9", "0"]]
    wide = ev.pivot_confusion(table, ["0", "1", "2"]).collect()
    assert len(wide) == 4 and wide[0].asDict().keys() == {"predicted", "0", "1", "2"}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (0, {"a": "1"}, [0.8, 0.9, 0.7], 0.95, 0.80, 0.8, 0.8, 0.8),
        (1, {"a": "2"}, [0.85, 0.86, 0.87], 0.90, 0.85, 0.8, 0.8, 0.8),
        (2, {"a": "3"}, [0.85, 0.86, 0.87], 0.90, 0.85, 0.8, 0.8, 0.8),
        (3, {"a": "4"}, [0.6, 0.6, 0.6], 0.58, 0.99, 0.8, 0.8, 0.8),
    ]
    return spark.createDataFrame(rows, "run_id long, params map<string,string>, cv_scores array<double>, train_acc double, test_acc double, f1 double, recall double, precision double")


def test_trust_and_gap(runs):
    for r in rn.with_scores(runs).collect():
        k = np.array(r["cv_scores"])
        raw = r["test_acc"] - 0.5 * abs(r["train_acc"] - r["test_acc"]) - 0.2 * k.std() - 0.3 * (
            abs(r["test_acc"] - k.mean()) + abs(r["train_acc"] - k.mean())) / 2
        assert r["trust"] == pytest.approx((raw + 0.9) / 1.9)
        assert r["gap"] == pytest.approx(round(round(r["train_acc"] - k.mean(), 3) / r["train_acc"] * 100, 2))
    assert rn.with_scores(runs, True).where("run_id = 3").first()["gap"] > 0


@pytest.mark.parametrize("score,absolute,want", [("trust", False, 1), ("relative_cv", False, 3), ("relative_cv", True, 3),
                                                 ("cv", False, 1), ("train", False, 0), ("test", False, 3)])
def test_best_run(runs, score, absolute, want):
    assert rn.best_run(runs, score, absolute).first()["run_id"] == want


def test_runs_summary_and_report(runs):
    got = {r["metric"]: (r["mean"], r["std"]) for r in rn.runs_summary(runs).collect()}
    train = [0.95, 0.9, 0.9, 0.58]
    assert got["train"] == (pytest.approx(np.mean(train), abs=6e-4), pytest.approx(np.std(train), abs=6e-4))
    rows = {(r["section"], r["name"]): r for r in rn.report(runs).collect()}
    assert rows[("params", "a")]["text"] == "2" and rows[("all", "runs")]["value"] == 4
    assert rows[("best", "train_acc")]["band"] == "green" and rows[("best", "test_acc")]["band"] == "yellow"
    assert ("average", "kfold") in rows and rows[("best", "kfold_gap")]["band"] == "yellow"


def test_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.65,), (0.8,), (0.95,)], "x double")
    assert [r[0] for r in df.select(fn.score_band(F.col("x"))).collect()] == ["red", "orange", "yellow", "green"]
    df = spark.createDataFrame([(2.0,), (-4.0,), (7.0,), (30.0,)], "x double")
    assert [r[0] for r in df.select(fn.overfit_band(F.col("x"))).collect()] == ["minor", "moderate", "significant", "very high"]
    assert [r[0] for r in df.select(fn.score_band(F.col("x"), "kfold")).collect()] == ["green", "green", "orange", "red"]


def test_standardize_and_pca(blobs):
    x = np.array([r["features"] for r in blobs.orderBy("row_id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    got = np.array([r["features"] for r in pc.standardize(blobs).orderBy("row_id").collect()])
    np.testing.assert_allclose(got, z)
    fit = pc.fit_pca(blobs, k=3)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:3]
    assert fit.explained() == [round(v * 100, 2) for v in values[order] / values.sum()]
    scores = np.array([r[:] for r in pc.apply_pca(fit, blobs).orderBy("row_id").select("pc1", "pc2", "pc3").collect()])
    for i, o in enumerate(order):
        v = vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o])
        np.testing.assert_allclose(scores[:, i], z @ v, atol=1e-8)
    assert np.abs(np.corrcoef(scores.T) - np.eye(3)).max() < 1e-8


@pytest.mark.parametrize("block, features", [(4, 7), (12, 1024), (64, 5)])
def test_pca_by_krylov_blocks(spark, monkeypatch, block, features):
    """A flat spectrum, from start blocks far smaller than the number of features."""
    monkeypatch.setattr(pc, "_BLOCK", block)
    monkeypatch.setattr(pc, "_FEATURES", features)
    x = np.random.default_rng(3).normal(size=(200, 30))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(4)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z)
    fit = pc.fit_pca(df, k=3)
    np.testing.assert_allclose(fit.shares, values[::-1][:3] / values.sum(), rtol=1e-9)
    np.testing.assert_allclose(np.abs(np.sum(fit.components() * vectors[:, ::-1][:, :3], axis=0)), 1, atol=1e-7)


def test_pca_of_many_features(spark):
    """20,000 features: a matrix of features by features would take 3.2 GB."""
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(120, 4)) * [5, 3, 2, 1]
    x = hidden @ rng.normal(size=(4, 20_000)) + 0.5 * rng.normal(size=(120, 20_000))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3)
    z = (x - x.mean(0)) / x.std(0)
    fit = pc.fit_pca(df, k=2)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(fit.shares, s[:2] ** 2 / (s**2).sum(), rtol=1e-8)
    np.testing.assert_allclose(np.abs(np.sum(fit.components() * v[:2].T, axis=0)), 1, atol=1e-8)
    with pytest.raises(ValueError):
        pc.fit_pca(df, k=0)


def test_pca_on_other_labels(blobs):
    fit = pc.fit_pca(blobs, ["low", "mid"], 2)
    own = pc.apply_pca(fit, blobs, ["high"])
    kept = pc.apply_pca(fit, blobs, ["high"], reuse_scaler=True)
    assert own.count() == kept.count() == 80
    assert abs(own.agg(F.avg("pc1")).first()[0]) < 1e-9 and abs(kept.agg(F.avg("pc1")).first()[0]) > 1


def test_constant_feature(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "features array<double>")
    assert sorted(list(r[0]) for r in pc.standardize(df).collect()) == [[0.0, -1.0], [0.0, 1.0]]


def test_ellipse(blobs):
    pairs = blobs.select("label", F.col("features")[0].alias("pc1"), F.col("features")[1].alias("pc2"))
    rows = pairs.collect()
    for r in pc.ellipse(pairs, n_std=2).collect():
        xy = np.array([(x[1], x[2]) for x in rows if x[0] == r["label"]])
        cov = np.cov(xy.T)
        rho = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
        assert r["pearson"] == pytest.approx(rho) and r["scale_x"] == pytest.approx(2 * np.sqrt(cov[0, 0]))
        assert r["radius_x"] == pytest.approx(np.sqrt(1 + rho)) and r["radius_y"] == pytest.approx(np.sqrt(1 - rho))


def test_param_grid():
    grid = ml.param_grid({"n_estimators": "100, 200", "max_depth": "None, 5", "criterion": ["gini"]}, {"bootstrap": "True", "max_depth": 9})
    assert len(grid) == 4
    assert {(g["n_estimators"], g["max_depth"]) for g in grid} == {(100, None), (100, 5), (200, None), (200, 5)}
    assert all(g["bootstrap"] is True and g["criterion"] == "gini" for g in grid)


def test_forest(spark, blobs, tmp_path):
    train, test = ds.split(blobs, 0.7, 1)
    model = ml.train_rf(train, {"n_estimators": 15, "criterion": "log_loss", "class_weight": "balanced", "max_depth": None, "min_samples_split": 4}, 3)
    out = ml.predict(model, test)
    assert ev.accuracy(out).first()[0] > 0.9
    row = out.first()
    assert sum(row["probabilities"]) == pytest.approx(1) and row["confidence"] == max(row["probabilities"])
    importance = ml.feature_importance(spark, model)
    assert importance.count() == 5 and importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    ml.save_model(spark, model, str(tmp_path / "m"))
    again = ml.predict(ml.load_model(spark, str(tmp_path / "m")), test.drop("label"))
    assert {r["row_id"]: r["predicted"] for r in again.collect()} == {r["row_id"]: r["predicted"] for r in out.collect()}
    with pytest.raises(ValueError):
        ml.train_rf(train, {"nonsense": 1})


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly", "sigmoid"])
def test_svc(spark, blobs, kernel, tmp_path):
    # an exact sigmoid machine cannot part features that are all positive
    train, test = ds.split(pc.standardize(blobs) if kernel == "sigmoid" else blobs, 0.7, 1)
    model = ml.train_svc(train, {"kernel": kernel, "C": 1.0, "max_iter": 20}, 3)
    out = ml.predict(model, test)
    assert ev.accuracy(out).first()[0] > 0.85
    assert sum(out.first()["probabilities"]) == pytest.approx(1)
    if kernel == "rbf":
        ml.save_model(spark, model, str(tmp_path / "m"))
        again = ml.predict(ml.load_model(spark, str(tmp_path / "m")), test)
        assert {r["row_id"]: r["predicted"] for r in again.collect()} == {r["row_id"]: r["predicted"] for r in out.collect()}


def test_learn(spark, blobs):
    train, test = ds.split(blobs, 0.7, 1)
    cfg = LearnConfig(grid={"n_estimators": "3, 6"}, fixed={"max_depth": 4}, folds=3, labels=["low", "high"])
    got = learn(train, test, cfg)
    runs = got.runs.orderBy("run_id").collect()
    assert [r["params"]["n_estimators"] for r in runs] == ["3", "6"] and all(len(r["cv_scores"]) == 3 for r in runs)
    assert all(r["test_acc"] > 0.9 and r["f1"] > 0.9 for r in runs)
    assert got.model.labels == ["high", "low"] and got.best.count() == 1
    assert kfold_scores(blobs, 2, lambda rows: ml.train_rf(rows, {"n_estimators": 3}))[0] > 0.8
    with pytest.raises(ValueError):
        LearnConfig(folds=None).validate()


def test_learning_goes_on_where_it_stopped(spark, blobs, tmp_path, monkeypatch):
    from sigspark.plans import learn as plan

    train, test = ds.split(blobs, 0.7, 1)
    cfg = LearnConfig(grid={"n_estimators": "2, 3, 4"}, fixed={"max_depth": 3}, folds=None, score="test", parallelism=1)
    fitted = []

    def fit(rows, params, seed, fail=()):
        fitted.append(params["n_estimators"])
        if params["n_estimators"] in fail:
            raise RuntimeError("lost")
        return ml.train_rf(rows, params, seed)

    monkeypatch.setitem(plan.TRAINERS, "rf", lambda rows, params, seed: fit(rows, params, seed, {4}))
    with pytest.raises(RuntimeError):
        learn(train, test, cfg, folder=str(tmp_path / "search"))
    monkeypatch.setitem(plan.TRAINERS, "rf", fit)
    got = learn(train, test, cfg, folder=str(tmp_path / "search"))
    assert fitted == [2, 3, 4, 4] and sorted(r["run_id"] for r in got.runs.collect()) == [0, 1, 2]
    assert got.model.pipeline.stages[0].getNumTrees == int(got.best.first()["params"]["n_estimators"])
    with pytest.raises(ValueError, match="another grid"):
        learn(train, test, LearnConfig(grid={"n_estimators": "9"}, folds=None, score="test"), folder=str(tmp_path / "search"))


def test_best_runs_in_one_pass(spark, runs):
    for score in ("trust", "relative_cv", "cv", "train", "test"):
        one = rn.best_run(runs, score).first()["run_id"]
        every = {r["score"]: r["run_id"] for r in rn.best_runs(runs, ["trust", "relative_cv", "cv", "train", "test"]).collect()}
        assert every[score] == one
    assert rn.best_runs(runs.limit(0), ["trust"]).count() == 0
