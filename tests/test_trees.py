import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.learning import models as ml
from sigspark.learning import trees
from sigspark.operators import evaluate as ev

#: What the estimators of the program report as their default settings.
FOREST = {"bootstrap": True, "ccp_alpha": 0.0, "class_weight": "balanced", "criterion": "gini", "max_depth": None,
          "max_features": "sqrt", "max_leaf_nodes": None, "max_samples": None, "min_impurity_decrease": 0.0, "min_samples_leaf": 1,
          "min_samples_split": 2, "min_weight_fraction_leaf": 0.0, "monotonic_cst": None, "n_estimators": 20, "n_jobs": None,
          "oob_score": False, "random_state": None, "verbose": 0, "warm_start": False}
MACHINE = {"C": 1.0, "break_ties": False, "cache_size": 200, "class_weight": None, "coef0": 0.0, "decision_function_shape": "ovr",
           "degree": 3, "gamma": "scale", "kernel": "rbf", "max_iter": -1, "probability": True, "random_state": None,
           "shrinking": True, "tol": 0.001, "verbose": False}


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        label = int(rng.integers(3))
        rows.append((i, [float(v) for v in rng.normal(label * 1.2, 1.5, 4)], f"l{label}"))
    return spark.createDataFrame(rows, "row_id long, features array<double>, label string").cache()


def random_tree(rng, n_leaves):
    """Children, impurity, weight and rows of a tree; a split never raises the weighted impurity."""
    left, right, stats = [-1], [-1], [rng.integers(1, 30, 3).astype(float)]
    for _ in range(n_leaves - 1):
        i = int(rng.choice([k for k in range(len(left)) if left[k] < 0 and stats[k].sum() > 1]))
        part = rng.binomial(stats[i].astype(int), rng.random(3)).astype(float)
        if part.sum() in (0, stats[i].sum()):
            continue
        left[i], right[i] = len(left), len(left) + 1
        stats += [part, stats[i] - part]
        left += [-1, -1]
        right += [-1, -1]
    stats = np.array(stats)
    weight = stats.sum(axis=1)
    return np.array(left), np.array(right), 1 - (stats**2).sum(axis=1) / weight**2, weight, weight.astype(int)


def cuts(left, right, i=0):
    """Every set of splits that leaves a tree with the same root."""
    yield frozenset()
    if left[i] >= 0:
        for a, b in itertools.product(list(cuts(left, right, left[i])), list(cuts(left, right, right[i]))):
            yield frozenset({int(i)}) | a | b


@pytest.mark.parametrize("seed", range(12))
def test_pruning_equals_the_best_of_all_cuts(seed):
    rng = np.random.default_rng(seed)
    left, right, impurity, weight, rows = random_tree(rng, 7)
    risk = impurity * weight / weight[0]

    def cost(splits, alpha):
        leaves = {0} if not splits else {c for i in splits for c in (int(left[i]), int(right[i]))} - set(splits)
        return sum(risk[i] for i in leaves) + alpha * len(leaves)

    every = set(cuts(left, right))
    for alpha in (0.001, 0.01, 0.03, 0.08, 0.3):
        got = frozenset(np.flatnonzero(trees.kept_splits(left, right, impurity, weight, rows, alpha)).tolist())
        best = min(cost(s, alpha) for s in every)
        # of equally good cuts the smallest
        want = min((s for s in every if cost(s, alpha) <= best + 1e-12), key=len)
        assert cost(got, alpha) == pytest.approx(best) and len(got) == len(want)


@pytest.mark.parametrize("seed", range(5))
def test_best_first_takes_the_largest_gain_each_time(seed):
    rng = np.random.default_rng(100 + seed)
    left, right, impurity, weight, rows = random_tree(rng, 12)
    gain = [weight[i] * impurity[i] - weight[left[i]] * impurity[left[i]] - weight[right[i]] * impurity[right[i]] if left[i] >= 0 else None
            for i in range(len(left))]
    chosen, open_ = set(), [0]
    for most in range(1, 9):
        got = set(np.flatnonzero(trees.kept_splits(left, right, impurity, weight, rows, max_leaves=most)).tolist())
        assert got == chosen
        can = [i for i in open_ if gain[i] is not None]
        if not can:
            break
        i = max(can, key=lambda i: gain[i])
        chosen.add(i)
        open_.remove(i)
        open_ += [int(left[i]), int(right[i])]


def leaves_of(model):
    return [t.numNodes // 2 + 1 for t in model.pipeline.stages[0].trees]


def test_default_settings_train(noisy):
    forest = ml.train_rf(noisy, FOREST, 1)
    assert ev.accuracy(ml.predict(forest, noisy)).first()[0] > 0.9
    machine = ml.train_svc(noisy, MACHINE, 1)
    assert ev.accuracy(ml.predict(machine, noisy)).first()[0] > 0.5


def test_cut_forests(spark, noisy, tmp_path):
    whole = ml.train_rf(noisy, FOREST, 1)
    few = ml.train_rf(noisy, FOREST | {"max_leaf_nodes": 6}, 1)
    pruned = ml.train_rf(noisy, FOREST | {"ccp_alpha": 0.02}, 1)
    stump = ml.train_rf(noisy, FOREST | {"ccp_alpha": 5.0}, 1)
    coarse = ml.train_rf(noisy, FOREST | {"min_samples_split": 80}, 1)
    assert max(leaves_of(few)) <= 6 < max(leaves_of(whole)) and set(leaves_of(stump)) == {1}
    assert all(a <= b for a, b in zip(leaves_of(pruned), leaves_of(whole))) and sum(leaves_of(pruned)) < sum(leaves_of(whole))
    assert sum(leaves_of(coarse)) < sum(leaves_of(whole))
    assert ev.accuracy(ml.predict(few, noisy)).first()[0] > 0.6
    ml.save_model(spark, few, str(tmp_path / "m"))
    again = ml.predict(ml.load_model(spark, str(tmp_path / "m")), noisy)
    assert {r["row_id"]: r["predicted"] for r in again.collect()} == {r["row_id"]: r["predicted"] for r in ml.predict(few, noisy).collect()}
    assert ml.feature_importance(spark, few).agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_limits_are_arguments(noisy):
    with pytest.raises(ValueError, match="more than 2 labels"):
        ml.train_rf(noisy, most_labels=2)
    with pytest.raises(ValueError, match="monotonic"):
        ml.train_rf(noisy, {"monotonic_cst": [1, 0, 0, 0]})
