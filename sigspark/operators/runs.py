"""Scoring and choosing training runs.

A run has ``run_id`` (number, in training order), ``params``, ``cv_scores`` (array), ``train_acc``, ``test_acc`` and
optionally ``f1``, ``recall``, ``precision``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions import columns as fn


def with_scores(runs: DataFrame, absolute_gap: bool = False) -> DataFrame:
    """Add mean fold accuracy, k-fold gap (percent), trust score and the overfitting risk."""
    folds = F.col("cv_scores")
    out = runs.withColumn("cv_mean", fn.array_mean(folds)).withColumn("cv_std", fn.array_std(folds))
    out = out.withColumn("gap", fn.kfold_gap(F.col("train_acc"), folds, absolute_gap))
    out = out.withColumn("trust", fn.trust_score(F.col("train_acc"), F.col("test_acc"), folds))
    return out.withColumn("risk", fn.overfit_band(F.col("gap")))


def _rank(score: str) -> Column:
    """Larger is better."""
    return {
        "trust": F.col("trust"),
        "relative_cv": -F.col("gap"),
        "cv": F.col("cv_mean"),
        "train": F.col("train_acc"),
        "test": F.col("test_acc"),
    }[score]


def best_runs(runs: DataFrame, scores: Sequence[str], absolute_gap: bool = False) -> DataFrame:
    """The best run by each of the scores, in one pass: the run's columns with ``score`` in front."""
    scored = with_scores(runs, absolute_gap)

    def best(score: str) -> Column:
        order = F.struct(F.coalesce(_rank(score), F.lit(float("-inf"))), -F.col("run_id"))
        return F.max_by(F.struct(*scored.columns), order)

    rows = scored.agg(F.array(*[F.struct(F.lit(s).alias("score"), best(s).alias("run")) for s in scores]).alias("best"))
    return rows.select(F.inline("best")).where(F.col("run").isNotNull()).select("score", "run.*")


def best_run(runs: DataFrame, score: str = "trust", absolute_gap: bool = False) -> DataFrame:
    """The single best run; the earlier one wins a tie. A run without the score loses to any with it."""
    return best_runs(runs, [score], absolute_gap).drop("score")


def runs_summary(runs: DataFrame) -> DataFrame:
    """Mean and population deviation over all runs of train, test and k-fold accuracy, 3 decimals."""
    values = runs.select(
        F.inline(F.concat(
            F.array(
                F.struct(F.lit("train").alias("metric"), F.col("train_acc").alias("value")),
                F.struct(F.lit("test").alias("metric"), F.col("test_acc").alias("value")),
            ),
            F.coalesce(
                F.transform("cv_scores", lambda v: F.struct(F.lit("kfold").alias("metric"), v.alias("value"))),
                F.array().cast("array<struct<metric:string,value:double>>"),
            ),
        ))
    )
    return values.groupBy("metric").agg(
        F.bround(F.avg("value"), 3).alias("mean"), F.bround(F.stddev_pop("value"), 3).alias("std")
    )


def report(runs: DataFrame, score: str = "trust", absolute_gap: bool = False) -> DataFrame:
    """Report rows: metrics and parameters of the best run, then averages over all runs, with colour bands."""

    def row(section: str, name: str, value, std=None, kind: str | None = "train_test") -> Column:
        number = F.lit(value).cast("double") if not isinstance(value, Column) else value.cast("double")
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("name"),
            number.alias("value"),
            (F.lit(None) if std is None else std).cast("double").alias("std"),
            F.lit(None).cast("string").alias("text"),
            (fn.score_band(number, kind) if kind else F.lit(None).cast("string")).alias("band"),
        )

    best = best_run(runs, score, absolute_gap)
    extra = [m for m in ("f1", "recall", "precision") if m in runs.columns]
    metrics = [row("best", m, F.col(m)) for m in ("train_acc", "test_acc", *extra)]
    metrics.append(row("best", "kfold", F.bround("cv_mean", 3), F.bround("cv_std", 3)))
    metrics.append(row("best", "kfold_difference", F.bround(F.col("train_acc") - F.bround("cv_mean", 3), 3), kind=None))
    metrics.append(row("best", "kfold_gap", F.col("gap"), kind="kfold"))
    metrics.append(row("best", "trust", F.bround("trust", 3)))
    top = best.select(F.inline(F.array(*metrics)))
    params = best.select(F.explode("params").alias("name", "text")).select(
        F.lit("params").alias("section"),
        "name",
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("std"),
        "text",
        F.lit(None).cast("string").alias("band"),
    )
    means = runs_summary(runs).select(F.inline(F.array(row("average", "", F.col("mean"), F.col("std")))), "metric")
    means = means.withColumn("name", F.col("metric")).drop("metric")
    total = runs.agg(F.count(F.lit(1)).alias("c")).select(F.inline(F.array(row("all", "runs", F.col("c"), kind=None))))
    return total.unionByName(top).unionByName(params).unionByName(means).where(
        F.col("value").isNotNull() | F.col("text").isNotNull()
    )
