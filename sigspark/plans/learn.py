"""Model selection: train every parameter combination, score it, choose the best."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.learning.models import TRAINERS, Model, load_model, param_grid, predict, save_model
from sigspark.operators import evaluate as ev
from sigspark.operators.dataset import assign_folds, filter_labels, merge
from sigspark.operators.runs import best_run, report
from sigspark.operators.scale import freeze, shared_dir
from sigspark.plans.config import LearnConfig

RUN_SCHEMA = (
    "run_id long, params map<string,string>, cv_scores array<double>, train_acc double, test_acc double, "
    "f1 double, recall double, precision double"
)


@dataclass
class Learned:
    """The runs and what was chosen; models stay in storage until ``model`` loads the best one."""

    runs: DataFrame
    best: DataFrame
    report: DataFrame
    folder: str

    @property
    def model(self) -> Model:
        return load_model(self.runs.sparkSession, f"{self.folder}/model={self.best.first()['run_id']}")


def kfold_scores(dataset: DataFrame, k: int, train, seed: int = 0, row_id: str = "row_id") -> list[float]:
    """Accuracy of a model trained on all other folds, for every fold. ``dataset`` may already carry ``fold``."""
    folded = dataset if "fold" in dataset.columns else freeze(assign_folds(dataset, k, seed, row_id))
    scores = []
    for i in range(k):
        model = train(folded.where(F.col("fold") != i))
        scores.append(ev.accuracy(predict(model, folded.where(F.col("fold") == i))).first()["accuracy"])
    return scores


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger of runs that a folder holds, if any."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/runs").drop("run")


def learn(train: DataFrame, test: DataFrame, cfg: LearnConfig, row_id: str = "row_id", folder: str | None = None) -> Learned:
    """Grid search. Each fit is a distributed job; ``parallelism`` of them run side by side.

    k-fold scores are taken on train and test rows together, with the model refitted per fold. Each run writes its model
    and then a line of the ledger to ``folder`` (a new one in the shared folder by default); a search that is started
    again with the same folder, data and settings goes on with the runs that have no line yet. The driver holds a model
    only while its run lasts.
    """
    cfg.validate()
    columns = [row_id, "features", "label"]
    train, test = train.select(*columns), test.select(*columns)
    if cfg.labels is not None:
        train, test = filter_labels(train, cfg.labels), filter_labels(test, cfg.labels)
    spark = train.sparkSession
    folder = folder or f"{shared_dir(spark)}/sigspark/{uuid.uuid4().hex}"
    fit = TRAINERS[cfg.kind]
    combos = param_grid(cfg.grid, cfg.fixed)
    ledger = finished(spark, folder)
    named = [{k: str(v) for k, v in combo.items()} for combo in combos]
    done = {} if ledger is None else {r["run_id"]: r["params"] for r in ledger.select("run_id", "params").collect()}
    if any(named[i] != params for i, params in done.items() if i < len(named)) or any(i >= len(named) for i in done):
        raise ValueError(f"{folder} holds the runs of another grid")
    folded = freeze(assign_folds(merge(train, test), cfg.folds, cfg.seed, row_id)) if cfg.folds else None
    train, test = freeze(train), freeze(test)

    def run(i: int) -> None:
        params = combos[i]
        model = fit(train, params, cfg.seed)
        predicted = predict(model, test)
        macro = ev.macro_metrics(predicted).first() if cfg.kind == "rf" else {}
        scores = kfold_scores(folded, cfg.folds, lambda rows: fit(rows, params, cfg.seed)) if cfg.folds else None
        row = (
            i, named[i], scores,
            ev.accuracy(predict(model, train)).first()["accuracy"],
            ev.accuracy(predicted).first()["accuracy"],
            *(macro[m] if macro else None for m in ("f1", "recall", "precision")),
        )
        save_model(spark, model, f"{folder}/model={i}")
        spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={i}")

    with ThreadPoolExecutor(max_workers=cfg.parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), [i for i in range(len(combos)) if i not in done]))
    runs = finished(spark, folder)
    absolute = cfg.kind == "svc"
    return Learned(runs, best_run(runs, cfg.score, absolute), report(runs, cfg.score, absolute), folder)
