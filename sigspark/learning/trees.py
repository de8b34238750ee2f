"""Forests as rows of nodes: weakest-link pruning, best-first growth to a number of leaves, rows needed for a split.

A fully grown tree holds every smaller tree that the same splits allow, so growing best-first is keeping, from the root
on, the splits that gain most. One task cuts one tree; the driver holds no nodes.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.scale import shared_dir


def node_rows(data: DataFrame) -> DataFrame:
    """``tree, id, left, right, impurity, stats, rows`` from a saved forest's nodes; children are -1 at leaves."""
    n = "nodeData"
    return data.select(F.col("treeID").alias("tree"), f"{n}.id", F.col(f"{n}.leftChild").alias("left"),
                       F.col(f"{n}.rightChild").alias("right"), f"{n}.impurity", F.col(f"{n}.impurityStats").alias("stats"),
                       F.col(f"{n}.rawCount").alias("rows"))


def forest_nodes(model: RandomForestClassificationModel) -> DataFrame:
    """The nodes of a fitted forest, one row each."""
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/sigspark/{uuid.uuid4().hex}"
    model.write().save(path)
    return node_rows(spark.read.parquet(f"{path}/data"))


def kept_splits(left, right, impurity, weight, rows, ccp_alpha: float = 0.0, max_leaves: int | None = None,
                min_rows: int = 2) -> np.ndarray:
    """Which nodes of one tree still split. Arrays by node id, root 0, children -1 at leaves."""
    splits = (left >= 0) & (rows >= min_rows)
    if max_leaves is not None:
        splits = _best_first(left, right, impurity, weight, splits, max_leaves)
    return _pruned(left, right, impurity * weight / weight[0], splits, ccp_alpha) if ccp_alpha > 0 else splits


def _best_first(left, right, impurity, weight, splits, most: int) -> np.ndarray:
    """The splits that gain most, each once its parent is split; ties to the node reached first."""
    out, reached, leaves = np.zeros(len(left), bool), 0, 1
    open_: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        nonlocal reached
        if splits[i]:
            a, b = left[i], right[i]
            heapq.heappush(open_, (-(weight[i] * impurity[i] - weight[a] * impurity[a] - weight[b] * impurity[b]), reached, i))
        reached += 1

    offer(0)
    while open_ and leaves < most:
        _, _, i = heapq.heappop(open_)
        out[i] = True
        leaves += 1
        offer(left[i])
        offer(right[i])
    return out


def _pruned(left, right, risk, splits, alpha: float) -> np.ndarray:
    """Collapse the weakest split while the risk it saves for each leaf beyond one is at most ``alpha``."""
    n = len(left)
    splits, parent, order, stack = splits.copy(), np.full(n, -1), [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if splits[i]:
            for child in (left[i], right[i]):
                parent[child] = i
                stack.append(child)
    leaves, below, turn = np.ones(n, np.int64), risk.astype(float).copy(), np.zeros(n, np.int64)

    def gather(i: int) -> None:
        leaves[i], below[i] = leaves[left[i]] + leaves[right[i]], below[left[i]] + below[right[i]]

    def strength(i: int) -> float:
        return (risk[i] - below[i]) / (leaves[i] - 1)

    inner = [i for i in reversed(order) if splits[i]]
    for i in inner:
        gather(i)
    heap = [(strength(i), i, 0) for i in inner]
    heapq.heapify(heap)
    while heap:
        weakest, i, at = heapq.heappop(heap)
        if at != turn[i] or not splits[i]:
            continue
        if weakest > alpha:
            break
        stack = [i]
        while stack:  # its whole subtree goes
            j = stack.pop()
            if splits[j]:
                splits[j] = False
                stack += [left[j], right[j]]
        leaves[i], below[i] = 1, risk[i]
        while (i := parent[i]) >= 0:
            gather(i)
            turn[i] += 1
            heapq.heappush(heap, (strength(i), i, turn[i]))
    return splits


def cut_forest(model: RandomForestClassificationModel, ccp_alpha: float = 0.0, max_leaves: int | None = None,
               min_rows: int = 2) -> RandomForestClassificationModel:
    """The same forest with each tree cut back: to ``max_leaves`` best-first, by ``ccp_alpha``, and no split of a node
    with fewer than ``min_rows`` training rows."""
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/sigspark/{uuid.uuid4().hex}"
    model.write().save(f"{path}/whole")
    data = spark.read.parquet(f"{path}/whole/data")

    def cut(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        left, right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
        weight = np.array([float(np.sum(s)) for s in nodes["stats"]])
        splits = kept_splits(left, right, nodes["impurity"].to_numpy(), weight, nodes["rows"].to_numpy(), ccp_alpha, max_leaves, min_rows)
        ids, stack = [], [0]
        while stack:  # parents before children, left before right
            i = stack.pop()
            ids.append(i)
            if splits[i]:
                stack += [right[i], left[i]]
        new = {i: place for place, i in enumerate(ids)}
        return pd.DataFrame({
            "treeID": nodes["tree"].iloc[0], "old": np.array(ids, np.int32), "new": np.arange(len(ids), dtype=np.int32),
            "left": np.array([new[left[i]] if splits[i] else -1 for i in ids], np.int32),
            "right": np.array([new[right[i]] if splits[i] else -1 for i in ids], np.int32)})

    kept = node_rows(data).groupBy("tree").applyInPandas(cut, "treeID int, old int, new int, left int, right int")
    leaf = F.col("left") < 0
    n = "nodeData"
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                    F.lit(-1).alias("numCategories"))
    rows = data.withColumn("old", F.col(f"{n}.id")).join(kept, ["treeID", "old"])
    rows.select("treeID", F.struct(
        F.col("new").alias("id"), f"{n}.prediction", f"{n}.impurity", f"{n}.impurityStats", f"{n}.rawCount",
        F.when(leaf, -1.0).otherwise(F.col(f"{n}.gain")).alias("gain"), F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), F.when(leaf, none).otherwise(F.col(f"{n}.split")).alias("split"),
    ).alias(n)).write.parquet(f"{path}/cut/data")
    spark.read.text(f"{path}/whole/metadata").coalesce(1).write.text(f"{path}/cut/metadata")
    spark.read.parquet(f"{path}/whole/treesMetadata").coalesce(1).write.parquet(f"{path}/cut/treesMetadata")
    return RandomForestClassificationModel.load(f"{path}/cut")
