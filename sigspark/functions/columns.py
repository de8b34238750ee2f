"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_all(column: Column, parts: Sequence[str]) -> Column:
    """Case-sensitive: every part occurs in the text. No parts: true."""
    return reduce(lambda acc, p: acc & F.contains(column, F.lit(p)), parts, F.lit(True))


def contains_any(column: Column, parts: Sequence[str]) -> Column:
    """Case-sensitive: at least one part occurs in the text. No parts: false."""
    return reduce(lambda acc, p: acc | F.contains(column, F.lit(p)), parts, F.lit(False))


def label_from_text(column: Column, mapping: Mapping[str, str], match: str = "first") -> Column:
    """Value of the first (or last) key found in the text, null if none; an empty value stands for its key."""
    if match not in ("first", "last"):
        raise ValueError("match must be 'first' or 'last'")
    pairs = [(key, value or key) for key, value in mapping.items()]
    if match == "last":
        pairs.reverse()
    if not pairs:
        return F.lit(None).cast("string")
    if len(pairs) <= 100:
        return F.coalesce(*[F.when(F.contains(column, F.lit(k)), F.lit(v)) for k, v in pairs])
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs])
    hits = F.filter(rules, lambda r: F.contains(column, r["key"]))
    return F.when(F.size(hits) > 0, hits[0]["value"])


def hann_weight(idx: Column, n: Column) -> Column:
    """Symmetric Hann weight of sample ``idx`` in a window of ``n``; a single sample keeps weight 1."""
    return F.when(n > 1, 0.5 - 0.5 * F.cos(2 * F.pi() * idx / (n - 1))).otherwise(F.lit(1.0))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def array_std(values: Column) -> Column:
    """Population standard deviation of an array."""
    mean = array_mean(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / F.size(values))


def trust_score(train: Column, test: Column, folds: Column) -> Column:
    """Test accuracy less penalties for gaps between train, test and fold scores, scaled to 0..1."""
    # Fixed weights of the score.
    gap_weight, spread_weight, fold_weight = 0.5, 0.2, 0.3
    lowest, highest = -0.9, 1.0
    mean = array_mean(folds)
    raw = (
        test
        - gap_weight * F.abs(train - test)
        - spread_weight * array_std(folds)
        - fold_weight * (F.abs(test - mean) + F.abs(train - mean)) / 2
    )
    return (raw - lowest) / (highest - lowest)


def kfold_gap(train: Column, folds: Column, absolute: bool = False) -> Column:
    """Train accuracy minus mean fold accuracy, as a percentage of the train accuracy."""
    gap = F.bround(train - array_mean(folds), 3)
    return F.bround((F.abs(gap) if absolute else gap) / train * 100, 2)


def band(value: Column, limits: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the first band whose upper limit exceeds the value; the last name has no limit."""
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names))):
        out = F.when(value < limit, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def score_band(value: Column, kind: str = "train_test") -> Column:
    """Traffic-light colour of an accuracy (``train_test``) or of a k-fold gap in percent (``kfold``)."""
    if kind == "train_test":
        return band(value, [0.65, 0.79, 0.9], ["red", "orange", "yellow", "green"])
    if kind == "kfold":
        return band(value, [3, 5, 10], ["green", "yellow", "orange", "red"])
    raise ValueError("kind must be 'train_test' or 'kfold'")


def overfit_band(gap: Column) -> Column:
    """Overfitting risk for a k-fold gap in percent."""
    value = F.abs(gap)
    return (
        F.when(value <= 2, "minor").when(value <= 5, "moderate").when(value <= 10, "significant")
        .when(value.isNotNull(), "very high")
    )
