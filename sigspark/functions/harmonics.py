"""Harmonics of a base frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIRST_AND_STEP = {"All": (1, 1), "Even": (2, 2), "Odd": (1, 2)}


def harmonics(freq: float, nth: int, mode: str = "All") -> list[float]:
    """Multiples 1..nth of ``freq``: all, the even ones or the odd ones."""
    first, step = _FIRST_AND_STEP[mode]
    return [freq * k for k in range(first, nth + 1, step)]


def harmonic_rows(df: DataFrame, freq: str | Column, nth: int, mode: str = "All") -> DataFrame:
    """One row per input row and harmonic, with columns ``order`` and ``harmonic``."""
    first, step = _FIRST_AND_STEP[mode]
    if nth < first:
        orders = F.array().cast("array<long>")
    else:
        orders = F.sequence(F.lit(first).cast("long"), F.lit(nth).cast("long"), F.lit(step).cast("long"))
    base = F.col(freq) if isinstance(freq, str) else freq
    return df.withColumn("order", F.explode(orders)).withColumn("harmonic", base * F.col("order"))
