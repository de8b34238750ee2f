"""Cut series into bounded blocks that carry a margin of their neighbours' samples.

Operators that need a sample's surroundings (zero-phase filters, peak windows) run per block instead of per series, so
a channel of any length is spread over many tasks. One shuffle builds the blocks; a sample travels at most three times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SAMPLES = 1 << 18


def collect_in_order(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with ``n``, ``start`` (lowest idx) and each numeric column as an array ``<name>s`` by idx.

    Columns are collected as separate flat lists, several times cheaper than a list of structs; they stay aligned
    because no list skips a row: a null is collected as NaN.
    """
    lists = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in columns]
    flat = df.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list("idx").alias("idx"), *lists)
    zipped = flat.select(*keys, "n", F.sort_array(F.arrays_zip("idx", *columns)).alias("_s"))
    return zipped.select(*keys, "n", F.col("_s")[0]["idx"].alias("start"), *[F.col(f"_s.{c}").alias(f"{c}s") for c in columns])


def to_blocks(
    signal: DataFrame,
    keys: Sequence[str],
    length: int,
    left: int = 0,
    right: int = 0,
    carry: Sequence[str] = (),
    longest: int | None = None,
) -> DataFrame:
    """One row per (series, block): ``start`` (index of the first sample held), ``n``, ``values`` in order.

    Block b owns samples [b*length, (b+1)*length) and also holds up to ``left`` samples before and ``right`` after.
    ``carry`` names further per-sample columns to collect beside ``values``, each into an array ``<name>s``. Only the
    few samples near a block's ends are copied to its neighbours; none if the ``longest`` series is one block.
    """
    if max(left, right) > length:
        raise ValueError("a margin cannot exceed the block length")
    rows = signal.select(*keys, "idx", "n", "value", *carry)
    own, place = F.expr(f"idx div {length}"), F.expr(f"idx % {length}")
    held = rows.withColumn("block", own)
    if (left or right) and (longest is None or longest > length):
        into_next = (place >= length - left) & ((own + 1) * length < F.col("n"))
        into_last = (place < right) & (own > 0)
        targets = F.array(F.when(into_next, own + 1), F.when(into_last, own - 1))
        copies = rows.where(into_next | into_last).withColumn("block", F.explode(targets))
        held = held.unionByName(copies.where(F.col("block").isNotNull()))
    return collect_in_order(held, [*keys, "block"], ["value", *carry])
