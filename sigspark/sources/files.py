"""Finding, choosing and labelling recording files by path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.columns import contains_all, contains_any, label_from_text


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files under ``root``, recursively. Only the listing is read, not the contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def select_paths(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), on: str = "path") -> DataFrame:
    """Keep paths that contain every ``include`` text and no ``exclude`` text (case-sensitive)."""
    return df.where(contains_all(F.col(on), include) & ~contains_any(F.col(on), exclude))


def assign_target(
    df: DataFrame, mapping: Mapping[str, str], on: str = "path", match: str = "first", untargeted: str = "keep"
) -> DataFrame:
    """Add ``target``: the value of the first (or last) key contained in the path.

    Rows without a target are kept with null, dropped, or stop the job (``error``).
    """
    target = label_from_text(F.col(on), mapping, match)
    if untargeted == "error":
        target = F.coalesce(target, F.raise_error(F.concat(F.lit("no target for "), F.col(on))).cast("string"))
    elif untargeted not in ("keep", "drop"):
        raise ValueError("untargeted must be 'keep', 'drop' or 'error'")
    out = df.withColumn("target", target)
    return out.where(F.col("target").isNotNull()) if untargeted == "drop" else out


def count_by_target(paths: DataFrame, mapping: Mapping[str, str], on: str = "path") -> DataFrame:
    """How many selected files have a target and how many do not."""
    labelled = assign_target(paths, mapping, on)
    return labelled.groupBy(F.col("target").isNotNull().alias("targeted")).agg(F.count(F.lit(1)).alias("files"))


def sibling_path(path: str) -> str | None:
    """The test file that belongs to a train file, or the reverse; None when the name follows neither form."""
    for here, there in (("_Xy_train.", "_Xy_test."), ("_Xy_test.", "_Xy_train.")):
        if here in path:
            return path.replace(here, there)
    return None
