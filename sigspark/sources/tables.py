"""Reading and writing feature sets, signals, spike tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.spikes import SPIKE_COLUMNS
from sigspark.sources.files import sibling_path
from sigspark.sources.recordings import cells, numbered_lines

# Sample indices of a segment that one file holds, for all its channels.
SAMPLES_PER_FILE = 1 << 20

# Headers of the spike table; ### stands for the unit.
SPIKE_HEADERS = [
    "Key", "File", "Sampling frequency [Hz]", "Number of values", "Target", "Column ID", "Threshold crossing index",
    "Peak value [###]", "Peak index", "Minimum value [###]", "Maximum value [###]", "Slope",
    "Extrema ratio (min/max)", "Extraction first index", "Extraction last index", "Extracted data [###]",
]
NO_SLOPE = "Uncomputable"
_SPIKE_TYPES = [
    "string", "string", "int", "long", "string", "string", "long", "double", "long", "double", "double", "double",
    "double", "long", "long", "array<double>",
]


def find_label_col(columns: Sequence[str]) -> str | None:
    """The last column whose name contains ``target`` or ``label``."""
    return next((c for c in reversed(columns) if "target" in c or "label" in c), None)


def read_dataset(spark: SparkSession, path: str, label_col: str | None = None) -> DataFrame:
    """Feature set from CSV (one column per feature, one label column) or from Parquet written by ``write_dataset``.

    The row ids of a CSV are its file and line: the same in every reading, and apart in different files.
    """
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    lines, ends = numbered_lines(spark, path)
    heads = lines.where("_line = 0").select(F.transform(cells(F.col("line")), lambda c: F.trim(c)).alias("names")).distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError("the files have different columns")
    names = heads[0]["names"] if heads else []
    label = label_col or find_label_col(names)
    if label not in names:
        raise ValueError("no label column found: name it")
    at, found = names.index(label), F.col("cells")
    wrong = F.raise_error(F.format_string("line %s of %s does not have %s values", F.col("_line") + 1, F.col("path"), F.lit(len(names))))
    rows = lines.join(ends, "path").where("_line > 0 AND _line <= _end").withColumn("cells", cells(F.col("line")))
    rows = rows.withColumn("cells", F.when(F.size("cells") == len(names), found).otherwise(wrong))
    number = F.transform(F.concat(F.slice(found, 1, at), F.slice(found, at + 2, len(names))), lambda c: F.when(F.trim(c) != "", F.trim(c)).cast("double"))
    return rows.select(F.format_string("%s:%012d", F.col("path"), F.col("_line")).alias("row_id"), number.alias("features"),
                       F.when(found[at] != "", found[at]).alias("label"))


def read_pair(spark: SparkSession, path: str, label_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The train and the test set, given the path of either; the other one must lie beside it."""
    other = sibling_path(path)
    if other is None:
        raise ValueError(f"{path} is named neither as a train nor as a test set")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(other)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"{other} does not exist")
    train, test = (path, other) if "_Xy_train." in path else (other, path)
    return read_dataset(spark, train, label_col), read_dataset(spark, test, label_col)


def write_dataset(dataset: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet as is; a path ending in .csv gets columns ``0``..``n-1`` and ``label``."""
    if not path.endswith(".csv"):
        dataset.write.mode(mode).parquet(path)
        return
    width = dataset.agg(F.max(F.size("features"))).first()[0] or 0
    columns = [F.get("features", F.lit(i)).alias(str(i)) for i in range(width)]
    dataset.select(*columns, "label").write.mode(mode).csv(path, header=True)


def write_signal(signal: DataFrame, path: str, mode: str = "errorifexists", samples: int = SAMPLES_PER_FILE) -> None:
    """Processed samples, one folder per recording and segment (recording paths are stored escaped).

    A range of ``samples`` indices of a segment is dealt to one task, so a segment has one file for each range.
    """
    keys = [c for c in ("recording_id", "segment_id") if c in signal.columns]
    dealt = signal.withColumn("_range", F.expr(f"idx DIV {samples}")).repartition(*keys, "_range")
    dealt.drop("_range").write.mode(mode).partitionBy(*keys).parquet(path)


def write_split(train: DataFrame, test: DataFrame, path: str, mode: str = "errorifexists") -> tuple[str, str]:
    """Write both parts beside ``path`` with ``_Xy_train`` and ``_Xy_test`` before the extension."""
    base, dot, ext = path.rpartition(".")
    base, tail = (base, f".{ext}") if dot and "/" not in ext else (path, ".parquet")
    paths = (f"{base}_Xy_train{tail}", f"{base}_Xy_test{tail}")
    for df, target in zip((train, test), paths):
        write_dataset(df, target, mode)
    return paths


def write_spikes(spikes: DataFrame, path: str, unit: str = "AU", mode: str = "errorifexists") -> None:
    """Spike table: Parquet as is; a path ending in .csv gets headers with the unit and waveforms as JSON text."""
    if not path.endswith(".csv"):
        spikes.write.mode(mode).parquet(path)
        return
    rows = spikes.withColumn("extracted", F.to_json("extracted")).withColumn(
        "slope", F.coalesce(F.col("slope").cast("string"), F.lit(NO_SLOPE))
    )
    named = [F.col(c).alias(h.replace("###", unit or "AU")) for c, h in zip(SPIKE_COLUMNS, SPIKE_HEADERS)]
    rows.select(*named).write.mode(mode).option("escape", '"').csv(path, header=True)


def _bare(header: str) -> str:
    return header.split("[")[0].strip()


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Spike table from CSV or Parquet; a table with other columns is refused. Units in headers are ignored."""
    if not path.endswith(".csv"):
        spikes = spark.read.parquet(path)
        if set(spikes.columns) != set(SPIKE_COLUMNS):
            raise ValueError("not a spike table")
        return spikes.select(*SPIKE_COLUMNS)
    raw = spark.read.option("escape", '"').csv(path, header=True)
    found = {_bare(c): c for c in raw.columns}
    if len(raw.columns) != len(SPIKE_HEADERS) or set(found) != {_bare(h) for h in SPIKE_HEADERS}:
        raise ValueError("not a spike table")
    columns = []
    for name, header, kind in zip(SPIKE_COLUMNS, SPIKE_HEADERS, _SPIKE_TYPES):
        cell = F.col(f"`{found[_bare(header)]}`")
        if name == "slope":
            cell = F.when(cell != NO_SLOPE, cell)
        value = F.from_json(cell, kind) if kind.startswith("array") else cell.cast(kind)
        columns.append(value.alias(name))
    return raw.select(*columns)


def write_metrics(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report (a few rows) as a single CSV file."""
    report.coalesce(1).write.mode(mode).csv(path, header=True)
