"""Reading recording CSV files: metadata lines, a header line, then one line per sample."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions.columns import contains_all, contains_any
from sigspark.operators.scale import freeze, small_side

_FILE_BLOCK = ["path", "_start"]
#: Name of the file of lines without a recording.
_NAMELESS = "__HIVE_DEFAULT_PARTITION__"


def write_lines(lines: DataFrame, folder: str, order: str) -> None:
    """Write a text file for each value of ``recording``: its ``line`` values, by the column ``order``.

    A task writes the files of its recordings, as streams, to a folder of its own, ``group=<task>/recording=<value>.csv``:
    a folder and a commit for each recording would cost more than its lines. A file appears under its name once it is
    whole; a task that runs again writes the same files again.
    """

    def write(batches):
        disk, base = pafs.FileSystem.from_uri(folder)
        base = f"{base}/group={TaskContext.get().partitionId()}"
        files, now, stream, temporary = 0, None, None, None

        def finish():
            stream.close()
            disk.move(temporary, f"{base}/recording={_NAMELESS if now is None else now}.csv")

        for batch in batches:
            if not len(batch):
                continue
            text = batch.column("line").cast(pa.string())
            at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2])
            names = batch.column("recording").to_pylist()
            begins = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for first, end in zip(begins, [*begins[1:], len(names)]):
                if stream is None or names[first] != now:
                    if stream is not None:
                        finish()
                    else:
                        disk.create_dir(base, recursive=True)
                    # a dot: listings pass over what is not whole
                    now, temporary = names[first], f"{base}/.{uuid.uuid4().hex}"
                    stream = disk.open_output_stream(temporary, compression=None)
                    files += 1
                stream.write(data[at[first] : at[end]])
        if stream is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    dealt = lines.select(F.col("recording").cast("string").alias("recording"), order, F.concat("line", F.lit("\n")).alias("line"))
    dealt = dealt.repartition("recording").sortWithinPartitions("recording", order)
    dealt.select("recording", "line").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def numbered_lines(
    spark: SparkSession, paths: str | Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Lines with their number in the file, and per file the number of its last non-blank line.

    ``paths``: files, or a folder whose files are read at any depth; the rules on paths choose among them before any is
    opened. A file may be read in many splits. Ids grow within a split, so a line's number is its id less the split's
    first id, plus the lines of the splits before it: one summary row per split, and no sort of the data. The lines are
    stored first, so that no later scan can cut the files otherwise.
    """
    text = spark.read.option("recursiveFileLookup", isinstance(paths, str)).text(paths if isinstance(paths, str) else list(paths))
    file = F.col("_metadata.file_path")
    text = freeze(text.where(contains_all(file, include) & ~contains_any(file, exclude)).select(
        file.alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"),
    ))
    solid = F.when(F.col("line") != "", F.col("_id"))
    splits = freeze(text.groupBy(*_FILE_BLOCK).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.max(solid).alias("_solid")
    ))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    ends = placed.groupBy("path").agg(F.max(F.col("_solid") - F.col("_first") + F.col("_before")).alias("_end"))
    starts = small_side(placed.select(*_FILE_BLOCK, "_first", "_before"))
    lines = text.join(starts, _FILE_BLOCK).withColumn("_line", F.col("_id") - F.col("_first") + F.col("_before"))
    return lines.select("path", "_line", "line"), ends


def cells(line: Column) -> Column:
    """The cells of a CSV line. A cell in double quotes may hold commas, and quotes if doubled; it ends on its line."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:\s*"(?:[^"]|"")*"\s*)|[^,]*)'), F.lit(1))
    bare = F.transform(quoted, lambda c: F.when(
        F.trim(c).startswith('"'), F.regexp_replace(F.substring(F.trim(c), F.lit(2), F.length(F.trim(c)) - 2), '""', '"')
    ).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, ","))


def _number(cell: Column) -> Column:
    """Numeric cell; an empty one is null, any other text stops the job."""
    return F.when(F.trim(cell) != "", cell).cast("double")


def read_recordings(
    spark: SparkSession,
    paths: str | Sequence[str],
    skip_rows: int = 0,
    time_like: str = "Time",
    header: Sequence[str] | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Read recordings of any mix of layouts into one long signal: the given files, or those of a folder at any depth
    whose paths hold every ``include`` and no ``exclude`` text.

    The first ``skip_rows`` lines are metadata, the next is the header (or pass ``header`` if all files share one, to
    save a pass). Columns whose name contains ``time_like`` are not channels; the first of them becomes ``t``.
    ``recording_id`` is the file path. Blank lines may only end a file.
    """
    lines, ends = numbered_lines(spark, paths, include, exclude)
    names = F.transform(cells(F.col("line")), lambda c: F.trim(c))
    if header is None:
        heads = lines.where(F.col("_line") == skip_rows).select("path", names.alias("_names"))
    else:
        heads = ends.select("path", F.array(*[F.lit(h) for h in header]).alias("_names"))
    heads = heads.join(ends, "path").select(
        "path",
        "_names",
        (F.col("_end") - skip_rows).alias("n"),
        F.transform("_names", lambda c: F.contains(c, F.lit(time_like)) if time_like else F.lit(False)).alias("_times"),
    )
    data = lines.join(small_side(heads), "path").where(
        (F.col("_line") > skip_rows) & (F.col("_line") <= F.col("n") + skip_rows)
    )
    found = cells(F.col("line"))
    wrong = F.when(F.size(found) < F.size("_names"), F.lit("few")).otherwise(F.lit("many"))
    checked = F.when(F.size(found) == F.size("_names"), found).otherwise(
        F.raise_error(F.format_string("line %s of %s has too %s values", F.col("_line") + 1, F.col("path"), wrong))
    )
    time_at = F.array_position("_times", F.lit(True))
    rows = data.select(
        F.col("path").alias("recording_id"),
        (F.col("_line") - skip_rows - 1).alias("idx"),
        "n",
        "_names",
        "_times",
        checked.alias("_cells"),
    ).withColumn("t", _number(F.when(time_at > 0, F.get("_cells", (time_at - 1).cast("int")))))
    return (
        rows.select("recording_id", "idx", "n", "t", "_cells", "_times", F.posexplode("_names").alias("_pos", "channel"))
        .where(~F.get("_times", F.col("_pos")))
        .select(
            "recording_id",
            "channel",
            F.col("_pos").cast("long").alias("channel_pos"),
            "idx",
            "n",
            "t",
            _number(F.get("_cells", F.col("_pos"))).alias("value"),
        )
    )
