"""Hard negatives of anchor vectors by exact integer products, several candidates in one multiplication.

Components become integers. The components of several candidates are biased by the block's least, so that none is
negative, and laid side by side into separate fields of one wide integer; a product with an anchor's component then
multiplies all of them at once, and the fields of the summed products are the candidates' scores, plus a known bias.
Fields are as wide as the largest possible sum of a block needs. A wide integer has 53 bits, which doubles hold
exactly, so the multiplication is a matrix product; where one field needs more, Python's integers are the wide ones.

Anchors go to the tasks in bounded blocks, and each block meets every candidate where it lies: vectors are not moved.
Tasks return their best rows of each anchor only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.tables import drop, freeze, in_batches, store
from sigspark.operators.scale import shared_dir

#: Bytes and number of anchors that go to the tasks at once, candidates of a packed block, rows a task holds of a wave.
WAVE_BYTES, WAVE, BLOCK, HELD = 8 << 20, 8192, 8192, 1 << 21
_WORD_BITS = 53
_LONG = 1 << 63


def units(x: float) -> int:
    """floor(256 * x) of a finite double, exactly."""
    return int(np.floor(256 * x)) if abs(x) < 2.0**900 else 256 * int(x)


def _integers(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of integers: int64, or Python's if products of them might not fit."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(n, len(x) // n if n else 0)
    if not x.size or np.abs(x).max() < 2.0**14:
        return np.floor(256 * x).astype(np.int64)
    return np.array([[units(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Packed:
    """Candidates as fields of wide integers."""

    def __init__(self, rows: np.ndarray, weight: int):
        """``weight``: the largest sum of the absolute components of any anchor to come."""
        self.count = len(rows)
        self.low = rows.min(axis=0) if rows.size else rows.sum(axis=0)
        biased = rows - self.low
        span = int(biased.max()) if biased.size else 0
        self.half = 1 << max(1, (int(weight) * span).bit_length())  # no sum reaches it, of either sign
        width = self.half.bit_length()
        self.exact = width <= _WORD_BITS and weight < 1 << _WORD_BITS and rows.dtype != object
        fields = max(1, _WORD_BITS // width) if self.exact else 8
        self.shifts = [f * width for f in range(fields)]
        words = -(-self.count // fields)
        full = np.zeros((words * fields, rows.shape[1]), rows.dtype if self.exact else object)
        full[: self.count] = biased
        full = full.reshape(fields, words, rows.shape[1])
        packed = sum((full[f] << s if self.exact else full[f] * (1 << s)) for f, s in enumerate(self.shifts))
        self.words = np.ascontiguousarray(packed.T.astype(np.float64 if self.exact else object))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one row per anchor."""
        bias = anchors @ self.low
        lift = sum(self.half << s for s in self.shifts)
        if self.exact:
            sums = (anchors.astype(np.float64) @ self.words).astype(np.int64) + lift
        else:
            sums = anchors.astype(object) @ self.words + lift
        mask = 2 * self.half - 1
        fields = [((sums >> s) & mask) - self.half for s in self.shifts]
        return np.concatenate(fields, axis=1)[:, : self.count] + bias[:, None]


class Best:
    """The ``most`` first (score descending, then id) of each group, of all rows seen so far."""

    def __init__(self, most: int):
        self.most, self.parts, self.held = most, [], 0

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((group, ids, score))
        self.held += len(ids)
        if self.held > HELD:
            self.parts = [self.rows()]
            self.held = len(self.parts[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        group, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, group)) if score.dtype != object else np.array(
            sorted(range(len(ids)), key=lambda i: (group[i], -score[i], ids[i])), np.int64)
        group, ids, score = group[order], ids[order], score[order]
        first = np.searchsorted(group, group)
        keep = np.arange(len(group)) - first < self.most
        return group[keep], ids[keep], score[keep]


def _first(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores; of equal ones the earlier (rows come in order of id)."""
    if len(score) <= most:
        return np.arange(len(score))
    if score.dtype == object:
        return np.argsort(-score, kind="stable")[:most]
    least = np.partition(score, len(score) - most)[len(score) - most]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: most - len(above)]])


def _blocks(batches, columns, dims):
    """Candidates in blocks of one length that an anchor has, in order of id: ids, labels, integers."""
    held: dict[int, list] = {}
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            if int(dim) in dims:
                parts = held.setdefault(int(dim), [])
                parts.append(batch.filter(pa.array(sizes == dim)))
                if sum(map(len, parts)) >= BLOCK:
                    yield int(dim), *_block(parts, columns)
                    held[int(dim)] = []
    for dim, parts in held.items():
        if parts:
            yield dim, *_block(parts, columns)


def _block(parts, columns):
    table = pa.Table.from_batches(parts).combine_chunks().sort_by("vec_id")
    values = _integers(table.column("v").combine_chunks())
    return [table.column(c).to_numpy() for c in columns], values


def _columns(score: np.ndarray) -> dict:
    """Scores as longs, and for those that a long cannot hold a text that sorts as they do."""
    if score.dtype != object:
        return {"score": score, "beyond": pa.nulls(len(score), pa.string())}
    whole = [int(s) for s in score]
    return {"score": [max(-_LONG, min(_LONG - 1, s)) for s in whole],
            "beyond": [None if -_LONG < s < _LONG - 1 else _sortable(s) for s in whole]}


def _sortable(score: int) -> str:
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score >= 0 else "0" + "".join(str(9 - int(c)) for c in text)


def _score(score: int, beyond: str | None) -> int:
    """The whole score again."""
    if beyond is None:
        return score
    return int(beyond[7:]) if beyond[0] == "1" else -int("".join(str(9 - int(c)) for c in beyond[7:]))


class _Wave:
    """A block of anchors: by length of vector their rows, and what all tasks need of them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("vec_id")
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.marks = table.column("mark").to_numpy()
        sizes = pa.compute.list_value_length(table.column("v")).to_numpy(zero_copy_only=False)
        self.by_dim = {}
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            values = _integers(table.column("v").take(pa.array(at)).combine_chunks())
            self.by_dim[int(dim)] = at, values, int(np.abs(values).sum(axis=1).max()) if values.size else 0


def hard_negatives(vectors: DataFrame, anchor: str, label: str = "label", positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, vec_id: str = "vec_id", embedding: str = "embedding",
                   wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Hard negatives of every positive of every anchor.

    ``anchor`` is a condition on ``vec_id`` (SQL); ``label`` an expression of the label. A row's score is the inner
    product of floor(256 * component) with the anchor's; higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score are returned:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null vec_id, label or vector, or any null or non-finite component, take no part. Rows that repeat
    vec_id, label and vector count once; rows of one vec_id that differ are rows of their own, ties among them by a
    hash, and an anchor each. Vectors of another length than the anchor's are not compared with it. Scores are exact
    whatever their size; those beyond 64 bits are reported as the nearest long. Other columns are not read. An anchor
    without positives or negatives gives no row, and so does an empty table.
    """
    spark = vectors.sparkSession
    v, same = F.col("v"), ["vec_id", "label", "mark"]
    kind = dict(vectors.dtypes)[embedding]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"),
                          F.col(embedding).cast(kind).alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(sound)
    candidates, path = store(rows.withColumn("mark", F.xxhash64("vec_id", F.transform("v", lambda x: x + F.lit(0.0)))))
    repeated = freeze(candidates.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not repeated.isEmpty():
        once = candidates.join(repeated, same, "left_semi").dropDuplicates([*same, "v"])
        candidates, rest = store(candidates.join(repeated, same, "left_anti").unionByName(once))
        drop(spark, path)
        path = rest
    anchors, anchors_path = store(candidates.where(anchor))
    total, longest = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    waves = max(-(-total * (8 * longest + 64) // wave_bytes), -(-total // WAVE))
    folder = f"{shared_dir(spark)}/sigspark/{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for wave in range(waves):
        own = anchors.where(F.pmod(F.xxhash64("mark"), F.lit(waves)) == wave).toArrow()
        if len(own):
            found = _of_wave(candidates, _Wave(own), positives, negatives, low, high)
            found.write.parquet(f"{folder}/wave={wave}")
    drop(spark, anchors_path)
    drop(spark, path)
    if not total:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*[c.split()[0] for c in schema.split(", ")])


def _of_wave(candidates: DataFrame, wave: _Wave, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(wave)  # at most about WAVE_BYTES

    def nearest(batches):
        wave, best = shared.value, Best(positives)
        for dim, (ids, labels, marks), values in _blocks(batches, ["vec_id", "label", "mark"], wave.by_dim):
            at, rows, weight = wave.by_dim[dim]
            for name in np.unique(labels):
                mine = np.flatnonzero(labels == name)
                own = np.flatnonzero(wave.labels[at] == name)
                if not len(own):
                    continue
                packed = Packed(values[mine], weight)
                for part in range(0, len(own), 64):
                    some = own[part : part + 64]
                    for i, score in zip(at[some], packed.scores(rows[some])):
                        keep = np.flatnonzero(marks[mine] != wave.marks[i])
                        keep = keep[_first(score[keep], positives)]
                        best.add(np.full(len(keep), i), ids[mine[keep]], score[keep])
        group, ids, score = best.rows()
        yield {"anchor": group, "id": ids, **_columns(score)}

    order = [F.col("score").desc(), F.col("beyond").desc_nulls_last(), F.col("id")]
    near = in_batches(candidates, nearest, "anchor long, id long, score long, beyond string")
    part = Window.partitionBy("anchor").orderBy(*order)
    near = near.withColumn("place", F.row_number().over(part)).where(F.col("place") <= positives).toArrow()
    # at most ``positives`` rows of each anchor of the wave
    by_anchor: dict[int, list] = {}
    names, scores = [], []
    for i, p, s, beyond in zip(*(near.column(c).to_pylist() for c in ("anchor", "id", "score", "beyond"))):
        by_anchor.setdefault(i, []).append(len(names))
        names.append((i, p, s))
        scores.append(_score(s, beyond))
    pairs = spark.sparkContext.broadcast((by_anchor, scores))

    def hard(batches):
        wave, (by_anchor, scores), best = shared.value, pairs.value, Best(negatives)
        for dim, (ids, labels), values in _blocks(batches, ["vec_id", "label"], wave.by_dim):
            at, rows, weight = wave.by_dim[dim]
            packed = Packed(values, weight)
            for part in range(0, len(at), 64):
                for i, score in zip(at[part : part + 64], packed.scores(rows[part : part + 64])):
                    other = labels != wave.labels[i]
                    for pair in by_anchor.get(int(i), ()):
                        p = scores[pair]
                        keep = np.flatnonzero(other & (score >= -(-low * p // 100)) & (score <= high * p // 100))
                        if len(keep):
                            keep = keep[_first(score[keep], negatives)]
                            best.add(np.full(len(keep), pair), ids[keep], score[keep])
        group, ids, score = best.rows()
        yield {"pair": group, "id": ids, **_columns(score)}

    found = in_batches(candidates, hard, "pair long, id long, score long, beyond string")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(*order)))
    of_pair = pa.table({"pair": pa.array(range(len(names)), pa.int64()),
                        "anchor_id": pa.array([int(wave.ids[i]) for i, _, _ in names], pa.int64()),
                        "positive_id": pa.array([p for _, p, _ in names], pa.int64()),
                        "positive_score": pa.array([s for _, _, s in names], pa.int64())})
    return ranked.where(F.col("rank") <= negatives).join(F.broadcast(spark.createDataFrame(of_pair)), "pair").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
