"""Near-duplicate vectors with randomised-rotation binary codes.

A unit vector is rotated at random and only the signs of its coordinates are kept, with a correction factor: the
product of the rotated vector and its signs. The product of another rotated vector and the signs, divided by that
factor, estimates the inner product without bias, and the factor gives the estimate's spread. Pairs whose upper
confidence bound misses the threshold are dropped; the cosine of all others is computed exactly in double precision.

Candidates meet in buckets: slices of the sign codes of further rotations. The number of slices follows from the
wanted recall at the threshold, their width from the number of vectors, so buckets stay small as vectors grow. Large
buckets are cut into tiles that meet pairwise. A pair counts in the first bucket that it shares.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.components import components
from sigspark.llm.tables import freeze, in_batches

#: Wanted recall of links at exactly the threshold (more for nearer pairs), spreads of the confidence bound, tile size.
RECALL, SPREADS, TILE = 0.97, 3.0, 1024
_SEED = 20240229


@functools.lru_cache(8)
def _rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, the same in every task."""
    rng = np.random.default_rng((_SEED, dim))
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def _plan(vectors: int, threshold: float) -> tuple[int, int]:
    """Bits of a slice and number of slices."""
    bits = min(24, max(6, round(math.log2(max(2, vectors))) - 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slices(x: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Bucket of each vector for each slice, from signs of rotations beyond the first."""
    dim = x.shape[1]
    turns = _rotations(dim, 1 + -(-bits * slices // dim))[1:]
    signs = np.concatenate([x @ t.T >= 0 for t in turns], axis=1)[:, : bits * slices]
    return signs.reshape(len(x), slices, bits) @ (1 << np.arange(bits, dtype=np.int64))


def links_within(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, buckets: np.ndarray, turn: int, threshold: float):
    """Pairs (i < j in place, one of ``rows``, one of ``cols``) that reach the threshold and first meet in slice ``turn``.

    ``x`` are unit vectors. Yields index arrays in blocks.
    """
    dim = x.shape[1]
    rotated = x @ _rotations(dim, 1)[0].T
    signs = np.where(rotated >= 0, 1.0, -1.0) / math.sqrt(dim)
    factor = (rotated * signs).sum(axis=1)
    spread = SPREADS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    same = rows is cols
    for at in range(0, len(rows), 256):
        own = rows[at : at + 256]
        estimate = rotated[own].astype(np.float32) @ signs[cols].astype(np.float32).T / factor[cols].astype(np.float32)
        i, j = np.nonzero(estimate + spread[cols].astype(np.float32) >= threshold - 1e-4)
        if same:
            upper = j > i + at
            i, j = i[upper], j[upper]
        i, j = own[i], cols[j]
        for part in range(0, len(i), 1 << 17):
            a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            keep = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[keep], b[keep]
            if turn and len(a):
                first = (buckets[a, :turn] != buckets[b, :turn]).all(axis=1)
                a, b = a[first], b[first]
            if len(a):
                yield a, b


def _forest(n: int, pairs) -> np.ndarray:
    """Root of each of n nodes."""
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row: other vectors of a cosine of at least ``threshold`` found,
    the smallest vec_id reachable, and whether that is its own.

    Every row is indexed. Equal vectors are one class and always linked. A null, empty or zero vector, or one with null
    or non-finite components, links with nothing; so does a vector with those of another length, and a row without a
    vec_id (its component_id is null, kept false). Rows that repeat a vec_id are one node; rows that repeat a vec_id
    and its vector count once. Other columns are not read. An empty table gives an empty result.
    """
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = (F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(v, lambda x: x != 0))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), v)).withColumn(
        "class", F.when(v.isNotNull(), F.xxhash64(F.transform("v", lambda x: x + 0.0))))
    ids = freeze(rows.select("vec_id", "class"))
    once = rows.where("class IS NOT NULL").dropDuplicates(["vec_id", "class"])
    classes = freeze(once.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("v").alias("v")))
    total = classes.count()
    bits, slices = _plan(total, threshold)

    def spread(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                for at in range(0, len(part), 512):
                    some = part.slice(at, 512)
                    found = _slices(_matrix(some.column("v")), bits, slices)
                    n = len(some)
                    yield {"class": np.repeat(some.column("class").to_numpy(), slices),
                           "dim": np.full(n * slices, dim, np.int32),
                           "turn": np.tile(np.arange(slices, dtype=np.int32), n), "bucket": found.reshape(-1)}

    met = freeze(in_batches(classes.select("class", "v"), spread, "class long, dim int, turn int, bucket long"))
    sizes = met.groupBy("dim", "turn", "bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    tiles = F.ceil(F.col("met") / TILE).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit(7)), tiles).cast("int")
    places = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(
        F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
    # pairs of tiles: a member of tile i meets those of every tile j
    dealt = (
        met.join(sizes, ["dim", "turn", "bucket"])
        .select("class", "dim", "turn", "bucket", own.alias("own"), F.explode(places).alias("at"))
        .join(classes.select("class", "copies", "v"), "class")
        .select("dim", "turn", "bucket", "at.i", "at.j", "own", "class", "copies", "v")
        .repartition("dim", "turn", "bucket", "i", "j").sortWithinPartitions("dim", "turn", "bucket", "i", "j", "class")
    )

    def compare(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            group = _runs(table)
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            rest = table.slice(last)
            if last:
                yield from _tiles(table.slice(0, last), group[:last], bits, slices, threshold)
        if rest is not None and len(rest):
            yield from _tiles(rest, _runs(rest), bits, slices, threshold)

    found = freeze(in_batches(dealt, compare, "class long, links long, other long"))
    counts = found.where("links > 0").groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()
    reps = classes.select("class", "rep")
    edges = edges.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("rep_a")), "a").join(
        reps.select(F.col("class").alias("b"), F.col("rep").alias("rep_b")), "b").select(
        F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    per_class = classes.select("class", "rep", "copies").join(counts, "class", "left").select(
        "class", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = freeze(ids.join(per_class, "class", "left"))
    copies = known.where("copies > 1").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    nodes = components(edges.union(copies))
    out = known.join(nodes.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _runs(table: pa.Table) -> np.ndarray:
    new = np.zeros(len(table), bool)
    for c in ("dim", "turn", "bucket", "i", "j"):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _tiles(table: pa.Table, group: np.ndarray, bits: int, slices: int, threshold: float):
    """Links of the members of each tile, and enough pairs to join what they join."""
    ends = np.flatnonzero(np.diff(np.append(group, group[-1] + 1))) + 1
    first = 0
    out: dict[str, list] = {"class": [], "links": [], "other": []}
    for end in ends:
        part = table.slice(first, end - first).combine_chunks()
        first = end
        i, j, own = part.column("i").to_numpy(), part.column("j").to_numpy(), part.column("own").to_numpy()
        if len(part) < 2:
            continue
        x = _matrix(part.column("v").chunk(0))
        turn = int(part.column("turn")[0].as_py())
        buckets = _slices(x, bits, slices) if turn else np.zeros((len(x), 0), np.int64)
        if i[0] == j[0]:
            rows = cols = np.arange(len(x))
        else:
            rows, cols = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        names, copies = part.column("class").to_numpy(), part.column("copies").to_numpy()
        links = np.zeros(len(x), np.int64)

        def found():
            for a, b in links_within(x, rows, cols, buckets, turn, threshold):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                yield a, b

        root = _forest(len(x), found())
        linked = np.flatnonzero(links)
        if len(linked):
            out["class"].append(names[linked])
            out["links"].append(links[linked])
            out["other"].append(names[root[linked]])
    if out["class"]:
        yield {k: np.concatenate(v) for k, v in out.items()}
