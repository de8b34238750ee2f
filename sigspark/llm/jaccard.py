"""Exact Jaccard join of texts on word shingles: size-banded tiles with hashed bitmap signatures.

A set's shingles are ordered from rare to frequent, by the frequency of their rarest word. Two sets that reach the
threshold share one of their first ``n - ceil(t * n) + 1`` shingles, and the shingles before the first shared one are
differences. So only documents that meet at such a shingle, near enough to the front, are compared. Documents that meet
are compared in tiles of near set sizes: the bits in which two bitmap signatures differ bound the overlap from above,
and only pairs that pass the bound have their sorted arrays intersected. Nothing is sampled or capped; the order of the
shingles and the tiles change the work, never the result.

Equal sets are one class from the start. Each class is first held against one or two it meets: those of most copies and
of smallest size. What these links join needs no further comparison, so a group of thousands of near copies of one text
costs a few comparisons a member rather than all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm import words as wd
from sigspark.llm.components import components
from sigspark.llm.tables import drop, freeze, in_batches, rows_of, store

# Counters of the word frequency sketch. A fixed size: its 2^20 levels of one byte are sent to every task.
SKETCH_BITS = 20
# A shingle's code: its level in the upper bits, so that codes sort from rare to frequent, and the rest of its hash.
_LEVEL_BITS = 6
# Bits of the sketch that tells which texts are needed for exact intersections. A fixed size of one megabyte.
_MARK_BITS = 23
# Members of one meeting place that one task compares; larger places are cut into pairs of tiles.
TILE = 512
_LEAST_BITS, _MOST_BITS = 256, 1 << 14


def _least_overlap(n, percent: int):
    """Members that a set of ``n`` shares at least with any set that reaches the threshold."""
    return (percent * n + 99) // 100


def _coded(hashes: np.ndarray, size: int, levels: np.ndarray) -> np.ndarray:
    """Sorted distinct codes of a text's shingles, rare ones first."""
    found = wd.shingles(hashes, size)
    if not len(found):
        return found
    level = levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    n = len(found)
    least = level[:n]
    for j in range(1, len(hashes) - n + 1):
        least = np.minimum(least, level[j : j + n])
    return wd.distinct(least.astype(np.uint64) << np.uint64(64 - _LEVEL_BITS) | found >> np.uint64(_LEVEL_BITS))


def _sets(batches, size: int, levels: np.ndarray):
    """Rows of a batch with the codes of their shingles."""
    for batch in batches:
        for first, end in rows_of(batch, 512):
            part = batch.slice(first, end - first)
            hashes, at = wd.words(part.column("text"))
            yield part, [_coded(hashes[at[i] : at[i + 1]], size, levels) for i in range(len(part))]


def word_levels(docs: DataFrame) -> np.ndarray:
    """How frequent the words of each of the sketch's counters are, on a logarithmic scale from 0 (rare)."""
    cells = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for first, end in rows_of(batch, 512):
                hashes, _ = wd.words(batch.column("text").slice(first, end - first))
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        seen = np.flatnonzero(total)
        yield {"cell": seen.astype(np.int32), "n": total[seen]}

    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = in_batches(texts, count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # one byte a counter
    step = F.least(F.floor(2 * F.log2(F.col("n").cast("double"))), F.lit((1 << _LEVEL_BITS) - 1)).cast("int")
    levels = np.zeros(cells, np.uint8)
    for r in rows.groupBy(step.alias("step")).agg(F.collect_list("cell").alias("cells")).collect():
        levels[r["cells"]] = r["step"]
    return levels


def _key(shingles: np.ndarray) -> np.uint64:
    return np.add.reduce(wd.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)


def _bitmap(shingles: np.ndarray) -> bytes:
    """Signature of about four bits a member; its length is a power of two. A bit tells whether an odd number of members
    falls on it, so each member that only one of two sets has changes one bit at most."""
    n = len(shingles)
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << max(0, (4 * n - 1).bit_length())))
    marks = (np.bincount(((shingles >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(marks, bitorder="little").tobytes()


def _folded(bitmap: bytes) -> bytes:
    """A quarter of a signature's length, about a bit a member: what tiles carry. Full ones judge what passes."""
    x = np.frombuffer(bitmap, np.uint64)
    for _ in range(2):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def shingle_sets(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``doc_id, n, key, prefix, bitmap, mark`` of each document; equal sets have equal keys."""

    def summarise(batches):
        for part, sets in _sets(batches, size, levels):
            keys, prefixes, bitmaps = [], [], []
            for s in sets:
                keys.append(_key(s))
                prefixes.append(s[: len(s) - _least_overlap(len(s), percent) + 1] if len(s) else s)
                bitmaps.append(_bitmap(s))
            ends = np.cumsum([0, *map(len, prefixes)])
            yield {
                "doc_id": part.column("doc_id"), "n": np.array([len(s) for s in sets], np.int64),
                "key": wd.signed(np.array(keys, np.uint64)),
                "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(wd.signed(np.concatenate(prefixes)))),
                "bitmap": pa.array(bitmaps, pa.binary()), "mark": pa.array([_folded(b) for b in bitmaps], pa.binary()),
            }

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(source, summarise, "doc_id long, n long, key long, prefix array<long>, bitmap binary, mark binary")


def _near(a, b, percent: int):
    """Set sizes that allow the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _differing_bits(bitmaps: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of each pair differ, the longer one folded to the length of the other."""
    lengths = np.array([len(b) for b in bitmaps])
    out = np.zeros(len(left), np.int64)
    stacks = {}
    for w in np.unique(lengths):
        rows = np.flatnonzero(lengths == w)
        place = np.zeros(len(bitmaps), np.int64)
        place[rows] = np.arange(len(rows))
        stacks[w] = (place, np.frombuffer(b"".join(bitmaps[i] for i in rows), np.uint64).reshape(len(rows), -1))

    def side(rows, own, width):
        place, stack = stacks[own]
        got = stack[place[rows]]
        while got.shape[1] * 8 > width:
            half = got.shape[1] // 2
            got = got[:, :half] ^ got[:, half:]
        return got

    pair_kind = lengths[left] * (1 << 32) + lengths[right]
    for kind in np.unique(pair_kind):
        chosen = np.flatnonzero(pair_kind == kind)
        wl, wr = int(kind >> 32), int(kind & 0xFFFFFFFF)
        step = max(1, (1 << 22) // min(wl, wr))
        for at in range(0, len(chosen), step):
            rows = chosen[at : at + step]
            x = side(left[rows], wl, min(wl, wr)) ^ side(right[rows], wr, min(wl, wr))
            out[rows] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    return out


def _may_reach(n_left, n_right, differing, percent: int):
    """Whether the overlap's upper bound (n_left + n_right - differing) / 2 allows the threshold."""
    most = (n_left + n_right - differing) // 2
    return (100 + percent) * most >= percent * (n_left + n_right)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``a, b`` of the class pairs that reach the threshold: first by their whole signatures, then by their members."""
    marks = sets.select("key", "n", "bitmap")
    both = (
        pairs.join(marks.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("map_a")), "a")
        .join(marks.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("map_b")), "b")
    )

    def bounded(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            maps = batch.column("map_a").to_pylist() + batch.column("map_b").to_pylist()
            bits = _differing_bits(maps, np.arange(n), np.arange(n, 2 * n))
            keep = pa.array(_may_reach(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), bits, percent))
            yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    pairs, pairs_path = store(in_batches(both, bounded, "a long, b long"))
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted, wanted_path = store(sets.join(needed, "key", "left_semi").select("key", F.col("rep").alias("doc_id")))
    members, members_path = store(_members(docs, wanted, size, levels))
    both = (
        pairs.join(members.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
        .join(members.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b")
    )

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(x) + len(y) - len(wd.distinct(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    links = freeze(in_batches(both, linked, "a long, b long"))
    for path in (pairs_path, wanted_path, members_path):
        drop(docs.sparkSession, path)
    return links


def _members(docs: DataFrame, wanted: DataFrame, size: int, levels: np.ndarray) -> DataFrame:
    """``key, members`` of the classes in ``wanted`` (``key, doc_id``), from their texts.

    A sketch of the wanted ids decides where shingles are made, so texts are neither shuffled nor made into shingles in
    vain. It may let others through; the join drops them. A repeated doc_id may carry other texts than its class: the
    set's key tells them apart.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _MARK_BITS))
    rows = wanted.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(spot % 32 AS INT))")).alias("bits")).collect()
    marks = np.zeros(1 << _MARK_BITS >> 5, np.int64)
    marks[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    packed = docs.sparkSession.sparkContext.broadcast(marks.astype(np.uint32))

    def make(batches):
        marks = packed.value
        for batch in batches:
            spots = batch.column("spot").to_numpy()
            good = marks[spots >> 5] >> (spots & 31).astype(np.uint32) & np.uint32(1)
            for part, found in _sets([batch.filter(pa.array(good == 1))], size, levels):
                ends = np.cumsum([0, *map(len, found)])
                yield {"doc_id": part.column("doc_id"), "key": wd.signed(np.array([_key(s) for s in found], np.uint64)),
                       "members": pa.ListArray.from_arrays(
                           pa.array(ends, pa.int32()), pa.array(wd.signed(np.concatenate([*found, np.zeros(0, np.uint64)]))))}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id IS NOT NULL").withColumn("spot", spot)
    made = in_batches(texts, make, "doc_id long, key long, members array<long>")
    return made.join(wanted, ["doc_id", "key"], "left_semi").dropDuplicates(["key"]).select("key", "members")


def _meetings(classes: DataFrame, percent: int) -> DataFrame:
    """``h, key, n, pos, met``: the shingles of all prefixes at which a class may meet another that reaches the threshold.

    Two that reach it have near sizes, so by size each one's neighbour at their first common shingle is near as well; and
    all shingles before that one differ, which bounds the sum of their positions. Rows are shuffled once.
    """
    place = Window.partitionBy("h")
    by_size = place.orderBy("n")
    meeting = classes.select("key", "n", F.posexplode("prefix").alias("pos", "h"))
    # as in _pairs: a pair's first common shingle has a sum of slacks of zero at least
    slack = (100 - percent) * F.col("n") - (100 + percent) * F.col("pos")
    return (
        meeting.select("*", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"))
        .where((100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above")))
        .select("h", "key", "n", "pos", F.max(slack).over(place).alias("most"))
        .where(slack + F.col("most") >= 0)
        .select("h", "key", "n", "pos", F.count(F.lit(1)).over(place).alias("met"))
        .where("met > 1")
    )


def _tiled(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Class pairs of one meeting place and different components whose signatures allow the threshold."""
    rows = shared.join(sets.select("key", F.col("mark").alias("bitmap")), "key")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    tiles = F.ceil(F.col("met") / TILE).cast("int")
    own = F.pmod(F.xxhash64("key"), tiles).cast("int")
    each = F.sequence(F.lit(0), tiles - 1)

    def place(band, role, i, j):
        return F.struct(band.alias("band"), F.lit(role).alias("role"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    small = F.array(place(F.lit(-1), 0, F.lit(0), F.lit(0)))
    # role 0: all pairs inside; 1 and 2: only pairs between the roles
    apart = F.concat(
        F.transform(each, lambda t: F.when(t == own, place(band, 0, own, own)).when(t > own, place(band, 1, own, t))
                    .otherwise(place(band, 2, t, own))),
        F.transform(each, lambda t: place(band, 3, own, t)),
        F.transform(each, lambda t: place(band - 1, 4, t, own)),
    )
    dealt = rows.withColumn("at", F.explode(F.when(F.col("met") <= TILE, small).otherwise(apart))).select(
        "h", "at.band", F.floor((F.col("at.role") + 1) / 2).cast("int").alias("kind"), "at.i", "at.j",
        "n", "pos", F.pmod(F.col("at.role"), F.lit(2)).cast("int").alias("role"), "key", "component", "bitmap",
    )
    dealt = dealt.repartition("h", "band", "kind", "i", "j").sortWithinPartitions("h", "band", "kind", "i", "j", "n")

    def compare(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            group = _groups(table)
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            rest = table.slice(last)
            if last:
                yield from _pairs(table.slice(0, last), group[:last], percent)
        if rest is not None and len(rest):
            yield from _pairs(rest, _groups(rest), percent)

    return in_batches(dealt, compare, "a long, b long").distinct()


def _groups(table: pa.Table) -> np.ndarray:
    """Number of each row's tile; rows of a tile are neighbours."""
    cols = [table.column(c).to_numpy() for c in ("h", "band", "kind", "i", "j")]
    new = np.zeros(len(table), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _pairs(table: pa.Table, group: np.ndarray, percent: int):
    n, pos, key, comp, role, kind = (
        table.column(c).to_numpy() for c in ("n", "pos", "key", "component", "role", "kind"))
    bitmaps = table.column("bitmap").to_pylist()
    alive = np.arange(len(group))
    step = 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(group)]
        # rows are in order of size: once the next one is too large, so are all later ones
        alive = alive[(group[alive] == group[np.minimum(alive + step, len(group) - 1)])]
        alive = alive[100 * n[alive] >= percent * n[alive + step]]
        other = alive + step
        open_ = (comp[alive] != comp[other]) & ((kind[alive] == 0) | (role[alive] != role[other]))
        # if this is the first shingle that both have, all those before it differ
        open_ &= (100 + percent) * (pos[alive] + pos[other]) <= (100 - percent) * (n[alive] + n[other])
        left, right = alive[open_], other[open_]
        if len(left):
            keep = _may_reach(n[left], n[right], _differing_bits_of(bitmaps, left, right), percent)
            a, b = key[left[keep]], key[right[keep]]
            if len(a):
                yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}


def _differing_bits_of(bitmaps, left, right):
    used, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    return _differing_bits([bitmaps[i] for i in used], back[: len(left)], back[len(left) :])


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are not read. One row per row of
    ``docs``: ``doc_id``, ``n_shingles`` (0 for a null, empty or blank text, which links with nothing) and
    ``component_id``, the smallest doc_id reachable by links. Texts shorter than ``size`` words are one shingle. Rows
    that repeat a doc_id are one node with the links of all its texts. A row with a null doc_id links with nothing and
    has a null component_id. An empty table gives an empty result. Links within a component are not enumerated: pairs
    that other links already join are not compared, so there is no list or number of a document's links.
    """
    levels = word_levels(docs)
    whole, path = store(shingle_sets(docs, size, percent, levels))
    classes = freeze(
        whole.where("n > 0 AND doc_id IS NOT NULL").groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
             F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"), F.first("mark").alias("mark"))
    )
    sets = freeze(whole.select("doc_id", "n", "key"))
    drop(docs.sparkSession, path)
    shared, path = store(_meetings(classes, percent))
    ranked = shared.select("h", "key", "n").join(classes.where("copies > 1").select("key", "copies"), "key", "left")
    leads = ranked.groupBy("h").agg(F.max(F.struct(F.coalesce("copies", F.lit(1)).alias("copies"), "key")).alias("most"),
                                    F.min(F.struct("n", "key")).alias("least"))
    leaders = shared.select("h", "key").join(leads, "h").groupBy("key").agg(
        F.max("most").alias("most"), F.min("least").alias("least"))
    first = leaders.select("key", F.explode(F.array("most.key", "least.key")).alias("lead")).where("key <> lead").select(
        F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
    links = _verified(first, classes, docs, size, percent, levels)
    joined = components(links)
    known = freeze(shared.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")))
    drop(docs.sparkSession, path)
    shared = known
    mixed = shared.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rest = _tiled(shared.join(mixed.select("h"), "h"), classes, percent)
    more = _verified(rest, classes, docs, size, percent, levels)

    reps = classes.select("key", "rep")
    found = (
        links.union(more)
        .join(reps.select(F.col("key").alias("a"), F.col("rep").alias("rep_a")), "a")
        .join(reps.select(F.col("key").alias("b"), F.col("rep").alias("rep_b")), "b")
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    copies = sets.where("n > 0").select("doc_id", "key").join(classes.where("copies > 1").select("key", "rep"), "key")
    nodes = components(found.union(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
