"""Exact duplicates by exchanging compressed fingerprints instead of texts.

Every partition of the input keeps its normalised texts where they were written, in a table with one bucket for each
partition, and works in chunks of bounded size. Equal texts of a chunk are one member, found by their bytes. A chunk
sends each owner - a range of fingerprints - its distinct fingerprints, sorted and Golomb-Rice-coded, a few bits more
than their number needs. Owners answer with a bitmap of those that another chunk has too. Only members with their bit
set are suspects: their texts alone are shuffled, and grouped by their bytes. What the groups find goes back to the
rows by chunk and member.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.tables import drop, freeze, in_batches
from sigspark.operators.scale import shared_dir

#: Bytes of distinct texts and rows after which a chunk is full, fingerprints an owner gets, bits beyond the count's own.
CHUNK_BYTES, CHUNK_ROWS, OWNER_ROWS, SPARE_BITS = 16 << 20, 1 << 16, 1 << 22, 10
#: Most buckets; partitions beyond share them, under keys of their own from here.
_BUCKETS, _FURTHER = 1 << 15, 1 << 40
_KINDS = "kind int, home long, member long, place int, slot int, n long, doc_id long, first boolean, sha binary, body binary"
_MESSAGE, _MEMBER, _ROW = range(3)


def golomb_encode(values: np.ndarray, base: int, span: int) -> bytes:
    """Sorted distinct integers of [base, base + span) as gaps: quotients in unary, then remainders of k bits each."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(base)) - np.concatenate([[0], np.ones(n - 1)]).astype(np.uint64)
    k = max(0, int(0.69 * span / n).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = gaps[:, None] >> np.arange(k, dtype=np.uint64) & np.uint64(1)
    packed = np.packbits(unary).tobytes()
    return bytes([k]) + len(packed).to_bytes(4, "big") + packed + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(code: bytes, n: int, base: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    k, size = code[0], int.from_bytes(code[1:5], "big")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 5)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=5 + size), count=n * k).reshape(n, k).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps + np.concatenate([[0], np.ones(n - 1)]).astype(np.uint64), dtype=np.uint64) + np.uint64(base)


def repeated_bits(messages: list[tuple[int, bytes]], base: int) -> list[np.ndarray]:
    """For each message ``(n, code)`` a bit, in 64-bit words, for each fingerprint that another message has too."""
    parts = [golomb_decode(code, n, base) for n, code in messages]
    values, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    bits = counts[back] > 1
    out, at = [], 0
    for part in parts:
        own = np.zeros(-(-len(part) // 64) * 64, bool)
        own[: len(part)] = bits[at : at + len(part)]
        out.append(np.packbits(own, bitorder="little").view(np.int64))
        at += len(part)
    return out


class _Chunk:
    """Rows of one chunk; equal texts are one member."""

    def __init__(self, home: int, seq: int, member: int):
        self.home, self.seq, self.first_member = home, seq, member
        self.at: dict[bytes, int] = {}
        self.shas, self.counts, self.least, self.least_row = [], [], [], []
        self.rows: list[tuple[int, int | None]] = []
        self.bytes = 0

    def add(self, doc_id, body: bytes, sha: bytes) -> None:
        i = self.at.setdefault(body, len(self.at))
        if i == len(self.shas):
            self.shas.append(sha)
            self.counts.append(0)
            self.least.append(doc_id)
            self.least_row.append(len(self.rows))
            self.bytes += len(body)
        elif doc_id is not None and (self.least[i] is None or doc_id < self.least[i]):
            self.least[i], self.least_row[i] = doc_id, len(self.rows)
        self.counts[i] += 1
        self.rows.append((i, doc_id))

    def tables(self, bits: int, owner_bits: int):
        """Messages to the owners, members and rows."""
        prints = np.array([int.from_bytes(s[:8].ljust(8, b"\0"), "big") for s in self.shas], np.uint64) >> np.uint64(64 - bits)
        values, inverse = np.unique(prints, return_inverse=True)
        shift = np.uint64(bits - owner_bits)
        owner = (values >> shift).astype(np.int64)
        ends = np.searchsorted(owner, np.arange((1 << owner_bits) + 1))
        place = owner + (self.seq << owner_bits)
        slot = np.arange(len(values)) - ends[owner]
        members, n = self.first_member + np.arange(len(self.shas)), len(self.rows)
        span = 1 << bits - owner_bits
        parts = [values[a:b] for a, b in zip(ends, ends[1:])]
        yield _table(_MESSAGE, self.home, len(parts), place=(self.seq << owner_bits) + np.arange(len(parts)),
                     n=[len(p) for p in parts], body=[golomb_encode(p, o * span, span) for o, p in enumerate(parts)])
        yield _table(_MEMBER, self.home, len(members), member=members, place=place[inverse], slot=slot[inverse],
                     n=self.counts, doc_id=self.least, sha=self.shas, body=list(self.at))
        own = np.array([i for i, _ in self.rows], np.int64)
        yield _table(_ROW, self.home, n, member=members[own], doc_id=[d for _, d in self.rows],
                     first=np.array(self.least_row)[own] == np.arange(n), sha=[self.shas[i] for i in own])


def _table(kind: int, home: int, rows: int, **columns) -> dict:
    empty = {"member": pa.int64(), "place": pa.int32(), "slot": pa.int32(), "n": pa.int64(), "doc_id": pa.int64(),
             "first": pa.bool_(), "sha": pa.binary(), "body": pa.binary()}
    out = {"kind": pa.array(np.full(rows, kind), pa.int32()), "home": pa.array(np.full(rows, home), pa.int64())}
    return out | {c: pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in empty.items()}


def _homes(spark: SparkSession, buckets: int) -> list[int]:
    """A key for each bucket: the least that Spark's bucket hash puts there."""
    keys = spark.range(buckets * 48).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).agg(F.min("id").alias("id"))
    return [r["id"] for r in keys.collect()]


def exact_duplicates(docs: DataFrame, digest: Column | None = None, chunk_rows: int = CHUNK_ROWS,
                     owner_rows: int = OWNER_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs`` (``doc_id``, ``text``).

    Texts are equal when their bytes are, after each run of space and \\x09-\\x0D is one space; a null text is empty.
    ``keep_id`` is the smallest doc_id of a text's rows and ``kept`` marks the one row that stays: of rows that repeat
    the smallest doc_id, one. A null doc_id counts after all others; where all of a group are null, keep_id is null and
    one row stays. Very long texts are a chunk of their own. Other columns are not read; an empty table gives an empty
    result. ``digest`` (of the column ``body``, binary) replaces SHA-256 in tests: a weak one costs time, not truth.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("body")).select(
        "doc_id", "body", (F.unhex(F.sha2("body", 256)) if digest is None else digest).alias("sha"))
    total, parts = docs.select(F.spark_partition_id().alias("part")).agg(
        F.count(F.lit(1)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    bits = min(62, max(total, 2).bit_length() + SPARE_BITS)
    owner_bits = max(0, (-(-total // owner_rows) - 1).bit_length())
    # fewer buckets than shuffle partitions, and Spark would deal the texts anew to join them
    homes = _homes(spark, min(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), _BUCKETS))

    def deal(batches):
        part = TaskContext.get().partitionId()
        home = homes[part] if part < len(homes) else _FURTHER + part
        chunk = _Chunk(home, 0, 0)
        for batch in batches:
            for doc_id, body, sha in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "sha"))):
                chunk.add(doc_id, body, sha)
                if chunk.bytes >= CHUNK_BYTES or len(chunk.rows) >= chunk_rows:
                    yield from chunk.tables(bits, owner_bits)
                    chunk = _Chunk(home, chunk.seq + 1, chunk.first_member + len(chunk.shas))
        if chunk.rows:
            yield from chunk.tables(bits, owner_bits)

    path, name = f"{shared_dir(spark)}/sigspark/{uuid.uuid4().hex}", f"sigspark_{uuid.uuid4().hex}"
    in_batches(rows, deal, _KINDS).write.partitionBy("kind").bucketBy(len(homes), "home").option("path", path).format(
        "parquet").saveAsTable(name)
    try:
        found = _verdicts(spark.table(name), bits, owner_bits)
        verdicts = freeze(found)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay
    own = spark.read.schema(_KINDS).parquet(path).where(F.col("kind") == _ROW).select("home", "member", "doc_id", "first", "sha")
    out = own.join(verdicts, ["home", "member"], "left")
    alone = F.col("top").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first") & (alone | ((F.col("top.home") == F.col("home")) & (F.col("top.member") == F.col("member"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _verdicts(held: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """``home, member, top, size`` of the members whose text stands in more than one row."""
    owner = F.pmod(F.col("place"), F.lit(1 << owner_bits))
    sent = held.where(F.col("kind") == _MESSAGE).select(owner.alias("owner"), "home", "place", "n", "body")
    sent = sent.repartition("owner").sortWithinPartitions("owner")

    def answer(batches):
        at, held = None, []

        def reply():
            words = repeated_bits([(n, code) for _, _, n, code in held], at << bits - owner_bits)
            return {"home": [h for h, *_ in held], "place": [p for _, p, *_ in held], "words": [w.tolist() for w in words]}

        for batch in batches:
            for owner, *message in zip(*(batch.column(c).to_pylist() for c in ("owner", "home", "place", "n", "body"))):
                if owner != at:
                    if held:
                        yield reply()
                    at, held = owner, []
                held.append(message)
        if held:
            yield reply()

    replies = freeze(in_batches(sent, answer, "home long, place int, words array<long>"))
    by_home = replies.groupBy("home").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "words"))), lambda x: x["words"]).alias("words"))
    # the texts stay in their buckets: only the bitmaps move
    bit = F.expr("shiftrightunsigned(words[place][CAST(slot DIV 64 AS INT)], slot % 64) & 1")
    members = held.where(F.col("kind") == _MEMBER).join(by_home.hint("shuffle_hash"), "home").withColumn("suspect", bit == 1)
    top = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "home", "member")
    suspects = members.where("suspect")
    by_text = suspects.groupBy("sha", "body").agg(F.min(top).alias("top"), F.sum("n").alias("size"))
    classes = freeze(by_text.select("sha", "top", "size"))
    if classes.groupBy("sha").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").isEmpty():
        known = suspects.select("home", "member", "sha").join(classes, "sha")
    else:  # two texts of one digest: only their bytes tell them apart
        known = suspects.select("home", "member", "sha", "body").join(by_text, ["sha", "body"])
    alone = members.where("NOT suspect AND n > 1").select("home", "member", top.alias("top"), F.col("n").alias("size"))
    return known.where("size > 1").select("home", "member", "top", "size").unionByName(alone)
