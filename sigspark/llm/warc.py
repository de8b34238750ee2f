"""Deterministic, sharded WARC archives.

Records are dealt to shards by ranges of (page_id, digest) of equal bytes and sorted within; each shard rolls to a new
file when the compressed size of the current one passes a limit. Headers, digests and record ids are made from the page
alone, and each record is a gzip member of its own without a time, so the same pages give the same bytes in any run.
A task writes under temporary names and renames when a file is complete: a task that runs again writes the same files.
A manifest of all files is written last; readers open only what it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.tables import drop, in_batches, store
from sigspark.operators.scale import ROWS_PER_CELL, shared_dir, small_side

#: Compressed bytes after which a file ends, pages of a shard, least payload that a revisit may stand for.
ROLL_BYTES, SHARD_BYTES, LEAST_REVISIT = 64 << 20, 256 << 20, 1000
#: Ids of one digest up to which its pages are joined by a shuffle.
HOT_IDS = 100_000
_SPACE = uuid.UUID("8c9f1d52-7d0b-5d1c-9a52-0c6f7e2a41b3")
_DATE = "1970-01-01T00:00:00Z"
_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, length: int, refers_to=None) -> bytes:
    """One WARC record, compressed. ``refers_to``: ``(page_id, url)`` of the response that a revisit stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers_to[0], digest)}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
        if refers_to[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {quote(refers_to[1], safe=_SAFE)}")
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def _source(pages: DataFrame) -> DataFrame:
    """Pages as their records need them, with the payload's length and digest."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})


def _revisits(keys: DataFrame) -> DataFrame:
    """``page_id, digest, to_page, to_url`` of the pages that repeat a response, from ids and digests alone.

    A digest of more than HOT_IDS ids is joined by broadcast, as there are few of them, so that no task gets all its pages.
    """
    large = keys.where(F.col("length") >= LEAST_REVISIT)
    top = F.max(F.struct("page_id", "url"))
    repeated = large.groupBy("digest").agg(
        top.getField("page_id").alias("to_page"), top.getField("url").alias("to_url"),
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ids"),
    ).where("rows > 1 AND to_page IS NOT NULL").select("digest", "to_page", "to_url", "ids")
    hot = small_side(repeated.where(F.col("ids") > HOT_IDS))
    other = large.join(hot.select("digest"), "digest", "left_anti").join(repeated.where(F.col("ids") <= HOT_IDS), "digest")
    found = large.join(hot, "digest").select(other.columns).union(other)
    return found.where(~F.col("page_id").eqNullSafe(F.col("to_page"))).select("page_id", "digest", "to_page", "to_url")


def _place(page_id: int | None, digest: str) -> tuple:
    """Key that sorts as Spark sorts ``page_id, digest``."""
    return page_id is not None, page_id or 0, digest


def _bounds(keys: DataFrame, shard_bytes: int) -> list[tuple]:
    """First key of each shard: shards hold ``shard_bytes`` of payload in order of (page_id, digest), one key more at most.

    The bytes before a key are summed exactly, so the bounds depend on the pages alone. One row per shard is collected.
    """
    parts = max(1, -(-keys.count() // ROWS_PER_CELL))
    ranged, path = store(keys.select("page_id", "digest", "bytes").repartitionByRange(parts, "page_id", "digest")
                         .withColumn("cell", F.spark_partition_id()))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    before = ranged.groupBy("cell").agg(F.sum("bytes").alias("bytes")).select(
        "cell", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cell").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(before), "cell")
    firsts = placed.groupBy(F.expr(f"(before + inside) div {int(shard_bytes)}").alias("shard")).agg(
        F.min(F.struct("page_id", "digest")).alias("first"))
    found = sorted(_place(*r["first"]) for r in firsts.select("first").collect())
    drop(keys.sparkSession, path)
    return found


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as ``folder/*.warc.gz``; return the manifest, also written there.

    Of records with equal payloads of at least LEAST_REVISIT bytes, that with the largest page_id is the response, the
    others are revisits; smaller ones are all responses. A null html is the empty payload. Rows that repeat a page_id
    with the largest one's payload are all responses; a row without a page_id is a revisit if another row with a
    page_id has its payload. No pages give an empty manifest. Other columns are not read.

    What is a revisit and where shards begin is found from ids, lengths and digests; payloads are shuffled once, to the
    task of their shard. Files are sorted by (page_id, digest, url) within and by their names, rows without an id first.
    Rows equal in page_id and payload stay in one shard, which its task writes as a stream.
    """
    spark = pages.sparkSession
    source = _source(pages)
    keys, keys_path = store(source.groupBy("page_id", "digest").agg(
        F.max("url").alias("url"), F.max("length").alias("length"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("length") + 500).alias("bytes")))
    found = _bounds(keys, shard_bytes)
    bounds = spark.sparkContext.broadcast(found)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, digests: pa.Array) -> pa.Array:
        firsts = bounds.value
        return pa.array([bisect_right(firsts, _place(*x)) - 1 for x in zip(ids.to_pylist(), digests.to_pylist())], pa.int32())

    # a decision stands before the pages that it is about
    both = _revisits(keys).withColumn("page", F.lit(0)).unionByName(source.withColumn("page", F.lit(1)), allowMissingColumns=True)
    dealt = both.withColumn("shard", shard_of("page_id", "digest")).repartitionById(max(1, len(found)), "shard")
    dealt = dealt.sortWithinPartitions("shard", "page_id", "digest", "page", "url")
    temporary_folder = f"_unfinished-{uuid.uuid4().hex}"

    def write(batches):
        disk, base = pafs.FileSystem.from_uri(folder)
        disk.create_dir(f"{base}/{temporary_folder}", recursive=True)
        shard, seq, out, done, decided = None, 0, None, [], None

        def finish():
            stream, temporary, name, digest, count, size = out
            stream.close()
            # of a task that ran before: the same bytes
            if disk.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
                disk.delete_file(f"{base}/{name}")
            disk.move(temporary, f"{base}/{name}")
            done.append((name, count, size, digest.hexdigest()))

        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "digest", "length", "page", "to_page", "to_url")]
            for row in zip(*cols):
                at, page_id, url, payload, digest, length, page, to_page, to_url = (x.as_py() for x in row)
                if not page:
                    decided = (page_id, digest), (to_page, to_url)
                    continue
                refers_to = decided[1] if decided and decided[0] == (page_id, digest) else None
                if out is not None and (at != shard or out[5] >= roll_bytes):
                    finish()
                    out = None
                if at != shard:
                    shard, seq = at, 0
                if out is None:
                    name = f"shard-{shard:06d}-{seq:04d}.warc.gz"
                    temporary = f"{base}/{temporary_folder}/{name}.{uuid.uuid4().hex}"
                    out = [disk.open_output_stream(temporary, compression=None), temporary, name, hashlib.sha1(), 0, 0]
                    seq += 1
                data = record(page_id, url, payload, digest, length, refers_to)
                out[0].write(data)
                out[3].update(data)
                out[4] += 1
                out[5] += len(data)
        if out is not None:
            finish()
        if done:
            name, count, size, digest = zip(*done)
            yield {"file": list(name), "records": list(count), "bytes": list(size), "sha1": list(digest)}

    manifest = in_batches(dealt, write, "file string, records long, bytes long, sha1 string")
    manifest.write.parquet(f"{folder}/manifest")
    # what lost tasks left behind
    drop(spark, f"{folder}/{temporary_folder}")
    drop(spark, keys_path)
    return spark.read.parquet(f"{folder}/manifest")


def _records(stream):
    """``(headers, block)`` of each record of a compressed archive, one gzip member after the other."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            data = rest or stream.read(1 << 20)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(member.decompress(data))
        rest = member.unused_data
        whole = b"".join(parts)
        head, _, block = whole.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, block[: int(headers["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest lists, digests of responses computed from their bytes.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``. A block that does not agree with
    its digest raises an error.
    """
    shard = F.regexp_extract("file", r"^shard-(\d+)-", 1).cast("int")
    files = spark.read.parquet(f"{folder}/manifest").select("file", shard.alias("shard"))
    files = files.repartitionById((files.agg(F.max("shard")).first()[0] or 0) + 1, "shard")

    def read(batches):
        disk, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                                        "refers_to", "payload")}
                held = 0
                with disk.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        length, payload = int(headers["X-Payload-Length"]), None
                        if headers["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
                                raise ValueError(f"{name}: {headers['WARC-Record-ID']} does not agree with its digest")
                        page, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        for k, v in zip(out, (page and int(page), headers.get("WARC-Target-URI"), length, digest,
                                              headers["WARC-Type"], to and int(to), payload)):
                            out[k].append(v)
                        held += len(payload or b"") + 200
                        if held > 8 << 20:
                            yield out
                            out, held = {k: [] for k in out}, 0
                yield out

    return in_batches(files, read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                   "record_type string, refers_to long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
