import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import copies


@pytest.mark.parametrize("n, span", [(0, 100), (1, 1), (1, 1 << 40), (50, 50), (400, 1000), (3000, 1 << 45), (64, 1 << 60)])
def test_golomb_round_trip(n, span):
    rng = np.random.default_rng(n)
    base = 3 * span
    values = base + np.sort(rng.choice(span, n, replace=False) if span < 1 << 20 else np.unique(rng.integers(0, span, n)))
    code = copies.golomb_encode(values.astype(np.uint64), base, span)
    assert copies.golomb_decode(code, len(values), base).tolist() == values.tolist()
    if n >= 400:  # near the least possible: log2(span / n) + 1.5 bits each
        assert 8 * len(code) <= len(values) * (np.log2(span / n) + 2.5) + 64


def test_bits_mark_what_another_message_has():
    sets = [list(range(0, 300, 3)), [], [5, 6, 9, 500], list(range(300))]
    sent = [(len(s), copies.golomb_encode(np.array(s, np.uint64) + np.uint64(1000), 1000, 1000)) for s in sets]
    for own, words in zip(sets, copies.repeated_bits(sent, 1000)):
        others = [v for s in sets if s is not own for v in s]
        got = [bool(words[i // 64] >> np.int64(i % 64) & 1) for i in range(len(own))]
        assert got == [v in others for v in own]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        least = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in ids:
            out.append((i, least, len(ids), i == least and stays, sha))
            stays = stays and i != least
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_equals_brute_force_on_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found(copies.exact_duplicates(odd_documents.repartition(3))) == brute(rows)
    assert copies.exact_duplicates(no_documents).count() == 0


def _texts(spark):
    """Hot copies over all partitions, pairs within and across chunks, texts that differ in white space alone."""
    rows = []
    for i in range(3000):
        text = "hot  copy" if i % 3 == 0 else f"pair {i % 700}" if i % 3 == 1 else f"own\t{i}"
        rows.append((3000 - i, text + " \n" * (i % 2)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(13), rows


def test_many_chunks_and_owners(spark):
    docs, rows = _texts(spark)
    assert found(copies.exact_duplicates(docs, chunk_rows=40, owner_rows=100)) == brute(rows)


def test_bytes_decide_where_digests_collide(spark):
    docs, rows = _texts(spark)
    weak = F.substring(F.unhex(F.md5("body")), 1, 1)
    got = found(copies.exact_duplicates(docs, digest=weak, chunk_rows=100))
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in brute(rows))


def test_texts_stay_in_their_buckets(spark, tmp_path):
    """Only the bitmaps are dealt for the join, not the texts."""
    rows = spark.range(400).select(F.lit(1).alias("kind"), F.col("id").alias("home"), F.col("id").alias("member"),
                                   F.lit(0).alias("place"), F.lit(0).alias("slot"), F.lit(1).cast("long").alias("n"),
                                   F.col("id").alias("doc_id"), F.lit(True).alias("first"),
                                   F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"), F.lit(b"x").alias("body"))
    rows.write.partitionBy("kind").bucketBy(8, "home").option("path", str(tmp_path / "t")).format("parquet").saveAsTable("held_test")
    try:
        held = spark.table("held_test")
        bits = held.groupBy("home").agg(F.collect_list("place").alias("words"))
        joined = held.where("kind = 1").join(bits.hint("shuffle_hash"), "home")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
    finally:
        spark.sql("DROP TABLE held_test")
