import collections
import gzip
import hashlib
import math
import pickle
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm import embeddings, jaccard, queries, recurrent, toxicity, warc, words

SMALL = "/root/testdata/sf0.001"


# --- toxicity ---


def labelled(spark, rows=600):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(rows):
        own = rng.choices(vocabulary, k=rng.choice([5, 40, 200]))
        toxic = int(i % 8 == 0)
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["Nasty!", "VILE", "awful,"])
        docs.append((i, " ".join(own)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_tell_held_out_labels_apart(spark, odd_documents, no_documents):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in got if i % 5 == 0 and got[i]["predicted"] != int(i % 8 == 0)]
    assert not wrong and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[8]["evidence"][0]["label"] == 1
    odd = toxicity.score(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(r["score"] < 0.5 for r in odd)
    assert toxicity.score(no_documents, model).count() == 0
    empty = toxicity.learn(no_documents, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(odd_documents, empty).collect()} == {0.0}
    only = toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(odd_documents, only).collect()} == {0.0}
    nothing = labels.select(F.col("doc_id"), F.lit(None).cast("int").alias("toxic"))
    assert toxicity.learn(docs, nothing, F.lit(True)).ids == []


@pytest.mark.parametrize("times", [1, 10])
def test_rare_words_of_few_rows_count(spark, times):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(70 * times):
        own = rng.choices([f"w{j}" for j in range(300)], k=60)
        toxic = int(i % 7 == 0)
        own += ["scum", "moron", "loser"][i // 7 % 3 :][:2] if toxic else []
        docs.append((i, " ".join(own)))
        labels.append((i, toxic))
    docs.append((-1, "w1 w2 w3"))
    docs, labels = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (labels, "doc_id long, toxic int")))
    train = F.col("doc_id") % 5 != 0
    model = toxicity.learn(docs, labels, train)
    texts = docs.join(labels, "doc_id").where(train).collect()
    assert set(model.vocabulary.tolist()) == {words.hash_of(w) for r in texts for w in r["text"].split()}
    assert (model.factor > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [i for i in got if i >= 0 and i % 5 == 0 and got[i]["predicted"] != int(i % 7 == 0)] == []
    assert got[-1]["evidence"] and not got[-1]["predicted"]


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(700):
        t = np.sort(rng.choice(50, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.linalg.norm(w)))
    model = toxicity.Model(np.arange(50, dtype=np.uint64), np.ones(50), list(range(700)), np.zeros(700), np.ones(700), rows, 0.1)
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(model.rows):
        dense[i, t] = w
    for _ in range(60):
        t = np.sort(rng.choice(50, 6, replace=False))
        w = rng.random(6)
        w /= np.linalg.norm(w)
        found, cosines = model.nearest(t, w)
        all_ = dense[:, t] @ w
        want = np.lexsort((np.arange(700), -np.round(all_, 12)))[: toxicity.NEIGHBOURS]
        assert list(found) == list(want) and np.allclose(cosines, all_[want])


@pytest.mark.parametrize("short, lists", [(8, 2), (64, 8), (256, 8)])
def test_neighbours_are_exact_with_long_lists_and_ties(monkeypatch, short, lists):
    monkeypatch.setattr(toxicity, "_SHORT", short)
    monkeypatch.setattr(toxicity, "_LISTS", lists)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        t = np.unique((400 * rng.random(rng.integers(1, 60)) ** 3).astype(np.int64))
        w = (rng.random(len(t)) + 0.1) * (t + 2)
        rows.append((t, w / np.linalg.norm(w)))
    # copies tie, a group of them far above the number of neighbours
    rows += [rows[5]] * 40 + [rows[6]] * 5
    n = len(rows)
    model = pickle.loads(pickle.dumps(toxicity.Model(
        np.arange(400, dtype=np.uint64), np.ones(400), list(range(n)), np.zeros(n), np.ones(n), rows, 0.1)))
    assert 4 * np.diff(model.post_first).max() > n
    dense = np.zeros((n, 400))
    for i, (t, w) in enumerate(model.rows):
        dense[i, t] = w
    queries = rows[:40] + rows[-45:-38] + [(np.zeros(0, np.int64), np.zeros(0)), (np.array([399]), np.ones(1))]
    for t, w in queries:
        found, cosines = model.nearest(t, w)
        all_ = dense[:, t] @ w
        want = [i for i in np.lexsort((np.arange(n), -np.round(all_, 12)))[: toxicity.NEIGHBOURS] if all_[i] > 1e-12]
        assert list(found) == want and np.allclose(cosines, all_[want])


# --- WARC ---


def pages(spark):
    same, small = "<p>" + "x" * 2000 + "</p>", "<p>tiny</p>"
    rows = [(i, f"http://a.example/{i}", same if i % 3 == 0 else small if i % 3 == 1 else f"<p>{'é' * 600}{i}</p>") for i in range(90)]
    rows += [(87, "http://a.example/87", same), (None, "http://n/", same), (None, None, None), (200, "bad url\r\nX: y", ""), (201, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_hold_every_page(spark, tmp_path):
    df, rows = pages(spark)
    folder = f"file://{tmp_path}/one"
    warc.write_archives(df, folder, roll_bytes=600, shard_bytes=9000)
    got = warc.read_archives(spark, folder).collect()
    want = []
    for page_id, _, body in rows:
        body = (body or "").encode()
        group = [p for p, _, b in rows if p is not None and (b or "").encode() == body]
        to = max(group) if len(body) >= 1000 and group and max(group) != page_id else None
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(str, want)) == sorted(
        str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    names = sorted(p.name for p in (tmp_path / "one").iterdir() if p.name.endswith(".gz"))
    assert len(names) > 5 and not any(n.startswith(".") for n in names)
    assert gzip.open(tmp_path / "one" / names[0]).read().startswith(b"WARC/1.1\r\n")
    again = f"file://{tmp_path}/two"
    warc.write_archives(df.repartition(7), again, roll_bytes=600, shard_bytes=9000)
    assert {n: (tmp_path / "two" / n).read_bytes() for n in names} == {n: (tmp_path / "one" / n).read_bytes() for n in names}


def ids_by_file(folder):
    out = []
    for path in sorted(p for p in folder.iterdir() if p.name.endswith(".gz")):
        with open(path, "rb") as f:
            out.append([int(h["X-Page-Id"]) for h, _ in warc._records(f)])
    return out


def test_files_are_sorted_and_even_beside_an_outlier(spark, tmp_path):
    rows = [(i * 3 % 1000, f"http://a.example/{i}", f"<p>{i}</p>" + "x" * 400) for i in range(1000)] + [(10**15, "http://far/", "far")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    warc.write_archives(df, f"file://{tmp_path}/far", roll_bytes=1 << 20, shard_bytes=90_000)
    found = ids_by_file(tmp_path / "far")
    assert [i for ids in found for i in ids] == sorted(r[0] for r in rows)
    assert len(found) == 11 and max(map(len, found)) <= 2 * len(found[0])
    assert not [p for p in (tmp_path / "far").iterdir() if p.name.startswith("_unfinished")]


def test_a_common_page_is_joined_by_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_IDS", 10)
    same, other = "s" * 1500, "o" * 1500
    rows = [(i, None, same if i % 3 else other if i % 2 else f"{i}" * 900) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/hot", shard_bytes=20_000)
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, f"file://{tmp_path}/hot").collect()}
    last = {body: i for i, _, body in rows}
    assert got == {i: last[body] if last[body] != i and len(body) >= 1000 else None for i, _, body in rows}


def test_no_pages(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


# --- embeddings ---


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, *(base[:20] + 0.05 * rng.standard_normal((20, 32)) for _ in range(5)), base[:3] * 2,
                        np.repeat(base[40:41], 60, 0) + 0.03 * rng.standard_normal((60, 32)), np.repeat(base[50:51], 9, 0)])
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    rows += [(1001, None), (1003, []), (1005, [0.0] * 32), (1007, [float("nan")] * 32), (1009, [None] * 32),
             (1011, [float("inf")] + [1.0] * 31), (1013, [1.0, 2.0]), (None, x[0].tolist()), (rows[7][0], rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS v", "1 AS class")
    got = embeddings.near_duplicates(df).collect()
    by_id = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    root = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    links = sum(by_id[i * 2]["n_links"] for i in range(len(x)))
    assert 0.97 * (near.sum() - len(x)) <= links <= near.sum() - len(x)
    assert all(by_id[i * 2]["component_id"] == 2 * root[i] for i in range(len(x)))
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["component_id"] == i and by_id[i]["kept"] for i in range(1001, 1015, 2))
    assert (by_id[None]["n_links"], by_id[None]["component_id"], by_id[None]["kept"]) == (0, None, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- language model ---


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in recurrent.initial(np.arange(200, 70, -1), 50).items()}
    inputs, targets = rng.integers(0, 131, (2, 5, 3))
    fresh = rng.random((5, 3)) < 0.3
    h = np.zeros((3, recurrent.UNITS))
    _, gradient, _ = recurrent.train_window(p, inputs, targets, fresh, h)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            at = (inputs[1, 1], *at[1:]) if name == "vectors" else at
            keep, e = p[name][at], 1e-5
            p[name][at] = keep + e
            up = recurrent.train_window(p, inputs, targets, fresh, h)[0]
            p[name][at] = keep - e
            down = recurrent.train_window(p, inputs, targets, fresh, h)[0]
            p[name][at] = keep
            assert abs((up - down) / 2 / e - gradient[name][at]) < 1e-7


def test_probabilities_sum_to_one_and_lanes_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    p = recurrent.initial(np.arange(200, 70, -1), 50)
    h = rng.standard_normal((1, recurrent.UNITS)).astype(np.float32)
    logs, _ = recurrent.log_probabilities(p, np.repeat(h, 131, 0), np.arange(131))
    assert abs(np.exp(logs).sum() - 1) < 1e-5
    lengths = [1, 1, 70, 3, 500, 2, 40, 1]
    tokens, at = rng.integers(0, 131, sum(lengths)), np.cumsum([0, *lengths])
    whole = recurrent.text_scores(p, tokens, at, 3)
    monkeypatch.setattr(recurrent, "LANES", 2)
    assert np.allclose(whole, recurrent.text_scores(p, tokens, at, 3), rtol=1e-5)
    for i in (0, 4):
        assert np.isclose(whole[i], recurrent.text_scores(p, tokens[at[i] : at[i + 1]], np.array([0, lengths[i]]), 3)[0], rtol=1e-5)
    one, state, total = p["vectors"] @ p["into"] + p["gates"], np.zeros((1, recurrent.UNITS), np.float32), 0.0
    for before, word in zip([3, *tokens[at[6] : at[7] - 1]], tokens[at[6] : at[7]]):
        state, _ = recurrent.step(p, one[[before]], state)
        total += recurrent.log_probabilities(p, state, np.array([word]))[0][0]
    assert np.isclose(whole[6], total, rtol=1e-5)


def test_words_of_all_classes_share_one_softmax(monkeypatch):
    rng = np.random.default_rng(6)
    p = recurrent.initial(np.arange(2000, 70, -1), 50)
    words, n = len(p["vectors"]) - 1, 700
    targets = rng.integers(0, words + 1, n)
    h = rng.standard_normal((n, recurrent.UNITS)).astype(np.float32)
    plain = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    want = []
    for state, t in zip(h, targets):
        c = t // recurrent.CLASS if t < words else len(p["word"])
        want.append(plain(state @ p["class"] + p["class_bias"])[c])
        if t < words:
            want[-1] += plain(state @ p["word"][c] + p["word_bias"][c])[t % recurrent.CLASS]
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    for gradient in (None, {k: np.zeros_like(v) for k, v in p.items()}):
        logs, _ = recurrent.log_probabilities(p, h, targets.copy(), gradient)
        assert np.allclose(logs, want, rtol=1e-5)
    assert len(calls) <= 6


def test_states_lie_in_columns_and_a_softmax_takes_one_exp(monkeypatch):
    rng = np.random.default_rng(8)
    p = recurrent.initial(np.arange(2000, 70, -1), 50)
    h = rng.standard_normal((300, recurrent.UNITS)).astype(np.float32)
    given = recurrent._product(h, p["into"])
    assert np.allclose(given, h @ p["into"], atol=1e-6) and given.flags.f_contiguous
    new, _ = recurrent.step(p, given, np.asfortranarray(h))
    assert new.flags.f_contiguous and np.allclose(new, recurrent.step(p, h @ p["into"], h)[0], atol=1e-6)
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    for gradient in (None, {k: np.zeros_like(v) for k, v in p.items()}):
        calls.clear()
        recurrent.log_probabilities(p, h, rng.integers(0, len(p["vectors"]), 300), gradient)
        assert len(calls) == 2  # of the classes and of the words


def test_training_reads_every_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} of the text{i % 7}") for i in range(900)] + [(None, None), (1, "other")],
                                 "doc_id long, text string")
    want = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    for share, rounds in ((0.5, 2), (0.7, 2), (1.0, 2), (1 / 3, 3), (1.0, 1)):
        parts = [p.select("doc_id", "text").collect() for p in recurrent.rounds_of(docs, share, rounds)]
        assert sorted({(r["doc_id"] or -1, r["text"]) for p in parts for r in p}) == want
        assert all(abs(len(p) - share * len(want)) < 90 for p in parts)
    # weights of many tasks, added up in groups; far more texts than a round needs at least
    counts = recurrent.count_words(docs)
    seen, added = [], recurrent._added
    monkeypatch.setattr(recurrent, "GROUP", 2)
    monkeypatch.setattr(recurrent, "_added", lambda parts: seen.append(added(parts)) or seen[-1])
    recurrent.learn(docs, counts, round_tokens=10, task_tokens=300)
    assert sum(n for _, n in seen) == counts.tokens


def test_trainer_holds_a_chunk(monkeypatch):
    monkeypatch.setattr(recurrent, "CHUNK", 500)
    before = recurrent.initial(np.arange(200, 70, -1), 50)
    trainer = recurrent.Trainer(before, 3)
    texts = [np.full(n, 5) for n in (1, 400, 30, 90, 2000, 7, 1)]
    held = []
    for x in texts:
        trainer.add(x)
        held.append(trainer.held)
    assert max(held) < 500
    trainer.flush()
    assert trainer.tokens == sum(map(len, texts)) and not trainer.texts
    h = np.zeros((1, recurrent.UNITS), np.float32)
    new, old = (recurrent.log_probabilities(p, h, np.array([5]))[0][0] for p in (trainer.p, before))
    assert new > old


def test_copies_are_spread_over_rounds(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "'one text many times' AS text")
    parts = recurrent.rounds_of(docs, 0.5, 2)
    assert all(200 < p.count() < 400 and p.select("order").distinct().count() == p.count() for p in parts)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(12))
    found = recurrent.Lookup(keys)
    assert (found(keys) == np.arange(len(keys))).all() and (found(keys + np.uint64(1)) == -1).all()
    assert (recurrent.Lookup(keys[:0])(keys) == -1).all()


def test_base_scores_of_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    docs = odd_documents.select("doc_id", "text")
    train = F.coalesce(F.col("doc_id"), F.lit(-1)) != 9
    known = docs.where(train)
    counts = recurrent.count_words(known, shortlist=8, common=16)
    got = recurrent.score(odd_documents, counts, recurrent.learn(known, counts)).collect()
    seen, texts = collections.Counter(), []
    for r in docs.collect():
        own = (r["text"] or "").encode().lower().split() + ["end"]
        texts.append((r["doc_id"], own))
        if r["doc_id"] != 9:
            seen.update(own)
    n, v = sum(seen.values()), len(seen)
    want = sorted((d or -1, len(t), sum(w in seen for w in t), n,
                   round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t), 5)) for d, t in texts)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    empty = recurrent.count_words(no_documents)
    rows = recurrent.score(odd_documents, empty, recurrent.learn(no_documents, empty)).collect()
    assert len(rows) == len(texts) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert recurrent.score(no_documents, counts, recurrent.learn(known, counts)).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = queries.op10_recurrent_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# --- the pipeline ---


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 5, 80).collect()}
    items = [x for (x,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    plain = {i: " ".join((t or "").lower().split()) for i, t in texts.items()}
    leaked = {i for i, t in plain.items() if any(" ".join(x.lower().split()) in t for x in items)}
    want = {i for i, t in texts.items() if groups[i] == i and i not in leaked and any(c.isalpha() for c in t or "")}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "bpe"]


def test_near_duplicates_are_judged_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a + " end"), (3, a), (3, c), (4, " "), (4, " "), (4, None), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    want = [(1, a), (1, b), (3, c), (4, " "), (4, " "), (4, None), (None, a)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, want))


def test_no_known_language_drops_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12 !", None, "a", 4), (3, None, None, "a", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()] == [1]


def test_stages_take_odd_documents(spark, odd_documents, no_documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_documents.select(columns), no_documents.select(columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns
        found = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert "ids" in found.columns
        found.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    from tests import oracle

    assert oracle.compare(spark, oracle.connect(SMALL), name, SMALL) == ""


def test_word_hash_of_end_is_no_word():
    assert recurrent.END not in set(words.words(pa.array(["a b c"]))[0].tolist())
