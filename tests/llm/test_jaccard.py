import random
import re
from collections import defaultdict

import pytest

from sigspark.llm import jaccard


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=25))
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 30, 120, 400]))
        for k in range(rng.choice([1, 1, 3, 8])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 40, len(words) // 12])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(own) + (" " + shared if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("size,percent,tile", [(3, 90, 512), (5, 80, 4)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = texts(size)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size, percent)


def test_only_sets_that_may_reach_the_threshold_meet(spark):
    rng = random.Random(8)
    rows = [(k, n, rng.sample(range(60), min(20, n // 5 + 1))) for k, n in enumerate(rng.choices(range(3, 300), k=150))]
    got = {(r["h"], r["key"]): (r["n"], r["pos"], r["met"]) for r in
           jaccard._meetings(spark.createDataFrame(rows, "key long, n long, prefix array<long>"), 80).collect()}
    places, met, pairs = defaultdict(list), defaultdict(int), 0
    for k, n, prefix in rows:
        for pos, h in enumerate(prefix):
            places[h].append((k, n, pos))
    for h, k in got:
        met[h] += 1
    for h, members in places.items():
        for a, n, i in members:
            for b, m, j in members:
                if a < b and 100 * min(n, m) >= 80 * max(n, m) and 180 * (i + j) <= 20 * (n + m):
                    assert got[h, a][:2] == (n, i) and got[h, b][:2] == (m, j)
                    pairs += 1
    assert pairs > 500 and all(m == met[h] > 1 for (h, _), (_, _, m) in got.items())
    # of sets that share a shingle by chance those of no near size, or with too many others before it, are left out
    alone = spark.createDataFrame([(1, 10, [7]), (2, 100, [7]), (3, 100, [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 9_9]),
                                   (4, 101, [*range(200, 212), 9_9])], "key long, n long, prefix array<long>")
    assert jaccard._meetings(alone, 80).count() == 0


def test_odd_rows(odd_documents, no_documents):
    got = sorted(map(tuple, jaccard.jaccard_components(odd_documents, 3, 90).collect()), key=str)
    assert len(got) == odd_documents.count()
    ids = defaultdict(set)
    for doc_id, n, component in got:
        ids[doc_id].add((n, component))
    assert ids[1] == {(10, 1), (5, 1)} and ids[2] == {(10, 1)} and ids[9] == {(11, 1)}
    assert ids[3] == {(0, 3)} and ids[4] == {(0, 4)} and ids[5] == {(0, 5)}
    assert {c for _, c in ids[6] | ids[7]} == {6}
    assert ids[None] == {(10, None), (0, None)}
    assert jaccard.jaccard_components(no_documents).count() == 0


def test_long_chain_is_one_component(spark):
    from sigspark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
