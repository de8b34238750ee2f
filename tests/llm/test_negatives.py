import random

import numpy as np
import pytest

from sigspark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("scale", [1.0, 0.01, 500.0, 1e6, 1e200, 1e308])
def test_packed_scores_are_exact(scale):
    rng = np.random.default_rng(1)
    x, a = (scale * rng.uniform(-1, 1, (n, 9)) for n in (37, 5))
    if scale == 500.0:
        x[3], a[1, 2] = 0.0, 1e300  # one anchor beyond all others
    rows, anchors = ([[negatives.units(float(v)) for v in r] for r in m] for m in (x, a))
    kind = object if scale > 1e4 else np.int64
    packed = negatives.Packed(np.array(rows, kind), max(sum(map(abs, r)) for r in anchors))
    got = packed.scores(np.array(anchors, object if scale > 1e4 or scale == 500.0 else np.int64))
    assert [[int(v) for v in r] for r in got] == [[sum(p * q for p, q in zip(r, s)) for s in rows] for r in anchors]
    assert packed.exact == (scale < 500) and (not packed.exact or len(packed.shifts) >= 2)


def test_empty_vectors_and_blocks():
    assert negatives.Packed(np.zeros((3, 0), np.int64), 0).scores(np.zeros((2, 0), np.int64)).tolist() == [[0] * 3] * 2


def brute(rows, is_anchor, positives=5, negatives_=10, low=30, high=90):
    sound = [r for r in rows if all(v is not None for v in r) and all(v is not None and np.isfinite(v) for v in r[2])]
    once = list({(i, l, tuple(v)): (i, l, [negatives.units(x) for x in v]) for i, l, v in sound}.values())
    out = []
    for a in once:
        if not is_anchor(a[0]):
            continue
        scored = [(sum(p * q for p, q in zip(a[2], r[2])), r) for r in once if r is not a and len(r[2]) == len(a[2])]
        order = sorted(scored, key=lambda s: (-s[0], s[1][0]))
        for p, row in [s for s in order if s[1][1] == a[1]][:positives]:
            hard = [s for s in order if s[1][1] != a[1] and low * p <= 100 * s[0] <= high * p][:negatives_]
            out += [(a[0], row[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("wave_bytes", [1 << 20, 600])
def test_equals_brute_force(spark, wave_bytes):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.gauss(0.3, 0.5) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, i % 3, list(rows[7][2])) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, lambda i: i % 20 == 0)
    assert want and found(negatives.hard_negatives(df, "vec_id % 20 = 0", wave_bytes=wave_bytes)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 1.0]
    rows = [(0, 1, v), (0, 1, v), (1, 1, [0.6, -0.2, 0.9]), (2, 2, [0.3, -0.1, 0.4]), (2, 2, [0.3, -0.1, 0.4]), (3, 2, None),
            (4, None, v), (None, 1, v), (5, 2, [nan, 0.0, 0.0]), (6, 2, [inf, 0.0, 0.0]), (7, 2, [None, 0.1, 0.1]), (8, 2, []),
            (9, 2, [0.4, 0.4]), (10, 1, [0.0, 0.0, 0.0]), (11, 2, [0.0, 0.0, 0.0]), (20, 3, [0.1, 0.2]), (40, 3, []), (41, 3, []),
            (60, 5, [-1e300, 1e300, 7.0]), (61, 5, [-1e300, 1e300, 7.0]), (62, 6, [-6e299, 6e299, 1.0]), (63, 6, [1e300, 1e300, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS id", "label AS anchor", "embedding AS v", "1 AS score", "2 AS mark")
    longest = (1 << 63) - 1
    want = sorted((*r[:4], *[max(-longest - 1, min(longest, s)) for s in r[4:]]) for r in brute(rows, lambda i: i % 20 == 0))
    got = found(negatives.hard_negatives(df, "vec_id % 20 = 0"))
    assert got == want and {r[0] for r in got} >= {0, 40, 60}
    assert found(negatives.hard_negatives(df.limit(0), "vec_id % 20 = 0")) == []
    assert found(negatives.hard_negatives(df, "vec_id = 7777")) == []
