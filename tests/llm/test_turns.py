import hashlib
import random
import re

import pytest

from sigspark.llm import turns


def least(initials, faults):
    """Cheapest, ASCII-least edits by keeping the best of each state, row after row."""
    step, then = turns._STEP, turns._NEXT
    best = {0: (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (cost, path) in list(out.items()):
                found = (cost + 5, path + "I")
                if then[q] not in out or found < out[then[q]]:
                    out[then[q]] = found
        return out

    for c, f in zip(initials, faults):
        after = {}
        for q, (cost, path) in inserted(best).items():
            moves = [(q, cost + 2, "D")]
            if f not in "bd":
                more = 5 if f == "t" else 0
                moves.append((then[q], cost + 1 + more, "R"))
                if (q, c) in step:
                    moves.append((step[q, c], cost + more, "K"))
            for to, price, letter in moves:
                after[to] = min(after.get(to, (1 << 30, "")), (price, path + letter))
        best = after
    done = inserted(best)
    return min(done[q] for q in (0, 3) if q in done)


def rows_of(rng, n):
    return "".join(rng.choices("suuuaaax", k=n)), "".join(rng.choices("-----bdt", k=n))


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(200):
        initials, faults = rows_of(rng, rng.randrange(12))
        edits, q, cost = turns.repair(initials, faults)
        assert (cost, edits) == least(initials, faults) and q in (0, 3)


def test_stretches_agree_with_one_search(monkeypatch):
    rng = random.Random(1)
    for stretch in (1, 3, 64):
        monkeypatch.setattr(turns, "STRETCH", stretch)
        for n in (40, 200):
            initials, faults = rows_of(rng, n)
            edits, _, cost = turns.repair(initials, faults)
            assert (cost, edits) == least(initials, faults)


def test_long_runs_without_alternation_end():
    for initials, faults in (("u" * 5000, "-" * 5000), ("x" * 3000, "t" * 3000), ("s" * 2000, "-" * 2000), ("a" * 500, "b" * 500)):
        edits, _, cost = turns.repair(initials, faults)
        assert (cost, edits) == least(initials, faults)


def brute(rows):
    """The whole contract for one conversation's rows after damage, in order."""
    seen, faults = set(), ""
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-"
        seen.add((role, text))
        faults += fault
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for _, r, _ in rows)
    cost, edits = least(initials, faults)
    q, i, lines = 0, 0, []
    for e in edits:
        name = ["user", "user", "assistant", "user"][q]
        if e == "I":
            lines.append(name + ":")
            q = turns._NEXT[q]
            continue
        _, role, text = rows[i]
        if e == "K":
            lines.append(f"{role}:{text}")
            q = turns._STEP[q, initials[i]]
        elif e == "R":
            lines.append(f"{name}:{text}")
            q = turns._NEXT[q]
        i += 1
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(c) for c in "bdt"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    assert len(got) == df.count()
    return got


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (1, 1, "assistant", "Hi!"), (1, 5, "tool", "x" * 100_000),
    (2, None, None, None), (2, None, "user", "Eh?"), (2, 3, "", "Fine."), (None, 0, "user", "No id."), (None, None, "assistant", "Yes. \t\n"),
    (None, 2, "assistant", "open"), (3, 0, "system", "Be kind."), (4, 7, None, " \n "), (5, 1, "user", "a!"), (5, 2, "user", "a!"),
    (6, None, None, None), (7, 9, "Assistant", "Upper."), (-8, 1, "system", "S."), (-8, 2, "user", "u."), (-8, 3, "assistant", "ünïcode 🙂."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "turn AS idx", "role AS conv", "conv_id AS block", "text AS digest", "1 AS n")
    want = {c: brute(in_order(rows)) for c, rows in grouped(ODD).items()}
    assert found(turns.repaired(df)) == want
    nothing = df.limit(0)
    assert turns.repaired(nothing).count() == 0 and turns.repaired(nothing, turns.damaged(nothing)).count() == 0


def test_damage(spark):
    rng = random.Random(4)
    rows = ODD + [(rng.randrange(40), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system"]),
                   rng.choice(["Yes. No!", "open", "", "Twice? Thrice."])) for _ in range(400)]
    import zlib

    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            kept += [row] * (2 if k == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {c: brute(in_order(own)) for c, own in grouped(kept).items()}
    empty = hashlib.sha256(b"").hexdigest()
    want |= {c: (0, 0, 0, 0, 0, 0, "", empty) for c, *_ in rows if c not in want}
    assert found(turns.repaired(df, turns.damaged(df))) == want


def test_blocks_of_one_conversation(spark):
    """A conversation that holds most rows is cut into blocks: the same edits as one search over all of it."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice([f"Text {i}.", "Same.", "open " + str(i), ""])) for i in range(700)]
    rows += [(2, i, ["user", "assistant"][i % 2], f"T{i}.") for i in range(30)] + [(None, i, "user", f"N{i}.") for i in range(45)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {c: brute(in_order(own)) for c, own in grouped(rows).items()}
    assert found(turns.repaired(df, block=20)) == want
    assert found(turns.repaired(df)) == want
