"""Cheapest repair of a conversation's turns by iterative-deepening A*.

A repaired conversation reads system?, then user and assistant in turn: ``(s?(ua)+)?`` by the roles' initials. The
search goes through a conversation's rows depth first, trying edits in ASCII order (Delete, Insert, Keep, Rerole),
under a bound on the cost that grows by the least excess of what it cut. States (row, place in the pattern) that failed
are remembered with the budget that did not suffice. The first path accepted is the cheapest, and of equal ones the
ASCII-least.

Where a conversation is longer than a stretch, the cost of what follows each stretch is worked out backwards first, so
a search never spans more than a stretch. Conversations longer than a block are spread over tasks: each block is
summarised as a table of costs from entry to exit state, tables are folded from the end, blocks searched on their own
for each entry state, and the entry states handed on.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import freeze, in_batches
from sigspark.operators.scale import with_position

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: Rows of a stretch and of a block.
STRETCH, BLOCK = 64, 4096
_FAR = 1 << 50
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_AWAITED, _NEXT, _ENDS = "uuau", (2, 2, 3, 2), (0, 3)
_NAMES = {"u": b"user", "a": b"assistant"}


def _rows(initials: str, faults: str):
    """Of each row: whether it must go, its initial, what a row left in place costs more."""
    return [(f in "bd", c, UNFINISHED if f == "t" else 0) for c, f in zip(initials, faults)]


def _ahead(rows, end) -> list[list[int]]:
    """Least cost from each row on, for each state. ``end``: the costs after the last row."""
    out = [end]
    for must_go, initial, more in reversed(rows):
        then = out[-1]
        here = []
        for q in range(4):
            best = then[q] + DELETE
            if not must_go:
                best = min(best, then[_NEXT[q]] + REROLE + more)
                if (kept := _STEP.get((q, initial))) is not None:
                    best = min(best, then[kept] + more)
            here.append(best)
        out.append([min(here[q], here[_NEXT[q]] + INSERT, here[_NEXT[_NEXT[q]]] + 2 * INSERT) for q in range(4)])
    return out[::-1]


#: Cost of completing the pattern by insertions.
_END = [0, 2 * INSERT, INSERT, 0]


def search(rows, q: int, after: list[int] | None) -> str:
    """The edits of one stretch from state ``q``; ``after``: cost by the state at its end, None where nothing follows."""
    n, failed, excess = len(rows), {}, _FAR
    least = [0 if after is None else min(after)]
    for must_go, initial, more in reversed(rows):
        least.append(least[-1] + (DELETE if must_go or more else 0 if initial in "sua" else REROLE))
    least.reverse()

    def cut(by: int) -> None:
        nonlocal excess
        excess = min(excess, by)

    def visit(i: int, q: int, budget: int) -> str | None:
        if i == n and (q in _ENDS if after is None else after[q] <= budget):
            return ""
        if i == n and after is not None:
            return cut(after[q] - budget)
        if least[i] > budget:
            return cut(least[i] - budget)
        if failed.get((i, q), -1) >= budget:
            return cut(failed[i, q] + 1 - budget)
        moves = [("I", INSERT, i, _NEXT[q])]
        if i < n:
            must_go, initial, more = rows[i]
            moves.insert(0, ("D", DELETE, i + 1, q))
            if not must_go:
                if (kept := _STEP.get((q, initial))) is not None:
                    moves.append(("K", more, i + 1, kept))
                moves.append(("R", REROLE + more, i + 1, _NEXT[q]))
        for letter, cost, j, to in moves:
            if cost > budget:
                cut(cost - budget)
            elif (rest := visit(j, to, budget - cost)) is not None:
                return letter + rest
        failed[i, q] = budget
        return None

    bound = least[0]
    while (path := visit(0, q, bound)) is None:
        bound, excess = bound + excess, _FAR
    return path


def follow(rows, q: int, edits: str) -> tuple[int, int]:
    """State and cost after the edits."""
    i = cost = 0
    for letter in edits:
        if letter == "I":
            q, cost = _NEXT[q], cost + INSERT
            continue
        _, initial, more = rows[i]
        i += 1
        if letter == "D":
            cost += DELETE
        else:
            q = _STEP[q, initial] if letter == "K" else _NEXT[q]
            cost += more + (REROLE if letter == "R" else 0)
    return q, cost


def repair(initials: str, faults: str, q: int = 0, after: list[int] | None = None) -> tuple[str, int, int]:
    """Edits, last state and cost of a run of rows from state ``q``."""
    rows, parts, total = _rows(initials, faults), [], 0
    ahead = _ahead(rows, _END if after is None else list(after)) if len(rows) > STRETCH else None
    for at in range(0, max(1, len(rows)), STRETCH):
        some, to = rows[at : at + STRETCH], at + STRETCH
        part = search(some, q, ahead[to] if to < len(rows) else None if after is None else list(after))
        q, cost = follow(some, q, part)
        parts.append(part)
        total += cost
    return "".join(parts), q, total


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text``: rows after damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    ``conv`` tells a null conv_id from all others. 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats
    it, 4 makes its role user.
    """
    conv_id, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv_id, F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(
        conv_key("conv_id").alias("conv"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("harm"),
    ).where("harm <> 0")
    harm = F.col("harm")
    return rows.select(
        "conv", "turn", F.when(harm == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, F.lit("")).when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def conv_key(column: str):
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit(""))


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The repair of every conversation of ``conversations`` (``conv_id, turn, role, text``), one row per conv_id.

    ``rows``: what there is to repair, as ``damaged`` gives it; the undamaged rows by default. Rows are in order of
    turn, nulls first; those of one turn by role, then by the SHA-256 of their text. A row's first fault counts: blank
    (nothing but white space), duplicate (role and text of an earlier row), truncated (last character other than white
    space not one of ``.!?``). Blank and duplicate rows must be deleted.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A null conv_id is a
    conversation. One without rows left has zeros, no edits and the digest of the empty text; an empty table gives an
    empty result. Other columns are not read. The edits of a conversation are one string, so it may have 2^31 rows at
    most; its digest is taken by one task that streams through its texts in order, since SHA-256 cannot be split.
    """
    if rows is None:
        rows = conversations.select(
            conv_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
            *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    last = r"[.!?][\x20\x09-\x0D]*\z"
    narrow = rows.select(
        "conv", "turn", "role", "digest", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("full"), F.col("text").rlike(last).alias("ended"))
    placed = freeze(with_position(narrow, ["conv"], ["turn", "role", "digest"]))
    first = placed.groupBy("conv", "role", "digest").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("times"))
    judged = placed.join(first.where("times > 1").drop("times"), ["conv", "role", "digest"], "left")
    fault = F.when(~F.col("full"), "b").when(F.col("first") < F.col("idx"), "d").when(~F.col("ended"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    judged = judged.select("conv", "turn", "idx", fault.alias("fault"),
                           F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
    judged = freeze(judged)
    kinds = {"blank": "b", "duplicate": "d", "truncated": "t"}
    counts = judged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.sum((F.col("fault") == v).cast("long")).alias(k) for k, v in kinds.items()])

    held = F.sort_array(F.collect_list(F.struct("idx", "initial", "fault")))
    blocks = judged.groupBy("conv", F.expr(f"idx DIV {block}").alias("block")).agg(held.alias("r"))
    blocks = freeze(blocks.select("conv", "block", *[F.array_join(f"r.{c}", "").alias(f"{c}s") for c in ("initial", "fault")]))
    pieces = freeze(_short(blocks).unionByName(_long(blocks)))
    inside = F.expr(
        "length(initials) - 1 - size(filter(sequence(1, length(initials)), i -> substring(initials, i, 2) IN ('su', 'ua', 'au')))")
    seams = blocks.select("conv", (F.col("block") + 1).alias("block"), F.substring("initials", -1, 1).alias("before"))
    pairs = blocks.join(seams, ["conv", "block"], "left").select("conv", inside.alias("inside"), F.coalesce(
        (~F.concat("before", F.substring("initials", 1, 1)).isin("su", "ua", "au")).cast("int"), F.lit(0)).alias("seam"))
    illegal = pairs.groupBy("conv").agg(F.sum(F.col("inside") + F.col("seam")).alias("illegal"))
    audits = pieces.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    audits = freeze(audits)
    found = counts.join(illegal, "conv").join(audits, "conv").join(_digests(rows, audits), "conv")
    every = conversations.select("conv_id").distinct().withColumn("conv", conv_key("conv_id"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _short(blocks: DataFrame) -> DataFrame:
    """Edits and cost of the conversations of one block."""
    more = blocks.where("block > 0").select("conv").distinct()

    def each(batches):
        for batch in batches:
            found = [repair(i, f) for i, f in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults")))]
            yield {"conv": batch.column("conv"), "block": batch.column("block"),
                   "audit": [a for a, _, _ in found], "cost": [c for _, _, c in found]}

    return in_batches(blocks.join(more, "conv", "left_anti"), each, "conv string, block long, audit string, cost long")


def _long(blocks: DataFrame) -> DataFrame:
    """Edits and cost of each block of the conversations of several blocks."""
    more = blocks.where("block > 0").groupBy("conv").agg(F.max("block").alias("last"))
    own = blocks.join(more, "conv")

    def tables(batches):
        for batch in batches:
            out = []
            for initials, faults, at, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "block", "last"))):
                rows = _rows(initials, faults)
                ends = [_END] if at == last else [[0 if q == to else _FAR for q in range(4)] for to in range(4)]
                out.append([cost for end in ends for cost in _ahead(rows, end)[0]])
            yield {"conv": batch.column("conv"), "block": batch.column("block"), "costs": out}

    def backwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ascending=False)
        out, after = [], None
        for costs in frame["costs"]:
            out.append(after)
            costs = [int(c) for c in costs]
            after = costs if after is None else [min(costs[4 * to + q] + after[to] for to in range(4)) for q in range(4)]
        return pd.DataFrame({"conv": frame["conv"].values, "block": frame["block"].values, "after": out})

    # a row for each block: at most 2^31 / BLOCK of a conversation
    costs = in_batches(own.select("conv", "block", "last", "initials", "faults"), tables, "conv string, block long, costs array<long>")
    after = costs.groupBy("conv").applyInPandas(backwards, "conv string, block long, after array<long>")

    def each(batches):
        for batch in batches:
            found = [[repair(i, f, q, after) for q in range(4 if at else 1)] for i, f, at, after in
                     zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "block", "after")))]
            yield {"conv": batch.column("conv"), "block": batch.column("block"), "audits": [[a for a, _, _ in x] for x in found],
                   "exits": [[q for _, q, _ in x] for x in found], "costs": [[c for _, _, c in x] for x in found]}

    def forwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        out, q = [], 0
        for exits in frame["exits"]:
            out.append(q)
            q = int(exits[q])
        return pd.DataFrame({"conv": frame["conv"].values, "block": frame["block"].values, "entry": out})

    found = freeze(in_batches(own.join(after, ["conv", "block"]).select("conv", "block", "initials", "faults", "after"), each,
                              "conv string, block long, audits array<string>, exits array<int>, costs array<long>"))
    entries = found.select("conv", "block", "exits").groupBy("conv").applyInPandas(forwards, "conv string, block long, entry int")
    return found.join(entries, ["conv", "block"]).select(
        "conv", "block", F.expr("audits[entry]").alias("audit"), F.expr("costs[entry]").alias("cost"))


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired rows, ``role:text``, joined by newlines.

    A conversation's edits come before its rows, in the order in which they were numbered.
    """
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", F.col("text").cast("binary").alias("body"))
    edits = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.col("audit").cast("binary").alias("body"))
    dealt = texts.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")

    def stream(batches):
        state = None
        for batch in batches:
            done = []
            for conv, kind, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "body"))):
                if kind == 0:
                    if state is not None:
                        done.append(state.finish())
                    state = _Stream(conv, body.decode())
                else:
                    state.row(role, body)
            yield {"conv": [c for c, _ in done], "repaired_sha256": [d for _, d in done]}
        if state is not None:
            name, digest = state.finish()
            yield {"conv": [name], "repaired_sha256": [digest]}

    return in_batches(dealt, stream, "conv string, repaired_sha256 string")


class _Stream:
    """Digest of one conversation under way."""

    def __init__(self, conv: str, edits: str):
        self.conv, self.edits, self.at, self.q, self.hash, self.lines = conv, edits, 0, 0, hashlib.sha256(), 0

    def _line(self, role: bytes, text: bytes, to: int) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1
        self.q = to

    def _inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._line(_NAMES[_AWAITED[self.q]], b"", _NEXT[self.q])
            self.at += 1

    def row(self, role: str, text: bytes) -> None:
        self._inserted()
        letter = self.edits[self.at]
        self.at += 1
        if letter == "K":
            self._line(role.encode(), text, _STEP[self.q, role[0]])
        elif letter == "R":
            self._line(_NAMES[_AWAITED[self.q]], text, _NEXT[self.q])

    def finish(self) -> tuple[str, str]:
        self._inserted()
        return self.conv, self.hash.hexdigest()
