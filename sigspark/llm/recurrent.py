"""Log-likelihood of whole documents by a gated recurrent language model.

Words are the shortlist's, the most frequent of the training texts in classes of 64, and all others, which share one
class. The model gives the class, then the word within its class; a word of the shared class then gets its share of
that class's training tokens, with one added to each count and one unseen word, so all words together have the
probability 1. The state runs through a document from its first word to its end, window after window.

Counts cover all training texts, and so does training: truncated backpropagation passes over each of them at least
once, in tasks whose number grows with the tokens. They start from equal weights, read their texts as a stream, and their
weights are averaged after each round, in groups of tasks first.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words as wd
from sigspark.llm.tables import freeze, in_batches, rows_of
from sigspark.llm.words import Lookup

#: Words of the shortlist, words of a class, units of the state and of a word's vector.
SHORTLIST, CLASS, UNITS = 4032, 64, 16
#: Rounds. Each takes half of the texts, so that each text is in one; more of them, up to all, below ROUND_TOKENS.
ROUNDS, ROUND_TOKENS = 2, 1_200_000
#: Tasks of a round at least, tokens of a task (about), tokens that a task lays out at once, weights added up by a task.
TRAINERS, TASK_TOKENS, CHUNK, GROUP = 6, 4_000_000, 200_000, 16
#: Steps that a gradient runs back; lanes of documents side by side; tokens that a task holds at once.
WINDOW, LANES, HELD = 16, 384, 1_000_000
#: Most frequent words whose counts go to every task: 16 bytes each. Rarer ones are joined.
COMMON = 1 << 18
#: Texts that a trainer reads side by side: more of them if it has many tokens, which takes half the time a token.
_STREAMS, _STREAM_TOKENS, _RATE = (48, 192), 1024, 0.01
#: Stands for the end of a text among the words' hashes.
END = 0x2545F4914F6CDD1D


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by END, and where each text begins."""
    hashes, at = wd.words(texts)
    out = np.insert(hashes, at[1:], np.uint64(END))
    return out, at + np.arange(len(at))


@dataclass
class Counts:
    """What all training texts gave: the full table stays on storage, its common end goes to tasks."""

    table: DataFrame
    tokens: int
    distinct: int
    common: np.ndarray
    counts: np.ndarray
    short: int
    rest_tokens: int
    rest_distinct: int


def count_words(train: DataFrame, shortlist: int = SHORTLIST, common: int = COMMON) -> Counts:
    """Counts of every word of all texts of ``train``, summed in each task before the shuffle."""

    def count(batches):
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for first, end in rows_of(batch, 4096):
                got = _tokens(batch.column("text").slice(first, end - first))[0]
                parts.append(got)
                held += len(got)
                if held > 2_000_000:
                    words, n = _summed(words, n, parts)
                    parts, held = [], 0
                    if len(words) > 2_000_000:
                        yield {"term": wd.signed(words), "n": n}
                        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words, n = _summed(words, n, parts)
        yield {"term": wd.signed(words), "n": n}

    source = train.select(F.col("text").cast("string").alias("text"))
    table = freeze(in_batches(source, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the cut that leaves at most ``common`` words comes from a histogram, so that tasks send no more than those
    level = F.floor(16 * F.log2(F.col("n").cast("double")))
    kept, cut = 0, None
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        kept += r["words"]
        if kept > common:
            break
        cut = r["level"]
    top = table.where(level >= cut if cut is not None else F.lit(False)).toPandas()
    top = top.sort_values(["n", "term"], ascending=[False, True])
    terms, n = top["term"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    short = min(shortlist, len(n))
    return Counts(table, total["n"], total["v"], terms, n, short, total["n"] - int(n[:short].sum()), total["v"] - short)


def _summed(words, n, parts):
    if not parts:
        return words, n
    new, m = np.unique(np.concatenate(parts), return_counts=True)
    both, back = np.unique(np.concatenate([words, new]), return_inverse=True)
    return both, np.bincount(back, np.concatenate([n, m])).astype(np.int64)


# --- the network -------------------------------------------------------------------------------------------------


def initial(counts: np.ndarray, rest: int) -> dict[str, np.ndarray]:
    """Small random weights; the biases give each class and word its share of the training tokens."""
    rng = np.random.default_rng(5)
    words = len(counts)
    classes = -(-words // CLASS)
    padded = np.zeros(classes * CLASS)
    padded[:words] = counts + 1.0
    padded = padded.reshape(classes, CLASS)
    share = np.append(padded.sum(axis=1), rest + 1.0)
    small = lambda *shape: rng.standard_normal(shape).astype(np.float32) * np.float32(0.1)
    with np.errstate(divide="ignore"):
        word_bias = np.maximum(np.log(padded / padded.sum(axis=1, keepdims=True)), -1e4) if classes else padded
    return {
        "vectors": small(words + 1, UNITS), "into": small(UNITS, 3 * UNITS), "gates": np.zeros(3 * UNITS, np.float32),
        "state": small(UNITS, 3 * UNITS), "class": small(UNITS, classes + 1),
        "class_bias": np.log(share / share.sum()).astype(np.float32), "word": small(classes, UNITS, CLASS),
        "word_bias": word_bias.astype(np.float32),
    }


def _sigmoid(x):
    x = np.negative(x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.divide(np.float32(1), x, out=x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` with its columns, not its rows, in one piece: what units, gates and shares do then runs along them."""
    return (b.T @ a.T).T


def _columns(rows: int, columns: int, kind) -> np.ndarray:
    return np.empty((columns, rows), kind).T


def step(p, given: np.ndarray, h: np.ndarray):
    """Next state from the gate inputs of a word and the state; and what the way back needs."""
    u = UNITS
    own = _product(h, p["state"])
    zr = _sigmoid(given[:, : 2 * u] + own[:, : 2 * u])
    z, r = zr[:, :u], zr[:, u:]
    n = r * own[:, 2 * u :]
    n += given[:, 2 * u :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (h, z, r, n, own[:, 2 * u :])


def _softmax(x: np.ndarray, at: np.ndarray, slopes: bool) -> np.ndarray:
    """Log of the share of column ``at[i]`` of each row ``i``. Leaves in ``x`` the shares less one there if ``slopes``."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    out = x[rows, at]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    out -= np.log(total)
    if slopes:
        x *= (1 / total)[:, None]
        x[rows, at] -= 1
    return out


def log_probabilities(p, h: np.ndarray, targets: np.ndarray, gradient: dict | None = None):
    """Natural log of each target's probability (words of the shared class: of the class), given the states ``h``.

    With ``gradient``, adds the gradient of the mean negative log to it and returns that for ``h`` too.
    """
    classes, n, slopes = len(p["word"]), len(targets), gradient is not None
    of = targets // CLASS
    of[targets >= len(p["vectors"]) - 1] = classes
    x = _product(h, p["class"])
    x += p["class_bias"]
    out = _softmax(x, of, slopes).astype(np.float64)
    back = None
    if slopes:
        x *= x.dtype.type(1 / n)
        gradient["class"] += h.T @ x
        gradient["class_bias"] += x.sum(axis=0)
        back = _product(x, p["class"].T)
    # rows in order of their class: those of a class are one product, and all of them one table of logits
    order = np.argsort(of.astype(np.uint8 if classes < 256 else of.dtype), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=classes + 1)[:classes])]).tolist()
    order = order[: ends[-1]]
    own = h.T.take(order, axis=1).T
    x = _columns(len(order), CLASS, np.result_type(h, p["word"]))
    present = [(c, ends[c], ends[c + 1]) for c in range(classes) if ends[c] < ends[c + 1]]
    for c, first, end in present:
        part = x[first:end]
        np.matmul(p["word"][c].T, own[first:end].T, out=part.T)
        part += p["word_bias"][c]
    out[order] += _softmax(x, targets[order] % CLASS, slopes)
    if slopes:
        x *= x.dtype.type(1 / n)
        d = _columns(len(order), UNITS, own.dtype)
        for c, first, end in present:
            part = x[first:end]
            gradient["word"][c] += own[first:end].T @ part
            gradient["word_bias"][c] += part.sum(axis=0)
            np.matmul(p["word"][c], part.T, out=d[first:end].T)
        for column, more in zip(back.T, d.T):
            column[order] += more
    return out, back


def train_window(p, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """Loss, gradient and last state of a window of ``inputs[t, stream]``; ``fresh`` marks words that begin a text."""
    steps, streams = inputs.shape
    u, n = UNITS, steps * streams
    gradient = {k: np.zeros_like(v) for k, v in p.items()}
    words = inputs.reshape(-1)
    vectors = p["vectors"][words]
    given = _product(vectors, p["into"])
    given += p["gates"]
    states, befores = (_columns(n, u, given.dtype) for _ in range(2))
    saved = []
    h = np.asfortranarray(h)
    for t in range(steps):
        now = slice(t * streams, (t + 1) * streams)
        h, kept = step(p, given[now], h * ~fresh[t][:, None])
        befores[now], states[now] = kept[0], h
        saved.append(kept)
    logs, back = log_probabilities(p, states, targets.reshape(-1).copy(), gradient)
    d_given, d_own = (_columns(n, 3 * u, given.dtype) for _ in range(2))
    d_h = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        now = slice(t * streams, (t + 1) * streams)
        before, z, r, new, own = saved[t]
        d = d_h + back[now]
        d_zr, d_n = d_given[now, : 2 * u], d_given[now, 2 * u :]
        np.multiply(d * (1 - z), 1 - new * new, out=d_n)
        np.multiply(d * (before - new), z * (1 - z), out=d_zr[:, :u])
        np.multiply(d_n * own, r * (1 - r), out=d_zr[:, u:])
        d_own[now, : 2 * u] = d_zr
        np.multiply(d_n, r, out=d_own[now, 2 * u :])
        d *= z
        d += _product(d_own[now], p["state"].T)
        d_h = d * ~fresh[t][:, None]
    gradient["state"] += befores.T @ d_own
    gradient["gates"] += d_given.sum(axis=0)
    gradient["into"] += vectors.T @ d_given
    for column, d in zip(gradient["vectors"].T, _product(d_given, p["into"].T).T):
        column += np.bincount(words, d, minlength=len(column))
    return -logs.mean(), gradient, h


class Trainer:
    """Weights on their way through texts given as word numbers; ``end`` is the number that closes each."""

    def __init__(self, p: dict[str, np.ndarray], end: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.end, self.turn, self.tokens = end, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}
        self.texts: list[np.ndarray] = []
        self.held = 0

    def add(self, text: np.ndarray) -> None:
        """Take a text; once about CHUNK tokens wait, train on them."""
        self.texts.append(text)
        self.held += len(text)
        if self.held >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        p, first, second = self.p, self.first, self.second
        whole = np.concatenate(self.texts)
        begins = np.zeros(len(whole), bool)
        begins[np.cumsum([0, *map(len, self.texts[:-1])])] = True
        self.tokens += len(whole)
        self.texts, self.held = [], 0
        streams = min(max(len(whole) // _STREAM_TOKENS, _STREAMS[0]), _STREAMS[1])
        length = -(-len(whole) // streams)
        whole, begins = np.resize(whole, length * streams), np.resize(begins, length * streams)
        before = np.where(begins, self.end, np.roll(whole, 1))
        targets, inputs, fresh = (x.reshape(streams, length).T for x in (whole, before, begins))
        fresh = fresh.copy()
        fresh[0] = True
        h = np.zeros((streams, UNITS), np.float32)
        for at in range(0, length, WINDOW):
            self.turn += 1
            _, gradient, h = train_window(p, inputs[at : at + WINDOW], targets[at : at + WINDOW], fresh[at : at + WINDOW], h)
            norm = math.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
            clip = min(1.0, 1.0 / max(norm, 1e-9))
            rate = _RATE * math.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
            for k, g in gradient.items():
                g *= np.float32(clip)
                x = g - first[k]
                x *= np.float32(0.1)
                first[k] += x
                g *= g
                g -= second[k]
                g *= np.float32(0.001)
                second[k] += g
                np.sqrt(second[k], out=x)
                x += np.float32(1e-8)
                np.multiply(first[k], np.float32(rate), out=g)
                g /= x
                p[k] -= g


def _packed(p) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def _added(parts) -> tuple[dict[str, np.ndarray], int]:
    """Mean of weights given as ``(packed weights, tokens)``, each counted by its tokens, and all tokens."""
    total, tokens = {}, 0
    for weights, n in parts:
        for k, w in _unpacked(weights).items():
            total[k] = total.get(k, 0) + w.astype(np.float64) * n
        tokens += n
    return {k: (w / tokens).astype(np.float32) for k, w in total.items()}, tokens


def rounds_of(train: DataFrame, share: float, rounds: int) -> list[DataFrame]:
    """The texts of each round, in ``order``: ``share`` of them, at least 1 / rounds; together all texts."""
    texts = train.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    number = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    starts = [(1 - share) * turn / max(1, rounds - 1) for turn in range(rounds)]
    # a range ends no earlier than the next begins, and the last is open: rounding leaves no gap
    ends = [max(a + share, b) for a, b in zip(starts, starts[1:])]
    return [
        texts.where((number >= starts[turn]) & ((number < ends[turn]) if turn < rounds - 1 else F.lit(True)))
        .withColumn("order", F.xxhash64("doc_id", "text", F.lit(turn + 4))) for turn in range(rounds)
    ]


def learn(train: DataFrame, counts: Counts, round_tokens: int = ROUND_TOKENS, trainers: int = TRAINERS,
          rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> dict[str, np.ndarray]:
    """Weights trained on all texts of ``train``, each in one round at least.

    Texts are dealt to rounds and tasks by hashes of doc_id and text, so copies of a text are spread. A task holds
    about CHUNK tokens (one text at least). The driver gets one set of weights (half a megabyte) for each GROUP tasks.
    """
    p = initial(counts.counts[: counts.short], counts.rest_tokens)
    if not counts.short:
        return p
    share = min(1.0, max(1 / rounds, round_tokens / max(1, counts.tokens)))
    trainers = max(trainers, math.ceil(counts.tokens * share / task_tokens))
    short, total = counts.common[: counts.short], counts.short
    spark = train.sparkSession
    for chosen in rounds_of(train, share, rounds):
        packed = spark.sparkContext.broadcast((short, _packed(p)))

        def run(batches, packed=packed):
            known, weights = packed.value
            lookup = Lookup(known)
            closing = lookup(np.array([END], np.uint64))[0]
            trainer = Trainer(_unpacked(weights), total if closing < 0 else int(closing))
            for batch in batches:
                for first, stop in rows_of(batch, 512):
                    hashes, at = _tokens(batch.column("text").slice(first, stop - first))
                    numbers = lookup(hashes)
                    numbers = np.where(numbers < 0, total, numbers)
                    for i in range(stop - first):
                        trainer.add(numbers[at[i] : at[i + 1]])
            trainer.flush()
            if trainer.tokens:
                yield {"weights": [_packed(trainer.p)], "tokens": [trainer.tokens]}

        def add(batches):
            rows = ((w, n) for b in batches for w, n in zip(b.column("weights").to_pylist(), b.column("tokens").to_pylist()))
            found, tokens = _added(rows)
            if tokens:
                yield {"weights": [_packed(found)], "tokens": [tokens]}

        dealt = chosen.repartition(trainers, "order").sortWithinPartitions("order", "doc_id", "text")
        found = freeze(in_batches(dealt.select("text"), run, "weights binary, tokens long"))
        n = found.count()
        while n > GROUP:
            n = math.ceil(n / GROUP)
            found = freeze(in_batches(found.repartition(n), add, "weights binary, tokens long"))
        rows = found.orderBy("tokens", F.xxhash64("weights")).collect()
        if rows:
            p = _added((bytes(r["weights"]), r["tokens"]) for r in rows)[0]
    return p


def text_scores(p: dict[str, np.ndarray], tokens: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Natural log of the probability of each text, given as word numbers ``tokens[at[i]:at[i + 1]]``, ``end`` closing each.

    Texts are laid end to end into lanes that run side by side, the longest first; the state starts anew with a text.
    """
    texts = len(at) - 1
    total = np.zeros(texts)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    lanes: list[list[int]] = [[] for _ in range(min(LANES, texts))]
    loads = np.zeros(len(lanes), np.int64)
    for i in order[length[order] > 0]:
        lane = int(np.argmin(loads))
        lanes[lane].append(i)
        loads[lane] += length[i]
    by_load = np.argsort(-loads, kind="stable")
    flat = np.concatenate([np.zeros(0, np.int64), *(np.arange(at[i], at[i + 1]) for lane in by_load for i in lanes[lane])])
    owner = np.repeat(np.arange(texts), length)[flat]
    loads = loads[by_load]
    first = np.concatenate([[0], np.cumsum(loads)])[:-1]
    targets = tokens[flat]
    begins = np.zeros(len(flat), bool)
    begins[flat == at[owner]] = True
    inputs = np.where(begins, end, np.roll(targets, 1))
    table = np.ascontiguousarray((p["vectors"] @ p["into"] + p["gates"]).T)
    h = np.zeros((UNITS, len(lanes)), np.float32).T
    window = 32
    for t in range(0, int(loads.max(initial=0)), window):
        steps = np.arange(t, min(t + window, int(loads[0])))
        active = np.searchsorted(-loads, -steps, side="left")
        ends = np.cumsum(active).tolist()
        place = np.concatenate([first[:n] + now for n, now in zip(active.tolist(), steps.tolist())])
        given, fresh = table.take(inputs[place], axis=1).T, begins[place]
        states = _columns(ends[-1], UNITS, np.float32)
        for start, end in zip([0, *ends], ends):
            h = h[: end - start]
            new = fresh[start:end]
            if new.any():
                h = h * ~new[:, None]
            h, _ = step(p, given[start:end], h)
            states[start:end] = h
        logs, _ = log_probabilities(p, states, targets[place].copy())
        np.add.at(total, owner[place], logs)
    return total


def score(docs: DataFrame, counts: Counts, p: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``; logs to base 10.

    A null text counts as empty: its one token is the end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over the
    tokens. Without training texts the shared class has all probability. Rows that repeat or lack a doc_id are rows like
    any other; other columns are not read. Counts of words beyond the common ones are joined, summed per text.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast((counts.common, counts.counts, _packed(p)))
    short, n_all = counts.short, counts.tokens
    whole = math.log10(n_all + counts.distinct + 1)
    rest = math.log10(counts.rest_tokens + counts.rest_distinct + 1)

    def run(batches):
        common, n, weights = packed.value
        lookup, weights = Lookup(common), _unpacked(weights)
        log_n = np.append(np.log10(n + 1.0), 0.0)
        found = lookup(np.array([END], np.uint64))[0]
        closing = short if found < 0 or found >= short else int(found)

        def done(parts, ids):
            tokens = np.concatenate([x for x, _ in parts])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
            number = lookup(tokens)
            short_number = np.where((number < 0) | (number >= short), short, number)
            model = text_scores(weights, short_number, at, closing) / math.log(10)
            length = np.diff(at)
            owner = np.repeat(np.arange(len(length)), length)
            base = np.bincount(owner, log_n[number], minlength=len(length)) - whole * length
            shared = short_number == short
            model += np.bincount(owner, (log_n[number] - rest) * shared, minlength=len(length))
            unknown = number < 0
            keys, times = tokens[unknown], owner[unknown]
            order = np.lexsort((keys, times))
            keys, times = keys[order], times[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (times[1:] != times[:-1])])) if len(keys) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(keys)))
            ends = np.searchsorted(times[new], np.arange(len(length) + 1)).astype(np.int32)
            return {
                "row": pa.concat_arrays([r for r, _ in ids]), "doc_id": pa.concat_arrays([d for _, d in ids]),
                "n_tokens": length, "n_known": length - np.bincount(times, minlength=len(length)),
                "base": base, "model": model,
                "rare": pa.ListArray.from_arrays(pa.array(ends), pa.array(wd.signed(keys[new]))),
                "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64))),
            }

        parts, ids, held = [], [], 0
        for batch in batches:
            for first, stop in rows_of(batch, 4096):
                parts.append(_tokens(batch.column("text").slice(first, stop - first)))
                ids.append((batch.column("row").slice(first, stop - first), batch.column("doc_id").slice(first, stop - first)))
                held += len(parts[-1][0])
                if held > HELD:
                    yield done(parts, ids)
                    parts, ids, held = [], [], 0
        if parts:
            yield done(parts, ids)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    scored = freeze(in_batches(source, run, "row long, doc_id long, n_tokens long, n_known long, base double, "
                                            "model double, rare array<long>, times array<long>"))
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("term"), F.col("x.times").alias("tf"))
    seen = rare.join(counts.table, "term").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("tf").alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def log_likelihoods(docs: DataFrame, train: Column) -> DataFrame:
    """Score every row of ``docs`` by a model of the rows for which ``train`` holds."""
    known = docs.where(train)
    counts = count_words(known)
    return score(docs, counts, learn(known, counts))
