"""Benchmark decontamination: training passages are queries against a BM25 index of the benchmark's items.

Items are indexed in parts of at most 64 words, passages are windows of 128 words that begin every 64, so any part that
occurs in a text lies in one passage. A part's score is taken relative to its score against itself: 1 if a passage has
all its words.

Retrieval is exact, by block-max WAND: the postings of a term are blocks with their largest impact, and each part's
terms are parted into those that decide and a rest that adds less than half the threshold. A block of parts is opened for
a passage only if its largest impacts and largest rest can reach the threshold. Only parts of which a passage has
deciding terms are looked at, and only if those and the rest's bound reach the threshold is the score worked out. A term's
weight comes from the whole benchmark, however many indexes it is searched in. Retrieved items are then verified against the words around the passage.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words as wd
from sigspark.llm.tables import freeze, in_batches, rows_of

PART, PASSAGE, STRIDE = 64, 128, 64
#: Retrieved: BM25 relative to the part's own. Verified: share of the question's 5-word shingles, and of the answer's words.
RETRIEVE, QUESTION, ANSWER = 0.5, 0.5, 0.5
_K1, _B = 1.2, 0.75
#: Items of one index; a larger benchmark is searched index by index.
ITEMS_PER_INDEX = 20_000
_BLOCK = 16


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    size = end - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


class Index:
    """Postings of one block of benchmark items.

    ``whole``: number and mean length of the parts of all blocks, this block's terms in order of their hashes and in how
    many of all parts each is; taken from ``items`` if not given. The last two are bytes of unsigned and signed numbers.
    """

    def __init__(self, items: list[tuple[int, str]], retrieve: float = RETRIEVE,
                 whole: tuple[int, float, bytes, bytes] | None = None):
        self.retrieve = retrieve
        self.items, parts, of_item = [], [], []
        for item_id, text in items:
            hashes = wd.words(pa.array([text or ""]))[0]
            if not len(hashes):
                continue
            answer = max(1, len(hashes) // 5)
            self.items.append((item_id, len(hashes), wd.distinct(wd.shingles(hashes[: len(hashes) - answer], 5)),
                               wd.distinct(hashes[len(hashes) - answer :])))
            for at in range(0, len(hashes), PART):
                parts.append(hashes[at : at + PART])
                of_item.append(len(self.items) - 1)
        self.of_item = np.array(of_item, np.int64)
        n = len(parts)
        self.terms = wd.distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        part_of, term_of, count = [], [], []
        for i, p in enumerate(parts):
            t, c = np.unique(np.searchsorted(self.terms, p), return_counts=True)
            part_of.append(np.full(len(t), i))
            term_of.append(t)
            count.append(c)
        if not parts:
            return
        part, term, tf = np.concatenate(part_of), np.concatenate(term_of), np.concatenate(count)
        df = np.bincount(term, minlength=len(self.terms))
        length = np.array([len(p) for p in parts])
        n_all, mean = n, length.mean()
        if whole is not None:
            n_all, mean = whole[:2]
            df = np.frombuffer(whole[3], np.int64)[np.searchsorted(np.frombuffer(whole[2], np.uint64), self.terms)]
        norm = _K1 * (1 - _B + _B * length / mean)
        impact = np.log1p((n_all - df + 0.5) / (df + 0.5))[term] * tf * (_K1 + 1) / (tf + norm[part])
        impact /= np.bincount(part, impact, minlength=n)[part]
        # the terms of a part from weak to strong; those before the bound are its rest
        order = np.lexsort((impact, part))
        part, term, impact = part[order], term[order], impact[order]
        first = np.searchsorted(part, np.arange(n + 1))
        run = np.cumsum(impact) - np.concatenate([[0], np.cumsum(impact)])[first[part]]
        weak = run < retrieve / 2
        self.rest = np.bincount(part, impact * weak, minlength=n)
        self.part_first, self.part_terms, self.part_impacts = first, term, impact
        # postings of deciding terms, by term and part
        strong = np.flatnonzero(~weak)
        strong = strong[np.lexsort((part[strong], term[strong]))]
        self.post_part, self.post_impact = part[strong], impact[strong]
        # a run is a term's postings in a block of parts
        own, block = term[strong], self.post_part // _BLOCK
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
        new = np.flatnonzero(new)
        self.run_first, self.run_block = np.append(new, len(own)), block[new]
        self.run_most = np.maximum.reduceat(self.post_impact, new)
        self.term_first = np.searchsorted(own[new], np.arange(len(self.terms) + 1))
        self.rest_most = np.maximum.reduceat(self.rest, np.arange(0, n, _BLOCK))
        # a table of the low bits of a term's hash tells most words apart from terms at once
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def retrieved(self, hashes: np.ndarray, at: np.ndarray):
        """``(row, passage, part, score)`` arrays of all passages and parts that reach the threshold."""
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none, none, np.zeros(0)
        places = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.searchsorted(self.terms, hashes[places])
        hit = self.terms[np.minimum(term, len(self.terms) - 1)] == hashes[places]
        places, term = places[hit], term[hit]
        row = np.searchsorted(at, places, side="right") - 1
        slot = (places - at[row]) // STRIDE
        # each word lies in the passage that begins in its stride and in the one before
        width = int((np.diff(at).max(initial=0)) // STRIDE + 2)
        passage = row * width + slot
        passage = np.concatenate([passage, passage[slot > 0] - 1])
        term = np.concatenate([term, term[slot > 0]])
        keys = wd.distinct((passage * len(self.terms) + term).astype(np.uint64)).astype(np.int64)
        passage, term = keys // len(self.terms), keys % len(self.terms)
        # block-max: a block of parts is opened for a passage only if its terms' largest impacts can reach the bound
        runs, of = _spread(self.term_first[term], self.term_first[term + 1])
        cells, back = np.unique(passage[of] * len(self.rest_most) + self.run_block[runs], return_inverse=True)
        bound = np.bincount(back, self.run_most[runs], minlength=len(cells)) + self.rest_most[cells % len(self.rest_most)]
        opened = (bound >= self.retrieve - 2e-9)[back]
        runs, of = runs[opened], of[opened]
        post, by = _spread(self.run_first[runs], self.run_first[runs + 1])
        n = len(self.of_item)
        pair = passage[of[by]] * n + self.post_part[post]
        pairs, back = np.unique(pair, return_inverse=True)
        strong = np.bincount(back, self.post_impact[post], minlength=len(pairs))
        pairs = pairs[strong + self.rest[pairs % n] >= self.retrieve - 1e-9]
        part, passage = pairs % n, pairs // n
        size = self.part_first[part + 1] - self.part_first[part]
        spread = np.repeat(np.arange(len(part)), size)
        own = np.arange(len(spread)) - np.repeat(np.cumsum(size) - size, size) + self.part_first[part][spread]
        wanted = passage[spread] * len(self.terms) + self.part_terms[own]
        found = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted if len(keys) else wanted < 0
        score = np.bincount(spread, self.part_impacts[own] * found, minlength=len(part))
        good = score >= self.retrieve - 1e-9
        return passage[good] // width, passage[good] % width, part[good], score[good]

    def leaks(self, texts: pa.Array):
        """``(row, item_id, score, word, question, answer)`` of each verified item, best passage first, once a text."""
        hashes, at = wd.words(texts)
        best: dict[tuple[int, int], tuple] = {}
        for row, passage, part, score in zip(*self.retrieved(hashes, at)):
            item_id, n, question, answer = self.items[self.of_item[part]]
            begin = at[row] + passage * STRIDE
            near = hashes[max(at[row], begin - n) : min(at[row + 1], begin + PASSAGE + n)]
            in_question = float(np.isin(question, wd.shingles(near, min(5, max(1, n - len(answer))))).mean()) if len(question) else 1.0
            in_answer = float(np.isin(answer, near).mean())
            if in_question >= QUESTION and in_answer >= ANSWER:
                found = (float(score), int(passage * STRIDE), in_question, in_answer)
                key = (int(row), int(self.of_item[part]))
                if key not in best or (found[0], -found[1]) > (best[key][0], -best[key][1]):
                    best[key] = found
        return [(row, self.items[item][0], *found) for (row, item), found in sorted(best.items())]


def _part_terms(rows: DataFrame) -> DataFrame:
    """``term, parts, words`` of items: in how many parts each term is; a null term has the number and words of all."""

    def count(batches):
        for batch in batches:
            terms, parts, length = [np.zeros(0, np.uint64)], 0, 0
            for first, end in rows_of(batch, 512):
                hashes, at = wd.words(batch.column("text").slice(first, end - first))
                for i in range(end - first):
                    for j in range(at[i], at[i + 1], PART):
                        terms.append(wd.distinct(hashes[j : min(j + PART, at[i + 1])]))
                        parts += 1
                length += len(hashes)
            found, n = np.unique(np.concatenate(terms), return_counts=True)
            yield {"term": wd.signed(found), "parts": n, "words": np.zeros(len(n), np.int64)}
            yield {"term": pa.array([None], pa.int64()), "parts": [parts], "words": [length]}

    return in_batches(rows.select("text"), count, "term long, parts long, words long").groupBy("term").agg(
        F.sum("parts").alias("parts"), F.sum("words").alias("words"))


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The benchmark's items, at most ITEMS_PER_INDEX or so at a time, fetched one block after the other; and ``whole``."""
    source = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    blocks = math.ceil(max(1, source.count()) / ITEMS_PER_INDEX)
    if blocks > 1:
        source = freeze(source.where("item IS NOT NULL AND text <> ''").distinct())
        counts = freeze(_part_terms(source))
        total = counts.where("term IS NULL").first()
    for b in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else source
        items = sorted({(r["item"], r["text"]) for r in rows.collect() if r["item"] is not None and r["text"]})
        whole = None
        if blocks > 1 and items:
            own = counts.join(_part_terms(rows).select("term"), "term", "left_semi").toPandas()
            terms, parts = own["term"].to_numpy(np.int64).view(np.uint64), own["parts"].to_numpy(np.int64)
            order = np.argsort(terms)
            whole = total["parts"], total["words"] / max(1, total["parts"]), terms[order].tobytes(), parts[order].tobytes()
        yield items, whole


@functools.lru_cache(4)
def _index(items: tuple, whole: tuple | None, retrieve: float) -> Index:
    return Index(list(items), retrieve, whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
                 retrieve: float = RETRIEVE) -> DataFrame:
    """``doc_id, item_id, score, word, question_overlap, answer_overlap`` of each verified item in each document.

    ``word`` is where the best passage begins. Every window of every whole text is a query. A null, empty or blank
    text, or an item without words, matches nothing. An item's answer is its last fifth of words, its question the
    words before. Rows that repeat a doc_id count as one document with the best match of each item; null doc_ids do
    too. Columns other than ``doc_id`` and ``text`` are not read. Items with a null id are left out.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items, whole in _blocks(benchmark, item, text):
        packed = docs.sparkSession.sparkContext.broadcast((tuple(items), whole))

        def search(batches, packed=packed):
            index = _index(*packed.value, retrieve)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, end in rows_of(batch, 512):
                    found = index.leaks(batch.column("text").slice(first, end - first))
                    if found:
                        row, item_id, score, word, question, answer = zip(*found)
                        yield {"doc_id": [ids[first + r] for r in row], "item_id": list(item_id), "score": list(score),
                               "word": list(word), "question_overlap": list(question), "answer_overlap": list(answer)}

        part = in_batches(source, search, "doc_id long, item_id long, score double, word long, question_overlap double, "
                                          "answer_overlap double")
        out = part if out is None else out.union(part)
    rank = F.struct("score", (-F.col("word")).alias("before"), "question_overlap", "answer_overlap")
    return out.groupBy("doc_id", "item_id").agg(F.max(rank).alias("best")).select(
        "doc_id", "item_id", "best.score", (-F.col("best.before")).alias("word"), "best.question_overlap",
        "best.answer_overlap")


def keep_clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
               retrieve: float = RETRIEVE) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is verified, with all their columns. The texts are not shuffled."""
    for items, whole in _blocks(benchmark, item, text):
        packed = docs.sparkSession.sparkContext.broadcast((tuple(items), whole))

        def clean(batches, packed=packed):
            index = _index(*packed.value, retrieve)
            for batch in batches:
                for first, end in rows_of(batch, 512):
                    part = batch.slice(first, end - first)
                    good = np.ones(len(part), bool)
                    good[[row for row, *_ in index.leaks(part.column("text"))]] = False
                    yield part.filter(pa.array(good))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
