"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a bounded sample of the labelled rows, in which copies of one text count once. A term's idf is
multiplied by how far the labels' rates of it are apart, smoothed so that the number of rows does not matter; no word
has the factor 0. Examples are the sample's rows that have a term; similar ones stand in one block. For a text, the
postings of its terms are added up, long lists last; the largest weights that the lists left have in each block bound what
they can add to the block's examples, and only examples that can still be among the k nearest are worked out: the
neighbours are exact. Their votes are weighted by nearness and by how many labelled rows each example stands for, and
pulled towards the rate of texts without any term.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words as wd
from sigspark.llm.tables import freeze, in_batches, rows_of

#: Added to the distance of the labels' rates of a term, so that words common to both count too.
LEAST_APART = 0.01
#: Labelled rows of each class that the model is fitted on, at most; of them, examples of each class in the index.
SAMPLE, EXAMPLES = 16_384, 4096
#: Neighbours that vote.
NEIGHBOURS = 15
#: Examples in a block; postings of a short list, at most; long lists added between two looks at the bounds.
_BLOCK, _SHORT, _LISTS = 64, 256, 8


def _terms(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the terms of a text."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.unique(at[vocabulary[at] == hashes], return_counts=True)


def factors(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Factor of each term found in ``pos`` and ``neg`` of ``n_pos`` and ``n_neg`` rows: idf times the distance of the
    smoothed rates p and q, (p - q) log(p / q) + LEAST_APART."""
    p, q = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    return np.log1p((n_pos + n_neg) / (pos + neg)) * ((p - q) * np.log(p / q) + LEAST_APART)


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    size = end - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


def _vector(terms: np.ndarray, counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * factor[terms]
    norm = np.sqrt((weights * weights).sum())
    return weights / norm if norm else weights


@dataclass
class Model:
    """Vocabulary, examples and rates; its size is bounded by the words of SAMPLE and EXAMPLES rows."""

    vocabulary: np.ndarray
    factor: np.ndarray
    ids: list
    labels: np.ndarray
    weights: np.ndarray
    rows: list
    rate_without: float
    neighbours: int = NEIGHBOURS

    def __post_init__(self):
        # similar examples share a block: sort by their heaviest term
        order = sorted(range(len(self.rows)), key=lambda i: (int(self.rows[i][0][np.argmax(self.rows[i][1])]),
                                                             -float(self.rows[i][1].max()), i))
        self.ids = [self.ids[i] for i in order]
        self.labels, self.weights = self.labels[order], self.weights[order]
        rows = [self.rows[i] for i in order]
        self.row_first = np.cumsum([0, *(len(t) for t, _ in rows)])
        self.row_term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)]).astype(np.int32)
        self.row_weight = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        self._index()

    def _index(self):
        """Postings by term and example, runs of them by term and block, and the rows as parts of the flat arrays."""
        n = len(self.row_first) - 1
        self.rows = [(self.row_term[i:j], self.row_weight[i:j]) for i, j in zip(self.row_first[:-1], self.row_first[1:])]
        self.blocks = -(-n // _BLOCK)
        by_term = np.argsort(self.row_term, kind="stable")
        term = self.row_term[by_term]
        self.post_row = np.repeat(np.arange(n), np.diff(self.row_first))[by_term]
        self.post_weight = self.row_weight[by_term]
        block = self.post_row // _BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        new = np.flatnonzero(new)
        self.run_block = block[new]
        self.run_most = np.maximum.reduceat(self.post_weight, new) if len(new) else np.zeros(0)
        size = len(self.vocabulary)
        self.post_first = np.searchsorted(term, np.arange(size + 1))
        self.term_first = np.searchsorted(term[new], np.arange(size + 1))
        self.term_most = np.zeros(size)
        has = np.flatnonzero(np.diff(self.term_first))
        if len(has):
            self.term_most[has] = np.maximum.reduceat(self.run_most, self.term_first[has])
        self.query = np.zeros(size)
        # a list of more than a quarter of the examples also as a column: at most four cells a posting
        self.columns = {}
        for t in np.flatnonzero(4 * np.diff(self.post_first) > max(n, _SHORT)).tolist():
            i, j = self.post_first[t : t + 2]
            self.columns[t] = np.zeros(n)
            self.columns[t][self.post_row[i:j]] = self.post_weight[i:j]

    def __getstate__(self):
        # tasks get the rows and make their own postings: half the bytes
        kept = ("vocabulary", "factor", "ids", "labels", "weights", "rate_without", "neighbours", "row_first", "row_term", "row_weight")
        return {k: self.__dict__[k] for k in kept}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def nearest(self, terms: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of largest cosine above 0, nearest first, ties by their place in the index; and the cosines.

        Short postings lists are added up first, then the long ones from the largest share on. What the lists left can
        add to an example is bounded, first by their largest weights anywhere, then by those in its block; once the
        examples that can still be among the nearest have fewer terms than there are postings left, their cosines are
        worked out from their own terms.
        """
        n, share = len(self.row_first) - 1, vector * self.term_most[terms]
        length = self.post_first[terms + 1] - self.post_first[terms]
        short = np.flatnonzero((share > 0) & (length <= _SHORT))
        long = np.flatnonzero((share > 0) & (length > _SHORT))
        long = long[np.argsort(-share[long], kind="stable")]
        post, of = _spread(self.post_first[terms[short]], self.post_first[terms[short] + 1])
        sums = np.bincount(self.post_row[post], self.post_weight[post] * vector[short][of], minlength=n).astype(float)
        left = np.append(np.cumsum(share[long][::-1])[::-1], 0.0)
        ahead = np.append(np.cumsum(length[long][::-1])[::-1], 0)
        lists = list(zip(terms[long].tolist(), self.post_first[terms[long]].tolist(), self.post_first[terms[long] + 1].tolist(),
                         vector[long].tolist()))
        own = np.empty(n)
        for done in range(0, len(lists) + 1, _LISTS):
            # no sum is above the largest
            if n > self.neighbours and sums.max() > left[done]:
                least = np.partition(sums, -self.neighbours)[-self.neighbours]
                if least > left[done]:
                    found = np.flatnonzero(sums >= least - left[done] - 1e-11)
                    if len(found) * len(self.row_term) < n * ahead[done]:
                        break
            for term, i, j, weight in lists[done : done + _LISTS]:
                if term in self.columns:
                    sums += np.multiply(self.columns[term], weight, out=own)
                else:
                    sums[self.post_row[i:j]] += weight * self.post_weight[i:j]
        else:
            done = len(lists)
        if done == len(lists):
            found = np.flatnonzero(sums > 1e-12)
            cosines = sums[found]
            if len(found) > self.neighbours:
                near = np.flatnonzero(cosines >= np.partition(cosines, -self.neighbours)[-self.neighbours] - 1e-11)
                found, cosines = found[near], cosines[near]
        else:
            rest = long[done:]
            runs, of = _spread(self.term_first[terms[rest]], self.term_first[terms[rest] + 1])
            bounds = np.bincount(self.run_block[runs], self.run_most[runs] * vector[rest][of], minlength=self.blocks)
            found = found[sums[found] + bounds[found // _BLOCK] >= least - 1e-11]
            at, of = _spread(self.row_first[found], self.row_first[found + 1])
            self.query[terms] = vector
            cosines = np.bincount(of, self.row_weight[at] * self.query[self.row_term[at]], minlength=len(found))
            self.query[terms] = 0.0
        keep = np.lexsort((found, -np.round(cosines, 12)))[: self.neighbours]
        keep = keep[cosines[keep] > 1e-12]
        return found[keep], cosines[keep]

    def score(self, hashes: np.ndarray) -> tuple[float, list]:
        """Probability of label 1, and the nearest examples as ``(doc_id, label, cosine)``."""
        terms, counts = _terms(hashes, self.vocabulary)
        found, cosines = self.nearest(terms, _vector(terms, counts, self.factor))
        if not len(found):
            return self.rate_without, []
        votes = self.weights[found] * cosines / (1.05 - np.minimum(cosines, 1.0))
        prior = 0.2 * votes.max()
        value = float((votes @ self.labels[found] + prior * self.rate_without) / (votes.sum() + prior))
        return value, [(self.ids[i], int(self.labels[i]), float(c)) for i, c in zip(found[:3], cosines[:3])]


def learn(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE,
          examples: int = EXAMPLES) -> Model:
    """Model from the rows of ``docs`` for which ``train`` holds and that have a label 0 or 1.

    Fitted on at most ``sample`` rows of each class, the first in order of a hash of their id; rates and votes are scaled
    to all labelled rows. The index takes at most ``examples`` of them that have a term. A doc_id with several labels,
    and a text that occurs with several, counts as 1 if any is.
    """
    known = freeze(labels.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
                   .where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all, p_all = sum(total.values()), total.get(1, 0)
    base = p_all / max(1, n_all)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), [], np.zeros(0), np.zeros(0), [], base)
    if not p_all or p_all == n_all:
        return nothing
    # at most 2 * sample rows are broadcast: the texts stay where they are
    picked = [known.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for kind in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select(
        "doc_id", "label", F.xxhash64("text").alias("key"))
    once = freeze(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")))
    rows = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(once), ["doc_id", "key"]).select("label", "doc_id", "text")

    def count(batches):
        seen = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        total = [0, 0]
        for batch in batches:
            kinds = batch.column("label").to_numpy()
            for first, end in rows_of(batch, 512):
                hashes, at = wd.words(batch.column("text").slice(first, end - first), plain=True)
                for kind in (0, 1):
                    own = [wd.distinct(hashes[at[i] : at[i + 1]]) for i in range(end - first) if kinds[first + i] == kind]
                    total[kind] += len(own)
                    if own:
                        old, m = seen[kind]
                        new, n = np.unique(np.concatenate(own), return_counts=True)
                        both, back = np.unique(np.concatenate([old, new]), return_inverse=True)
                        seen[kind] = both, np.bincount(back, np.concatenate([m, n])).astype(np.int64)
        for kind in (0, 1):
            words, n = seen[kind]
            zero = np.zeros(len(n), np.int64)
            yield {"term": wd.signed(words), "pos": n if kind else zero, "neg": zero if kind else n}
        # the row of sums
        yield {"term": pa.array([None], pa.int64()), "pos": [total[1]], "neg": [total[0]]}

    counts = freeze(in_batches(rows, count, "term long, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    sums = counts.where("term IS NULL").first()
    n_pos, n_neg = (sums["pos"], sums["neg"]) if sums else (0, 0)
    if not n_pos or not n_neg:
        return nothing
    # at most the words of SAMPLE rows of each class, 24 bytes a word
    chosen = counts.where("term IS NOT NULL").toArrow()
    if not len(chosen):
        return nothing
    vocabulary = chosen.column("term").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    factor = factors(*(chosen.column(c).to_numpy()[order] for c in ("pos", "neg")), n_pos, n_neg)
    vocabulary = vocabulary[order]
    packed = docs.sparkSession.sparkContext.broadcast((vocabulary, factor))

    def vectors(batches):
        vocabulary, factor = packed.value
        without = [0, 0]
        for batch in batches:
            kinds, ids = batch.column("label").to_numpy(), batch.column("doc_id").to_numpy()
            out = {"doc_id": [], "label": [], "terms": [], "weights": [], "without": []}
            for first, end in rows_of(batch, 512):
                hashes, at = wd.words(batch.column("text").slice(first, end - first), plain=True)
                for i in range(end - first):
                    own, m = _terms(hashes[at[i] : at[i + 1]], vocabulary)
                    if not len(own):
                        without[kinds[first + i]] += 1
                        continue
                    for k, v in zip(out, (ids[first + i], kinds[first + i], own, _vector(own, m, factor), 0)):
                        out[k].append(v)
            yield out
        for kind in (0, 1):
            yield {"doc_id": pa.array([None], pa.int64()), "label": [kind], "terms": [[]], "weights": [[]],
                   "without": [without[kind]]}

    found = freeze(in_batches(rows, vectors, "doc_id long, label int, terms array<int>, weights array<double>, without long"))
    bare = {r["label"]: r["n"] for r in found.where("doc_id IS NULL").groupBy("label").agg(F.sum("without").alias("n")).collect()}
    found = found.where("doc_id IS NOT NULL")
    have = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [
        found.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        .select("doc_id", "label", "terms", "weights").toArrow() for kind in (0, 1)
    ]
    scale = [total[0] / n_neg, total[1] / n_pos]
    share = [scale[kind] * have.get(kind, 0) / max(1, len(taken[kind])) for kind in (0, 1)]
    without = [scale[kind] * bare.get(kind, 0) for kind in (0, 1)]
    rate = (without[1] + base) / (sum(without) + 1)
    kept = pa.concat_tables(taken).combine_chunks()
    kinds = kept.column("label").to_numpy()
    return Model(vocabulary, factor, kept.column("doc_id").to_pylist(), kinds.astype(float), np.array(share)[kinds],
                 _rows(kept), rate)


def _rows(kept: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and weights of each row, as parts of two flat arrays."""
    out = []
    for batch in kept.select(["terms", "weights"]).to_batches():
        terms, weights = batch.columns
        at = terms.offsets.to_numpy()
        flat = terms.values.to_numpy(), weights.values.to_numpy()
        out += [(flat[0][i:j], flat[1][i:j]) for i, j in zip(at[:-1], at[1:])]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, evidence`` of each row of ``docs``, from its whole text alone.

    ``score`` is from 0 to 1; a text without any term of the model (so a null, empty or blank one) gets the rate of
    label 1 among labelled rows without one. ``predicted`` is 1 from 0.5 on. ``evidence`` lists up to three nearest
    examples: doc_id, label and cosine. Without labelled rows of both classes every score is the rate of label 1, 0 if
    there are none. Rows that repeat or lack a doc_id are rows like any other; other columns are not read.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = packed.value
        for batch in batches:
            scores, evidence = [], []
            for first, end in rows_of(batch, 512):
                hashes, at = wd.words(batch.column("text").slice(first, end - first), plain=True)
                for i in range(end - first):
                    value, near = own.score(hashes[at[i] : at[i + 1]])
                    scores.append(value)
                    evidence.append([dict(zip(("doc_id", "label", "cosine"), x)) for x in near])
            yield {"doc_id": batch.column("doc_id"), "score": scores, "predicted": [int(s >= 0.5) for s in scores],
                   "evidence": evidence}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(source, run, "doc_id long, score double, predicted int, "
                                   "evidence array<struct<doc_id: long, label: int, cosine: double>>")
