"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 letters, word edges counted as a letter) of a language or a text in
falling order. A text gets the language whose profile has the smallest out-of-place distance: the sum over the text's
n-grams of how far their ranks are apart, with the length of the profile for n-grams it lacks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import freeze, in_batches, rows_of

#: N-grams in a profile.
PROFILE = 400
_SHARPNESS = 25.0


@functools.cache
def _letters() -> np.ndarray:
    """A number under 1024 for each code point: 0 for what is no letter; upper and lower case alike.

    Letters from U+0200 on share numbers by a fixed rule, which blurs n-grams of large scripts but loses none.
    """
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if ch.isalpha():
            low = ch.lower()
            code_low = ord(low[0])
            table[code] = code_low if code_low < 512 else 512 + (code_low * 40503 >> 4) % 512
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, in any order; empty if it has no letter."""
    found = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    found = np.concatenate([[0], found, [0]]).astype(np.uint32)
    found = found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]
    if len(found) < 2:
        return np.zeros(0, np.uint32)
    a, b = found[:-1], found[1:]
    two = a << np.uint32(10) | b
    three = two[:-1] << np.uint32(10) | found[2:]
    return np.concatenate([
        found[found != 0] | np.uint32(1 << 30),
        two | np.uint32(2 << 30),
        three[found[1:-1] != 0] | np.uint32(3 << 30),
    ])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def learn_profiles(docs: DataFrame, lang: str = "lang", most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of each non-null language from all rows of ``docs``.

    Counts are summed per task and language before they are shuffled. The driver gets the frequent end of each
    language's counts, cut at a step of a logarithmic histogram: a few times ``most`` rows a language.
    """

    def count(batches):
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, end in rows_of(batch, 4096, limit=1 << 19):
                texts = batch.column("text").slice(first, end - first).to_pylist()
                for one in set(langs[first:end]):
                    joined = [grams(t) for t, x in zip(texts, langs[first:end]) if x == one and t]
                    if joined:
                        codes, n = counted(np.concatenate(joined))
                        if one in totals:
                            old, m = totals[one]
                            both, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                            codes, n = both, np.bincount(back, np.concatenate([m, n])).astype(np.int64)
                        totals[one] = codes, n
        for one, (codes, n) in totals.items():
            yield {"lang": pa.array([one] * len(codes)), "gram": codes.astype(np.int64), "n": n}

    source = docs.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    source = source.where("lang IS NOT NULL AND text IS NOT NULL")
    totals = freeze(in_batches(source, count, "lang string, gram long, n long")
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in totals.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect():
        sizes.setdefault(r["lang"], []).append((r["step"], r["rows"]))
    if not sizes:
        return {}
    cuts = []
    for one, steps in sizes.items():
        kept = 0
        for at, rows in sorted(steps, reverse=True):
            kept, cut = kept + rows, at
            if kept >= most:
                break
        cuts.append((one, cut))
    # one row a language
    cut_table = totals.sparkSession.createDataFrame(cuts, "lang string, cut long")
    frequent: dict[str, list[tuple[int, int]]] = {}
    for r in totals.join(cut_table, "lang").where(step >= F.col("cut")).select("lang", "gram", "n").collect():
        frequent.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    return {
        one: ranked(np.array([g for g, _ in rows], np.uint32), np.array([n for _, n in rows]), most)
        for one, rows in sorted(frequent.items())
    }


def distances(own: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[float]:
    """Out-of-place distance of a text's ranked n-grams to each profile, as a share of the largest possible."""
    out = []
    ranks = np.arange(len(own))
    for codes, at in profiles:
        place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        apart = np.where(codes[place] == own, np.abs(at[place] - ranks), most)
        out.append(float(apart.sum()) / (most * len(own)))
    return out


def _judge(profiles: dict[str, np.ndarray], most: int):
    names = sorted(profiles)
    tables = []
    for name in names:
        order = np.argsort(profiles[name])
        tables.append((profiles[name][order], order))

    def judge(text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else ()
        if not len(codes) or not names:
            return "und", 0.0
        far = distances(ranked(*counted(codes), most), tables, most)
        best = min(range(len(far)), key=far.__getitem__)
        share = 1 / sum(math.exp(-_SHARPNESS * (d - far[best])) for d in far)
        return names[best], share * (1 - far[best])

    return judge


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs``, from the whole text alone.

    ``lang_pred`` is ``und`` and ``score`` 0 for a null or empty text, one without a letter, or if no language was
    learned. Equal distances go to the language first in order of name. ``score`` weighs the best language against all
    others: exp(-25 d) of it over the sum, times 1 - d, so a text far from every profile scores low.
    Rows with a null or repeated doc_id are rows like any other; other columns are not read.
    """
    judge = _judge(profiles, most)

    def predict(batches):
        for batch in batches:
            found = [judge(text) for text in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(source, predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, train: Column, most: int = PROFILE) -> DataFrame:
    """Rows of ``docs`` in an identified language, with all their columns: those that ``identify`` calls ``und`` go.

    These are the texts without a letter: no distance to the profiles is too far. Profiles come from the rows for which
    ``train`` holds and ``lang`` is known; if there are none, every text with a letter stays too. The texts are not
    shuffled.
    """
    profiles = learn_profiles(docs.where(train), most=most)
    judge = _judge(profiles, most) if profiles else lambda text: ("any" if text and len(grams(text)) else "und", 0.0)

    def keep(batches):
        for batch in batches:
            for first, end in rows_of(batch, 512):
                part = batch.slice(first, end - first)
                yield part.filter(pa.array([judge(t)[0] != "und" for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
