"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that its encoding can end with: the token that fits the
unique last token of what stands before it. Storing that token for each prefix makes the encoding a walk from the end.
Appending only adds entries, and an edit needs new entries only until the table agrees with the old one again.

Two tokens fit if merging the bytes of both by rank merges nothing across their border. Fits are remembered, as are the ids of recent
segments and of the pattern's matches in them; all memories have fixed bounds. Matches that many texts ask for and none
remembers are worked out together, by the same entries: for all of them at once those of their first bytes, then of
their second ones, and so on (``Together``).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import in_batches, rows_of
from sigspark.llm.words import Lookup

#: Entries of the memories of a task; when full they start anew.
REMEMBERED_FITS = 1 << 18
REMEMBERED_SEGMENTS = 1 << 17
REMEMBERED_PIECES = 1 << 16
REMEMBERED_HEADS = 1 << 17

#: Bits of the number of fits that matches worked out together remember; bytes of those matches, and of the longest.
FIT_BITS, TOGETHER, LONGEST = 19, 1 << 16, 256
#: Rows and bytes of text that are encoded together.
_ROWS, _TEXT = 512, 1 << 19
#: Longest segments and matches, in characters, that are remembered.
_SHORT = 32

_NEVER = 1 << 60
#: Bytes of the heads that are remembered from one match to the next.
_HEAD = 6


def _spread(keys: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 one to one as hashes whose low bits differ."""
    out = keys.astype(np.uint64)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out


class Together:
    """Last tokens of all prefixes of many byte strings at once, as ``Vocabulary.extend`` finds them for one.

    Every token that a string holds is found by its bytes, all strings and places together. Then the entries are filled
    in by place: of the tokens that end there one fits the entry before it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self._of = vocabulary
        ranks, tokens = vocabulary.ranks, vocabulary.tokens
        # the number past the last token stands for the begin of a string; it merges with nothing
        self.none = len(tokens)
        self._width = self.none + 1
        self._sizes = np.array([*map(len, tokens), 1])
        self._numbers = np.arange(self.none).astype(object)  # one object a number, however often it is remembered
        nodes: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        steps, pairs, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                head = token[: i + 1]
                if head not in nodes:
                    steps.append(nodes[token[:i]] << 8 | token[i])
                    nodes[head] = len(nodes)
                left = ranks.get(token[:i])
                if left is not None:
                    right = ranks.get(token[i:])
                    if right is not None:
                        pairs.append(left * self._width + right)
                        merged.append(rank)
        self._steps, self._pairs = (Lookup(_spread(np.array(x, np.int64))) for x in (steps, pairs))
        self._merged = np.append(np.array(merged, np.int64), _NEVER)  # for no pair, -1
        self._token = np.full(len(nodes), -1, np.int32)
        for token, rank in ranks.items():
            if token:
                self._token[nodes[token]] = rank
        # the states of ``Vocabulary._schedule``, filled in when asked for; known: 1 if merging gives the token, 0 if not
        self._first = np.concatenate([[0], np.cumsum(self._sizes)])
        self._next = np.full(self._first[-1], _NEVER)
        self._begin, self._end = (np.full(self._first[-1], self.none) for _ in range(2))
        self._known = np.full(self._width, -1, np.int8)
        self._known[self.none] = 1
        # twice the pair, and one more if it fits; a later pair takes the place of an earlier one
        self._fits = np.full(1 << FIT_BITS, -1)

    def _schedules(self, tokens: np.ndarray) -> None:
        ranks = self._of.ranks
        for token in np.unique(tokens[self._known[tokens] < 0]).tolist():
            states = self._of._schedule(token)
            self._known[token] = bool(states)
            if states:
                at = slice(self._first[token], self._first[token] + len(states))
                self._next[at] = [rank for rank, _, _ in states]
                self._begin[at] = [ranks[begin] for _, begin, _ in states]
                self._end[at] = [ranks[end] for _, _, end in states]

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair first, as ``Vocabulary._apart`` tells of one."""
        before, token = np.divmod(pairs, self._width)
        self._schedules(before)
        self._schedules(token)
        out = (self._known[before] > 0) & (self._known[token] > 0)
        at = np.flatnonzero(out)
        i, j = self._first[before[at]], self._first[token[at]]
        while len(at):
            next_left, next_right = self._next[i], self._next[j]
            across = self._merged[self._pairs(_spread(self._end[i] * self._width + self._begin[j]))]
            crossed = (across < next_left) & (across <= next_right)
            out[at[crossed]] = False
            left = next_left <= next_right
            i, j = i + left, j + ~left
            on = ~crossed & ~(left & (next_left == _NEVER))
            at, i, j = at[on], i[on], j[on]
        return out

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        pairs = before * np.int64(self._width) + token
        place = (_spread(pairs) & np.uint64(len(self._fits) - 1)).astype(np.int64)
        found = self._fits[place]
        out = (found & 1).astype(bool)
        new = np.flatnonzero(found >> 1 != pairs)
        if len(new):
            asked, back = np.unique(pairs[new], return_inverse=True)
            ok = self._apart(asked)[back]
            out[new] = ok
            self._fits[place[new]] = pairs[new] * 2 + ok
        return out

    def encode(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each string; none is empty."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        # one place before each string stands for its begin
        data = np.frombuffer(b"\0" + b"\0".join(strings), np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        ahead = np.repeat(begin + size, size + 1) - np.arange(len(data))  # bytes that follow in the string
        inside = np.ones(len(data), bool)
        inside[begin] = False
        start = np.flatnonzero(inside).astype(np.int32)
        node, length, found = data[start].astype(np.int64), 1, []
        while True:
            token = self._token[node]
            hit = np.flatnonzero(token >= 0)
            found.append((start[hit] - np.int32(1), token[hit], start[hit] + np.int32(length - 1)))
            on = ahead[start] >= length
            start, node = start[on], node[on]
            if not len(start):
                break
            step = self._steps(_spread(node << 8 | data[start + length]))
            on = step >= 0
            start, node, length = start[on], step[on].astype(np.int64) + 256, length + 1
        before, token, end = map(np.concatenate, zip(*found))
        place = (np.arange(len(data)) - np.repeat(begin, size + 1)).astype(np.uint16)[end]
        order = np.argsort(place, kind="stable")
        before, token, end = before[order], token[order], end[order]
        last = np.full(len(data), -1)
        last[begin] = self.none
        borders = np.cumsum(np.bincount(place)).tolist()
        for a, b in zip(borders, borders[1:]):
            fit = self.fits(last[before[a:b]], token[a:b])
            last[end[a:b][fit]] = token[a:b][fit]
        if last.min(initial=0) < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        return self._walk(last, begin, size)

    def _walk(self, last, begin, size) -> list[tuple[int, ...]]:
        at, owner, found = begin + size, np.arange(len(begin)), []
        while len(at):
            token = last[at]
            found.append((owner, token))
            at = at - self._sizes[token]
            on = at > begin[owner]
            at, owner = at[on], owner[on]
        count = np.bincount(np.concatenate([o for o, _ in found]), minlength=len(begin)) if found else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        flat = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for back, (owner, token) in enumerate(found):
            flat[ends[owner] - 1 - back] = token
        flat, ends = self._numbers[flat].tolist(), ends.tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Vocabulary:
    """Ranks of a byte-level vocabulary: one line per token, base64 bytes and rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        # by three last bytes: lengths of the tokens that can end there, longest first
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self._lengths = {ending: (*sorted(found, reverse=True), *self._short(ending)) for ending, found in lengths.items()}
        self.cut = regex.compile(pattern).findall
        self._schedules: dict[int, list[tuple[int, bytes, bytes]]] = {}
        self._fits: dict[int, bool] = {}
        self._segments: dict[str, tuple[int, ...] | None] = {}
        self._older: dict[str, tuple[int, ...] | None] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older_pieces: dict[str, tuple[int, ...]] = {}
        self._heads: dict[bytes, tuple[int, ...]] = {}

    @functools.cached_property
    def _ends(self):
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        return found.iter

    @functools.cached_property
    def _together(self) -> Together:
        return Together(self)

    def _schedule(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """States of the token's bytes as they merge by rank: rank of the next merge, leftmost and rightmost part.

        The last state has no next merge; it is one part exactly if rank merging gives the token.
        """
        known = self._schedules.get(token)
        if known is None:
            data, ranks, known = self.tokens[token], self.ranks, []
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                pairs = [(ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)]
                rank, i = min(pairs, default=(_NEVER, 0))
                known.append((rank, parts[0], parts[-1]))
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 1:
                known = []
            self._schedules[token] = known
        return known

    def fits(self, before: int | None, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (None: begin a string): no merge crosses the border first.

        The bytes of both merge in one order, lowest rank first and leftmost among equals.
        """
        key = token if before is None else before + 1 << 32 | token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= REMEMBERED_FITS:
                self._fits.clear()
            left, right = self._schedule(token if before is None else before), self._schedule(token)
            known = bool(left and right) and (before is None or self._apart(left, right))
            self._fits[key] = known
        return known

    def _apart(self, left, right) -> bool:
        get, i, j = self.ranks.get, 0, 0
        while True:
            next_left, _, end = left[i]
            next_right, begin, _ = right[j]
            across = get(end + begin, _NEVER)
            if across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                if next_left == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Add to ``last``, the last tokens of the prefixes of ``data``, those of the next prefixes up to ``stop``."""
        done, stop = len(last), len(data) if stop is None else stop
        known, fits = self._fits.get, self.fits
        first = max(0, done + 1 - self.longest)
        # every token that ends at each byte, in order of the end
        for at, token in self._ends(data[first:stop].decode("latin-1")):
            at += first
            if at != len(last):
                if at > len(last):
                    break
                continue
            start = at + 1 - len(self.tokens[token])
            before = last[start - 1] if start else None
            key = token if before is None else before + 1 << 32 | token
            ok = known(key)
            if ok or ok is None and fits(before, token):
                last.append(token)
        if len(last) < stop:
            raise ValueError("the vocabulary lacks a byte of the text")
        return last

    def edited(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Bytes and last tokens after ``data[start:stop]`` is replaced by ``new``.

        Entries are computed from ``start`` until as many in a row as the longest token has bytes agree with the old
        table; what follows is the old table's.
        """
        after = data[:start] + new + data[stop:]
        moved = len(new) - (stop - start)
        fresh, same = last[:start], 0
        while len(fresh) < len(after):
            self.extend(after, fresh, len(fresh) + 1)
            end = len(fresh)
            # the entry of one prefix depends on those of the last ``longest`` prefixes alone
            if end > start + len(new) and fresh[-1] == last[end - moved - 1]:
                same += 1
                if same >= self.longest:
                    return after, fresh + last[end - moved :]
            else:
                same = 0
        return after, fresh

    def walk(self, last: list[int]) -> list[int]:
        """Encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        out.reverse()
        return out

    def _short(self, ending: bytes) -> tuple[int, ...]:
        """Lengths below three of the tokens that can end with ``ending``."""
        return (2, 1) if ending[-2:] in self.ranks else (1,)

    def _ids(self, data: bytes, heads: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
        """Encoding of a string, from those of the heads that it asks for, rather than of all: the head before the last
        token, which must fit that head's last one. Short heads are remembered, longer ones while ``heads`` lives.
        """
        get, known, fits, end = self.ranks.get, self._fits.get, self.fits, len(data)
        for length in self._lengths.get(data[-3:]) or self._short(data):
            if length < end:
                token = get(data[-length:])
                if token is None:
                    continue
                head = data[:-length]
                before = (self._heads if end - length <= _HEAD else heads).get(head) or self._ids(head, heads)
                ok = known(before[-1] + 1 << 32 | token)
                if ok or ok is None and fits(before[-1], token):
                    ids = (*before, token)
                    break
            elif length == end:
                token = get(data)
                if token is not None and self.fits(None, token):
                    ids = (token,)
                    break
        else:
            raise ValueError("the vocabulary lacks a byte of the text")
        if end > _HEAD:
            heads[data] = ids
        else:
            if len(self._heads) >= REMEMBERED_HEADS:
                self._heads.clear()
            self._heads[data] = ids
        return ids

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern. Short ones are remembered, two generations as for segments."""
        ids = self._pieces.get(text)
        if ids is None:
            ids = self._older_pieces.get(text)
            if ids is None:
                ids = self._piece(text)
            if len(text) <= _SHORT:
                if len(self._pieces) >= REMEMBERED_PIECES:
                    self._older_pieces, self._pieces = self._pieces, {}
                self._pieces[text] = ids
        return ids

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match, worked out. A match that is a token is that token."""
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 64:
            return tuple(self.walk(self.extend(data, [])))
        return self._ids(data, {}) if data else ()

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the pattern cuts it; no special tokens."""
        # Between single spaces that touch no other white space the pattern cuts each segment by itself.
        first, *segments = text.split(" ")
        if segments and first and not first[-1].isspace():
            get = self._segments.get
            parts = [get(s, False) for s in segments]
            if False in parts:
                parts = [self._segment(s) if p is False else p for s, p in zip(segments, parts)]
            if None not in parts:
                head = chain.from_iterable(map(self.piece, self.cut(first)))
                return list(chain(head, chain.from_iterable(parts)))
        return list(chain.from_iterable(map(self.piece, self.cut(text))))

    def _segment(self, segment: str) -> tuple[int, ...] | None:
        """Ids of a space and ``segment``; None if the segment is empty or begins or ends with white space.

        Two generations are remembered: what was asked for since the last change stays at the next one.
        """
        ids = self._older.get(segment, False)
        if ids is False:
            if not segment or segment[0].isspace() or segment[-1].isspace():
                ids = None
            else:
                pieces = self.cut(" " + segment)
                ids = self.piece(pieces[0]) if len(pieces) == 1 else tuple(chain.from_iterable(map(self.piece, pieces)))
        if len(segment) <= _SHORT:
            if len(self._segments) >= REMEMBERED_SEGMENTS:
                self._older, self._segments = self._segments, {}
            self._segments[segment] = ids
        return ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """``encode`` of each text. What is not remembered is worked out together."""
        known, older = self._segments, self._older
        split = [text.split(" ") for text in texts]
        heads = [parts.pop(0) for parts in split]
        asked = set(chain.from_iterable(split)).difference(known)
        new = []
        for segment in asked:
            ids = older.get(segment, False)
            if ids is not False or not segment or segment[0].isspace() or segment[-1].isspace():
                known[segment] = ids or None
            else:
                new.append(segment)
        cut = self.cut(" " + " ".join(new)) if new else []
        pieces = self._pieces
        self._work_out(set(cut))
        found: list[tuple[int, ...]] = []
        for piece, ids in zip(cut, map(pieces.__getitem__, cut)):
            if piece[0] == " ":
                found.append(ids)
            else:
                found[-1] += ids
        known.update(zip(new, found, strict=True))
        for at, (text, head) in enumerate(zip(texts, heads)):
            parts = split[at] = list(map(known.__getitem__, split[at]))
            if not parts or not head or head[-1].isspace() or None in parts:
                head, split[at] = text, []
            heads[at] = self.cut(head)
        self._work_out(set(chain.from_iterable(heads)))
        out = [
            list(chain(chain.from_iterable(map(pieces.__getitem__, head)), chain.from_iterable(parts)))
            for head, parts in zip(heads, split)
        ]
        for memory, asked in ((known, new), (pieces, set(chain(cut, *heads)))):
            for text in asked:
                if len(text) > _SHORT:
                    del memory[text]
        if len(known) >= REMEMBERED_SEGMENTS:
            self._older, self._segments = known, {}
        if len(pieces) >= REMEMBERED_PIECES:
            self._older_pieces, self._pieces = pieces, {}
        return out

    def _work_out(self, asked: set[str]) -> None:
        """Remember the ids of matches of the pattern, of all that are not remembered together."""
        pieces, older, ranks = self._pieces, self._older_pieces, self.ranks
        texts, strings, held = [], [], 0
        for text in asked.difference(pieces):
            ids = older.get(text)
            if ids is None:
                data = text.encode()
                whole = ranks.get(data)
                if whole is None and len(data) <= LONGEST:
                    texts.append(text)
                    strings.append(data)
                    held += len(data)
                    if held >= TOGETHER:
                        pieces.update(zip(texts, self._together.encode(strings)))
                        texts, strings, held = [], [], 0
                    continue
                ids = (whole,) if whole is not None else tuple(self.walk(self.extend(data, [])))
            pieces[text] = ids
        if texts:
            pieces.update(zip(texts, self._together.encode(strings)))

    def settle(self) -> None:
        """Between tasks: keep what was asked for last, bounded in number, for the worker's next task."""
        self._older, self._older_pieces = {}, {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of each row; the digests are of the decimal ids joined
    by commas and of the bytes that decoding the ids gives. ``with_ids=False`` leaves the ids out.

    ``path`` must exist on every executor. A null text counts as empty: no tokens, and the digests of nothing. Rows
    with a null or repeated doc_id are encoded like any other; other columns are not read; texts are not shuffled.
    """

    def encode(batches):
        vocabulary = load(path, pattern)
        decimal = list(map(str, range(len(vocabulary.tokens))))
        for batch in batches:
            out = {"doc_id": [], "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            held = 0

            def taken():
                return {k: list(v) for k, v in out.items()}

            for first, stop in rows_of(batch, _ROWS, limit=_TEXT):
                part = batch.slice(first, stop - first)
                encoded = vocabulary.encode_all([text or "" for text in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    out["doc_id"].append(doc_id)
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids if with_ids else None)
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                    held += len(ids) if with_ids else 1
                    if held > 1 << 18:
                        yield taken()
                        held = 0
                        for column in out.values():
                            column.clear()
            yield taken()
        vocabulary.settle()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = "ids array<int>, " if with_ids else ""
    return in_batches(source, encode, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
