"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation within each format.

Values are found by pattern and kept only if they are valid: cards by their Luhn digit, IBANs by their check digits,
addresses by their octets, dates by the calendar. Hexadecimal secrets of 16 digits and more are found by the name that
is assigned them. Dates before 1900 or after 2099 stay; of dates with slashes the month comes first where that is a
date. A value becomes a whole number below the size of its format, the
number is permuted, and the result is written in the same format with check digits anew. The permutation depends on
the key and the kind alone, so equal values stay equal in all documents, in whatever grouping they are written.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import in_batches, rows_of

_ROUNDS, _LONGEST_WORD = 10, 64
#: Dates outside are left alone: they are rarely about a living person.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")
_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<phone>\+1 ?\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})"
    r"|(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\.\d)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\5\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r")(?!\w)"
)
_SECRET = re.compile(
    r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|secret[ _-]?key)[\"']?\s{0,8}[:=]\s{0,8}[\"']?"
    r"(?P<value>[0-9a-f]{16,})(?![a-z0-9])")
_HINT = re.compile(r"[@\d]|[:=]")


class Feistel:
    """Keyed permutations of range(n) for any n."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.sha256(key).digest(), kind.encode()[:16]

    def __call__(self, value: int, size: int) -> int:
        """Where ``value`` goes in range(``size``). Rounds run on two halves of bits; a result out of range goes on."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, wide, tweak = (1 << half) - 1, (half + 7) // 8, size.to_bytes(max(128, (size.bit_length() + 7) // 8), "big")
        while True:
            left, right = value >> half, value & mask
            for r in range(_ROUNDS):
                mixed = b"".join(
                    hashlib.blake2b(tweak + bytes((r, block)) + right.to_bytes(wide, "big"), key=self.key,
                                    person=self.kind.ljust(16)).digest() for block in range(wide // 64 + 1))
                left, right = right, left ^ int.from_bytes(mixed, "big") & mask
            value = left << half | right
            if value < size:
                return value


def _in_place(digits: str, shape: str) -> str:
    """``digits`` put where ``shape`` has digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _permuted_digits(digits: str, permute) -> str:
    return str(permute(int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""


def _permuted_word(text: str, permute) -> str:
    """ASCII letters and digits permuted within their class and case; other characters stay. A word longer than any
    address or account allows is permuted in parts, so that its cost grows with its length."""
    if len(text) > _LONGEST_WORD:
        return "".join(_permuted_word(text[i : i + _LONGEST_WORD], permute) for i in range(0, len(text), _LONGEST_WORD))
    size, value, radix = 1, 0, []
    for c in text:
        r = 10 if c.isascii() and c.isdigit() else 26 if c.isascii() and c.isalpha() else 0
        radix.append(r)
        if r:
            value = value * r + (ord(c.lower()) - (48 if r == 10 else 97))
            size *= r
    if size == 1:
        return text
    value = permute(value, size)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if radix[i]:
            value, at = divmod(value, radix[i])
            c = chr(at + (48 if radix[i] == 10 else 97))
            out[i] = c.upper() if text[i].isupper() else c
    return "".join(out)


def luhn_digit(payload: str) -> str:
    """Check digit of a number without it."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return str(98 - int(number) % 97).zfill(2)


def _email(text, permute):
    local, _, host = text.rpartition("@")
    labels = host.split(".")
    return f"{_permuted_word(local, permute)}@{'.'.join([*(_permuted_word(x, permute) for x in labels[:-1]), labels[-1]])}"


def _secret(text, permute):
    """Hexadecimal digits permuted in parts of 32; their case stays where all letters have one."""
    out = "".join(format(permute(int(part, 16), 16 ** len(part)), "x").zfill(len(part))
                  for part in (text[i : i + 32] for i in range(0, len(text), 32)))
    return out.upper() if text.upper() == text else out


def _card(text, permute):
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = _permuted_digits(digits[:-1], permute)
    return _in_place(payload + luhn_digit(payload), text)


def _phone(text, permute):
    # country code 1 has ten digits after it, in whatever grouping; other codes are what stands apart in front
    code = text.startswith("+1") and len(_digits(text)) == 11
    head = re.match(r"\+1" if code else r"\+\d{1,3}(?=[ .(-])", text)
    at = head.end() if head else 0
    digits = _digits(text[at:])
    if not 7 <= len(digits) <= 14:
        return None
    return text[:at] + _in_place(_permuted_digits(digits, permute), text[at:])


def _ipv4(text, permute):
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text, permute):
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = permute((area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(text, permute):
    parts = re.split(r"[./-]", text)
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    elif "/" in text:
        orders = [(2, 0, 1), (2, 1, 0)]
    else:
        orders = [(2, 1, 0)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        for i, value in zip(order, (new.year, new.month, new.day)):
            parts[i] = str(value).zfill(len(parts[i]) if len(parts[i]) > 1 else 1)
        marks = [c for c in text if c in "./-"]
        return parts[0] + marks[0] + parts[1] + marks[1] + parts[2]
    return None


def _iban(text, permute):
    plain = text.replace(" ", "")
    if len(plain) < 15 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = _permuted_word(plain[4:], permute)
    rest = iter(plain[:2] + iban_check(plain[:2], account) + account)
    return "".join(c if c == " " else next(rest) for c in text)


_KINDS = {"card": _card, "phone": _phone, "ipv4": _ipv4, "ssn": _ssn, "date": _date, "iban": _iban}


@functools.lru_cache(4)
def _permutations(key: bytes) -> dict[str, Feistel]:
    return {kind: Feistel(key, kind) for kind in ("email", "secret", *_KINDS)}


def pseudonymize(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with its valid values replaced, and ``(kind, start, end, pseudonym)`` of each in the given text."""
    if not text or not _HINT.search(text):
        return text, []
    permute = _permutations(key)
    found = []
    if "@" in text:
        found = [("email", m.start(), m.end(), _email(m[0], permute["email"])) for m in _EMAIL.finditer(text)]
    found += [("secret", m.start("value"), m.end("value"), _secret(m["value"], permute["secret"])) for m in _SECRET.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    at = next_taken = 0
    while m := _NUMBER.search(text, at):
        kind, end, new = m.lastgroup, m.end(), None
        while next_taken < len(taken) and taken[next_taken][1] <= m.start():
            next_taken += 1
        if next_taken == len(taken) or taken[next_taken][0] >= m.end():
            # numbers may follow one another: the longest valid run of groups counts
            for cut in [m.end(), *(m.start() + x.start() for x in reversed([*re.finditer(r"[ -]", m[0])]))]:
                new = _KINDS[kind](text[m.start() : cut], permute[kind])
                if new is not None or kind not in ("card", "iban"):
                    end = cut
                    break
            else:
                end = m.start() + len(re.match(r"\w+", m[0])[0])
        if new is not None:
            found.append((kind, m.start(), end, new))
        at = end
    found.sort(key=lambda x: x[1])
    out, last = [], 0
    for _, start, end, new in found:
        out += text[last:start], new
        last = end
    return "".join([*out, text[last:]]), found


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_values, spans`` of each row: the whole text with pseudonyms, and what stood where.

    ``spans`` gives kind, start and end (code points of the given text) and pseudonym, in order. A null text stays
    null and an empty one empty, both without spans. Texts are taken one by one, so rows that repeat or lack a doc_id
    are rows like any other; columns other than ``doc_id`` and ``text`` are not read. Texts are not shuffled.
    """

    def run(batches):
        for batch in batches:
            done = [pseudonymize(t, key) for t in batch.column("text").to_pylist()]
            yield {
                "doc_id": batch.column("doc_id"), "text": [t for t, _ in done], "n_values": [len(s) for _, s in done],
                "spans": [[dict(zip(("kind", "start", "end", "pseudonym"), x)) for x in s] for _, s in done],
            }

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(source, run, "doc_id long, text string, n_values long, "
                                   "spans array<struct<kind: string, start: int, end: int, pseudonym: string>>")


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with all its columns, ``text`` replaced by its pseudonymised form."""

    def hide(batches):
        for batch in batches:
            for first, end in rows_of(batch, 512):
                part = batch.slice(first, end - first)
                texts = [pseudonymize(t, key)[0] for t in part.column("text").to_pylist()]
                place = part.schema.get_field_index("text")
                yield part.set_column(place, "text", pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(hide, docs.schema)
