import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sigspark.llm import bpe, decontaminate, html, language, pii, words
from sigspark.llm.queries import VOCABULARY
from sigspark.llm.tables import remainder, remainder_of


def test_words_and_shingles():
    texts = ["A b\tC", None, "", " x ", "ÄB\x0bäb a b", "a b"]
    hashes, at = words.words(pa.array(texts))
    got = [[int(h) for h in hashes[at[i] : at[i + 1]]] for i in range(len(texts))]
    want = [["a", "b", "c"], [], [], ["x"], ["Äb", "äb", "a b"], ["a", "b"]]
    assert got == [[words.hash_of(w) for w in x] for x in want]
    assert len(words.shingles(hashes[:3], 3)) == 1 and len(words.shingles(hashes[:2], 3)) == 1
    assert words.shingles(hashes[:2], 3)[0] != words.shingles(hashes[:3], 3)[0]
    plain, at = words.words(pa.array(["don't, Stop!!"]), plain=True)
    assert [int(h) for h in plain] == [words.hash_of(w) for w in ("don", "t", "stop")]


def test_remainder(spark):
    df = spark.createDataFrame([(1,), (77,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(remainder("doc_id", 5)).collect()]
    assert got == [remainder_of(x, 5) for x in (1, 77, None)] and got[1] == zlib.crc32(b"77") % 5


# --- byte BPE ---


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_encoding_equals_the_library(vocabulary, library):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("aab eth  \n\t'sreéß漢🙂12_-.  ") for _ in range(rng.randrange(60)))
        assert vocabulary.encode(text) == library.encode_ordinary(text), repr(text)
        assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


def test_a_word_is_worked_out_once(vocabulary, library, monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

    word = "qzvnoteltrugenischaftabel"
    texts = ["start " + " ".join(word + sign * n for n in range(1, 9)) for sign in ".,!?;:"]
    fresh = bpe.Vocabulary(Counted(vocabulary.ranks), public_tokenizers.PATTERN)
    Counted.asked = 0
    assert fresh.encode(f"start {word}") == library.encode_ordinary(f"start {word}")
    once = Counted.asked
    assert [fresh.encode(x) for x in texts] == [library.encode_ordinary(x) for x in texts]
    # the 48 signs are looked up; the word before them is not
    assert Counted.asked < once + 48 * 12
    # memories that fill up and start anew change nothing
    for name in ("REMEMBERED_HEADS", "REMEMBERED_PIECES", "REMEMBERED_SEGMENTS"):
        monkeypatch.setattr(bpe, name, 3)
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choice("etaoinshré") for _ in range(rng.randrange(1, 24))) for _ in range(5))
        assert fresh.encode(text) == library.encode_ordinary(text), repr(text)


def test_texts_are_encoded_together(vocabulary, library, monkeypatch):
    rng = random.Random(6)
    plain = lambda n: "".join(rng.choice("etaoinshréß漢") for _ in range(n))
    odd = lambda: "".join(rng.choice("aab eth  \n\t'sreéß漢🙂12_-.\x1c\x85 ") for _ in range(rng.randrange(60)))
    texts = [" ".join(plain(rng.randrange(1, 20)) + rng.choice(["", ".", ",\n"]) for _ in range(40)) for _ in range(60)]
    texts += [odd() for _ in range(400)] + ["", " ", "  a", "b  ", plain(90), plain(400) + " " + plain(600), "x\n\ny 's 's"]
    want = [library.encode_ordinary(x) for x in texts]
    fresh = bpe.Vocabulary(vocabulary.ranks, public_tokenizers.PATTERN)
    calls, encode = [], bpe.Together.encode
    monkeypatch.setattr(bpe.Together, "encode", lambda self, x: calls.append(len(x)) or encode(self, x))
    assert fresh.encode_all(texts) == want
    # thousands of words in a few calls, and no word by itself but the one longer than LONGEST bytes
    assert sum(calls) > 1500 and len(calls) <= 3 and not fresh._heads
    calls.clear()
    assert fresh.encode_all(texts) == want and sum(calls) < 200
    assert [fresh.encode(x) for x in texts] == want
    # memories that fill up and start anew change nothing
    for name in ("REMEMBERED_PIECES", "REMEMBERED_SEGMENTS", "TOGETHER"):
        monkeypatch.setattr(bpe, name, 30)
    monkeypatch.setattr(bpe, "FIT_BITS", 3)
    fresh = bpe.Vocabulary(vocabulary.ranks, public_tokenizers.PATTERN)
    for at in range(0, len(texts), 7):
        assert fresh.encode_all(texts[at : at + 7]) == want[at : at + 7]
    assert max(map(len, (*fresh._older, *fresh._older_pieces))) <= 32
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0, b" ": 1}, public_tokenizers.PATTERN).encode_all(["a ab"])


def test_appends_and_edits_are_exact(vocabulary):
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdethe ing") for _ in range(rng.randrange(1, 200)))
        last = vocabulary.extend(data, [])
        more = data + b"the thing"
        assert vocabulary.extend(more, list(last)) == vocabulary.extend(more, [])
        a = rng.randrange(len(data))
        b = rng.randrange(a, len(data) + 1)
        after, table = vocabulary.edited(data, last, a, b, bytes(rng.choice(b"things") for _ in range(rng.randrange(9))))
        assert table == vocabulary.extend(after, [])
        assert b"".join(vocabulary.tokens[t] for t in vocabulary.walk(table)) == after


def test_odd_documents_are_encoded(odd_documents, no_documents, library):
    got = bpe.encode_documents(odd_documents, VOCABULARY, public_tokenizers.PATTERN).collect()
    want = sorted((r["doc_id"] or -1, tuple(library.encode_ordinary(r["text"] or ""))) for r in odd_documents.collect())
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in got) == want
    assert bpe.encode_documents(no_documents, VOCABULARY, public_tokenizers.PATTERN).count() == 0


# --- language ---


def test_language_of_odd_documents(odd_documents, no_documents):
    profiles = language.learn_profiles(odd_documents)
    assert set(profiles) == {"en", "de"}  # the French row has no letter
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd_documents, profiles).collect()]
    assert all(0 <= s <= 1 for _, _, s in got)
    assert {d: x for d, x, _ in got if d in (2, 3, 4, 5, 8, 10)} == {2: "en", 3: "und", 4: "und", 5: "und", 8: "und", 10: "de"}
    kept = language.keep_identified(odd_documents, F.lit(True))
    assert kept.columns == odd_documents.columns and kept.count() == 9
    assert language.learn_profiles(no_documents) == {}
    assert {r["lang_pred"] for r in language.identify(odd_documents, {}).collect()} == {"und"}
    assert language.keep_identified(no_documents, F.lit(True)).count() == 0


def test_distance_is_the_sum_of_rank_differences():
    own, other = np.array([5, 9, 7], np.uint32), np.array([9, 5, 1], np.uint32)
    order = np.argsort(other)
    assert language.distances(own, [(other[order], order)], 10) == [(1 + 1 + 10) / 30]


# --- personal data ---


def test_values_keep_their_format_and_links():
    def hidden(text):
        return pii.pseudonymize(text, b"key")

    card, spaced = hidden("4111111111111111")[0], hidden("x 4111 1111 1111 1111.")[0]
    assert card != "4111111111111111" and pii.luhn_digit(card[:-1]) == card[-1]
    assert spaced[2:-1].replace(" ", "") == card
    assert hidden("4111111111111112 999.1.1.1 30.02.2001 666-11-1111")[1] == []
    iban = hidden("DE89 3704 0044 0532 0130 00")[0]
    assert iban[:2] == "DE" and pii.iban_check("DE", iban.replace(" ", "")[4:]) == iban[2:4] and len(iban) == 27
    assert hidden("1980-02-29")[0][:10] != "1980-02-29"
    assert hidden("29.02.1980")[0] == "{2}.{1}.{0}".format(*hidden("1980-02-29")[0].split("-"))
    assert [s[0] for s in hidden("+1 (212) 555-0100 4111111111111111 1.2.3.4 a.b@c.org")[1]] == ["phone", "card", "ipv4", "email"]
    text, spans = hidden("mail x.9@site3.example.com, 4111111111111111 48451681144")
    assert [s[0] for s in spans] == ["email", "card"] and text.endswith(" 48451681144") and ".com," in text
    assert hidden("nothing here")[0] == "nothing here" and hidden(None) == (None, [])


def test_long_addresses_secrets_and_phone_links():
    def hidden(text):
        return pii.pseudonymize(text, b"key")[0]

    for text in ("x" * 10_000 + "@example.org", "a.b" * 5000 + "@site.org", "u@" + "y" * 300 + ".org", "q" * 1_000_000 + "@a.org"):
        new = hidden(text)
        assert len(new) == len(text) and new != text and new.rsplit(".", 1)[1] == "org" and new.count("@") == 1
    one, two, three = (hidden(t) for t in ("+12125550199", "+1 212 555 0199", "call +1 (212) 555-0199 now"))
    assert one != "+12125550199" and len({"".join(c for c in x if c.isdigit()) for x in (one, two, three)}) == 1
    assert one.startswith("+1") and two.startswith("+1 ") and three.startswith("call +1 (")
    token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    for form, value in (('token = "%s" end', token), ("API_KEY:%s", token), ("TOKEN = '%s'!!", token.upper()), ("password=%s", token[:16])):
        new = hidden(form % value)
        found = re.search("[0-9a-fA-F]{16,}", new)[0]
        assert found != value and len(found) == len(value) and new == form % found and found.isupper() == value.isupper()
        assert hidden("x " + form % value) == "x " + new
    assert hidden(f"commit {token}") == f"commit {token}" and hidden("secret: none given") == "secret: none given"
    assert hidden("born 12.05.1899") == "born 12.05.1899"


def test_hidden_values_equal_a_plain_permutation_of_what_patterns_find():
    """Brute force: every substring that the format's own rules accept, replaced by cycle-walking a plain Feistel."""
    def plain(kind, value, size):
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        key = hashlib.sha256(b"key").digest()
        while True:
            left, right = value >> half, value % (1 << half)
            for r in range(10):
                mixed = hashlib.blake2b(size.to_bytes(128, "big") + bytes((r, 0)) + right.to_bytes((half + 7) // 8, "big"), key=key,
                                        person=kind.encode().ljust(16)).digest()
                left, right = right, left ^ int.from_bytes(mixed, "big") % (1 << half)
            value = left * (1 << half) + right
            if value < size:
                return value

    rng = random.Random(5)
    for _ in range(60):
        octets = [rng.randrange(256) for _ in range(4)]
        text = ".".join(map(str, octets))
        new = plain("ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32).to_bytes(4, "big")
        assert pii.pseudonymize(f"at {text} now", b"key")[0] == f"at {'.'.join(map(str, new))} now"
        payload = "".join(rng.choices("0123456789", k=15))
        card = payload + pii.luhn_digit(payload)
        new = str(plain("card", int(payload), 10**15)).zfill(15)
        assert pii.pseudonymize(card, b"key")[0] == new + pii.luhn_digit(new)


@pytest.mark.parametrize("size", [2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    permute = pii.Feistel(b"k", "card")
    assert sorted(permute(i, size) for i in range(size)) == list(range(size))


def test_odd_documents_are_pseudonymised(odd_documents, no_documents):
    got = {(r["doc_id"], r["text"]) for r in pii.pseudonymized(odd_documents, b"k").collect()}
    given = {(r["doc_id"], r["text"]) for r in odd_documents.collect()}
    assert {x for x in got ^ given} == {x for x in got | given if x[0] == 10}
    changed = pii.with_pseudonyms(odd_documents, b"k")
    assert changed.columns == odd_documents.columns and changed.count() == odd_documents.count()
    assert pii.pseudonymized(no_documents, b"k").count() == 0


# --- decontamination ---


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of"] * 40 + [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 20, 50, 150])))) for i in range(60)]
    docs, want = [], set()
    for d in range(120):
        own = rng.choices(vocabulary, k=rng.choice([3, 60, 500, 1500]))
        if d % 3 == 0:
            item, text = rng.choice(items)
            at = rng.randrange(len(own))
            own[at:at] = text.upper().split()
            want.add((d, item))
        elif d % 3 == 1:
            own += rng.choice(items)[1].split()[:4]
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (None, "a b c")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    clean = {r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_retrieval_is_exact():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(120)]
    index = decontaminate.Index([(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(80)])
    hashes, at = words.words(pa.array([" ".join(rng.choices(vocabulary, k=200)) for _ in range(20)]))
    got = {(r, p, q): s for r, p, q, s in zip(*map(np.ndarray.tolist, index.retrieved(hashes, at)))}
    want = {}
    for row in range(20):
        own = hashes[at[row] : at[row + 1]]
        for p in range(0, -(-len(own) // decontaminate.STRIDE)):
            seen = own[p * decontaminate.STRIDE : p * decontaminate.STRIDE + decontaminate.PASSAGE]
            for part in range(80):
                span = slice(index.part_first[part], index.part_first[part + 1])
                s = index.part_impacts[span][np.isin(index.terms[index.part_terms[span]], seen)].sum()
                if s >= decontaminate.RETRIEVE:
                    want[row, p, part] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_odd_documents_against_an_item(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(7, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_documents, bench).collect()), key=str)
    assert got == [(1, 7), (2, 7), (9, 7), (None, 7)]
    assert decontaminate.keep_clean(odd_documents, bench).count() == odd_documents.count() - 5
    assert decontaminate.contaminated(no_documents, bench).count() == 0
    assert decontaminate.contaminated(odd_documents, bench.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd_documents, bench.limit(0)).count() == odd_documents.count()


# --- html ---


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"),
    ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One<br>two&nbsp;&eacute; <b>x<p>y</article><footer>f</footer>",
     "T\n\nOne two é x\n\ny"),
    ("<div class=ad>Buy<article><p>Hi</article>", "Hi"),
    ("<article><p>Text, of some, length.</p><div id='comments'><p>I, a, reader, think, so.</p></div></article>",
     "Text, of some, length."),
    ("<body><div class='cookie-notice'>We, use, cookies</div><div class=post-content><header><h1>H</h1></header><p>A, b, c"
     "</p></div><aside>Side</aside><form>Mail <input></form><script>var t='</p>';</script></body>", "H\n\nA, b, c"),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_odd_pages(spark):
    long = "<article>" + "<p>para, graph</p>" * 5000 + "</article>" + "<" * 1000
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, None), (2, None, "", 2), (3, "v", long, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in html.extract(pages).collect())
    n = 5000 * len("para, graph") + 4999 * 2
    assert got[:4] == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0)] and got[4][0] == 3 and got[4][1] >= n
    assert html.extract(pages.limit(0)).count() == 0


def test_blocks_are_skipped_in_a_large_benchmark():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for i in range(1500)]
    index = decontaminate.Index(items)
    blocks = -(-len(index.of_item) // decontaminate._BLOCK)
    assert len(index.of_item) > 1024 and len(index.rest_most) == blocks
    # a run's impact bounds the impacts of its postings, which are all there
    sizes = np.diff(index.run_first)
    assert sizes.sum() == len(index.post_part) and (np.repeat(index.run_most, sizes) >= index.post_impact).all()
    texts = [" ".join(rng.choices(items, k=4)[j][1] for j in range(4)) for _ in range(20)]
    hashes, at = words.words(pa.array(texts))
    got = {(int(r), int(p), int(q)) for r, p, q, _ in zip(*index.retrieved(hashes, at))}
    want = set()
    for i in range(len(texts)):
        own = hashes[at[i] : at[i + 1]]
        for p in range(-(-len(own) // decontaminate.STRIDE)):
            seen = np.isin(index.terms, own[p * decontaminate.STRIDE : p * decontaminate.STRIDE + decontaminate.PASSAGE])
            for q in range(len(index.of_item)):
                has = slice(index.part_first[q], index.part_first[q + 1])
                if index.part_impacts[has][seen[index.part_terms[has]]].sum() >= decontaminate.RETRIEVE:
                    want.add((i, p, q))
    assert got == want and len(want) >= 20


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{int(rng.random() ** 3 * 400)}" for _ in range(rng.choice([9, 20, 90])))) for i in range(60)]
    items += [(3, items[3][1]), (70, ""), (None, "w1 w2"), (71, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(items[i][1].split()[:60]) + " and more") for i in range(40)], "doc_id long, text string")

    def found():
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["word"]) for r in decontaminate.contaminated(docs, bench).collect())

    whole = found()
    clean = decontaminate.keep_clean(docs, bench).count()
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", 16)
    assert found() == whole and len(whole) >= 20
    assert decontaminate.keep_clean(docs, bench).count() == clean
