"""Operators 11 to 13: against the tokenizers library, a plain integer fit and a brute-force search, and their edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strom.llm import bpe, runs, vector_codes
from strom.llm.hilbert import hilbert_keys
from strom.llm.registry import all_queries
from strom.llm.wavelet import WaveletMatrix
from tests.harness import SF_DIR

FILE = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("1 as ids", "'x' as kept", "2L as row", "3 as runs", "'k' as decoded", "4 as point", "5 as text_", "6 as part", "7 as _best")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(FILE, "rb").read())


def test_merges_of_any_text_are_the_librarys(library, vocabulary):
    draw = random.Random(3)
    texts = ["", " ", "It's we'll DON'T 3,14", "ΑΣ Σ", "ǅ İ ẞ é", "日本語 テスト 😀😀 é", "<|endoftext|>x<|startoftext|><|endoftext", "a b c\x85d\x1ce"]
    texts += ["".join(draw.choice("abeht") for _ in range(n)) for n in (24, 25, 48, 49, 1000, 5001)] + [c * n for c in ("a", "th", "!", "é") for n in (23, 24, 26, 3000)]
    texts += ["".join(chr(draw.choice((draw.randrange(0x250), draw.randrange(0xD800), draw.randrange(0xE000, 0x20000)))) for _ in range(200)) for _ in range(60)]
    for text in texts:
        assert vocabulary.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_join_grows_its_window_until_both_sides_agree(vocabulary):
    # an odd number of letters on the left moves every boundary of the right
    for left, right in (("a" * 31, "a" * 64), ("ab" * 40, "b" * 3), ("x" * 7, "y" * 7)):
        a, b = vocabulary.tree(vocabulary.symbols(left, False)), vocabulary.tree(vocabulary.symbols(right))
        assert vocabulary.join(a, b) == vocabulary.direct(vocabulary.symbols(left + right))
    assert vocabulary.join([], [5]) == [5] and vocabulary.tree([]) == []


def test_long_words_are_encoded_in_pieces(spark, library):
    draw = random.Random(4)
    word = "".join(draw.choice("abcdefgh") for _ in range(2_000))
    texts = [None, "", "  ", "short text", f"before {word} between {word}! {word[:50]}", "a" * 999, "é" * 700 + "1" * 300, word[:129], "one <|endoftext|>" + word, "short text"]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id bigint, text string").selectExpr("*", *CLASH)
    file = bpe.VocabularyFile(spark, FILE)
    found = bpe.encode(docs, file, docs.columns, long_word=64).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in [*texts, "no id"]]
    assert sorted((r.text or "", r.ids) for r in found) == sorted(zip([t or "" for t in [*texts, "no id"]], want))
    assert {r.doc_id for r in found} == {*range(9), None} and found[0].kept == "x"
    back = bpe.decode(bpe.encode(docs, file, ["text"], long_word=64), file, ["text", "ids"]).collect()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in back)
    assert bpe.encode(docs.limit(0), file, ["doc_id"]).count() == 0


def test_bpe_query_is_the_librarys(spark, library):
    found = {r.doc_id: r for r in all_queries()["op11_bpe"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = found.pop(r.doc_id)
        assert (got.n_tokens, got.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert not found


# -- 12


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector) by id -> codebooks, codes and errors by plain loops over all entries."""
    x = np.array([np.floor(np.float64(v) * 4096).astype(np.int64) for _, v in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        distance = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        nearest = distance.argmin(2)
        if turn == rounds:
            return books, nearest, distance.min(2).sum(1)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[nearest[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((1, 4), (2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    draw = np.random.default_rng(2)
    for _ in range(200):
        x, entries = draw.integers(-9, 9, (30, 3)), draw.integers(-9, 9, (6, 3))
        listed = vector_codes.shortlists(x.min(0)[None], x.max(0)[None], entries)[0]
        assert listed[((x[:, None] - entries) ** 2).sum(2).argmin(1)].all()


def test_vector_codes_equal_a_plain_fit(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 0.4, (5, 16))
    vectors = [(i, (centres[i % 5] + draw.normal(0, 0.02 if i % 2 else 0.3, 16)).astype(np.float32).tolist()) for i in range(900)]
    vectors += [(2_000 + i, vectors[3][1]) for i in range(700)]  # one common vector fills blocks
    bad = [(-1, None), (-2, [None] * 16), (-3, [float("nan")] + [0.0] * 15), (-4, [float("inf")] * 16)]
    made = spark.createDataFrame([(i, v, None if i % 7 == 0 else i % 3) for i, v in vectors + bad], "vec_id bigint, embedding array<float>, label int").selectExpr("*", *CLASH)
    found = {r.vec_id: r for r in vector_codes.code_table(made.repartition(5)).collect()}
    rows = sorted((i, np.float32(v)) for i, v in vectors)
    books, codes, errors = plain_codes(rows)
    assert set(found) == {i for i, _ in rows}
    by_label = {}
    for (i, _), e in zip(rows, errors):
        key = None if i % 7 == 0 else i % 3
        by_label[key] = by_label.get(key, 0) + int(e)
    for (i, _), c, e in zip(rows, codes, errors):
        assert (found[i].code, found[i].error) == ("".join(f"{k:02x}" for k in c), e)
        assert found[i].label_error == by_label[None if i % 7 == 0 else i % 3]
    assert found[0].codebooks_sha256 == sha(",".join(map(str, books.ravel().tolist())))


def test_vector_codes_edge_cases(spark):
    def table(rows):
        return vector_codes.code_table(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))

    assert table([]).count() == 0 and table([(1, None, 1)]).count() == 0
    few = table([(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [-0.5] * 8, None)]).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in few) == [(0, "02" * 8, 0, 0)] + [(1, "00" * 8, 0, 0)] * 2
    for rows in ([(1, [0.5] * 7, 1)], [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)]):
        with pytest.raises(ValueError):
            table(rows)
    with pytest.raises(Exception, match="too large"):
        table([(1, [1e30] * 8, 1)]).collect()


# -- 13


def plain_runs(w, shortest=12):
    """(start, length, period) of all runs by comparing every word with the one each period before it."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i - q, j), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_wavelet_queries():
    draw = np.random.default_rng(5)
    for n, limit in ((1, 1), (70, 70), (500, 9), (1000, 4000)):
        values = draw.integers(0, limit, n)
        tree = WaveletMatrix(values, limit)
        low = draw.integers(0, n, 50)
        high, bound = low + draw.integers(0, n - low + 1), draw.integers(0, limit + 3, 50)
        assert tree.count_below(low, high, bound).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(low, high, bound)]
        low, high = low[high > low], high[high > low]
        nth = (high - low) // 2
        assert tree.smallest(low, high, nth).tolist() == [np.sort(values[a:b])[k] for a, b, k in zip(low, high, nth)]


def test_every_run_holds_the_block_that_finds_it():
    for q in range(1, 300):
        size = 1 << runs.block_level(q)
        assert 2 * size - 1 + q <= max(12, 2 * q) < 4 * size - 1 + q
    for longest in (1, 6, 7, 100, 1000):
        windows = runs._windows(longest, 12)
        assert [q for _, low, high in windows for q in range(low, high + 1)] == list(range(1, longest + 1))
        assert all(runs.block_level(q) == level for level, low, high in windows for q in range(low, high + 1))


def test_runs_equal_brute_force():
    draw = random.Random(6)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            n, letters = draw.randint(0, 120), draw.randint(1, 3)
            w = [draw.randint(0, letters) for _ in range(n)]
            if n > 4 and draw.random() < 0.7:
                a = draw.randrange(n)
                p = draw.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        first = np.cumsum([0, *map(len, texts)])
        got = runs.find_runs(np.array([x for w in texts for x in w], int), first)
        want = [(s + a, s + a + n, q) for w, a in zip(texts, first) for s, n, q in sorted(plain_runs(w), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in got.tolist()] == want


def test_long_progressions_of_occurrences():
    for words in ([0] * 3000, [0, 1] * 1500, ([0] * 700 + [1]) * 4, list(range(700)) * 4, [0, 1] * 300 + [0] + [0, 1] * 300):
        got = runs.find_runs(np.array(words), np.array([0, len(words)]))
        assert [(s, e - s, q) for s, e, q in got.tolist()] == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def check_rows(found, docs):
    want = []
    for doc_id, text in docs:
        w = planted(doc_id, text)
        all_runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in all_runs for i in range(s + q, s + n)}
        best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((doc_id, len(all_runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in all_runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))


def test_runs_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) < 9000 or text is null").collect()]
    ids = {i for i, _ in docs}
    found = [r for r in all_queries()["op13_runs"](spark, SF_DIR).collect() if r.doc_id in ids]
    assert len(found) > 150
    check_rows(found, docs)


def test_runs_edge_cases(spark):
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 30), (5, "x y " * 40), (5, "x y " * 40), (-4, "é 😀 z " * 9), (6, "one two\x0bthree"), (tens[0], None), (tens[1], "   ")]
    docs += [(i, " ".join(random.Random(i).choice("abc") for _ in range(i))) for i in tens[2:]]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", *CLASH)
    texts = runs.repeat_tails(F.col("doc_id"), F.col("text"))
    check_rows(runs.run_digests(runs.periodic_runs(table, ["doc_id"], texts)).collect(), docs)
    assert runs.periodic_runs(table.limit(0), ["doc_id"]).count() == 0
    kept = runs.periodic_runs(table, table.columns).where("text like 'x y%'").first()
    assert kept.kept == "x" and kept.collapsed == "x y" and [tuple(r) for r in kept.runs] == [(0, 80, 2)]
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(20, int), np.array([0, 20]), 5)
