"""BPE encoding and decoding with a public vocabulary file, exact for unsplit words of any length.

A text is normalised, split into words by the file's pattern, and each word's symbols are merged. Words of a few symbols are merged directly and remembered; longer
ones by tree concatenation: both halves are encoded by themselves, then a window around the join, first one token a side, is encoded again and
grows on each side until its outer token there is the token that was there before. Any two neighbours of the result are then neighbours in a right
encoding of some stretch, which is what makes a whole encoding right, as every token comes from one merge only, later than those of its parts (checked when the file is read).

Texts with a stretch of ``long_word`` characters without a blank go another way, so that one task need not encode such a word alone: the word is cut into pieces,
Spark encodes the pieces of all words in parallel, and joins neighbours pairwise, round by round, until one is left of each word.

Defined results: null and empty texts, and those of nothing but white space, have no tokens. Every row is encoded by itself, so repeated rows and ids change nothing. A kept
column called ``ids`` (or, when decoding, ``decoded``) is replaced. Strings of the file's special tokens in a text are those tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from strom.llm.shared import map_arrow, small_batches
from strom.session import cut_lineage

# words of up to so many symbols are merged directly, and remembered
_DIRECT = 24
_REMEMBERED = 1 << 18
_LONG_WORD = 1 << 14
_NO_MERGE = 1 << 62
# beyond Latin letters with and without marks, and common punctuation
_RARER = re.compile("[^\x00-\u024f\u2010-\u2027]")


class _Remembered(dict):
    """Encodings of short words. Beyond its size it starts anew, and takes words that come again from what it held before."""

    def __init__(self, encode_word):
        super().__init__()
        self.encode_word, self.before = encode_word, {}

    def __missing__(self, word):
        found = self.before.get(word)
        if found is None:
            found = self.encode_word(word)
            if isinstance(word, int) or len(word) > _DIRECT:
                return found
        if len(self) >= _REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found


class Vocabulary:
    """Merges, tokens and split pattern of a vocabulary file with word ends."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        model = file["model"]
        self.tokens: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        # rank of a pair of tokens under one number for both, and what it becomes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        rank_of: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = self.tokens[left], self.tokens[right], self.tokens[left + right]
            if made in rank_of or max(rank_of.get(a, -1), rank_of.get(b, -1)) >= rank:
                raise ValueError("a token of this file has several merges, or is used before it is made")
            rank_of[made] = rank
            self.ranks[a << 32 | b] = rank
            self.made.append(made)
            self.parts[made] = (a, b)
        splits = file["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = specials
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        names = {**{i: t for t, i in self.tokens.items()}, **{i: s for s, i in specials.items()}}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())
        # printable stand-ins of all bytes, as byte-level files use them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = [self.tokens[shown[b]] for b in range(256)]
        self.last = [self.tokens[shown[b] + self.suffix] for b in range(256)]
        self._known = _Remembered(self.encode_word)
        # the library's own steps, for texts whose characters Python's tables may know otherwise
        self.exact = Tokenizer.from_str(content.decode())
        self.exact_split = pre_tokenizers.Split(Regex(splits[0]["pattern"]["Regex"]), "removed", invert=True)

    # -- words

    def _split(self, text: str) -> list[str]:
        """Words of composed, small characters. The versions of Unicode that Python and the file's library know differ in rarer characters."""
        if text.isascii() or not _RARER.search(text):
            return self.pattern.findall(text.lower())
        return [w for w, _ in self.exact_split.pre_tokenize_str(self.exact.normalizer.normalize_str(text))]

    def words(self, text: str) -> list[str | int]:
        """The words of a text in order, and the numbers of the special tokens it spells out."""
        if self.special is None or "<" not in text:
            return self._split(text)
        return [w for part in self.special.split(text) for w in ([self.specials[part]] if part in self.specials else self._split(part))]

    def symbols(self, word: str, whole: bool = True) -> list[int]:
        """The bytes of a word as tokens; the last one ends the word unless it goes on."""
        data, inner = word.encode(), self.inner
        found = [inner[b] for b in data]
        if whole and found:
            found[-1] = self.last[data[-1]]
        return found

    # -- merges

    def _apart(self, tokens: Sequence[int]) -> list[int]:
        """The symbols that tokens were merged from."""
        found, open_ = [], list(reversed(tokens))
        while open_:
            parts = self.parts.get(token := open_.pop())
            if parts is None:
                found.append(token)
            else:
                open_ += (parts[1], parts[0])
        return found

    def direct(self, symbols: Sequence[int]) -> list[int]:
        """All merges, the earliest of the file first and from left to right."""
        if len(symbols) > _DIRECT:
            return self._direct_long(symbols)
        tokens, rank, made = list(symbols), self.ranks.get, self.made
        ranks = [rank(a << 32 | b, _NO_MERGE) for a, b in zip(tokens, tokens[1:])]
        while ranks and (first := min(ranks)) < _NO_MERGE:
            at = ranks.index(first)
            tokens[at : at + 2] = (token := made[first],)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(tokens[at - 1] << 32 | token, _NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank(token << 32 | tokens[at + 1], _NO_MERGE)
        return tokens

    def _direct_long(self, symbols: Sequence[int]) -> list[int]:
        tokens, rank = list(symbols), self.ranks.get
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            first, i = heapq.heappop(heap)
            a, j = tokens[i], after[i]
            if a < 0 or j >= n or rank(a << 32 | tokens[j]) != first:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = self.made[first], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            h = before[i]
            for left, right in ((i, k), (h, i)):
                if left >= 0 and right < n and (r := rank(tokens[left] << 32 | tokens[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [t for t in tokens if t >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one word from theirs."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.direct(self._apart(left[-a:] + right[:b]))
            left_agrees = a == len(left) or window[0] == left[-a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_agrees else 2 * a, b if right_agrees else 2 * b

    def tree(self, symbols: Sequence[int]) -> list[int]:
        """Tree concatenation of any number of symbols."""
        done = [self.direct(symbols[i : i + _DIRECT]) for i in range(0, len(symbols), _DIRECT)]
        while len(done) > 1:
            done = [self.join(*done[i : i + 2]) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        return done[0] if done else []

    def encode_word(self, word: str | int) -> tuple[int, ...]:
        if isinstance(word, int):
            return (word,)
        symbols = self.symbols(word)
        return tuple(self.direct(symbols) if len(symbols) <= _DIRECT else self.tree(symbols))

    def encode_words(self, words: Sequence[str | int]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self._known.__getitem__, words)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_words(self.words(text))


_READ: dict[str, Vocabulary] = {}


class VocabularyFile:
    """A vocabulary file's content, sent to the tasks once; its size is that of the file. Workers read it once each."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        Vocabulary(content)  # refuses files that the method is not exact for
        self.digest = hashlib.sha256(content).hexdigest()
        self.content = spark.sparkContext.broadcast(content)

    def get(self) -> Vocabulary:
        if self.digest not in _READ:
            _READ[self.digest] = Vocabulary(self.content.value)
        return _READ[self.digest]


def _lists(found: Sequence[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, file: VocabularyFile, keep: Sequence[Column | str], text: str = "text", long_word: int = _LONG_WORD) -> DataFrame:
    """The columns ``keep`` of every row and its token numbers ``ids``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    kept = rows.schema["kept"].dataType
    # a word is no longer than the stretch between blanks that holds it
    has_long = F.coalesce((F.length("text") >= long_word) & F.col("text").rlike(r"\S{%d}" % long_word), F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = file.get()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([vocabulary.encode(t) for t in _texts(batch.column(1))])], names=["kept", "ids"])

    short = map_arrow(rows.where(~has_long), whole, f"kept {kept.simpleString()}, ids array<int>")
    long = _encode_long(rows.where(has_long), file, long_word)
    return short.unionByName(long).select(*(F.col("kept").getField(c).alias(c) for c in kept.names if c != "ids"), "ids")


_PIECES = "row bigint, place bigint, piece int, text string, last boolean, ids array<int>"


def _encode_long(rows: DataFrame, file: VocabularyFile, long_word: int) -> DataFrame:
    """As ``encode``: words of more than ``long_word`` characters in pieces, tree round by tree round; the rest of each text in stretches between them."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = file.get()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                out, between = [], []
                for word in [*vocabulary.words(text), None]:
                    if word is None or (isinstance(word, str) and len(word) > long_word):
                        ids = vocabulary.encode_words(between)
                        out.append((row, len(out), 0, None, True, ids))
                        between = []
                        if word is not None:
                            place = len(out)
                            starts = range(0, len(word), long_word)
                            out += [(row, place, i, word[at : at + long_word], at + long_word >= len(word), None) for i, at in enumerate(starts)]
                    else:
                        between.append(word)
                for at in range(0, len(out), 64):
                    columns = list(zip(*out[at : at + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int32())))],
                        names=["row", "place", "piece", "text", "last", "ids"],
                    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = file.get()
        for batch in batches:
            done = [np.array(vocabulary.tree(vocabulary.symbols(t, last)), np.int32) for t, last in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(done)], names=["row", "place", "piece", "ids"])

    def join_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = file.get()
        for batch in batches:
            pairs = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            done = [np.array(vocabulary.join(a, b) if b is not None else a, np.int32) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(done)], names=["row", "place", "piece", "ids"])

    parts = cut_lineage(map_arrow(rows.select("row", "text"), cut, _PIECES))
    schema = "row bigint, place bigint, piece int, ids array<int>"
    pieces = parts.where("ids is null").repartition("row", "place", "piece").select("row", "place", "piece", "text", "last")
    words = cut_lineage(map_arrow(pieces, encode_pieces, schema))
    most = words.agg(F.max("piece")).first()[0] or 0
    while most > 0:
        at = F.shiftright("piece", 1).alias("piece")
        left = words.where("piece % 2 = 0").select("row", "place", at, F.col("ids").alias("a"))
        right = words.where("piece % 2 = 1").select("row", "place", at, F.col("ids").alias("b"))
        words = cut_lineage(map_arrow(left.join(right, ["row", "place", "piece"], "left"), join_pairs, schema))
        most >>= 1
    stretches = parts.where("ids is not null").select("row", "place", "ids").unionByName(words.select("row", "place", "ids"))
    # the stretches of one text together are as long as that text
    whole = stretches.groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.struct("place", "ids"))).getField("ids")).alias("ids"))
    return rows.select("row", "kept").join(whole, "row").select("kept", "ids")


def decode(tokens: DataFrame, file: VocabularyFile, keep: Sequence[Column | str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of every row and ``decoded``: its tokens' strings joined by blanks, as the file names no decoder. Null ids give an empty text."""
    rows = tokens.select(F.struct(*keep).alias("kept"), F.col(ids).alias("ids"))
    kept = rows.schema["kept"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = file.get().names
        for batch in batches:
            column = batch.column(1)
            lists = pa.ListArray.from_arrays(column.offsets, names.take(column.values)) if column.offset == 0 else pa.array(
                [names.take(pa.array(x or [], pa.int32())) for x in column.to_pylist()], pa.list_(pa.large_string()))
            lists = lists.cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_join(lists, " "), "")], names=["kept", "decoded"])

    out = map_arrow(rows, work, f"kept {kept.simpleString()}, decoded string")
    return out.select(*(F.col("kept").getField(c).alias(c) for c in kept.names if c != "decoded"), "decoded")


def token_digests(docs: DataFrame, file: VocabularyFile) -> DataFrame:
    """Digests of the token numbers and of the decoded text of every document."""
    tokens = encode(docs, file, ["doc_id"])
    decoded = decode(tokens, file, ["doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256")])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
