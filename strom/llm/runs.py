"""Periodic runs of words: maximal stretches that repeat a period at least twice, found by internal pattern matching.

The texts of a batch are ranked by prefix doubling: ``ranks[k][i]`` names the 2**k words at i, alike for equal words of one text. Every run of
period q and its required length holds, in its first words, an aligned (dyadic) block that occurs again q words later; how long the block is
follows from q alone. So each block is looked up in the window of the offsets its length stands for, by range successor in a wavelet tree over
the suffix array. A block's occurrences within half its length form an arithmetic progression: the first, the second and the last of them give
all. Each offset is a candidate period, which the ranks extend to both sides; stretches that reach the length are runs, and of the
periods found for one stretch the smallest is its period.

Defined results: null, empty and blank texts have no words and no runs. Rows are judged one by one, so repeated rows, repeated ids and null ids
change nothing. Kept columns may have any names but ``runs`` and ``collapsed``, which the result replaces. A text of n words takes about
100 bytes a word in the task that holds its row, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import map_arrow, small_batches
from strom.llm.wavelet import WaveletMatrix

SHORTEST = 12
_WORDS_AT_ONCE = 1 << 18


class _Factors:
    """Equal factors of 2**k words inside each text, and the suffix array of those that occur more than once."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.n, self.begin, self.end = n, first[text], first[text + 1]
        key = text * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        self.ranks: list[np.ndarray] = []
        self.suffixes = order
        open_slots = self._rank(np.arange(n), order, key[order], np.zeros(n, np.int32))
        half = 1
        while len(open_slots):
            at, known = self.suffixes[open_slots], self.ranks[-1]
            behind = at + half
            inside = behind < self.end[at]
            key = known[at].astype(np.int64) * (n + 1)
            key[inside] += known[behind[inside]] + 1
            order = np.argsort(key, kind="stable")
            self.suffixes[open_slots] = at[order]
            open_slots = self._rank(open_slots, at[order], key[order], known.copy())
            half *= 2

    def _rank(self, slots: np.ndarray, at: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Names each class after its first place in the suffix array; gives the places of classes of two and more."""
        if not len(slots):
            self.ranks.append(ranks)
            return slots
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        ranks[at] = slots[head]
        self.ranks.append(ranks)
        alone = new.copy()
        alone[:-1] &= new[1:]
        return slots[~alone]

    def equal_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (a < b, one text) are the same."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ranks, size = self.ranks[k], 1 << k
            fits = b + found + size <= self.end[b]
            i, j = np.where(fits, a + found, 0), np.where(fits, b + found, 0)
            found += np.where(fits & (ranks[i] == ranks[j]), size, 0)
        return found

    def equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words just before a and just before b are the same."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ranks, size = self.ranks[k], 1 << k
            fits = a - found - size >= self.begin[a]
            i, j = np.where(fits, a - found - size, 0), np.where(fits, b - found - size, 0)
            found += np.where(fits & (ranks[i] == ranks[j]), size, 0)
        return found


def block_level(period: int, shortest: int = SHORTEST) -> int:
    """Every run of this period holds an aligned block of 2**level words that occurs again one period later."""
    spare = max(shortest, 2 * period) - period
    return ((spare + 1) // 2).bit_length() - 1


def _windows(longest: int, shortest: int) -> list[tuple[int, int, int]]:
    """(level, first offset, last offset): the periods up to ``longest`` by the block that finds them."""
    found, low = [], 1
    while low <= longest:
        level, high = block_level(low, shortest), low
        if low >= shortest:  # from here on only the period decides: a level serves 2 * size - 1 to 4 * size - 2
            high = (4 << level) - 2
        while block_level(high + 1, shortest) == level and high < longest:
            high += 1
        found.append((level, low, min(high, longest)))
        low = high + 1
    return found


def _occurrences(factors: _Factors, places: "_Places", level: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, offset) pairs: aligned blocks of 2**level words that occur again ``low`` to ``high`` words later."""
    size, ranks = 1 << level, factors.ranks[level]
    blocks = np.arange(0, factors.n, size)
    blocks = blocks[blocks + low + size <= factors.end[blocks]]
    if low == high or level < 2:
        for offset in range(low, high + 1):
            inside = blocks[blocks + offset + size <= factors.end[blocks]]
            inside = inside[ranks[inside] == ranks[inside + offset]]
            yield inside, np.full(len(inside), offset)
        return
    blocks, left, right = places.classes(level, blocks)
    tree = places.tree
    below = lambda at, cut: tree.count_below(left[at], right[at], np.minimum(cut, factors.n))
    every = np.arange(len(blocks))
    some = every[below(every, blocks + low) < below(every, blocks + high + 1)]
    step = max(1, size // 2)
    for start in range(low, high + 1, step):
        stop = min(high + 1, start + step)
        lower = below(some, blocks[some] + start)
        count = below(some, blocks[some] + stop) - lower
        at, lower, count = some[count > 0], lower[count > 0], count[count > 0]
        if not len(at):
            continue
        first = tree.smallest(left[at], right[at], lower)
        last = tree.smallest(left[at], right[at], lower + count - 1)
        yield blocks[at], first - blocks[at]
        two = count == 2
        yield blocks[at[two]], last[two] - blocks[at[two]]
        many = count > 2
        if many.any():
            yield _progression(factors, tree, size, blocks[at[many]], left[at[many]], right[at[many]], lower[many], first[many], count[many])


def _progression(factors, tree, size, block, left, right, lower, first, count) -> tuple[np.ndarray, np.ndarray]:
    """Members of progressions after the first. Where block and occurrence lie in one stretch of the progression's own step, the offset is a
    multiple of that step, which a shorter block finds, so those are left out."""
    step = tree.smallest(left, right, lower + 1) - first
    same = factors.equal_ahead(block, block + step) + step - size  # offsets up to here stay within the block's own stretch
    beyond = np.maximum(1, (same - (first - block)) // step + 1)
    many = np.maximum(0, count - beyond)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(beyond, many)
    return np.repeat(block, many), np.repeat(first - block, many) + nth * np.repeat(step, many)


class _Places:
    """The suffix array of factors of four words that occur again, under a wavelet tree."""

    def __init__(self, factors: _Factors):
        ranks = factors.ranks[2]
        classes = ranks[factors.suffixes]
        again = np.zeros(factors.n, bool)
        again[1:] = classes[1:] == classes[:-1]
        again[:-1] |= again[1:]
        self.factors, self.suffixes = factors, factors.suffixes[again]
        self.tree = WaveletMatrix(self.suffixes, factors.n)

    def classes(self, level: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks that occur more than once, each with its class's slice of the suffix array."""
        ranks = self.factors.ranks[level]
        here = ranks[self.suffixes]
        left, right = np.searchsorted(here, ranks[blocks], "left"), np.searchsorted(here, ranks[blocks], "right")
        several = right - left > 1
        return blocks[several], left[several], right[several]


def find_runs(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Runs of texts whose words are numbers >= 0 one text after another, text t from ``first[t]`` on: rows (start, end, period), by start, then period.

    Starts and ends count from the first word of all texts.
    """
    if shortest < SHORTEST:
        raise ValueError(f"runs are found from {SHORTEST} words on")
    none = np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    factors = _Factors(words.astype(np.int64), first.astype(np.int64))
    if len(factors.ranks) < 3:
        return none
    places = _Places(factors)
    if not len(places.suffixes):
        return none
    found = []
    for level, low, high in _windows(int(np.diff(first).max()) // 2, shortest):
        if level >= len(factors.ranks):
            break
        for block, period in _occurrences(factors, places, level, low, high):
            start = block - factors.equal_before(block, block + period)
            end = block + period + factors.equal_ahead(block, block + period)
            enough = end - start >= np.maximum(shortest, 2 * period)
            found.append(np.stack([start[enough], end[enough], period[enough]], 1))
    runs = np.unique(np.concatenate(found or [none]), axis=0)  # by start, end, period
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _judge(texts: Sequence[bytes], shortest: int) -> Iterator[tuple[list[dict], bytes]]:
    """Runs of each text, and the text without the repeats."""
    split = [text.split() for text in texts]
    first = np.cumsum([0, *map(len, split)])
    words = [w for words in split for w in words]
    numbers = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = find_runs(numbers, first, shortest)
    cut = np.searchsorted(runs[:, 0], first)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    stays = np.cumsum(dropped[:-1]) == 0
    for t, own in enumerate(split):
        mine = runs[cut[t] : cut[t + 1]]
        if len(mine):
            own = [own[i] for i in np.flatnonzero(stays[first[t] : first[t + 1]])]
        spans = np.stack([mine[:, 0] - first[t], mine[:, 1] - mine[:, 0], mine[:, 2]], 1).tolist()
        yield [{"start": s, "length": n, "period": q} for s, n, q in spans], b" ".join(own)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, keep: Sequence[Column | str], text: Column | str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The columns ``keep`` of every row, its ``runs`` by start, then period, and its ``collapsed`` text: the words that no run holds
    after that run's first period, joined by one blank. Words end at ASCII white space."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), (F.col(text) if isinstance(text, str) else text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            size = np.cumsum([len(t) // 4 for t in texts])
            groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // _WORDS_AT_ONCE)) + 1)
            runs, collapsed = [], []
            for group in groups:
                for spans, rest in _judge([texts[i] for i in group], shortest):
                    runs.append(spans)
                    collapsed.append(rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())], names=["kept", "runs", "collapsed"])

    names = [c for c in rows.schema["kept"].dataType.names if c not in ("runs", "collapsed")]
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    out = map_arrow(rows, work, schema)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in names), "runs", "collapsed")


def repeat_tails(doc_id: Column, text: Column) -> Column:
    """The texts of the query: a tenth of the ids, by crc32, have their words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(words, at(i).cast("int"))))).otherwise(F.lit(""))

    # the words are split once, as the only element of an array
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Numbers of a result of ``periodic_runs`` that kept ``doc_id``: the longest run and digests of all runs and of the collapsed text."""
    # longest first, then smallest start, then smallest period
    key = lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", key))
    found = found.withColumn("_best", best)
    length, period = -F.col("_best.n"), F.col("_best.p")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
