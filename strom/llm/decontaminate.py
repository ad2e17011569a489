"""Benchmark passages in training text, by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import ALNUM_WORDS, Words, blocks, map_arrow, small_batches, utf8
from strom.operators.sizes import salted_join
from strom.session import cut_lineage

INDEX_SQL = "n_words bigint, doc_ids binary, doc_first binary, terms binary, first binary, positions binary"
MATCH_SQL = "shard bigint, place bigint, doc_id bigint, item_id string, kind string, start bigint, stop bigint"
_SHARD_BYTES = 2 << 20
# words of benchmark items that meet a shard at once (8 bytes each on the way there); more items make more blocks
BLOCK_WORDS = 500_000
# blocks of more words than this in all are not broadcast
_BROADCAST_WORDS = 8_000_000
# blocks that a worker keeps open, and postings it looks around at once
_OPEN_BLOCKS, _NEAR_POSTINGS = 4, 1 << 20
# a row of the index is megabytes: the writer looks at its size after every row, and a reader takes up few rows at once
_INDEX_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Postings of every word of every text, one row per shard of whole documents.

    A shard numbers its words in order, one number left free after each document so that no phrase crosses two. It
    holds the distinct terms (64-bit hashes, sorted), where each one's list begins, and all positions by term, beside the
    documents' ids and first positions. Shards are some 2 MB of text or one longer document. Written to the shared folder, where each
    has a number, ``shard``; with its place in the shard that tells every row apart, whatever its id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for low, high in blocks(offsets, _SHARD_BYTES):
                yield _shard(ids.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])

    return cut_lineage(map_arrow(rows, run, INDEX_SQL).withColumn("shard", F.monotonically_increasing_id()), **_INDEX_FILES)


def _shard(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words = Words(data, offsets, ALNUM_WORDS)
    n_docs = len(offsets) - 1
    first = words.first + np.arange(n_docs + 1)
    position = np.arange(len(words.hashes)) + words.text_of()
    order = np.argsort(words.hashes, kind="stable")
    ranked = words.hashes[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    missing = -(1 << 63)  # stands for a null id
    doc_ids = np.array(ids.fill_null(missing), dtype=np.int64)
    values = (doc_ids, first.astype(np.int64), ranked[new], np.append(new, len(ranked)).astype(np.int64), position[order].astype(np.int64 if len(ranked) > 1 << 30 else np.int32))
    arrays = [pa.array([len(ranked)], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in INDEX_SQL.split(", ")])


class Shard:
    """One row of the index, opened."""

    def __init__(self, n_words: int, doc_ids: bytes, doc_first: bytes, terms: bytes, first: bytes, positions: bytes):
        self.n_words = n_words
        self.doc_ids, self.doc_first = np.frombuffer(doc_ids, np.int64), np.frombuffer(doc_first, np.int64)
        self.terms, self.first = np.frombuffer(terms, np.uint64), np.frombuffer(first, np.int64)
        self.positions = np.frombuffer(positions, np.int64 if n_words > 1 << 30 else np.int32)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, -1 if it has no postings."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting lists of the terms one after another, and for each position which list it is from."""
        low, sizes = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        which = np.repeat(np.arange(len(numbers)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.positions[low[which] + inside].astype(np.int64), which

    def term_at(self, numbers: np.ndarray) -> np.ndarray:
        """Which of the terms is at each position: their lists laid out side by side. -1 elsewhere and between documents."""
        laid = np.full(int(self.doc_first[-1]) + 1, -1, np.int64)
        positions, which = self.lists(numbers)
        laid[positions] = numbers[which]
        return laid


@dataclass
class Phrases:
    """Benchmark items of one block: windows of ``window`` words, or all of a shorter item, and each one's rarest terms."""

    items: list
    item: np.ndarray  # of each window
    terms: np.ndarray  # distinct terms
    words: np.ndarray  # of all items, as numbers of terms
    sizes: np.ndarray  # words of each item
    start: np.ndarray  # of each window in words
    length: np.ndarray
    near_item: np.ndarray  # items with enough terms in the index
    near_terms: np.ndarray  # their rarest terms, one row each, the rarest first

    @classmethod
    def of(cls, ids: list, hashes: list[np.ndarray], window: int) -> "Phrases":
        terms, words = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
        sizes = np.array([len(h) for h in hashes], np.int64)
        windows = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        item = np.repeat(np.arange(len(ids)), windows)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
        none = np.zeros(0, np.int64)
        return cls(ids, item, terms, words.reshape(-1), sizes, start, np.minimum(sizes[item], window), none, none.reshape(0, 1))

    def choose(self, postings: np.ndarray, rare: int) -> None:
        """Sets each item's ``rare`` terms of the fewest ``postings``, of equal ones those that come first in the item."""
        owner = np.repeat(np.arange(len(self.items)), self.sizes)
        _, first = np.unique(owner * len(self.terms) + self.words, return_index=True)
        first = first[postings[self.words[first]] > 0]
        first = first[np.lexsort((first, postings[self.words[first]], owner[first]))]
        held = np.bincount(owner[first], minlength=len(self.items))
        begin = np.cumsum(held) - held
        self.near_item = np.flatnonzero(held >= rare)
        self.near_terms = self.words[first[begin[self.near_item][:, None] + np.arange(rare)]] if len(self.near_item) else np.zeros((0, rare), np.int64)


def _phrase_matches(shard: Shard, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every exact occurrence.

    Each window begins with the list of its rarest term here, moved back by the term's offset in the window, and is
    intersected with the lists of its other terms, each moved by its own offset.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = shard.lookup(phrases.terms)
    sizes = np.zeros(len(number), np.int64)
    sizes[number >= 0] = shard.first[number[number >= 0] + 1] - shard.first[number[number >= 0]]
    # the rarest term within each window; a window with a term of no postings is out
    count = sizes[phrases.words]
    rarest = phrases.start.copy()
    for step in range(1, int(phrases.length.max(initial=0))):
        at = phrases.start + np.minimum(step, phrases.length - 1)
        rarest = np.where(count[at] < count[rarest], at, rarest)
    alive = np.flatnonzero(count[rarest] > 0) if len(rarest) else np.zeros(0, np.int64)
    if not len(alive):
        return none
    positions, which = shard.lists(number[phrases.words[rarest[alive]]])
    window = alive[which]
    position = positions - (rarest - phrases.start)[window]
    inside = (position >= 0) & (position + phrases.length[window] <= shard.doc_first[-1])
    window, position = window[inside], position[inside]
    needed = np.unique(number[phrases.words])
    laid = shard.term_at(needed[needed >= 0])
    for step in range(int(phrases.length[window].max(initial=0))):
        reach = np.minimum(step, phrases.length[window] - 1)
        same = laid[position + reach] == number[phrases.words[phrases.start[window] + reach]]
        window, position = window[same], position[same]
    return window, position


def _near_matches(shard: Shard, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, last position) around each posting of an item's rarest term that has all its other rare terms within ``slop`` words.

    Of each other term the nearest posting in the same document is looked up, the earlier of two equally near ones.
    """
    number = shard.lookup(phrases.terms)[phrases.near_terms]
    here = np.flatnonzero((number >= 0).all(axis=1))
    if not len(here):
        return (np.zeros(0, np.int64),) * 3
    number, items = number[here], phrases.near_item[here]
    needed = np.unique(number)
    positions, owner = shard.lists(needed)
    keys = (owner << 40) + positions
    sizes = shard.first[number[:, 0] + 1] - shard.first[number[:, 0]]
    part = (np.cumsum(sizes) - sizes) // _NEAR_POSTINGS
    found = []
    for low in np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))):
        rows = np.arange(low, np.searchsorted(part, part[low], "right"))
        base, row = shard.lists(number[rows, 0])
        row = rows[row]
        span = [base, base]
        for step in range(1, number.shape[1]):
            term = np.searchsorted(needed, number[row, step])
            document = np.searchsorted(shard.doc_first, base, "right")
            after = np.searchsorted(keys, (term << 40) + base)
            gap, nearest = np.full(len(base), slop + 1), base
            for at in (after - 1, after):
                inside = np.clip(at, 0, len(keys) - 1)
                there = positions[inside]
                closer = (inside == at) & (owner[inside] == term) & (np.abs(there - base) < gap)
                closer &= np.searchsorted(shard.doc_first, there, "right") == document
                gap, nearest = np.where(closer, np.abs(there - base), gap), np.where(closer, there, nearest)
            good = gap <= slop
            span = [np.minimum(span[0], nearest)[good], np.maximum(span[1], nearest)[good]]
            base, row = base[good], row[good]
        found.append((items[row], *span))
    return tuple(np.concatenate(column) for column in zip(*found))


def _merged(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges of one group and document; ranges never cross documents."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    if not len(group):
        return group, start, stop
    reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return group[at], start[at], np.maximum.reduceat(stop, at)


def _search(shard: Shard, phrases: Phrases, slop: int) -> list[pa.Array]:
    window, position = _phrase_matches(shard, phrases)
    item, start, stop = _merged(phrases.item[window], position, position + phrases.length[window])
    near, low, high = _near_matches(shard, phrases, slop)
    near, low, high = _merged(near, low, high + 1)
    items, starts, stops = np.concatenate((item, near)), np.concatenate((start, low)), np.concatenate((stop, high))
    document = np.searchsorted(shard.doc_first, starts, "right") - 1
    ids = shard.doc_ids[document]
    first = shard.doc_first[document]
    return [
        pa.array(document, pa.int64()), pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), pa.array([phrases.items[i] for i in items], pa.string()),
        pa.array(["phrase"] * len(item) + ["near"] * len(near), pa.string()), pa.array(starts - first, pa.int64()), pa.array(stops - first, pa.int64()),
    ]


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Items with words, hashed and dealt into blocks of about ``block_words`` words, one row per block, written to the shared folder.

    Equal items of one id are one. An item longer than a block makes its block longer. Only the number of all words comes to the driver.
    """
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text")).where("item is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*utf8(batch.column(1)), ALNUM_WORDS)
            each = [words.hashes[low:high].tobytes() for low, high in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary()), pa.array(np.diff(words.first), pa.int64())], names=["item", "words", "n"])

    hashed = cut_lineage(map_arrow(items, run, "item string, words binary, n bigint").where("n > 0").distinct())
    n_blocks = -(-(hashed.agg(F.sum("n")).first()[0] or 0) // block_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, n_blocks)))
    held = hashed.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", "words")).alias("_held"), F.sum("n").alias("n"))
    return cut_lineage(held.select("block", F.col("_held.item").alias("items"), F.col("_held.words").alias("words"), "n"))


def _beside_blocks(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every shard beside every block: the blocks are broadcast if they are few words, else each one's shards are dealt over many tasks."""
    last, words = blocks.agg(F.max("block"), F.sum("n")).first()
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(-1 if last is None else last).cast("bigint"))))
    if last is None:
        shards = shards.where(F.lit(False))
    blocks = blocks.drop("n")
    if (words or 0) <= _BROADCAST_WORDS:
        return shards.join(F.broadcast(blocks), "block")
    return salted_join(shards, blocks, ["block"], F.col("shard"), 64)


def _open(ids: pa.Scalar, words: pa.Scalar, window: int) -> Phrases:
    return Phrases.of(ids.as_py(), [np.frombuffer(w.as_buffer(), np.uint64) for w in words], window)


def _postings(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per block which of its terms the whole index holds, and how many postings of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}

        def close(block: int) -> pa.RecordBatch:
            count = counts.pop(block)
            term = np.flatnonzero(count)
            del terms[block]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(term), block), pa.int64()), pa.array(term, pa.int64()), pa.array(count[term], pa.int64())], names=["block", "term", "postings"])

        for batch in batches:
            for row in range(batch.num_rows):
                held, first, block = (batch.column(name)[row] for name in ("terms", "first", "block"))
                block = block.as_py()
                if block not in counts:
                    if len(counts) >= _OPEN_BLOCKS:
                        yield close(next(iter(counts)))
                    terms[block] = np.unique(np.frombuffer(b"".join(batch.column("words")[row].as_py()), np.uint64))
                    counts[block] = np.zeros(len(terms[block]), np.int64)
                held, first = np.frombuffer(held.as_buffer(), np.uint64), np.frombuffer(first.as_buffer(), np.int64)
                _, here, there = np.intersect1d(terms[block], held, assume_unique=True, return_indices=True)
                counts[block][here] += first[there + 1] - first[there]
        for block in list(counts):
            yield close(block)

    each = map_arrow(_beside_blocks(index.select("terms", "first", "shard"), blocks), run, "block bigint, term bigint, postings bigint")
    summed = each.groupBy("block", "term").agg(F.sum("postings").alias("postings"))
    held = summed.groupBy("block").agg(F.collect_list(F.struct("term", "postings")).alias("_held"))
    return held.select("block", F.col("_held.term").alias("term"), F.col("_held.postings").alias("postings"))


def search_index(index: DataFrame, benchmark: DataFrame, window: int = 13, rare: int = 0, slop: int = 40, block_words: int = BLOCK_WORDS,
                 item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Exact phrase matches, and with ``rare`` > 0 proximity matches, of all items in the index.

    Rows: shard and place (of the document in it), doc_id, item_id (as text), kind (phrase or near), start and stop in words of the document; overlapping
    windows of one item are one row. A proximity match is a place where the item's ``rare`` rarest terms stand together: all others within ``slop`` words
    of the rarest, in one document. Rarest are those of the fewest postings in the whole index, of equal ones those that come first in the item; terms
    without postings do not count, and an item with fewer than ``rare`` others has no proximity matches. How documents are dealt into shards
    and items into blocks changes nothing. Null items and items without words match nothing; texts that share an id count for it together.
    """
    small_batches(index.sparkSession)
    items = item_blocks(benchmark, block_words, item_column, text_column)
    if rare:
        items = cut_lineage(items.join(_postings(index, items), "block", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Phrases] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                block = at["block"].as_py()
                if block not in opened:
                    if len(opened) >= _OPEN_BLOCKS:
                        del opened[next(iter(opened))]
                    opened[block] = _open(at["items"], at["words"], window)
                    if rare and at["term"].is_valid:
                        postings = np.zeros(len(opened[block].terms), np.int64)
                        postings[at["term"].values.to_numpy()] = at["postings"].values.to_numpy()
                        opened[block].choose(postings, rare)
                shard = Shard(at["n_words"].as_py(), *(at[name].as_buffer() for name in names[1:]))
                found = _search(shard, opened[block], slop)
                number = pa.array(np.full(len(found[0]), at["shard"].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([number, *found], names=[c.split()[0] for c in MATCH_SQL.split(", ")])

    names = [c.split()[0] for c in INDEX_SQL.split(", ")]
    return map_arrow(_beside_blocks(index.select(*names, "shard"), items), run, MATCH_SQL)


def _lengths(index: DataFrame) -> DataFrame:
    """Number of words of every document, from the index alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[row].as_buffer(), np.int64)
                first = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                arrays = [np.full(len(ids), batch.column(2)[row].as_py()), np.arange(len(ids)), np.diff(first) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), *[pa.array(a, pa.int64()) for a in arrays]], names=["doc_id", "shard", "place", "n_words"])

    return map_arrow(index.select("doc_ids", "doc_first", "shard"), run, "doc_id bigint, shard bigint, place bigint, n_words bigint")


def _covered(ranges: Column) -> Column:
    """Words inside any of the ranges, sorted by start."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(state: Column, r: Column) -> Column:
        return F.struct(
            (state["n"] + F.greatest(F.lit(0).cast("bigint"), r["stop"] - F.greatest(state["upto"], r["start"]))).alias("n"),
            F.greatest(state["upto"], r["stop"]).alias("upto"))

    return F.aggregate(F.array_sort(ranges), start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_share: int = 20, rare: int = 0, slop: int = 40,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document how many of its words lie in passages of the benchmark and which items these are of.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. Contaminated: ``least_share`` times the words
    hit are at least all words. Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with ``rare`` > 0 also n_near and near_sha256,
    the items whose ``rare`` rarest terms stand together (see ``search_index``); they do not decide. Null and empty texts have no
    words. Every row is judged by itself, also one without id or with an id that others have; other columns are not
    read. An empty benchmark hits nothing.
    """
    index = build_index(docs, id_column, text_column)
    matches = search_index(index, benchmark, window, rare, slop)
    phrase, near = F.col("kind") == "phrase", F.col("kind") == "near"
    hits = matches.groupBy("shard", "place").agg(
        F.collect_list(F.when(phrase, F.struct("start", "stop"))).alias("_ranges"), *(
            F.array_sort(F.collect_set(F.when(kind, F.col("item_id")))).alias(name) for kind, name in ((phrase, "_items"), (near, "_near"))))
    rows = _lengths(index).join(hits.select("shard", "place", _covered(F.col("_ranges")).alias("_hit"), "_items", "_near"), ["shard", "place"], "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("bigint"))
    more = [("n_near", "near_sha256", "_near")] if rare else []
    listed = [(F.coalesce(F.size(ids), F.lit(0)).cast("bigint").alias(count), F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")), 256).alias(digest))
              for count, digest, ids in [("n_items", "items_sha256", "_items"), *more]]
    return rows.select(
        F.col("doc_id").alias(id_column), "n_words", n_hit.alias("n_hit"), *listed[0],
        ((n_hit > 0) & (n_hit * least_share >= F.col("n_words"))).alias("contaminated"), *(c for pair in listed[1:] for c in pair))
