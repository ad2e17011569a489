"""Near duplicates: HyperMinHash sketches, banded; estimate first, then full sets; components last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.llm.components import connect
from strom.llm.shared import SPACE_WORDS, Words, mix, salted_lookup, map_arrow, small_batches, utf8, with_row_key
from strom.session import cut_lineage

REGISTERS = 120
_MANTISSA = 10
SKETCH_SQL = "doc_id bigint, n bigint, set_a bigint, set_b bigint, registers binary"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHORT = mix(np.arange(1, 64, dtype=np.uint64) * _B)  # tells sequences shorter than a shingle apart by length
# rows of one bucket that meet in one task, members of one centre that do, and shingles of one block of a neighbourhood
_BLOCK, _MEMBERS, _SHINGLES = 512, 2000, 150_000


def shingle_sets(words: Words, width: int = 3) -> Iterator[np.ndarray]:
    """Per text its distinct shingles of ``width`` words as sorted hashes; all words as one if there are fewer, none without words."""
    h = words.hashes
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _A) | np.uint64(1)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = high - low
        if n >= width:
            yield np.unique(rolled[low : high - width + 1])
        elif n:
            yield mix((h[low:high] * factors[:n]).sum(keepdims=True) + _SHORT[n])
        else:
            yield np.zeros(0, np.uint64)


_RANK = mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64) * _C).reshape(REGISTERS, REGISTERS)


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash of a set: per bucket the leading zeros of its smallest hash and the bits after the first one.

    Buckets that got nothing borrow the register of the bucket first in a fixed random order of their own, so that equal
    sets borrow alike and similar sets mostly do.
    """
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = mix(hashes ^ _B) | np.uint64(1)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), value)
    used = np.zeros(REGISTERS, bool)
    used[bucket.astype(np.int64)] = True
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = (64 - np.minimum(exponent, 64)).astype(np.uint16)
    out = (zeros << np.uint16(_MANTISSA)) | ((fraction * 2 - 1) * (1 << _MANTISSA)).astype(np.uint16) & np.uint16((1 << _MANTISSA) - 1)
    if not used.all():
        full = np.flatnonzero(used)
        empty = np.flatnonzero(~used)
        out[empty] = out[full[_RANK[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def chance_match(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Share of registers that agree though the smallest hashes differ: same leading zeros, same mantissa by chance."""
    zeros = 2.0 ** -np.arange(0, 40)

    def held(n):
        rate = np.maximum(np.asarray(n, float), 1)[..., None] / REGISTERS
        return np.exp(-rate * zeros / 2) - np.exp(-rate * zeros)

    return (held(n_a) * held(n_b)).sum(-1) / (1 << _MANTISSA)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the agreement by chance."""
    p = chance_match(n_a, n_b)
    return np.clip((equal / REGISTERS - p) / (1 - p), 0, 1)


def may_link(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """False only where the estimate lies five standard errors or more below ``least``, or the sizes rule a link out."""
    sample = np.minimum(REGISTERS, np.maximum(n_a, n_b))
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (estimate(equal, n_a, n_b) >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(sample, 1))) & (small >= least * large - 1e-9)


def sketch(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: size of its set, two independent digests of the set, and its registers. Written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, registers = [], [], [], []
            for hashes in shingle_sets(Words(*utf8(batch.column(1)), SPACE_WORDS), width):
                n.append(len(hashes))
                a.append(int(mix(hashes ^ _A).sum().view(np.int64)) if len(hashes) else 0)
                b.append(int(mix(hashes ^ _C).sum().view(np.int64)) if len(hashes) else 0)
                registers.append(registers_of(hashes).tobytes() if len(hashes) else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SKETCH_SQL.split(", ")])

    return cut_lineage(map_arrow(rows, run, SKETCH_SQL))


def band_rows(least: float, missed: float = 1e-6) -> int:
    """Registers per band: the most, up to five, at which a pair of similarity ``least`` shares no band with a probability below ``missed``."""
    return max([r for r in range(1, 6) if (1 - least**r) ** (REGISTERS // r) < missed], default=1)


def _buckets(reps: DataFrame, height: int) -> DataFrame:
    """(key, band, doc_id) of every band of registers that two documents or more agree in, with their number."""
    width = 2 * height
    keys = F.array(*[F.xxhash64(F.substring("registers", width * i + 1, width), F.lit(i)) for i in range(REGISTERS // height)])
    rows = reps.select("doc_id", F.posexplode(keys).alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return cut_lineage(rows.join(shared, "key"))


def _centres(buckets: DataFrame) -> DataFrame:
    """(centre, doc_id): in every bucket each member and the one that shares most buckets with others.

    That one is the likeliest common origin of a group of copies, which most others are near to.
    """
    shared = buckets.groupBy("doc_id").agg(F.sum("members").alias("_shared"))
    rows = buckets.select("key", "doc_id").join(shared, "doc_id")
    most = rows.groupBy("key").agg(F.max("_shared").alias("_shared"))
    centre = rows.join(most, ["key", "_shared"]).groupBy("key").agg(F.min("doc_id").alias("centre"))
    pairs = rows.select("key", "doc_id").join(centre, "key").where("centre <> doc_id")
    return pairs.select("centre", "doc_id").distinct()


def _beside_centre(pairs: DataFrame, payload: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Pairs (centre, doc_id) that ``compare`` keeps. Members stream past their centre's payload, which comes first in its group.

    A centre with many members is dealt into parts, its payload once to each, so a task holds one centre at a time and no centre is hot.
    """
    counts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("_parts"))
    members = pairs.join(counts, "centre").select("centre", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int").alias("part"))
    own = counts.select("centre", F.col("centre").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    rows = members.unionByName(own).join(payload, "doc_id").withColumn("member", F.col("doc_id") != F.col("centre"))
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "member")
    data = [c for c in payload.columns if c != "doc_id"]
    return map_arrow(rows.select("centre", "doc_id", "member", *data), compare, "centre bigint, doc_id bigint")


def _kept(centres: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(centres, pa.int64()), pa.array(ids, pa.int64())], names=["centre", "doc_id"])


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = np.zeros(REGISTERS, np.uint16), 0
        for batch in batches:
            centres, ids, members, sizes = (batch.column(i).to_pylist() for i in range(4))
            held = np.frombuffer(b"".join(x.as_py() for x in batch.column(4)), np.uint16).reshape(-1, REGISTERS)
            centre_row, centre_size = np.empty_like(held), np.empty(len(ids), np.int64)
            for i, member in enumerate(members):
                if not member:
                    own, size = held[i].copy(), sizes[i]
                centre_row[i], centre_size[i] = own, size
            good = may_link((held == centre_row).sum(axis=1), np.array(sizes, np.int64), centre_size, least) & np.array(members, bool)
            at = np.flatnonzero(good)
            yield _kept([centres[i] for i in at], [ids[i] for i in at])

    return _beside_centre(pairs, reps.select("doc_id", "n", "registers"), compare)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets meet 100 |A n B| >= percent |A u B|."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            centres, ids, members = (batch.column(i).to_pylist() for i in range(3))
            out: tuple[list, list] = ([], [])
            for i, hashes in enumerate(shingle_sets(Words(*utf8(batch.column(3)), SPACE_WORDS), width)):
                if not members[i]:
                    own = hashes
                    continue
                both = len(hashes) + len(own) - len(np.union1d(hashes, own))
                if both and 100 * both >= percent * (len(hashes) + len(own) - both):
                    out[0].append(centres[i])
                    out[1].append(ids[i])
            yield _kept(*out)

    return _beside_centre(pairs, texts, compare)


class _Sets:
    """Disjoint sets of the labels one task has met; tells which edges joined two of them."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.over.get(x, x)) != x:
            self.over[x] = self.over.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.over[max(a, b)] = min(a, b)
        return a != b


def _grouped(batches: Iterator[pa.RecordBatch], n: int, work: Callable[[list], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hands sorted rows to ``work`` group by group; the first ``n`` columns are the key."""
    group: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and row[:n] != group[0][:n]:
                yield from work(group)
                group = []
            group.append(row)
    if group:
        yield from work(group)


def _neighbourhoods(buckets: DataFrame, labels: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Links (centre, doc_id) between ids of components with a pair that shares a bucket and may be linked.

    Only buckets that still hold several components are looked at. A large one is cut into blocks, each pair of which meets in a task
    of its own, where registers are compared as arrays. A task gives out a link only where it joins two components it has not
    joined before, so never more than it has rows.
    """
    rows = buckets.select("key", "doc_id").join(labels, "doc_id")
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    rows = rows.join(mixed.select("key", F.ceil(F.col("_rows") / _BLOCK).cast("int").alias("_blocks")), "key")
    rows = rows.join(reps.select("doc_id", "n", "registers"), "doc_id").withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other")})
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    rows = rows.select("key", "low", "high", "component", "n", "registers")

    def tied(group: list) -> Iterator[pa.RecordBatch]:
        parts, sizes = (np.array([g[i] for g in group], np.int64) for i in (3, 4))
        held = np.frombuffer(b"".join(g[5] for g in group), np.uint16).reshape(-1, REGISTERS)
        sets, out = _Sets(), ([], [])
        for i in range(len(group) - 1):
            against = np.flatnonzero(parts[i + 1 :] != parts[i]) + i + 1
            good = may_link((held[against] == held[i]).sum(axis=1), sizes[against], np.full(len(against), sizes[i]), least)
            for part in np.unique(parts[against[good]]).tolist():
                if sets.join(int(parts[i]), part):
                    out[0].append(int(parts[i]))
                    out[1].append(part)
        yield _kept(*out)

    return map_arrow(rows, lambda batches: _grouped(batches, 3, tied), "centre bigint, doc_id bigint")


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    return rows.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int"))


def _links_between(labels: DataFrame, around: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (centre, doc_id) between ids of components of one neighbourhood, by full sets.

    ``around`` gives a neighbourhood to each component that is in one. The documents outside of its largest component are compared with all
    others, in blocks of bounded size, each pair of which meets in a task. Given out are only links that join components.
    """
    rows = salted_lookup(labels, around, ["component"], F.col("doc_id"), how="inner").join(reps.select("doc_id", "n"), "doc_id")
    parts = rows.groupBy("place", "component").agg(F.sum("n").alias("_n"))
    places = parts.groupBy("place").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "component")).alias("_main"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    places = cut_lineage(places.select("place", F.col("_main.component").alias("_main"),
                                       F.ceil(F.col("_all") / _SHINGLES).cast("int").alias("_right"), F.ceil((F.col("_all") - F.col("_main._n")) / _SHINGLES).cast("int").alias("_left")))
    rows = rows.join(places, "place")
    left = _dealt(rows.where("component <> _main"), "_left").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("_right") - 1)))
    right = _dealt(rows, "_right").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("_left") - 1)))
    both = left.select("place", F.col("_own").alias("l"), "r", F.lit(True).alias("asks"), "doc_id", "component").unionByName(
        right.select("place", "l", F.col("_own").alias("r"), F.lit(False).alias("asks"), "doc_id", "component"))
    both = both.join(texts, "doc_id").repartition("place", "l", "r").sortWithinPartitions("place", "l", "r")
    both = both.select("place", "l", "r", "asks", "component", "text")

    def linked(group: list) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(pa.array([g[5] for g in group], pa.string()))
        found = list(shingle_sets(Words(data, offsets, SPACE_WORDS), width))
        asks = np.array([g[3] for g in group], bool)
        others, owners = np.flatnonzero(~asks), np.array([g[4] for g in group], np.int64)
        sizes = np.array([len(f) for f in found], np.int64)
        postings = np.concatenate([np.zeros(0, np.uint64), *(found[i] for i in others)])
        of = np.repeat(np.arange(len(others)), sizes[others])
        order = np.argsort(postings, kind="stable")
        postings, of = postings[order], of[order]
        sets, out = _Sets(), ([], [])
        for i in np.flatnonzero(asks).tolist():
            low, high = np.searchsorted(postings, found[i], "left"), np.searchsorted(postings, found[i], "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shared = np.bincount(of[at], minlength=len(others))
            good = (shared > 0) & (100 * shared >= percent * (sizes[i] + sizes[others] - shared)) & (owners[others] != owners[i])
            for part in np.unique(owners[others[good]]).tolist():
                if sets.join(int(owners[i]), part):
                    out[0].append(int(owners[i]))
                    out[1].append(part)
        yield _kept(*out)

    return map_arrow(both, lambda batches: _grouped(batches, 3, linked), "centre bigint, doc_id bigint")


def near_dedup(docs: DataFrame, width: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``percent`` / 100 or more over sets of word shingles.

    Documents with equal sets form one class, whose smallest id stands for it. Classes meet in buckets of agreeing register bands: at
    the least similarity two miss each other in all bands with a probability below 1e-6. In each bucket all members are first tried
    against one centre (estimate from registers, then full sets). Buckets whose members are then still in several components
    are looked at again: components with a pair that may link form a neighbourhood, in which all pairs across components are decided by
    full sets, so no link between components is left out; pairs within one add nothing. That last step is quadratic in the documents of
    a neighbourhood outside its largest component, block by block, and gives out no more links than components.

    Columns: id, n_shingles, component_id (smallest id reachable), kept. Null and empty texts have no shingles and stand alone. Rows that
    repeat an id share its component; rows without id stand alone, with a null component, and are kept. Other columns are not read.
    """
    least = percent / 100
    height = band_rows(least)
    sketches = sketch(docs, width, id_column, text_column)
    full = sketches.where("n > 0 and doc_id is not null")
    classes = cut_lineage(full.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep")))
    reps = cut_lineage(full.select("doc_id", "n", "registers").join(classes.select(F.col("rep").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]))
    buckets = _buckets(reps, height)
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = cut_lineage(texts.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))
    tried = cut_lineage(_estimated(_centres(buckets), reps, least))
    links = cut_lineage(_verified(tried, texts, width, percent))
    labels = connect(links)
    members = buckets.select("doc_id").distinct().join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    members = cut_lineage(members)
    # from here on components are linked, not their documents: each stands as one node, whatever its size
    around = connect(cut_lineage(_neighbourhoods(buckets, members, reps, least))).select(F.col("doc_id").alias("component"), F.col("component").alias("place"))
    more = cut_lineage(_links_between(members, around, reps, texts, width, percent))
    merged = connect(more).select(F.col("doc_id").alias("component"), F.col("component").alias("_whole"))
    labels = salted_lookup(members, merged, ["component"], F.col("doc_id")).select(F.col("doc_id").alias("rep"), F.coalesce("_whole", "component").alias("component"))
    found = classes.join(labels, "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    joined = salted_lookup(full.select("doc_id", "n", "set_a", "set_b"), found, ["set_a", "set_b", "n"], F.col("doc_id"), how="inner")
    out = joined.select("doc_id", "n", "component").unionByName(alone)
    return out.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def near_dedup_by_id(docs: DataFrame, width: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``near_dedup``, for ids that may repeat: every row's text is compared by itself, and rows of one id are one document.

    So a document of several texts is linked with all that any of them is linked with, whatever the order of the rows. One row for each row of ``docs``;
    rows without id stand alone, with a null component, and are kept.
    """
    rows = with_row_key(docs).select("_row", F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    named = rows.where("doc_id is not null")
    found = near_dedup(named, width, percent, "_row", "text").select("_row", "n_shingles", F.col("component_id").alias("_part"))
    found = cut_lineage(found.join(rows.select("_row", "doc_id"), "_row"))
    # parts that share an id are one; most ids occur once and give no pair
    firsts = found.groupBy("doc_id").agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).where("_first <> _last").select("doc_id", "_first")
    shared = salted_lookup(found.select("_row", "doc_id", "_part"), firsts, ["doc_id"], F.col("_row"), how="inner")
    links = cut_lineage(shared.where("_part <> _first").select(F.col("_first").alias("centre"), F.col("_part").alias("doc_id")).distinct())
    merged = connect(links).select(F.col("doc_id").alias("_part"), F.col("component").alias("_whole"))
    found = cut_lineage(found.join(merged, "_part", "left").withColumn("_whole", F.coalesce("_whole", "_part")))
    least = found.groupBy("_whole").agg(F.min("doc_id").alias("component_id"))
    out = salted_lookup(found, least, ["_whole"], F.col("_row"), how="inner").select("doc_id", "n_shingles", "component_id")
    alone = sketch(rows.where("doc_id is null"), width, "_row", "text").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("doc_id").alias(id_column), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
