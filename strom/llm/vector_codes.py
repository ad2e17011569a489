"""Vector code compression: product codes whose codebooks are fitted over all vectors, in exact integers.

Each part of all vectors is sorted along a Hilbert curve and cut into flat blocks that store the smallest box around their points and the sum of
them. A round compares the box of a block with the entries of its codebook: only entries that are not farther at their nearest than another one
at its farthest can be the nearest of a point inside. Where that leaves one entry, the block's sum joins it whole; else a small kernel compares the block's
points with those entries alone. All is int64, so results do not depend on how rows fall into tasks.

A round is one pass over the blocks and sends entries x components sums to the driver, whatever the number of vectors. The blocks are written once.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. The first entries come from the smallest ids, null ids last,
ties by the vectors themselves; with fewer vectors there are fewer entries. Repeated rows and ids are vectors of their own, each with a row. Vectors whose length differs from
the others' or is no multiple of the parts, and components beyond +-2**14, are errors. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.llm.hilbert import hilbert_keys
from strom.llm.shared import map_arrow, salted_lookup, small_batches
from strom.session import cut_lineage

SCALE = 4096
_LARGEST = SCALE << 14
_BLOCK = 256


@dataclass
class Codebooks:
    """``entries``: parts x entries x components; ``scale`` turned components into integers."""

    entries: np.ndarray
    scale: int = SCALE

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, vector: str = "embedding", vector_id: str = "vec_id", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (``row``, ``id``, ``label``, ``point``) of the vectors that are kept; ``point`` holds the integers floor(scale * x). Written to the shared folder."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vector_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            batch = batch.filter(column.is_valid())
            column = batch.column(3)
            flat, sizes = column.flatten(), np.diff(column.offsets.to_numpy(zero_copy_only=False))
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ends = np.cumsum(sizes)
            whole = bad[ends] == bad[ends - sizes]
            values = np.floor(values * scale)
            if (np.abs(values[np.repeat(whole, sizes)]) > _LARGEST).any():
                raise ValueError("components are too large for exact distances")
            with np.errstate(invalid="ignore"):
                point = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values.astype(np.int64)))
            mask = pa.array(whole)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in range(3)), point.filter(mask)], names=["row", "id", "label", "point"])

    id_type, label_type = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return cut_lineage(map_arrow(rows, work, f"row bigint, id {id_type}, label {label_type}, point array<bigint>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def flat_blocks(points: DataFrame, parts: int) -> DataFrame:
    """Rows (``part``, ``rows``, ``points``, ``low``, ``high``, ``total``): blocks of points near each other. Written to the shared folder.

    The rows are dealt by (part, place on the curve, row), so equal points spread over as many tasks as they need.
    """
    lengths = points.agg(F.min(F.size("point")).alias("a"), F.max(F.size("point")).alias("b")).first()
    if lengths.a is None:
        width = 1
    elif lengths.a != lengths.b or lengths.a % parts or not lengths.a:
        raise ValueError(f"vectors have {lengths.a} to {lengths.b} components, which {parts} parts do not divide")
    else:
        width = lengths.a // parts
    bits = max(1, min(16, 62 // width))
    dims = min(width, 62)
    bounds = points.select(F.posexplode("point").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, step = np.zeros(parts * width, np.int64), np.ones(parts * width, np.int64)
    for b in bounds:
        low[b["at"]], step[b["at"]] = b.low, ((b.high - b.low) >> bits) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), parts * width)
            cells = (x - low) // step
            for part in range(parts):
                own = slice(part * width, part * width + width)
                keys = hilbert_keys(cells[:, own][:, :dims], bits)
                data = pa.FixedSizeListArray.from_arrays(pa.array(x[:, own].ravel()), width).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(keys), batch.column(0), data], names=["part", "key", "row", "point"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rows, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), width)
            change = np.flatnonzero(np.diff(part)) + 1
            edges = np.unique(np.concatenate([np.arange(0, len(part), _BLOCK), change, [len(part)]]))
            columns: dict[str, list] = {"part": [], "rows": [], "points": [], "low": [], "high": [], "total": []}
            for a, b in zip(edges[:-1], edges[1:]):
                own = x[a:b]
                for name, value in zip(columns, (part[a], rows[a:b], own.ravel(), own.min(0), own.max(0), own.sum(0))):
                    columns[name].append(value)
            if columns["part"]:
                yield pa.RecordBatch.from_arrays([pa.array(columns["part"], pa.int32()), *(pa.array(columns[c], pa.list_(pa.int64())) for c in list(columns)[1:])], names=list(columns))

    placed = map_arrow(points.select("row", "point"), place, "part int, key bigint, row bigint, point array<bigint>")
    dealt = placed.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return cut_lineage(map_arrow(dealt, pack, "part int, rows array<bigint>, points array<bigint>, low array<bigint>, high array<bigint>, total array<bigint>"))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks x entries: whether an entry can be the nearest of any point in the block's box."""
    c = entries[None]
    beside = np.maximum(np.maximum(low[:, None] - c, c - high[:, None]), 0)
    across = np.maximum(np.abs(c - low[:, None]), np.abs(high[:, None] - c))
    return (beside * beside).sum(2) <= (across * across).sum(2).min(1)[:, None]


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, ties to the lower one, and its squared distance."""
    away = x[:, None, :] - entries[None]
    distance = np.einsum("pec,pec->pe", away, away)
    index = distance.argmin(1)
    return index, distance[np.arange(len(x)), index]


def _blocks_of(batch: pa.RecordBatch, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows, points, total, shortlist) of each block of a batch."""
    width = entries.shape[2]
    part = batch.column(0).to_numpy()
    low, high, total = (_matrix(batch.column(i), width) for i in (3, 4, 5))
    listed = np.zeros((len(part), entries.shape[1]), bool)
    for p in np.unique(part):
        listed[part == p] = shortlists(low[part == p], high[part == p], entries[p])
    for i, p in enumerate(part):
        rows = batch.column(1)[i].values.to_numpy()
        yield p, rows, batch.column(2)[i].values.to_numpy().reshape(len(rows), width), total[i], np.flatnonzero(listed[i])


def _one_round(blocks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after one round: floors of the means of their points."""
    parts, count, width = entries.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for part, _, x, total, short in _blocks_of(batch, entries):
                if len(short) == 1:
                    sums[part, short[0]] += total
                    sizes[part, short[0]] += len(x)
                    continue
                index = short[_nearest(x, entries[part][short])[0]]
                for e in np.unique(index):
                    sums[part, e] += x[index == e].sum(0)
                sizes[part] += np.bincount(index, minlength=count)
        part, entry, at = (a.ravel().astype(np.int32) for a in np.indices(sums.shape))
        size = np.repeat(sizes.ravel(), width)
        used = pa.array(size > 0)
        yield pa.RecordBatch.from_arrays([pa.array(a).filter(used) for a in (part, entry, at, sums.ravel(), size)], names=["part", "entry", "at", "total", "size"])

    found = map_arrow(blocks, work, "part int, entry int, at int, total bigint, size bigint")
    after = entries.copy()
    for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).collect():
        after[r.part, r.entry, r["at"]] = r.total // r["size"]
    return after


def fit(points: DataFrame, blocks: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks of ``parts`` after ``rounds`` over all ``blocks``; those of the smallest ids in ``points`` are the first entries."""
    seeds = points.orderBy(F.col("id").asc_nulls_last(), "point", "row").limit(entries).select("point").collect()
    if not seeds:
        return Codebooks(np.zeros((parts, 0, 1), np.int64))
    x = np.array([s.point for s in seeds], np.int64)
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _one_round(blocks, books)
    return Codebooks(books)


def encode(points: DataFrame, blocks: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (``id``, ``label``, ``codes``, ``error``): index of the nearest entry by part, and the sum of the squared distances to them."""
    entries = books.entries

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, x, _, short in _blocks_of(batch, entries):
                index, distance = _nearest(x, entries[part][short])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(np.full(len(rows), part, np.int32)), pa.array(short[index].astype(np.int32)), pa.array(distance)],
                    names=["row", "part", "code", "distance"],
                )

    found = map_arrow(blocks, work, "row bigint, part int, code int, distance bigint")
    whole = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "code"))).alias("codes"), F.sum("distance").alias("error"))
    return points.select("row", "id", "label").join(whole, "row").select("row", "id", "label", F.col("codes.code").alias("codes"), "error")


def code_table(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``) of the vectors that are kept."""
    points = whole_vectors(vectors)
    blocks = flat_blocks(points, parts)
    books = fit(points, blocks, parts, entries, rounds)
    rows = cut_lineage(encode(points, blocks, books))
    rows = rows.withColumn("unlabelled", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit(0)))
    sums = rows.groupBy("label", "unlabelled").agg(F.sum("error").alias("label_error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return salted_lookup(rows, sums, ["label", "unlabelled"], F.col("row")).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
