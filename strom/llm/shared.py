"""Helpers several operators share: session settings, salted look-ups, and byte-level views of Arrow text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strom.session import cut_lineage

BATCH_BYTES = 2 << 20
# ASCII white space as the contracts list it: blank and \t \n \v \f \r
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, since one text may be as long as thousands of others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def give_back() -> None:
    """Hands memory that Python no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, after which the worker, which Spark keeps for later tasks, hands its freed memory back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a bigint of each row's own, null and repeated ids or not.

    Rows of a plain file scan are numbered by file and place in it, which every later scan of the same files gives again. All else
    is written to the shared folder once with its numbers, since a plan that runs twice need not number its rows alike.
    """
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan != "LogicalRelation" or "_metadata" in docs.columns:
        return cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    names = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    # one row per file, of which the driver holds a list anyway
    files = cut_lineage(names.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("bigint").alias("_number")))
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    row = F.shiftleft("_number", 40).bitwiseOR(F.col("_at"))
    return rows.join(F.broadcast(files), "_file").select(*docs.columns, row.alias("_row"))


def salt(spread: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")


def salted_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], spread: Column, salts: int = 64, how: str = "left") -> DataFrame:
    """Joins many ``rows`` to a ``table`` with one row per key, however many rows a key has.

    Each key's rows are dealt into ``salts`` parts. Only the distinct (key, part) pairs, combined before they are
    shuffled, meet the table; the rows then meet the pairs, so neither join gathers a hot key in one task.
    """
    dealt = rows.withColumn("_salt", salt(spread, salts))
    pairs = dealt.select(*on, "_salt").distinct()
    return dealt.join(pairs.join(table, list(on), how), [*on, "_salt"], how).drop("_salt")


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls into ``fold``; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(folds)) == fold, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 18


class Words:
    """Words of a block of texts as 64-bit hashes, in order.

    ``table`` gives every byte its value; bytes of value 0 separate words. Hash and position of all words come
    from running sums over the bytes, so the work is the same for one long text as for many short ones.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = (table != 0)[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]  # a text ends where the next one begins
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text's words, and the end
        self.hashes = _hashes(data, self.starts, self.ends, table)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(_POWERS.get("up", ())) >= n:
        size = max(n, _SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        up, down = _powers(int(ends[upto - 1] - low))
        part = table[data[low : ends[upto - 1]]] * up[: ends[upto - 1] - low]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
        s = starts[at:upto] - low
        out[at:upto] = (sums[ends[at:upto] - low] - sums[s]) * down[s]
        at = upto
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_table(separators: Sequence[int], lower: bool = True) -> np.ndarray:
    """A random odd value for each byte, 0 for separators; A-Z as a-z if ``lower``."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


SPACE_WORDS = byte_table([ord(c) for c in SPACES])
# words of letters, digits and everything beyond ASCII
ALNUM_WORDS = byte_table([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def blocks(offsets: np.ndarray, limit: int, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes and ``most`` texts each, one text at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, low + most, n)
        yield low, high
        low = high
