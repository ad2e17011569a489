"""Broadcast only what has been measured to be small; salt the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from strom.session import cut_lineage


# no side above this is broadcast, whatever its number of rows
MAX_BROADCAST_BYTES = 256 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About how much a row takes: text, binary and arrays by their length, all else at a fixed width."""
    total = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            element = field.dataType.elementType
            total = total + 16 * (len(element.fields) if isinstance(element, StructType) else 1) * F.greatest(F.size(field.name), F.lit(0))
        else:
            total = total + 16
    return total


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether there are at most ``max_rows`` rows of ``MAX_BROADCAST_BYTES`` in all; every task sends on two sums."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df).cast("bigint"))).first()
    return rows <= max_rows and (size or 0) <= MAX_BROADCAST_BYTES


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, buckets: int, how: str = "inner"
) -> DataFrame:
    """Equi-join that splits every hot key of ``big`` over ``buckets`` tasks.

    ``spread`` is any expression that varies between the rows of one key. ``small`` is repeated once
    per bucket, so it should be the side with few rows per key. For ``inner`` and ``left`` joins only.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def skew_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, buckets: int, how: str = "inner",
    hot_rows: int = 1_000_000, max_hot_keys: int = 100_000,
) -> DataFrame:
    """Equi-join of two large sides that splits only the keys that need it.

    Rows of ``big`` are counted per key (combined on the map side); a key with more than ``hot_rows`` of them
    is dealt into as many parts as that takes, and only its rows of ``small`` are repeated. Should there be
    more hot keys than may be broadcast, every key is salted instead.
    """
    counted = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = cut_lineage(counted.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts")))
    if not is_small(hot, max_hot_keys):
        return salted_join(big, small, on, spread, buckets, how)
    if hot.isEmpty():
        return big.join(small.hint("merge"), list(on), how)
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = small.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_parts").join(right.drop("_parts").hint("merge"), [*on, "_salt"], how).drop("_salt")


def join_to_dimension(
    facts: DataFrame, dimension: DataFrame, on: Sequence[str], how: str, max_rows: int, spread: Column, buckets: int = 16
) -> DataFrame:
    """Fact-to-dimension join: broadcast if the dimension is measured small, else with its hot keys split."""
    if is_small(dimension, max_rows):
        return facts.join(F.broadcast(dimension), list(on), how)
    return skew_join(facts, dimension, on, spread, buckets, how)
