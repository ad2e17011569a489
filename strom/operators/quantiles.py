"""Exact interpolated percentiles without one task per group.

The built-in exact percentile keeps all distinct values of a group in one buffer. Here an
approximate percentile sketch, bounded in size, only proposes bracket values; rows are counted per
bracket, and the exact order statistics are then looked up inside the one bracket that holds them.
The sketch decides how much is sorted, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.operators.sizes import salted_join
from strom.session import cut_lineage

_ACCURACY = 2_000
_MARGIN = 0.002


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: Column, percentiles: dict[str, float], buckets: int = 16,
    few_groups: bool = False, one_task_rows: int = 1_000_000,
) -> DataFrame:
    """One row per group with a value: the keys and one column per named percentile (linear interpolation).

    ``few_groups`` states that the number of groups is fixed by definition (states, buckets), so the
    brackets can be broadcast; otherwise rows meet them in a salted join. Keys and values are written once; if they
    hold no more than ``one_task_rows`` rows, they cannot overload a task and take the built-in aggregate.
    """
    aliases = [f"_k{i}" for i in range(len(keys))]
    # written once, narrow: both ways read it, and its number of rows is known without another run of the input
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, aliases)), value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = cut_lineage(rows)
    if one_task_rows and rows.count() <= one_task_rows:
        return rows.groupBy(*(F.col(a).alias(k) for k, a in zip(keys, aliases))).agg(*(F.percentile("_v", F.lit(p)).alias(n) for n, p in percentiles.items()))
    # grouping by a struct-free text-safe key: NULL groups are kept through a null-marker column
    group = F.xxhash64(*(F.coalesce(F.col(a).cast("string"), F.lit("\u0000")) for a in aliases)) if aliases else F.lit(0)
    probes = sorted({min(1.0, max(0.0, p + d)) for p in percentiles.values() for d in (-_MARGIN, _MARGIN)})
    rows = rows.withColumn("_g", group)
    key_cols = ["_g", *aliases]
    sketch = rows.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_total"),
        F.percentile_approx("_v", probes, _ACCURACY).alias("_edges"),
    )
    # the hash alone is not trusted as a key: the real key columns travel along and are compared null-safely
    edges = sketch.select("_g", F.struct(*aliases, F.lit(0).alias("_pad")).alias("_key"), "_total", "_edges")
    keyed = rows.select("_g", F.struct(*aliases, F.lit(0).alias("_pad")).alias("_rowkey"), "_v")
    if few_groups:
        matched = keyed.join(F.broadcast(edges), "_g")
    else:
        matched = salted_join(keyed, edges, ["_g"], F.col("_v"), buckets)
    matched = matched.where(F.col("_rowkey").eqNullSafe(F.col("_key")))
    bracket = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    counted = (
        matched.select("_g", "_key", "_total", "_v", bracket.alias("_bracket"))
        .groupBy("_g", "_key", "_total", "_bracket", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    brackets = counted.groupBy("_g", "_key", "_total", "_bracket").agg(F.sum("_c").alias("_in"))
    ordered = W.partitionBy("_g", "_key").orderBy("_bracket")
    brackets = brackets.withColumn("_upto", F.sum("_in").over(ordered)).withColumn(
        "_before", F.col("_upto") - F.col("_in")
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(p)

    def holds(index: Column, low: str, high: str) -> Column:
        return (F.col(low) <= index) & (index < F.col(high))

    wanted = [f(position(p)) for p in percentiles.values() for f in (F.floor, F.ceil)]
    any_wanted = holds(wanted[0], "_before", "_upto")
    for index in wanted[1:]:
        any_wanted = any_wanted | holds(index, "_before", "_upto")
    needed = brackets.where(any_wanted).select(
        F.col("_g").alias("_ng"), F.col("_key").alias("_nkey"), F.col("_bracket").alias("_nb"), "_before"
    )
    inside = W.partitionBy("_g", "_key", "_bracket").orderBy("_v")
    found = (
        counted.join(
            needed,
            (F.col("_g") == F.col("_ng")) & (F.col("_bracket") == F.col("_nb")) & F.col("_key").eqNullSafe(F.col("_nkey")),
        )
        .withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    aggregates = []
    for name, p in percentiles.items():
        for side, rounding in (("lo", F.floor), ("hi", F.ceil)):
            at = holds(rounding(position(p)), "_start", "_end")
            aggregates.append(F.max(F.when(at, F.col("_v"))).alias(f"_{side}_{name}"))
    result = found.groupBy("_g", "_key", "_total").agg(*aggregates)
    # the arithmetic of the built-in percentile, so both ways agree to the last bit
    outs = []
    for name, p in percentiles.items():
        low, high, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), position(p)
        mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        outs.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise(mixed).alias(name))
    return result.select(*(F.col(f"_key.{a}").alias(k) for k, a in zip(keys, aliases)), *outs)
