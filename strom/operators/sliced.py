"""Ordered window functions that do not put one key's whole history into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and one vehicle may hold
a third of all rows. Here a key's history is cut into slices of the order column (a day, 25 km): the window runs inside
(key, slice), and what a slice needs from the slices before it - the last row, the running sum,
the row count, the running maximum - comes from a one-row-per-slice summary joined back in.
The summary, the window and the join all hash on (key, slice), so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BEFORE_ALL = -(2**62)


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    tiebreak: Sequence[str],
    slice_width: float,
    *,
    lag: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    running_max: dict[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Adds, per key in (order_by, tiebreak) order:

    ``prev_<c>`` for every column in ``lag``; inclusive running sums; the maximum over all *earlier*
    rows; and the 1-based row number. ``order_by`` is a timestamp (``slice_width`` in seconds) or a
    number (``slice_width`` in its unit).
    """
    sums, running_max = sums or {}, running_max or {}
    position = F.col(order_by)
    if df.schema[order_by].dataType.typeName() == "timestamp":
        position = F.unix_micros(position) / 1e6
    slice_no = F.coalesce(F.floor(position / slice_width), F.lit(_BEFORE_ALL))
    parted = df.withColumn("_slice", slice_no).repartition(*keys, "_slice")
    order = [F.col(order_by).asc_nulls_first(), *(F.col(c) for c in tiebreak)]
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)

    summary = [F.count(F.lit(1)).alias("_n")]
    if lag:
        at = F.struct(order_by, *tiebreak)
        summary.append(F.max_by(F.struct(*lag), at).alias("_last"))
    summary += [F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()]
    summary += [F.max(c).alias(f"_max_{name}") for name, c in running_max.items()]
    slices = parted.groupBy(*keys, "_slice").agg(*summary)

    by_slice = W.partitionBy(*keys).orderBy("_slice")
    earlier = by_slice.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before")]
    if lag:
        carried.append(F.lag("_last").over(by_slice).alias("_carry"))
    carried += [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0.0)).alias(f"_sum_before_{n}") for n in sums]
    carried += [F.max(f"_max_{n}").over(earlier).alias(f"_max_before_{n}") for n in running_max]
    carry_names = [f"_key{i}" for i in range(len(keys))] + ["_key_slice"]
    carry = slices.select(*(F.col(k).alias(n) for k, n in zip([*keys, "_slice"], carry_names)), *carried)

    inner: dict[str, Column] = {}
    if lag:
        inner["_prev"] = F.lag(F.struct(*lag)).over(inside)
    if number:
        inner["_rank"] = F.row_number().over(inside)
    inner |= {f"_in_sum_{n}": F.sum(c).over(so_far) for n, c in sums.items()}
    inner |= {f"_in_max_{n}": F.max(c).over(before) for n, c in running_max.items()}
    windowed = parted.withColumns(inner)

    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_slice"], carry_names)]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    joined = windowed.join(carry, condition, "left")

    out: dict[str, Column] = {}
    if lag:
        joined = joined.withColumn("_prev", F.coalesce("_prev", "_carry"))
        out |= {f"prev_{c}": F.col(f"_prev.{c}") for c in lag}
    if number:
        out[number] = F.col("_rank") + F.col("_n_before")
    out |= {n: F.coalesce(F.col(f"_in_sum_{n}"), F.lit(0.0)) + F.col(f"_sum_before_{n}") for n in sums}
    out |= {n: F.greatest(f"_in_max_{n}", f"_max_before_{n}") for n in running_max}
    return joined.withColumns(out).select(*df.columns, *out)
