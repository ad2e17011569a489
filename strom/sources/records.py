"""Records of delimited text whose quoted cells may hold line breaks, read by many tasks per file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strom.session import cut_lineage


def _quoting(sep: str) -> tuple[str, str]:
    """Patterns of a line after which a quoted cell is open, if the line begins outside and if it begins inside one.

    A cell is quoted if a quote is its first character; two quotes within stand for one. What follows the closing quote up to the
    separator, and a quote within an unquoted cell, are plain characters.
    """
    other = f"[^{re.escape(sep)}]"
    inside = r'[^"]*+(?:""[^"]*+)*+'
    whole = f'(?:(?:"{inside}"{other}*+|(?!"){other}++)?+{re.escape(sep)})*+'
    begun = rf'{whole}"{inside}\z'
    return f"^{begun}", rf'^{inside}(?:\z|"{other}*+{re.escape(sep)}{begun})'


def _open_after(start: Column, fixed: Column, swaps: Column) -> Column:
    """Whether a cell is open, from the last line that decides it alone (or the start) and the number of swaps since."""
    turned = F.pmod(swaps - F.coalesce(fixed["swaps"], F.lit(0)), F.lit(2)) == 1
    return F.coalesce(fixed["open"], start) != turned


def read_records(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``_file``, ``_at`` (orders the records of a file) and ``record``, the text of one record without its line end.

    Files are read in splits. Whether a line begins inside a quoted cell depends on all lines before it, but each line only maps
    two states onto two: it fixes the state, keeps it or swaps it. So a line's state follows from the last fixing line and
    the swaps since, first within its split, then over the splits' summaries (one row each). Lines are written to the shared folder
    once, with their numbers. Only lines of records that span several are gathered, by record. A cell that is never closed runs to the end of its file.
    """
    from_outside, from_inside = _quoting(sep)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"), "value",
        F.col("value").rlike(from_outside).alias("_outside"), F.col("value").rlike(from_inside).alias("_inside"))
    lines = cut_lineage(lines)
    within = Window.partitionBy("_file", "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = F.when(F.col("_outside") & ~F.col("_inside"), 1).otherwise(0)
    lines = lines.withColumn("_swaps", F.sum(swap).over(within))
    fixing = F.when(F.col("_outside") == F.col("_inside"), F.struct(F.col("_outside").alias("open"), F.col("_swaps").alias("swaps")))
    lines = lines.withColumn("_fixed", F.last(fixing, ignorenulls=True).over(within))

    # per split: its map, then the state at its start from the maps of all splits before it
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("_file", "_split").agg(F.max_by(F.struct("_fixed", "_swaps"), "_line").alias("m"))
    splits = splits.select("_file", "_split", F.col("m._fixed").alias("_fixed"), F.col("m._swaps").alias("_swaps"))
    total = F.sum("_swaps").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    splits = splits.withColumn("_total", total)
    reset = F.when(F.col("_fixed").isNotNull(), F.struct(
        F.col("_fixed.open").alias("open"), (F.col("_total") - F.col("_swaps") + F.col("_fixed.swaps")).alias("swaps")))
    splits = splits.select("_file", "_split", F.last(reset, ignorenulls=True).over(before).alias("fixed"), F.lag("_total", 1, 0).over(
        Window.partitionBy("_file").orderBy("_split")).alias("swaps"))
    splits = splits.select("_file", "_split", _open_after(F.lit(False), F.col("fixed"), F.col("swaps")).alias("_start"))

    lines = lines.join(splits, ["_file", "_split"])
    ends_open = _open_after(F.col("_start"), F.col("_fixed"), F.col("_swaps"))
    lines = lines.select("_file", "_split", "_line", "value", "_start", ends_open.alias("_ends_open"))
    by_line = Window.partitionBy("_file", "_split").orderBy("_line")
    lines = lines.withColumn("_begins", ~F.coalesce(F.lag("_ends_open").over(by_line), F.col("_start")))
    at = F.struct("_split", "_line")
    single = lines.where(F.col("_begins") & ~F.col("_ends_open")).select("_file", at.alias("_at"), F.col("value").alias("record"))

    # a record of several lines is named by its first one, which may lie in an earlier split
    spanning = lines.where(~F.col("_begins") | F.col("_ends_open")).withColumn("_own", F.last(F.when(F.col("_begins"), at), ignorenulls=True).over(
        by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = spanning.groupBy("_file", "_split").agg(F.max("_own").alias("_own"))
    carried = last.select("_file", "_split", F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    spanning = spanning.join(carried, ["_file", "_split"]).withColumn("_at", F.coalesce("_own", "_carried"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_line", "value"))), lambda part: part["value"]), "\n")
    records = single.unionByName(spanning.groupBy("_file", "_at").agg(joined.alias("record")))
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
