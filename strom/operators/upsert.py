"""Upserts without a table format: most return the new state of the target, ``upsert_days`` rewrites the touched day folders in place."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.operators.sizes import join_to_dimension
from strom.session import cut_lineage


def _same_columns(target: DataFrame, source: DataFrame) -> None:
    if sorted(target.columns) != sorted(source.columns):
        raise ValueError(f"columns differ: {sorted(set(target.columns) ^ set(source.columns))}")


def upsert_changed(target: DataFrame, source: DataFrame, key: str, change_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Inserts new keys and replaces rows whose tracked columns differ.

    Returns the new snapshot and the touched keys with ``inserted`` or ``updated``. Unchanged rows
    keep their stored version.
    """
    _same_columns(target, source)
    columns = [c for c in target.columns if c != key]
    old = target.select(key, F.struct(*columns).alias("_old"))
    new = source.select(key, F.struct(*columns).alias("_new"))
    both = old.join(new, key, "full_outer")
    equal = F.lit(True)
    for c in change_columns:
        equal = equal & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    action = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted")
        .when(equal, "unchanged").otherwise("updated")
    )
    merged = both.withColumn("_action", action)
    row = F.when(F.col("_action").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    snapshot = merged.select(key, row.alias("_row")).select(key, "_row.*").select(*target.columns)
    touched = merged.where(F.col("_action").isin("inserted", "updated")).select(key, F.col("_action").alias("action"))
    return snapshot, touched


def upsert_all(target: DataFrame, source: DataFrame, *key: str) -> DataFrame:
    """The source wins on every key it has."""
    _same_columns(target, source)
    return target.join(source.select(*key), list(key), "left_anti").unionByName(source)


def replace_children(children: DataFrame, fresh: DataFrame, touched: DataFrame, parent: str) -> DataFrame:
    """Children of touched parents are replaced by the fresh ones, all others stay."""
    parents = touched.select(parent).distinct()
    return children.join(parents, parent, "left_anti").unionByName(fresh.join(parents, parent, "left_semi"))


def close_vanished(target: DataFrame, polled: DataFrame, answered: DataFrame, key: str, road: str, as_of: datetime, mode: str = "live") -> DataFrame:
    """Open-ended events on a road that answered, but no longer listed, end now. Nothing closes on replayed data."""
    if mode == "fixture":
        return target
    present = polled.select(key).distinct().withColumn("_present", F.lit(True))
    roads = answered.select(road).distinct().withColumn("_answered", F.lit(True))
    marked = join_to_dimension(target.join(present, key, "left"), roads, [road], "left", 200_000, F.col(key))
    gone = F.col("ends_at").isNull() & F.col("_answered").isNotNull() & F.col("_present").isNull()
    return marked.withColumn("ends_at", F.when(gone, F.lit(as_of)).otherwise(F.col("ends_at"))).select(*target.columns)


def incremental_delete_insert(
    target: DataFrame | None, source: DataFrame, key: str, ts: str, lookback_minutes: int, build=lambda df: df
) -> DataFrame:
    """New state after re-reading the source from the look-back point and replacing the rows it yields.

    The first run loads everything, and so does one that finds the target empty. A change of the columns is an error. ``build`` derives the target
    rows from the re-read part only.
    """
    if target is None:
        return build(source)
    since = target.agg((F.max(ts) - F.expr(f"interval {lookback_minutes} minutes")).alias("t")).scalar()
    recent = build(source.where(F.coalesce(F.col(ts) >= since, since.isNull())))
    _same_columns(target, recent)
    return target.join(recent.select(key), key, "left_anti").unionByName(recent)


def upsert_days(
    path: str, source: DataFrame, key: str, ts: str, lookback_minutes: int, build=lambda df: df, key_moves: bool = True
) -> list:
    """``incremental_delete_insert`` in place on a dataset stored in one folder per day (``dt``); returns the days rewritten.

    Only the days that re-read rows fall into are read whole and written anew, all other folders keep their files. If ``key_moves``, rows
    may come back on another day than they were stored on: the days of their old versions, found from the stored keys alone, are
    rewritten as well. A day left without rows loses its folder. Rows without ``ts`` are stored under a null day. A run that dies
    is simply run again.
    """
    spark = source.sparkSession
    files = _folder(spark, path)
    day = F.to_date(ts).alias("dt")
    if not files.exists(""):
        rows = build(source)
        rows.select("*", day).write.partitionBy("dt").parquet(path)
        return sorted((r.dt for r in spark.read.parquet(path).select("dt").distinct().collect()), key=str)
    stored = spark.read.parquet(path)
    stored = stored.withColumn("dt", F.col("dt").cast("date"))
    since = stored.agg((F.max(ts) - F.expr(f"interval {lookback_minutes} minutes")).alias("t")).scalar()
    recent = cut_lineage(build(source.where(F.coalesce(F.col(ts) >= since, since.isNull()))).select("*", day))
    _same_columns(stored, recent)
    touched = recent.select("dt")
    if key_moves:
        touched = touched.union(stored.select(key, "dt").join(recent.select(key), key, "left_semi").select("dt"))
    days = sorted((r.dt for r in touched.distinct().collect()), key=str)  # as many as the increment has days
    if not days:
        return days
    wanted = F.col("dt").isin([d for d in days if d is not None])
    wanted = (F.coalesce(wanted, F.lit(False)) | F.col("dt").isNull()) if None in days else wanted
    fresh = cut_lineage(stored.where(wanted).join(recent.select(key), key, "left_anti").unionByName(recent))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    left = {r.dt for r in fresh.select("dt").distinct().collect()}
    for gone in set(days) - left:
        files.delete(f"dt={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone.isoformat()}")
    return days


class _folder:
    """Looks up and deletes below a folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root, self._system = path, self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._system.exists(self._path(f"{self._root}/{name}"))

    def delete(self, name: str) -> None:
        self._system.delete(self._path(f"{self._root}/{name}"), True)
