"""Tables kept in buckets of a key's hash, so that an increment rewrites the buckets it changes and leaves the files of all others.

A table is a folder of attempts, each holding the new rows of some buckets, and a log of small files: one per change, naming the attempt that now holds
each changed bucket. Of a bucket the newest named attempt counts. A change thus becomes visible as a whole when its log file is moved into place; a run
that dies before leaves an attempt that nobody names, and is simply run again. One writer at a time; readers that already listed their files go on reading them.

The number of buckets is settled when the table is made. It should put some 100 MB into each: an increment costs what its changed buckets
hold, whatever the table holds. Buckets are read and written by many tasks where they are large, so a parent with very many children is no single task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.session import cut_lineage

_ENTRY = "version bigint, bucket int, attempt string, rows bigint, buckets int"
_ACTIONS = ("inserted", "updated")


class BucketTable:
    """Rows of ``schema`` under ``path``, in buckets by ``key``: the row's own key, or its parent's for a table of children."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, list(key), buckets
        self.columns = spark.createDataFrame([], schema).columns
        if {"bucket", "attempt"} & set(self.columns):
            raise ValueError("columns bucket and attempt are the table's own")

    # -- what counts

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ENTRY)

    def state(self) -> dict[int, tuple[str, int]]:
        """Of every bucket the attempt that holds it and its rows: one entry a bucket."""
        newest = self._log().groupBy("bucket").agg(F.max_by(F.struct("attempt", "rows", "buckets"), "version").alias("e")).collect()
        if any(r.e.buckets != self.buckets for r in newest):
            raise ValueError(f"the table has {newest[0].e.buckets} buckets")
        return {r.bucket: (r.e.attempt, r.e.rows) for r in newest}

    def version(self) -> int:
        return self._log().agg(F.max("version")).first()[0] or 0

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: the files of others are not opened."""
        state = self.state()
        return self._open([(b, state[b][0]) for b in (state if only is None else only) if b in state and state[b][1]]).select(*self.columns)

    def _open(self, places: Sequence[tuple[int, str]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("basePath", f"{self.path}/data").schema(self.schema).parquet(*(f"{self.path}/data/attempt={a}/bucket={b}" for b, a in places))

    # -- changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.key)), F.lit(self.buckets)).cast("int")

    def _incoming(self, source: DataFrame) -> tuple[DataFrame, list[int]]:
        """The source with its buckets, written once, and the list of them."""
        if sorted(source.columns) != sorted(self.columns):
            raise ValueError(f"columns differ: {sorted(set(source.columns) ^ set(self.columns))}")
        rows = cut_lineage(source.select(*self.columns).withColumn("bucket", self._bucket()))
        return rows, sorted(r.bucket for r in rows.select("bucket").distinct().collect())

    def _replace(self, rows: DataFrame, changed: Sequence[int]) -> list[int]:
        """Makes ``rows`` the content of the buckets ``changed``, which may be left empty."""
        if not changed:
            return []
        attempt = uuid.uuid4().hex
        # large buckets are dealt to several tasks, small ones share one
        rows.select(*self.columns, "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/attempt={attempt}")
        counted = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/attempt={attempt}") if not rows.isEmpty() else rows
        sizes = {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        version = self.version() + 1
        entries = [(version, b, attempt, sizes.get(b, 0), self.buckets) for b in changed]
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return list(changed)

    def _same_key(self, a: str, b: str) -> Column:
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return same

    def upsert_changed(self, source: DataFrame, change_columns: Sequence[str]) -> DataFrame:
        """Inserts new keys and replaces rows whose tracked columns differ; gives the touched keys with ``inserted`` or ``updated``.

        Unchanged rows keep their stored version, and a bucket of nothing but such rows its files. A key that occurs twice in the source is an error.
        """
        rows, buckets = self._incoming(source)
        if rows.groupBy(*self.key).count().where("count > 1").limit(1).count():
            raise ValueError("the source has a key more than once")
        old = self.read(buckets).withColumn("bucket", self._bucket()).alias("o")
        both = old.join(rows.alias("n"), (F.col("o.bucket") == F.col("n.bucket")) & self._same_key("o", "n"), "full_outer")
        equal = F.lit(True)
        for c in change_columns:
            equal = equal & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        action = F.when(F.col("n.bucket").isNull(), "kept").when(F.col("o.bucket").isNull(), "inserted").when(equal, "unchanged").otherwise("updated")
        fresh = action.isin(*_ACTIONS)
        merged = cut_lineage(both.select(
            *(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.columns),
            F.coalesce("o.bucket", "n.bucket").alias("bucket"), action.alias("_action")))
        touched = merged.where(F.col("_action").isin(*_ACTIONS))
        changed = sorted(r.bucket for r in touched.select("bucket").distinct().collect())
        self._replace(merged.where(F.col("bucket").isin(changed)), changed)
        return touched.select(*self.key, F.col("_action").alias("action"))

    def upsert_all(self, source: DataFrame) -> list[int]:
        """The source wins on every key it has; gives the buckets rewritten."""
        rows, buckets = self._incoming(source)
        keys = rows.select("bucket", *self.key).distinct().alias("n")
        old = self.read(buckets).withColumn("bucket", self._bucket()).alias("o")
        rest = old.join(keys, (F.col("o.bucket") == F.col("n.bucket")) & self._same_key("o", "n"), "left_anti")
        return self._replace(rest.unionByName(rows), buckets)

    def replace_children(self, touched: DataFrame, fresh: DataFrame) -> list[int]:
        """Rows of the parents in ``touched`` (the table's key) become those of ``fresh``, none where it has none; gives the buckets rewritten."""
        parents = cut_lineage(touched.select(*self.key).distinct().withColumn("bucket", self._bucket()))
        buckets = sorted(r.bucket for r in parents.select("bucket").distinct().collect())
        same = (F.col("o.bucket") == F.col("n.bucket")) & self._same_key("o", "n")
        old = self.read(buckets).withColumn("bucket", self._bucket()).alias("o").join(parents.alias("n"), same, "left_anti")
        new = fresh.select(*self.columns).withColumn("bucket", self._bucket()).alias("o").join(parents.alias("n"), same, "left_semi")
        return self._replace(old.unionByName(new), buckets)

    def compact_log(self) -> None:
        """One log file in place of many: the state of all buckets under a new version. Older files stay, and count for nothing."""
        version = self.version() + 1
        entries = [(version, b, a, n, self.buckets) for b, (a, n) in self.state().items()]
        if entries:
            self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def forgotten(self) -> list[str]:
        """Folders of attempts and buckets that count no more; safe to delete once no reader uses them."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data").select("path")
        place = files.select(F.regexp_extract("path", "attempt=([0-9a-f]+)", 1).alias("attempt"), F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("int").alias("bucket")).distinct()
        counts = {(a, b) for b, (a, _) in self.state().items()}
        return sorted(f"attempt={r.attempt}/bucket={r.bucket}" for r in place.collect() if (r.attempt, r.bucket) not in counts)
