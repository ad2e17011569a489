"""Tables that a stream writes batch by batch, each batch visible as one unit.

A batch first writes the rows of all its tables into folders of its own attempt, and then a single small file that names them. Readers only open folders that such
a file names, so a run that dies between two tables shows nothing of its batch, and the same batch, delivered again, starts a new attempt.
A batch that is already named is not written again. Folders of attempts nobody names are left for ``unnamed`` to list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "batch bigint, table string, attempt string, rows bigint"


class BatchLog:
    """Commit log of the tables under ``path``; ``schemas`` names them with the columns they have."""

    def __init__(self, path: str, schemas: Mapping[str, str]):
        self.path, self.schemas = path, dict(schemas)

    def _entries(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(_ENTRY).json(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _ENTRY)

    def committed(self, spark: SparkSession, batch_id: int | None = None) -> list[int]:
        """The batches that count, one number each; only ``batch_id`` where given."""
        entries = self._entries(spark)
        found = entries if batch_id is None else entries.where(F.col("batch") == batch_id)
        return sorted(r.batch for r in found.select("batch").distinct().collect())

    def write(self, tables: Mapping[str, DataFrame], batch_id: int) -> bool:
        """Writes a batch's rows of each table and makes them count together; False where that batch already does."""
        if unknown := set(tables) - set(self.schemas):
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        spark = next(iter(tables.values())).sparkSession
        if self.committed(spark, batch_id):
            return False
        attempt, entries = uuid.uuid4().hex, []
        for name, rows in tables.items():
            folder = f"{self.path}/{name}/batch={batch_id}/attempt={attempt}"
            self._write_table(rows, folder)
            entries.append((batch_id, name, attempt, spark.read.schema(self.schemas[name]).parquet(folder).count()))
        # one file, moved into place when it is complete: this is the moment the batch counts
        spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return True

    def _write_table(self, rows: DataFrame, folder: str) -> None:
        rows.write.parquet(folder)

    def read(self, spark: SparkSession, table: str, with_batch: bool = False) -> DataFrame:
        """The rows of all batches that count."""
        schema = self.schemas[table]
        entries = self._entries(spark).where((F.col("table") == table) & (F.col("rows") > 0)).collect()
        folders = [f"{self.path}/{table}/batch={e.batch}/attempt={e.attempt}" for e in entries]
        if not folders:
            return spark.createDataFrame([], schema + (", batch bigint" if with_batch else ""))
        rows = spark.read.option("basePath", f"{self.path}/{table}").schema(f"{schema}, batch bigint, attempt string").parquet(*folders)
        return rows.drop("attempt") if with_batch else rows.drop("attempt", "batch")

    def latest(self, spark: SparkSession, table: str, *keys: str) -> DataFrame:
        """The newest version of every key."""
        rows = self.read(spark, table, with_batch=True)
        others = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")

    def unnamed(self, spark: SparkSession, table: str) -> list[str]:
        """Attempts with files that no commit names: what a run left that died. Safe to delete once no writer runs."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{table}").select("path")
        attempt = F.regexp_extract("path", "attempt(?:=|%3D)([0-9a-f]+)", 1).alias("attempt")
        named = self._entries(spark).where(F.col("table") == table).select("attempt")
        return sorted(unquote(r.attempt) for r in files.select(attempt).distinct().join(named, "attempt", "left_anti").collect())


def commit_parts(log: BatchLog, part: str = "part") -> Callable[[DataFrame, int], None]:
    """A sink for a stream whose rows name their table in ``part`` and hold that table's row in the column of that name."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            log.write({name: batch.where(F.col(part) == name).select(f"{name}.*") for name in log.schemas}, batch_id)
        finally:
            batch.unpersist()

    return write


def parts(tables: Mapping[str, DataFrame], part: str = "part") -> DataFrame:
    """Several branches of one stream as one, so that they advance and are committed together."""
    out = None
    for name, rows in tables.items():
        one = rows.select(F.lit(name).alias(part), F.struct(*rows.columns).alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
