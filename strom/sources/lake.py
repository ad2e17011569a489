"""Parquet lake: zones, datasets, one folder per day; idempotent partition writes and an inventory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ZONES = ("raw", "bronze", "silver", "gold")
ROWS_PER_FILE = 50_000


def dataset_path(root: str, zone: str, dataset: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone}")
    return f"{root}/{zone}/{dataset}"


def write_partition(df: DataFrame, root: str, zone: str, dataset: str, day: date) -> bool:
    """Replaces one day of a dataset, so a rerun leaves the same state. Empty input writes nothing."""
    if df.isEmpty():
        return False
    (
        df.withColumn("dt", F.lit(day.isoformat())).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("dt")
        .parquet(dataset_path(root, zone, dataset))
    )
    return True


def read_lake(spark: SparkSession, root: str, zone: str, dataset: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(dataset_path(root, zone, dataset))


def register_lake_views(spark: SparkSession, root: str, datasets: list[tuple[str, str]]) -> list[str]:
    """Every dataset as the temporary view ``zone_dataset``."""
    names = []
    for zone, dataset in datasets:
        name = f"{zone}_{dataset}"
        read_lake(spark, root, zone, dataset).createOrReplaceTempView(name)
        names.append(name)
    return names


def lake_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    return spark.sql(sql, args=args or {})


def describe_lake(spark: SparkSession, root: str, datasets: list[tuple[str, str]]) -> DataFrame:
    """Files, bytes and rows per dataset and day, from file metadata."""
    out = None
    for zone, dataset in datasets:
        files = read_lake(spark, root, zone, dataset).select("dt", "_metadata.file_path", "_metadata.file_size")
        per_file = files.groupBy("dt", "file_path").agg(F.first("file_size").alias("file_size"), F.count(F.lit(1)).alias("_rows"))
        part = per_file.groupBy("dt").agg(
            F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("_rows").alias("rows")
        ).select(F.lit(zone).alias("zone"), F.lit(dataset).alias("dataset"), "dt", "files", "bytes", "rows")
        out = part if out is None else out.unionByName(part)
    return out


# fixed values: endings of files that the line reader would unpack, and the mark it leaves out at a file's start
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
_MARK = b"\xef\xbb\xbf"


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, sha256) from (file, bytes, line) in the files' own order; a file may go on in the next batch."""
    file, size, seen, sums = None, 0, 0, ()

    def closed() -> pa.RecordBatch:
        # a line feed after the last line and the mark are told apart by the length of what was read: it lacks the mark's three bytes or not
        marked = seen + len(_MARK) in (size, size + 1)
        whole = sums[1] if marked else sums[0]
        if seen + len(_MARK) * marked == size:
            whole.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([whole.hexdigest()], pa.string())], names=["file", "sha256"])

    for batch in rows:
        names, sizes, lines = batch.column(0), batch.column(1), batch.column(2)
        runs = pc.run_end_encode(names)
        low = 0
        for name, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != file:
                if file is not None:
                    yield closed()
                file, size, seen, sums = name, sizes[low].as_py(), 0, (hashlib.sha256(), hashlib.sha256(_MARK))
            # the feed of a line is added once another one follows
            block = (b"\n" if seen else b"") + b"\n".join(lines.slice(low, high - low).to_pylist())
            for one in sums:
                one.update(block)
            seen += len(block) + (0 if seen else 1)
            low = high
    if file is not None:
        yield closed()


def raw_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Digest and size of every raw file under a path.

    Files are read in splits, as lines up to a line feed, and put back into their order by one shuffle; each file's bytes then stream through its digest. No
    file is held whole, whatever its size, only its longest line. The line reader unpacks compressed files, so those are read as one value
    each, up to 2 GB. Files without a byte are not listed, since Spark's readers pass them over.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime")
    packed = F.col("file").rlike(r"(?i)(" + "|".join(e.replace(".", r"\.") for e in _PACKED) + ")$")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number")).where(~packed)
    ordered = lines.repartition("file").sortWithinPartitions("file", "start", "number").select("file", "bytes", "line")
    whole = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content").where(packed)
    digests = ordered.mapInArrow(_digests, "file string, sha256 string").unionByName(whole.select("file", F.sha2("content", 256).alias("sha256")))
    return files.join(digests, F.col("path") == F.col("file"), "left").select(
        "file_name", F.lit(kind).alias("kind"), F.coalesce("sha256", F.sha2(F.lit(_MARK), 256)).alias("sha256"),  # without a line there is only the mark
        F.col("length").alias("bytes"), F.col("modificationTime").alias("fetched_at"),
    )


def source_digest(manifest: DataFrame) -> DataFrame:
    """One row: ``source_file_sha256`` and ``bytes_downloaded`` of a run's files; the digest of a single file is its own.

    Several files are told by a digest of their sorted digests, in 4 096 parts, so that no list grows with the number of files.
    """
    parts = manifest.groupBy(F.substring("sha256", 1, 3).alias("_part")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ","), 256).alias("_sha"), F.count(F.lit(1)).alias("_n"),
        F.min("sha256").alias("_first"), F.sum("bytes").alias("_bytes"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_sha"))), lambda p: p["_sha"]), ",")
    digest = F.when(F.sum("_n") == 1, F.min("_first")).when(F.sum("_n") > 1, F.sha2(listed, 256))
    return parts.agg(digest.alias("source_file_sha256"), F.coalesce(F.sum("_bytes"), F.lit(0)).cast("bigint").alias("bytes_downloaded"))


def run_record(
    report: DataFrame, run_id: str, source: str, pipeline: str, provider_mode: str, started_at, finished_at,
    manifest: DataFrame | None = None, source_url: str | None = None, error: str | None = None,
) -> DataFrame:
    """One row per run from a quality report's (metric, value) rows, with the digest of its files in ``manifest``.

    A run with an ``error`` has failed, whatever it counted until then; only the message's first 2 000 characters are kept.
    """
    def metric(name: str):
        return F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(0).cast("bigint")).alias(name)

    counters = [metric(f"rows_{n}") for n in ("received", "accepted", "rejected", "duplicate")]
    rules = F.sort_array(F.collect_list(F.when(F.col("metric").startswith("rule:"), F.struct("metric", "value"))))
    row = report.agg(*counters, F.to_json(rules).alias("quality_report"))
    status = F.when(F.col("rows_rejected") > 0, "partial").otherwise("succeeded")
    files = {"source_file_sha256": F.lit(None).cast("string"), "bytes_downloaded": F.lit(None).cast("bigint")}
    if manifest is not None:
        digest = source_digest(manifest)
        files = {c: digest.select(c).scalar() for c in files}
    return row.withColumns({
        "id": F.lit(run_id), "source": F.lit(source), "pipeline": F.lit(pipeline), "provider_mode": F.lit(provider_mode),
        "started_at": F.lit(started_at), "finished_at": F.lit(finished_at), "status": status if error is None else F.lit("failed"), **files,
        "source_url": F.lit(source_url).cast("string"), "error_message": F.lit(None if error is None else error[:2000]).cast("string"),
    })


def record_run(path: str, run: DataFrame) -> None:
    """Appends a run's row to the table of runs."""
    run.coalesce(1).write.mode("append").parquet(path)
