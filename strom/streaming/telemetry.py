"""Telemetry stream jobs: append with rejects, deduplication, newest state per vehicle, counters."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strom.streaming.messages import good, rejects

# fixed values: flush policy of the consumer
TRIGGER_SECONDS = 1
ROWS_PER_BATCH = 500


@dataclass(frozen=True)
class BatchPolicy:
    """When a micro-batch starts, and how much one may read at most.

    A batch starts once ``rows`` messages wait or ``seconds`` have passed. A backlog is worked off in batches of at most ``most_rows`` messages or, from a folder,
    ``files`` files, so that no batch grows with the backlog.
    """

    rows: int = ROWS_PER_BATCH
    seconds: int = TRIGGER_SECONDS
    most_rows: int = 1_000_000
    files: int = 1_000

    def options(self, source: str) -> dict[str, str]:
        """Reader options of a ``kafka`` source or a folder."""
        if source == "kafka":
            return {"minOffsetsPerTrigger": str(self.rows), "maxTriggerDelay": f"{self.seconds}s", "maxOffsetsPerTrigger": str(self.most_rows)}
        return {"maxFilesPerTrigger": str(self.files)}


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a parsed micro-batch: good rows and rejects side by side, one folder per batch.

    A batch that is delivered again after a failure overwrites its own folder, so each source row
    ends up in the table exactly once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good(batch).write.mode("overwrite").parquet(f"{path}/telemetry/batch={batch_id}")
            rejects(batch).write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def update_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Appends the changed rows of a stateful query under their batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_version(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest version of every key written by ``update_batch``."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def dedupe_events(parsed: DataFrame, watermark: str = "30 minutes") -> DataFrame:
    """Each event once, however often it is delivered inside the watermark."""
    return parsed.withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["event_id"])


def vehicle_state(telemetry: DataFrame) -> DataFrame:
    """Newest sample per vehicle as a running aggregate; the first seen wins a tie."""
    newest = F.max_by(F.struct("recorded_at", "trip_id", "state", "speed_kmh", "battery_soc_percent"), F.struct("recorded_at", F.col("event_id")))
    return telemetry.groupBy("vehicle_id").agg(newest.alias("_r")).select("vehicle_id", "_r.*")


def delta_feed(states: DataFrame, since, cap: int = 1000, after: str | None = None) -> DataFrame:
    """Vehicles seen after the cursor, at most ``cap`` per poll, in the order of time and id.

    The cursor of the next poll is the last row's time and, as ``after``, its vehicle: nothing beyond a full poll is skipped.
    """
    newer = F.col("recorded_at") > F.lit(since)
    if after is not None:
        newer = newer | ((F.col("recorded_at") == F.lit(since)) & (F.col("vehicle_id") > after))
    return states.where(newer).orderBy("recorded_at", "vehicle_id").limit(cap)


def counted(parsed: DataFrame, name: str = "stream_counters") -> DataFrame:
    """Publishes consumed, written and rejected counts with each micro-batch."""
    bad = F.col("reject_reason").isNotNull()
    return parsed.observe(name, F.count(F.lit(1)).alias("consumed"), F.count_if(~bad).alias("written"), F.count_if(bad).alias("rejected"))


def messages_behind(end_offset: str | None, latest_offset: str | None) -> int | None:
    """Messages between a batch's end and the end of the log, over all partitions; None where the source does not tell both."""
    try:
        end, latest = json.loads(end_offset or "null"), json.loads(latest_offset or "null")
    except ValueError:
        return None
    if not (isinstance(end, dict) and isinstance(latest, dict) and all(isinstance(x, dict) for x in (*end.values(), *latest.values()))):
        return None
    return sum(max(0, last - end.get(topic, {}).get(part, 0)) for topic, parts in latest.items() for part, last in parts.items())


def files_behind(spark: SparkSession, folder: str, checkpoint: str, source: int = 0) -> int:
    """Files of a folder that its stream has not taken yet, by the source's own log; worked out in tasks, only the number comes back.

    Files without a byte hold no message and are not counted.
    """
    # the log and a reader write a scheme without a host in different ways
    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/").alias("path")

    listed = spark.read.format("binaryFile").load(folder).select(plain(F.col("_metadata.file_path")))
    try:
        log = spark.read.text(f"{checkpoint}/sources/{source}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return listed.count()
    taken = log.where("value like '{%'").select(plain(F.get_json_object("value", "$.path")))
    return listed.join(taken, "path", "left_anti").count()


def progress_rows(query: StreamingQuery, name: str = "stream_counters") -> list[tuple[int, int, int]]:
    """(batch, consumed, rejected) from a query's own progress reports, which are those of its last batches only."""
    rows = []
    for progress in query.recentProgress:
        metrics = progress.observedMetrics.get(name) if hasattr(progress, "observedMetrics") else progress["observedMetrics"].get(name)
        if metrics is not None:
            rows.append((int(progress.batchId), int(metrics["consumed"]), int(metrics["rejected"])))
    return rows


class Counters(StreamingQueryListener):
    """Totals and one row per batch of the observed query; also tells how its run ended.

    A batch is reported once its sink is through, so rows of batches that failed are in no count; ``errors`` are runs that ended by one. ``lag`` is that of the last batch:
    None before the first one and where the source does not tell it.
    """

    ROW = "batch bigint, consumed bigint, written bigint, rejected bigint, lag bigint, duration_ms bigint"

    def __init__(self, name: str = "stream_counters"):
        self.name, self.batches, self.consumed, self.written, self.rejected, self.errors, self.last_batch = name, 0, 0, 0, 0, 0, -1
        self.lag: int | None = None
        self.rows: list[tuple] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics.get(self.name)
        if metrics is not None:
            behind = [messages_behind(source.endOffset, source.latestOffset) for source in progress.sources]
            self.lag = None if None in behind or not behind else sum(behind)
            counts = [int(metrics[c]) for c in ("consumed", "written", "rejected")]
            self.batches, self.consumed, self.written, self.rejected = (x + y for x, y in zip((self.batches, self.consumed, self.written, self.rejected), (1, *counts)))
            self.rows.append((int(progress.batchId), *counts, self.lag, int(progress.batchDuration)))
        self.last_batch = max(self.last_batch, int(progress.batchId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.errors += event.exception is not None
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per batch of this run, to be appended to a table of metrics."""
        return spark.createDataFrame(self.rows, self.ROW)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is available and stops; the checkpoint makes a rerun continue where this one ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_counted(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "stream_counters") -> Counters:
    """``run_to_end`` with counts over all batches of the run, however many. A run that fails is counted as an error and can be run again."""
    spark, totals = stream.sparkSession, Counters(name)
    spark.streams.addListener(totals)
    try:
        query = counted(stream, name).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            pass
        # events come after the query's end; that of the end is the last one
        for _ in range(600):
            if str(query.runId) in totals.ended:
                break
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(totals)
    return totals


def run_continuously(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", policy: BatchPolicy = BatchPolicy()) -> StreamingQuery:
    """Micro-batches by the policy's clock, as long as the query runs; its bounds are the reader's options."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        processingTime=f"{policy.seconds} seconds").start()
