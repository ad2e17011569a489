"""Raw files' digests, runs, health of the sources, batch policy and counters, stored windows and the log of predictions."""

import datetime as dt
import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from strom.plans import fleet, learning, traffic
from strom.sources import lake
from strom.streaming import messages, telemetry
from tests.test_streaming import at, deliver, message

AT = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
MARK = b"\xef\xbb\xbf"
FILES = {
    "plain.csv": b"a;b\r\nc\rd\n" * 500, "open end.csv": b"x\ny" * 100 + b"z", "feed.csv": b"\n", "feeds.csv": b"\n" * 700, "marked.csv": (MARK + "Säule\nrest\n".encode()) * 40,
    "mark and open end.csv": MARK + b"abc", "mark only.csv": MARK, "mark and feed.csv": MARK + b"\n", "one.csv": b"a", "two.csv": b"ab", "a%20ä.dat": bytes(range(256)) * 90,
    "late feeds.csv": b"a\n\n\n", "packed.gz": gzip.compress(b"hello\n" * 10),
}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_digests_are_those_of_the_files_at_any_split(spark, tmp_path, small_splits):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "empty.csv").write_bytes(b"")
    want = {name: (hashlib.sha256(body).hexdigest(), len(body)) for name, body in FILES.items()}
    for size in ("128m", "997", "61"):
        small_splits(size)
        assert {r.file_name: (r.sha256, r.bytes) for r in lake.raw_manifest(spark, str(tmp_path), "k").collect()} == want


def test_a_large_file_is_no_row(spark, tmp_path, small_splits):
    body = b"".join(b"%d;%s\n" % (i, b"x" * (i % 90)) for i in range(60_000))
    (tmp_path / "large.csv").write_bytes(body)
    small_splits("200k")
    manifest = lake.raw_manifest(spark, str(tmp_path), "k")
    assert [r.sha256 for r in manifest.collect()] == [hashlib.sha256(body).hexdigest()]
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_a_run_names_its_files_and_its_error(spark, tmp_path):
    report = spark.createDataFrame([("rows_received", 5), ("rows_accepted", 4), ("rows_rejected", 1), ("rule:soc", 1)], "metric string, value bigint")
    sums = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    manifest = spark.createDataFrame([(s, 10) for s in sums], "sha256 string, bytes bigint")
    one = lake.run_record(report, "r", "weather", "p", "live", AT, AT, manifest.limit(1)).first()
    assert (one.source_file_sha256, one.bytes_downloaded, one.status, one.error_message) == (manifest.first().sha256, 10, "partial", None)
    many, again = (lake.source_digest(m).first() for m in (manifest, manifest.orderBy(F.desc("sha256")).repartition(7)))
    assert many == again and many.bytes_downloaded == 500 and many.source_file_sha256 not in sums
    assert lake.source_digest(manifest.limit(49)).first().source_file_sha256 != many.source_file_sha256
    none = lake.source_digest(manifest.limit(0)).first()
    assert (none.source_file_sha256, none.bytes_downloaded) == (None, 0)
    lake.record_run(str(tmp_path / "runs"), lake.run_record(report, "r", "weather", "p", "live", AT, AT, manifest))
    lake.record_run(str(tmp_path / "runs"), lake.run_record(report, "s", "weather", "p", "live", AT, AT, error="E" * 3000))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert got["r"].source_file_sha256 == many.source_file_sha256 and got["s"].status == "failed" and len(got["s"].error_message) == 2000


def test_health_has_the_terms_and_the_simulator(spark):
    runs = spark.createDataFrame([
        ("weather", "w", AT - dt.timedelta(days=1), "succeeded", "live", 10, 9, 1, 2, None, None),
        ("weather", "w", AT, "failed", "live", 0, 0, 0, 0, None, "no answer"),
        ("traffic", "t", AT, "succeeded", "live", 4, 3, 1, 0, "https://mirror", None),
        ("simulator", "s", AT, "failed", "live", 4, 3, 1, 0, None, "not looked at"),
        ("unheard of", "u", AT, "succeeded", "live", 1, 1, 0, 0, None, None),
    ], "source string, pipeline string, started_at timestamp, status string, provider_mode string, rows_received bigint, rows_accepted bigint, rows_rejected bigint, rows_duplicate bigint, source_url string, error_message string")
    got = fleet.quality_by_source(runs, spark.range(7), AT + dt.timedelta(minutes=30)).collect()
    assert [(r.source, r.source_status) for r in got] == [("weather", "failed"), ("traffic", "healthy"), ("unheard of", "healthy"), ("simulator", "simulation")]
    weather, road, other, simulator = got
    assert (weather.licence, weather.error_message, weather.acceptance_rate, weather.age_minutes) == ("CC BY 4.0", "no answer", 0.0, 30.0)
    assert (road.licence, road.source_url, road.acceptance_rate) == (None, "https://mirror", 75.0) and other.licence is None and other.attribution is None
    assert (simulator.rows_received, simulator.rows_accepted, simulator.acceptance_rate, simulator.last_run_at, simulator.error_message, simulator.data_origin) == (7, 7, 100.0, None, None, "simulated")
    assert fleet.quality_by_source(runs.limit(0), spark.range(0), AT).first().acceptance_rate == 0.0


def test_traffic_features_draw_a_line_where_there_is_one(spark):
    events = spark.sql("""select * from values
        ('b', 'low', null, 50.0D, 9.0D), ('a', 'severe', array(named_struct('ordinal', 1, 'latitude', 51.0D, 'longitude', 8.0D), named_struct('ordinal', 0, 'latitude', 50.5D, 'longitude', 9.5D)), 50.0D, 9.0D),
        ('c', 'low', null, 40.0D, 1.0D) as t(traffic_event_id, severity, geometry, latitude, longitude)""").selectExpr(
        "*", "'x' external_id", "'closure' event_type", "true is_blocked", "cast(null as string) road_name", "'N' direction", "'say \"no\"' title", "cast(null as double) delay_minutes")
    got = traffic.geojson_features(events, cap=2).collect()
    first, second = (json.loads(r.feature) for r in got)
    assert first["geometry"] == {"type": "LineString", "coordinates": [[9.5, 50.5], [8.0, 51.0]]} and second["geometry"] == {"type": "Point", "coordinates": [9.0, 50.0]}
    assert second["properties"] == {"external_id": "x", "event_type": "closure", "severity": "low", "is_blocked": True, "road_name": None, "direction": "N", "title": 'say "no"', "delay_minutes": None, "geometry_kind": "Point"}
    # the extent is that of what is given out
    assert {(r.total_matching, r.truncated, r.west, r.south, r.east, r.north) for r in got} == {(3, True, 8.0, 50.0, 9.5, 51.0)}
    assert traffic.geojson_features(events.limit(0)).count() == 0


def stream_of(spark, folder, policy):
    return messages.parse_envelope(messages.read_messages(spark, str(folder), policy.options(str(folder))), "telemetry")


def test_batches_stay_within_the_policy_and_the_backlog_is_told(spark, tmp_path):
    policy, folder, cp = telemetry.BatchPolicy(files=2), tmp_path / "in", str(tmp_path / "cp")
    for i in range(5):
        deliver(folder, i, message(f"e{i}", at(i)), "{broken")
    assert telemetry.files_behind(spark, str(folder), cp) == 5
    totals = telemetry.run_counted(stream_of(spark, folder, policy), telemetry.append_batch(str(tmp_path / "out")), cp)
    assert (totals.batches, totals.consumed, totals.written, totals.rejected, totals.errors) == (3, 10, 5, 5, 0)
    assert sorted(r.consumed for r in totals.table(spark).collect()) == [2, 4, 4] and totals.lag is None
    assert telemetry.files_behind(spark, str(folder), cp) == 0
    for i in range(5, 8):
        deliver(folder, i, message(f"e{i}", at(i)))
    assert telemetry.files_behind(spark, str(folder), cp) == 3


def test_a_failed_run_is_an_error_and_its_rows_count_once(spark, tmp_path):
    folder, cp, write = tmp_path / "in", str(tmp_path / "cp"), telemetry.append_batch(str(tmp_path / "out"))
    for i in range(4):
        deliver(folder, i, message(f"e{i}", at(i)))

    def breaks(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("no space")
        write(batch, batch_id)

    policy = telemetry.BatchPolicy(files=2)
    first = telemetry.run_counted(stream_of(spark, folder, policy), breaks, cp)
    assert (first.errors, first.written) == (1, 2)
    second = telemetry.run_counted(stream_of(spark, folder, policy), write, cp)
    assert (second.errors, second.written) == (0, 2)
    assert spark.read.parquet(str(tmp_path / "out/telemetry")).count() == 4


def test_lag_is_the_sum_over_partitions_or_unknown():
    end, latest = json.dumps({"t": {"0": 5, "1": 7}}), json.dumps({"t": {"0": 9, "1": 7, "2": 3}})
    assert telemetry.messages_behind(end, latest) == 7 and telemetry.messages_behind(latest, latest) == 0
    assert telemetry.messages_behind(end, None) is None and telemetry.messages_behind('{"logOffset":3}', '{"logOffset":4}') is None and telemetry.messages_behind("x", latest) is None
    assert telemetry.BatchPolicy().options("kafka") == {"minOffsetsPerTrigger": "500", "maxTriggerDelay": "1s", "maxOffsetsPerTrigger": "1000000"}


def test_windows_without_their_columns_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no training windows"):
        learning.load_training_windows(spark, str(tmp_path / "none"))
    spark.range(3).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="missing columns: speed_kmh"):
        learning.load_training_windows(spark, str(tmp_path / "odd"))


def test_predictions_are_only_ever_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    scored = spark.range(3).select(
        F.concat(F.lit("T"), "id").alias("trip_id"), F.lit(AT).alias("window_start"), *(F.lit(1.0).alias(c) for c in learning.FEATURES), F.lit(18.5).alias("predicted"), F.lit(17.0).alias("baseline"),
        F.lit("r1").alias("route_id"), F.create_map(F.lit("speed_kmh"), F.lit(0.5)).alias("contributions"))
    for call, part in (("1", scored), ("1", scored), ("2", scored.drop("contributions"))):
        learning.append_predictions(path, part, "linear", call, AT, ["route_id"])
    got = learning.logged_predictions(spark, path).collect()
    assert len(got) == 6 == len({r.prediction_id for r in got}) and {r.call for r in got} == {"1", "2"}
    assert {r.context for r in got} == {'{"route_id":"r1"}'} and {r.contributions for r in got if r.call == "1"} == {'{"speed_kmh":0.5}'} and {r.contributions for r in got if r.call == "2"} == {None}
    assert set(json.loads(got[0].features)) == set(learning.FEATURES)
    assert os.path.isdir(f"{path}/call=1")
