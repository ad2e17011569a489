"""Queries and oracles: telemetry stream jobs and charging plans."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.plans import analysis, chargeplan, fleet, learning
from strom.plans.corridors import best_per_stretch
from strom.plans.trips import rounded
from strom.registry import corridors as C
from strom.registry.energy import WINDOW_ROW_SQL, conditions, vehicle_profiles
from strom.registry.fleet_models import models
from strom.registry.oracle import RELATIONS, Registry, relation
from strom.session import checkpoint_root
from strom.sources.driver import Tables
from strom.streaming import messages, state, telemetry
from strom.streaming.commits import BatchLog, parts
from strom.streaming.ordered import DAY_US

REG = Registry()
CURSOR = dt.datetime(2024, 1, 28, 0, 0, 30, tzinfo=dt.UTC)
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_FIELDS = [f.strip().rsplit(" ", 1)[0] for f in messages.PAYLOADS["telemetry"].split(",")]


def _folder(t: Tables) -> str:
    return f"{checkpoint_root(t.spark)}/strom-stream-{uuid.uuid4().hex}"


def published(t: Tables, copies: int = 1) -> str:
    """Telemetry as JSON messages in a folder; some are cut off, some carry an impossible speed."""
    path = _folder(t)
    speed = F.when(F.col("telemetry_id") % 43 == 0, -1.0).otherwise(F.col("speed_kmh"))
    rows = t.telemetry.withColumn("speed_kmh", speed)
    text = F.to_json(F.struct(
        F.concat(F.lit("e"), F.col("telemetry_id").cast("string")).alias("event_id"), F.lit("telemetry").alias("event_type"), F.lit(1).alias("schema_version"),
        F.col("recorded_at").alias("occurred_at"), F.lit("fleet").alias("producer"), "data_origin", F.struct(*_FIELDS).alias("payload")), _MICROS)
    broken = F.when(F.col("telemetry_id") % 31 == 0, F.substring(text, 1, 40)).otherwise(text)
    lines = rows.select(broken.alias("value"))
    for _ in range(copies):
        lines.write.mode("append").text(path)
    return path


relation("published", """
    select telemetry_id, vehicle_id, trip_id, recorded_at, battery_soc_percent, cumulative_energy_kwh, odometer_m, speed_kmh, state, latitude,
           case when telemetry_id % 31 = 0 then 'malformed' when telemetry_id % 43 = 0 then 'speed_kmh'
                when battery_soc_percent is null or battery_soc_percent not between 0 and 100 then 'battery_soc_percent'
                when cumulative_energy_kwh < 0 then 'cumulative_energy_kwh' when odometer_m < 0 then 'odometer_m' end as reject_reason
    from telemetry""")


def parsed_stream(t: Tables, copies: int = 1, files: int | None = None) -> DataFrame:
    return messages.parse_envelope(messages.read_messages(t.spark, published(t, copies), files_per_trigger=files), "telemetry")


def _appended(t: Tables) -> str:
    path = _folder(t)
    telemetry.run_to_end(parsed_stream(t, files=2), telemetry.append_batch(path), f"{path}/checkpoint")
    return path


REG.add("stream_append", lambda t: rounded(t.spark.read.parquet(_appended(t) + "/telemetry").select(
    "event_id", "vehicle_id", "trip_id", "recorded_at", "speed_kmh", "odometer_m")),
    "select 'e' || telemetry_id as event_id, vehicle_id, trip_id, recorded_at, speed_kmh, odometer_m from published where reject_reason is null")
REG.add("stream_rejects", lambda t: t.spark.read.parquet(_appended(t) + "/rejects").groupBy("reject_reason").agg(F.count("*").alias("messages")),
        "select reject_reason, count(*) as messages from published where reject_reason is not null group by 1")


def _deduped(t: Tables):
    path = _folder(t)
    stream = messages.good(parsed_stream(t, copies=2))
    telemetry.run_to_end(telemetry.dedupe_events(stream), telemetry.update_batch(f"{path}/once"), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/once").groupBy("event_id").agg(F.count("*").alias("copies"))


REG.add("stream_dedupe", _deduped, "select 'e' || telemetry_id as event_id, 1::bigint as copies from published where reject_reason is null")


def _vehicle_state(t: Tables) -> DataFrame:
    path = _folder(t)
    stream = telemetry.vehicle_state(messages.good(parsed_stream(t, files=2)))
    telemetry.run_to_end(stream, telemetry.update_batch(f"{path}/vehicles"), f"{path}/checkpoint", "update")
    return telemetry.latest_version(t.spark, f"{path}/vehicles", "vehicle_id")


relation("newest_published", "select * from published where reject_reason is null qualify row_number() over (partition by vehicle_id order by recorded_at desc, 'e' || telemetry_id desc) = 1")
_STATE = "vehicle_id, recorded_at, trip_id, state, speed_kmh, round(battery_soc_percent, 6) as battery_soc_percent"
REG.add("stream_vehicle_state", lambda t: rounded(_vehicle_state(t)), f"select {_STATE} from newest_published")
REG.add("stream_delta_feed", lambda t: rounded(telemetry.delta_feed(_vehicle_state(t), CURSOR)),
        f"select {_STATE} from newest_published where recorded_at > timestamp '2024-01-28 00:00:30' order by recorded_at, vehicle_id limit 1000")


def finish_messages(t: Tables) -> DataFrame:
    """The end of every closed trip as a JSON message, with its time."""
    body = F.to_json(F.struct(
        F.concat(F.lit("x"), "trip_id").alias("event_id"), F.lit("trip_event").alias("event_type"), F.lit(1).alias("schema_version"), F.col("ended_at").alias("occurred_at"),
        F.lit("fleet").alias("producer"), "data_origin", F.struct(
            F.lit("finished").alias("event_type"), "trip_id", F.substring_index("trip_id", "-", 1).alias("vehicle_id"), F.col("ended_at").alias("occurred_at"), F.col("end_soc_percent").alias("soc_percent"),
            F.round("distance_m", 3).alias("distance_m")).alias("payload")), _MICROS)
    return t.trips.where("ended_at is not null").select(body.alias("value"), F.col("ended_at").alias("at"))


def trip_rows(t: Tables, stream: DataFrame) -> DataFrame:
    """Telemetry and trip events as one stream of rows keyed by trip."""
    samples = stream.select(
        "trip_id", F.lit("telemetry").alias("kind"), F.col("recorded_at").alias("at"), F.substring("event_id", 2, 20).cast("bigint").alias("sequence"), "state",
        F.col("odometer_m").alias("distance_m"), F.col("cumulative_energy_kwh").alias("energy_kwh"), F.col("battery_soc_percent").alias("soc_percent"))
    path = _folder(t)
    finish_messages(t).select("value").write.text(path)
    finished = messages.good(messages.parse_envelope(messages.read_messages(t.spark, path), "trip_event")).select(
        "trip_id", F.col("event_type").alias("kind"), F.col("occurred_at").alias("at"), F.lit(0).cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("state"),
        "distance_m", "energy_kwh", "soc_percent")
    return samples.unionByName(finished)


def _trip_totals(t: Tables) -> DataFrame:
    path = _folder(t)
    stream = state.trip_totals(trip_rows(t, messages.good(parsed_stream(t))))
    telemetry.run_to_end(stream, telemetry.update_batch(f"{path}/trips"), f"{path}/checkpoint", "update")
    return telemetry.latest_version(t.spark, f"{path}/trips", "trip_id")


REG.add("stream_trip_totals", lambda t: rounded(_trip_totals(t), 5), """
    with newest as (select * from published where reject_reason is null and trip_id is not null qualify row_number() over (partition by trip_id order by recorded_at desc, telemetry_id) = 1),
    fin as (select trip_id, ended_at, case when end_soc_percent between 0 and 100 then end_soc_percent end as soc, round(distance_m, 3) as m, end_soc_percent from trips
            where ended_at is not null and coalesce(end_soc_percent between 0 and 100, true)),
    j as (select coalesce(n.trip_id, f.trip_id) as trip_id, case when f.trip_id is not null then 'completed' else n.state end as state, coalesce(f.m, n.odometer_m) as m,
                 n.cumulative_energy_kwh as e, coalesce(f.soc, n.battery_soc_percent) as soc, f.ended_at from newest n full join fin f on f.trip_id = n.trip_id)
    select trip_id, state, round(m, 5) as distance_m, round(e, 5) as energy_kwh, case when m > 0 then round(e / (m / 100000), 5) end as avg_consumption_kwh_100km,
           round(soc, 5) as soc_percent, ended_at from j""")


def _trip_windows(t: Tables) -> DataFrame:
    """All trips' windows, each in its newest version."""
    path = _folder(t)
    rows = messages.good(parsed_stream(t)).select(
        "trip_id", "recorded_at", F.substring("event_id", 2, 20).cast("bigint").alias("sequence"), "speed_kmh", "odometer_m")
    telemetry.run_to_end(state.trip_windows(rows), telemetry.update_batch(f"{path}/windows"), f"{path}/checkpoint", "update")
    return telemetry.latest_version(t.spark, f"{path}/windows", "trip_id", "window_index")


REG.add("stream_trip_windows", lambda t: rounded(_trip_windows(t)), """
    with good as (select *, min(recorded_at) over (partition by trip_id) as first from published where reject_reason is null and trip_id is not null),
    w as (select *, (epoch_us(recorded_at) - epoch_us(first)) // 60000000 as window_index from good)
    select trip_id, window_index, any_value(first) + to_microseconds(60000000 * window_index) as window_start, count(*) as samples, round(avg(speed_kmh), 6) as mean_speed_kmh,
           round(arg_min(odometer_m, (recorded_at, telemetry_id)), 6) as first_odometer_m, round(arg_max(odometer_m, (recorded_at, telemetry_id)), 6) as last_odometer_m
    from w group by trip_id, window_index""")


# ---- the feed in three slices of time, each processed before the next one arrives


_SLICES = 3


def _slice_bounds(t: Tables) -> list[dt.datetime]:
    span = t.telemetry.agg(F.min(F.unix_micros("recorded_at")).alias("a"), F.max(F.unix_micros("recorded_at")).alias("b")).first()
    return [span.a + (span.b - span.a) * i // _SLICES for i in range(1, _SLICES)]


def _slice(us, bounds: list[int]):
    return sum((F.when(us > b, 1).otherwise(0) for b in bounds), F.lit(0))


def telemetry_slices(t: Tables):
    """Writes the published telemetry slice by slice into one folder, which it gives out after each."""
    whole, path, bounds = t.spark.read.text(published(t)), _folder(t), _slice_bounds(t)
    # cut-off messages have no time: they come last
    at = F.unix_micros(F.to_timestamp(F.get_json_object("value", "$.payload.recorded_at")))
    for i in range(_SLICES):
        whole.where(F.coalesce(_slice(at, bounds), F.lit(_SLICES - 1)) == i).write.mode("append").text(path)
        yield path


def samples_of(t: Tables, stream: DataFrame) -> DataFrame:
    """Good samples with what the windows need beyond the message."""
    n = F.substring("event_id", 2, 20).cast("bigint")
    congestion = fleet.congestion_class(F.col("speed_kmh"), F.col("speed_limit_kmh"), F.col("road_class"))
    return stream.withColumns({
        "sequence": n, "severity_ordinal": F.coalesce(congestion, F.lit(1)), "precipitation_mm": (n % 5) / 10.0,
        "wind_speed_ms": (n % 12).cast("double"), "gradient_percent": (n % 13 - 6) / 2.0}).withColumnRenamed("state", "vehicle_state")


def _window_features(t: Tables) -> DataFrame:
    path = _folder(t)
    for source in telemetry_slices(t):
        stream = messages.good(messages.parse_envelope(messages.read_messages(t.spark, source), "telemetry"))
        telemetry.run_to_end(state.window_sums(samples_of(t, stream)), telemetry.update_batch(f"{path}/sums"), f"{path}/checkpoint", "update")
    return learning.finish_windows(state.stored_windows(telemetry.latest_version(t.spark, f"{path}/sums", "trip_id", "window_index")), vehicle_profiles(t))


relation("good_steps", """
    select t.*, case when p then epoch_us(t.recorded_at) - epoch_us(at0) end / 1e6 as dt, case when p then t.odometer_m - m0 end as dm, case when p then t.cumulative_energy_kwh - e0 end as de
    from (select t.*, lag(t.recorded_at) over w as at0, lag(t.odometer_m) over w as m0, lag(t.cumulative_energy_kwh) over w as e0, lag(t.trip_id) over w is not null as p
          from telemetry t join published p using (telemetry_id) where p.reject_reason is null and t.trip_id is not null
          window w as (partition by t.trip_id order by t.recorded_at, t.telemetry_id)) t""")
relation("good_window", RELATIONS["window_raw"].replace("from trip_steps st", "from good_steps st"))
REG.add("stream_window_features", lambda t: rounded(_window_features(t), 8),
        WINDOW_ROW_SQL.replace("window_raw", "good_window"))


def fleet_rows(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Good telemetry and trip events as rows of one shape."""
    a = samples.select(
        "vehicle_id", "trip_id", F.lit("telemetry").alias("kind"), F.col("recorded_at").alias("at"), F.substring("event_id", 2, 20).cast("bigint").alias("sequence"), "state",
        F.col("odometer_m").alias("distance_m"), F.col("cumulative_energy_kwh").alias("energy_kwh"), F.col("battery_soc_percent").alias("soc_percent"))
    return a.unionByName(events.select(
        "vehicle_id", "trip_id", F.col("event_type").alias("kind"), F.col("occurred_at").alias("at"), F.lit(0).cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("state"),
        "distance_m", "energy_kwh", "soc_percent"))


_STATE_FIELDS = "vehicle_id string, state string"
_TRIP_FIELDS = "trip_id string, state string, distance_m double, energy_kwh double, avg_consumption_kwh_100km double, soc_percent double, ended_at timestamp"
_SAMPLE_FIELDS = "event_id string, vehicle_id string, trip_id string, recorded_at timestamp, speed_kmh double, odometer_m double"
_REJECT_FIELDS = "raw string, event_id string, reject_reason string"


def _ingested(t: Tables) -> BatchLog:
    """Samples, rejects, trips and vehicles of the whole feed, written by one stream whose batches count as a unit."""
    path, ended = _folder(t), _folder(t)
    log = BatchLog(f"{path}/tables", {"telemetry": _SAMPLE_FIELDS, "rejects": _REJECT_FIELDS, "trips": _TRIP_FIELDS, "vehicles": _STATE_FIELDS})
    finished = finish_messages(t).withColumn("_slice", _slice(F.unix_micros("at"), _slice_bounds(t)))
    for i, source in enumerate(telemetry_slices(t)):
        finished.where(F.col("_slice") == i).select("value").write.mode("append").text(ended)
        parsed = messages.parse_envelope(messages.read_messages(t.spark, source), "telemetry")
        events = messages.good(messages.parse_envelope(messages.read_messages(t.spark, ended), "trip_event"))
        samples = messages.good(parsed)
        changes = state.fleet_state(fleet_rows(samples, events), closed_us=90 * DAY_US, forget_us=90 * DAY_US)
        both = parts({"telemetry": samples.select(*(f.split(" ")[0] for f in _SAMPLE_FIELDS.split(", "))), "rejects": messages.rejects(parsed), "changes": changes})
        telemetry.run_to_end(both, commit_changes(log), f"{path}/checkpoint", "update")
    return log


def commit_changes(log: BatchLog):
    """As ``commit_parts``, with the changes of the keyed state dealt to trips and vehicles."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            changes = batch.where("part = 'changes'").select("changes.*")
            log.write({
                "telemetry": batch.where("part = 'telemetry'").select("telemetry.*"), "rejects": batch.where("part = 'rejects'").select("rejects.*"),
                "trips": state.trips_of(changes), "vehicles": state.vehicles_of(changes)}, batch_id)
        finally:
            batch.unpersist()

    return write


relation("finish", """
    select trip_id, split_part(trip_id, '-', 1) as vehicle_id, ended_at, round(distance_m, 3) as m, end_soc_percent as soc from trips
    where ended_at is not null and coalesce(end_soc_percent between 0 and 100, true)""")
relation("fleet_trip", """
    select coalesce(n.trip_id, f.trip_id) as trip_id, case when f.trip_id is not null then 'completed' else n.state end as state, coalesce(f.m, n.odometer_m) as m,
           n.cumulative_energy_kwh as e, coalesce(f.soc, n.battery_soc_percent) as soc, f.ended_at
    from (select p.* from published p left join finish f using (trip_id) where reject_reason is null and p.trip_id is not null and (f.ended_at is null or p.recorded_at <= f.ended_at)
          qualify row_number() over (partition by p.trip_id order by odometer_m desc, recorded_at desc, telemetry_id desc) = 1) n
    full join finish f on f.trip_id = n.trip_id""")
REG.add("stream_fleet_trips", lambda t: rounded(_ingested(t).latest(t.spark, "trips", "trip_id"), 5), """
    select trip_id, state, round(m, 5) as distance_m, round(e, 5) as energy_kwh, case when m > 0 then round(e / (m / 100000), 5) end as avg_consumption_kwh_100km,
           round(soc, 5) as soc_percent, ended_at from fleet_trip""")
REG.add("stream_fleet_vehicles", lambda t: _ingested(t).latest(t.spark, "vehicles", "vehicle_id"), """
    select vehicle_id, state from (
        select vehicle_id, recorded_at as seen_at, 0 as is_event, telemetry_id as seq, state from published where reject_reason is null
        union all select vehicle_id, ended_at, 1, 0, 'idle' from finish)
    qualify row_number() over (partition by vehicle_id order by seen_at desc, is_event desc, seq desc) = 1""")


def _committed(t: Tables) -> DataFrame:
    log, out = _ingested(t), None
    for name, key in (("telemetry", "event_id"), ("rejects", "raw"), ("trips", "trip_id"), ("vehicles", "vehicle_id")):
        rows = log.read(t.spark, name)
        if name in ("trips", "vehicles"):
            rows = rows.select(key).distinct()
        part = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("table"), "rows", "keys")
        out = part if out is None else out.unionByName(part)
    return out


REG.add("stream_commit", _committed, """
    select 'telemetry' as "table", count(*) as rows, count(*) as keys from published where reject_reason is null
    union all select 'rejects', count(*), count(*) from published where reject_reason is not null
    union all select 'trips', count(*), count(*) from fleet_trip
    union all select 'vehicles', count(*), count(*) from (select vehicle_id from published where reject_reason is null union select vehicle_id from finish)""")


def _counters(t: Tables) -> DataFrame:
    path = _folder(t)
    totals = telemetry.run_counted(parsed_stream(t, files=2), telemetry.append_batch(path), f"{path}/checkpoint")
    return t.spark.createDataFrame([(totals.consumed, totals.rejected)], "consumed bigint, rejected bigint")


REG.add("stream_counters", _counters, "select count(*) as consumed, count(reject_reason) as rejected from published")


def _batches(t: Tables) -> DataFrame:
    """The batches of one run as a table of metrics, added up, with the files that wait in the end."""
    path, source = _folder(t), published(t)
    policy = telemetry.BatchPolicy(files=2)
    stream = messages.parse_envelope(messages.read_messages(t.spark, source, policy.options(source)), "telemetry")
    totals = telemetry.run_counted(stream, telemetry.append_batch(path), f"{path}/checkpoint")
    left = telemetry.files_behind(t.spark, source, f"{path}/checkpoint")
    totals.table(t.spark).write.parquet(f"{path}/metrics")
    return t.spark.read.parquet(f"{path}/metrics").agg(
        *(F.sum(c).alias(c) for c in ("consumed", "written", "rejected")), F.lit(totals.errors).cast("bigint").alias("errors"), F.lit(left).cast("bigint").alias("files_behind"))


REG.add("stream_batches", _batches, """
    select count(*) as consumed, count(*) - count(reject_reason) as written, count(reject_reason) as rejected, 0::bigint as errors, 0::bigint as files_behind from published""")


def _other_topics(t: Tables) -> DataFrame:
    """Traffic and charging messages through the same parser."""
    traffic = t.traffic_events.select(F.to_json(F.struct(
        F.col("id").alias("event_id"), F.lit("traffic_event").alias("event_type"), F.lit(1).alias("schema_version"), F.col("ingested_at").alias("occurred_at"), F.lit("roads").alias("producer"),
        "data_origin", F.struct("external_id", "event_type", F.when(F.col("delay_minutes") > 50, F.lit("odd")).otherwise(F.col("severity")).alias("severity"), "title", "latitude", "longitude", "is_blocked").alias("payload"))).alias("value"))
    charging = t.charging_points.select(F.to_json(F.struct(
        F.col("id").alias("event_id"), F.lit("charging_event").alias("event_type"), F.lit(1).alias("schema_version"), F.lit("sites").alias("producer"), "data_origin", F.struct(
            "station_id", F.lit("started").alias("event_type"), F.lit("V1").alias("vehicle_id"), "power_kw", (F.col("ordinal") % 120).cast("double").alias("soc_percent")).alias("payload"))).alias("value"))
    out = None
    for topic, rows, kind in (("traffic", traffic, "traffic_event"), ("charging", charging, "charging_event")):
        part = messages.parse_envelope(rows, kind).groupBy(F.lit(topic).alias("topic"), F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("messages"))
        out = part if out is None else out.unionByName(part)
    return out


REG.add("parse_other_topics", _other_topics, """
    select 'traffic' as topic, case when delay_minutes > 50 then 'severity' else 'ok' end as outcome, count(*) as messages from traffic_events group by 1, 2
    union all select 'charging', case when ordinal % 120 > 100 then 'soc_percent' else 'ok' end, count(*) from charging_points group by 1, 2""")

# ---- charging plans


def _candidates(t: Tables, routes: DataFrame | None = None) -> DataFrame:
    return C.corridor_candidates(t, pick=best_per_stretch(10.0), routes=routes).select(
        "route_id", "station_id", (F.col("offset_m") / 1000.0).alias("offset_km"), (F.col("lateral_m") / 1000.0 * 2).alias("detour_km"), "max_power_kw", "lateral_m")


REG.add("thin_candidates", lambda t: rounded(chargeplan.thin_candidates(_candidates(t), ["route_id"]).select("route_id", "station_id", "offset_km"), 3), """
    with b as (select *, floor(offset_m / 1000 / 10) as k from candidate_raw),
    best as (select * from b qualify row_number() over (partition by route_id, k order by max_power_kw desc, lateral_m, station_id) = 1)
    select route_id, station_id, round(offset_m / 1000, 3) as offset_km from best
    qualify row_number() over (partition by route_id order by max_power_kw desc, lateral_m, station_id) <= 60""")


def _plans(t: Tables) -> DataFrame:
    driven = analysis.segment_energies(analysis.for_vehicles(conditions(t), t.requests, models(t)))
    segments = driven.select("route_id", "vehicle_model_id", (F.col("start_offset_m") / 1000.0).alias("start_km"), "distance_km", "kwh", "duration_s")
    # candidates on routes that no request names meet no segment
    return chargeplan.plan_charging(t.requests, segments, _candidates(t, t.requests), models(t))


REG.add("plan_charging", lambda t: rounded(_plans(t), 4))
