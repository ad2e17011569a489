"""Stream jobs over several micro-batches: redelivery, late samples, closed trips, windows."""

import json

import pytest

from strom.streaming import messages, state, telemetry


def message(event_id, at, kind="telemetry", **payload):
    base = {"vehicle_id": "V1", "trip_id": "T1", "latitude": 50.0, "longitude": 9.0, "speed_kmh": 50.0, "battery_soc_percent": 60.0,
            "cumulative_energy_kwh": 1.0, "odometer_m": 100.0, "state": "driving", "recorded_at": at} if kind == "telemetry" else {"trip_id": "T1", "vehicle_id": "V1", "occurred_at": at}
    return json.dumps({"event_id": event_id, "event_type": kind, "schema_version": 1, "occurred_at": at, "producer": "p", "data_origin": "simulated", "payload": base | payload})


def deliver(folder, number, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:03d}.txt").write_text("\n".join(lines) + "\n")


def at(minute, second=0):
    return f"2024-01-01T00:{minute:02d}:{second:02d}.000Z"


def test_rejects_never_stop_the_stream(spark, tmp_path):
    deliver(tmp_path / "in", 0, message("a", at(0)), "{broken", message("b", at(1), latitude=99.0), message("c", at(2), battery_soc_percent=101.0))
    stream = messages.parse_envelope(messages.read_messages(spark, str(tmp_path / "in")), "telemetry")
    telemetry.run_to_end(stream, telemetry.append_batch(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/telemetry")).collect()] == ["a"]
    assert sorted(r.reject_reason for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()) == ["battery_soc_percent", "latitude", "malformed"]


def test_redelivered_batch_overwrites_itself(spark, tmp_path):
    deliver(tmp_path / "in", 0, message("a", at(0)))
    batch = messages.parse_envelope(spark.read.text(str(tmp_path / "in")), "telemetry")
    write = telemetry.append_batch(str(tmp_path / "out"))
    write(batch, 7)
    write(batch, 7)
    assert spark.read.parquet(str(tmp_path / "out/telemetry")).count() == 1


def test_deduplication_across_batches(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i, lines in enumerate([[message("a", at(0)), message("a", at(0))], [message("a", at(0)), message("b", at(1))]]):
        deliver(source, i, *lines)
        stream = messages.good(messages.parse_envelope(messages.read_messages(spark, str(source)), "telemetry"))
        telemetry.run_to_end(telemetry.dedupe_events(stream), telemetry.update_batch(out), cp)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def trips_after(spark, tmp_path, batches):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i, lines in enumerate(batches):
        deliver(source, i, *lines)
        raw = messages.read_messages(spark, str(source))
        samples = messages.good(messages.parse_envelope(raw, "telemetry")).selectExpr(
            "trip_id", "'telemetry' kind", "recorded_at at", "cast(ascii(event_id) as bigint) sequence", "state", "odometer_m distance_m",
            "cumulative_energy_kwh energy_kwh", "battery_soc_percent soc_percent")
        events = messages.good(messages.parse_envelope(messages.read_messages(spark, str(source)), "trip_event")).selectExpr(
            "trip_id", "event_type kind", "occurred_at at", "0L sequence", "cast(null as string) state", "distance_m", "energy_kwh", "soc_percent")
        telemetry.run_to_end(state.trip_totals(samples.unionByName(events)), telemetry.update_batch(out), cp, "update")
    return {r.trip_id: r for r in telemetry.latest_version(spark, out, "trip_id").collect()}


def test_trip_totals_are_monotone_and_close_once(spark, tmp_path):
    first = message("b", at(5), odometer_m=5000.0, cumulative_energy_kwh=1.0)
    rows = trips_after(spark, tmp_path, [
        [first, message("a", at(1), odometer_m=1000.0)],          # out of order: the newer sample counts
        [message("a", at(1), odometer_m=1000.0)],                 # redelivery must not move the trip back
        [message("x", at(9), "trip_event", event_type="finished", distance_m=10_000.0, soc_percent=40.0)],
        [message("c", at(11), odometer_m=99_000.0), message("y", at(12), "trip_event", event_type="finished", distance_m=1.0)],  # too late
    ])
    trip = rows["T1"]
    assert (trip.state, trip.distance_m, trip.energy_kwh, trip.soc_percent) == ("completed", 10_000.0, 1.0, 40.0)
    assert trip.avg_consumption_kwh_100km == pytest.approx(1.0 / 0.1) and trip.ended_at.minute == 9


def test_a_trip_goes_on_counting_after_a_long_pause(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[message("a", at(0, 30), speed_kmh=40.0)], [message("b", "2024-01-01T02:30:00.000Z", trip_id="other")], [message("c", "2024-01-01T02:31:00.000Z", trip_id="other")],
               [message("d", "2024-01-01T02:32:30.000Z", speed_kmh=80.0)], [message("e", "2024-01-01T02:32:45.000Z", speed_kmh=60.0)]]
    for i, lines in enumerate(batches):
        deliver(source, i, *lines)
        rows = messages.good(messages.parse_envelope(messages.read_messages(spark, str(source)), "telemetry")).selectExpr(
            "trip_id", "recorded_at", "cast(ascii(event_id) as bigint) sequence", "speed_kmh", "odometer_m")
        telemetry.run_to_end(state.trip_windows(rows), telemetry.update_batch(out), cp, "update")
    rows = telemetry.latest_version(spark, out, "trip_id", "window_index").where("trip_id <> 'other'").collect()
    assert sorted((r.window_index, r.samples, r.mean_speed_kmh) for r in rows) == [(0, 1, 40.0), (152, 2, 70.0)]


def test_windows_are_anchored_at_the_first_sample(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[message("a", at(0, 30), speed_kmh=40.0), message("b", at(1, 20), speed_kmh=60.0)], [message("c", at(1, 40), speed_kmh=80.0), message("d", at(3, 40))],
               [message("e", at(1, 45), speed_kmh=20.0)]]  # the last one is late, inside the watermark
    expected = [(0, 2, 50.0), (1, 2, 50.0), (3, 1, 50.0)]
    for i, lines in enumerate(batches):
        deliver(source, i, *lines)
        rows = messages.good(messages.parse_envelope(messages.read_messages(spark, str(source)), "telemetry")).selectExpr(
            "trip_id", "recorded_at", "cast(ascii(event_id) as bigint) sequence", "speed_kmh", "odometer_m")
        telemetry.run_to_end(state.trip_windows(rows), telemetry.update_batch(out), cp, "update")
    rows = telemetry.latest_version(spark, out, "trip_id", "window_index").collect()
    assert sorted((r.window_index, r.samples, r.mean_speed_kmh) for r in rows) == expected
