"""The keyed stream state: the same results for every way to cut the feed into micro-batches; batches that count as a unit."""

import random

import pytest
from pyspark.sql import functions as F

from strom.plans import learning
from strom.registry.streams import commit_changes, fleet_rows
from strom.streaming import messages, state, telemetry
from strom.streaming.commits import BatchLog, commit_parts, parts
from strom.streaming.ordered import DAY_US
from tests.test_streaming import at, deliver, message

HOUR_US = 3_600_000_000


def run(spark, tmp_path, batches, job, name="out"):
    """Delivers the batches one by one and runs ``job(folder, out, checkpoint)`` after each."""
    source, out, cp = tmp_path / f"in-{name}", str(tmp_path / name), str(tmp_path / f"cp-{name}")
    for i, lines in enumerate(batches):
        deliver(source, i, *lines)
        job(str(source), out, cp)
    return out


def feed(spark, source):
    raw = messages.read_messages(spark, source)
    samples = messages.good(messages.parse_envelope(raw, "telemetry")).withColumn("event_id", F.concat(F.lit("e"), F.ascii("event_id").cast("string")))
    return samples, messages.good(messages.parse_envelope(messages.read_messages(spark, source), "trip_event"))


def fleet(spark, tmp_path, batches, name="out", **times):
    def job(source, out, cp):
        telemetry.run_to_end(state.fleet_state(fleet_rows(*feed(spark, source)), **times), telemetry.update_batch(out), cp, "update")

    changes = spark.read.parquet(run(spark, tmp_path, batches, job, name))
    key = F.coalesce("trip_id", "vehicle_id").alias("id")
    newest = changes.groupBy("entity", key).agg(F.max_by(F.struct("state", "distance_m", "energy_kwh", "soc_percent", "ended_us"), "batch").alias("r"))
    return {r.id: tuple(r.r) for r in newest.collect()}, changes


def cuts(lines, seed):
    """One batch, one line a batch, and something between, all in order of time up to a few minutes."""
    draw = random.Random(seed)
    middle = sorted(draw.sample(range(1, len(lines)), min(3, len(lines) - 1)))
    return [lines], [lines[a:b] for a, b in zip([0, *middle], [*middle, len(lines)])]


def test_trips_and_vehicles_do_not_depend_on_the_batches(spark, tmp_path):
    lines = [
        message("a", at(1), odometer_m=1000.0), message("b", at(3), odometer_m=3000.0, cumulative_energy_kwh=2.0), message("c", at(2), odometer_m=2500.0),
        message("x", at(4), "trip_event", event_type="charging_started"), message("y", at(5), "trip_event", event_type="charging_finished"),
        message("d", at(6), odometer_m=2900.0, battery_soc_percent=50.0),           # a step back: not counted for the trip
        message("z", at(9), "trip_event", event_type="finished", distance_m=10_000.0, soc_percent=40.0),
        message("e", at(8), odometer_m=9_000.0, cumulative_energy_kwh=3.0, state="stopped"),  # late, but before the finish
        message("f", at(10), odometer_m=99_000.0), message("w", at(12), "trip_event", event_type="finished", distance_m=1.0),  # after the finish
        message("g", at(13), trip_id="T2", odometer_m=5.0, state="charging"),
    ]
    seen = [fleet(spark, tmp_path, cut, f"out{i}")[0] for i, cut in enumerate((*cuts(lines, 1), cuts(lines, 2)[1]))]
    assert seen[0] == seen[1] == seen[2]
    assert seen[0]["T1"] == ("completed", 10_000.0, 3.0, 40.0, 9 * 60_000_000 + 1_704_067_200_000_000)
    assert seen[0]["T2"][0] == "charging" and seen[0]["V1"][0] == "charging"


def test_a_finished_trip_leaves_its_vehicle_idle(spark, tmp_path):
    rows, _ = fleet(spark, tmp_path, [[message("a", at(1))], [message("z", at(2), "trip_event", event_type="finished")]])
    assert rows["T1"][0] == "completed" and rows["V1"][0] == "idle"


def test_only_changes_are_given_out_and_old_trips_forgotten(spark, tmp_path):
    far = "2024-01-03T00:00:00.000Z"
    batches = [[message("a", at(1))], [message("a", at(1))], [message("o", at(2), vehicle_id="V2", trip_id="T9")], [message("z", at(2), "trip_event", event_type="finished")],
               [message("p", far, vehicle_id="V2", trip_id="T9", odometer_m=200.0)], [message("q", far, vehicle_id="V3", trip_id="T8")]]
    rows, changes = fleet(spark, tmp_path, batches, closed_us=HOUR_US, forget_us=24 * HOUR_US)
    told = {(r.entity, r.id): r.n for r in changes.groupBy("entity", F.coalesce("trip_id", "vehicle_id").alias("id")).agg(F.count("*").alias("n")).collect()}
    assert told == {("trip", "T1"): 2, ("vehicle", "V1"): 2, ("trip", "T9"): 2, ("vehicle", "V2"): 1, ("trip", "T8"): 1, ("vehicle", "V3"): 1}


def sample(event_id, second, trip="T1", **values):
    time = f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.000Z"
    return second, message(event_id, time, trip_id=trip, **values)


def windows(spark, tmp_path, batches, name):
    def job(source, out, cp):
        rows = messages.good(messages.parse_envelope(messages.read_messages(spark, source), "telemetry")).withColumns({
            "sequence": F.ascii("event_id").cast("bigint"), "severity_ordinal": F.lit(2)}).withColumnRenamed("state", "vehicle_state")
        telemetry.run_to_end(state.window_sums(rows), telemetry.update_batch(out), cp, "update")

    out = run(spark, tmp_path, batches, job, name)
    return state.stored_windows(telemetry.latest_version(spark, out, "trip_id", "window_index"))


def test_windows_do_not_depend_on_the_batches(spark, tmp_path):
    """A trip of over an hour, so that minutes settle, with late samples, one before the first, and redelivery."""
    draw, lines = random.Random(7), []
    for i in range(240):
        second = 600 + i * 20
        lines.append(sample(chr(65 + i % 50), second, odometer_m=i * 200.0 - (500.0 if i % 23 == 0 else 0.0), cumulative_energy_kwh=i * 0.05, speed_kmh=40.0 + i % 7, acceleration_ms2=(i % 5) * 0.4,
                            outside_temperature_c=None if i % 9 == 0 else i / 10, battery_temperature_c=20.0, road_class=("motorway", "primary", None)[i // 50 % 3],
                            speed_limit_kmh=None if i % 4 else 80.0, state="driving" if i % 40 else "charging"))
    in_order = [m for _, m in lines]
    late = [m for _, m in sorted(lines, key=lambda x: x[0] + draw.choice((0, 0, 0, 300, 700)))]
    first_late = [*in_order[3:30], *in_order[:3], *in_order[30:]]
    found = []
    for i, batches in enumerate(([in_order], [late[:60], late[60:70], late[60:150], late[150:]], [first_late[:20], first_late[20:120], first_late[110:200], first_late[200:]])):
        rows = windows(spark, tmp_path, batches, f"w{i}").drop("batch").collect()
        found.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows))
    assert len(found[0]) == 80 and found[0] == found[1] == found[2]


def test_windows_equal_the_batch_plan(spark, tmp_path):
    lines = [sample(chr(65 + i), 30 + i * 17, odometer_m=i * 300.0, cumulative_energy_kwh=i * 0.1, acceleration_ms2=0.6, outside_temperature_c=9.0, battery_temperature_c=8.0, road_class="trunk")[1] for i in range(30)]
    profile = spark.createDataFrame([("V1", "sedan", 2000.0, 0.5, 16.0)], "vehicle_id string, vehicle_model_code string, mass_kg double, drag_area_m2 double, nominal_consumption_kwh_100km double")
    streamed = learning.finish_windows(windows(spark, tmp_path, [lines[:9], lines[9:]], "s"), profile)
    raw = messages.good(messages.parse_envelope(spark.createDataFrame([(x,) for x in lines], "value string"), "telemetry"))
    from strom.plans.trips import telemetry_steps

    base = raw.withColumnsRenamed({"event_id": "telemetry_id", "state": "vehicle_state"})
    extra = base.select("telemetry_id", "speed_limit_kmh", "vehicle_state", F.lit(2).alias("severity_ordinal"), *(F.lit(None).cast("double").alias(c) for c in ("precipitation_mm", "wind_speed_ms", "gradient_percent")))
    batch = learning.window_features(telemetry_steps(base).join(extra, "telemetry_id"), profile)
    columns = [c for c in batch.columns if c in streamed.columns and c not in ("precipitation_mm", "wind_speed_ms", "gradient_percent")]
    show = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
    assert set(learning.FEATURES) <= set(streamed.columns) and len(show(batch)) >= 8 and show(streamed) == show(batch)


# -- batches that count as a unit


class Dies(BatchLog):
    """Fails at the second table of its first batch."""

    fails = True

    def _write_table(self, rows, folder):
        if "/rejects/" in folder and Dies.fails:
            Dies.fails = False
            raise RuntimeError("lost")
        super()._write_table(rows, folder)


SCHEMAS = {"telemetry": "event_id string, odometer_m double", "rejects": "raw string, event_id string, reject_reason string"}


def test_a_run_that_dies_between_two_tables_shows_neither(spark, tmp_path):
    deliver(tmp_path / "in", 0, message("a", at(0)), "{broken")
    log = Dies(str(tmp_path / "tables"), SCHEMAS)

    def go():
        parsed = messages.parse_envelope(messages.read_messages(spark, str(tmp_path / "in")), "telemetry")
        both = parts({"telemetry": messages.good(parsed).select("event_id", "odometer_m"), "rejects": messages.rejects(parsed)})
        telemetry.run_to_end(both, commit_parts(log), str(tmp_path / "cp"))

    with pytest.raises(Exception, match="lost"):
        go()
    assert log.committed(spark) == [] and log.read(spark, "telemetry").count() == 0 and log.read(spark, "rejects").count() == 0
    assert len(log.unnamed(spark, "telemetry")) == 1
    go()
    assert log.committed(spark) == [0] and [r.event_id for r in log.read(spark, "telemetry").collect()] == ["a"] and log.read(spark, "rejects").count() == 1
    assert len(log.unnamed(spark, "telemetry")) == 1 and log.unnamed(spark, "rejects") == []


def test_a_batch_counts_once(spark, tmp_path):
    log = BatchLog(str(tmp_path / "t"), {"a": "x bigint", "b": "y bigint"})
    one, none = spark.range(3).toDF("x"), spark.range(0).toDF("y")
    assert log.write({"a": one, "b": none}, 4) and not log.write({"a": one, "b": none}, 4) and log.write({"a": one.where("x > 0"), "b": none}, 5)
    assert log.read(spark, "a").count() == 5 and log.read(spark, "b").columns == ["y"] and log.committed(spark, 5) == [5]
    assert sorted((r.x, r.batch) for r in log.read(spark, "a", True).collect()) == [(0, 4), (1, 4), (1, 5), (2, 4), (2, 5)]
    with pytest.raises(ValueError):
        log.write({"c": one}, 6)


def test_samples_rejects_trips_and_vehicles_commit_together(spark, tmp_path):
    log = BatchLog(str(tmp_path / "tables"), {"telemetry": "event_id string", "rejects": "raw string, event_id string, reject_reason string",
                                              "trips": state.TRIP_SCHEMA, "vehicles": "vehicle_id string, state string"})

    def job(source, out, cp):
        parsed = messages.parse_envelope(messages.read_messages(spark, source), "telemetry")
        events = messages.good(messages.parse_envelope(messages.read_messages(spark, source), "trip_event"))
        samples = messages.good(parsed).withColumn("event_id", F.concat(F.lit("e"), F.ascii("event_id").cast("string")))
        both = parts({"telemetry": samples.select("event_id"), "rejects": messages.rejects(parsed), "changes": state.fleet_state(fleet_rows(samples, events), closed_us=DAY_US)})
        telemetry.run_to_end(both, commit_changes(log), cp, "update")

    run(spark, tmp_path, [[message("a", at(1)), "{"], [message("z", at(2), "trip_event", event_type="finished")]], job)
    assert log.read(spark, "telemetry").count() == 1
    assert log.latest(spark, "vehicles", "vehicle_id").first().state == "idle" and log.latest(spark, "trips", "trip_id").first().state == "completed"
    by_batch = {b: {n: log.read(spark, n, True).where(F.col("batch") == b).count() for n in log.schemas} for b in log.committed(spark)}
    assert by_batch[0]["telemetry"] == 1 and by_batch[0]["vehicles"] == 1 and sum(v["vehicles"] for v in by_batch.values()) == 2


# -- calls to the state store


class Store:
    """A key's states in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Entry(self, f"{name}."))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.discard(at)


class Entry:
    def __init__(self, store, name):
        self.store, self.name, self.held = store, name, {}

    def _call(self, what):
        self.store.calls.append(self.name + what)

    def exists(self):
        self._call("exists")
        return None in self.held

    def get(self):
        self._call("get")
        return self.held[None]

    def update(self, value):
        self._call("update")
        self.held[None] = value

    def clear(self):
        self._call("clear")
        self.held.clear()

    def containsKey(self, key):
        self._call("containsKey")
        return key in self.held

    def getValue(self, key):
        self._call("getValue")
        return self.held[key]

    def updateValue(self, key, value):
        self._call("updateValue")
        self.held[key] = value

    def removeKey(self, key):
        self._call("removeKey")
        del self.held[key]

    def keys(self):
        self._call("keys")
        return iter(list(self.held))


class Passed:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000

    def getExpiryTimeInMs(self):
        return self.us // 1000


def replayed(batches, passed):
    """What a trip's windows give out batch by batch, and their store."""
    store, windows_ = Store(), state.TripWindows()
    windows_.init(store)
    columns, told = windows_.columns, []
    for rows, until in zip(batches, passed):
        given = ({**dict.fromkeys(columns), "speed_kmh": 50.0, "odometer_m": us / 1e5, "vehicle_state": "driving", "us": us, "sequence": n} for n, us in rows)
        told.append([tuple(r) for r in windows_.handleInputRows(("T1",), given, Passed(until))])
    return told, store


def test_a_key_of_few_rows_costs_few_calls(monkeypatch):
    rows = [(n, 60_000_000 * 100 + n * 7_000_000) for n in range(60)]
    told, store = replayed([rows], [0])
    assert len(told[0]) == 7 and len(store.calls) <= 4
    cut, limits = [rows[:25], rows[20:40], rows[:5] + rows[38:]], [0, 60_000_000 * 102, 60_000_000 * 102]
    near, store = replayed(cut, limits)
    assert not any(c.startswith("open.") for c in store.calls)
    monkeypatch.setattr("strom.streaming.ordered.NEAR_ROWS", 3)
    far, store = replayed(cut, limits)
    # the same from the map, which holds a minute for each entry, and none that has passed
    assert far == near and sorted(k[0] for k in store.states["open"].held) == [102, 103, 104, 105, 106]
