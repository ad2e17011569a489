"""Keyed state of the telemetry stream: trips, vehicles and training windows, all replayed in event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strom.functions.lookups import ROAD_CLASS_ORDINAL
from strom.plans.learning import ACCELERATION_EVENT_MS2, UNRESTRICTED_KMH
from strom.streaming.ordered import DAY_US, OrderedReplay, replay, use_map_state

# fixed values: what a trip event does to the trip and to the vehicle that drives it
EVENT_STATE = {"started": "driving", "finished": "completed", "charging_started": "charging", "charging_finished": "driving", "paused": "stopped"}
VEHICLE_STATE = EVENT_STATE | {"finished": "idle"}
WINDOW_US = 60_000_000
FLEET_SCHEMA = ("entity string, vehicle_id string, trip_id string, state string, distance_m double, energy_kwh double, avg_consumption_kwh_100km double, "
                "soc_percent double, ended_us bigint, us bigint")
TRIP_SCHEMA = "trip_id string, state string, distance_m double, energy_kwh double, avg_consumption_kwh_100km double, soc_percent double, ended_at timestamp"
_TOTALS_SCHEMA = "trip_id string, state string, distance_m double, energy_kwh double, avg_consumption_kwh_100km double, soc_percent double, ended_us bigint"
_TRIP_STATE = "state string, distance_m double, energy_kwh double, soc_percent double, ended_us bigint"
TRIP_COLUMNS = ("trip_id", "state", "distance_m", "energy_kwh", "avg_consumption_kwh_100km", "soc_percent", "ended_at")


def _none(value):
    """None instead of a number that is none."""
    return None if value is None or value != value else value


def _ahead(now: float | None, before: float | None) -> float | None:
    """How far a counter went on; None where it is not known or went back."""
    step = None if now is None or before is None else now - before
    return step if step is not None and step >= 0 else None


class FleetState(OrderedReplay):
    """Trips and vehicle of one key, advanced row by row in the order of time.

    Counters are absolute: they are assigned, never added, and never go back. A finished trip stays closed; its totals are those of
    the finish event, where it tells them. A trip event sets the vehicle's state as well: a finished trip leaves it idle.
    A closed trip is forgotten after ``closed_us``, one that is never closed after ``forget_us`` without a sample.
    """

    columns = ("us", "is_event", "sequence", "vehicle_id", "trip_id", "kind", "state", "distance_m", "energy_kwh", "soc_percent")
    order = ("us", "is_event", "sequence", "trip_id", "kind")
    schema = FLEET_SCHEMA

    def __init__(self, closed_us: int = DAY_US, forget_us: int = 7 * DAY_US):
        self.closed_us, self.forget_us = closed_us, forget_us

    def begin(self) -> dict[str, Any]:
        return {"vehicle": None, "trips": {}}

    def fold(self, state: dict[str, Any], rows: list[Sequence]) -> None:
        trips = state["trips"]
        for at, is_event, _, vehicle_id, trip_id, kind, status, *measures in rows:
            distance, energy, soc = map(_none, measures)
            trip = trips.setdefault(trip_id, [None, None, None, None, None, at]) if trip_id is not None else None
            if trip is not None and trip[4] is None:
                trip[5] = at
                if not is_event:
                    if trip[1] is None or (distance is not None and distance >= trip[1]):
                        trip[:4] = [status, distance, energy, soc]
                else:
                    trip[0] = EVENT_STATE[kind]
                    if kind == "finished":
                        known = trip[1:4]
                        trip[1:5] = [*(old if new is None else new for new, old in zip((distance, energy, soc), known)), at]
            state["vehicle"] = [VEHICLE_STATE[kind] if is_event else status, vehicle_id, trip_id, at]

    def names(self, state: dict[str, Any]) -> set[str]:
        return {f"t{trip_id}" for trip_id in state["trips"]} | ({"v"} if state["vehicle"] is not None else set())

    def results(self, key: tuple, state: dict[str, Any]) -> Iterator[tuple[str, tuple]]:
        vehicle = state["vehicle"]
        for trip_id, (status, distance, energy, soc, ended, at) in state["trips"].items():
            rate = energy / (distance / 100_000.0) if distance is not None and distance > 0 and energy is not None else None
            yield f"t{trip_id}", ("trip", vehicle[1] if vehicle else None, trip_id, status, distance, energy, rate, soc, ended, at)
        if vehicle is not None:
            # only a change of state is news of a vehicle
            yield "v", ("vehicle", vehicle[1], None, vehicle[0], None, None, None, None, None, None)

    def expire(self, state: dict[str, Any], passed: int) -> None:
        limits = {t: trip[4] + self.closed_us if trip[4] is not None else trip[5] + self.forget_us for t, trip in state["trips"].items()}
        state["trips"] = {t: trip for t, trip in state["trips"].items() if limits[t] > passed}


def fleet_state(rows: DataFrame, watermark: str = "30 minutes", key: str = "vehicle_id", **times: int) -> DataFrame:
    """Changed trips and vehicles per micro-batch, one state for both.

    ``rows``: vehicle_id, trip_id, kind (``telemetry`` or a trip event), at, sequence, state, distance_m, energy_kwh, soc_percent.
    """
    ready = rows.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withWatermark("at", watermark).withColumns({
        "us": F.unix_micros("at"), "is_event": F.col("kind") != "telemetry", "sequence": F.coalesce("sequence", F.lit(0).cast("bigint"))})
    return replay(ready.select(F.col(key).alias("_key"), "at", *FleetState.columns), "_key", FleetState(**times))


def trips_of(changes: DataFrame) -> DataFrame:
    """The trips among the changes."""
    return changes.where("entity = 'trip'").withColumn("ended_at", F.timestamp_micros("ended_us")).select(*TRIP_COLUMNS)


def vehicles_of(changes: DataFrame) -> DataFrame:
    """The vehicles among the changes."""
    return changes.where("entity = 'vehicle'").select("vehicle_id", "state")


class TripTotals(StatefulProcessor):
    """Newest absolute counters of each micro-batch, assigned and never added; a finished trip stays closed.

    Of samples that are told together only the newest counts, so results depend on the batches; ``FleetState`` is free of that and forgets old trips. A replay cannot move a trip backwards: counters below the known distance are ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TRIP_STATE)
        self.row = Row(*(c.strip().split(" ")[0] for c in _TOTALS_SCHEMA.split(",")))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, distance, energy, soc, ended = self.totals.get() if self.totals.exists() else (None,) * 5
        newest, place, events = None, None, []
        for r in rows:
            if r.kind == "telemetry":
                # the newest sample, the first in sequence of several at that time
                here = (r.us, r.sequence is not None, -(r.sequence or 0))
                if place is None or here > place:
                    newest, place = r, here
            else:
                events.append(r)
        # buffered telemetry goes first, so the final totals of a finish event win
        if newest is not None and ended is None:
            reached = _none(newest.distance_m)
            if distance is None or (reached is not None and reached >= distance):
                status, distance, energy, soc = newest.state, reached, _none(newest.energy_kwh), _none(newest.soc_percent)
        for event in sorted(events, key=lambda e: e.us):
            if ended is not None:
                break
            status = EVENT_STATE[event.kind]
            if event.kind == "finished":
                ended = event.us
                distance, energy, soc = (old if _none(new) is None else new for new, old in ((event.distance_m, distance), (event.energy_kwh, energy), (event.soc_percent, soc)))
        self.totals.update((status, distance, energy, soc, ended))
        rate = energy / (distance / 100_000.0) if distance is not None and distance > 0 and energy is not None else None
        yield self.row(key[0], status, distance, energy, rate, soc, ended)

    def close(self) -> None:
        pass


def trip_totals(rows: DataFrame) -> DataFrame:
    """One row per trip and micro-batch with the trip's state after it.

    ``rows``: trip_id, kind (``telemetry`` or a trip event), at, sequence, state, distance_m, energy_kwh, soc_percent.
    """
    use_map_state(rows.sparkSession)
    ready = rows.where(F.col("trip_id").isNotNull()).withColumn("us", F.unix_micros("at")).drop("at")
    totals = ready.groupBy("trip_id").transformWithState(TripTotals(), _TOTALS_SCHEMA, "Update", "None")
    return totals.withColumn("ended_at", F.timestamp_micros("ended_us")).select(*TRIP_COLUMNS)


# measures of a window: sums first, then means; nulls count for neither
_SUMS = ("distance_km", "duration_s", "energy_kwh")
_MEANS = ("speed_kmh", "_square", "acceleration_abs_mean_ms2", "outside_temperature_c", "battery_temperature_c", "precipitation_mm", "wind_speed_ms",
          "gradient_percent", "soc_percent", "speed_limit_kmh", "_severity")
_CLASSES = tuple(ROAD_CLASS_ORDINAL)
_SAMPLE = {
    "vehicle_id": "string", "sequence": "bigint", "speed_kmh": "double", "acceleration_ms2": "double", "outside_temperature_c": "double",
    "battery_temperature_c": "double", "precipitation_mm": "double", "wind_speed_ms": "double", "gradient_percent": "double", "battery_soc_percent": "double",
    "speed_limit_kmh": "double", "severity_ordinal": "double", "vehicle_state": "string", "road_class": "string", "odometer_m": "double", "cumulative_energy_kwh": "double",
}


class TripWindows(OrderedReplay):
    """60 s windows counted from the trip's first sample, as sums that add up minute by minute.

    A late sample that precedes the first one known moves all windows; results that such a move leaves without samples are taken back by a row of no samples.
    Once the watermark has passed the first sample it stays for as long as the trip is known, so a trip that goes on after a pause goes on counting.
    """

    columns = ("us", *_SAMPLE)
    order = ("us", "sequence")
    schema = ("trip_id string, vehicle_id string, first_us bigint, window_index bigint, samples bigint, " + ", ".join(f"{c} double" for c in (*_SUMS, *_MEANS))
              + ", _events bigint, _driving boolean, " + ", ".join(f"_class_{c} bigint" for c in _CLASSES) + ", first_odometer_m double, last_odometer_m double")

    def begin(self) -> dict[str, Any]:
        return {"first": None, "vehicle": None, "last": None, "windows": {}}

    def fold(self, state: dict[str, Any], rows: list[Sequence]) -> None:
        for us, *values in rows:
            r = dict(zip(_SAMPLE, values))
            if state["first"] is None:
                state["first"], state["vehicle"] = us, r["vehicle_id"]
            before = state["last"] or [None, None, None]
            odometer, energy, speed, push, limit = (_none(r[c]) for c in ("odometer_m", "cumulative_energy_kwh", "speed_kmh", "acceleration_ms2", "speed_limit_kmh"))
            step_m, step_kwh = _ahead(odometer, before[1]), _ahead(energy, before[2])
            push = None if push is None else abs(push)
            measures = [
                None if step_m is None else step_m / 1000.0, None if before[0] is None else (us - before[0]) / 1e6, step_kwh, speed, None if speed is None else speed * speed, push,
                *(_none(r[c]) for c in ("outside_temperature_c", "battery_temperature_c", "precipitation_mm", "wind_speed_ms", "gradient_percent", "battery_soc_percent")),
                UNRESTRICTED_KMH if limit is None else limit, _none(r["severity_ordinal"])]
            state["last"] = [us, odometer, energy]
            k, n = str((us - state["first"]) // WINDOW_US), len(measures)
            w = state["windows"].setdefault(k, {"sums": [0.0] * n, "counts": [0] * n, "more": [0] * (2 + len(_CLASSES)), "driving": True, "odometer": [odometer, None]})
            for i, value in enumerate(measures):
                if value is not None:
                    w["sums"][i] += value
                    w["counts"][i] += 1
            w["more"][0] += push is not None and push > ACCELERATION_EVENT_MS2
            w["more"][1] += 1
            if r["road_class"] in _CLASSES:
                w["more"][2 + _CLASSES.index(r["road_class"])] += 1
            w["driving"] = w["driving"] and r["vehicle_state"] == "driving"
            w["odometer"][1] = odometer

    def names(self, state: dict[str, Any]) -> set[str]:
        return set(state["windows"])

    def results(self, key: tuple, state: dict[str, Any]) -> Iterator[tuple[str, tuple]]:
        for k, w in state["windows"].items():
            values = [(s if c else None) if i < len(_SUMS) else (s / c if c else None) for i, (s, c) in enumerate(zip(w["sums"], w["counts"]))]
            events, samples, *classes = w["more"]
            yield k, (key[0], state["vehicle"], state["first"], int(k), samples, *values, events, w["driving"], *classes, *w["odometer"])

    def gone(self, key: tuple, name: str) -> tuple | None:
        return (key[0], None, None, int(name), 0, *[None] * (len(_SUMS) + len(_MEANS)), 0, False, *[0] * len(_CLASSES), None, None)

    def expire(self, state: dict[str, Any], passed: int) -> None:
        if state["first"] is not None:
            state["windows"] = {k: w for k, w in state["windows"].items() if state["first"] + (int(k) + 1) * WINDOW_US > passed}


def window_sums(rows: DataFrame, watermark: str = "30 minutes") -> DataFrame:
    """Windows of every trip, in a new version whenever they change; the newest version of a window with ``samples`` 0 says there is none.

    ``rows``: trip_id, recorded_at and the columns of a sample; those a feed does not have are taken as null.
    """
    ready = rows.where(F.col("trip_id").isNotNull() & F.col("recorded_at").isNotNull()).withWatermark("recorded_at", watermark)
    sample = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _SAMPLE.items()]
    return replay(ready.select("trip_id", "recorded_at", F.unix_micros("recorded_at").alias("us"), *sample), "trip_id", TripWindows())


def trip_windows(rows: DataFrame, watermark: str = "30 minutes") -> DataFrame:
    """Samples, mean speed and odometer readings of ``window_sums``."""
    start = F.timestamp_micros(F.col("first_us") + F.col("window_index") * WINDOW_US)
    return window_sums(rows, watermark).select(
        "trip_id", "window_index", start.alias("window_start"), "samples", F.col("speed_kmh").alias("mean_speed_kmh"), "first_odometer_m", "last_odometer_m")


def stored_windows(versions: DataFrame) -> DataFrame:
    """The newest versions of ``window_sums`` in the form that ``learning.finish_windows`` takes."""
    return versions.where("samples > 0").withColumn("_first", F.timestamp_micros("first_us")).withColumnRenamed("samples", "_n").drop("first_us", "first_odometer_m", "last_odometer_m")
