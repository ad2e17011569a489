"""Message schemas and the parser shared by all topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: message contracts
TOPICS = {
    "vehicle.telemetry.v1": "telemetry", "vehicle.trip-events.v1": "trip_event",
    "traffic.events.v1": "traffic_event", "charging.events.v1": "charging_event",
}
PAYLOADS = {
    "telemetry": (
        "vehicle_id string, trip_id string, route_id string, recorded_at timestamp, latitude double, longitude double, speed_kmh double, "
        "acceleration_ms2 double, heading_deg double, battery_soc_percent double, battery_temperature_c double, outside_temperature_c double, "
        "instantaneous_power_kw double, energy_consumption_kwh_100km double, cumulative_energy_kwh double, estimated_range_km double, "
        "road_class string, speed_limit_kmh double, odometer_m double, state string"
    ),
    "trip_event": (
        "event_type string, trip_id string, vehicle_id string, occurred_at timestamp, latitude double, longitude double, soc_percent double, "
        "distance_m double, energy_kwh double, station_id string, reason string"
    ),
    "traffic_event": (
        "external_id string, event_type string, severity string, road_name string, direction string, title string, description string, "
        "latitude double, longitude double, starts_at timestamp, ends_at timestamp, is_blocked boolean, delay_minutes double, observed_at timestamp"
    ),
    "charging_event": (
        "station_id string, event_type string, occurred_at timestamp, vehicle_id string, trip_id string, connector_type string, power_kw double, "
        "energy_added_kwh double, soc_percent double, duration_s double, latitude double, longitude double"
    ),
}
ENVELOPE = "event_id string, event_type string, schema_version int, occurred_at timestamp, producer string, data_origin string, payload struct<{payload}>"
TRIP_EVENT_TYPES = ("started", "finished", "charging_started", "charging_finished", "paused")


def payload_struct(kind: str) -> str:
    return ", ".join(f"{name}: {kind_}" for name, kind_ in (field.strip().rsplit(" ", 1) for field in PAYLOADS[kind].split(",")))


def envelope_schema(kind: str) -> str:
    return ENVELOPE.format(payload=payload_struct(kind))


def _p(name: str) -> Column:
    return F.col(f"payload.{name}")


def _outside(name: str, low: float | None, high: float | None = None) -> Column:
    value, out = _p(name), F.lit(False)
    if low is not None:
        out = out | (value < low)
    if high is not None:
        out = out | (value > high)
    return F.isnan(value) | out


def payload_rules(kind: str) -> list[tuple[str, Column]]:
    """(reason, broken) in the order they are reported; an unknown outcome is not a breach."""
    place = [("latitude", _p("latitude").isNull() | _outside("latitude", -90, 90)), ("longitude", _p("longitude").isNull() | _outside("longitude", -180, 180))]
    if kind == "telemetry":
        return [
            ("vehicle_id", F.coalesce(_p("vehicle_id"), F.lit("")) == ""), ("recorded_at", _p("recorded_at").isNull()), *place,
            ("speed_kmh", _p("speed_kmh").isNull() | _outside("speed_kmh", 0)),
            ("battery_soc_percent", _p("battery_soc_percent").isNull() | _outside("battery_soc_percent", 0, 100)),
            ("cumulative_energy_kwh", _p("cumulative_energy_kwh").isNull() | _outside("cumulative_energy_kwh", 0)),
            ("estimated_range_km", _outside("estimated_range_km", 0)), ("speed_limit_kmh", _p("speed_limit_kmh") <= 0),
            ("odometer_m", _p("odometer_m").isNull() | _outside("odometer_m", 0)), ("state", _p("state").isNull()),
        ]
    if kind == "trip_event":
        return [("trip_id", F.coalesce(_p("trip_id"), F.lit("")) == ""), ("vehicle_id", F.coalesce(_p("vehicle_id"), F.lit("")) == ""),
                ("event_type", ~F.coalesce(_p("event_type").isin(*TRIP_EVENT_TYPES), F.lit(False))), ("occurred_at", _p("occurred_at").isNull()),
                ("soc_percent", _outside("soc_percent", 0, 100))]
    if kind == "traffic_event":
        return [("external_id", F.coalesce(_p("external_id"), F.lit("")) == ""), ("title", F.coalesce(_p("title"), F.lit("")) == ""), *place,
                ("severity", ~F.coalesce(_p("severity").isin("low", "moderate", "high", "severe"), F.lit(False)))]
    return [("station_id", F.coalesce(_p("station_id"), F.lit("")) == ""), ("vehicle_id", F.coalesce(_p("vehicle_id"), F.lit("")) == ""),
            ("soc_percent", _outside("soc_percent", 0, 100))]


def parse_envelope(messages: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Envelope and payload columns plus ``reject_reason``: NULL for a good message, never an error.

    Works the same on a stream and on a static relation.
    """
    parsed = messages.withColumn("_m", F.from_json(F.col(column), envelope_schema(kind), {"mode": "PERMISSIVE"})).select(
        F.col(column).alias("raw"), "_m.*")
    checks = [F.when(F.col("event_id").isNull() | F.col("payload").isNull(), "malformed"),
              F.when(~F.coalesce(F.col("event_type").contains(kind.split("_")[0]), F.lit(False)), "event_type")]
    checks += [F.when(F.coalesce(broken, F.lit(False)), reason) for reason, broken in payload_rules(kind)]
    return parsed.withColumn("reject_reason", F.coalesce(*checks))


def good(parsed: DataFrame) -> DataFrame:
    """Payload columns of the good messages; the envelope's time steps aside where the payload has its own."""
    fields = parsed.schema["payload"].dataType.fieldNames()
    published = F.col("occurred_at").alias("published_at" if "occurred_at" in fields else "occurred_at")
    return parsed.where(F.col("reject_reason").isNull()).select("event_id", published, "producer", "data_origin", "payload.*")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("raw", "event_id", "reject_reason")


def read_messages(spark: SparkSession, source: str, options: dict[str, str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream with the message text in ``value``: ``kafka`` with its options, else a folder of JSON lines.

    ``options`` also take those of a ``BatchPolicy``, which bound what one micro-batch reads.
    """
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.schema("value string").options(**(options or {}))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(source)
