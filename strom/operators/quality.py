"""Rule engine: every rule is a name and a predicate column; a row keeps all rules it breaks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.lookups import in_germany
from strom.operators.sizes import is_small
from strom.operators.sliced import with_history
from strom.session import cut_lineage

DUPLICATE = "no_duplicate_key"
MIN_ACCEPTANCE = 0.5
STRICT_MIN_ROWS = 20
_SEQUENCE_SLICE = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``broken`` is true where a row violates the rule; NULL counts as not broken."""

    name: str
    broken: Column
    message: Column


def _about(field: str, what: str) -> Column:
    return F.concat(F.lit(f"{field} "), F.coalesce(F.col(field).cast("string"), F.lit("null")), F.lit(f" {what}"))


def required_field(field: str) -> Rule:
    blank = F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")
    return Rule(f"required_field[{field}]", blank, F.lit(f"{field} is missing or blank"))


def numeric_range(field: str, low: float, high: float, allow_none: bool = True, label: str = "numeric_range") -> Rule:
    value = F.col(field)
    outside = F.isnan(value) | ~value.between(low, high)
    broken = F.coalesce(outside, F.lit(not allow_none))
    return Rule(f"{label}[{field}]", broken, _about(field, f"is outside [{low:g}, {high:g}]"))


def soc_in_range(field: str = "battery_soc_percent", allow_none: bool = False) -> Rule:
    return numeric_range(field, 0.0, 100.0, allow_none, "soc_in_range")


def latitude_in_range(field: str = "latitude") -> Rule:
    return numeric_range(field, -90.0, 90.0, False, "latitude_in_range")


def longitude_in_range(field: str = "longitude") -> Rule:
    return numeric_range(field, -180.0, 180.0, False, "longitude_in_range")


def within_germany_bbox(latitude: str = "latitude", longitude: str = "longitude") -> Rule:
    return Rule("within_germany_bbox", ~in_germany(F.col(latitude), F.col(longitude)),
                F.concat_ws(" ", F.lit("coordinate"), F.col(latitude).cast("string"), F.col(longitude).cast("string"),
                            F.lit("is outside Germany")))


def positive_power(field: str = "power_kw", maximum_kw: float = 1000.0, allow_none: bool = True) -> Rule:
    value = F.col(field)
    broken = F.coalesce((value <= 0) | (value > maximum_kw), F.lit(not allow_none))
    return Rule(f"positive_power[{field}]", broken, _about(field, f"kW is not in (0, {maximum_kw:g}]"))


def timestamp_present(field: str) -> Rule:
    return Rule(f"timestamp_present[{field}]", F.col(field).isNull(), F.lit(f"{field} is missing"))


def timestamp_not_future(field: str, as_of: datetime, tolerance_s: float = 3600.0) -> Rule:
    ahead = (F.unix_micros(F.col(field)) - F.unix_micros(F.lit(as_of))) / 1e6
    return Rule(f"timestamp_not_future[{field}]", ahead > tolerance_s, _about(field, "is in the future"))


def mark_duplicates(df: DataFrame, key: Sequence[str], order: str, flag: str = "is_duplicate", cfg: Config = DEFAULT) -> DataFrame:
    """Flags every row but the first of its key. A row with a NULL in its key is never a duplicate.

    ``order`` is unique within a key; a row without it is taken for a duplicate. Which keys repeat is found by counting a hash of them; where these are
    measured to be few, their first rows are broadcast and no row is moved. Else the first occurrence is a map-side-combined
    minimum, and rows meet it on (key, order): that pair spreads evenly however often a key repeats.
    """
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    keyed = df.where(has_key).withColumn("_hash", F.xxhash64(*key))
    repeated = cut_lineage(keyed.groupBy("_hash").agg(F.count(order).alias("_rows")).where("_rows > 1").select("_hash"))
    most = 5 * cfg.broadcast_rows  # one number, or a key with its first row
    if is_small(repeated, most):
        # one hash may stand for several keys: the keys themselves decide
        first = cut_lineage(keyed.join(F.broadcast(repeated), "_hash", "left_semi").groupBy(*key).agg(F.min(order).alias("_first")))
        if is_small(first, most):
            marked = df.join(F.broadcast(first), list(key), "left")
            later = F.col(order).isNull() | F.coalesce(F.col(order) != F.col("_first"), F.lit(False))
            return marked.withColumn(flag, has_key & later).select(*df.columns, flag)
    first = df.where(has_key).groupBy(*key).agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    marked = df.join(first, [*key, order], "left")
    return marked.withColumn(flag, has_key & F.col("_first").isNull()).select(*df.columns, flag)


def monotonic_violations(df: DataFrame, key: str, ts: str, sequence: str) -> DataFrame:
    """Rows whose timestamp steps back behind an earlier row of the same key, in arrival order."""
    usable = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    seen = with_history(usable, [key], sequence, [], _SEQUENCE_SLICE, running_max={"latest_before": F.col(ts)})
    return seen.where(F.col(ts) < F.col("latest_before"))


def validate(df: DataFrame, rules: Sequence[Rule], key: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Adds the broken rules, the first message and the verdict to every row; no row is dropped.

    Duplicates are judged over all rows: a row another rule rejects still claims its key.
    """
    checked = mark_duplicates(df, key, order, "_duplicate") if key else df.withColumn("_duplicate", F.lit(False))
    rules = [*rules, Rule(DUPLICATE, F.col("_duplicate"), F.lit("duplicate key"))]
    # plain columns, as Spark interprets functions over arrays
    checked = checked.withColumns({f"_broken{i}": F.coalesce(r.broken, F.lit(False)) for i, r in enumerate(rules)})
    broken = [F.col(f"_broken{i}") for i in range(len(rules))]
    count = sum((b.cast("int") for b in broken), F.lit(0))

    def first_of(values: Sequence[Column]) -> Column:
        return reduce(lambda otherwise, one: F.when(one[0], one[1]).otherwise(otherwise), reversed(list(zip(broken, values))), F.lit(None).cast("string"))

    return checked.withColumns({
        "quality_status": F.when(count == 0, "accepted").when((count == 1) & F.col("_duplicate"), "duplicate").otherwise("rejected"),
        "quality_rules": F.concat_ws("; ", *(F.when(b, F.lit(r.name)) for b, r in zip(broken, rules))),
        "quality_rule": first_of([F.lit(r.name) for r in rules]),
        "quality_message": first_of([r.message for r in rules]),
    }).drop("_duplicate", *(f"_broken{i}" for i in range(len(rules))))


def quality_report(validated: DataFrame) -> DataFrame:
    """Counters and per-rule counts as (metric, value) rows."""
    by_status = validated.groupBy(F.concat(F.lit("rows_"), "quality_status").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    received = validated.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows_received").alias("metric"), "value")
    broken = validated.where(F.col("quality_rules") != "").select(F.explode(F.split("quality_rules", "; ")).alias("rule"))
    by_rule = broken.groupBy(F.concat(F.lit("rule:"), "rule").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return by_status.unionByName(received).unionByName(by_rule)


def merge_reports(*reports: DataFrame) -> DataFrame:
    merged = reports[0]
    for report in reports[1:]:
        merged = merged.unionByName(report)
    return merged.groupBy("metric").agg(F.sum("value").alias("value"))


def check_acceptance(
    report: DataFrame, strict: bool = False, minimum: float = MIN_ACCEPTANCE, min_rows: int = STRICT_MIN_ROWS
) -> float:
    """Acceptance rate; in strict mode too low a rate over enough rows is an error."""
    counts = {r.metric: r.value for r in report.where(F.col("metric").isin("rows_received", "rows_accepted")).collect()}
    received, accepted = counts.get("rows_received", 0), counts.get("rows_accepted", 0)
    rate = accepted / received if received else 0.0
    if strict and received >= min_rows and rate < minimum:
        raise ValueError(f"only {accepted}/{received} rows accepted")
    return rate


def violations(validated: DataFrame, row_id: str, cap: int = 5000) -> DataFrame:
    """Broken rules with their first message, the lowest row ids first, up to the report's size."""
    return (
        validated.where(F.col("quality_rule").isNotNull())
        .select(row_id, "quality_status", "quality_rules", "quality_message").orderBy(row_id).limit(cap)
    )


# ---- rule sets per feed (fixed values: plausibility limits)


def station_rules() -> list[Rule]:
    return [
        required_field("external_id"), required_field("operator"), required_field("city"), within_germany_bbox(),
        positive_power("max_power_kw", maximum_kw=1000.0),
    ]


def weather_rules(as_of: datetime) -> list[Rule]:
    return [
        required_field("weather_station_id"), timestamp_present("observed_at"),
        timestamp_not_future("observed_at", as_of, 900.0), within_germany_bbox(),
        numeric_range("temperature_c", -50.0, 60.0),
    ]


def traffic_rules() -> list[Rule]:
    return [required_field("external_id"), required_field("title"), within_germany_bbox()]


def telemetry_rules(as_of: datetime) -> list[Rule]:
    return [
        required_field("vehicle_id"), soc_in_range(), latitude_in_range(), longitude_in_range(),
        timestamp_not_future("recorded_at", as_of, 120.0), numeric_range("speed_kmh", 0.0, 400.0, False),
    ]
