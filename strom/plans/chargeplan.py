"""Charging plans for many requests at once: a beam search in at most three joins.

Identical requests - same corridor, vehicle and start charge - share one search. A state of the
search carries its position on the corridor's running energy sum, so the energy of any leg is one
subtraction; the beam is a ranked cut per search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.energy import charge_time_batch
from strom.operators.sizes import is_small, salted_join
from strom.session import cut_lineage


@dataclass(frozen=True)
class PlanSettings:
    # fixed values: defaults of the search
    min_soc: float = 10.0
    target_arrival_soc: float = 10.0
    max_stops: int = 3
    beam_width: int = 8
    targets: tuple[float, ...] = (60.0, 70.0, 80.0, 90.0)
    detour_speed_kmh: float = 60.0
    risk_buffer: float = 5.0
    risk_per_percent: float = 2.0
    battery_temperature_c: float = 20.0
    min_leg_km: float = 5.0
    min_useful_charge: float = 2.0
    max_candidates: int = 60


_EPSILON = 1e-6


def thin_candidates(candidates: DataFrame, keys: Sequence[str], spacing_km: float = 10.0, cap: int = 60) -> DataFrame:
    """Best site per stretch of the corridor; if still too many, the strongest.

    Best means most power, then least detour, then the id. Both cuts are rank filters, so each map
    task passes on only its own best rows.
    """
    rank = [F.col("max_power_kw").desc(), F.col("lateral_m").asc(), F.col("station_id").asc()]
    bucket = F.floor(F.col("offset_km") / spacing_km)
    per_stretch = W.partitionBy(*keys, "_bucket").orderBy(*rank)
    best = candidates.withColumn("_bucket", bucket).withColumn("_r", F.row_number().over(per_stretch)).where(F.col("_r") == 1)
    strongest = W.partitionBy(*keys).orderBy(*rank)
    return best.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= cap).drop("_r", "_bucket")


def energy_at(candidates: DataFrame, driven: DataFrame) -> DataFrame:
    """Energy used from the origin to each candidate, per vehicle.

    ``driven`` holds one row per (route, vehicle, segment): start_km, end_km, kwh and the energy before it.
    """
    inside = (F.col("offset_km") >= F.col("start_km")) & (F.col("offset_km") < F.col("end_km"))
    last = F.col("is_last") & (F.col("offset_km") >= F.col("end_km"))
    share = F.least(F.lit(1.0), (F.col("offset_km") - F.col("start_km")) / F.nullif(F.col("end_km") - F.col("start_km"), F.lit(0.0)))
    return candidates.join(driven, "route_id").where(inside | last).select(
        *candidates.columns, "vehicle_model_id", (F.col("before_kwh") + F.coalesce(share, F.lit(1.0)) * F.col("kwh")).alias("at_kwh"))


def with_prefix(segments: DataFrame) -> DataFrame:
    """Adds running energy and the corridor's totals. ``segments``: route, vehicle, start_km, distance_km, kwh, duration_s."""
    keys = ["route_id", "vehicle_model_id"]
    upto = W.partitionBy(*keys).orderBy("start_km").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    return segments.withColumns({
        "end_km": F.col("start_km") + F.col("distance_km"),
        "before_kwh": F.sum("kwh").over(upto) - F.col("kwh"),
        "route_kwh": F.sum("kwh").over(whole), "drive_min": F.sum("duration_s").over(whole) / 60.0,
    }).withColumns({"route_km": F.max("end_km").over(whole)}).withColumn("is_last", F.col("end_km") >= F.col("route_km"))


def plan_charging(
    requests: DataFrame, segments: DataFrame, candidates: DataFrame, models: DataFrame,
    settings: PlanSettings = PlanSettings(), cfg: Config = DEFAULT,
) -> DataFrame:
    """Best feasible plan per request, or why there is none.

    ``requests``: request_id, route_id, vehicle_model_id, start_soc_percent. ``candidates``: route_id,
    station_id, offset_km, detour_km, max_power_kw, lateral_m.
    """
    s, pair = settings, ["route_id", "vehicle_model_id"]
    driven = cut_lineage(with_prefix(segments))
    totals = driven.where("is_last").select(*pair, "route_km", "route_kwh", "drive_min").dropDuplicates(pair)
    profile = models.select("vehicle_model_id", "usable_capacity_kwh", "nominal_consumption_kwh_100km", "max_dc_power_kw")
    sites = cut_lineage(energy_at(thin_candidates(candidates, ["route_id"], cap=s.max_candidates), driven))
    searches = requests.select(*pair, "start_soc_percent").distinct()
    start = searches.join(totals, pair).join(F.broadcast(profile), "vehicle_model_id").withColumns({
        "at_km": F.lit(0.0), "at_kwh": F.lit(0.0), "soc": F.col("start_soc_percent"), "charge_min": F.lit(0.0), "detour_km": F.lit(0.0),
        "risk_min": F.lit(0.0), "lowest_soc": F.col("start_soc_percent"), "stops": F.array().cast("array<string>"),
        "targets": F.array().cast("array<double>"),
    })
    usable, comfort = F.col("usable_capacity_kwh"), min(100.0, s.min_soc + s.risk_buffer)

    def percent(kwh: Column) -> Column:
        return kwh / usable * 100.0

    def finished(states: DataFrame) -> DataFrame:
        arrival = F.col("soc") - percent(F.col("route_kwh") - F.col("at_kwh"))
        risk = F.col("risk_min") + F.greatest(F.lit(0.0), F.lit(comfort) - arrival) * s.risk_per_percent
        detour_min = F.col("detour_km") / s.detour_speed_kmh * 60.0
        done = states.withColumn("arrival_soc", arrival).where(
            (F.col("arrival_soc") >= s.min_soc - _EPSILON) & (F.col("arrival_soc") >= s.target_arrival_soc - _EPSILON))
        return done.withColumn("objective", F.col("drive_min") + F.col("charge_min") + detour_min * 2.0 + risk).select(
            *pair, "start_soc_percent", "objective", "arrival_soc", "charge_min", "detour_km", F.least("lowest_soc", "arrival_soc").alias("lowest_soc"),
            "stops", "targets")

    best, beam, considered = finished(start), start, None
    search = [*pair, "start_soc_percent"]
    sites_named = sites.select(
        *pair, "station_id", F.col("offset_km").alias("_km"), F.col("at_kwh").alias("_kwh"), F.col("detour_km").alias("_detour"),
        F.col("max_power_kw").alias("_kw"))
    small = is_small(sites_named, cfg.broadcast_rows)
    for _ in range(s.max_stops):
        # at most ``beam_width`` states meet at most ``max_candidates`` sites per search
        met = (beam.join(F.broadcast(sites_named), pair) if small
               else salted_join(beam, sites_named, pair, F.col("start_soc_percent"), cfg.salt_buckets))
        ahead = (F.col("_km") > F.col("at_km") + s.min_leg_km) & (F.col("_km") <= F.col("route_km") + s.min_leg_km)
        detour_kwh = F.col("_detour") * F.col("nominal_consumption_kwh_100km") / 100.0
        legs = met.where(ahead & ~F.array_contains("stops", F.col("station_id"))).withColumn(
            "_arrival", F.col("soc") - percent(F.col("_kwh") - F.col("at_kwh")) - percent(detour_kwh)
        ).where(F.col("_arrival") >= s.min_soc - _EPSILON)
        needed = percent(F.col("route_kwh") - F.col("_kwh")) + s.target_arrival_soc
        wanted = F.array_distinct(F.transform(F.array(*(F.lit(t) for t in s.targets), needed), lambda t: F.round(t, 6)))
        useful = F.filter(wanted, lambda t: (t >= F.col("_arrival") + s.min_useful_charge) & (t <= 100.0))
        stopped = legs.withColumn("_target", F.explode(useful)).withColumn("_minutes", charge_time_batch(
            F.col("max_dc_power_kw"), usable, F.col("_arrival"), F.col("_target"), F.col("_kw"), F.lit(s.battery_temperature_c)))
        expanded = stopped.select(
            *search, "route_km", "route_kwh", "drive_min", "usable_capacity_kwh", "nominal_consumption_kwh_100km", "max_dc_power_kw",
            F.col("_km").alias("at_km"), F.col("_kwh").alias("at_kwh"), F.col("_target").alias("soc"),
            (F.col("charge_min") + F.col("_minutes")).alias("charge_min"), (F.col("detour_km") + F.col("_detour")).alias("detour_km"),
            (F.col("risk_min") + F.greatest(F.lit(0.0), F.lit(comfort) - F.col("_arrival")) * s.risk_per_percent).alias("risk_min"),
            F.least("lowest_soc", "_arrival").alias("lowest_soc"), F.array_append("stops", F.col("station_id")).alias("stops"),
            F.array_append("targets", F.col("_target")).alias("targets"),
        )
        expanded = cut_lineage(expanded)
        counted = expanded.groupBy(*search).agg(F.count(F.lit(1)).alias("n"))
        considered = counted if considered is None else considered.unionByName(counted)
        best = best.unionByName(finished(expanded))
        spent = F.col("charge_min") + F.col("detour_km") / s.detour_speed_kmh * 120.0 + F.col("risk_min")
        open_kwh = F.col("route_kwh") - F.col("at_kwh") - (F.col("soc") - s.target_arrival_soc) / 100.0 * usable
        score = F.round(spent + F.greatest(F.lit(0.0), open_kwh) / (F.col("max_dc_power_kw") * 0.6) * 60.0, 6)
        order = W.partitionBy(*search).orderBy("_score", "stops", "targets")
        ranked = expanded.withColumn("_score", score).withColumn("_r", F.row_number().over(order))
        beam = ranked.where(F.col("_r") <= s.beam_width).drop("_score", "_r")
    rank = F.struct(F.round("objective", 6).alias("o"), F.size("stops").alias("n"), "stops", "targets")
    chosen = best.groupBy(*search).agg(F.min_by(F.struct("objective", "arrival_soc", "charge_min", "detour_km", "lowest_soc", "stops", "targets"), rank).alias("_p"))
    tries = considered.groupBy(*search).agg((F.sum("n") + 1).alias("alternatives_considered"))
    first_site = sites.groupBy(*pair).agg(F.min("at_kwh").alias("_first_kwh"), F.count(F.lit(1)).alias("_sites"))
    answers = (
        searches.join(totals, pair).join(F.broadcast(profile), "vehicle_model_id").join(chosen, search, "left").join(tries, search, "left")
        .join(first_site, pair, "left")
    )
    reach = (F.col("start_soc_percent") - s.min_soc) / 100.0 * usable
    reason = (
        F.when(F.col("_p").isNotNull(), F.lit(None).cast("string")).when(F.col("_sites").isNull(), "no_station")
        .when(F.col("_first_kwh") > reach, "first_station_out_of_reach").otherwise("gaps_too_large")
    )
    plans = answers.select(
        *search, F.col("_p").isNotNull().alias("feasible"), reason.alias("reason"), F.col("_p.objective").alias("objective_value"),
        F.col("drive_min").alias("driving_time_min"), F.coalesce("_p.charge_min", F.lit(0.0)).alias("charging_time_min"),
        F.coalesce("_p.detour_km", F.lit(0.0)).alias("detour_km_total"), F.col("_p.arrival_soc").alias("arrival_soc_percent"),
        F.col("_p.lowest_soc").alias("min_soc_percent_reached"), F.coalesce(F.size("_p.stops"), F.lit(0)).alias("stop_count"),
        F.array_join("_p.stops", ",").alias("stops"), F.array_join(F.transform("_p.targets", lambda t: F.round(t, 3).cast("string")), ",").alias("charge_targets"),
        F.coalesce("alternatives_considered", F.lit(1)).alias("alternatives_considered"),
    )
    keep = requests.select("request_id", *search)
    if is_small(plans, cfg.broadcast_rows):
        return keep.join(F.broadcast(plans), search, "left")
    return salted_join(keep, plans, search, F.col("request_id"), cfg.salt_buckets, "left")
