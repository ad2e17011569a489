"""Route analysis served by a fitted consumption model.

The model is an input of the plan: any Spark ML pipeline that reads the twenty features and writes ``predicted`` (kWh per 100 km), saved and
loaded like every other. Its one input that depends on the request is the charge it is told, the middle between the start charge and the
arrival that the physics implies. So segments are scored once for each distinct (route, vehicle, start charge), a *case*, however many requests share it.
The physical parts of a segment are scaled to the prediction, which keeps them additive, and what the model says beyond the physics becomes a driver of its own.
"""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import energy, lookups
from strom.operators.checks import MODE_RANK, stored_mode, weakest_mode
from strom.plans import analysis
from strom.plans.learning import FEATURES, features_from_conditions
from strom.session import cut_lineage

PAIR = ("route_id", "vehicle_model_id")
CASE = (*PAIR, "start_soc_percent")
_PARTS = energy.ENERGY_FIELDS


def as_pipeline(model: Model) -> PipelineModel:
    """A regressor over the feature vector as a pipeline that starts from the twenty columns."""
    return PipelineModel(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """A saved pipeline; one that does not read the features or write ``predicted`` is an error."""
    model = PipelineModel.load(path)
    probe = spark.createDataFrame([], ", ".join(f"{f} double" for f in FEATURES))
    if "predicted" not in model.transform(probe).columns:
        raise ValueError("the model writes no column predicted")
    return model


def driven_energies(requests: DataFrame, conditions: DataFrame, models: DataFrame) -> DataFrame:
    """Every (segment, vehicle) somebody asks about with its energy and counterfactuals. Written, since four plans read it."""
    return cut_lineage(analysis.counterfactuals(analysis.for_vehicles(conditions, requests, models)))


def charge_cases(requests: DataFrame, driven: DataFrame) -> DataFrame:
    """The distinct (route, vehicle, start charge) with the charge the model is told."""
    totals = driven.groupBy(*PAIR).agg(F.sum("kwh").alias("_kwh"), F.first("usable_capacity_kwh").alias("_usable"))
    cases = requests.select(*CASE).distinct().join(totals, list(PAIR))
    return cases.select(*CASE, analysis.mean_soc(F.col("start_soc_percent"), F.col("_kwh"), F.col("_usable")).alias("mean_soc_percent"))


def served_segments(driven: DataFrame, cases: DataFrame, model: Model | None) -> DataFrame:
    """Segments of every case with the energy that is served: the prediction, else the physics. ``physical_kwh`` keeps the latter.

    A prediction below zero counts as zero; a segment without physical energy stays as it is.
    """
    rows = driven.join(cases, list(PAIR)).withColumn("physical_kwh", F.col("kwh"))
    if model is None:
        return rows.withColumn("predicted_kwh_100km", F.lit(None).cast("double"))
    inputs = features_from_conditions(rows.withColumn("_row", F.struct("*")), F.col("mean_soc_percent"), ("_row",))
    scored = model.transform(inputs).select("_row.*", F.col("predicted").alias("predicted_kwh_100km"))
    target = F.greatest(F.lit(0.0), F.col("predicted_kwh_100km")) * F.col("distance_km") / 100.0
    return analysis.rescale_to_model(scored, target)


def case_totals(served: DataFrame) -> DataFrame:
    """Sums over the segments of every case."""
    sums = (*_PARTS, "physical_kwh", "free_kwh", "mild_kwh", "neutral_kwh", "distance_km", "duration_s")
    first = ("usable_capacity_kwh", "nominal_consumption_kwh_100km", "mean_soc_percent")
    return served.groupBy(*CASE).agg(*(F.sum(c).alias(c) for c in sums), *(F.first(c).alias(c) for c in first))


def source_modes(
    routes: DataFrame, event_pairs: DataFrame, event_modes: DataFrame, readings: DataFrame, reading_modes: DataFrame, segments: DataFrame,
) -> DataFrame:
    """Per route the weakest mode of the rows its answer rests on; no row at all counts as test data.

    ``event_modes`` (traffic_event_id, provider_mode) and ``reading_modes`` (weather_station_id, provider_mode) say how the rows came in,
    ``readings`` holds those in use by segment, ``routes`` (route_id, routing_mode) how the line was found.
    """
    def by_route(rows: DataFrame, name: str) -> DataFrame:
        modes = rows.withColumn("_mode", stored_mode(F.col("provider_mode"))).join(segments.select("route_segment_id", "route_id"), "route_segment_id")
        return modes.groupBy("route_id").agg(weakest_mode("_mode").alias(name))

    weather = by_route(readings.where("weather_station_id is not null").join(reading_modes, "weather_station_id"), "weather_mode")
    traffic = by_route(event_pairs.join(event_modes, "traffic_event_id"), "traffic_mode")
    known = routes.join(weather, "route_id", "left").join(traffic, "route_id", "left").fillna("fixture", ["weather_mode", "traffic_mode"])
    order = F.array(*map(F.lit, MODE_RANK))
    ranks = (F.array_position(order, F.col(m)) for m in ("routing_mode", "weather_mode", "traffic_mode"))
    return known.withColumn("data_mode", F.element_at(order, F.greatest(*ranks).cast("int")))


def answers(
    requests: DataFrame, totals: DataFrame, modes: DataFrame, model_name: str | None, min_arrival_soc: float = 10.0, cfg: Config = DEFAULT
) -> DataFrame:
    """One answer per request. Penalties compare runs of the physics with each other, so the model does not touch them."""
    known = totals.join(modes, "route_id").withColumns({
        "_arrival": F.col("start_soc_percent") - F.col("kwh") / F.col("usable_capacity_kwh") * 100.0,
        "_rate": energy.consumption_kwh_per_100km(F.col("kwh"), F.col("distance_km")),
    })
    deficit = F.greatest(F.lit(0.0), (F.lit(min_arrival_soc) - F.col("_arrival")) / 100.0 * F.col("usable_capacity_kwh"))
    penalty = lambda other: analysis.penalty_percent(F.col("physical_kwh"), F.col(other))
    known = known.select(
        *CASE, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_arrival"))).alias("arrival_soc_percent"),
        F.col("kwh").alias("energy_kwh_total"), deficit.alias("energy_deficit_kwh"), (deficit > 0).alias("charging_required"),
        "distance_km", F.col("duration_s").alias("estimated_duration_s"), F.col("_rate").alias("avg_consumption_kwh_100km"),
        energy.consumption_kwh_per_100km(F.col("physical_kwh"), F.col("distance_km")).alias("baseline_kwh_100km"),
        (F.col("_rate") if model_name else F.lit(None).cast("double")).alias("model_kwh_100km"), F.lit(model_name).cast("string").alias("model_name"),
        lookups.energy_intensity(F.col("_rate"), F.col("nominal_consumption_kwh_100km")).alias("energy_intensity"),
        penalty("mild_kwh").alias("weather_penalty_percent"), penalty("free_kwh").alias("traffic_penalty_percent"),
        penalty("neutral_kwh").alias("total_penalty_percent"), "mean_soc_percent", *(p for p in _PARTS if p != "kwh"),
        "routing_mode", "weather_mode", "traffic_mode", "data_mode",
    )
    return analysis.meet_requests(requests.select("request_id", *CASE), cut_lineage(known), cfg, CASE)


def drivers(requests: DataFrame, driven: DataFrame, totals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The seven drivers of every request's consumption. The rungs do not depend on the charge, so they are worked out once for each (route, vehicle)."""
    still = {"gradient_percent": F.lit(0.0), "headwind_ms": F.lit(0.0), "acceleration_ms2": F.lit(0.0), "battery_temperature_c": F.col("temperature_c")}
    rungs = analysis.ladder_totals(driven.withColumns(still), list(PAIR))
    cases = totals.select(*CASE, F.col("kwh").alias("served_kwh")).join(rungs, list(PAIR))
    ranked = cut_lineage(analysis.rank_drivers(cases, list(CASE), "served_kwh"))
    return analysis.meet_requests(requests.select("request_id", *CASE), ranked, cfg, CASE)


def segment_answers(served: DataFrame) -> DataFrame:
    """Segments of every case as the answer lists them: served and physical consumption, charge at the end, intensity."""
    upto = W.partitionBy(*CASE).orderBy("segment_ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    rate: Column = energy.consumption_kwh_per_100km(F.col("kwh"), F.col("distance_km"))
    soc = F.col("start_soc_percent") - F.sum("kwh").over(upto) / F.col("usable_capacity_kwh") * 100.0
    return served.select(
        *CASE, "segment_ordinal", "route_segment_id", "kwh", rate.alias("kwh_per_100km"),
        energy.consumption_kwh_per_100km(F.col("physical_kwh"), F.col("distance_km")).alias("baseline_kwh_per_100km"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), soc)).alias("soc_at_end_percent"),
        lookups.energy_intensity(rate, F.col("nominal_consumption_kwh_100km")).alias("energy_intensity"),
    )
