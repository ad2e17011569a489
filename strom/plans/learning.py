"""Training set, grouped split, boosted-tree training, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import energy, lookups
from strom.functions.energy import Drive, with_segment_energy
from strom.operators.quality import mark_duplicates
from strom.operators.quantiles import exact_percentiles
from strom.operators.sizes import join_to_dimension
from strom.operators.sliced import with_history
from strom.plans.analysis import default_speed

# fixed values: the model's inputs in order, its target, and the limits of plausible rows
FEATURES = (
    "speed_kmh", "avg_speed_kmh", "speed_std_kmh", "acceleration_abs_mean_ms2", "accel_events_per_km",
    "outside_temperature_c", "battery_temperature_c", "soc_percent", "road_class_ordinal", "speed_limit_kmh",
    "traffic_severity_ordinal", "precipitation_mm", "wind_speed_ms", "gradient_percent", "segment_distance_km",
    "mass_kg", "drag_area", "nominal_consumption_kwh_100km", "hvac_load_kw", "is_motorway",
)
TARGET = "energy_consumption_kwh_100km"
# fixed values: further columns that a table of training windows must have
TRAINING_COLUMNS = (*FEATURES, TARGET, "trip_id", "vehicle_code", "window_start", "window_end", "distance_km", "duration_s", "energy_kwh", "road_class", "traffic_severity", "data_origin")
WINDOW_SECONDS = 60.0
MIN_WINDOW_KM = 0.05
UNRESTRICTED_KMH = 130.0
ACCELERATION_EVENT_MS2 = 0.5
DEFAULT_SOC = 60.0
SPLIT_RATIOS = (0.7, 0.15, 0.15)


def window_features(steps: DataFrame, models: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """60-second windows per trip, anchored at the trip's first sample.

    ``steps`` are telemetry samples with the distance, energy and seconds since the sample before.
    Windows with a sample that is not driving, without distance or time, are dropped.
    """
    # in time order the latest of the negated earlier times is the first one
    placed = with_history(steps, ["trip_id"], "recorded_at", ["telemetry_id"], cfg.slice_seconds,
                          running_max={"_minus_first": -F.unix_micros("recorded_at")})
    placed = placed.withColumn("_first", F.coalesce(F.timestamp_micros(-F.col("_minus_first")), F.col("recorded_at")))
    index = F.floor(lookups.seconds_between(F.col("_first"), F.col("recorded_at")) / WINDOW_SECONDS)
    speed = F.col("speed_kmh")
    classes = {c: F.count_if(F.col("road_class") == c) for c in lookups.ROAD_CLASS_ORDINAL}
    windows = placed.groupBy("trip_id", "vehicle_id", "_first", index.alias("window_index")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("step_distance_m") / 1000.0).alias("distance_km"),
        F.sum("step_seconds").alias("duration_s"), F.sum("step_energy_kwh").alias("energy_kwh"),
        F.avg(speed).alias("speed_kmh"), F.avg(speed * speed).alias("_square"),
        F.avg(F.abs("acceleration_ms2")).alias("acceleration_abs_mean_ms2"),
        F.count_if(F.abs("acceleration_ms2") > ACCELERATION_EVENT_MS2).alias("_events"),
        *(F.avg(c).alias(c) for c in ("outside_temperature_c", "battery_temperature_c", "precipitation_mm", "wind_speed_ms", "gradient_percent")),
        F.avg("battery_soc_percent").alias("soc_percent"),
        F.avg(F.coalesce("speed_limit_kmh", F.lit(UNRESTRICTED_KMH))).alias("speed_limit_kmh"),
        F.avg("severity_ordinal").alias("_severity"), F.bool_and(F.col("vehicle_state") == "driving").alias("_driving"),
        *(c.alias(f"_class_{name}") for name, c in classes.items()),
    )
    return finish_windows(windows, models, cfg)


def finish_windows(windows: DataFrame, models: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Training rows of windows given as sums and means, worked out in batch or kept up by a stream."""
    classes, speed = lookups.ROAD_CLASS_ORDINAL, F.col("speed_kmh")
    usable = F.col("_driving") & (F.col("distance_km") >= MIN_WINDOW_KM) & (F.col("duration_s") > 0)
    # most samples win, the higher class on a tie
    dominant = F.greatest(*(
        F.struct(F.col(f"_class_{name}").alias("n"), F.lit(rank).alias("rank"), F.lit(name).alias("name"))
        for name, rank in lookups.ROAD_CLASS_ORDINAL.items()
    )).getField("name")
    severity = F.greatest(F.lit(1), F.least(F.lit(4), F.bround("_severity").cast("int")))
    names = F.array(*(F.lit(s) for s in lookups.SEVERITY_ORDINAL))
    profile = models.select(
        "vehicle_id", F.col("vehicle_model_code").alias("vehicle_code"), "mass_kg", F.col("drag_area_m2").alias("drag_area"),
        "nominal_consumption_kwh_100km",
    )
    micros = F.unix_micros("_first") + (F.col("window_index") * int(WINDOW_SECONDS * 1e6))
    driven = join_to_dimension(windows.where(usable), profile, ["vehicle_id"], "inner", cfg.broadcast_rows, F.col("window_index"), cfg.salt_buckets)
    return driven.withColumns({
        "window_start": F.timestamp_micros(micros),
        "window_end": F.timestamp_micros(micros + int(WINDOW_SECONDS * 1e6)),
        "avg_speed_kmh": F.col("distance_km") / (F.col("duration_s") / 3600.0),
        "speed_std_kmh": F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - speed * speed)),
        "accel_events_per_km": F.col("_events") / F.col("distance_km"),
        "road_class": dominant,
        "traffic_severity": F.element_at(names, severity),
        "traffic_severity_ordinal": severity,
        "segment_distance_km": F.col("distance_km"),
        "hvac_load_kw": energy.hvac_kw_physics(F.col("outside_temperature_c")),
        TARGET: F.col("energy_kwh") / F.col("distance_km") * 100.0,
        "data_origin": F.lit("simulated"),
    }).withColumns({
        "road_class_ordinal": lookups.road_class_ordinal(F.col("road_class")),
        "is_motorway": (F.col("road_class") == "motorway").cast("int"),
    }).drop("_first", "_n", "_square", "_events", "_severity", "_driving", *(f"_class_{n}" for n in classes))


def finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def require_columns(df: DataFrame, columns: Sequence[str] = (*FEATURES, TARGET, "trip_id")) -> DataFrame:
    """The frame itself; a column missing from the contract is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_training_windows(spark: SparkSession, path: str) -> DataFrame:
    """Stored training windows; a missing table and missing columns are errors that say what to do."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"no training windows at {path}: write those of window_features or of the stream there first") from error
    return require_columns(rows, TRAINING_COLUMNS)


def feature_problems(df: DataFrame) -> DataFrame:
    """Per feature: how many values are NULL and how many are not finite."""
    counts = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("null_count"),
                       F.count_if(F.col(c).isNotNull() & ~finite(c)).alias("non_finite_count")) for c in FEATURES]
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


def project_features(df: DataFrame, check: bool = True) -> DataFrame:
    """The twenty inputs as doubles in model order; NULL or non-finite values are an error."""
    require_columns(df, FEATURES)
    if check:
        bad = feature_problems(df).where((F.col("null_count") > 0) | (F.col("non_finite_count") > 0)).collect()
        if bad:
            raise ValueError(f"unusable feature values: {', '.join(r.feature for r in bad)}")
    return df.select(*(F.col(c).cast("double").alias(c) for c in FEATURES))


def _rules() -> list[tuple[str, Column]]:
    """Drop rules in order: a row is charged to the first one it fails."""
    numeric = (*FEATURES, TARGET, "distance_km", "duration_s", "energy_kwh")
    all_set, all_finite = F.lit(True), F.lit(True)
    for c in numeric:
        all_set, all_finite = all_set & F.col(c).isNotNull(), all_finite & finite(c)
    target = F.col(TARGET)
    return [
        ("null_identifier", F.col("trip_id").isNotNull() & F.col("vehicle_code").isNotNull()),
        ("null_numeric", all_set), ("non_finite_numeric", all_finite),
        ("zero_or_negative_distance", F.col("distance_km") > 0), ("zero_or_negative_duration", F.col("duration_s") > 0),
        ("non_positive_target", target > 0), ("implausible_low_target", target >= 1.0), ("implausible_target", target <= 120.0),
        ("implausible_speed", F.col("speed_kmh").between(0.0, 250.0)), ("soc_out_of_range", F.col("soc_percent").between(0.0, 100.0)),
        ("implausible_temperature", F.col("outside_temperature_c").between(-40.0, 55.0) & F.col("battery_temperature_c").between(-40.0, 80.0)),
        ("negative_energy", F.col("energy_kwh") >= 0),
    ]


def judge_training_windows(df: DataFrame, order: str = "window_start") -> DataFrame:
    """Adds ``drop_rule``: the first rule a row fails, ``duplicate_window`` for a repeated window, NULL if kept."""
    failed = F.coalesce(*(F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)) for name, keep in _rules()))
    judged = df.withColumn("drop_rule", failed)
    kept = mark_duplicates(judged.where(F.col("drop_rule").isNull()), ["trip_id", "window_start"], order, "_again")
    kept = kept.withColumn("drop_rule", F.when(F.col("_again"), F.lit("duplicate_window"))).drop("_again")
    return kept.unionByName(judged.where(F.col("drop_rule").isNotNull()))


def clean_training_windows(df: DataFrame, order: str = "window_start") -> tuple[DataFrame, DataFrame]:
    """Rows worth training on, and how many each rule dropped."""
    judged = judge_training_windows(df, order)
    report = judged.groupBy(F.coalesce("drop_rule", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("rows"))
    return judged.where(F.col("drop_rule").isNull()).drop("drop_rule"), report


def grouped_split(df: DataFrame, key: str = "trip_id", ratios: Sequence[float] = SPLIT_RATIOS, seed: int = 42) -> DataFrame:
    """Adds ``fold``: whole groups go to train, validation or test by a seeded hash of the key.

    Placing each group by its own hash needs no global order, so it scales; the shares approach the
    ratios as the number of groups grows, and no group is ever in two folds.
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must add up to 1")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") / float(16**7)
    fold = F.when(place < ratios[0], "train").when(place < ratios[0] + ratios[1], "validation").otherwise("test")
    return df.withColumn("fold", fold)


def with_vector(df: DataFrame) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(doubles)


def train_energy_model(split: DataFrame, max_iter: int = 60, max_depth: int = 5, step: float = 0.1, seed: int = 42) -> Model:
    """Boosted trees on the train fold; the validation fold decides when to stop."""
    rows = with_vector(split.where(F.col("fold") != "test")).withColumn("_validation", F.col("fold") == "validation")
    learner = GBTRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="predicted", validationIndicatorCol="_validation",
        maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, subsamplingRate=0.85,
    )
    return learner.fit(rows)


def baseline_predictions(df: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``baseline``: the road-load model on the same rows, each window driven steadily."""
    profile = models.select(F.col("vehicle_model_code").alias("vehicle_code"), F.col("mass_kg").alias("_mass"),
                            F.col("drag_area_m2").alias("_area"), F.col("rolling_resistance").alias("_rolling"))
    joined = df.join(F.broadcast(profile), "vehicle_code")  # five fixed profiles
    steady = Drive.of(
        temperature_c=F.col("outside_temperature_c"), headwind_ms=F.lit(0.0), acceleration_ms2=F.lit(0.0),
        mass_kg=F.col("_mass"), drag_area_m2=F.col("_area"), rolling_resistance=F.col("_rolling"),
    )
    scored = with_segment_energy(joined, steady, "_b_")
    rate = energy.consumption_kwh_per_100km(F.col("_b_kwh"), F.col("distance_km"))
    return scored.withColumn("baseline", rate).select(*df.columns, "baseline")


def predict_batch(df: DataFrame, model: Model, models: DataFrame) -> DataFrame:
    """Model prediction with the physical baseline beside it."""
    return baseline_predictions(model.transform(with_vector(df)).drop("features"), models)


def prediction_log(scored: DataFrame, model_name: str) -> DataFrame:
    """Rows to append to the prediction log: inputs as JSON, prediction and baseline."""
    return scored.select(
        "trip_id", "window_start", F.lit(model_name).alias("model_name"), F.to_json(F.struct(*FEATURES)).alias("features"),
        F.col("predicted").alias("predicted_kwh_100km"), F.col("baseline").alias("baseline_kwh_100km"),
    )


def append_predictions(path: str, scored: DataFrame, model_name: str, call: str, served_at: datetime, context: Sequence[str] = ()) -> None:
    """Appends one call's predictions to the log at ``path``, a folder per call.

    Rows stay as they were answered, whatever comes later. A call that is repeated after a failure replaces its own rows only. ``context`` names columns of ``scored``
    that are kept as JSON; where ``scored`` has ``contributions`` they are logged too.
    """
    named = scored.withColumns({
        "_context": F.to_json(F.struct(*context)) if context else F.lit(None).cast("string"),
        "_parts": F.to_json("contributions") if "contributions" in scored.columns else F.lit(None).cast("string"),
        "_id": F.sha2(F.concat_ws("|", F.lit(call), F.coalesce("trip_id", F.lit("")), F.unix_micros("window_start").cast("string")), 256),
    })
    rows = named.select(
        F.col("_id").alias("prediction_id"), "trip_id", "window_start", F.lit(model_name).alias("model_name"), F.lit(served_at).alias("served_at"),
        F.to_json(F.struct(*FEATURES)).alias("features"), F.col("predicted").alias("predicted_kwh_100km"), F.col("baseline").alias("baseline_kwh_100km"),
        F.col("_parts").alias("contributions"), F.col("_context").alias("context"))
    rows.write.mode("overwrite").parquet(f"{path}/call={call}")


def logged_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The log with the call of each row."""
    return spark.read.option("mergeSchema", "false").parquet(path).withColumn("call", F.col("call").cast("string"))


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 (NaN without variance), from sums that combine on the map side."""
    y, error = F.col(label), F.col(prediction) - F.col(label)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"), F.var_pop(y).alias("_var"),
    )
    total = F.col("_var") * F.col("rows")
    r2 = F.when(total > 0, F.lit(1.0) - F.col("_sse") / total).otherwise(F.lit(float("nan")))
    return sums.withColumn("r2", r2).drop("_sse", "_var")


def residual_histogram(df: DataFrame, residual: Column, bins: int = 25) -> DataFrame:
    """Counts in bins symmetric about zero; empty bins are listed, NaN values are not counted."""
    values = df.select(residual.alias("_r")).where(~F.isnan("_r"))
    extent = values.agg(F.max(F.abs("_r"))).scalar()
    width = F.col("_extent") * (2.0 / bins)
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_r") + F.col("_extent")) / width)))
    counted = (
        values.withColumn("_extent", extent).groupBy(F.when(F.col("_extent") > 0, index).otherwise(F.lit(0)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("_extent", extent)
    return spine.join(counted, "bin", "left").select(
        "bin", (width * (F.col("bin") + 0.5) - F.col("_extent")).alias("bucket"), F.coalesce("count", F.lit(0)).alias("count"))


def residual_quantiles(df: DataFrame, residual: Column, keys: Sequence[str] = ()) -> DataFrame:
    values = df.select(*keys, residual.alias("_r"))
    spread = exact_percentiles(values, list(keys), F.col("_r"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}, few_groups=True)
    base = values.groupBy(*keys).agg(F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"))
    if keys:
        return base.join(spread, list(keys))
    return base.select("*", *(spread.select(c).scalar().alias(c) for c in ("p05", "p50", "p95")))


def gain_importance(model: Model, spark) -> DataFrame:
    """Normalised gain per feature; twenty values from the model itself."""
    gains = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(g)) for f, g in zip(FEATURES, gains)], "feature string, importance double")


def permutation_importance(
    df: DataFrame, model: Model, row_id: str, features: Sequence[str] = FEATURES, seed: int = 42, repeats: int = 5, rows_per_bucket: int = 2000
) -> DataFrame:
    """Rise of the mean absolute error when one feature's values are shuffled between rows, over several shuffles.

    Rows are dealt into random buckets of bounded size and a feature is permuted inside each, which needs no global order.
    All features of one shuffle are scored in one pass: a row appears once per feature with that feature's value replaced.
    """
    count, base = df.count(), model.transform(with_vector(df)).agg(F.avg(F.abs(F.col("predicted") - F.col(TARGET)))).scalar()
    spread = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(max(1, count // rows_per_bucket)))
    rows = df.select(row_id, F.col(TARGET), *FEATURES, spread.alias("_bucket"))
    inside, out = W.partitionBy("_bucket"), None
    for repeat in range(repeats):
        dealt = rows.withColumns({
            "_n": F.row_number().over(inside.orderBy(row_id)),
            "_m": F.row_number().over(inside.orderBy(F.xxhash64(F.lit(seed + 1 + repeat), row_id), row_id)),
        })
        donor = dealt.select("_bucket", F.col("_m").alias("_n"), F.struct(*features).alias("_other"))
        each = dealt.join(donor, ["_bucket", "_n"]).withColumn("_feature", F.explode(F.array(*map(F.lit, features))))
        swapped = each.withColumns({f: F.when(F.col("_feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in features})
        part = model.transform(with_vector(swapped)).groupBy(F.col("_feature").alias("feature")).agg(
            F.avg(F.abs(F.col("predicted") - F.col(TARGET))).alias("mae"))
        out = part if out is None else out.unionByName(part)
    rise = out.groupBy("feature").agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("std")).withColumn("importance", F.col("mae") - base)
    total = F.sum(F.greatest("importance", F.lit(0.0))).over(W.partitionBy(F.lit(0)))  # a row per feature
    return rise.withColumns({"importance_normalised": F.when(total > 0, F.greatest("importance", F.lit(0.0)) / total).otherwise(F.lit(0.0)), "method": F.lit("permutation")})


def features_from_conditions(
    driven: DataFrame, soc: Column | None = None, keep: Sequence[str] = ("route_segment_id", "vehicle_model_id")
) -> DataFrame:
    """The twenty inputs for analysed segments; what a segment does not tell gets its neutral value."""
    speed = F.greatest(F.lit(0.0), F.col("speed_kmh"))
    values = {
        "speed_kmh": speed, "avg_speed_kmh": speed, "speed_std_kmh": F.lit(0.0), "acceleration_abs_mean_ms2": F.lit(0.0),
        "accel_events_per_km": F.lit(0.0), "outside_temperature_c": F.col("temperature_c"), "battery_temperature_c": F.col("temperature_c"),
        "soc_percent": soc if soc is not None else F.lit(DEFAULT_SOC),
        "road_class_ordinal": lookups.road_class_ordinal(F.col("road_class")).cast("double"),
        "speed_limit_kmh": F.coalesce(F.col("speed_limit_kmh"), default_speed(F.col("road_class"))),
        "traffic_severity_ordinal": lookups.severity_ordinal(F.col("traffic_severity")).cast("double"),
        "precipitation_mm": F.greatest(F.lit(0.0), F.col("precipitation_mm")),
        "wind_speed_ms": F.greatest(F.lit(0.0), F.col("wind_speed_ms")), "gradient_percent": F.lit(0.0),
        "segment_distance_km": F.col("distance_km"), "mass_kg": F.col("mass_kg"), "drag_area": F.col("drag_area_m2"),
        "nominal_consumption_kwh_100km": F.col("nominal_consumption_kwh_100km"),
        "hvac_load_kw": energy.hvac_kw_physics(F.col("temperature_c")),
        "is_motorway": (F.col("road_class") == "motorway").cast("double"),
    }
    return driven.select(*keep, *(values[f].alias(f) for f in FEATURES))
