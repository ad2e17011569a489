"""Plans on small literal tables: charging plans against a plain search, gap tiling, learning helpers, lake writes."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strom.functions.energy import SOC_TAPER
from strom.plans import chargeplan, corridors, learning, staging
from strom.sources import lake, reference


def minutes_to_charge(model, a, b, kw):
    steps = max(1, math.ceil((b - a) / 0.25))
    step = (b - a) / steps
    total = 0.0
    for i in range(steps):
        vehicle = max(1.0, model["dc"] * float(np.interp(a + (i + 0.5) * step, *zip(*SOC_TAPER))))
        total += model["usable"] * step / 100.0 / min(kw, vehicle) * 60.0
    return total


def plain_plan(model, segments, sites, start):
    """Beam search over one request, written out in loops."""
    route_km = segments[-1][0] + segments[-1][1]

    def energy(a, b):
        return sum(k * max(0.0, min(b, s + d) - max(a, s)) / d for s, d, k, _ in segments)

    def percent(kwh):
        return kwh / model["usable"] * 100.0

    drive = sum(t for *_, t in segments) / 60.0

    def finish(s):
        arrival = s["soc"] - percent(energy(s["km"], route_km))
        if arrival < 10.0 - 1e-6:
            return None
        return drive + s["charge"] + 2 * s["detour"] + s["risk"] + max(0.0, 15.0 - arrival) * 2.0, arrival

    first = {"km": 0.0, "soc": start, "charge": 0.0, "detour": 0.0, "risk": 0.0, "stops": (), "targets": ()}
    plans = [(finish(first), first)]
    beam = [first]
    for _ in range(3):
        grown = []
        for s in beam:
            for name, km, detour, kw in sites:
                if name in s["stops"] or km <= s["km"] + 5.0:
                    continue
                arrival = s["soc"] - percent(energy(s["km"], km)) - percent(detour * model["nominal"] / 100.0)
                if arrival < 10.0 - 1e-6:
                    continue
                needed = percent(energy(km, route_km)) + 10.0
                for target in sorted({round(v, 6) for v in (60.0, 70.0, 80.0, 90.0, needed) if arrival + 2.0 <= v <= 100.0}):
                    grown.append({"km": km, "soc": target, "charge": s["charge"] + minutes_to_charge(model, arrival, target, kw), "detour": s["detour"] + detour,
                                  "risk": s["risk"] + max(0.0, 15.0 - arrival) * 2.0, "stops": (*s["stops"], name), "targets": (*s["targets"], target)})
        plans += [(finish(s), s) for s in grown]

        def score(s):
            missing = max(0.0, energy(s["km"], route_km) - (s["soc"] - 10.0) / 100.0 * model["usable"])
            return round(s["charge"] + 2 * s["detour"] + s["risk"] + missing / (model["dc"] * 0.6) * 60.0, 6), s["stops"], s["targets"]

        beam = sorted(grown, key=score)[:8]
    done = [(f, s) for f, s in plans if f is not None]
    return min(done, key=lambda p: (round(p[0][0], 6), len(p[1]["stops"]), p[1]["stops"], p[1]["targets"])) if done else None


def test_charging_plans_match_a_plain_search(spark):
    models = staging.vehicle_models(reference.vehicle_models(spark))
    m = next(r for r in reference.VEHICLE_MODELS if r[0] == "vm-0")
    model = {"usable": m[5], "nominal": m[6], "dc": m[7]}
    segments = [(i * 10.0, 10.0, 1.8 + (i % 4) * 0.3, 360.0 + i) for i in range(45)]
    sites = [("a", 40.0, 1.0, 150.0), ("b", 95.0, 0.5, 50.0), ("c", 140.0, 2.0, 300.0), ("d", 210.0, 0.2, 150.0), ("e", 260.0, 3.0, 22.0), ("f", 333.0, 1.0, 300.0)]
    starts = [95.0, 80.0, 55.0, 30.0, 12.0]
    requests = spark.createDataFrame([(i, "R", "vm-0", s) for i, s in enumerate(starts)] + [(9, "empty", "vm-0", 50.0)],
                                     "request_id long, route_id string, vehicle_model_id string, start_soc_percent double")
    seg = spark.createDataFrame([(r, "vm-0", *s) for r in ("R", "empty") for s in segments],
                                "route_id string, vehicle_model_id string, start_km double, distance_km double, kwh double, duration_s double")
    cand = spark.createDataFrame([("R", n, km, d, kw, d * 500) for n, km, d, kw in sites],
                                 "route_id string, station_id string, offset_km double, detour_km double, max_power_kw double, lateral_m double")
    got = {r.request_id: r for r in chargeplan.plan_charging(requests, seg, cand, models).collect()}
    assert got[9].reason == "no_station" and not got[9].feasible
    for i, start in enumerate(starts):
        want = plain_plan(model, segments, sites, start)
        assert got[i].feasible == (want is not None), start
        if want is None:
            assert got[i].reason in ("first_station_out_of_reach", "gaps_too_large")
            continue
        (objective, arrival), state = want
        assert got[i].stops == ",".join(state["stops"]) and got[i].objective_value == pytest.approx(objective, abs=1e-5)
        assert got[i].arrival_soc_percent == pytest.approx(arrival, abs=1e-5)
    assert any(got[i].stop_count >= 2 for i in range(5))


def test_thinning_keeps_the_strongest_per_stretch(spark):
    cand = spark.createDataFrame([("R", "a", 1.0, 50.0, 9.0), ("R", "b", 9.0, 150.0, 90.0), ("R", "c", 9.5, 150.0, 10.0), ("R", "d", 11.0, 22.0, 1.0)],
                                 "route_id string, station_id string, offset_km double, max_power_kw double, lateral_m double")
    assert {r.station_id for r in chargeplan.thin_candidates(cand, ["route_id"]).collect()} == {"c", "d"}
    assert {r.station_id for r in chargeplan.thin_candidates(cand, ["route_id"], cap=1).collect()} == {"c"}


def test_gaps_tile_every_route(spark):
    routes = spark.createDataFrame([("A", 100.0), ("B", 50.0), ("C", 10.0)], "route_id string, km double")
    sites = spark.createDataFrame([("A", f"s{i}", float(k)) for i, k in enumerate([0, 3, 3, 60, 99.5])] + [("C", "z", 10.0)], "route_id string, station_id string, at double")
    gaps = corridors.gaps_along(sites, routes, "at", "km", 25.0).collect()
    total = {}
    for g in gaps:
        total[g.route_id] = total.get(g.route_id, 0.0) + g.gap
    assert total == {"A": pytest.approx(100.0), "B": 50.0, "C": 10.0}
    assert [g.gap_kind for g in gaps if g.route_id == "B"] == ["whole_route"]
    assert sorted(g.gap_kind for g in gaps if g.route_id == "C") == ["destination", "origin"]


def test_training_rows_are_charged_to_their_first_broken_rule(spark):
    base = {f: 1.0 for f in learning.FEATURES} | {learning.TARGET: 20.0, "distance_km": 1.0, "duration_s": 60.0, "energy_kwh": 0.2, "trip_id": "t", "vehicle_code": "v", "window_start": 0}
    changes = [{}, {}, {"trip_id": None, "speed_kmh": None}, {"speed_kmh": None}, {"speed_kmh": float("nan")}, {"distance_km": 0.0, learning.TARGET: -1.0},
               {learning.TARGET: 0.5}, {learning.TARGET: 130.0}, {"soc_percent": 101.0}, {"energy_kwh": -1.0}]
    rows = [base | {"n": i} | c for i, c in enumerate(changes)]
    schema = ", ".join(f"{k} {'string' if k in ('trip_id', 'vehicle_code') else 'long' if k in ('window_start', 'n') else 'double'}" for k in rows[0])
    df = spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], schema)
    got = {r.n: r.drop_rule for r in learning.judge_training_windows(df, "n").collect()}
    assert got == {0: None, 1: "duplicate_window", 2: "null_identifier", 3: "null_numeric", 4: "non_finite_numeric", 5: "zero_or_negative_distance",
                   6: "implausible_low_target", 7: "implausible_target", 8: "soc_out_of_range", 9: "negative_energy"}
    kept, report = learning.clean_training_windows(df, "n")
    assert kept.count() == 1 and {r.rule: r.rows for r in report.collect()}["kept"] == 1
    with pytest.raises(ValueError):
        learning.project_features(df)
    with pytest.raises(ValueError):
        learning.require_columns(df.drop("mass_kg"))


def test_split_keeps_groups_whole_and_near_the_ratios(spark):
    df = spark.range(60_000).select((F.col("id") % 4000).cast("string").alias("trip_id"))
    split = learning.grouped_split(df)
    assert split.groupBy("trip_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    share = {r.fold: r["count"] / 60_000 for r in split.groupBy("fold").count().collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.03) and share["test"] == pytest.approx(0.15, abs=0.03)


def test_metrics_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    row = learning.regression_metrics(df, "y", "p").first()
    assert row.mae == 1.0 and row.rmse == 1.0 and math.isnan(row.r2)


def test_lake_partition_rewrite_is_idempotent(spark, tmp_path):
    df, root = spark.range(10), str(tmp_path)
    for day, rows in ((dt.date(2024, 1, 1), df), (dt.date(2024, 1, 2), df), (dt.date(2024, 1, 1), df.limit(4))):
        assert lake.write_partition(rows, root, "silver", "x", day)
    assert not lake.write_partition(df.where("id < 0"), root, "silver", "x", dt.date(2024, 1, 2))
    counts = {str(r.dt): r["count"] for r in lake.read_lake(spark, root, "silver", "x").groupBy("dt").count().collect()}
    assert counts == {"2024-01-01": 4, "2024-01-02": 10}
