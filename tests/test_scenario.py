import math

import pytest
from pyspark.sql import functions as F

from freshet import constants as k
from freshet.functions.scorers import heuristic_score, linear_score
from freshet.operators import logs, planner, scenario, validation

c = F.col
REQUEST = ("id int, district string, model_version string, target_risk_level string, budget_profile string, "
           "max_steps int, allowed_features array<string>")
KEEP = ["id", "model_version", "target_risk_level", "budget_profile", "max_steps", "allowed_features"]


def rows_of(spark, requests):
    return scenario.scenario_rows(spark.createDataFrame(requests, REQUEST), KEEP)


def baseline(district):
    return dict(zip(k.NUMERIC_INPUTS, map(float, k.DISTRICT_DEFAULTS.get(district, k.GENERIC_DEFAULTS))))


def linear(x, version=None):
    s = (0.90 - x["drainage_index"] * 0.20 - x["infrastructure_score"] * 0.15 + x["nearest_evac_km"] * 0.01
         + x["nearest_hospital_km"] * 0.005 - x["distance_to_river_m"] * 0.00002 + x["built_up_percent"] * 0.001)
    return max(0.0, min(1.0, s))


def heuristic(x, version):
    s = 0.40 + (x["rainfall_7d_mm"] - 50) / 1500 * 0.15 - (x["drainage_index"] - 0.5) * 0.12
    s -= min((x["elevation_m"] - 30) / 500, 0.1) * 0.08
    s -= min((x["distance_to_river_m"] - 500) / 5000, 0.1) * 0.06
    s -= (x["infrastructure_score"] - 0.5) * 0.08
    s += (x["historical_flood_count"] - 2) * 0.02 + (x["extreme_weather_index"] - 0.3) * 0.10
    s += max((x["nearest_hospital_km"] - 5) / 50, 0) * 0.04
    return max(0.0, min(1.0, s * k.VERSION_FACTORS.get(version, 1.0)))


def brute_force(x, score, version, target, profile, steps, allowed):
    """Tries every change one after the other, as a person would on paper."""
    goal = k.LEVEL_THRESHOLDS[target]
    x, now = dict(x), score(x, version)
    taken, tried, stalled = [], 0, False
    for _ in range(max(1, min(steps, 5))):
        if now < goal:
            break
        best = None
        for name, _, _, aim, rising, _, cost, cheap, _ in k.ACTIONS:
            if name in [t[0] for t in taken] or (allowed is not None and name not in allowed):
                continue
            here = x[name]
            if (here >= aim) if rising else (here <= aim):
                continue
            for f in k.PROFILE_FRACTIONS[profile]:
                value = math.floor((here + (aim - here) * f) * 1e6 + 0.5) / 1e6
                tried += 1
                after = score({**x, name: value}, version)
                gain = now - after
                if gain <= 1e-9:
                    continue
                use = {"aggressive": gain, "balanced": gain / math.sqrt(cost),
                       "low_cost": gain * (1.35 if cheap else 0.75) / cost}[profile]
                option = (-use, -gain, cost, name, value, after)
                if best is None or option < best:
                    best = option
        if best is None:
            stalled = True
            break
        x[best[3]], now = best[4], best[5]
        taken.append((best[3], best[4]))
    return taken, now, tried, stalled


CASES = [
    (i, d, v, t, p, s, a)
    for i, (d, v, t, p, s, a) in enumerate(
        [(d, v, t, p, s, None) for d in ("Colombo", "Kandy", "Ratnapura", "Atlantis")
         for v, t, p, s in (("v13", "Low", "balanced", 3), (k.MODEL_VERSIONS[1], "Low", "low_cost", 5),
                            (k.MODEL_VERSIONS[2], "Medium", "aggressive", 9), ("v13", "Critical", "balanced", 2))]
        + [("Colombo", "v13", "Low", "aggressive", 5, ["not_a_feature", "drainage_index"]),
           ("Colombo", "v13", "Low", "balanced", 0, None), ("Colombo", "v13", "Low", "balanced", 3, [])]
    )
]


@pytest.mark.parametrize("scorer,by_hand", [(linear_score, linear), (heuristic_score, heuristic)])
def test_plans_equal_brute_force(spark, scorer, by_hand):
    plans = {r["id"]: r for r in planner.plan(rows_of(spark, CASES), ["id"], scorer).collect()}
    for case in CASES:
        i, district, version, target, profile, steps, allowed = case
        taken, after, tried, stalled = brute_force(
            baseline(district), by_hand, version, target, profile, steps, allowed)
        got = plans[i]
        assert [(s.feature, s.to_value) for s in got.recommended_plan] == [
            (n, math.floor(v * 1e4 + 0.5) / 1e4) for n, v in taken], case
        assert got.optimized_score == pytest.approx(after, abs=5.1e-5)
        assert len(got.search_trace) == tried
        assert sum(t.accepted for t in got.search_trace) == len(taken)
        assert got.target_reached == (after < k.LEVEL_THRESHOLDS[target])
        assert len(got.alternatives) <= 3
        told = any(a.name == k.STALL_TEXT for a in got.alternatives)
        assert told == (stalled and not got.target_reached)


def test_plan_columns_and_limits(spark):
    plans = planner.plan(rows_of(spark, CASES), ["id"], linear_score)
    assert set(plans.columns) == {
        "id", "district", "model_version", "baseline_score", "baseline_risk_level", "target_risk_level",
        "target_score_threshold", "target_reached", "optimized_score", "optimized_risk_level",
        "risk_reduction_pct", "recommended_plan", "search_trace", "alternatives"}
    only = planner.exploded(plans, "search_trace", ["id"]).where("id = 16").collect()
    assert {r["tried_feature"] for r in only} == {"drainage_index"}
    for r in plans.collect():
        scores = [s.score_before for s in r.recommended_plan] + [r.optimized_score]
        assert scores == sorted(scores, reverse=True)
        signatures = [tuple(s.feature for s in a.steps) for a in r.alternatives if a.name != k.STALL_TEXT]
        assert len(signatures) == len(set(signatures))


def test_planning_is_a_projection(spark):
    plans = planner.plan(rows_of(spark, CASES), ["id"]).where("target_reached")
    physical = plans._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and "Join" not in physical
    assert physical.count("aggregate(") == 1


def test_bad_requests_are_named_and_do_not_end_the_job(spark):
    rows = rows_of(spark, CASES).withColumn("target_risk_level", F.when(F.col("id") == CASES[0][0], "Lowish").otherwise(F.col("target_risk_level")))
    rows = rows.withColumn("budget_profile", F.when(F.col("id") == CASES[1][0], "cheap").otherwise(F.col("budget_profile")))
    assert planner.plan(rows, ["id"]).count() == rows.count()
    good, bad = planner.split_requests(rows)
    assert good.count() == rows.count() - 2
    assert {r.id: r.violations for r in bad.collect()} == {
        CASES[0][0]: ["unsupported target_risk_level Lowish"], CASES[1][0]: ["unsupported budget_profile cheap"],
    }


def test_overrides_win_over_defaults(spark):
    df = spark.createDataFrame([(1, "Kandy", 10.0), (2, "Kandy", None), (3, "X", None)],
                               "id int, district string, elevation_m double")
    rows = scenario.scenario_rows(df, ["id"]).orderBy("id").collect()
    assert [r["elevation_m"] for r in rows] == [10.0, 500.0, 30.0]
    assert rows[2]["rainfall_7d_mm"] == 50.0 and rows[0]["place_name"] == "Unknown"


def test_sweep_by_hand(spark):
    rows = rows_of(spark, CASES[:1])
    swept = scenario.sweep(rows, ["id"]).collect()
    assert len(swept) == len(k.SWEEP_FEATURES)
    for r in swept:
        low, high = next((lo, hi) for n, _, _, lo, hi, _ in k.SWEEP_FEATURES if n == r["feature"])
        assert r["values"][0] == low and r["values"][-1] == high and len(r["scores"]) == 10
        for i, score in enumerate(r["scores"]):
            x = {**baseline("Colombo"), r["feature"]: low + (high - low) / 9 * i}
            assert score == pytest.approx(heuristic(x, "v13"), abs=5.1e-5)


def test_interventions_by_hand(spark):
    got = scenario.interventions(rows_of(spark, CASES[:1]), ["id"]).orderBy("position").collect()
    assert [r["position"] for r in got] == [1, 2, 3, 4, 5]
    falls = [r["risk_reduction_pct"] for r in got]
    assert falls == sorted(falls, reverse=True)
    base = heuristic(baseline("Colombo"), "v13")
    for r in got:
        better = next(b for n, *_, b in k.SWEEP_FEATURES if n == r["feature"])
        after = heuristic({**baseline("Colombo"), r["feature"]: better}, "v13")
        assert r["risk_reduction_pct"] == pytest.approx((base - after) / base * 100, abs=0.0051)


def test_compare_directions(spark):
    a = rows_of(spark, CASES[:1])
    b = a.withColumn("drainage_index", F.lit(0.9)).withColumn("ndvi", F.lit(0.5)).withColumn(
        "rainfall_7d_mm", c("rainfall_7d_mm") + 500).withColumn("ndwi", c("ndwi") + 0.0005)
    compared = scenario.compare(a, b, "id")
    row = compared.first()
    assert row["risk_improvement"] == ("improved" if row["score_delta"] < -0.005 else
                                       "worsened" if row["score_delta"] > 0.005 else "unchanged")
    changes = scenario.feature_changes(compared, "id").orderBy("position").collect()
    assert [r["feature"] for r in changes] == ["rainfall_7d_mm", "drainage_index", "ndvi"]
    worse = "negative" if row["score_b"] > row["score_a"] else "positive"
    assert [r["impact_direction"] for r in changes] == [worse, "positive", worse]


def test_overview_order(spark):
    requests = [(i, d, "v13", "Low", "balanced", 1, None) for i, d in enumerate(k.DISTRICTS)]
    overview = scenario.district_overview(scenario.simulate(rows_of(spark, requests))).orderBy("position").collect()
    assert len(overview) == 25
    scores = [r["flood_risk_score"] for r in overview]
    assert scores == sorted(scores, reverse=True)
    plain = [r["district"] for r in overview if r["district"] not in k.DISTRICT_DEFAULTS]
    assert plain == [d for d in k.DISTRICTS if d not in k.DISTRICT_DEFAULTS]  # equal scores: listing order


REQUEST_CASES = [
    ({}, True), ({"rainfall_7d_mm": 120.0, "drainage_index": 0.35, "district": "Ratnapura"}, True),
    ({"rainfall_7d_mm": -10.0}, False), ({"rainfall_7d_mm": -999.0}, False), ({"rainfall_7d_mm": 2000.0}, False),
    ({"drainage_index": 1.5}, False), ({"drainage_index": -0.1}, False), ({"district": "Atlantis"}, False),
    ({"model_version": "v999"}, False), ({"elevation_m": -5.0}, True), ({"elevation_m": -20.0}, False),
    ({"rainfall_7d_mm": 0.0}, True), ({"rainfall_7d_mm": 1500.0}, True),
] + [({"model_version": v}, True) for v in k.MODEL_VERSIONS]


def test_requests_are_accepted_or_quarantined(spark):
    fields = {"district": "string", "model_version": "string", "rainfall_7d_mm": "double",
              "drainage_index": "double", "elevation_m": "double"}
    data = [tuple([i, *[changes.get(n) for n in fields]]) for i, (changes, _) in enumerate(REQUEST_CASES)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{n} {t}" for n, t in fields.items()))
    checked = validation.with_violations(validation.with_defaults(df))
    good = {r["id"] for r in validation.accepted(checked).collect()}
    bad = {r["id"] for r in validation.quarantined(checked).collect()}
    assert good == {i for i, (_, ok) in enumerate(REQUEST_CASES) if ok}
    assert good | bad == set(range(len(REQUEST_CASES))) and not good & bad
    counts = {r["rule"]: r["rows"] for r in validation.violation_counts(checked).collect()}
    assert counts == {"rainfall_7d_mm>=0": 2, "rainfall_7d_mm<=1500": 1, "drainage_index<=1": 1,
                      "drainage_index>=0": 1, "district in list": 1, "model_version in list": 1, "elevation_m>=-10": 1}


def test_empty_log(spark, folder):
    from freshet.sources.tables import simulation_log

    totals = logs.summary(simulation_log(spark, folder).limit(0))
    row = totals.first()
    assert (row["total_simulations"], row["avg_latency_ms"], row["avg_risk_score"]) == (0, 0.0, 0.0)
    assert [r["rows"] for r in logs.histogram(totals).collect()] == [0, 0, 0, 0]
    assert {r["uses"] for r in logs.usage(totals).collect()} == {0}


def test_routes(spark):
    rows = rows_of(spark, CASES[:4])
    fitted = lambda df: df.withColumn("flood_risk_score", F.lit(0.77))
    out = scenario.score_by_route(rows, {"v13": fitted}).collect()
    assert len(out) == 4
    assert {r["route"] for r in out if r["model_version"] == "v13"} == {"model"}
    assert {r["route"] for r in out if r["model_version"] != "v13"} == {"heuristic"}
