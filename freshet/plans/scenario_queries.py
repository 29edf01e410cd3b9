"""Scenario analytics: validation, scoring, sweeps, comparison and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.constants import (
    ACTIONS, FEATURE_LABELS, GOOD_WHEN_FALLING, GOOD_WHEN_RISING, NUMERIC_BOUNDS, NUMERIC_INPUTS,
    PROFILE_FRACTIONS, STALL_TEXT, SWEEP_FEATURES, VOCABULARIES,
)
from freshet.functions.scorers import linear_combination
from freshet.operators import planner, scenario, validation
from freshet.operators.ordering import slices
from freshet.plans.common import (
    array_text, heuristic_sql, level_sql, over_obs, over_scenarios, rnd, sql, tidy, tidy_sql,
)
from freshet.sources.tables import observations, requests

c = F.col
QUERIES, ORACLES = {}, {}
KEEP = ["number", "model_version"]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


def scenarios(spark, folder, keep=KEEP):
    return scenario.scenario_rows(requests(spark, folder), keep)


def spread_scenarios(spark, folder, keep=KEEP):
    """Scenario rows dealt out evenly: sweeps and plans cost time per row, not bytes."""
    rows = scenarios(spark, folder, keep)
    return rows.repartition(slices(rows), "number")


# Validation of observations as if they were requests.

CHECKED = [n for n, _, _ in NUMERIC_BOUNDS if n not in ("is_synthetic",)]
WORDS = [n for n in VOCABULARIES if n != "model_version"]


def broken_sql() -> list[str]:
    out = []
    for n, low, high in NUMERIC_BOUNDS:
        if n in CHECKED:
            out.append(f"CASE WHEN {n} < {low} THEN '{n}>={low}' END")
            if high is not None:
                out.append(f"CASE WHEN {n} > {high} THEN '{n}<={high}' END")
    out += [f"CASE WHEN NOT list_contains({array_text(VOCABULARIES[n])}, {n}) THEN '{n} in list' END" for n in WORDS]
    return out


VIOLATIONS = f"list_filter([{', '.join(broken_sql())}], lambda x: x IS NOT NULL)"


def checked(spark, folder):
    obs = observations(spark, folder)
    return validation.with_violations(obs.select("record_id", *CHECKED, *WORDS))


@query("validation_rows", sql(over_obs(
    f"SELECT record_id, len(v) = 0 AS accepted, array_to_string(v, ',') AS violations"
    f" FROM (SELECT record_id, {VIOLATIONS} AS v FROM obs)")))
def validation_rows(spark, folder):
    """Each row with the rules it breaks, accepted and quarantined rows together."""
    rows = checked(spark, folder)
    shown = lambda df, ok: df.select(
        "record_id", F.lit(ok).alias("accepted"), F.array_join("violations", ",").alias("violations")
    )
    return shown(validation.accepted(rows), True).unionByName(shown(validation.quarantined(rows), False))


@query("violation_counts", sql(over_obs(
    f"SELECT rule, count(*) AS \"rows\" FROM (SELECT unnest({VIOLATIONS}) AS rule FROM obs) GROUP BY rule")))
def violation_counts(spark, folder):
    return validation.violation_counts(checked(spark, folder))


@query("request_defaults", tidy_sql(over_scenarios("""
SELECT number, model_version, coalesce(rainfall_7d_mm, 50) AS rainfall_7d_mm, coalesce(drainage_index, 0.5) AS drainage_index,
  coalesce(elevation_m, 30) AS elevation_m, coalesce(nearest_evac_km, 3) AS nearest_evac_km FROM requests"""),
    ["rainfall_7d_mm", "drainage_index", "elevation_m", "nearest_evac_km"]))
def request_defaults(spark, folder):
    filled = validation.with_defaults(requests(spark, folder))
    return tidy(filled.select("number", "model_version", "rainfall_7d_mm", "drainage_index", "elevation_m", "nearest_evac_km"))


# Scenario rows and scores.

@query("scenario_rows", tidy_sql(over_scenarios(
    f"SELECT number, district, 'Urban' AS landcover, '2024-06-15' AS generation_date, {', '.join(NUMERIC_INPUTS)} FROM scen"),
    NUMERIC_INPUTS))
def scenario_rows(spark, folder):
    rows = scenarios(spark, folder)
    return tidy(rows.select("number", "district", "landcover", "generation_date", *NUMERIC_INPUTS))


@query("district_default_rows", tidy_sql(over_scenarios(
    f"SELECT r.district, r.n AS requests, {', '.join(f'coalesce(d_{n}, {float(g)!r}) AS {n}' for n, g in zip(NUMERIC_INPUTS, (50.0, 200.0, 30.0, 500.0, 0.45, 0.50, 6.0, 4.0, 30.0, 500.0, 0.30, 0.10, 0.30, 0.50, 0.20, 0.50, 2, 1000.0)))}"
    " FROM (SELECT district, count(*) AS n FROM requests GROUP BY district) r LEFT JOIN defaults ON d_district = r.district"),
    NUMERIC_INPUTS))
def district_default_rows(spark, folder):
    """Defaults of the districts that were asked for."""
    asked = requests(spark, folder).groupBy("district").agg(F.count(F.lit(1)).alias("requests"))
    return tidy(scenario.district_defaults(asked).join(asked, "district"))


SIMULATED = f"(SELECT *, {heuristic_sql()} AS score FROM scen)"


@query("simulate", tidy_sql(over_scenarios(
    f"SELECT number, model_version, score AS flood_risk_score, {level_sql('score')} AS risk_level FROM {SIMULATED}"),
    ["flood_risk_score"]))
def simulate(spark, folder):
    scored = scenario.simulate(scenarios(spark, folder))
    return tidy(scored.select("number", "model_version", "flood_risk_score", "risk_level"))


@query("score_routes", tidy_sql(over_scenarios(
    f"SELECT number, model_version, score AS flood_risk_score, {level_sql('score')} AS risk_level,"
    " CASE WHEN model_version = 'v13' THEN 'model' ELSE 'heuristic' END AS route FROM (SELECT number, model_version,"
    f" CASE WHEN model_version = 'v13' THEN least(greatest(0.3 + rainfall_7d_mm * 0.002 + drainage_index * -0.1, 0), 1)"
    f" ELSE {heuristic_sql()} END AS score FROM scen)"), ["flood_risk_score"]))
def score_routes(spark, folder):
    """Versions with a fitted model use it, the others the heuristic."""
    fitted = linear_combination({"rainfall_7d_mm": 0.002, "drainage_index": -0.1}, 0.3)

    def route(rows):
        return rows.withColumn(
            "flood_risk_score", F.least(F.greatest(F.expr(fitted(lambda n: n)), F.lit(0.0)), F.lit(1.0))
        )

    scored = scenario.score_by_route(scenarios(spark, folder), {"v13": route})
    return tidy(scored.select("number", "model_version", "flood_risk_score", "risk_level", "route"))


OVERVIEW_SQL = f"""
SELECT district, "rows", {rnd('s', 4)} AS flood_risk_score, {level_sql('s')} AS risk_level,
  CAST(row_number() OVER (ORDER BY {rnd('s', 4)} DESC,
    coalesce(nullif(list_position({array_text(VOCABULARIES['district'])}, district), 0), 26), district) AS INT) AS position,
  rainfall_7d_mm, drainage_index, elevation_m, historical_flood_count, infrastructure_score
FROM (SELECT district, count(*) AS "rows", avg(score) AS s, avg(rainfall_7d_mm) AS rainfall_7d_mm,
  avg(drainage_index) AS drainage_index, avg(elevation_m) AS elevation_m,
  avg(historical_flood_count) AS historical_flood_count, avg(infrastructure_score) AS infrastructure_score
  FROM {SIMULATED} GROUP BY district)"""
FACTORS = ["rainfall_7d_mm", "drainage_index", "elevation_m", "historical_flood_count", "infrastructure_score"]


def overview(spark, folder):
    return scenario.district_overview(scenario.simulate(scenarios(spark, folder)))


@query("district_overview", tidy_sql(over_scenarios(OVERVIEW_SQL), FACTORS))
def district_overview(spark, folder):
    return tidy(overview(spark, folder), columns=FACTORS)


@query("district_extremes", sql(over_scenarios(f"""
SELECT arg_min(district, position) AS highest_risk, arg_max(district, position) AS lowest_risk,
  {rnd('avg(flood_risk_score)', 4)} AS avg_risk_score FROM ({OVERVIEW_SQL})""")))
def district_extremes(spark, folder):
    return scenario.overview_totals(overview(spark, folder))


@query("risk_level_counts", sql(over_scenarios(
    f"SELECT risk_level, count(*) AS districts FROM ({OVERVIEW_SQL}) GROUP BY risk_level")))
def risk_level_counts(spark, folder):
    return scenario.level_counts(overview(spark, folder))


SWEEP_VALUES = ", ".join(
    f"({i}, '{n}', '{l}', '{cat}', {lo!r}, {hi!r}, {'NULL' if better is None else repr(better)})"
    for i, (n, l, cat, lo, hi, better) in enumerate(SWEEP_FEATURES))
SWEEP_CTE = f", grid(ord, feature, label, category, low, high, better) AS (VALUES {SWEEP_VALUES})"
SWEPT = {n: f"CASE WHEN feature = '{n}' THEN v ELSE {n} END" for n, *_ in SWEEP_FEATURES}


@query("sensitivity_sweep", sql(over_scenarios(f"""
SELECT number, model_version, feature, label, i AS point, {rnd('v', 2)} AS value, {rnd(heuristic_sql(**SWEPT), 4)} AS score
FROM (SELECT scen.*, feature, label, i,
  CAST(low AS DOUBLE) + (CAST(high AS DOUBLE) - CAST(low AS DOUBLE)) / 9.0 * i AS v
  FROM scen, grid, (SELECT CAST(unnest(range(10)) AS INT) AS i))""", SWEEP_CTE)))
def sensitivity_sweep(spark, folder):
    """Ten values of each of seven features per scenario."""
    return scenario.sweep_points(spread_scenarios(spark, folder), KEEP)


IMPROVED = {n: f"CASE WHEN feature = '{n}' THEN CAST(better AS DOUBLE) ELSE {n} END" for n, *_ in SWEEP_FEATURES}
CURRENT = "CASE feature " + " ".join(f"WHEN '{n}' THEN {n}" for n, *_ in SWEEP_FEATURES) + " END"


@query("interventions", sql(over_scenarios(f"""
SELECT number, model_version, CAST(row_number() OVER (PARTITION BY number ORDER BY pct DESC, ord) AS INT) AS position,
  feature, label AS feature_label, category, {rnd('cur', 4)} AS current_value,
  {rnd('CAST(better AS DOUBLE)', 4)} AS improved_value, {rnd('base', 4)} AS baseline_score,
  {rnd('after', 4)} AS improved_score, pct AS risk_reduction_pct
FROM (SELECT *, CASE WHEN base > 0 THEN {rnd('(base - after) / base * 100', 2)} ELSE 0 END AS pct
  FROM (SELECT scen.*, grid.*, {CURRENT} AS cur, {heuristic_sql()} AS base, {heuristic_sql(**IMPROVED)} AS after
    FROM scen, grid WHERE better IS NOT NULL))""", SWEEP_CTE)))
def interventions(spark, folder):
    return scenario.interventions(spread_scenarios(spark, folder), KEEP)


# Scenario A is the request, scenario B a plan for the same place: better drainage and access, less rain.

B_SIDE = {"drainage_index": "0.85", "nearest_evac_km": "1.0", "rainfall_7d_mm": "rainfall_7d_mm * 0.9",
          "built_up_percent": "built_up_percent + 5"}
SIDES_CTE = f""", sides AS (SELECT number, district, {', '.join(f'{n} AS a_{n}' for n in NUMERIC_INPUTS)},
  {', '.join(f'{B_SIDE.get(n, n)} AS b_{n}' for n in NUMERIC_INPUTS)}, model_version, {heuristic_sql()} AS score_a,
  {heuristic_sql(**B_SIDE)} AS score_b FROM scen)"""


def compared(spark, folder):
    a = scenarios(spark, folder)
    b = a.withColumns({n: F.expr(text.replace("0.85", "0.85D").replace("1.0", "1.0D").replace("0.9", "0.9D"))
                       for n, text in B_SIDE.items()})
    return scenario.compare(a, b, "number")


@query("scenario_compare", sql(over_scenarios(f"""
SELECT number, district AS district_a, district AS district_b, {rnd('score_a', 4)} AS score_a, {level_sql('score_a')} AS level_a,
  {rnd('score_b', 4)} AS score_b, {level_sql('score_b')} AS level_b, {rnd('score_b - score_a', 4)} AS score_delta,
  CASE WHEN {rnd('score_b - score_a', 4)} < -0.005 THEN 'improved' WHEN {rnd('score_b - score_a', 4)} > 0.005 THEN 'worsened'
    ELSE 'unchanged' END AS risk_improvement FROM sides""", SIDES_CTE)))
def scenario_compare(spark, folder):
    return compared(spark, folder).drop("changes")


def changes_sql() -> str:
    parts = []
    for i, n in enumerate(NUMERIC_INPUTS):
        good = "delta > 0" if n in GOOD_WHEN_RISING else "delta < 0" if n in GOOD_WHEN_FALLING else "false"
        parts.append(
            f"SELECT number, {i} AS ord, '{n}' AS feature, '{FEATURE_LABELS[n]}' AS label, a_{n} AS va, b_{n} AS vb,"
            f" b_{n} - a_{n} AS delta, CASE WHEN {good} THEN 'positive' WHEN score_b > score_a THEN 'negative'"
            f" ELSE 'positive' END AS impact_direction FROM sides"
        )
    return f"""SELECT number, CAST(row_number() OVER (PARTITION BY number ORDER BY abs({rnd('delta', 4)}) DESC, ord) AS INT) AS position,
      feature, label, {rnd('va', 4)} AS value_a, {rnd('vb', 4)} AS value_b, {rnd('delta', 4)} AS delta, impact_direction
      FROM ({' UNION ALL '.join(parts)}) WHERE abs(delta) > 0.001"""


@query("scenario_changes", sql(over_scenarios(changes_sql(), SIDES_CTE)))
def scenario_changes(spark, folder):
    return scenario.feature_changes(compared(spark, folder), "number")


# Greedy plans, spelled out round by round in SQL.

ACTION_NAMES = [a[0] for a in ACTIONS]


def planner_ctes() -> str:
    actions = ", ".join(
        f"({i}, '{a[0]}', '{a[1]}', {float(a[3])!r}, {str(a[4]).lower()}, {float(a[6])!r}, {str(a[7]).lower()})"
        for i, a in enumerate(ACTIONS))
    fractions = ", ".join(f"('{p}', {f!r})" for p, fs in PROFILE_FRACTIONS.items() for f in fs)
    others = "rainfall_7d_mm, elevation_m, historical_flood_count, extreme_weather_index"
    now = ", ".join(ACTION_NAMES)
    text = f""",
actions(ord, feature, label, target, rising, cost, cheap) AS (VALUES {actions}),
fractions(profile, fraction) AS (VALUES {fractions}),
s0 AS MATERIALIZED (SELECT number, district, model_version, target_risk_level, budget_profile, narrow,
  least(greatest(max_steps, 1), 5) AS lim,
  CASE target_risk_level WHEN 'Low' THEN 0.25 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.75 ELSE 1.0 END AS threshold,
  {others}, {now}, {heuristic_sql()} AS score, CAST([] AS VARCHAR[]) AS used, false AS stalled FROM scen)"""
    value = "CASE feature " + " ".join(f"WHEN '{n}' THEN {n}" for n in ACTION_NAMES) + " END"
    swapped = {n: f"CASE WHEN feature = '{n}' THEN tv ELSE {n} END" for n in ACTION_NAMES}
    for r in range(1, 6):
        going = f"s.score >= s.threshold AND NOT s.stalled AND {r} <= s.lim"
        text += f""",
c{r} AS MATERIALIZED (SELECT *, s_score - new_score AS red, CASE budget_profile WHEN 'aggressive' THEN s_score - new_score
    WHEN 'low_cost' THEN (s_score - new_score) * CASE WHEN cheap THEN 1.35 ELSE 0.75 END / CAST(cost AS DOUBLE)
    ELSE (s_score - new_score) / sqrt(CAST(cost AS DOUBLE)) END AS utility
  FROM (SELECT *, score AS s_score, {heuristic_sql(**swapped)} AS new_score
    FROM (SELECT DISTINCT s.*, a.ord, a.feature, a.label, a.cost, a.cheap, a.rising, {value} AS fv, CAST(a.target AS DOUBLE) AS goal,
        {rnd(f'{value} + (CAST(a.target AS DOUBLE) - {value}) * CAST(f.fraction AS DOUBLE)', 6)} AS tv
      FROM s{r - 1} s, actions a, fractions f WHERE {going} AND f.profile = s.budget_profile
        AND NOT list_contains(s.used, a.feature)
        AND (NOT s.narrow OR a.feature IN ('drainage_index', 'built_up_percent')))
    WHERE NOT (CASE WHEN rising THEN fv >= goal ELSE fv <= goal END) AND abs(fv - goal) > 1e-9
      AND tv >= least(fv, goal) AND tv <= greatest(fv, goal))),
b{r} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number
    ORDER BY utility DESC, red DESC, cost, feature, tv) AS rn FROM c{r} WHERE red > 1e-9) WHERE rn = 1),
s{r} AS MATERIALIZED (SELECT s.number, s.district, s.model_version, s.target_risk_level, s.budget_profile, s.narrow, s.lim, s.threshold,
    {', '.join('s.' + n for n in others.split(', '))},
    {', '.join(f"CASE WHEN b.feature = '{n}' THEN b.tv ELSE s.{n} END AS {n}" for n in ACTION_NAMES)},
    coalesce(b.new_score, s.score) AS score,
    CASE WHEN b.feature IS NULL THEN s.used ELSE list_append(s.used, b.feature) END AS used,
    s.stalled OR ({going} AND b.feature IS NULL) AS stalled
  FROM s{r - 1} s LEFT JOIN b{r} b ON b.number = s.number)"""
    return text


PLANS = planner_ctes()
EACH = range(1, 6)


def planned(spark, folder):
    rows = spread_scenarios(
        spark, folder, KEEP + ["target_risk_level", "budget_profile", "max_steps", "allowed_features"]
    )
    return planner.plan(rows, ["number"])


def pct(before: str, after: str) -> str:
    return rnd(f"CASE WHEN {before} > 0 THEN ({before} - {after}) / {before} * 100 ELSE 0 END", 2)


@query("plan_summary", sql(over_scenarios(f"""
SELECT a.number, a.district, a.model_version, a.target_risk_level, {rnd('a.score', 4)} AS baseline_score,
  {level_sql('a.score')} AS baseline_risk_level, CAST(a.threshold AS DOUBLE) AS target_score_threshold,
  z.score < z.threshold AS target_reached, {rnd('z.score', 4)} AS optimized_score,
  {level_sql('z.score')} AS optimized_risk_level, {pct('a.score', 'z.score')} AS risk_reduction_pct,
  CAST(len(z.used) AS INT) AS steps FROM s0 a JOIN s5 z ON z.number = a.number""", PLANS)))
def plan_summary(spark, folder):
    plans = planned(spark, folder)
    return plans.withColumn("steps", F.size("recommended_plan")).drop("recommended_plan", "search_trace", "alternatives")


def by_action(at: int) -> str:
    return "CASE feature " + " ".join(f"WHEN '{a[0]}' THEN '{a[at]}'" for a in ACTIONS) + " END"


@query("plan_steps", sql(over_scenarios(" UNION ALL ".join(f"""
SELECT number, {r} AS position, feature, label AS feature_label, {by_action(2)} AS category, {rnd('fv', 4)} AS from_value,
  {rnd('tv', 4)} AS to_value, {rnd('s_score', 4)} AS score_before, {rnd('new_score', 4)} AS score_after,
  {rnd('s_score - new_score', 4)} AS absolute_reduction, {pct('s_score', 'new_score')} AS relative_reduction_pct,
  {by_action(5)} AS cost_level, {by_action(8)} AS rationale FROM b{r}""" for r in EACH), PLANS)))
def plan_steps(spark, folder):
    return planner.exploded(planned(spark, folder), "recommended_plan", ["number"])


def all_trials() -> str:
    return " UNION ALL ".join(f"""
SELECT c.number, {r} AS step, c.ord, c.feature, c.rising, c.tv, c.new_score, c.red, c.label, list_append(c.used, c.feature) AS path,
  c.threshold, coalesce(b.feature = c.feature AND b.tv = c.tv, false) AS accepted
  FROM c{r} c LEFT JOIN b{r} b ON b.number = c.number""" for r in EACH)


@query("plan_trace", sql(over_scenarios(f"""
SELECT number, CAST(row_number() OVER (PARTITION BY number ORDER BY step, ord, CASE WHEN rising THEN tv ELSE -tv END) AS INT) AS position,
  step, feature AS tried_feature, {rnd('tv', 4)} AS tried_value, {rnd('new_score', 4)} AS resulting_score,
  {level_sql('new_score')} AS resulting_risk_level, accepted FROM ({all_trials()})""", PLANS)))
def plan_trace(spark, folder):
    return planner.exploded(planned(spark, folder), "search_trace", ["number"])


STALLED = STALL_TEXT.replace("'", "''")


@query("plan_alternatives", sql(over_scenarios(f"""
SELECT number, CAST(row_number() OVER (PARTITION BY number ORDER BY ord, missed, optimized_score, steps, name) AS INT) AS position,
  name, optimized_score, optimized_risk_level, target_reached, risk_reduction_pct, steps
FROM (
  SELECT number, 1 AS ord, new_score >= threshold AS missed, name, {rnd('new_score', 4)} AS optimized_score,
    {level_sql('new_score')} AS optimized_risk_level, new_score < threshold AS target_reached,
    {pct('base', 'new_score')} AS risk_reduction_pct, CAST(len(path) AS INT) AS steps
  FROM (SELECT t.*, 'Alternative via ' || t.label AS name, s0.score AS base, row_number() OVER (
      PARTITION BY t.number, array_to_string(path, '>') ORDER BY {rnd('new_score', 4)}, step, t.ord, CASE WHEN rising THEN tv ELSE -tv END) AS first
    FROM ({all_trials()}) t JOIN s0 ON s0.number = t.number WHERE red > 1e-9 AND NOT accepted) WHERE first = 1
  UNION ALL
  SELECT z.number, 0, true, '{STALLED}', {rnd('z.score', 4)}, {level_sql('z.score')}, false,
    {pct('a.score', 'z.score')}, CAST(len(z.used) AS INT)
  FROM s5 z JOIN s0 a ON a.number = z.number WHERE z.stalled AND z.score >= z.threshold)
QUALIFY position <= 3""", PLANS)))
def plan_alternatives(spark, folder):
    rows = planner.exploded(planned(spark, folder), "alternatives", ["number"])
    return rows.withColumn("steps", F.size("steps"))
