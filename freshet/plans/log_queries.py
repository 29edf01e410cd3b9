"""The simulation log: appending, reporting, recent rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.constants import DISTRICTS, NUMERIC_INPUTS, SCORE_BINS, TRACKED_COLUMNS
from freshet.durable import scratch
from freshet.operators import logs, stats
from freshet.operators.scenario import simulate
from freshet.plans.common import array_text, heuristic_sql, level_sql, over_scenarios, rnd, sql, tidy, tidy_sql
from freshet.plans.scenario_queries import scenarios
from freshet.sources import files
from freshet.sources.tables import simulation_log

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


TRACKED = ", ".join(
    f"CASE WHEN k % {i + 2} = 0 THEN CAST(k AS DOUBLE) END AS {n}" for i, n in enumerate(TRACKED_COLUMNS))
LOG = f"""WITH log AS (SELECT *, {level_sql('flood_risk_score')} AS risk_level FROM (
  SELECT event_id AS id, ts AS timestamp, event_type AS model_version, {array_text(DISTRICTS)}[user_id % 25 + 1] AS district,
    {TRACKED}, least(value / 500, 1.0) AS flood_risk_score, value AS inference_time_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))"""
BINS = {name: " AND ".join(
    ([f"flood_risk_score >= {lo}"] if lo is not None else []) + ([f"flood_risk_score < {hi}"] if hi is not None else []))
    for name, lo, hi in SCORE_BINS}


@query("log_summary", sql(f"""{LOG} SELECT count(*) AS total_simulations, {rnd('avg(inference_time_ms)', 2)} AS avg_latency_ms,
  {rnd('avg(flood_risk_score)', 4)} AS avg_risk_score FROM log"""))
def log_summary(spark, folder):
    return logs.summary(simulation_log(spark, folder)).select("total_simulations", "avg_latency_ms", "avg_risk_score")


@query("score_histogram", tidy_sql(f"""{LOG} SELECT *, "rows" / greatest(max("rows") OVER (), 1) AS share FROM (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS bin, count(*) AS \"rows\" FROM log WHERE {where}" for name, where in BINS.items()) + ")", ["share"]))
def score_histogram(spark, folder):
    return tidy(stats.share_of_largest(logs.histogram(logs.summary(simulation_log(spark, folder))), "rows"))


@query("feature_usage", tidy_sql(f"""{LOG} SELECT *, uses / greatest(max(uses) OVER (), 1) AS share FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS uses FROM log" for n in TRACKED_COLUMNS) + ")", ["share"]))
def feature_usage(spark, folder):
    used = logs.usage(logs.summary(simulation_log(spark, folder)))
    return tidy(stats.share_of_largest(used, "uses")).orderBy(c("uses").desc(), "feature")


@query("empty_log_summary", sql(f"""{LOG} SELECT count(*) AS total_simulations, coalesce(avg(inference_time_ms), 0) AS avg_latency_ms,
  coalesce(avg(flood_risk_score), 0) AS avg_risk_score FROM log WHERE flood_risk_score < 0"""))
def empty_log_summary(spark, folder):
    """A log without matching rows reports zeros."""
    nothing = simulation_log(spark, folder).where(c("flood_risk_score") < 0)
    return logs.summary(nothing).select("total_simulations", "avg_latency_ms", "avg_risk_score")


@query("recent_simulations", sql(f"""{LOG} SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, district, model_version,
  {rnd('flood_risk_score', 4)} AS flood_risk_score, risk_level, {rnd('inference_time_ms', 2)} AS inference_time_ms
  FROM log ORDER BY log.timestamp DESC, id DESC LIMIT 20"""))
def recent_simulations(spark, folder):
    return logs.recent(simulation_log(spark, folder))


@query("log_append", tidy_sql(over_scenarios(f"""
SELECT model_version, district, rainfall_7d_mm, drainage_index, built_up_percent, score AS flood_risk_score,
  {level_sql('score')} AS risk_level, drainage_index AS logged_drainage
FROM (SELECT *, {heuristic_sql()} AS score FROM scen)"""),
    ["rainfall_7d_mm", "drainage_index", "built_up_percent", "flood_risk_score", "logged_drainage"]))
def log_append(spark, folder):
    """Scored scenarios appended to a log table and read back from it."""
    scored = simulate(scenarios(spark, folder)).withColumn("inference_time_ms", F.lit(0.0))
    rows = logs.log_rows(scored, ["district", *NUMERIC_INPUTS], F.lit("2024-06-15").cast("timestamp"))
    path = scratch(spark, "log")
    files.append_log(rows, path)
    back = files.read_log(spark, path)
    logged = F.get_json_object("input_features_json", "$.drainage_index").cast("double")
    return tidy(
        back.select(
            "model_version", "district", "rainfall_7d_mm", "drainage_index", "built_up_percent",
            "flood_risk_score", "risk_level", logged.alias("logged_drainage"),
        )
    )
