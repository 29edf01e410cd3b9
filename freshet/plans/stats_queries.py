"""Statistics, profiles, ranks and quantiles over the observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.constants import CATEGORICAL, NUMERIC_INPUTS
from freshet.operators import ordering, stats
from freshet.plans.common import over_obs, tidy, tidy_sql
from freshet.sources.tables import labelled, observations, unlabelled

c = F.col
QUERIES, ORACLES = {}, {}
Y = "flood_risk_score"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


@query("district_mean", tidy_sql(over_obs(
    f"SELECT district, avg({Y}) AS mean_risk FROM train GROUP BY district"), ["mean_risk"]))
def district_mean(spark, folder):
    return tidy(labelled(observations(spark, folder)).groupBy("district").agg(F.avg(Y).alias("mean_risk")))


@query("flag_moments", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS flag, {n} AS value, avg({Y}) AS mean, stddev_samp({Y}) AS std, count({Y}) AS \"count\""
    f" FROM train WHERE {n} IS NOT NULL GROUP BY {n}"
    for n in ("flood_occurrence_current_event", "water_presence_flag", "is_synthetic"))), ["mean", "std"]))
def flag_moments(spark, folder):
    """Mean, deviation and count of the target by each yes/no column."""
    train = labelled(observations(spark, folder))
    names = ["flood_occurrence_current_event", "water_presence_flag", "is_synthetic"]
    long = train.select(Y, *names).unpivot([Y], names, "flag", "value").where(c("value").isNotNull())
    return tidy(
        long.groupBy("flag", "value").agg(
            F.avg(Y).alias("mean"), F.stddev_samp(Y).alias("std"), F.count(Y).alias("count")
        )
    )


@query("district_stats", tidy_sql(over_obs(f"""
SELECT district, avg({Y}) AS district_mean_risk, coalesce(stddev_samp({Y}), 0) AS district_std_risk,
  min({Y}) AS district_min_risk, max({Y}) AS district_max_risk, count({Y}) AS district_count,
  median({Y}) AS district_median_risk, quantile_cont({Y}, 0.10) AS district_p10_risk,
  quantile_cont({Y}, 0.90) AS district_p90_risk, avg(historical_flood_count) AS district_flood_mean,
  avg(rainfall_7d_mm) AS district_rain_mean, avg(population_density_per_km2) AS district_pop_mean,
  avg(extreme_weather_index) AS district_extreme_mean, median(elevation_m) AS district_elev_median
FROM train GROUP BY district"""), [f"district_{n}" for n in (
    "mean_risk", "std_risk", "min_risk", "max_risk", "median_risk", "p10_risk", "p90_risk", "flood_mean",
    "rain_mean", "pop_mean", "extreme_mean", "elev_median")]))
def district_stats(spark, folder):
    return tidy(
        stats.group_profile(
            labelled(observations(spark, folder)), "district", Y, "district_", "_risk",
            quantiles={"p10": 0.10, "p90": 0.90},
            means={"district_flood_mean": "historical_flood_count", "district_rain_mean": "rainfall_7d_mm",
                   "district_pop_mean": "population_density_per_km2",
                   "district_extreme_mean": "extreme_weather_index"},
            medians={"district_elev_median": "elevation_m"},
        )
    )


@query("district_stats_compact", tidy_sql(over_obs(f"""
SELECT district, avg({Y}) AS dist_mean_risk, median({Y}) AS dist_median_risk,
  coalesce(stddev_samp({Y}), 0) AS dist_std_risk FROM train GROUP BY district"""),
    ["dist_mean_risk", "dist_median_risk", "dist_std_risk"]))
def district_stats_compact(spark, folder):
    profile = stats.group_profile(labelled(observations(spark, folder)), "district", Y, "dist_", "_risk")
    return tidy(profile.select("district", "dist_mean_risk", "dist_median_risk", "dist_std_risk"))


PLACE_SQL = f"""
SELECT place_name, avg({Y}) AS place_mean_risk, coalesce(stddev_samp({Y}), 0) AS place_std_risk,
  min({Y}) AS place_min_risk, max({Y}) AS place_max_risk, count({Y}) AS place_count,
  median({Y}) AS place_median_risk, quantile_cont({Y}, 0.10) AS place_p10_risk,
  quantile_cont({Y}, 0.25) AS place_p25_risk, quantile_cont({Y}, 0.75) AS place_p75_risk,
  quantile_cont({Y}, 0.90) AS place_p90_risk, max({Y}) - min({Y}) AS place_range_risk,
  quantile_cont({Y}, 0.75) - quantile_cont({Y}, 0.25) AS place_iqr_risk FROM train GROUP BY place_name"""
PLACE_COLUMNS = [f"place_{n}_risk" for n in (
    "mean", "std", "min", "max", "median", "p10", "p25", "p75", "p90", "range", "iqr")]


def place_profile(train):
    profile = stats.group_profile(
        train, "place_name", Y, "place_", "_risk",
        quantiles={"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90},
    )
    return profile.withColumn(
        "place_range_risk", c("place_max_risk") - c("place_min_risk")
    ).withColumn("place_iqr_risk", c("place_p75_risk") - c("place_p25_risk"))


@query("place_stats", tidy_sql(over_obs(PLACE_SQL), PLACE_COLUMNS))
def place_stats(spark, folder):
    return tidy(place_profile(labelled(observations(spark, folder))))


@query("group_stats_join", tidy_sql(over_obs(
    f"SELECT r.record_id, r.split, p.* EXCLUDE (place_name, place_count) FROM obs r LEFT JOIN ({PLACE_SQL}) p"
    " ON p.place_name = r.place_name"), PLACE_COLUMNS))
def group_stats_join(spark, folder):
    """Statistics of the training rows of a place on every row of it.

    On training rows these hold the row's own target: fine to report, not to learn from.
    """
    obs = observations(spark, folder)
    out = stats.attach_group_stats(
        obs.select("record_id", "split", "place_name"), place_profile(labelled(obs)), "place_name", "place_count"
    )
    return tidy(out.select("record_id", "split", *PLACE_COLUMNS))


@query("residual_stats", tidy_sql(over_obs(f"""
SELECT stddev_samp(residual) AS residual_std, min(residual) AS residual_min, max(residual) AS residual_max
FROM (SELECT {Y} - avg({Y}) OVER (PARTITION BY place_name) AS residual FROM train)"""),
    ["residual_std", "residual_min", "residual_max"]))
def residual_stats(spark, folder):
    rows = stats.with_residual(labelled(observations(spark, folder)).select("place_name", Y), "place_name", Y)
    return tidy(
        rows.agg(
            F.stddev_samp("residual").alias("residual_std"), F.min("residual").alias("residual_min"),
            F.max("residual").alias("residual_max"),
        )
    )


@query("place_residuals", tidy_sql(over_obs(f"""
SELECT record_id, avg({Y}) OVER (PARTITION BY place_name) AS place_mean,
  {Y} - avg({Y}) OVER (PARTITION BY place_name) AS residual FROM train"""), ["place_mean", "residual"]))
def place_residuals(spark, folder):
    rows = labelled(observations(spark, folder)).select("record_id", "place_name", Y)
    return tidy(stats.with_residual(rows, "place_name", Y).select("record_id", "place_mean", "residual"))


RESIDUAL_COLUMNS = [n for n in NUMERIC_INPUTS if n not in ("nearest_hospital_km", "nearest_evac_km")] + [
    "rainfall_7d_mm_log1p", "distance_to_river_m_log1p", "ndwi_qmap"]


@query("residual_correlations", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", corr({n}, residual) AS corr FROM res" for n in RESIDUAL_COLUMNS),
    f", res AS MATERIALIZED (SELECT *, {Y} - avg({Y}) OVER (PARTITION BY place_name) AS residual FROM train)"),
    ["corr"]))
def residual_correlations(spark, folder):
    train = labelled(observations(spark, folder)).select("place_name", Y, *RESIDUAL_COLUMNS)
    rows = stats.with_residual(train, "place_name", Y)
    return tidy(stats.correlations(rows, RESIDUAL_COLUMNS, "residual"))


@query("target_correlations", tidy_sql(over_obs(
    "SELECT \"column\", abs(corr) AS abs_corr FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", corr({n}, {Y}) AS corr FROM train" for n in NUMERIC_INPUTS)
    + ") ORDER BY abs(corr) DESC, \"column\" LIMIT 20"), ["abs_corr"]))
def target_correlations(spark, folder):
    corrs = stats.correlations(labelled(observations(spark, folder)), NUMERIC_INPUTS, Y)
    return tidy(stats.strongest(corrs, 20).select("column", F.abs("corr").alias("abs_corr")))


# All columns of the observations.
DOUBLES = [*NUMERIC_INPUTS, "rainfall_7d_mm_log1p", "distance_to_river_m_log1p", "population_density_per_km2_log1p",
           "ndwi_qmap", "elevation_m_yeojohnson", Y]
PROFILED = ["record_id", "number", "generation_date", *CATEGORICAL, "is_synthetic", "fold", "split", *DOUBLES]


def kind_of(name: str) -> str:
    return {"number": "bigint", "fold": "int"}.get(name, "double" if name in DOUBLES else "string")


@query("column_profile", over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{kind_of(n)}' AS dtype, count(DISTINCT {n}) AS distinct_values,"
    f" count(*) - count({n}) AS missing FROM obs" for n in PROFILED)))
def column_profile(spark, folder):
    return stats.column_profile(observations(spark, folder).select(*PROFILED))


@query("describe", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count({n}) AS \"count\", avg({n}) AS mean, stddev_samp({n}) AS std, min({n}) AS min,"
    f" max({n}) AS max, quantile_cont({n}, 0.25) AS p25, median({n}) AS p50, quantile_cont({n}, 0.75) AS p75"
    f" FROM train" for n in [*NUMERIC_INPUTS, Y])), ["mean", "std", "min", "max", "p25", "p50", "p75"]))
def describe(spark, folder):
    return tidy(stats.describe(labelled(observations(spark, folder)), [*NUMERIC_INPUTS, Y]))


PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


@query("target_percentiles", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT {p} AS percent, quantile_cont({Y}, {p / 100}) AS quantile FROM train" for p in PERCENTS)), ["quantile"]))
def target_percentiles(spark, folder):
    return tidy(stats.percentiles(labelled(observations(spark, folder)), Y, PERCENTS))


@query("district_counts", over_obs(
    "SELECT district, count(*) AS \"rows\" FROM train GROUP BY district ORDER BY 2 DESC, 1 LIMIT 30"))
def district_counts(spark, folder):
    return stats.most_frequent(labelled(observations(spark, folder)), "district", 30)


COUNTED = ["landcover", "soil_type", "water_supply", "electricity", "road_quality", "urban_rural",
           "water_presence_flag", "flood_occurrence_current_event"]


@query("category_counts", over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", {n} AS value, count(*) AS \"rows\" FROM train WHERE {n} IS NOT NULL GROUP BY {n}"
    for n in COUNTED)))
def category_counts(spark, folder):
    return stats.value_counts(labelled(observations(spark, folder)), COUNTED)


@query("table_shape", over_obs(
    "SELECT 'train' AS split, count(*) AS \"rows\", 19 AS columns FROM train"
    " UNION ALL SELECT 'test', count(*), 18 FROM test"))
def table_shape(spark, folder):
    obs = observations(spark, folder)
    train = stats.shape(labelled(obs).select(*NUMERIC_INPUTS, Y))
    test = stats.shape(unlabelled(obs).select(*NUMERIC_INPUTS))
    return train.select(F.lit("train").alias("split"), "*").unionByName(test.select(F.lit("test").alias("split"), "*"))


@query("non_finite", over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(*) - count(x) AS missing, count(*) FILTER (NOT isfinite(x)) AS not_finite FROM (SELECT"
    f" CASE WHEN number % {i + 11} = 0 THEN CAST('inf' AS DOUBLE) WHEN number % {i + 13} = 1 THEN CAST('nan' AS DOUBLE)"
    f" WHEN number % {i + 17} = 2 THEN CAST('-inf' AS DOUBLE) ELSE {n} END AS x FROM obs)"
    for i, n in enumerate(NUMERIC_INPUTS))))
def non_finite(spark, folder):
    """Gaps and values that are not finite, in measures some of which have been spoilt."""
    spoilt = {
        n: F.when(c("number") % (i + 11) == 0, float("inf")).when(c("number") % (i + 13) == 1, float("nan"))
        .when(c("number") % (i + 17) == 2, float("-inf")).otherwise(c(n))
        for i, n in enumerate(NUMERIC_INPUTS)
    }
    return stats.non_finite(observations(spark, folder).withColumns(spoilt), NUMERIC_INPUTS)


@query("place_mean_predictor", tidy_sql(over_obs(f"""
SELECT sqrt(avg(({Y} - m) * ({Y} - m))) AS rmse, corr({Y}, m) AS corr
FROM (SELECT {Y}, avg({Y}) OVER (PARTITION BY place_name) AS m FROM train)"""), ["rmse", "corr"]))
def place_mean_predictor(spark, folder):
    return tidy(stats.group_mean_predictor(labelled(observations(spark, folder)), "place_name", Y))


@query("global_mean", tidy_sql(over_obs(f"SELECT avg({Y}) AS global_mean FROM train"), ["global_mean"]))
def global_mean(spark, folder):
    return tidy(labelled(observations(spark, folder)).agg(F.avg(Y).alias("global_mean")))


RANKED = ["rainfall_7d_mm", "monthly_rainfall_mm", "historical_flood_count", "extreme_weather_index",
          "distance_to_river_m", "elevation_m", "drainage_index", "inundation_area_sqm"]


@query("place_rank", tidy_sql(over_obs(
    "SELECT record_id, " + ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN (rank() OVER (PARTITION BY place_name ORDER BY {n})"
        f" + (count(*) OVER (PARTITION BY place_name, {n}) - 1) / 2.0) / count({n}) OVER (PARTITION BY place_name) END"
        f" AS {n}_place_rank" for n in RANKED) + " FROM train"), [f"{n}_place_rank" for n in RANKED]))
def place_rank(spark, folder):
    train = labelled(observations(spark, folder)).select("record_id", "place_name", *RANKED)
    return tidy(ordering.percent_ranks(train, "place_name", RANKED, ["record_id"], "_place_rank"))


@query("district_value_share", tidy_sql(over_obs(f"""
SELECT district, count(*) AS "rows", count(*) / greatest(max(count(*)) OVER (), 1) AS share FROM train GROUP BY district"""),
    ["share"]))
def district_value_share(spark, folder):
    """Bar heights: rows of a district over those of the largest."""
    counts = labelled(observations(spark, folder)).groupBy("district").agg(F.count(F.lit(1)).alias("rows"))
    return tidy(stats.share_of_largest(counts, "rows"))
