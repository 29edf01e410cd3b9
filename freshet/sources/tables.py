"""The star-schema tables seen as flood observations, requests, predictions and logs.

Sums are taken over integers (cents, hundredths), so each value is the same
whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.constants import DISTRICTS, MODEL_VERSIONS, TRACKED_COLUMNS
from freshet.functions.scalars import clip_unit, risk_level
from freshet.operators.folds import arithmetic_fold

c = F.col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def district_at(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DISTRICTS]), (number + 1).cast("int"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: line totals, counted before the shuffle."""
    hundredths = lambda name: F.floor(c(name) * 100 + 0.5)
    return table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(hundredths("l_discount")).alias("disc"),
        F.sum(hundredths("l_tax")).alias("tax"),
        F.sum(hundredths("l_extendedprice")).alias("cents"),
        F.count(F.lit(1)).alias("lines"),
        F.max("l_linenumber").cast("double").alias("last_line"),
        F.max("l_discount").alias("max_disc"), F.min("l_tax").alias("min_tax"),
        F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("s_suppkey"),
    )


def observations(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    """One observation per order. The sizes of all sides are left to Catalyst."""
    number = c("o_orderkey")
    joined = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), c("o_custkey") == c("c_custkey"))
        .join(table(spark, folder, "nation").select("n_nationkey"), c("c_nationkey") == c("n_nationkey"))
        .join(order_lines(spark, folder), "o_orderkey", "left")
        .join(table(spark, folder, "part"), "p_partkey", "left")
        .join(table(spark, folder, "supplier"), "s_suppkey", "left")
    )
    drainage = c("disc") / (c("lines") * 10.0)
    river, height = c("c_acctbal"), c("s_acctbal") / 10
    rain = c("qty")
    yes_no = lambda condition: F.when(condition, "Yes").otherwise("No")
    target = clip_unit(
        c("o_totalprice") * 0.5 / 500000.0
        + F.coalesce(rain, F.lit(0.0)) * 0.3 / 350.0
        + (F.lit(1.0) - F.coalesce(drainage, F.lit(0.0))) * 0.2
    )
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return joined.select(
        F.concat(F.lit("F"), number.cast("string")).alias("record_id"),
        number.alias("number"),
        # A few dates are unreadable, as they may be in a request.
        F.when(number % 97 == 0, "not-a-date").otherwise(date).alias("generation_date"),
        district_at(c("n_nationkey")).alias("district"),
        c("c_name").alias("place_name"),
        c("p_type").alias("landcover"),
        c("c_mktsegment").alias("soil_type"),
        c("p_brand").alias("water_supply"),
        yes_no(c("o_totalprice") > 250000).alias("electricity"),
        c("o_orderpriority").alias("road_quality"),
        F.when(c("p_size").isNull(), None).when(c("p_size") > 25, "Urban").otherwise("Rural").alias("urban_rural"),
        F.when(c("s_acctbal").isNull(), None).when(c("s_acctbal") < 0, "Yes").otherwise("No").alias("water_presence_flag"),
        yes_no(c("o_orderstatus") == "F").alias("flood_occurrence_current_event"),
        yes_no(c("c_acctbal") > 0).alias("is_good_to_live"),
        F.when(c("o_orderpriority").startswith("1"), "High flood risk; Poor infrastructure")
        .when(c("o_orderpriority").startswith("2"), "No road access")
        .when(c("o_orderpriority").startswith("3"), None)
        .otherwise("Other").alias("reason_not_good_to_live"),
        rain.alias("rainfall_7d_mm"),
        (rain + c("p_size") * 4).alias("monthly_rainfall_mm"),
        height.alias("elevation_m"),
        river.alias("distance_to_river_m"),
        drainage.alias("drainage_index"),
        (c("tax") / (c("lines") * 8.0)).alias("infrastructure_score"),
        (c("p_size") / 2.0).alias("nearest_hospital_km"),
        c("last_line").alias("nearest_evac_km"),
        (c("p_size") * 2.0).alias("built_up_percent"),
        (c("o_totalprice") / 100).alias("population_density_per_km2"),
        (c("disc") / (c("lines") * 5.0) - 1).alias("ndvi"),
        (c("tax") / (c("lines") * 4.0) - 1).alias("ndwi"),
        (c("max_disc") * 10).alias("extreme_weather_index"),
        (c("min_tax") * 12.5).alias("seasonal_index"),
        (c("p_size") / 50.0).alias("terrain_roughness_index"),
        ((river + 1000) / 11000.0).alias("socioeconomic_status_index"),
        c("lines").cast("double").alias("historical_flood_count"),
        (c("cents") / 100.0).alias("inundation_area_sqm"),
        F.when(number % 26 == 0, None).when(number % 2 == 0, "True").otherwise("False").alias("is_synthetic"),
        F.log1p(rain).alias("rainfall_7d_mm_log1p"),
        F.log1p(F.greatest(river, F.lit(0.0))).alias("distance_to_river_m_log1p"),
        F.log1p(c("o_totalprice") / 100).alias("population_density_per_km2_log1p"),
        (c("tax") / (c("lines") * 8.0) - 0.5).alias("ndwi_qmap"),
        F.when(height >= 0, F.log1p(height)).otherwise(height).alias("elevation_m_yeojohnson"),
        target.alias("flood_risk_score"),
        arithmetic_fold(number, folds).alias("fold"),
        F.when(number % 5 == 4, "test").otherwise("train").alias("split"),
    )


def labelled(obs: DataFrame) -> DataFrame:
    return obs.where(c("split") == "train")


def unlabelled(obs: DataFrame) -> DataFrame:
    return obs.where(c("split") == "test")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario requests: a district, a version and some measures that override its defaults."""
    number = c("number")
    obs = observations(spark, folder)
    some = lambda name, step, rest: F.when(number % step == rest, c(name)).alias(name)
    return obs.select(
        "number",
        # Every 11th request names a district that is not on the list.
        F.when(number % 11 == 0, "Atlantis").otherwise(c("district")).alias("district"),
        F.element_at(F.array(*[F.lit(v) for v in MODEL_VERSIONS]), (number % 3 + 1).cast("int")).alias("model_version"),
        some("rainfall_7d_mm", 2, 0), some("drainage_index", 3, 1), some("elevation_m", 4, 2),
        some("infrastructure_score", 5, 3), some("nearest_hospital_km", 3, 2),
        some("nearest_evac_km", 4, 1), some("built_up_percent", 6, 5),
        some("historical_flood_count", 7, 3),
        F.element_at(F.array(*[F.lit(v) for v in ("Low", "Medium", "High", "Critical")]),
                     (number % 4 + 1).cast("int")).alias("target_risk_level"),
        F.element_at(F.array(*[F.lit(v) for v in ("low_cost", "balanced", "aggressive")]),
                     (F.floor(number / 3) % 3 + 1).cast("int")).alias("budget_profile"),
        (number % 7).cast("int").alias("max_steps"),
        F.when(number % 5 == 0, F.array(F.lit("not_a_feature"), F.lit("drainage_index"), F.lit("built_up_percent")))
        .alias("allowed_features"),
    )


# Names, share of the target in the prediction, spread and pattern of the stand-in models.
STAND_IN_MODELS = [
    ("lgb_rmse_s42", 0.80, 0.20, 611, 17), ("lgb_mae_s42", 0.70, 0.25, 337, 5),
    ("xgb_sq_d6_s42", 0.75, 0.30, 871, 101), ("hgb_d4_s42", 0.60, 0.15, 457, 3),
    ("cat_d6_s42", 0.90, 0.35, 733, 29), ("cat_d8_slow_s142", 0.20, 0.90, 269, 11),
]


def stand_in_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of six stand-in models for every observation, with the target y."""
    obs = observations(spark, folder).select("record_id", "number", "split", "fold", c("flood_risk_score").alias("y"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                (c("y") * share + 0.45 * (1 - share)
                 + ((c("number") * step + shift) % 1009 / 1009.0 - 0.5) * spread).alias("pred"),
            )
            for name, share, spread, step, shift in STAND_IN_MODELS
        ]
    )
    return obs.withColumn("_m", F.explode(rows)).select("record_id", "number", "split", "fold", "y", "_m.*")


def simulation_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as the log of simulations."""
    k = F.get_json_object("props", "$.k").cast("int")
    score = F.least(c("value") / 500, F.lit(1.0))
    tracked = [
        F.when(k % (i + 2) == 0, k.cast("double")).alias(name) for i, name in enumerate(TRACKED_COLUMNS)
    ]
    return table(spark, folder, "events").select(
        c("event_id").alias("id"), c("ts").alias("timestamp"), c("event_type").alias("model_version"),
        district_at(c("user_id") % 25).alias("district"), *tracked,
        c("props").alias("input_features_json"), score.alias("flood_risk_score"),
        risk_level(score).alias("risk_level"), c("value").alias("inference_time_ms"),
    )
