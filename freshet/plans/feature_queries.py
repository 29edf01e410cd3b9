"""Feature blocks, imputation and scaling over the observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.constants import (
    CATEGORICAL, ENCODING_PRODUCTS, FEATURES_108, NUMERIC_INPUTS, TARGET, TARGET_ENCODINGS,
)
from freshet.durable import materialize
from freshet.functions import features as fx
from freshet.functions.scalars import logit, risk_level, sigmoid
from freshet.functions.scorers import heuristic_score, linear_combination, linear_score, score
from freshet.operators import encoding, ordering

from freshet.plans.common import heuristic_sql, level_sql, over_obs, tidy, tidy_sql
from freshet.plans.encoding_queries import fold_te_sql, full_te_sql
from freshet.sources.tables import labelled, observations

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


META_SQL = """
  CAST(month(d) AS INT) AS gen_month, CAST(year(d) AS INT) AS gen_year,
  CAST(dayofyear(d) AS INT) AS gen_day_of_year, CAST(quarter(d) AS INT) AS gen_quarter,
  CASE WHEN month(d) IN (12, 1, 2) THEN 1 ELSE 0 END AS is_ne_monsoon,
  CASE WHEN month(d) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS is_sw_monsoon,
  sin(2 * pi() * month(d) / 12) AS gen_month_sin, cos(2 * pi() * month(d) / 12) AS gen_month_cos,
  CASE WHEN lower(coalesce(reason_not_good_to_live, 'Other')) LIKE '%flood%' THEN 1 ELSE 0 END AS reason_flood_flag,
  CASE WHEN lower(coalesce(reason_not_good_to_live, 'Other')) LIKE '%infrastructure%' THEN 1 ELSE 0 END AS reason_infra_flag,
  CASE WHEN lower(coalesce(reason_not_good_to_live, 'Other')) LIKE '%road%' THEN 1 ELSE 0 END AS reason_road_flag,
  CASE WHEN coalesce(reason_not_good_to_live, 'Other') = 'Other' THEN 1 ELSE 0 END AS reason_other_flag,
  CASE WHEN is_good_to_live = 'Yes' THEN 1 ELSE 0 END AS is_good_binary,
  ln(1 + inundation_area_sqm) AS log_inundation, sqrt(inundation_area_sqm) AS sqrt_inundation,
  inundation_area_sqm / (population_density_per_km2 + 1) AS inundation_per_pop,
  CAST(replace(record_id, 'F', '') AS BIGINT) AS record_id_num
"""
META_COLUMNS = ["gen_month_sin", "gen_month_cos", "log_inundation", "sqrt_inundation", "inundation_per_pop"]


def meta_sql(fallback: bool, extra: str = "") -> str:
    date = "TRY_CAST(generation_date AS DATE)"
    if fallback:
        date = f"coalesce({date}, DATE '2024-06-15')"
    return f"SELECT *, {META_SQL}{extra} FROM (SELECT *, {date} AS d FROM obs)"


@query("calendar_features", tidy_sql(over_obs(f"""
SELECT record_id, d AS gen_date, gen_month, gen_year, gen_day_of_year, gen_quarter, is_ne_monsoon, is_sw_monsoon,
  gen_month_sin, gen_month_cos FROM ({meta_sql(True)})"""), ["gen_month_sin", "gen_month_cos"]))
def calendar_features(spark, folder):
    obs = observations(spark, folder)
    block = fx.calendar_features(fx.FALLBACK_DATE)
    return tidy(obs.select("record_id", *[x.alias(n) for n, x in block.items()]))


@query("meta_features", tidy_sql(over_obs(f"""
SELECT record_id, gen_month, gen_year, reason_flood_flag, reason_infra_flag, reason_road_flag, reason_other_flag,
  is_good_binary, log_inundation, sqrt_inundation, inundation_per_pop, record_id_num,
  CASE WHEN is_synthetic = 'True' THEN 1 ELSE 0 END AS is_synthetic_flag,
  CASE WHEN is_synthetic IS NULL THEN 1 ELSE 0 END AS is_real_data
FROM ({meta_sql(False)})"""), ["log_inundation", "sqrt_inundation", "inundation_per_pop"]))
def meta_features(spark, folder):
    obs = observations(spark, folder)
    calendar = {n: x for n, x in fx.calendar_features().items() if n in ("gen_month", "gen_year")}
    block = calendar | fx.meta_features() | fx.origin_flags()
    return tidy(obs.select("record_id", *[x.alias(n) for n, x in block.items()]))


INTERACTIONS_SQL = {
    "rainfall_x_flood": "rainfall_7d_mm * historical_flood_count",
    "monthly_x_flood": "monthly_rainfall_mm * historical_flood_count",
    "rain_ratio": "rainfall_7d_mm / (monthly_rainfall_mm + 0.000001)",
    "rain_cum": "rainfall_7d_mm + monthly_rainfall_mm",
    "river_clip": "CASE WHEN distance_to_river_m < 0 THEN 0 ELSE distance_to_river_m END",
    "river_rain_risk": "rainfall_7d_mm / (greatest(distance_to_river_m, 0) + 1)",
    "river_monthly_risk": "monthly_rainfall_mm / (greatest(distance_to_river_m, 0) + 1)",
    "elev_clip": "CASE WHEN elevation_m < 0 THEN 0 ELSE elevation_m END",
    "elev_rain_ratio": "rainfall_7d_mm / (CASE WHEN elevation_m < 0 THEN 0 ELSE elevation_m END + 1)",
    "low_elev_flag": "CASE WHEN elevation_m < 30 THEN 1 ELSE 0 END",
    "infra_socio": "infrastructure_score * socioeconomic_status_index",
    "water_veg_balance": "ndwi - ndvi",
    "ndvi_ndwi_product": "ndvi * ndwi",
    "ndwi_sq": "ndwi * ndwi",
    "drainage_x_rain": "drainage_index * rainfall_7d_mm",
    "bad_drainage_rain": "CASE WHEN drainage_index < 0.35 THEN 1 ELSE 0 END * rainfall_7d_mm",
    "urban_runoff": "built_up_percent * rainfall_7d_mm / 100",
    "evac_hosp_sum": "nearest_hospital_km + nearest_evac_km",
    "max_dist_help": "greatest(nearest_hospital_km, nearest_evac_km)",
    "pop_x_rain": "population_density_per_km2 * rainfall_7d_mm",
    "pop_x_flood": "population_density_per_km2 * historical_flood_count",
    "extreme_x_rain": "extreme_weather_index * rainfall_7d_mm",
    "extreme_x_flood": "extreme_weather_index * historical_flood_count",
    "extreme_x_monthly": "extreme_weather_index * monthly_rainfall_mm",
    "seasonal_rain": "seasonal_index * rainfall_7d_mm",
    "seasonal_extreme": "seasonal_index * extreme_weather_index",
    "terrain_rain": "terrain_roughness_index * rainfall_7d_mm",
    "inundation_x_rain": "inundation_area_sqm * rainfall_7d_mm",
    "log_inundation_x_extreme": "ln(1 + inundation_area_sqm) * extreme_weather_index",
    "composite_vuln": "rainfall_7d_mm * 0.3 + historical_flood_count * 15.0 + extreme_weather_index * 50.0"
                      " + (1 - drainage_index) * 30.0 + built_up_percent * 0.1",
}
FLAGS = {"low_elev_flag", "very_low_elevation_flag", "neg_elev_flag", "ndwi_positive", "ndvi_negative",
         "rough_terrain_flag", "poor_drainage_flag"}


def block_oracle(block: dict[str, str]) -> str:
    columns = ", ".join(f"{text} AS {name}" for name, text in block.items())
    return tidy_sql(over_obs(f"SELECT record_id, {columns} FROM obs"), [n for n in block if n not in FLAGS])


@query("interaction_features", block_oracle(INTERACTIONS_SQL))
def interaction_features(spark, folder):
    obs = observations(spark, folder)
    return tidy(obs.select("record_id", *[x.alias(n) for n, x in fx.interactions().items()]))


EXTENDED_SQL = {
    "very_low_elevation_flag": "CASE WHEN elevation_m < 10 THEN 1 ELSE 0 END",
    "neg_elev_flag": "CASE WHEN elevation_m < 0 THEN 1 ELSE 0 END",
    "elev_x_river": "(CASE WHEN elevation_m < 0 THEN 0 ELSE elevation_m END + 1) * (greatest(distance_to_river_m, 0) + 1)",
    "river_x_elevation": "greatest(distance_to_river_m, 0) * CASE WHEN elevation_m < 0 THEN 0 ELSE elevation_m END",
    "infra_per_pop": "infrastructure_score / (population_density_per_km2 + 1)",
    "vulnerability_index": "(100 - infrastructure_score) / (socioeconomic_status_index + 0.000001)",
    "ndvi_sq": "ndvi * ndvi",
    "ndwi_positive": "CASE WHEN ndwi > 0 THEN 1 ELSE 0 END",
    "ndvi_negative": "CASE WHEN ndvi < 0 THEN 1 ELSE 0 END",
    "rough_terrain_flag": "CASE WHEN terrain_roughness_index > 1.5 THEN 1 ELSE 0 END",
    "drainage_rain_ratio": "drainage_index / (rainfall_7d_mm + 1)",
    "poor_drainage_flag": "CASE WHEN drainage_index < 0.35 THEN 1 ELSE 0 END",
    "poor_drainage_rain": "CASE WHEN drainage_index < 0.4 THEN 1 ELSE 0 END * rainfall_7d_mm",
    "log_built_up": "ln(1 + built_up_percent)",
    "min_distance_to_help": "least(nearest_hospital_km, nearest_evac_km)",
    "extreme_x_pop": "extreme_weather_index * population_density_per_km2",
    "seasonal_monthly": "seasonal_index * monthly_rainfall_mm",
    "log_inundation_x_rain": "ln(1 + inundation_area_sqm) * rainfall_7d_mm",
    "composite_unit": "rainfall_7d_mm * 0.3 + historical_flood_count * 0.2 + extreme_weather_index * 0.2"
                      " + (1 - drainage_index) * 0.15 + built_up_percent * 0.0015",
    "composite_mid": "rainfall_7d_mm * 0.25 + historical_flood_count * 15.0 + extreme_weather_index * 50.0"
                     " + (1 - drainage_index) * 30.0 + built_up_percent * 0.1",
    "flood_exposure": "rainfall_7d_mm * (historical_flood_count + 1) / (drainage_index *"
                      " CASE WHEN elevation_m IS NULL THEN NULL ELSE greatest(elevation_m, 1) END + 0.000001)",
    "flood_exposure_score": "rainfall_7d_mm * historical_flood_count / (drainage_index *"
                            " CASE WHEN elevation_m IS NULL THEN NULL ELSE greatest(elevation_m, 1) END + 0.000001)",
    "log_distance_river": "ln(1 + greatest(distance_to_river_m, 0))",
    "log_pop_density": "ln(1 + greatest(population_density_per_km2, 0))",
    "log_elevation": "ln(1 + CASE WHEN elevation_m < 0 THEN 0 ELSE elevation_m END)",
    "log_rainfall_7d": "ln(1 + rainfall_7d_mm)",
    "log_monthly_rain": "ln(1 + monthly_rainfall_mm)",
}


@query("extended_features", block_oracle(EXTENDED_SQL))
def extended_features(spark, folder):
    obs = observations(spark, folder)
    return tidy(obs.select("record_id", *[x.alias(n) for n, x in fx.extended_interactions().items()]))


TRANSFORMED_SQL = {
    "log_rain_x_flood": "rainfall_7d_mm_log1p * historical_flood_count",
    "log_rain_x_extreme": "rainfall_7d_mm_log1p * extreme_weather_index",
    "log_river_x_rain": "distance_to_river_m_log1p * rainfall_7d_mm",
    "log_river_x_extreme": "distance_to_river_m_log1p * extreme_weather_index",
    "log_pop_x_rain": "population_density_per_km2_log1p * rainfall_7d_mm",
    "ndwi_qmap_x_rain": "ndwi_qmap * rainfall_7d_mm",
    "yj_elev_x_rain": "elevation_m_yeojohnson * rainfall_7d_mm",
}


@query("transformed_interactions", block_oracle(TRANSFORMED_SQL))
def transformed_interactions(spark, folder):
    obs = observations(spark, folder)
    block = fx.transformed_interactions(obs.columns)
    return tidy(obs.select("record_id", *[x.alias(n) for n, x in block.items()]))


@query("logit_target", tidy_sql(over_obs("""
SELECT record_id, z AS logit_target, 1 / (1 + exp(-z)) AS back FROM (
  SELECT record_id, ln(p / (1.0 - p)) AS z FROM (
    SELECT record_id, least(greatest(flood_risk_score, 0.000001), 0.999999) AS p FROM obs))"""),
    ["logit_target", "back"], 9))
def logit_target(spark, folder):
    obs = observations(spark, folder).select("record_id", logit(c(TARGET)).alias("logit_target"))
    return tidy(obs.withColumn("back", sigmoid(c("logit_target"))), 9)


@query("risk_scores", tidy_sql(over_obs(f"""
SELECT record_id, score AS heuristic, {level_sql('score')} AS risk_level,
  least(greatest(0.90 - drainage_index * 0.20 - infrastructure_score * 0.15 + nearest_evac_km * 0.01
    + nearest_hospital_km * 0.005 - distance_to_river_m * 0.00002 + built_up_percent * 0.001, 0), 1) AS linear,
  least(greatest(0.1 + rainfall_7d_mm * 0.001 + drainage_index * -0.2, 0), 1) AS fitted
FROM (SELECT *, {heuristic_sql(model_version="'v13'")} AS score FROM obs)"""), ["heuristic", "linear", "fitted"]))
def risk_scores(spark, folder):
    obs = observations(spark, folder)
    fitted = linear_combination({"rainfall_7d_mm": 0.001, "drainage_index": -0.2}, 0.1)
    plain_score = score(lambda read: heuristic_score(read, versioned=False))
    return tidy(
        obs.select(
            "record_id", plain_score.alias("heuristic"), risk_level(plain_score).alias("risk_level"),
            score(linear_score).alias("linear"),
            F.least(F.greatest(score(fitted), F.lit(0.0)), F.lit(1.0)).alias("fitted"),
        )
    )


@query("impute_median", tidy_sql(over_obs(
    "SELECT split, record_id, " + ", ".join(f"coalesce({n}, m_{n}) AS {n}" for n in NUMERIC_INPUTS)
    + " FROM obs, (SELECT " + ", ".join(f"median({n}) AS m_{n}" for n in NUMERIC_INPUTS)
    + " FROM train)"), NUMERIC_INPUTS))
def impute_median(spark, folder):
    obs = materialize(observations(spark, folder).select("split", "record_id", *NUMERIC_INPUTS))
    fill = ordering.medians(labelled(obs), NUMERIC_INPUTS)
    return tidy(obs.fillna(fill))


@query("impute_median_union", tidy_sql(over_obs(
    "SELECT record_id, " + ", ".join(f"coalesce({n}, median({n}) OVER ()) AS {n}" for n in NUMERIC_INPUTS)
    + " FROM obs"), NUMERIC_INPUTS))
def impute_median_union(spark, folder):
    obs = materialize(observations(spark, folder).select("record_id", *NUMERIC_INPUTS))
    fill = ordering.medians(obs, NUMERIC_INPUTS)
    return tidy(obs.fillna(fill))


@query("impute_constant", tidy_sql(over_obs("""
SELECT record_id, coalesce(landcover, 'missing') AS landcover,
  coalesce(reason_not_good_to_live, 'Other') AS reason_not_good_to_live,
  coalesce(rainfall_7d_mm, 0) AS rainfall_7d_mm FROM obs"""), ["rainfall_7d_mm"]))
def impute_constant(spark, folder):
    obs = observations(spark, folder)
    filled = obs.fillna({"landcover": "missing", "reason_not_good_to_live": "Other", "rainfall_7d_mm": 0.0})
    return tidy(filled.select("record_id", "landcover", "reason_not_good_to_live", "rainfall_7d_mm"))


SCALED = NUMERIC_INPUTS


@query("standard_scale", tidy_sql(over_obs(
    "SELECT record_id, " + ", ".join(f"({n} - m_{n}) / s_{n} AS {n}_z" for n in SCALED)
    + " FROM obs, (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in SCALED)
    + " FROM train)"), [f"{n}_z" for n in SCALED]))
def standard_scale(spark, folder):
    obs = observations(spark, folder)
    stats = encoding.scaling_stats(labelled(obs), SCALED)
    return tidy(encoding.standard_scale(obs.select("record_id", *SCALED), stats).drop(*SCALED))


@query("column_selection", tidy_sql(over_obs("""
SELECT elevation_m, distance_to_river_m, rainfall_7d_mm, flood_risk_score, number FROM obs"""),
    ["elevation_m", "distance_to_river_m", "rainfall_7d_mm", "flood_risk_score"]))
def column_selection(spark, folder):
    obs = observations(spark, folder)
    kept = fx.without(obs, names=["fold"], patterns=["_log1p", "_yeojohnson", "_qmap", "_index", "_km", "nd"])
    kept = kept.select(*fx.numeric_columns(kept))
    return tidy(
        fx.without(
            kept,
            names=["monthly_rainfall_mm", "infrastructure_score", "built_up_percent", "historical_flood_count",
                   "inundation_area_sqm"],
        )
    )


def feature_table(obs, features=FEATURES_108, serving=False):
    """Encoded, imputed and ordered features with id, target, fold and split.

    Training rows get fold-safe encodings, test rows those of all training rows.
    """
    obs = materialize(obs)
    codes = encoding.label_codes(obs, CATEGORICAL)
    both = encoding.fold_safe_encode(obs, TARGET_ENCODINGS, TARGET, "fold", train=c("split") == "train")
    # The meta block reads the raw categories, so the codes replace them last.
    both = encoding.apply_codes(both, codes, CATEGORICAL, suffix="_code")
    both = fx.engineer(both, fx.FALLBACK_DATE, record_number=not serving)
    both = fx.add(both, fx.encoding_products(both.columns)).drop(*CATEGORICAL)
    both = both.withColumnsRenamed({f"{n}_code": n for n in CATEGORICAL})
    # Written once, without what no feature needs: the medians and the result both read it.
    keep = ["record_id", "split", "fold", TARGET]
    numeric = [n for n in features if n in both.columns]
    both = materialize(both.select(*dict.fromkeys([*keep, *numeric])))
    fill = ordering.medians(labelled(both), numeric)
    return fx.align(both, features, fill, keep=keep)


def matrix_sql() -> str:
    """The same features in SQL: encodings, codes, blocks, then medians for the gaps."""
    te = [f"{n}_te" for n, _ in TARGET_ENCODINGS]
    river = {"river_clip": "greatest(distance_to_river_m, 0)"}
    products = ", ".join(f"{e}_te * {river.get(f, f)} AS {name}" for f, e, name in ENCODING_PRODUCTS)
    codes, joins = [], ""
    for n in CATEGORICAL:
        codes.append(f"CAST(k_{n}.code AS DOUBLE) AS c_{n}")
        joins += f""" LEFT JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (
          SELECT DISTINCT coalesce({n}, 'nan') AS category FROM obs)) k_{n} ON k_{n}.category = coalesce(b.{n}, 'nan')"""
    blocks = ", ".join(f"{text} AS {name}" for name, text in INTERACTIONS_SQL.items())
    source = {n: f"c_{n}" for n in CATEGORICAL}
    present = [n for n in FEATURES_108 if n not in ABSENT]
    shown = ", ".join(
        f"CAST(0 AS FLOAT) AS {n}" if n in ABSENT
        else f"CAST(coalesce({source.get(n, n)}, m_{n}) AS FLOAT) AS f_{n}" for n in FEATURES_108
    )
    medians = ", ".join(f"median({source.get(n, n)}) AS m_{n}" for n in present)
    renamed = ", ".join(n if n in ABSENT else f"f_{n} AS {n}" for n in FEATURES_108)
    return over_obs(f"SELECT record_id, split, fold, flood_risk_score, {renamed} FROM (SELECT record_id, split, fold, flood_risk_score, {shown} FROM f, med)", f""",
te AS MATERIALIZED (SELECT record_id, {', '.join(te)} FROM ({fold_te_sql(TARGET_ENCODINGS)})
  UNION ALL SELECT record_id, {', '.join(te)} FROM ({full_te_sql('test')})),
f AS MATERIALIZED (SELECT b.*, {', '.join(te)}, {products}, {', '.join(codes)}
  FROM (SELECT *, {blocks} FROM ({meta_sql(True)})) b JOIN te ON te.record_id = b.record_id{joins}),
med AS MATERIALIZED (SELECT {medians} FROM f WHERE split = 'train')""")


ABSENT = ["latitude", "longitude", "monthly_rainfall_mm_log1p", "nearest_hospital_km_log1p", "nearest_evac_km_log1p",
          "drainage_index_yeojohnson", "ndvi_qmap", "built_up_percent_qmap"]


@query("feature_matrix", tidy_sql(matrix_sql(), [*FEATURES_108, TARGET], 4))
def feature_matrix(spark, folder):
    """All 108 features of every observation, as model input."""
    return tidy(feature_table(observations(spark, folder)), 4)
