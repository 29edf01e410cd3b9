import math

import pytest
from pyspark.sql import functions as F

from freshet.functions import features as fx
from freshet.functions.scalars import (
    clip_low, clip_unit, flag, logit, nan_to_null, relative_reduction, risk_level, round_half_up, sigmoid,
)

c = F.col


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(-5.0, 1), (None, 2), (0.4, 3), (7.0, 4)], "x double, id int").orderBy("id")


def test_clip_keeps_null(numbers):
    assert values(numbers, clip_low(c("x"))) == [0.0, None, 0.4, 7.0]
    assert values(numbers, clip_unit(c("x"))) == [0.0, None, 0.4, 1.0]


def test_flag_of_unknown_is_zero(numbers):
    assert values(numbers, flag(c("x") < 1)) == [1, 0, 1, 0]


def test_row_maximum_skips_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    assert values(df, F.greatest("a", "b")) == [1.0, None, 3.0]


@pytest.mark.parametrize(
    "score,level",
    [(0.0, "Low"), (0.15, "Low"), (0.24, "Low"), (0.2499, "Low"), (0.25, "Medium"), (0.35, "Medium"),
     (0.49, "Medium"), (0.4999, "Medium"), (0.5, "High"), (0.65, "High"), (0.74, "High"), (0.7499, "High"),
     (0.75, "Critical"), (0.9, "Critical"), (1.0, "Critical"), (None, None)],
)
def test_level_borders(spark, score, level):
    df = spark.createDataFrame([(score,)], "s double")
    assert values(df, risk_level(c("s"))) == [level]


def test_logit_and_back(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (None,)], "p double")
    back = values(df, sigmoid(logit(c("p"))))
    assert back[:3] == pytest.approx([1e-6, 0.3, 1 - 1e-6], rel=1e-9)
    assert back[3] is None
    extreme = spark.createDataFrame([(-800.0,), (800.0,)], "z double")
    assert values(extreme, sigmoid(c("z"))) == [0.0, 1.0]


def test_reduction_guards_the_base(spark):
    df = spark.createDataFrame([(0.5, 0.4), (0.0, 0.1)], "a double, b double")
    assert values(df, relative_reduction(c("a"), c("b"))) == pytest.approx([20.0, 0.0])


def test_rounding_and_nan(spark):
    df = spark.createDataFrame([(0.125,), (-1.5,), (float("nan"),)], "x double")
    assert values(df, round_half_up(nan_to_null(c("x")), 2)) == [0.13, -1.5, None]


RAW = {
    "record_id": "F12", "generation_date": "2024-12-25", "reason_not_good_to_live": None, "is_good_to_live": "Yes",
    "rainfall_7d_mm": 50.0, "monthly_rainfall_mm": 200.0, "drainage_index": 0.3, "infrastructure_score": 0.5,
    "elevation_m": -3.0, "distance_to_river_m": -10.0, "nearest_hospital_km": 5.0, "nearest_evac_km": 3.0,
    "built_up_percent": 30.0, "extreme_weather_index": 0.3, "seasonal_index": 0.5, "terrain_roughness_index": 0.2,
    "historical_flood_count": 2.0, "population_density_per_km2": 500.0, "ndvi": 0.3, "ndwi": 0.1,
    "socioeconomic_status_index": 0.5, "inundation_area_sqm": 1000.0,
}
KINDS = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in RAW.items())


def engineered(spark, fallback=None, **changes):
    rows = [tuple({**RAW, **changes}.values())]
    return fx.engineer(spark.createDataFrame(rows, KINDS), fallback).first()


def test_features_by_hand(spark):
    row = engineered(spark)
    assert (row.gen_month, row.gen_year, row.gen_quarter, row.gen_day_of_year) == (12, 2024, 4, 360)
    assert (row.is_ne_monsoon, row.is_sw_monsoon) == (1, 0)
    assert (row.reason_other_flag, row.reason_flood_flag, row.is_good_binary) == (1, 0, 1)
    assert row.record_id_num == 12
    assert row.river_clip == 0.0 and row.elev_clip == 0.0 and row.low_elev_flag == 1
    assert row.river_rain_risk == 50.0
    assert row.bad_drainage_rain == 50.0
    assert row.composite_vuln == pytest.approx(50 * 0.3 + 2 * 15 + 0.3 * 50 + 0.7 * 30 + 3)
    assert row.rain_ratio == pytest.approx(0.25, rel=1e-6)
    assert row.log_inundation_x_extreme == pytest.approx(math.log1p(1000) * 0.3)


def test_bad_and_missing_dates(spark):
    for date in ("not-a-date", None):
        assert engineered(spark, fx.FALLBACK_DATE, generation_date=date).gen_month == 6
        row = engineered(spark, generation_date=date)
        assert row.gen_month is None and row.is_ne_monsoon == 0


def test_logarithm_at_the_edge(spark):
    row = engineered(spark, inundation_area_sqm=-1.0)
    assert row.log_inundation is None
    assert math.isnan(row.sqrt_inundation)


def test_missing_values_stay_missing(spark):
    row = engineered(spark, elevation_m=None, rainfall_7d_mm=None)
    assert row.elev_clip is None and row.low_elev_flag == 0 and row.rain_cum is None


def test_optional_blocks(spark):
    assert fx.transformed_interactions(["rainfall_7d_mm"]) == {}
    assert set(fx.transformed_interactions(["ndwi_qmap"])) == {"ndwi_qmap_x_rain"}
    df = spark.createDataFrame([(0.5,)], "district_te double")
    block = fx.encoding_products(df.columns, [("rain", "district", "out")])
    assert values(df, block["out"]) == [0.0]


def test_alignment(spark):
    df = spark.createDataFrame([(None, 2), (3.0, 4)], "a double, b int")
    out = fx.align(df, ["b", "missing", "a", "unknown"], {"a": 9.0, "missing": 5.0})
    assert out.dtypes == [("b", "float"), ("missing", "float"), ("a", "float"), ("unknown", "float")]
    assert [tuple(r) for r in out.collect()] == [(2, 5, 9, 0), (4, 5, 3, 0)]


def test_feature_lists():
    from freshet.constants import FEATURES_108, FEATURES_115

    assert len(FEATURES_108) == len(set(FEATURES_108)) == 108
    assert len(FEATURES_115) == len(set(FEATURES_115)) == 115
    assert {*fx.meta_features(), *fx.interactions()} <= set(FEATURES_108) < set(FEATURES_115)
