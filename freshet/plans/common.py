"""Shared parts of the registered queries and of the SQL they are checked with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.constants import (
    DISTRICT_DEFAULTS, DISTRICTS, GENERIC_DEFAULTS, MODEL_VERSIONS, NUMERIC_INPUTS, VERSION_FACTORS,
)
from freshet.functions.scalars import EXACT
from freshet.sources.tables import STAND_IN_MODELS

DIGITS = 6
# Values are cut where no short decimal falls, so a sum in another order lands on the same side.
CUT = 0.41421356


def tidy(df: DataFrame, digits: int = DIGITS, columns: list[str] | None = None) -> DataFrame:
    """Cuts fractional columns (all, or the listed ones), so that sums in another order compare equal.

    Not-a-number, infinities and values too large to hold such digits stay as they are.
    """
    scale = 10**digits
    large = f"{EXACT / scale!r}D"
    return df.select(
        *[
            F.expr(f"CASE WHEN abs(`{n}`) < {large} THEN floor(`{n}` * {scale}D + {CUT}D) / {scale}D ELSE `{n}` END").alias(n)
            if kind in ("double", "float") and (columns is None or n in columns) else F.col(n)
            for n, kind in df.dtypes
        ]
    )


def sql(text: str) -> str:
    """Marks decimal literals as doubles, outside of quoted text."""
    return re.sub(
        r"'[^']*'|(?<![\w.])\d+\.\d+(?![\w.])",
        lambda m: m.group(0) if m.group(0).startswith("'") else m.group(0) + "e0",
        text,
    )


def tidy_sql(text: str, columns: list[str], digits: int = DIGITS) -> str:
    """The same rounding in SQL for the listed columns; a WITH clause may lead."""
    scale = f"1e{digits}"
    rounded = ", ".join(f"floor({n}*{scale}+{CUT}e0)/{scale} AS {n}" for n in columns)
    return f"SELECT * REPLACE ({rounded}) FROM ({sql(text)})"


def rnd(text: str, digits: int) -> str:
    return f"(floor(({text})*1e{digits}+0.5e0)/1e{digits})"


def array_text(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OBS = f"""
la AS MATERIALIZED (
  SELECT l_orderkey, sum(l_quantity) AS qty,
         CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc,
         CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax,
         CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS cents,
         count(*) AS lines, CAST(max(l_linenumber) AS DOUBLE) AS last_line,
         max(l_discount) AS max_disc, min(l_tax) AS min_tax,
         min(l_partkey) AS pk, min(l_suppkey) AS sk
  FROM lineitem GROUP BY l_orderkey),
obs AS MATERIALIZED (
  SELECT concat('F', CAST(o_orderkey AS VARCHAR)) AS record_id, o_orderkey AS number,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS generation_date,
    {array_text(DISTRICTS)}[n_nationkey + 1] AS district, c_name AS place_name,
    p_type AS landcover, c_mktsegment AS soil_type, p_brand AS water_supply,
    CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS electricity,
    o_orderpriority AS road_quality,
    CASE WHEN p_size IS NULL THEN NULL WHEN p_size > 25 THEN 'Urban' ELSE 'Rural' END AS urban_rural,
    CASE WHEN s_acctbal IS NULL THEN NULL WHEN s_acctbal < 0 THEN 'Yes' ELSE 'No' END AS water_presence_flag,
    CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS flood_occurrence_current_event,
    CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS is_good_to_live,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'High flood risk; Poor infrastructure'
         WHEN o_orderpriority LIKE '2%' THEN 'No road access'
         WHEN o_orderpriority LIKE '3%' THEN NULL ELSE 'Other' END AS reason_not_good_to_live,
    qty AS rainfall_7d_mm, qty + p_size * 4 AS monthly_rainfall_mm,
    s_acctbal / 10 AS elevation_m, c_acctbal AS distance_to_river_m,
    disc / (lines * 10.0) AS drainage_index, tax / (lines * 8.0) AS infrastructure_score,
    p_size / 2.0 AS nearest_hospital_km, last_line AS nearest_evac_km, p_size * 2.0 AS built_up_percent,
    o_totalprice / 100 AS population_density_per_km2,
    disc / (lines * 5.0) - 1 AS ndvi, tax / (lines * 4.0) - 1 AS ndwi,
    max_disc * 10 AS extreme_weather_index, min_tax * 12.5 AS seasonal_index,
    p_size / 50.0 AS terrain_roughness_index, (c_acctbal + 1000) / 11000.0 AS socioeconomic_status_index,
    CAST(lines AS DOUBLE) AS historical_flood_count, cents / 100.0 AS inundation_area_sqm,
    CASE WHEN o_orderkey % 26 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS is_synthetic,
    ln(1 + qty) AS rainfall_7d_mm_log1p, ln(1 + greatest(c_acctbal, 0)) AS distance_to_river_m_log1p,
    ln(1 + o_totalprice / 100) AS population_density_per_km2_log1p,
    tax / (lines * 8.0) - 0.5 AS ndwi_qmap,
    CASE WHEN s_acctbal / 10 >= 0 THEN ln(1 + s_acctbal / 10) ELSE s_acctbal / 10 END AS elevation_m_yeojohnson,
    least(greatest(o_totalprice * 0.5 / 500000.0 + coalesce(qty, 0) * 0.3 / 350.0
          + (1.0 - coalesce(disc / (lines * 10.0), 0)) * 0.2, 0), 1) AS flood_risk_score,
    CAST((o_orderkey * 7919 + 42) % 5 AS INT) AS fold,
    CASE WHEN o_orderkey % 5 = 4 THEN 'test' ELSE 'train' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN la ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk
  LEFT JOIN supplier ON s_suppkey = sk),
train AS MATERIALIZED (SELECT * FROM obs WHERE split = 'train'),
test AS MATERIALIZED (SELECT * FROM obs WHERE split = 'test')
"""


def over_obs(text: str, more: str = "") -> str:
    """A query over the observations."""
    return f"WITH {OBS}{more} {text}"


def _defaults() -> str:
    rows = [
        "('" + d + "', " + ", ".join(f"{float(v)!r}" for v in values) + ")"
        for d, values in DISTRICT_DEFAULTS.items()
    ]
    names = ", ".join(f"d_{n}" for n in NUMERIC_INPUTS)
    return f"defaults(d_district, {names}) AS (VALUES {', '.join(rows)})"


OVERRIDES = [
    # Measure, and which requests override it (number % step = rest).
    ("rainfall_7d_mm", 2, 0), ("drainage_index", 3, 1), ("elevation_m", 4, 2),
    ("infrastructure_score", 5, 3), ("nearest_hospital_km", 3, 2), ("nearest_evac_km", 4, 1),
    ("built_up_percent", 6, 5), ("historical_flood_count", 7, 3),
]


def _scenarios() -> str:
    some = ", ".join(f"CASE WHEN number % {s} = {r} THEN {n} END AS {n}" for n, s, r in OVERRIDES)
    over = {n for n, _, _ in OVERRIDES}
    filled = ", ".join(
        f"coalesce({'r.' + n + ', ' if n in over else ''}d_{n}, {float(g)!r}) AS {n}"
        for n, g in zip(NUMERIC_INPUTS, GENERIC_DEFAULTS)
    )
    return f"""
requests AS MATERIALIZED (
  SELECT number, CASE WHEN number % 11 = 0 THEN 'Atlantis' ELSE district END AS district,
    {array_text(MODEL_VERSIONS)}[number % 3 + 1] AS model_version, {some},
    ['Low', 'Medium', 'High', 'Critical'][number % 4 + 1] AS target_risk_level,
    ['low_cost', 'balanced', 'aggressive'][(number // 3) % 3 + 1] AS budget_profile,
    CAST(number % 7 AS INT) AS max_steps, number % 5 = 0 AS narrow
  FROM obs),
{_defaults()},
scen AS MATERIALIZED (
  SELECT r.number, r.district, r.model_version, r.target_risk_level, r.budget_profile, r.max_steps, r.narrow,
    {filled}
  FROM requests r LEFT JOIN defaults ON r.district = d_district)
"""


SCENARIOS = _scenarios()


def over_scenarios(text: str, more: str = "") -> str:
    """A query over complete scenario rows."""
    return f"WITH {OBS}, {SCENARIOS}{more} {text}"


def heuristic_sql(**other: str) -> str:
    """The heuristic score; `other` names the text to read a feature from."""
    g = lambda n: other.get(n, n)
    factors = " ".join(f"WHEN '{v}' THEN {f!r}" for v, f in VERSION_FACTORS.items())
    return f"""least(greatest((0.40 + (coalesce({g('rainfall_7d_mm')}, 50) - 50) / 1500.0 * 0.15
      - (coalesce({g('drainage_index')}, 0.5) - 0.5) * 0.12
      - least((coalesce({g('elevation_m')}, 30) - 30) / 500.0, 0.1) * 0.08
      - least((coalesce({g('distance_to_river_m')}, 500) - 500) / 5000.0, 0.1) * 0.06
      - (coalesce({g('infrastructure_score')}, 0.5) - 0.5) * 0.08
      + (coalesce({g('historical_flood_count')}, 2) - 2) * 0.02
      + (coalesce({g('extreme_weather_index')}, 0.3) - 0.3) * 0.10
      + greatest((coalesce({g('nearest_hospital_km')}, 5) - 5) / 50.0, 0) * 0.04)
      * CASE {g('model_version')} {factors} ELSE 1.0 END, 0), 1)"""


def level_sql(score: str) -> str:
    return (f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} < 0.25 THEN 'Low' WHEN {score} < 0.5 THEN 'Medium' "
            f"WHEN {score} < 0.75 THEN 'High' ELSE 'Critical' END")


def _stand_ins() -> str:
    models = ", ".join(f"('{n}', {a!r}, {b!r}, {s}, {t})" for n, a, b, s, t in STAND_IN_MODELS)
    return f"""
models(model, share, spread, step, shift) AS (VALUES {models}),
preds AS MATERIALIZED (
  SELECT record_id, number, split, fold, flood_risk_score AS y, model,
    flood_risk_score * CAST(share AS DOUBLE) + 0.45 * (1 - CAST(share AS DOUBLE))
      + ((number * step + shift) % 1009 / 1009.0 - 0.5) * CAST(spread AS DOUBLE) AS pred
  FROM obs, models)
"""


def over_predictions(text: str, more: str = "") -> str:
    """A query over the stand-in predictions."""
    return f"WITH {OBS}, {_stand_ins()}{more} {text}"
