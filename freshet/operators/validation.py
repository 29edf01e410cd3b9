"""Range and vocabulary rules over request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.constants import (
    NUMERIC_BOUNDS, REQUEST_NUMERIC_DEFAULTS, SCENARIO_TEXT_DEFAULTS, VOCABULARIES,
)

c = F.col


def rules(
    columns: list[str],
    bounds: list[tuple] = NUMERIC_BOUNDS,
    vocabularies: dict[str, list[str]] = VOCABULARIES,
) -> dict[str, Column]:
    """Rule name -> condition that breaks it, for the columns there are."""
    broken = {}
    for name, low, high in bounds:
        if name not in columns:
            continue
        if low is not None:
            broken[f"{name}>={low}"] = c(name) < low
        if high is not None:
            broken[f"{name}<={high}"] = c(name) > high
    for name, values in vocabularies.items():
        if name in columns:
            broken[f"{name} in list"] = ~c(name).isin(values)
    return broken


def with_defaults(df: DataFrame) -> DataFrame:
    """Absent values of a request become the request defaults."""
    fill = {**SCENARIO_TEXT_DEFAULTS, **REQUEST_NUMERIC_DEFAULTS, "model_version": "v13",
            "district": "Colombo"}
    return df.select(
        *[F.coalesce(c(n), F.lit(fill[n])).alias(n) if n in fill else c(n) for n in df.columns]
    )


def with_violations(df: DataFrame, broken: dict[str, Column] | None = None) -> DataFrame:
    """Adds the array of broken rules; an unknown value breaks none."""
    broken = rules(df.columns) if broken is None else broken
    checks = [F.when(condition, F.lit(name)) for name, condition in broken.items()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0)


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") > 0)


def violation_counts(df: DataFrame) -> DataFrame:
    """(rule, rows) of every broken rule."""
    return df.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("rows")
    )
