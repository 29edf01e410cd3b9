"""The simulation log: building its rows and reporting on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.constants import SCORE_BINS, TRACKED_COLUMNS
from freshet.functions.scalars import risk_level, round_half_up

c = F.col


def log_rows(scored: DataFrame, inputs: list[str], at: Column | None = None) -> DataFrame:
    """One log row per scored request, with its whole input as JSON."""
    return scored.select(
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
        "model_version",
        F.coalesce(c("district"), F.lit("Unknown")).alias("district"),
        *[c(n).cast("double").alias(n) for n in TRACKED_COLUMNS],
        F.to_json(F.struct(*inputs)).alias("input_features_json"),
        "flood_risk_score",
        risk_level(c("flood_risk_score")).alias("risk_level"),
        c("inference_time_ms").cast("double").alias("inference_time_ms"),
    )


def bin_condition(low: float | None, high: float | None) -> Column:
    score = c("flood_risk_score")
    condition = F.lit(True)
    if low is not None:
        condition = condition & (score >= low)
    if high is not None:
        condition = condition & (score < high)
    return condition


def summary(log: DataFrame) -> DataFrame:
    """Totals, averages, score histogram and use counts, in one aggregate.

    An empty log gives one row of zeros.
    """
    zero = F.lit(0.0)
    return log.agg(
        F.count(F.lit(1)).alias("total_simulations"),
        F.coalesce(round_half_up(F.avg("inference_time_ms"), 2), zero).alias("avg_latency_ms"),
        F.coalesce(round_half_up(F.avg("flood_risk_score"), 4), zero).alias("avg_risk_score"),
        *[F.count_if(bin_condition(lo, hi)).alias(f"bin_{i}") for i, (_, lo, hi) in enumerate(SCORE_BINS)],
        *[F.count(n).alias(f"used_{n}") for n in TRACKED_COLUMNS],
    )


def histogram(totals: DataFrame) -> DataFrame:
    """(bin, rows) from the summary row."""
    rows = totals.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(name).alias("bin"), c(f"bin_{i}").alias("rows"))
                  for i, (name, _, _) in enumerate(SCORE_BINS)]
            )
        ).alias("_b")
    )
    return rows.select("_b.*")


def usage(totals: DataFrame) -> DataFrame:
    """(feature, uses) from the summary row."""
    names = [f"used_{n}" for n in TRACKED_COLUMNS]
    rows = totals.select(*names).unpivot([], names, "name", "uses")
    return rows.select(F.replace("name", F.lit("used_"), F.lit("")).alias("feature"), "uses")


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    """The latest rows of the log, newest first."""
    newest = log.orderBy(c("timestamp").desc(), c("id").desc()).limit(limit)
    return newest.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "district", "model_version",
        round_half_up(c("flood_risk_score"), 4).alias("flood_risk_score"), "risk_level",
        round_half_up(c("inference_time_ms"), 2).alias("inference_time_ms"),
    )
