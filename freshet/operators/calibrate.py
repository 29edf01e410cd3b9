"""Mapping predictions onto the distribution of the target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.operators.ordering import (
    group_quantiles, ordinal_positions, slices, value_ladder,
)

c = F.col


def ordered_values(df: DataFrame, value: str, key: str) -> DataFrame:
    """(position, here, next): every value by its place, with its successor."""
    placed = ordinal_positions(df.withColumn("_all", F.lit(0)), ["_all"], value, key)
    placed = materialize(placed.select("position", c(value).alias("_v")))
    # Each value is sent to its own place and, as successor, to the one before.
    pairs = placed.select(
        F.explode(
            F.array(
                F.struct(c("position").alias("position"), c("_v").alias("here"), F.lit(None).cast("double").alias("next")),
                F.struct((c("position") - 1).alias("position"), F.lit(None).cast("double").alias("here"), c("_v").alias("next")),
            )
        ).alias("_p")
    ).select("_p.*")
    pairs = pairs.where(c("position") >= 0).repartition(slices(placed, placed.count()), "position")
    return pairs.groupBy("position").agg(
        F.max("here").alias("here"), F.max("next").alias("next")
    )


def remap_ranks(ranked: DataFrame, target: DataFrame, value: str, key: str) -> DataFrame:
    """Adds `pred`: the target value at each rank in [0, 1], interpolated."""
    places = ordered_values(target, value, key)
    rows = target.where(c(value).isNotNull()).count()
    last = rows - 1
    at = ranked.withColumn("_spot", F.least(c("rank"), F.lit(1.0)) * last).withColumn(
        "position", F.floor("_spot")
    )
    joined = at.repartition(slices(target, rows), "position").join(places, "position", "left")
    mixed = c("here") + (F.coalesce("next", "here") - c("here")) * (c("_spot") - c("position"))
    return joined.withColumn("pred", mixed).drop("_spot", "position", "here", "next")


def quantile_calibrate(
    preds: DataFrame, pred: str, reference: DataFrame, ref_pred: str, ref_target: str, key: str,
    name: str = "calibrated",
) -> DataFrame:
    """Moves each prediction to the target value at its place among the reference predictions.

    Between two reference predictions the target is interpolated; outside it is
    the first or last target. Distinct predictions are placed once, by counting
    the reference values up to them; values are then fetched by place.
    """
    wanted = preds.select(c(pred).alias("_x"), F.lit(0).alias("_w"))
    known = reference.select(c(ref_pred).alias("_x"), F.lit(1).alias("_w"))
    both = known.unionByName(wanted).withColumn("_all", F.lit(0))
    ladder = value_ladder(both, ["_all"], "_x", weight=c("_w"))
    # The last reference prediction that is not above x; -1 where there is none.
    placed = ladder.select("_x", (c("below") + c("ties") - 1).alias("_j"), "rows")
    asked = preds.where(c(pred).isNotNull()).groupBy(c(pred).alias("_x")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    asked = asked.join(placed, "_x").withColumn(
        "position", F.greatest(c("_j"), F.lit(0)).cast("bigint")
    )
    xs = ordered_values(reference, ref_pred, key)
    ys = ordered_values(reference, ref_target, key)
    knots = xs.withColumnsRenamed({"here": "_x0", "next": "_x1"}).join(
        ys.withColumnsRenamed({"here": "_y0", "next": "_y1"}), "position"
    )
    share = (c("_x") - c("_x0")) / (c("_x1") - c("_x0"))
    value = (
        F.when((c("_j") < 0) | c("_x1").isNull() | (c("_x") <= c("_x0")), c("_y0"))
        .when(c("_x1") > c("_x0"), c("_y0") + (c("_y1") - c("_y0")) * share)
        .otherwise(c("_y0"))
    )
    mapped = materialize(
        asked.join(knots, "position", "left").select(c("_x").alias(pred), value.alias(name), "_rows")
    )
    return lookup(preds, mapped, [pred], weight="_rows")


def quantile_knots(df: DataFrame, x: str, y: str, knots: int) -> tuple[list[float], list[float]]:
    """Quantiles of x and of y at evenly spaced probabilities, as two short lists."""
    wanted = {f"q{i}": i / (knots - 1) for i in range(knots)}
    both = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("double").alias("value")) for n in (x, y)])
        ).alias("_v")
    ).select("_v.*")
    rows = {r["column"]: r for r in group_quantiles(both, ["column"], "value", wanted).collect()}
    return tuple([rows[n][q] for q in wanted] for n in (x, y))


def interpolate(df: DataFrame, x: str, xs: list[float], ys: list[float], name: str) -> DataFrame:
    """Piecewise linear lookup in a bounded list of knots, ends clamped."""
    knots_x, knots_y = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)

    @F.pandas_udf("double")
    def lookup_knots(values: pd.Series) -> pd.Series:
        out = pd.Series(np.interp(values.to_numpy(), knots_x, knots_y), index=values.index)
        return out.where(values.notna())

    return df.withColumn(name, lookup_knots(c(x)))
