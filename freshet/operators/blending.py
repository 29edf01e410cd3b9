"""Combining the predictions of several models.

Predictions live in one long table: record_id, split, model, (seed, repeat, fold,) pred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import clip_unit
from freshet.operators.ordering import ordinal_positions, slices
from freshet.operators.stats import prediction_metrics

c = F.col


def average_predictions(preds: DataFrame, by: list[str]) -> DataFrame:
    """Mean prediction per row over seeds, repeats or folds."""
    return preds.groupBy(*by).agg(F.avg("pred").alias("pred"), F.count("pred").alias("parts"))


def stack(preds: DataFrame, models: list[str], ids: list[str]) -> DataFrame:
    """One row per record, one column per model; a model that has a record twice stops the job."""
    own = lambda m: F.when(c("model") == m, c("pred"))
    return preds.where(c("model").isin(models)).groupBy(*ids).agg(
        *[only_one(F.max(own(m)), F.count(own(m)), m).alias(m) for m in models]
    )


def only_one(value: Column, rows: Column, name: str) -> Column:
    return F.when(rows <= 1, value).otherwise(F.raise_error(F.lit(f"{name} holds a record more than once")))


def aligned(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Prediction tables side by side, matched on the key, not on the row order.

    A key that a table lacks or repeats stops the job; counting is part of the join's own shuffle.
    """
    out = None
    for name, table in tables.items():
        rows = F.count(F.lit(1))
        side = table.groupBy(key).agg(only_one(F.max(value), rows, name).alias(name), rows.alias(f"_{name}"))
        out = side if out is None else out.join(side, key, "full")
    checked = [
        F.when(c(f"_{name}").isNull(), F.raise_error(F.lit(f"{name} lacks a record"))).otherwise(c(name)).alias(name) for name in tables
    ]
    return out.select(key, *checked)


def check_one_to_one(tables: dict[str, DataFrame], key: str) -> None:
    """Refuse tables that are empty, repeat a key or cover different keys."""
    seen = None
    for name, table in tables.items():
        side = table.select(key).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        seen = side if seen is None else seen.join(side, key, "full")
    bad = seen.where(" OR ".join(f"coalesce(`{n}`, 0) <> 1" for n in tables))
    if seen.isEmpty():
        raise ValueError("the prediction tables are empty")
    if not bad.isEmpty():
        raise ValueError("the prediction tables do not hold the same keys once each")


def weighted_blend(wide: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Adds the weighted sum of prediction columns."""
    total = None
    for model, weight in weights.items():
        term = c(model) * F.lit(float(weight))
        total = term if total is None else total + term
    return wide.withColumn(name, total)


def mean_blend(wide: DataFrame, models: list[str], name: str) -> DataFrame:
    total = c(models[0])
    for model in models[1:]:
        total = total + c(model)
    return wide.withColumn(name, total / float(len(models)))


def geometric_blend(wide: DataFrame, models: list[str], name: str) -> DataFrame:
    """The n-th root of the product of n predictions."""
    total = c(models[0])
    for model in models[1:]:
        total = total * c(model)
    return wide.withColumn(name, F.pow(total, F.lit(1.0 / len(models))))


def weight_sweep(wide: DataFrame, first: str, second: str, weights: list[float], ids: list[str]) -> DataFrame:
    """One row per weight of `second`: (ids, weight, pred), clipped to [0, 1]."""
    rows = wide.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    mix = (F.lit(1.0) - c("weight")) * c(first) + c("weight") * c(second)
    return rows.select(*ids, "weight", clip_unit(mix).alias("pred"))


def model_scores(labelled: DataFrame) -> DataFrame:
    """(model, rmse, r2, rows): one row per model."""
    return prediction_metrics(labelled, ["model"])


def inverse_error_weights(scores: DataFrame, least_r2: float | None = None) -> DataFrame:
    """(model, weight): weights in proportion to 1/RMSE, summing to 1."""
    if least_r2 is not None:
        scores = scores.where(c("r2") > least_r2)
    everything = Window.partitionBy(F.lit(1))  # one row per model
    share = 1.0 / c("rmse") / F.sum(1.0 / c("rmse")).over(everything)
    return scores.select("model", share.alias("weight"))


def blend_by_weights(preds: DataFrame, weights: DataFrame, ids: list[str]) -> DataFrame:
    """Weighted mean per record over the models that predict it.

    `weights` has one row per model and is broadcast, so predictions are not shuffled by model;
    models without a weight take no part.
    """
    used = F.when(c("pred").isNotNull(), c("weight"))
    return preds.join(F.broadcast(weights), "model").groupBy(*ids).agg(
        F.try_divide(F.sum(c("pred") * c("weight")), F.sum(used)).alias("pred")
    )


def best_by_rmse(scores: DataFrame) -> DataFrame:
    """The candidate with the lowest RMSE; the first name among equals."""
    return scores.orderBy("rmse", "model").limit(1)


def top_by_rmse(scores: DataFrame, count: int) -> DataFrame:
    return scores.orderBy("rmse", "model").limit(count).select("model", "rmse")


def best_of_family(scores: DataFrame, prefix: str) -> DataFrame:
    """The model of a family with the highest R2."""
    return scores.where(c("model").startswith(prefix)).orderBy(c("r2").desc(), "model").limit(1)


def top_weights(weights: DataFrame, count: int) -> DataFrame:
    """Model weights by size, whatever their sign."""
    return weights.orderBy(F.abs("weight").desc(), "model").limit(count)


def family_counts(models: DataFrame) -> DataFrame:
    """(family, models): the family is the name up to the first underscore."""
    names = models.select("model").distinct()
    return names.groupBy(F.split("model", "_")[0].alias("family")).agg(
        F.count(F.lit(1)).alias("models")
    )


def rank_average(preds: DataFrame, groups: list[str], ids: str) -> DataFrame:
    """Mean over models of each record's rank (from 0) divided by the number of rows.

    `groups` are the columns to rank within and must hold `model`.
    """
    placed = ordinal_positions(preds, groups, "pred", ids)
    keep = [g for g in groups if g != "model"]
    placed = placed.repartition(slices(preds, preds.count()), *keep, ids)
    return placed.groupBy(*keep, ids).agg(F.avg(c("position") / c("rows")).alias("rank"))
