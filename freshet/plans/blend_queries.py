"""Metrics, blends, ranks and calibration over the stand-in predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.durable import materialize
from freshet.operators import blending, calibrate, neighbours, ordering, stats, training
from freshet.plans.common import over_predictions, tidy, tidy_sql
from freshet.sources import files
from freshet.sources.tables import STAND_IN_MODELS, stand_in_predictions, table

c = F.col
QUERIES, ORACLES = {}, {}
MODELS = [m[0] for m in STAND_IN_MODELS]
THREE = MODELS[:3]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


def predictions(spark, folder):
    return stand_in_predictions(spark, folder)


def out_of_fold(spark, folder):
    return predictions(spark, folder).where(c("split") == "train")


RMSE = "sqrt(avg((y - pred) * (y - pred)))"
R2 = "1.0 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))"
SCORES_CTE = f", scores AS MATERIALIZED (SELECT model, {RMSE} AS rmse, {R2} AS r2, count(*) AS \"rows\" FROM preds WHERE split = 'train' GROUP BY model)"


@query("model_scores", tidy_sql(over_predictions("SELECT * FROM scores", SCORES_CTE), ["rmse", "r2"]))
def model_scores(spark, folder):
    return tidy(blending.model_scores(out_of_fold(spark, folder)))


@query("fold_metrics", tidy_sql(over_predictions(
    f"SELECT model, fold, {RMSE} AS rmse, {R2} AS r2, count(*) AS \"rows\" FROM preds WHERE split = 'train'"
    " GROUP BY GROUPING SETS ((model, fold), (model))"), ["rmse", "r2"]))
def fold_metrics(spark, folder):
    return tidy(stats.fold_metrics(out_of_fold(spark, folder)))


@query("prediction_summary", tidy_sql(over_predictions(
    "SELECT model, stddev_pop(pred) AS std, min(pred) AS lowest, max(pred) AS highest, avg(pred) AS mean"
    " FROM preds WHERE split = 'test' GROUP BY model"), ["std", "lowest", "highest", "mean"]))
def prediction_summary(spark, folder):
    return tidy(stats.prediction_summary(predictions(spark, folder).where(c("split") == "test")))


@query("candidate_table", tidy_sql(over_predictions(
    "SELECT s.model, s.rmse, s.r2, p.std, p.lowest, p.highest, s.rmse = min(s.rmse) OVER () AS best FROM scores s JOIN"
    " (SELECT model, stddev_pop(pred) AS std, min(pred) AS lowest, max(pred) AS highest FROM preds WHERE split = 'test'"
    " GROUP BY model) p USING (model)", SCORES_CTE), ["rmse", "r2", "std", "lowest", "highest"]))
def candidate_table(spark, folder):
    """Every candidate with its error and spread, the best one marked."""
    preds = predictions(spark, folder)
    scores = materialize(blending.model_scores(preds.where(c("split") == "train")))
    summary = stats.prediction_summary(preds.where(c("split") == "test")).drop("mean")
    best = blending.best_by_rmse(scores).select("model", F.lit(True).alias("best"))
    table = scores.drop("rows").join(summary, "model").join(best, "model", "left")
    return tidy(table.withColumn("best", F.coalesce("best", F.lit(False))))


@query("best_candidate", tidy_sql(over_predictions("SELECT * FROM scores ORDER BY rmse, model LIMIT 1", SCORES_CTE), ["rmse", "r2"]))
def best_candidate(spark, folder):
    return tidy(blending.best_by_rmse(blending.model_scores(out_of_fold(spark, folder))))


@query("top_models", tidy_sql(over_predictions("SELECT model, rmse FROM scores ORDER BY rmse, model LIMIT 4", SCORES_CTE), ["rmse"]))
def top_models(spark, folder):
    return tidy(blending.top_by_rmse(blending.model_scores(out_of_fold(spark, folder)), 4))


@query("best_of_family", tidy_sql(over_predictions(
    "SELECT * FROM scores WHERE model LIKE 'cat%' ORDER BY r2 DESC, model LIMIT 1", SCORES_CTE), ["rmse", "r2"]))
def best_of_family(spark, folder):
    return tidy(blending.best_of_family(blending.model_scores(out_of_fold(spark, folder)), "cat"))


@query("family_counts", over_predictions(
    "SELECT split_part(model, '_', 1) AS family, count(DISTINCT model) AS models FROM preds GROUP BY 1"))
def family_counts(spark, folder):
    return blending.family_counts(predictions(spark, folder))


@query("model_name_parts", over_predictions("""
SELECT DISTINCT model, split_part(model, '_', 1) AS family,
  CASE WHEN split_part(model, '_', 1) IN ('lgb', 'xgb') THEN split_part(model, '_', 2)
       WHEN model LIKE '%slow%' THEN 'slow' WHEN model LIKE '%reg%' THEN 'reg' END AS variant,
  TRY_CAST(nullif(regexp_extract(model, '_d([0-9]+)', 1), '') AS INT) AS depth,
  TRY_CAST(nullif(regexp_extract(model, '_s([0-9]+)$', 1), '') AS INT) AS seed FROM preds"""))
def model_name_parts(spark, folder):
    return training.parse_model_names(predictions(spark, folder).select("model").distinct())


WIDE = ("SELECT record_id, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}" for m in MODELS)
        + " FROM preds GROUP BY record_id")


@query("stack_matrix", tidy_sql(over_predictions(WIDE), MODELS))
def stack_matrix(spark, folder):
    return tidy(blending.stack(predictions(spark, folder), MODELS, ["record_id"]))


A, B, C = THREE
ALIGNED_CTE = f", wide AS MATERIALIZED ({WIDE})"


@query("blends", tidy_sql(over_predictions(f"""
SELECT record_id, ({A} + {B} + {C}) / 3.0 AS mean3, {A} * 0.5 + {B} * 0.5 AS half, {A} * 0.6 + {B} * 0.4 AS lean,
  {A} * 0.5 + {B} * 0.3 + {C} * 0.2 AS weighted, {A} * 0.4 + {B} * 0.3 + {C} * 0.3 AS even,
  pow(c1 * c2 * c3, 1.0 / 3) AS geometric
FROM (SELECT *, least(greatest({A}, 0), 1) AS c1, least(greatest({B}, 0), 1) AS c2, least(greatest({C}, 0), 1) AS c3 FROM wide)""",
    ALIGNED_CTE), ["mean3", "half", "lean", "weighted", "even", "geometric"]))
def blends(spark, folder):
    """Fixed mixes and the geometric mean of three aligned prediction tables."""
    preds = predictions(spark, folder)
    tables = {m: preds.where(c("model") == m) for m in THREE}
    wide = blending.aligned(tables, "record_id", "pred")
    mixes = {
        "half": {A: 0.5, B: 0.5}, "lean": {A: 0.6, B: 0.4},
        "weighted": {A: 0.5, B: 0.3, C: 0.2}, "even": {A: 0.4, B: 0.3, C: 0.3},
    }
    out = blending.mean_blend(wide, THREE, "mean3")
    for name, weights in mixes.items():
        out = blending.weighted_blend(out, weights, name)
    for i, m in enumerate(THREE):
        out = out.withColumn(f"c{i + 1}", F.least(F.greatest(c(m), F.lit(0.0)), F.lit(1.0)))
    out = blending.geometric_blend(out, ["c1", "c2", "c3"], "geometric")
    return tidy(out.select("record_id", "mean3", *mixes, "geometric"))


@query("weight_sweep", tidy_sql(over_predictions(
    f"SELECT record_id, w AS weight, least(greatest((1.0 - w) * {A} + w * {B}, 0), 1) AS pred"
    " FROM wide, (SELECT CAST(unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS DOUBLE) AS w)", ALIGNED_CTE), ["weight", "pred"]))
def weight_sweep(spark, folder):
    wide = blending.stack(predictions(spark, folder), [A, B], ["record_id"])
    return tidy(blending.weight_sweep(wide, A, B, [0.3, 0.4, 0.5, 0.6, 0.7], ["record_id"]))


def inverse_sql(where: str = "") -> str:
    return f"SELECT model, (1 / rmse) / sum(1 / rmse) OVER () AS weight FROM scores {where}"


@query("inverse_error_weights", tidy_sql(over_predictions(inverse_sql(), SCORES_CTE), ["weight"]))
def inverse_error_weights(spark, folder):
    return tidy(blending.inverse_error_weights(blending.model_scores(out_of_fold(spark, folder))))


@query("inverse_error_blend", tidy_sql(over_predictions(
    f"SELECT record_id, split, sum(pred * weight) AS pred FROM preds JOIN ({inverse_sql()}) USING (model) GROUP BY 1, 2",
    SCORES_CTE), ["pred"]))
def inverse_error_blend(spark, folder):
    preds = predictions(spark, folder)
    weights = blending.inverse_error_weights(blending.model_scores(preds.where(c("split") == "train")))
    return tidy(blending.blend_by_weights(preds, weights, ["record_id", "split"]))


@query("good_model_blend", tidy_sql(over_predictions(
    f"SELECT record_id, sum(pred * weight) AS pred FROM preds JOIN ({inverse_sql('WHERE r2 > 0.02')}) USING (model)"
    " WHERE split = 'test' GROUP BY 1", SCORES_CTE), ["pred"]))
def good_model_blend(spark, folder):
    """Only models that explain something take part."""
    preds = predictions(spark, folder)
    scores = blending.model_scores(preds.where(c("split") == "train"))
    weights = blending.inverse_error_weights(scores, least_r2=0.02)
    return tidy(blending.blend_by_weights(preds.where(c("split") == "test"), weights, ["record_id"]))


@query("seed_average", tidy_sql(over_predictions(
    "SELECT record_id, split_part(model, '_', 1) AS family, avg(pred) AS pred, count(pred) AS parts FROM preds GROUP BY 1, 2"),
    ["pred"]))
def seed_average(spark, folder):
    """Mean over the models of a family, as over seeds, repeats or folds."""
    preds = predictions(spark, folder).withColumn("family", F.split("model", "_")[0])
    return tidy(blending.average_predictions(preds, ["record_id", "family"]))


@query("ordinal_ranks", tidy_sql(over_predictions(
    "SELECT model, record_id, (row_number() OVER (PARTITION BY model ORDER BY pred, record_id) - 1) / count(*) OVER (PARTITION BY model) AS rank"
    " FROM preds WHERE split = 'test'"), ["rank"]))
def ordinal_ranks(spark, folder):
    placed = ordering.ordinal_positions(
        predictions(spark, folder).where(c("split") == "test"), ["model"], "pred", "record_id"
    )
    return tidy(placed.select("model", "record_id", (c("position") / c("rows")).alias("rank")))


RANK_CTE = SCORES_CTE + """,
ranked AS MATERIALIZED (SELECT split, record_id, avg(r) AS rank FROM (
  SELECT split, record_id, (row_number() OVER (PARTITION BY model, split ORDER BY pred, record_id) - 1)
    / count(*) OVER (PARTITION BY model, split) AS r
  FROM preds WHERE model IN (SELECT model FROM scores ORDER BY rmse, model LIMIT 4)) GROUP BY 1, 2),
ys AS MATERIALIZED (SELECT flood_risk_score AS y, row_number() OVER (ORDER BY flood_risk_score, record_id) - 1 AS p,
  count(*) OVER () AS n FROM train)"""


@query("rank_blend", tidy_sql(over_predictions("""
SELECT split, record_id, rank, lo.y + (coalesce(hi.y, lo.y) - lo.y) * (spot - floor(spot)) AS pred
FROM (SELECT *, rank * ((SELECT max(n) FROM ys) - 1) AS spot FROM ranked)
JOIN ys lo ON lo.p = CAST(floor(spot) AS BIGINT) LEFT JOIN ys hi ON hi.p = CAST(floor(spot) AS BIGINT) + 1""", RANK_CTE),
    ["rank", "pred"]))
def rank_blend(spark, folder):
    """Mean rank of the four best models, mapped onto the target's distribution."""
    preds = materialize(predictions(spark, folder))
    oof = preds.where(c("split") == "train")
    top = blending.top_by_rmse(blending.model_scores(oof), 4)
    best = preds.join(F.broadcast(top.select("model")), "model", "left_semi")
    ranked = blending.rank_average(best, ["split", "model"], "record_id")
    target = oof.where(c("model") == A).select("record_id", c("y").alias("flood_risk_score"))
    return tidy(calibrate.remap_ranks(ranked, target, "flood_risk_score", "record_id"))


CAL_CTE = f""", o AS MATERIALIZED (SELECT pred AS x, row_number() OVER (ORDER BY pred, record_id) - 1 AS p FROM preds
  WHERE split = 'train' AND model = '{A}'),
t AS MATERIALIZED (SELECT flood_risk_score AS y, row_number() OVER (ORDER BY flood_risk_score, record_id) - 1 AS p FROM train),
k AS MATERIALIZED (SELECT o.p, x AS x0, y AS y0, lead(x) OVER (ORDER BY o.p) AS x1, lead(y) OVER (ORDER BY o.p) AS y1 FROM o JOIN t ON o.p = t.p),
q AS MATERIALIZED (SELECT record_id, pred FROM preds WHERE split = 'test' AND model = '{A}')"""


@query("quantile_calibration", tidy_sql(over_predictions("""
SELECT record_id, pred, CASE WHEN x0 IS NULL THEN (SELECT y0 FROM k WHERE p = 0)
    WHEN x1 IS NULL OR pred = x0 THEN y0 ELSE y0 + (y1 - y0) * ((pred - x0) / (x1 - x0)) END AS calibrated
FROM q ASOF LEFT JOIN k ON q.pred >= k.x0""", CAL_CTE), ["pred", "calibrated"]))
def quantile_calibration(spark, folder):
    """Test predictions moved to the target value at their place among the known ones."""
    preds = materialize(predictions(spark, folder).where(c("model") == A))
    known = preds.where(c("split") == "train").select("record_id", c("pred").alias("oof"), "y")
    asked = preds.where(c("split") == "test").select("record_id", "pred")
    return tidy(calibrate.quantile_calibrate(asked, "pred", known, "oof", "y", "record_id"))


KNOTS = 101
KNOT_CTE = f""", kn AS MATERIALIZED (SELECT unnest(range({KNOTS})) AS i,
  unnest((SELECT quantile_cont(pred, [{', '.join(f'{i / (KNOTS - 1)!r}' for i in range(KNOTS))}]) FROM preds WHERE split = 'train' AND model = '{A}')) AS x,
  unnest((SELECT quantile_cont(y, [{', '.join(f'{i / (KNOTS - 1)!r}' for i in range(KNOTS))}]) FROM preds WHERE split = 'train' AND model = '{A}')) AS y),
seg AS MATERIALIZED (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY i) AS x1, lead(y) OVER (ORDER BY i) AS y1 FROM kn),
q AS MATERIALIZED (SELECT record_id, pred FROM preds WHERE split = 'test' AND model = '{A}')"""


@query("knot_calibration", tidy_sql(over_predictions("""
SELECT record_id, CASE WHEN x0 IS NULL THEN (SELECT min(y) FROM kn) WHEN x1 IS NULL THEN y0
  ELSE y0 + (y1 - y0) * ((pred - x0) / (x1 - x0)) END AS calibrated FROM q ASOF LEFT JOIN seg ON q.pred >= seg.x0""", KNOT_CTE),
    ["calibrated"]))
def knot_calibration(spark, folder):
    """The same mapping through 101 quantiles, looked up in every task."""
    preds = materialize(predictions(spark, folder).where(c("model") == A))
    xs, ys = calibrate.quantile_knots(preds.where(c("split") == "train"), "pred", "y", KNOTS)
    asked = preds.where(c("split") == "test").select("record_id", "pred")
    return tidy(calibrate.interpolate(asked, "pred", xs, ys, "calibrated").select("record_id", "calibrated"))


# Merging and resuming: even orders are one machine's predictions, the rest another's.

@query("merge_report", over_predictions("""
SELECT action, count(*) AS models FROM (
  SELECT DISTINCT model, CASE WHEN model LIKE '%d6%' THEN 'skipped' ELSE 'copied' END AS action FROM preds) GROUP BY action"""))
def merge_report(spark, folder):
    preds = predictions(spark, folder)
    return files.merge_report(preds, preds.where(c("model").contains("d6")))


@query("merge_new", over_predictions(
    "SELECT model, count(*) AS \"rows\" FROM preds WHERE model NOT LIKE '%d6%' GROUP BY model"))
def merge_new(spark, folder):
    preds = predictions(spark, folder)
    new = files.new_predictions(preds, preds.where(c("model").contains("d6")))
    return new.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))


GRID = [("cat_d6", 42), ("cat_d6", 142), ("cat_d8_slow", 142), ("hgb_d4", 42), ("lgb_mae", 42), ("lgb_wide", 42)]


@query("unfinished_models", over_predictions(
    "SELECT config, CAST(seed AS INT) AS seed FROM (VALUES " + ", ".join(f"('{n}', {s})" for n, s in GRID)
    + ") g(config, seed) WHERE config || '_s' || seed NOT IN (SELECT DISTINCT model FROM preds)"))
def unfinished_models(spark, folder):
    """Grid rows still to train, given what the prediction table holds."""
    grid = training.grid_table(spark, training.grid(), [42, 142])
    wanted = grid.where(" OR ".join(f"(config = '{n}' AND seed = {s})" for n, s in GRID))
    return training.unfinished(wanted, predictions(spark, folder)).select("config", "seed")


@query("submission", tidy_sql(over_predictions(
    f"SELECT record_id, least(greatest(pred, 0), 1) AS flood_risk_score FROM preds WHERE split = 'test' AND model = '{MODELS[5]}'"),
    ["flood_risk_score"]))
def submission(spark, folder):
    preds = predictions(spark, folder).where((c("split") == "test") & (c("model") == MODELS[5]))
    return tidy(files.submission(preds))


# Neighbours of the embedded vectors; a vector's fold is its id modulo 5.

PAIRS = """SELECT a.vec_id, b.vec_id AS ref_key, b.label,
  sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id % 5 <> b.vec_id % 5"""
NEAREST = f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, ref_key) AS rn FROM ({PAIRS}) QUALIFY rn <= 30"


def vectors(spark, folder):
    return table(spark, folder, "embeddings").withColumn("fold", (c("vec_id") % 5).cast("int"))


@query("nearest_neighbours", tidy_sql(
    f"SELECT vec_id, ref_key, distance, CAST(rn AS INT) AS position FROM ({NEAREST}) WHERE rn <= 5", ["distance"]))
def nearest_neighbours(spark, folder):
    """The five nearest vectors of other folds."""
    v = vectors(spark, folder)
    return tidy(neighbours.nearest(v, v, "vec_id", "embedding", 5, group="fold"))


@query("neighbour_regression", tidy_sql(f"""
SELECT vec_id, CASE WHEN count(*) FILTER (distance = 0) > 0 THEN avg(label) FILTER (distance = 0)
  ELSE sum(label / distance) FILTER (distance > 0) / sum(1 / distance) FILTER (distance > 0) END AS pred FROM ({NEAREST}) GROUP BY vec_id""", ["pred"]))
def neighbour_regression(spark, folder):
    """The label of a vector from its 30 nearest of other folds, weighted by 1/distance."""
    v = vectors(spark, folder)
    found = neighbours.nearest(v, v, "vec_id", "embedding", 30, group="fold")
    return tidy(neighbours.neighbour_regression(found, v, "vec_id", "label"))
