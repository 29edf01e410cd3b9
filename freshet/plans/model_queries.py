"""Meta-models, cross-validated training and stored predictions."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from freshet.constants import FEATURES_108, NUMERIC_INPUTS, TARGET
from freshet.durable import materialize, scratch
from freshet.functions.scalars import clip_unit, logit
from freshet.functions.scorers import linear_combination, score
from freshet.operators import blending, ensembles, folds, grid_runs, scenario, stacking, training
from freshet.operators.ordering import medians
from freshet.operators.stats import rmse
from freshet.plans.blend_queries import MODELS, RMSE, SCORES_CTE, inverse_sql, out_of_fold, predictions
from freshet.plans.common import over_obs, over_predictions, over_scenarios, tidy, tidy_sql
from freshet.plans.encoding_queries import seeded_fold_sql
from freshet.plans.feature_queries import feature_table
from freshet.plans.scenario_queries import scenarios
from freshet.sources import files
from freshet.sources.tables import labelled, observations, unlabelled

c = F.col
QUERIES, ORACLES = {}, {}
A, B = MODELS[0], MODELS[4]
FEATURES = ["rainfall_7d_mm", "population_density_per_km2", "drainage_index", "extreme_weather_index",
            "historical_flood_count", "elevation_m"]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


# Meta-models whose closed form SQL can state for two inputs.

PAIR_CTE = f""", pair AS MATERIALIZED (SELECT record_id, split, any_value(y) AS y,
    max(CASE WHEN model = '{A}' THEN pred END) AS a, max(CASE WHEN model = '{B}' THEN pred END) AS b
  FROM preds GROUP BY 1, 2),
mo AS MATERIALIZED (SELECT count(*) * var_pop(a) + 1.0 AS aa, count(*) * var_pop(b) + 1.0 AS bb, count(*) * covar_pop(a, b) AS ab,
    count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS byy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my
  FROM pair WHERE split = 'train'),
w AS MATERIALIZED (SELECT *, my - wa * ma - wb * mb AS w0 FROM (
  SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM mo))"""


def stacked(spark, folder, models):
    """Stacked predictions of all records with target and split, written once."""
    return materialize(
        blending.stack(predictions(spark, folder), models, ["record_id", "split", "fold", "number", "y"])
    )


@query("ridge_stack", tidy_sql(over_predictions(
    "SELECT record_id, least(greatest(w0 + wa * a + wb * b, 0), 1) AS pred FROM pair, w WHERE split = 'test'", PAIR_CTE), ["pred"]))
def ridge_stack(spark, folder):
    """A ridge meta-model of two models, applied to the test rows."""
    wide = stacked(spark, folder, [A, B])
    weights, intercept = stacking.fit_ridge(wide.where(c("split") == "train"), [A, B], "y", alpha=1.0)
    scored = score(linear_combination(weights, intercept))
    return tidy(wide.where(c("split") == "test").select("record_id", clip_unit(scored).alias("pred")))


@query("simplex_weights", tidy_sql(over_predictions(f"""
SELECT unnest(['{A}', '{B}']) AS model, unnest([wa, 1 - wa]) AS weight FROM (
  SELECT least(greatest(sum((y - b) * (a - b)) / sum((a - b) * (a - b)), 0), 1) AS wa FROM pair WHERE split = 'train')""",
    PAIR_CTE), ["weight"], 5))
def simplex_weights(spark, folder):
    """Weights from 0 to 1 that sum to 1 and blend two models best."""
    wide = stacked(spark, folder, [A, B]).where(c("split") == "train")
    return tidy(stacking.weights_table(wide, stacking.fit_simplex(wide, [A, B], "y")), 5)


@query("top_weights", tidy_sql(over_predictions(
    f"SELECT * FROM ({inverse_sql()}) ORDER BY abs(weight) DESC, model LIMIT 3", SCORES_CTE), ["weight"]))
def top_weights(spark, folder):
    weights = blending.inverse_error_weights(blending.model_scores(out_of_fold(spark, folder)))
    return tidy(blending.top_weights(weights, 3))


@query("huber_weights")
def huber_weights(spark, folder):
    """Weights of all models under the Huber loss, largest first."""
    wide = stacked(spark, folder, MODELS).where(c("split") == "train")
    weights, _ = stacking.fit_huber(wide, MODELS, "y", max_iter=2000)
    return blending.top_weights(stacking.weights_table(wide, weights), 15)


@query("meta_trees")
def meta_trees(spark, folder):
    """A boosted-tree meta-model with folds of its own; out-of-fold and test predictions."""
    wide = stacked(spark, folder, MODELS)
    train = wide.where(c("split") == "train").withColumn("meta_fold", folds.arithmetic_fold(c("number"), 5, 141))
    oof, outside = stacking.cross_fit_trees(train, wide.where(c("split") == "test"), MODELS, "y", folds=5)
    return oof.select("record_id", F.lit("train").alias("split"), "pred").unionByName(
        outside.select("record_id", F.lit("test").alias("split"), "pred")
    )


@query("stack_predictions")
def stack_predictions(spark, folder):
    """Huber over all stored models, applied to both splits, as a submission is made from it."""
    return training.stack_store(predictions(spark, folder), "y", ["record_id", "split", "fold", "y"])


@query("requested_models", over_predictions("""
SELECT config, config LIKE '%\\_%' ESCAPE '\\' AS known FROM (
  SELECT DISTINCT regexp_replace(model, '_s[0-9]+$', '') AS config FROM preds UNION SELECT DISTINCT event_type FROM events)"""))
def requested_models(spark, folder):
    """Which requested configurations the grid knows."""
    names = predictions(spark, folder).select(F.regexp_replace("model", r"_s\d+$", "").alias("config")).distinct()
    names = names.unionByName(
        spark.read.parquet(f"{folder}/events.parquet").select(c("event_type").alias("config")).distinct()
    )
    known, unknown = training.requested(training.grid_table(spark, training.grid(), [42]), names)
    return known.select("config", F.lit(True).alias("known")).unionByName(
        unknown.select("config", F.lit(False).alias("known"))
    )


# Training on the observations.

def model_input(spark, folder):
    """Observations with gaps filled by training medians, written once."""
    obs = observations(spark, folder, folds=3).select(
        "record_id", "number", "split", "fold", TARGET, "soil_type", "urban_rural", *NUMERIC_INPUTS
    )
    obs = materialize(obs)
    return obs.fillna(medians(labelled(obs), NUMERIC_INPUTS))


def named(name: str) -> training.Config:
    return next(g for g in [*training.grid(), *training.extra_configs()] if g.name == name)


@query("cross_validated_predictions")
def cross_validated_predictions(spark, folder):
    """Out-of-fold and mean test predictions of a boosted and a forest model, all rounds and trees of their configurations on 108 features."""
    matrix = feature_table(observations(spark, folder, folds=3))
    preds = None
    for name in ("cat_d4", "et_leaf5"):
        own = training.cross_validate(labelled(matrix), unlabelled(matrix), FEATURES_108, TARGET, named(name), 42, 3)
        preds = own if preds is None else preds.unionByName(own)
    return blending.average_predictions(preds, ["record_id", "split", "model"])


@query("early_stopping")
def early_stopping(spark, folder):
    """Boosting that stops when its validation fold no longer gains."""
    rows = model_input(spark, folder)
    preds = training.cross_validate(
        labelled(rows), unlabelled(rows), FEATURES, TARGET, named("lgb_rmse"), 42, 2,
        early_stopping=True, maxIter=8, maxDepth=4,
    )
    return preds.select("record_id", "split", "model", "fold", "pred")


@query("pseudo_label_training")
def pseudo_label_training(spark, folder):
    """Training on log-odds with pseudo-labelled test rows added to every fold."""
    rows = model_input(spark, folder)
    train = labelled(rows).withColumn("z", logit(c(TARGET)))
    guess = unlabelled(rows).select("record_id", (c("rainfall_7d_mm") * 0.001 + 0.3).alias("guess"))
    rich = folds.add_pseudo_rows(
        train.drop(TARGET), unlabelled(rows).drop("fold", TARGET).withColumn("z", F.lit(0.0)),
        guess.select("record_id", logit(c("guess")).alias("z_guess")), "record_id", "z", "z_guess",
    )
    preds = training.cross_validate(
        rich, unlabelled(rows), FEATURES, "z", named("cat_d3"), 42, 2, logit_scale=True, maxIter=4
    )
    return preds.select("record_id", "split", "fold", "pred")


@query("forest_predictions")
def forest_predictions(spark, folder):
    """Impute, scale, one-hot and a forest, as one fitted object."""
    obs = observations(spark, folder).select(
        "record_id", "split", TARGET, "soil_type", "urban_rural", *NUMERIC_INPUTS
    ).fillna("missing", ["soil_type", "urban_rural"])
    steps = training.forest_pipeline(NUMERIC_INPUTS, ["soil_type", "urban_rural"], TARGET, trees=10, depth=6)
    model = steps.fit(labelled(obs))
    return model.transform(unlabelled(obs)).select("record_id", clip_unit(c("prediction")).alias("pred"))


@query("served_scores")
def served_scores(spark, folder):
    """A refit on all training rows, saved, loaded and applied to all rows."""
    rows = model_input(spark, folder)
    learner = GBTRegressor(maxIter=5, maxDepth=4, seed=42)
    path = scratch(spark, "serving")
    training.save_serving(training.fit_serving(labelled(rows), FEATURES, TARGET, learner), path)
    scored = training.score_with(training.load_serving(path), rows)
    return scored.select("record_id", "split", "flood_risk_score")


@query("feature_importance")
def feature_importance(spark, folder):
    """What a fitted model relies on, largest first."""
    rows = model_input(spark, folder)
    model = training.fit_serving(
        labelled(rows), FEATURES, TARGET, GBTRegressor(maxIter=5, maxDepth=4, seed=42)
    )
    return spark.createDataFrame(training.importances(model, FEATURES), "feature string, importance double")


# A grid of units on the whole feature matrix, and a stack that is saved and served.

# Shortened fits: see the README. The operators' defaults are 100 rounds and 100 trees of depth 15.
SHORT = {"maxIter": 4, "numTrees": 3, "maxDepth": 4}
GRID = ["cat_d4", "lgb_huber", "et_leaf5"]


@query("grid_predictions", over_obs(f"""
SELECT g.model, r.repeat, f.fold, s.split, (
    SELECT count(*) FROM obs WHERE split = s.split AND (split = 'test' OR {seeded_fold_sql("CAST(42 + r.repeat AS VARCHAR)", 2)} = f.fold)) AS "rows",
  true AS usable, 0 AS trained_again
FROM (SELECT unnest([{', '.join(f"'{g}_s42'" for g in GRID)}]) AS model) g, (SELECT unnest([0, 1]) AS repeat) r,
  (SELECT unnest([0, 1]) AS fold) f, (SELECT unnest(['train', 'test']) AS split) s"""))
def grid_predictions(spark, folder):
    """Three models on 108 features, two repeats of two folds, trained side by side; a second run trains nothing."""
    matrix = feature_table(observations(spark, folder))
    path = scratch(spark, "grid")
    wanted = grid_runs.units([named(g) for g in GRID], [42], repeats=2, folds=2)
    fold = lambda r: folds.seeded_fold(c("record_id"), 2, 42 + r)
    run = lambda: grid_runs.run_units(labelled(matrix), unlabelled(matrix), FEATURES_108, TARGET, wanted, path, fold, **SHORT)
    run()
    again = len(run())
    preds = grid_runs.read_units(spark, path)
    usable = F.min(c("pred").between(-0.5, 1.5))
    return preds.groupBy("model", "repeat", "fold", "split").agg(
        F.count(F.lit(1)).alias("rows"), usable.alias("usable"), F.lit(again).alias("trained_again")
    )


@query("served_stack", over_scenarios(
    "SELECT number, model_version, CASE WHEN model_version = 'v13' THEN 'model' ELSE 'heuristic' END AS route, true AS same FROM scen"))
def served_stack(spark, folder):
    """Scenarios of one version scored by a stack that was saved and loaded, the others by the heuristic.

    `same` says that the loaded stack scores as the fitted one, within [0, 1].
    """
    rows = model_input(spark, folder)
    learners = {
        "gbt": lambda: GBTRegressor(featuresCol="inputs", labelCol=TARGET, maxIter=4, maxDepth=3, seed=42),
        "huber": lambda: ensembles.HuberBoosting(TARGET, rounds=4, depth=3, rate=0.3),
        "trees": lambda: ensembles.ExtraTrees(TARGET, trees=3, depth=4),
    }
    fitted = ensembles.Stack(learners, NUMERIC_INPUTS, TARGET, folds=3).fit(labelled(rows))
    path = scratch(spark, "stack")
    fitted.write().overwrite().save(path)
    loaded = ensembles.StackModel.load(path)
    asked = materialize(scenarios(spark, folder))
    scored = scenario.score_by_route(asked, {"v13": loaded.transform}).select("number", "model_version", "route", "flood_risk_score")
    before = fitted.transform(asked.where("model_version = 'v13'")).select("number", c("flood_risk_score").alias("before"))
    same = F.when(c("route") == "model", c("before") == c("flood_risk_score")).otherwise(True) & c("flood_risk_score").between(0, 1)
    return scored.join(before, "number", "left").select("number", "model_version", "route", same.alias("same"))


# Files: predictions by model, merged; submissions by variant.

@query("prediction_store", over_predictions(
    "SELECT model, count(*) AS \"rows\", count(DISTINCT split) AS splits FROM preds GROUP BY model"))
def prediction_store(spark, folder):
    """Two stores written by two workers and merged, then read back."""
    preds = predictions(spark, folder).select(
        "record_id", "split", "model", F.lit(42).alias("seed"), F.lit(0).alias("repeat"), "fold", "pred"
    )
    here, there = scratch(spark, "preds"), scratch(spark, "preds")
    files.write_predictions(preds.where(~c("model").startswith("cat")), here)
    files.write_predictions(preds.where(~c("model").startswith("hgb")), there)
    files.merge_predictions(spark, there, here)
    files.require_paths(spark, [here, there])
    return files.read_predictions(spark, here).groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("split").alias("splits")
    )


@query("submission_files", tidy_sql(over_predictions(
    "SELECT model AS variant, record_id, least(greatest(pred, 0), 1) AS flood_risk_score FROM preds WHERE split = 'test'"),
    ["flood_risk_score"]))
def submission_files(spark, folder):
    """One CSV folder per model, read back with its schema."""
    preds = predictions(spark, folder).where(c("split") == "test").withColumnRenamed("model", "variant")
    path = scratch(spark, "submissions")
    files.write_variants(preds, path)
    back = spark.read.schema("record_id string, flood_risk_score double, variant string").option(
        "header", True
    ).csv(path)
    return tidy(back.select("variant", "record_id", "flood_risk_score"))


@query("observation_csv", tidy_sql(over_obs(
    f"SELECT record_id, generation_date, district, rainfall_7d_mm, elevation_m, {TARGET} FROM train"),
    ["rainfall_7d_mm", "elevation_m", TARGET]))
def observation_csv(spark, folder):
    """Observations written to CSV and scanned back by the explicit schema."""
    from freshet.sources.schemas import observation_schema

    path = scratch(spark, "csv")
    train = labelled(observations(spark, folder))
    kept = train.select(TARGET, "record_id", "generation_date", "district", "rainfall_7d_mm", "elevation_m")
    kept.write.option("header", True).csv(path)
    back = files.read_csv(spark, path, observation_schema())
    return tidy(back.select("record_id", "generation_date", "district", "rainfall_7d_mm", "elevation_m", TARGET))


@query("oof_error", tidy_sql(over_predictions(
    f"SELECT model, {RMSE} AS rmse FROM preds WHERE split = 'train' AND model IN ('{A}', '{B}') GROUP BY model"), ["rmse"]))
def oof_error(spark, folder):
    """Error of two models from their stacked predictions."""
    wide = blending.stack(out_of_fold(spark, folder), [A, B], ["record_id", "y"])
    long = wide.unpivot(["record_id", "y"], [A, B], "model", "pred")
    return tidy(long.groupBy("model").agg(rmse().alias("rmse")))
