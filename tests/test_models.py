import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from freshet.operators import blending, calibrate, neighbours, stacking, stats, training

c = F.col


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    y = rng.random(n)
    return pd.DataFrame({
        "record_id": [f"F{i}" for i in range(n)], "y": y,
        "a": y * 0.7 + rng.normal(0, 0.1, n), "b": y * 0.4 + rng.normal(0, 0.2, n), "d": rng.random(n),
    })


@pytest.fixture(scope="module")
def wide(spark, data):
    return spark.createDataFrame(data).repartition(4)


def test_ridge_closed_form(wide, data):
    weights, intercept = stacking.fit_ridge(wide, ["a", "b", "d"], "y", alpha=20.0)
    x = data[["a", "b", "d"]].to_numpy()
    xc, yc = x - x.mean(0), data.y - data.y.mean()
    expected = np.linalg.solve(xc.T @ xc + 20.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(list(weights.values()), expected, rtol=1e-9)
    assert intercept == pytest.approx(data.y.mean() - x.mean(0) @ expected)


def test_ridge_as_spark_learner(wide, data):
    learner = training.linear_learner(20.0, len(data), data.y.std(ddof=0))
    model = learner.setFeaturesCol("inputs").setLabelCol("y").fit(stacking.assemble(wide, ["a", "b", "d"]))
    weights, _ = stacking.fit_ridge(wide, ["a", "b", "d"], "y", alpha=20.0)
    np.testing.assert_allclose(model.coefficients.toArray(), list(weights.values()), rtol=1e-8)


def test_huber_resists_outliers(spark, data):
    spoilt = data.assign(y=np.where(np.arange(len(data)) % 20 == 0, 50.0, 2 * data.a + 1))
    weights, intercept = stacking.fit_huber(spark.createDataFrame(spoilt), ["a"], "y")
    assert weights["a"] == pytest.approx(2.0, abs=0.05) and intercept == pytest.approx(1.0, abs=0.05)


def test_simplex_weights(wide, data):
    weights = stacking.fit_simplex(wide, ["a", "b", "d"], "y")
    w = np.array(list(weights.values()))
    assert w.sum() == pytest.approx(1.0) and (w >= 0).all()
    x, y = data[["a", "b", "d"]].to_numpy(), data.y.to_numpy()
    best = ((x @ w - y) ** 2).mean()
    rng = np.random.default_rng(0)
    for other in rng.dirichlet(np.ones(3), 500):
        assert best <= ((x @ other - y) ** 2).mean() + 1e-12


def test_projection_onto_simplex():
    np.testing.assert_allclose(stacking.onto_simplex(np.array([0.2, 0.8])), [0.2, 0.8])
    np.testing.assert_allclose(stacking.onto_simplex(np.array([3.0, 0.0])), [1.0, 0.0])


def test_metrics(wide, data):
    preds = wide.select("y", c("a").alias("pred"), F.lit("m").alias("model"), F.lit(0).alias("fold"))
    row = blending.model_scores(preds).first()
    error = data.y - data.a
    assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((data.y - data.y.mean()) ** 2).sum())
    levels = stats.fold_metrics(preds).collect()
    assert {r["fold"] for r in levels} == {None, 0}


def test_alignment_ignores_row_order(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, p double")
    b = spark.createDataFrame([("y", 20.0), ("x", 10.0)], "id string, p double")
    out = blending.aligned({"a": a, "b": b}, "id", "p").orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in out] == [(1.0, 10.0), (2.0, 20.0)]
    blending.check_one_to_one({"a": a, "b": b}, "id")
    for other in (b.limit(1), b.unionByName(b), b.limit(0)):
        with pytest.raises(ValueError):
            blending.check_one_to_one({"a": a, "b": other}, "id")


def test_weights_sum_to_one(spark):
    scores = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.4, 0.0)], "model string, rmse double, r2 double")
    weights = {r["model"]: r["weight"] for r in blending.inverse_error_weights(scores).collect()}
    assert weights == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    only = blending.inverse_error_weights(scores, least_r2=0.02).collect()
    assert [(r["model"], r["weight"]) for r in only] == [("a", 1.0)]


def test_calibration_equals_interpolation(spark):
    rng = np.random.default_rng(5)
    oof = np.round(rng.normal(0.5, 0.1, 600), 2)  # many equal predictions
    y = rng.random(600)
    asked = np.concatenate([rng.normal(0.5, 0.2, 300), oof[:50], [-3.0, 3.0, oof.min(), oof.max()], np.full(200, 0.4711)])
    ref = spark.createDataFrame(pd.DataFrame({"id": range(600), "oof": oof, "y": y}))
    new = spark.createDataFrame(pd.DataFrame({"n": range(len(asked)), "pred": asked}))
    got = calibrate.quantile_calibrate(new, "pred", ref, "oof", "y", "id").toPandas().sort_values("n")
    expected = np.interp(asked, np.sort(oof), np.sort(y))
    np.testing.assert_allclose(got["calibrated"], expected, rtol=1e-9)


def test_rank_remap_equals_interpolation(spark):
    rng = np.random.default_rng(6)
    y, ranks = rng.random(500), np.concatenate([rng.random(200), [0.0, 1.0]])
    target = spark.createDataFrame(pd.DataFrame({"id": range(500), "y": y}))
    asked = spark.createDataFrame(pd.DataFrame({"n": range(202), "rank": ranks}))
    got = calibrate.remap_ranks(asked, target, "y", "id").toPandas().sort_values("n")
    np.testing.assert_allclose(got["pred"], np.interp(ranks, np.linspace(0, 1, 500), np.sort(y)), rtol=1e-9)


def test_knot_lookup(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (None,), (9.0,)], "x double")
    out = calibrate.interpolate(df, "x", [0.0, 1.0, 2.0], [0.0, 10.0, 0.0], "v").collect()
    assert [r["v"] for r in out] == [0.0, 5.0, None, 0.0]


@pytest.mark.parametrize("group", [None, "fold"])
def test_neighbours_equal_brute_force(spark, group):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 10, (6, 8))
    which = np.where(rng.random(400) < 0.4, 0, rng.integers(0, 6, 400))
    x = (centres[which] + rng.normal(0, 1, (400, 8))).astype("float32")
    x[7] = x[3]  # an exact copy
    fold = np.arange(400) % 4
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "v": list(x.tolist()), "fold": fold}),
                               "id bigint, v array<float>, fold int")
    got = neighbours.nearest(df, df, "id", "v", 5, group=group, block_rows=40, pivots=7).toPandas()
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    if group:
        d[fold[:, None] == fold[None]] = np.inf
    for i in range(400):
        order = np.lexsort((np.arange(400), d[i]))[:5]
        own = got[got.id == i].sort_values("position")
        assert list(own.ref_key) == list(order)
        np.testing.assert_allclose(own.distance, d[i][order], rtol=1e-9, atol=1e-12)


def test_neighbours_skip_far_cells(spark):
    """Well separated clusters: a query is only sent to cells that can hold neighbours."""
    x = np.repeat(np.eye(4) * 1000, 50, axis=0) + np.random.default_rng(1).normal(0, 0.1, (200, 4))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "v": x.astype("float32").tolist()}), "id bigint, v array<float>")
    found = neighbours.nearest(df, df, "id", "v", 3, pivots=40, block_rows=1000).toPandas()
    assert (found.distance < 2).all() and len(found) == 600


def test_neighbours_hand_on_no_copies(spark, monkeypatch):
    """However many blocks a query meets, no interim table has more rows than the vectors."""
    written = []
    kept = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df: written.append(kept(df)) or written[-1])
    x = np.random.default_rng(4).normal(size=(300, 16))  # nothing can be skipped
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, v array<float>")
    found = neighbours.nearest(df, df, "id", "v", 3, block_rows=50, pivots=6)
    assert found.count() == 900
    assert max(df.count() for df in written) <= 300


def test_neighbours_of_close_vectors_far_from_zero(spark):
    """Single precision cannot tell these apart; a vector with a missing number is nobody's neighbour and has none."""
    x = np.random.default_rng(5).normal(size=(120, 6)) * 1e-3 + 1e6
    rows = [(i, row.tolist()) for i, row in enumerate(x)] + [(200, [1e6, None, 1e6, 1e6, 1e6, 1e6])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = neighbours.nearest(df, df, "id", "v", 4, block_rows=30, pivots=3).toPandas().sort_values(["id", "position"])
    near = got.groupby("id")["ref_key"].apply(list)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert list(near.index) == list(range(120))
    assert all(near[i] == list(np.lexsort((np.arange(120), d[i]))[:4]) for i in range(120))


def test_neighbour_weights(spark):
    found = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 10, 0.0), (2, 11, 1.0)],
                                  "id bigint, ref_key bigint, distance double")
    labels = spark.createDataFrame([(10, 3.0), (11, 6.0)], "id bigint, y double")
    out = {r["id"]: r["pred"] for r in neighbours.neighbour_regression(found, labels, "id", "y").collect()}
    assert out == pytest.approx({1: (3.0 + 3.0) / 1.5, 2: 3.0})


def test_grid():
    names = [g.name for g in training.grid()]
    assert len(names) == len(set(names)) == 27
    assert training.SEEDS == [42, 142, 242, 342, 442, 542, 642, 742, 842, 942]


def test_grid_requests_and_resume(spark):
    table = training.grid_table(spark, training.grid(), [42, 142])
    assert table.count() == 54
    names = spark.createDataFrame([("cat_d6",), ("nope",)], "config string")
    known, unknown = training.requested(table, names)
    assert sorted(r["model"] for r in known.collect()) == ["cat_d6_s142", "cat_d6_s42"]
    assert [r["config"] for r in unknown.collect()] == ["nope"]
    preds = spark.createDataFrame([("cat_d6_s42", "train"), ("cat_d6_s42", "test"), ("cat_d6_s142", "train")],
                                  "model string, split string")
    assert [r["model"] for r in training.unfinished(known, preds).collect()] == ["cat_d6_s142"]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 2))
    df = pd.DataFrame({"record_id": [f"F{i}" for i in range(600)], "x0": x[:, 0], "x1": x[:, 1],
                       "y": 0.7 * x[:, 0] + 0.2 * x[:, 1], "fold": np.arange(600) % 3})
    all_rows = spark.createDataFrame(df, "record_id string, x0 double, x1 double, y double, fold int")
    return all_rows.where("substring(record_id, 2) < 500"), all_rows.where("substring(record_id, 2) >= 500")


def test_cross_validation_covers_every_row_once(learnable):
    train, test = learnable
    config = next(g for g in training.grid() if g.name == "cat_d3")
    preds = training.cross_validate(train, test, ["x0", "x1"], "y", config, 42, 3, maxIter=10, stepSize=0.3)
    got = preds.toPandas()
    oof = got[got.split == "train"]
    assert len(oof) == oof.record_id.nunique() == train.count()
    assert (got[got.split == "test"].groupby("record_id").size() == 3).all()
    y = train.toPandas().set_index("record_id").y
    error = oof.set_index("record_id").pred - y
    assert np.sqrt((error**2).mean()) < 0.5 * y.std()


def test_saved_model_scores_the_same(spark, learnable, tmp_path):
    train, test = learnable
    model = training.fit_serving(train, ["x0", "x1"], "y", GBTRegressor(maxIter=5, maxDepth=3, seed=1))
    path = str(tmp_path / "model")
    training.save_serving(model, path)
    again = training.score_with(training.load_serving(path), test)
    a = training.score_with(model, test).toPandas().sort_values("record_id")
    b = again.toPandas().sort_values("record_id")
    assert a.flood_risk_score.tolist() == b.flood_risk_score.tolist()
    assert a.flood_risk_score.between(0, 1).all()
    top = training.importances(model, ["x0", "x1"])
    assert top[0][0] == "x0" and sum(v for _, v in top) == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["early_stopping", "pseudo_label_training"])
def test_training_queries_return_both_splits(spark, folder, name):
    from freshet.plans import model_queries

    rows = model_queries.QUERIES[name](spark, folder).groupBy("split").count().collect()
    assert {r["split"] for r in rows} == {"train", "test"} and all(r["count"] > 0 for r in rows)


def test_cross_validated_predictions_shorten_nothing(spark, folder, monkeypatch):
    from freshet.constants import FEATURES_108
    from freshet.plans import model_queries

    asked = []

    def seen(train, test, features, target, config, seed, folds, **short):
        asked.append((config.name, features, short))
        return test.select("record_id", F.lit("test").alias("split"), F.lit(config.name).alias("model"), F.lit(0.5).alias("pred"))

    monkeypatch.setattr(training, "cross_validate", seen)
    monkeypatch.setattr(model_queries, "feature_table", lambda obs: obs)
    model_queries.QUERIES["cross_validated_predictions"](spark, folder)
    assert asked == [("cat_d4", FEATURES_108, {}), ("et_leaf5", FEATURES_108, {})]


def test_repeated_or_missing_predictions_stop_a_blend(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, p double")
    twice = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.3)], "id long, p double")
    for other in (twice, a.where("id = 1"), a.unionByName(spark.createDataFrame([(3, 0.3)], a.schema))):
        with pytest.raises(Exception, match="more than once|lacks a record"):
            blending.aligned({"a": a, "b": other}, "id", "p").collect()
    preds = twice.withColumn("model", F.lit("m")).withColumnRenamed("p", "pred")
    with pytest.raises(Exception, match="more than once"):
        blending.stack(preds, ["m"], ["id"]).collect()


def test_seeded_folds_differ_by_seed(spark):
    from freshet.operators import folds

    rows = spark.range(3000).select(*[folds.seeded_fold(c("id"), 5, s).alias(f"f{s}") for s in (1, 2)]).toPandas()
    assert rows.f1.value_counts().between(500, 700).all()
    assert 0.15 < (rows.f1 == rows.f2).mean() < 0.25


def test_cross_validation_makes_its_vectors_once(spark, wide):
    """Fits read rows that executors hold: a pass of a tree does not make them anew, and nothing stays held."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def looked_at(values: pd.Series) -> pd.Series:
        seen.add(len(values))
        return values

    train = wide.select("record_id", "y", looked_at("a").alias("x"), "b", (F.substring("record_id", 2, 9).cast("int") % 2).alias("fold"))
    test = wide.limit(10).select("record_id", c("a").alias("x"), "b")
    for config in (training.grid()[0], training.extra_configs()[1]):
        seen.value = 0
        preds = training.cross_validate(train, test, ["x", "b"], "y", config, 42, 2, maxIter=2, numTrees=2, maxDepth=2)
        assert seen.value == 400
        assert preds.count() == 400 + 2 * 10
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
