"""Inputs that once gave wrong numbers or ended a job."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.durable import lookup, materialize
from freshet.functions import features, scalars
from freshet.operators import blending, logs, neighbours, stacking, stats, training
from freshet.plans.common import tidy
from freshet.sources import files

ODD = [math.nan, math.inf, -math.inf, 1e13, -1e13, 1e-9, 0.123456789, -0.5, None]


def same(a, b):
    return a is b is None or a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x double")


def values(df, column="x"):
    return [r[column] for r in df.orderBy("i").collect()]


def test_tidy_and_rounding_keep_what_is_no_ordinary_number(odd):
    text = odd.withColumn("x", F.expr(scalars.rounded_text("x", 6)))
    for out in (values(tidy(odd)), values(odd.withColumn("x", scalars.round_half_up(F.col("x"), 6))), values(text)):
        assert all(same(a, b) for a, b in zip(out[:5] + out[8:], ODD[:5] + ODD[8:]))
        assert all(abs(a - b) <= 1e-6 for a, b in zip(out[5:8], ODD[5:8]))


def test_tidy_of_some_columns(spark):
    row = tidy(spark.createDataFrame([(0.123456789, 0.123456789)], "a double, b double"), columns=["a"]).first()
    assert row.a != 0.123456789 and row.b == 0.123456789


def test_clip_keeps_not_a_number(odd):
    out = values(odd.withColumn("x", scalars.clip_unit(F.col("x"))))
    assert math.isnan(out[0]) and out[1:5] == [1.0, 0.0, 1.0, 0.0] and out[8] is None


def test_csv_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("record_id,elevation_m,rainfall_7d_mm\nF1,2,200\n")
    (tmp_path / "b.csv").write_text("record_id,rainfall_7d_mm,elevation_m\nF2,300,3\n")
    (tmp_path / "c.csv").write_text("rainfall_7d_mm,record_id\nnot a number,F3\n")
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("elevation_m", T.DoubleType()), T.StructField("rainfall_7d_mm", T.DoubleType())])
    rows = {r.record_id: r for r in files.read_csv(spark, str(tmp_path), schema, corrupt="_line").collect()}
    assert (rows["F1"].elevation_m, rows["F1"].rainfall_7d_mm) == (2.0, 200.0)
    assert (rows["F2"].elevation_m, rows["F2"].rainfall_7d_mm) == (3.0, 300.0)
    assert rows["F3"].elevation_m is None and rows["F3"].rainfall_7d_mm is None
    assert rows["F3"]._line and rows["F1"]._line is None


def test_merge_copies_the_missing_half(spark):
    kind = "model string, split string, record_id string, pred double"
    source = spark.createDataFrame([("m", "train", "1", 0.1), ("m", "test", "2", 0.2), ("n", "test", "2", 0.3)], kind)
    there = spark.createDataFrame([("m", "train", "1", 0.1)], kind)
    new = files.new_predictions(source, there)
    assert {(r.model, r.split) for r in new.collect()} == {("m", "test"), ("n", "test")}
    assert {r.action: r.models for r in files.merge_report(source, there).collect()} == {"copied": 2, "skipped": 1}
    assert "Exchange hashpartitioning(model" not in new._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_metrics_of_one_row_and_of_a_constant_target(spark):
    preds = spark.createDataFrame([("m", 0, 1.0, 0.5), ("m", 1, 2.0, 2.0), ("m", 1, 4.0, 3.0)], "model string, fold int, y double, pred double")
    rows = {r.fold: r for r in stats.fold_metrics(preds).collect()}
    assert rows[0].r2 is None and rows[0].rmse == 0.5 and rows[1].r2 == pytest.approx(0.5)
    assert stats.prediction_metrics(preds.withColumn("y", F.lit(1.0)), ["model"]).first().r2 is None


def test_a_density_of_minus_one(spark):
    raw = spark.createDataFrame([Row(reason_not_good_to_live="x", inundation_area_sqm=5.0, record_id="F1", population_density_per_km2=-1.0, is_good_to_live="Yes")])
    assert raw.select(features.meta_features()["inundation_per_pop"].alias("v")).first().v is None


def test_a_model_name_without_parts(spark):
    rows = training.parse_model_names(spark.createDataFrame([("lgb",), ("lgb_mae_s42",), ("other",)], "model string"))
    out = {r.model: r for r in rows.collect()}
    assert out["lgb"].variant is None and out["lgb_mae_s42"].variant == "mae" and out["lgb_mae_s42"].seed == 42


def test_log_rows_are_numbered_across_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    scored = spark.range(6).select(
        F.lit("v13").alias("model_version"), F.lit("Colombo").alias("district"), *[F.lit(1.0).alias(n) for n in logs.TRACKED_COLUMNS],
        F.lit(0.4).alias("flood_risk_score"), F.lit(1).alias("inference_time_ms"),
    )
    for _ in range(2):
        files.append_log(logs.log_rows(scored, ["district"], F.lit("2024-06-15").cast("timestamp")), path)
    ids = [r.id for r in files.read_log(spark, path).select("id").collect()]
    assert len(set(ids)) == 12 and None not in ids


def test_blend_of_the_models_that_are_there(spark):
    preds = spark.createDataFrame([("a", "1", 0.8), ("a", "2", 0.2), ("b", "2", 0.6), ("c", "1", 0.9)], "model string, record_id string, pred double")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, weight double")
    out = blending.blend_by_weights(preds, weights, ["record_id"])
    assert {r.record_id: r.pred for r in out.collect()} == {"1": pytest.approx(0.8), "2": pytest.approx(0.4)}
    assert "hashpartitioning(model" not in out._jdf.queryExecution().executedPlan().toString()


def test_moments_of_many_models(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(400, 270)) + 100.0
    y = x[:, :3].sum(1) + random.normal(size=400)
    names = [f"m{i}" for i in range(270)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"])).repartition(5)
    n, means, moments = stacking.cross_moments(df, names, "y")
    both = np.column_stack([x, y])
    assert n == 400 and np.allclose(means, both.mean(0)) and np.allclose(moments, np.cov(both.T, bias=True), atol=1e-9)
    weights, _ = stacking.fit_ridge(df, names, "y", alpha=1.0)
    assert len(weights) == 270 and weights["m0"] > 0.3


def test_a_hot_key_that_the_table_does_not_know_is_spread(spark):
    facts = spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    table = materialize(facts.where("k != 'hot'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.lit(1)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup(facts, table, ["k"], weight="n", broadcast_rows=0, salts=64)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2200
        assert out.where("v = 1").count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbours_of_text_keys_and_missing_groups(spark):
    from freshet.operators.neighbours import nearest

    random = np.random.default_rng(2)
    points = random.normal(size=(90, 3))
    rows = [(f"k{i:02d}", [float(x) for x in p], None if i % 7 == 0 else i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame([*rows, ("none", None, 1)], "id string, v array<double>, g int")
    found = nearest(df, df, "id", "v", 2, group="g", block_rows=10, pivots=4).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.position):
        got.setdefault(r.id, []).append(r.ref_key)
    for i, (name, _, group) in enumerate(rows):
        others = [j for j in range(90) if group is None or rows[j][2] != group]
        order = sorted(others, key=lambda j: (np.linalg.norm(points[i] - points[j]), rows[j][0]))
        assert got[name] == [rows[j][0] for j in order[:2]]


def test_grid_run_trains_nothing_twice_and_is_stacked(spark, tmp_path):
    rows = spark.range(120).select(
        F.concat(F.lit("F"), F.col("id")).alias("record_id"), (F.col("id") % 7 / 7).alias("a"), (F.col("id") % 5 / 5).alias("b"),
        (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 4 > 0, "train").otherwise("test").alias("split"),
    ).withColumn("y", F.col("a") * 0.5 + F.col("b") * 0.3)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    configs = [g for g in training.grid() if g.name in ("cat_d4", "lgb_rmse")]
    table = training.grid_table(spark, configs, [42])
    path = str(tmp_path / "store")
    run = lambda t: training.run_grid(train, test, ["a", "b"], "y", t, configs, 3, path, maxIter=4, maxDepth=3)
    assert run(table.where("config = 'cat_d4'")) == ["cat_d4_s42"]
    assert run(table) == ["lgb_rmse_s42"]
    assert run(table) == []
    preds = files.read_predictions(spark, path)
    counts = {(r.model, r.split): r["count"] for r in preds.groupBy("model", "split").count().collect()}
    assert counts == {(m, s): n for m in ("cat_d4_s42", "lgb_rmse_s42") for s, n in (("train", 90), ("test", 90))}
    named = preds.join(rows.select("record_id", "y"), "record_id")
    out = training.stack_store(named, "y", ["record_id", "split", "y"], max_iter=100).collect()
    assert len(out) == 120 and all(0 <= r.pred <= 1 for r in out)
    truth = {r.record_id: r.y for r in rows.collect()}
    assert np.mean([(truth[r.record_id] - r.pred) ** 2 for r in out]) < 0.02


def test_one_hot_vectors_of_many_classes(spark):
    from freshet.operators import encoding

    train = spark.range(12_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") > 5, "x").alias("g"))
    model = encoding.fit_one_hot(train, ["k", "g"])
    rows = spark.createDataFrame([("c7", "x"), ("never seen", None)], "k string, g string")
    out = model.transform(encoding.fill_missing(rows, ["k", "g"])).collect()
    assert out[0]["k_hot"].size == 12_000 and out[0]["k_hot"].numNonzeros() == 1 and out[1]["k_hot"].numNonzeros() == 0
    assert [r["g_hot"].toArray().tolist() for r in out] == [[0.0, 1.0], [1.0, 0.0]]


def test_neighbour_routing_in_small_parts(spark, monkeypatch):
    """Copies of queries and distances are held a few at a time, with the same neighbours."""
    monkeypatch.setattr(neighbours, "ROUTED_ROWS", 7)
    monkeypatch.setattr(neighbours, "SEARCHED_ROWS", 3)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, size=(60, 3)).astype(float)  # many equal distances
    df = spark.createDataFrame([(i, row.tolist(), i % 3) for i, row in enumerate(x)], "id long, v array<double>, g int")
    found = neighbours.nearest(df, df, "id", "v", 4, group="g", block_rows=9, pivots=3).toPandas()
    got = found.sort_values(["id", "position"]).groupby("id")["ref_key"].apply(list)
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(60), d)) if j % 3 != i % 3][:4]
        assert got[i] == order
