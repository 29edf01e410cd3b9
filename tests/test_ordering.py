import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.operators import blending, calibrate, ordering

c = F.col


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, half of those with one value."""
    rng = np.random.default_rng(7)
    n = 3000
    group = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    value = np.round(rng.normal(size=n), 1)
    value[(group == "hot") & (rng.random(n) < 0.5)] = 0.0
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": range(n), "g": group, "x": value, "z": rng.normal(size=n)})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    df = spark.createDataFrame(skewed)
    return df.withColumn("x", F.when(~F.isnan("x"), c("x")))


def test_group_quantiles(frame, skewed):
    wanted = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    got = ordering.group_quantiles(frame, ["g"], "x", wanted).toPandas().set_index("g").sort_index()
    for name, p in wanted.items():
        expected = skewed.groupby("g")["x"].quantile(p)
        np.testing.assert_allclose(got[name], expected.loc[got.index], rtol=1e-12)


def test_medians_of_many_columns(frame, skewed):
    got = ordering.medians(frame, ["x", "z"])
    assert got == pytest.approx({"x": skewed["x"].median(), "z": skewed["z"].median()})


def test_percent_ranks_average_ties(frame, skewed):
    got = ordering.percent_ranks(frame, "g", ["x", "z"], ["id"], "_r").toPandas().set_index("id").sort_index()
    for name in ("x", "z"):
        expected = skewed.groupby("g")[name].rank(pct=True)
        np.testing.assert_allclose(got[f"{name}_r"].astype(float), expected, rtol=1e-12)


def test_null_group_has_no_rank(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", 3.0)], "id int, g string, x double")
    rows = ordering.percent_ranks(df, "g", ["x"], ["id"], "_r").orderBy("id").collect()
    assert [r["x_r"] for r in rows] == [None, 1.0]


def test_ordinal_positions(frame, skewed):
    got = ordering.ordinal_positions(frame, ["g"], "x", "id").toPandas()
    known = skewed.dropna(subset=["x"]).sort_values(["g", "x", "id"])
    known["position"] = known.groupby("g").cumcount()
    merged = got.merge(known[["id", "position"]], on="id")
    assert len(got) == len(known)
    assert (merged["position_x"] == merged["position_y"]).all()


def test_one_value_everywhere(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.lit(2.5).alias("x"))
    row = ordering.group_quantiles(df, ["g"], "x", {"m": 0.5}).first()
    assert row["m"] == 2.5


def test_lookup_is_the_same_with_and_without_broadcast(spark, frame):
    stats = materialize(
        frame.groupBy("g").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    small = lookup(frame, stats, ["g"], weight="n")
    salted = lookup(frame, stats, ["g"], weight="n", broadcast_rows=0, hot_share=10, salts=5)
    a = small.select("id", "s").toPandas().sort_values("id", ignore_index=True)
    b = salted.select("id", "s").toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    assert salted.columns == small.columns


def test_lookup_spreads_the_hot_key(spark, frame):
    """No join task holds the hot group: its rows have many salts."""
    stats = materialize(frame.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    out = lookup(frame, stats, ["g"], weight="n", broadcast_rows=0, hot_share=10, salts=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_rows_without_a_key_are_spread_and_kept(spark):
    facts = spark.range(400).select("id", F.when(c("id") % 4 == 0, F.lit("a")).alias("k"))
    stats = materialize(facts.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("v")))
    out = lookup(facts, stats, ["k"], weight="n", broadcast_rows=0, salts=8)
    assert out.count() == 400 and out.where("v = 1").count() == 100
    assert out.where("k is null and v is not null").isEmpty()


def test_lookup_keeps_unmatched_rows(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    stats = materialize(spark.createDataFrame([("a", 5, 1)], "k string, v int, n bigint"))
    for limit in (10, 0):
        rows = lookup(facts, stats, ["k"], weight="n", broadcast_rows=limit).orderBy("id").collect()
        assert [r["v"] for r in rows] == [5, None, None]


@pytest.mark.parametrize("limit", [100_000, 20])
def test_percent_ranks_of_small_and_large_groups(spark, frame, skewed, limit):
    """Groups up to the limit are ordered in one shuffle; either way gives the same ranks."""
    got = ordering.percent_ranks(frame, "g", ["x", "z"], ["id"], "_r", group_rows=limit).toPandas().set_index("id").sort_index()
    for name in ("x", "z"):
        np.testing.assert_allclose(got[f"{name}_r"].astype(float), skewed.groupby("g")[name].rank(pct=True), rtol=1e-12)


def test_medians_order_few_values(spark, monkeypatch):
    """Only values near the median are ordered, and a range that misses it is not trusted."""
    ordered = []
    climb = ordering.climb
    monkeypatch.setattr(ordering, "SMALL_ROWS", 1000)
    monkeypatch.setattr(ordering, "climb", lambda steps, *a: climb(ordered.append(steps.count()) or steps, *a))
    df = spark.range(20_000).select(F.hash("id").alias("x"), (c("id") % 2).alias("flag"), F.lit(None).cast("double").alias("none"))
    rows = df.toPandas()
    wanted = {"x": rows["x"].median(), "flag": rows["flag"].median()}
    assert ordering.medians(df, ["x", "flag", "none"]) == wanted
    assert sum(ordered) < 1000
    monkeypatch.setattr(ordering, "near_quantiles", lambda df, n, q: {(i, 0): (5e9, 6e9) for i in range(n)})
    assert ordering.medians(df, ["x", "flag", "none"]) == wanted


def test_column_quantiles_of_nan_and_ends(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i > 2 else float(i)) for i in range(6)], "x double, y double")
    wanted = {"lo": 0.0, "p25": 0.25, "hi": 1.0}
    rows = {r["column"]: r for r in ordering.column_quantiles(df, ["x", "y"], wanted).collect()}
    assert [rows["x"][n] for n in wanted] == [0.0, 1.25, 5.0]
    assert [str(rows["y"][n]) for n in wanted] == ["0.0", "1.25", "nan"]


def test_ranks_take_more_tasks_for_more_rows(spark, monkeypatch):
    """A task's rows depend on the slice, not on the session's four shuffle partitions."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 100)
    preds = materialize(spark.range(3000).selectExpr("'a' AS model", "'r' || id AS record_id", "id * 7919 % 3001 / 3001 AS pred"))
    ranked = blending.rank_average(preds, ["model"], "record_id")
    target = preds.select("record_id", F.col("pred").alias("y"))
    mapped = calibrate.remap_ranks(ranked, target, "y", "record_id")
    for df in (ordering.ordinal_positions(preds, ["model"], "pred", "record_id"), ranked, mapped):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 700
