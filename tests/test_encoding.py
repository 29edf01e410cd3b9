import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import encoding, folds

c = F.col


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 800
    return pd.DataFrame({
        "record_id": [f"F{i}" for i in range(n)],
        "place": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 60, n).astype(str)),
        "y": rng.random(n), "fold": rng.integers(0, 5, n).astype("int32"),
    })


def loop_encoding(data, smooth, prior):
    """Leave-one-fold-out means, fold by fold."""
    out = np.zeros(len(data))
    for fold in range(5):
        rest, own = data[data.fold != fold], data.fold == fold
        mean = data.y.mean() if prior == "global" else rest.y.mean()
        s = rest.groupby("place").y.agg(["sum", "count"])
        enc = (s["sum"] + mean * smooth) / (s["count"] + smooth)
        out[own] = data[own].place.map(enc).fillna(mean)
    return out


def test_fold_safe_encoding_equals_the_loop(spark, data):
    df = spark.createDataFrame(data)
    got = encoding.fold_safe_encode(df, [("place", 5.0)], "y", "fold")
    got = got.toPandas().set_index("record_id").loc[data.record_id, "place_te"]
    np.testing.assert_allclose(got, loop_encoding(data, 5.0, "global"), rtol=1e-12)


def test_fold_prior(spark, data):
    """With the other folds' mean as prior, keys seen elsewhere follow the loop."""
    df = spark.createDataFrame(data)
    got = encoding.fold_safe_encode(df, [("place", 5.0)], "y", "fold", prior="fold")
    got = got.toPandas().set_index("record_id").loc[data.record_id, "place_te"]
    np.testing.assert_allclose(got, loop_encoding(data, 5.0, "fold"), rtol=1e-12)


def test_key_of_one_fold_gets_the_prior(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0), ("a", 0.0, 0), ("b", 0.5, 0), ("b", 0.7, 1)], "k string, y double, fold int"
    )
    got = encoding.fold_safe_encode(df, [("k", 10.0)], "y", "fold")
    assert [r["k_te"] for r in got.where("k = 'a'").collect()] == pytest.approx([0.55, 0.55])


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("x", 1.0, 0), (None, 0.0, 1), (None, 0.5, 0)], "k string, y double, fold int")
    test = spark.createDataFrame([("new", 1), (None, 2), ("x", 3)], "k string, id int")
    both = folds.union_splits(train, test)
    got = encoding.fold_safe_encode(both, [("k", 1.0)], "y", "fold", train=c("split") == "train")
    rows = {r["id"]: r["k_te"] for r in got.where("split = 'test'").collect()}
    assert rows[1] == pytest.approx(0.5)
    assert rows[2] == pytest.approx((0.5 + 0.5) / 3)
    assert rows[3] == pytest.approx((1.0 + 0.5) / 2)


def test_codes_count_up_in_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("B",), (None,), ("a",), ("b",)], "k string")
    rows = encoding.label_codes(df, ["k"]).orderBy("code").collect()
    assert [(r["category"], r["code"], r["rows_of_key"]) for r in rows] == [
        ("B", 0, 1), ("a", 1, 1), ("b", 2, 2), ("nan", 3, 1)]


def test_applied_codes(spark):
    codes = encoding.label_codes(spark.createDataFrame([("b",), ("missing",)], "k string"), ["k"])
    out = encoding.apply_codes(
        spark.createDataFrame([("b", 1), ("zzz", 2)], "k string, id int"), codes, ["k"], unseen=True
    ).orderBy("id").collect()
    assert [(r["k"], r["unseen_categories"]) for r in out] == [(0, 0), (1, 1)]
    plain = encoding.label_codes(spark.createDataFrame([("c",), ("d",)], "k string"), ["k"])
    out = encoding.apply_codes(spark.createDataFrame([("zzz",)], "k string"), plain, ["k"], "_code").first()
    assert (out["k"], out["k_code"]) == ("zzz", 0)


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, k double")
    out = encoding.standard_scale(df, encoding.scaling_stats(df, ["x", "k"])).orderBy("x").collect()
    assert [(r["x_z"], r["k_z"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_of_unknown_is_zero(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "k string")
    out = encoding.one_hot(df, {"k": ["a", "missing"]}).collect()
    assert [(r["k_is_a"], r["k_is_missing"]) for r in out] == [(1, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError):
        encoding.distinct_categories(df, "k", limit=2)


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("id", c("id").cast("string"))
    a = {r["id"]: r["fold"] for r in folds.with_folds(df.repartition(7), "id", 5).collect()}
    b = {r["id"]: r["fold"] for r in folds.with_folds(df.coalesce(1), "id", 5).collect()}
    assert a == b and set(a.values()) == set(range(5))


def test_repeats_cover_every_row_once(spark):
    df = spark.range(300).withColumn("key", c("id").cast("string"))
    hashed = lambda repeat: F.pmod(F.xxhash64("key", repeat), F.lit(4))
    rows = folds.with_repeated_folds(df, hashed, 3).toPandas()
    assert (rows.groupby("repeat").size() == 300).all()
    first, second = (rows[rows.repeat == r].sort_values("id").fold.to_numpy() for r in (0, 1))
    assert 0.1 < (first == second).mean() < 0.45


def test_pseudo_rows_train_but_never_validate(spark):
    train = spark.createDataFrame([("a", 0.1, 0), ("b", 0.2, 1)], "record_id string, y double, fold int")
    test = spark.createDataFrame([("c", None)], "record_id string, y double")
    labels = spark.createDataFrame([("c", 0.9)], "record_id string, pred double")
    rows = folds.add_pseudo_rows(train, test, labels, "record_id", "y", "pred")
    for fold in (0, 1):
        inside = {r["record_id"] for r in folds.training_rows(rows, fold).collect()}
        held = {r["record_id"] for r in folds.validation_rows(rows, fold).collect()}
        assert "c" in inside and "c" not in held and not inside & held
