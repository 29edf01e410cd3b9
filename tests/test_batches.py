"""Stored sums, sketches, quarantines and resumed grids."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import encoding, grid_runs, incremental, quarantine, sketches, stats
from freshet.operators.training import Config, estimator

c = F.col


@pytest.fixture(scope="module")
def rows(spark):
    kind = F.when(c("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (c("id") % 5).cast("string")))
    return spark.range(400).select("id", kind.alias("kind"), (c("id") % 3).cast("int").alias("fold"), (c("id") % 10 / 10).alias("y"))


def test_batches_add_up(spark, rows, tmp_path):
    columns = [("kind", 4.0)]
    state = incremental.EncodingState(spark, str(tmp_path / "state"))
    assert state.read().count() == 0
    for part in range(3):
        state.add(rows.where(c("id") % 3 == part), columns, "y")
    whole = incremental.batch_state(rows, columns, "y")
    key = lambda df: sorted((r["column"], r["category"], r["fold"], round(r["_s"], 9), r["_n"]) for r in df.collect())
    assert key(state.read()) == key(whole)
    table = encoding.encoding_table(rows, columns, "y", encoding.mean_of(rows, "y"))
    got = {r["category"]: r["enc"] for r in incremental.encodings(state.read(), columns).collect()}
    assert got == pytest.approx({r["category"]: r["enc"] for r in table.collect()})


def test_an_incomplete_version_is_not_read(spark, rows, tmp_path):
    state = incremental.EncodingState(spark, str(tmp_path / "state"))
    state.add(rows, [("kind", 4.0)], "y")
    before = state.read().count()
    (tmp_path / "state" / "v1").mkdir()  # a writer that failed
    assert state.versions() == [0] and state.read().count() == before
    state.add(rows, [("kind", 4.0)], "y")
    assert state.versions() == [0, 1]
    assert state.read().agg(F.sum("_n")).first()[0] == 2 * rows.count()


def test_sketches_merge_to_the_whole(spark, rows):
    parts = sketches.sketched(rows.where("id < 150")).unionByName(sketches.sketched(rows.where("id >= 150")))
    merged = {r["column"]: r for r in sketches.merged_profile(parts).collect()}
    whole = {r["column"]: r for r in sketches.merged_profile(sketches.sketched(rows)).collect()}
    for name, r in whole.items():
        assert merged[name]["distinct_estimate"] == pytest.approx(r["distinct_estimate"], rel=0.01)
    for r in stats.column_profile(rows).collect():
        assert abs(merged[r["column"]]["distinct_estimate"] - r["distinct_values"]) <= max(1, 0.06 * r["distinct_values"])
        assert merged[r["column"]]["missing"] == r["missing"] and merged[r["column"]]["rows"] == 400
    empty = sketches.merged_profile(sketches.sketched(rows.limit(0))).collect()
    assert all(r["rows"] == r["missing"] == r["distinct_estimate"] == 0 for r in empty)


def test_quarantine_counts_what_it_writes(spark, rows, tmp_path):
    broken = {"small": c("y") > 0.65, "known": c("kind").isNull()}
    found = quarantine.quarantine(rows, str(tmp_path / "q"), broken)
    assert found.rows == 400 and found.broken == {"small": rows.where("y > 0.65").count(), "known": rows.where("kind IS NULL").count()}
    assert found.accepted_rows(spark).columns == rows.columns
    assert found.accepted_rows(spark).count() == rows.where("y <= 0.65 AND kind IS NOT NULL").count() == 400 - found.rejected
    assert found.rejected_rows(spark).where("size(violations) = 0").count() == 0


def test_units_are_trained_once(spark, tmp_path):
    train = spark.range(90).select(
        c("id").cast("string").alias("record_id"), c("id"), (c("id") % 9).cast("double").alias("a"), (c("id") % 9 / 9).alias("y")
    )
    configs = [Config("cat_d2", "cat", {"maxDepth": 2}), Config("lgb_huber", "lgb", {"maxDepth": 2, "lossType": "huber"})]
    path, wanted = str(tmp_path / "grid"), grid_runs.units(configs, [1], 1, 2)
    run = lambda units: grid_runs.run_units(
        train, train.drop("y"), ["a"], "y", units, path, lambda r: c("id") % 2, workers=2, maxIter=2
    )
    first = run(wanted[:1])
    (tmp_path / "grid" / "model=cat_d2_s1" / "seed=1" / "repeat=0" / "fold=1").mkdir(parents=True)  # a writer that was killed
    assert len(first) == 1 and run(wanted) == wanted[1:] and run(wanted) == []
    counts = {(r["model"], r["fold"], r["split"]): r["count"] for r in grid_runs.read_units(spark, path).groupBy("model", "fold", "split").count().collect()}
    assert counts == {(m, f, s): n for m in ("cat_d2_s1", "lgb_huber_s1") for f in (0, 1) for s, n in (("train", 45), ("test", 90))}
    assert grid_runs.averaged(grid_runs.read_units(spark, path)).count() == 2 * (90 + 90)


def test_every_family_has_its_own_learner():
    kinds = {name: type(estimator(Config(name, family, options), 1, "y")).__name__ for name, family, options in (
        ("lgb_huber", "lgb", {"lossType": "huber"}), ("lgb_mae", "lgb", {"lossType": "absolute"}), ("rf", "rf", {}), ("et", "et", {}))}
    assert kinds == {"lgb_huber": "HuberBoosting", "lgb_mae": "GBTRegressor", "rf": "RandomForestRegressor", "et": "ExtraTrees"}
