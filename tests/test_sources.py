import json

import pytest
from pyspark.sql import functions as F

from freshet.constants import TRACKED_COLUMNS
from freshet.operators import logs, scenario
from freshet.sources import files, tables
from freshet.sources.schemas import PREDICTIONS, observation_schema
from freshet.streaming import log_stream

c = F.col


def test_csv_by_name_with_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("elevation_m,record_id,other\n5.5,F1,x\nNaN,F2,y\n,F3,z\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), observation_schema())
    assert df.dtypes == [("elevation_m", "double"), ("record_id", "string")]
    assert {r["record_id"]: r["elevation_m"] for r in df.collect()} == {"F1": 5.5, "F2": None, "F3": None}


def test_artifacts(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"soil": {"Clay": 0, "nan": 1}, "road": {"Fair": 0}}, indent=1))
    (tmp_path / "medians.json").write_text('{"a": 1.5,\n "b": 2.0}')
    (tmp_path / "columns.json").write_text('["a", "b"]')
    (tmp_path / "mean.json").write_text("0.42")
    rows = files.read_json_maps(spark, str(tmp_path / "codes.json"), "int").collect()
    assert {(r["column"], r["key"], r["value"]) for r in rows} == {("soil", "Clay", 0), ("soil", "nan", 1), ("road", "Fair", 0)}
    assert files.read_json_map(spark, str(tmp_path / "medians.json")) == {"a": 1.5, "b": 2.0}
    assert files.read_json_list(spark, str(tmp_path / "columns.json")) == ["a", "b"]
    assert files.read_json_number(spark, str(tmp_path / "mean.json")) == 0.42
    table = spark.createDataFrame([("soil", "Clay", 0)], "column string, category string, code int")
    files.write_json_rows(table, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 1


def preds(spark, *models):
    rows = [(f"F{i}", s, m, 42, 0, 0, 0.5) for m in models for s in ("train", "test") for i in range(3)]
    return spark.createDataFrame(rows, PREDICTIONS)


def test_predictions_by_model(spark, tmp_path):
    path = str(tmp_path / "preds")
    files.write_predictions(preds(spark, "a", "b"), path)
    files.write_predictions(preds(spark, "b").withColumn("pred", F.lit(0.9)), path)  # replaces b only
    back = files.read_predictions(spark, path)
    means = {r["model"]: r["p"] for r in back.groupBy("model").agg(F.avg("pred").alias("p")).collect()}
    assert means == pytest.approx({"a": 0.5, "b": 0.9})


def test_merge_with_dry_run(spark, tmp_path):
    here, there = str(tmp_path / "here"), str(tmp_path / "there")
    files.write_predictions(preds(spark, "a"), here)
    files.write_predictions(preds(spark, "a", "b", "x"), there)
    count = lambda: files.read_predictions(spark, here).count()
    report = files.merge_predictions(spark, there, here, dry_run=True)
    assert {r["action"]: r["models"] for r in report.collect()} == {"copied": 2, "skipped": 1}
    assert count() == 6
    files.merge_predictions(spark, there, here)
    assert count() == 18
    again = files.merge_predictions(spark, there, here)
    assert {r["action"]: r["models"] for r in again.collect()} == {"skipped": 3}
    assert count() == 18
    with pytest.raises(FileNotFoundError):
        files.require_paths(spark, [here, str(tmp_path / "nowhere")])


def test_submissions(spark, tmp_path):
    df = spark.createDataFrame([("F1", 1.7, "v1"), ("F2", -0.2, "v2")], "record_id string, pred double, variant string")
    files.write_submission(df, str(tmp_path / "one"))
    back = spark.read.option("header", True).csv(str(tmp_path / "one"))
    assert back.columns == ["record_id", "flood_risk_score"]
    assert {r[0]: float(r[1]) for r in back.collect()} == {"F1": 1.0, "F2": 0.0}
    files.write_variants(df, str(tmp_path / "many"))
    assert {p.name for p in (tmp_path / "many").glob("variant=*")} == {"variant=v1", "variant=v2"}


def test_registry(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    versions = [("v1", str(tmp_path / "m1"), 10), ("v2", str(tmp_path / "m2"), 36)]
    rows = files.registry(spark, versions, "v1").collect()
    assert [(r["version"], r["num_base_models"], r["is_default"]) for r in rows] == [("v1", 10, True)]
    rows = files.registry(spark, [(v, p + "x", n) for v, p, n in versions], "v1").collect()
    assert [(r["version"], r["num_base_models"]) for r in rows] == [("v1", 0), ("v2", 0)]


def test_cache_is_built_once_and_never_outdated(spark, tmp_path):
    path, source = str(tmp_path / "cache"), str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    stamp = lambda: sorted(p.name for p in (tmp_path / "cache").glob("*.parquet"))
    build = lambda: spark.read.parquet(source)
    assert files.cached_table(spark, path, build, [source]).count() == 3
    first = stamp()
    assert files.cached_table(spark, path, build, [source]).count() == 3 and stamp() == first
    # Another expression, another version of the code, other input files, no manifest: built again.
    assert files.cached_table(spark, path, lambda: build().where("id > 0"), [source]).count() == 2
    assert files.cached_table(spark, path, build, [source]).count() == 3
    before = stamp()
    assert files.cached_table(spark, path, build, [source], version="2").count() == 3 and stamp() != before
    spark.range(5).write.mode("append").parquet(source)
    assert files.cached_table(spark, path, build, [source], version="2").count() == 8


def test_observations_are_unique_and_in_range(spark, folder):
    obs = tables.observations(spark, folder)
    row = obs.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids"),
        F.min("flood_risk_score").alias("lo"), F.max("flood_risk_score").alias("hi"),
        F.sum((c("distance_to_river_m") < 0).cast("int")).alias("below"),
        F.sum(c("rainfall_7d_mm").isNull().cast("int")).alias("gaps"),
    ).first()
    assert row["n"] == row["ids"] and 0 <= row["lo"] <= row["hi"] <= 1 and row["below"] and row["gaps"]


def test_scans_read_only_what_is_used(spark, folder):
    plan = tables.observations(spark, folder).select("record_id", "rainfall_7d_mm")._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_extendedprice" not in plan and "p_retailprice" not in plan


REQUESTS = "district string, model_version string, rainfall_7d_mm double, asked_at timestamp"


def test_streamed_requests_are_logged_once(spark, tmp_path):
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    batch = spark.sql("SELECT 'Colombo' AS district, 'v13' AS model_version, CAST(id * 30 AS DOUBLE) AS rainfall_7d_mm,"
                      " timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id) AS asked_at FROM range(4)")
    run = lambda: log_stream.simulate_and_log(
        spark.readStream.schema(REQUESTS).parquet(inbox), log, checkpoint).awaitTermination()
    batch.write.mode("append").parquet(inbox)
    run()
    batch.write.mode("append").parquet(inbox)
    run()
    run()
    got = spark.read.parquet(log)
    assert got.count() == 8
    direct = scenario.simulate(scenario.scenario_rows(batch, ["model_version", "asked_at"]))
    expected = sorted(r["flood_risk_score"] for r in direct.collect()) * 2
    assert sorted(r["flood_risk_score"] for r in got.collect()) == sorted(expected)


def test_streamed_histogram(spark, folder, tmp_path):
    log = tables.simulation_log(spark, folder).withColumn("timestamp", c("timestamp").cast("timestamp"))
    log = log.select("id", "timestamp", "flood_risk_score", *TRACKED_COLUMNS, "inference_time_ms")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = log_stream.score_histogram(stream, "1 day").writeStream.format("memory").queryName("hist").outputMode(
        "complete").trigger(availableNow=True).start()
    query.awaitTermination()
    totals = logs.summary(log).first()
    row = spark.sql("SELECT sum(total) AS n, sum(bin_0) AS b0, sum(bin_3) AS b3 FROM hist").first()
    assert (row["n"], row["b0"], row["b3"]) == (totals["total_simulations"], totals["bin_0"], totals["bin_3"])
