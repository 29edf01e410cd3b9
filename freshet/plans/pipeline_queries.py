"""Tables that grow by batches, sketches, quarantines and caches, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.constants import LEVEL_THRESHOLDS, NUMERIC_BOUNDS, NUMERIC_INPUTS, TARGET, TARGET_ENCODINGS, VOCABULARIES
from freshet.durable import materialize, scratch
from freshet.operators import incremental, planner, quarantine, sketches, stats, validation
from freshet.plans.common import array_text, over_obs, over_scenarios, sql, tidy, tidy_sql
from freshet.plans.stats_queries import PROFILED, kind_of
from freshet.sources import files
from freshet.sources.schemas import observation_schema
from freshet.sources.tables import labelled, observations, requests

c = F.col
QUERIES, ORACLES = {}, {}
NAMES = [n for n, _ in TARGET_ENCODINGS]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


# Encodings from a stored state.

def batches(spark, folder):
    """A state that has taken the training rows in three batches."""
    train = labelled(observations(spark, folder)).select("number", "fold", TARGET, *NAMES)
    state = incremental.fresh_state(spark)
    for rest in range(3):
        state.add(train.where(c("number") % 3 == rest), TARGET_ENCODINGS, TARGET)
    return state


@query("te_incremental", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", coalesce({n}, 'nan') AS category, count(*) AS rows_of_key,"
    f" (sum(flood_risk_score) + (SELECT avg(flood_risk_score) FROM train) * {s}) / (count(*) + {s}) AS enc"
    f" FROM train GROUP BY 2" for n, s in TARGET_ENCODINGS)), ["enc"]))
def te_incremental(spark, folder):
    """Encodings after three batches, as of one run over all rows."""
    return tidy(incremental.encodings(batches(spark, folder).read(), TARGET_ENCODINGS))


@query("te_incremental_folds", tidy_sql(over_obs(" UNION ALL ".join(f"""
SELECT '{n}' AS "column", k.category, k.fold, k.n AS rows_of_key,
  (t.s - k.s + (SELECT avg(flood_risk_score) FROM train) * {s}) / (t.n - k.n + {s}) AS enc
FROM (SELECT coalesce({n}, 'nan') AS category, fold, sum(flood_risk_score) AS s, count(*) AS n FROM train GROUP BY 1, 2) k
JOIN (SELECT coalesce({n}, 'nan') AS category, sum(flood_risk_score) AS s, count(*) AS n FROM train GROUP BY 1) t USING (category)"""
    for n, s in TARGET_ENCODINGS)), ["enc"]))
def te_incremental_folds(spark, folder):
    """Each fold's encodings without its own rows, from the same state."""
    out = incremental.encodings(batches(spark, folder).read(), TARGET_ENCODINGS, leave_out=True)
    return tidy(out.select("column", "category", "fold", "rows_of_key", "enc"))


# Profiles from sketches.

@query("sketch_profile", over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{kind_of(n)}' AS dtype, count(*) AS \"rows\", count(*) - count({n}) AS missing,"
    f" count(DISTINCT {n}) AS distinct_values, true AS near FROM obs" for n in PROFILED)))
def sketch_profile(spark, folder):
    """All columns of the observations from sketches of each split, beside the exact counts.

    `near` says whether the estimate lies within the stated bound of the exact count.
    """
    obs = materialize(observations(spark, folder).select(*PROFILED))
    parts = sketches.sketched(obs.where("split = 'train'")).unionByName(sketches.sketched(obs.where("split = 'test'")))
    found = sketches.merged_profile(parts).join(stats.column_profile(obs).drop("dtype", "missing"), "column")
    apart = F.abs(c("distinct_estimate") - c("distinct_values"))
    near = apart <= F.greatest(F.lit(1.0), sketches.BOUND * c("distinct_values"))
    return found.select("column", "dtype", "rows", "missing", "distinct_values", near.alias("near"))


# Quarantine in one scan.

CHECKED = [n for n, _, _ in NUMERIC_BOUNDS if n != "is_synthetic"]
LISTED = {**VOCABULARIES}


def flag_sql() -> str:
    return "CASE WHEN is_synthetic = 'True' THEN 1 WHEN is_synthetic = 'False' THEN 0 END"


def rule_counts_sql() -> str:
    parts = []
    bounds = {n: (low, high) for n, low, high in NUMERIC_BOUNDS}
    for n, (low, high) in bounds.items():
        value = n if n != "is_synthetic" else f"({flag_sql()})"
        if low is not None:
            parts.append((f"{n}>={low}", f"{value} < {low}"))
        if high is not None:
            parts.append((f"{n}<={high}", f"{value} > {high}"))
    for n, values in LISTED.items():
        value = n if n != "model_version" else "['v13', 'v9', NULL, 'ensemble'][number % 4 + 1]"
        parts.append((f"{n} in list", f"NOT list_contains({array_text(values)}, {value})"))
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS \"rows\" FROM obs WHERE {test}" for rule, test in parts)


def requested_rows(spark, folder):
    """Observations as requests, with a model version and is_synthetic as a number."""
    versions = F.array(F.lit("v13"), F.lit("v9"), F.lit(None).cast("string"), F.lit("ensemble"))
    obs = observations(spark, folder)
    flag = F.when(c("is_synthetic") == "True", 1).when(c("is_synthetic") == "False", 0)
    words = [n for n in LISTED if n != "model_version"]
    return obs.select(
        "record_id", *CHECKED, *words, flag.alias("is_synthetic"), F.get(versions, c("number") % 4).alias("model_version")
    )


@query("quarantine_counts", sql(over_obs(f"""
SELECT rule, "rows" FROM ({rule_counts_sql()}) WHERE "rows" > 0""")))
def quarantine_counts(spark, folder):
    """How often each rule is broken, counted while accepted and rejected rows are written."""
    return quarantine.quarantine(requested_rows(spark, folder), scratch(spark, "quarantine")).counts(spark)


@query("csv_quarantine", tidy_sql(over_obs("""
SELECT record_id, number % 13 = 5 AS rejected, CASE WHEN number % 13 <> 5 THEN rainfall_7d_mm END AS rainfall_7d_mm FROM obs"""),
    ["rainfall_7d_mm"]))
def csv_quarantine(spark, folder):
    """CSV lines that do not fit the schema are kept and told apart in the scan that reads the others."""
    path = scratch(spark, "csv")
    spoilt = F.when(c("number") % 13 == 5, F.concat(F.lit("wet"), c("number").cast("string"))).otherwise(c("rainfall_7d_mm").cast("string"))
    rows = observations(spark, folder).select("record_id", "district", spoilt.alias("rainfall_7d_mm"))
    rows.write.option("header", True).csv(path)
    read = files.read_csv(spark, path, observation_schema(), corrupt="line")
    known = read.select("record_id", "rainfall_7d_mm", "line")
    broken = {"fits the schema": c("line").isNotNull()}
    found = quarantine.quarantine(known, scratch(spark, "quarantine"), broken)
    # The line is all that is left of a rejected row; its first field is the id.
    kept = found.accepted_rows(spark).select("record_id", F.lit(False).alias("rejected"), "rainfall_7d_mm")
    dropped = found.rejected_rows(spark).select(
        F.split("line", ",")[0].alias("record_id"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("rainfall_7d_mm")
    )
    return tidy(kept.unionByName(dropped))


@query("plan_rejections", over_scenarios(f"""
SELECT number, concat_ws('; ',
  CASE WHEN number % 17 = 3 THEN 'unsupported target_risk_level Severe' WHEN number % 19 = 4 THEN 'unsupported target_risk_level null'
       WHEN NOT list_contains({array_text(list(LEVEL_THRESHOLDS))}, target_risk_level) THEN 'unsupported target_risk_level ' || target_risk_level END,
  CASE WHEN number % 23 = 5 THEN 'unsupported budget_profile free' END) AS violations
FROM requests WHERE number % 17 = 3 OR number % 19 = 4 OR number % 23 = 5 OR NOT list_contains({array_text(list(LEVEL_THRESHOLDS))}, target_risk_level)"""))
def plan_rejections(spark, folder):
    """Planning requests whose arguments no plan can work on, each with what is wrong."""
    number = c("number")
    asked = requests(spark, folder).withColumns({
        "target_risk_level": F.when(number % 17 == 3, "Severe").when(number % 19 == 4, None).otherwise(c("target_risk_level")),
        "budget_profile": F.when(number % 23 == 5, "free").otherwise(c("budget_profile")),
    })
    _, rejected = planner.split_requests(asked)
    return rejected.select("number", F.array_join("violations", "; ").alias("violations"))


@query("feature_cache", over_obs("""
SELECT split, count(*) AS "rows", count(*) AS again, count(*) FILTER (number % 2 = 0) AS rebuilt FROM obs GROUP BY split"""))
def feature_cache(spark, folder):
    """All features written by the first run, read by the second, and built anew where their plan differs."""
    path, inputs = scratch(spark, "features"), [f"{folder}/orders.parquet", f"{folder}/lineitem.parquet"]
    count = lambda df, name: df.groupBy("split").agg(F.count(F.lit(1)).alias(name))
    build = lambda: observations(spark, folder).select("record_id", "number", "split", *NUMERIC_INPUTS)
    first = materialize(count(files.cached_table(spark, path, build, inputs), "rows"))
    again = materialize(count(files.cached_table(spark, path, build, inputs), "again"))
    other = lambda: build().where("number % 2 = 0")
    rebuilt = materialize(count(files.cached_table(spark, path, other, inputs), "rebuilt"))
    return first.join(again, "split").join(rebuilt, "split")
