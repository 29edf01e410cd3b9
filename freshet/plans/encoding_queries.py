"""Category codes, target encodings, folds and union over the observations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from freshet.constants import CATEGORICAL, ENCODING_PRODUCTS, TARGET, TARGET_ENCODINGS
from freshet.functions import features as fx
from freshet.functions.scalars import logit
from freshet.operators import encoding, folds, stats
from freshet.plans.common import over_obs, tidy, tidy_sql
from freshet.sources.tables import labelled, observations, unlabelled

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


def codes_sql(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS code,"
        f" rows_of_key FROM (SELECT coalesce({n}, 'nan') AS category, count(*) AS rows_of_key FROM obs GROUP BY 1)"
        for n in names
    )


@query("label_codes", over_obs(codes_sql(CATEGORICAL)))
def label_codes(spark, folder):
    return encoding.label_codes(observations(spark, folder), CATEGORICAL)


def applied_sql() -> str:
    ctes, columns, joins = "", [], ""
    for n in CATEGORICAL:
        ctes += (f", k_{n} AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS code"
                 f" FROM (SELECT DISTINCT coalesce({n}, 'nan') AS category FROM train))")
        columns.append(f"coalesce(k_{n}.code, 0) AS {n}")
        joins += f" LEFT JOIN k_{n} ON k_{n}.category = coalesce(test.{n}, 'nan')"
    misses = " + ".join(f"CASE WHEN k_{n}.code IS NULL THEN 1 ELSE 0 END" for n in CATEGORICAL)
    return over_obs(
        f"SELECT record_id, {', '.join(columns)}, {misses} AS unseen_categories FROM test{joins}", ctes
    )


@query("label_apply", applied_sql())
def label_apply(spark, folder):
    """Codes learnt on the training rows, applied to the others."""
    obs = observations(spark, folder).select("record_id", "split", *CATEGORICAL)
    codes = encoding.label_codes(labelled(obs), CATEGORICAL)
    coded = encoding.apply_codes(unlabelled(obs).drop("split"), codes, CATEGORICAL, unseen=True)
    return coded.select("record_id", *CATEGORICAL, "unseen_categories")


HOT = {
    "soil_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "urban_rural": ["Rural", "Urban"],
}


@query("one_hot", over_obs("SELECT record_id, " + ", ".join(
    f"CASE WHEN {n} = '{v}' THEN 1 ELSE 0 END AS {n}_is_{v}" for n, vs in HOT.items() for v in vs)
    + " FROM obs"))
def one_hot(spark, folder):
    """Classes come from the rows with a category; a missing one gives zeros."""
    obs = observations(spark, folder).select("record_id", *HOT)
    classes = {n: encoding.distinct_categories(obs.where(c(n).isNotNull()), n) for n in HOT}
    return encoding.one_hot(obs, classes).drop(*HOT)


def hot_places_sql() -> str:
    ctes, picks, joins = "", [], ""
    for n in HOT:
        ctes += (f", h_{n} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS at"
                 f" FROM (SELECT DISTINCT coalesce({n}, 'missing') AS v FROM train))")
        picks.append(f"coalesce(h_{n}.at, -1) AS {n}_at, CASE WHEN h_{n}.at IS NULL THEN 0 ELSE 1 END AS {n}_ones")
        joins += f" LEFT JOIN h_{n} ON h_{n}.v = coalesce(obs.{n}, 'missing')"
    return over_obs(f"SELECT record_id, {', '.join(picks)} FROM obs{joins}", ctes)


@query("one_hot_vectors", hot_places_sql())
def one_hot_vectors(spark, folder):
    """0/1 vectors of any number of classes, learnt from the training rows: where the one is, and how many there are."""
    obs = observations(spark, folder).select("record_id", "split", *HOT)
    found = encoding.fit_one_hot(labelled(obs), list(HOT)).transform(encoding.fill_missing(obs, list(HOT)))
    out = []
    for n in HOT:
        values = vector_to_array(f"{n}_hot")
        out += [(F.array_position(values, 1.0) - 1).cast("int").alias(f"{n}_at"), F.size(F.filter(values, lambda x: x != 0)).alias(f"{n}_ones")]
    return found.select("record_id", *out)


def full_te_sql(rows: str, y: str = "flood_risk_score", columns=TARGET_ENCODINGS, source: str = "train") -> str:
    picks, joins = [], ""
    for n, s in columns:
        joins += (f" LEFT JOIN (SELECT coalesce({n}, 'nan') AS key, (sum({y}) + (SELECT avg({y}) FROM {source}) * {s})"
                  f" / (count(*) + {s}) AS enc FROM {source} GROUP BY 1) e_{n} ON e_{n}.key = coalesce(r.{n}, 'nan')")
        picks.append(f"coalesce(e_{n}.enc, (SELECT avg({y}) FROM {source})) AS {n}_te")
    return f"SELECT record_id, {', '.join(picks)} FROM {rows} r{joins}"


@query("te_full", tidy_sql(over_obs(full_te_sql("test")), [f"{n}_te" for n in NAMES]))
def te_full(spark, folder):
    """Encodings of all training rows, attached to the others."""
    obs = observations(spark, folder)
    train, test = labelled(obs), unlabelled(obs)
    mean = encoding.mean_of(train, TARGET)
    table = encoding.encoding_table(train, TARGET_ENCODINGS, TARGET, mean)
    out = encoding.attach_encodings(test, table, NAMES, mean)
    return tidy(out.select("record_id", *[f"{n}_te" for n in NAMES]))


@query("te_table", tidy_sql(over_obs(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", coalesce({n}, 'nan') AS category, count(*) AS rows_of_key,"
    f" (sum(flood_risk_score) + (SELECT avg(flood_risk_score) FROM train) * {s}) / (count(*) + {s}) AS enc"
    f" FROM train GROUP BY 2" for n, s in TARGET_ENCODINGS)), ["enc"]))
def te_table(spark, folder):
    train = labelled(observations(spark, folder))
    return tidy(encoding.encoding_table(train, TARGET_ENCODINGS, TARGET, encoding.mean_of(train, TARGET)))


def fold_te_sql(columns, y: str = "flood_risk_score", prior: str = "global") -> str:
    """Each fold's encodings from the rows of the other folds, fold by fold."""
    ctes, picks, joins = "", [], ""
    mean = f"(SELECT avg({y}) FROM train)"
    if prior == "fold":
        ctes += (f", fm AS (SELECT f.fold, avg(t.{y}) AS m FROM (SELECT DISTINCT fold FROM train) f"
                 f" JOIN train t ON t.fold <> f.fold GROUP BY f.fold)")
        joins += " JOIN fm ON fm.fold = r.fold"
        mean = "fm.m"
    for n, s in columns:
        ctes += f""", s_{n} AS (SELECT coalesce({n}, 'nan') AS key, fold, sum({y}) AS s, count(*) AS n
          FROM train GROUP BY 1, 2),
          o_{n} AS (SELECT f.fold, key, sum(s) AS s, sum(n) AS n FROM (SELECT DISTINCT fold FROM train) f
          JOIN s_{n} ON s_{n}.fold <> f.fold GROUP BY f.fold, key)"""
        joins += f" LEFT JOIN o_{n} ON o_{n}.key = coalesce(r.{n}, 'nan') AND o_{n}.fold = r.fold"
        picks.append(f"coalesce((o_{n}.s + {mean} * {s}) / (o_{n}.n + {s}), {mean}) AS {n}_te")
    return over_obs(f"SELECT record_id, {', '.join(picks)} FROM train r{joins}", ctes)


@query("te_fold_safe", tidy_sql(fold_te_sql(TARGET_ENCODINGS), [f"{n}_te" for n in NAMES]))
def te_fold_safe(spark, folder):
    train = labelled(observations(spark, folder)).select("record_id", "fold", TARGET, *NAMES)
    encoded = encoding.fold_safe_encode(train, TARGET_ENCODINGS, TARGET, "fold")
    return tidy(encoded.select("record_id", *[f"{n}_te" for n in NAMES]))


@query("te_fold_prior", tidy_sql(fold_te_sql([("district", 10.0)], prior="fold"), ["district_te"]))
def te_fold_prior(spark, folder):
    """Smoothing towards the mean of the other folds."""
    train = labelled(observations(spark, folder)).select("record_id", "fold", TARGET, "district")
    encoded = encoding.fold_safe_encode(train, [("district", 10.0)], TARGET, "fold", prior="fold")
    return tidy(encoded.select("record_id", "district_te"))


LOGIT_Y = ("ln(least(greatest(flood_risk_score, 0.000001), 0.999999)"
           " / (1.0 - least(greatest(flood_risk_score, 0.000001), 0.999999)))")


@query("te_logit", tidy_sql(
    fold_te_sql([("place_name", 5.0), ("soil_type", 10.0)], y=LOGIT_Y), ["place_name_te", "soil_type_te"]))
def te_logit(spark, folder):
    """Encodings of the log-odds of the target."""
    train = labelled(observations(spark, folder)).select(
        "record_id", "fold", "place_name", "soil_type", logit(c(TARGET)).alias("z")
    )
    encoded = encoding.fold_safe_encode(train, [("place_name", 5.0), ("soil_type", 10.0)], "z", "fold")
    return tidy(encoded.select("record_id", "place_name_te", "soil_type_te"))


INTERACTED = ["district", "flood_occurrence_current_event", "soil_type"]
FEATURE_SQL = {"river_clip": "greatest(distance_to_river_m, 0)"}


@query("te_interactions", tidy_sql(over_obs(
    "SELECT r.record_id, " + ", ".join(
        f"t.{e}_te * {FEATURE_SQL.get(f, 'r.' + f)} AS {name}" for f, e, name in ENCODING_PRODUCTS)
    + ", t.district_te * t.district_te AS dist_te_sq FROM test r JOIN ("
    + full_te_sql("test", columns=[(n, 10.0) for n in INTERACTED]) + ") t ON t.record_id = r.record_id"),
    [name for _, _, name in ENCODING_PRODUCTS] + ["dist_te_sq"]))
def te_interactions(spark, folder):
    """The encodings of a row times its measures."""
    obs = fx.add(observations(spark, folder), {"river_clip": fx.interactions()["river_clip"]})
    columns = [(n, 10.0) for n in INTERACTED]
    train = labelled(obs)
    mean = encoding.mean_of(train, TARGET)
    table = encoding.encoding_table(train, columns, TARGET, mean)
    encoded = encoding.attach_encodings(unlabelled(obs), table, INTERACTED, mean)
    block = fx.encoding_products(encoded.columns)
    block["dist_te_sq"] = c("district_te") * c("district_te")
    return tidy(encoded.select("record_id", *[x.alias(n) for n, x in block.items()]))


@query("te_correlation", tidy_sql(
    "SELECT 'district' AS \"column\", corr(t.district_te, r.flood_risk_score) AS corr FROM ("
    + fold_te_sql([("district", 10.0), ("place_name", 5.0)])
    + ") t JOIN (" + over_obs("SELECT record_id, flood_risk_score FROM obs") + ") r USING (record_id)"
    + " UNION ALL SELECT 'place_name', corr(t.place_name_te, r.flood_risk_score) FROM ("
    + fold_te_sql([("district", 10.0), ("place_name", 5.0)])
    + ") t JOIN (" + over_obs("SELECT record_id, flood_risk_score FROM obs") + ") r USING (record_id)",
    ["corr"]))
def te_correlation(spark, folder):
    train = labelled(observations(spark, folder)).select("record_id", "fold", TARGET, "district", "place_name")
    encoded = encoding.fold_safe_encode(train, [("district", 10.0), ("place_name", 5.0)], TARGET, "fold")
    corrs = stats.correlations(encoded, ["district_te", "place_name_te"], TARGET)
    return tidy(corrs.select(F.replace("column", F.lit("_te"), F.lit("")).alias("column"), "corr"))


@query("union_split", over_obs(
    "SELECT split, count(*) AS \"rows\", count(flood_risk_score) AS labelled, count(DISTINCT record_id) AS records"
    " FROM (SELECT split, record_id, flood_risk_score FROM train"
    " UNION ALL SELECT split, record_id, NULL FROM test) GROUP BY split"))
def union_split(spark, folder):
    """Both tables in one, told apart again by the split."""
    obs = observations(spark, folder)
    both = folds.union_splits(labelled(obs).drop("split"), unlabelled(obs).drop("split", TARGET))
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(TARGET).alias("labelled"),
        F.count_distinct("record_id").alias("records"),
    )


@query("fold_sizes", over_obs(
    "SELECT CAST((number * 7919 + 42) % 10 AS INT) AS fold, count(*) AS \"rows\" FROM obs GROUP BY 1"))
def fold_sizes(spark, folder):
    obs = observations(spark, folder).withColumn("fold", folds.arithmetic_fold(c("number"), 10))
    return obs.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


def seeded_fold_sql(seed: str, count: int) -> str:
    digit = lambda i: f"strpos('123456789abcdef', substr(md5({seed} || ':' || record_id), {i}, 1))"
    return f"CAST(({digit(1)} * 256 + {digit(2)} * 16 + {digit(3)}) % {count} AS INT)"


@query("repeated_folds", over_obs(
    f"SELECT record_id, CAST(repeat AS INT) AS repeat, {seeded_fold_sql('CAST(42 + repeat AS VARCHAR)', 5)} AS fold"
    " FROM train, (SELECT unnest([0, 1, 2]) AS repeat)"))
def repeated_folds(spark, folder):
    """Three assignments to five folds, each by a hash with a seed of its own."""
    train = labelled(observations(spark, folder)).select("record_id")
    repeated = folds.with_repeated_folds(train, lambda r: folds.seeded_fold(c("record_id"), 5, r + 42), 3)
    return repeated.select("record_id", "repeat", "fold")


@query("second_level_folds", over_obs(
    "SELECT fold, CAST((number * 7919 + 141) % 5 AS INT) AS meta_fold, count(*) AS \"rows\" FROM train GROUP BY 1, 2"))
def second_level_folds(spark, folder):
    train = labelled(observations(spark, folder))
    train = train.withColumn("meta_fold", folds.arithmetic_fold(c("number"), 5, seed=42 + 99))
    return train.groupBy("fold", "meta_fold").agg(F.count(F.lit(1)).alias("rows"))


@query("distinct_classes", over_obs(" UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS \"column\", coalesce({n}, 'nan') AS category FROM obs" for n in CATEGORICAL)))
def distinct_classes(spark, folder):
    return encoding.categories_long(observations(spark, folder), CATEGORICAL).distinct()


@query("pseudo_labels", tidy_sql(over_obs("""
SELECT record_id, fold, flood_risk_score, false AS is_pseudo FROM train
UNION ALL SELECT record_id, NULL, least(greatest(0.3 + coalesce(rainfall_7d_mm, 0) * 0.001, 0), 1), true FROM test"""),
    ["flood_risk_score"]))
def pseudo_labels(spark, folder):
    """Training rows plus the others with a predicted target, which validate nothing."""
    obs = observations(spark, folder).select("record_id", "split", "fold", TARGET, "rainfall_7d_mm")
    predicted = unlabelled(obs).select(
        "record_id",
        F.least(F.greatest(F.coalesce("rainfall_7d_mm", F.lit(0.0)) * 0.001 + 0.3, F.lit(0.0)), F.lit(1.0)).alias("pred"),
    )
    rows = folds.add_pseudo_rows(
        labelled(obs), unlabelled(obs).drop("fold"), predicted, "record_id", TARGET, "pred"
    )
    return tidy(rows.select("record_id", "fold", TARGET, "is_pseudo"))
