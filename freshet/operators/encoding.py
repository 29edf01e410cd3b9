"""Category codes, target encodings, scaling and one-hot columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.functions.features import add
from freshet.operators.ordering import value_ladder

c = F.col
MISSING = "nan"  # the class a missing category belongs to


def as_category(name: str) -> Column:
    """The text of a category; a missing one is a category of its own."""
    return F.coalesce(c(name).cast("string"), F.lit(MISSING))


def categories_long(df: DataFrame, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """(extra, column, category) with one row per row and column."""
    return df.select(*extra, *[as_category(n).alias(n) for n in columns]).unpivot(
        list(extra), columns, "column", "category"
    )


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, category, code, rows_of_key): codes count up in code-point order."""
    counted = categories_long(df, columns).groupBy("column", "category").agg(
        F.count(F.lit(1)).alias("rows_of_key")
    )
    counted = materialize(counted)
    ladder = value_ladder(counted, ["column"], "category")
    codes = ladder.select("column", "category", c("below").cast("int").alias("code"))
    return materialize(codes.join(counted, ["column", "category"]))


def apply_codes(
    df: DataFrame, codes: DataFrame, columns: list[str], suffix: str = "", unseen: bool = False
) -> DataFrame:
    """Replace (or with a suffix add) each column by its code.

    An unseen category gets the code of 'missing', or 0 where there is none.
    With `unseen`, the number of unseen categories of the row is added.
    """
    sizes = entries_per_column(codes)
    fallback = {r["column"]: r["code"] for r in codes.where(c("category") == "missing").collect()}
    misses = []
    for name in columns:
        table = codes.where(c("column") == name).select(
            c("category").alias("_category"), c("code").alias("_code"),
            c("rows_of_key").alias("_rows"),
        )
        df = lookup(
            df.withColumn("_category", as_category(name)), table, ["_category"],
            weight="_rows", size=sizes.get(name, 0),
        ).drop("_category")
        misses.append(c(f"_miss_{name}"))
        df = df.withColumn(f"_miss_{name}", c("_code").isNull().cast("int"))
        code = F.coalesce(c("_code"), F.lit(fallback.get(name, 0)))
        df = df.withColumn(name + suffix, code).drop("_code")
    if unseen:
        total = misses[0]
        for miss in misses[1:]:
            total = total + miss
        df = df.withColumn("unseen_categories", total)
    return df.drop(*[f"_miss_{n}" for n in columns])


def smoothed(total: Column, rows: Column, prior: Column, smoothing: Column) -> Column:
    return F.try_divide(total + prior * smoothing, rows + smoothing)


def smoothing_of(columns: list[tuple[str, float]]) -> Column:
    """The smoothing weight belonging to the value of `column`."""
    out = F.lit(None).cast("double")
    for name, weight in columns:
        out = F.when(c("column") == name, F.lit(float(weight))).otherwise(out)
    return out


def encoding_table(
    train: DataFrame, columns: list[tuple[str, float]], target: str, prior: float
) -> DataFrame:
    """(column, category, enc, rows_of_key): smoothed target mean of every category."""
    sums = categories_long(train, [n for n, _ in columns], [target]).groupBy(
        "column", "category"
    ).agg(F.sum(target).alias("_s"), F.count(target).alias("rows_of_key"))
    return materialize(
        sums.select(
            "column", "category", "rows_of_key",
            smoothed(c("_s"), c("rows_of_key"), F.lit(prior), smoothing_of(columns)).alias("enc"),
        )
    )


def fold_sums(
    train: DataFrame, columns: list[tuple[str, float]], target: str, fold: str
) -> DataFrame:
    """(column, category, fold, _s, _n): all that the encodings need, from one pass."""
    long = categories_long(train, [n for n, _ in columns], [target, fold])
    return materialize(
        long.groupBy("column", "category", fold).agg(
            F.sum(target).alias("_s"), F.count(target).alias("_n")
        )
    )


def fold_encoding_table(
    sums: DataFrame, columns: list[tuple[str, float]], fold: str, prior: float | None
) -> DataFrame:
    """(column, category, fold, enc, rows_of_key): each fold's encoding without its own rows.

    Leaving a fold out is a subtraction from the sums of the category. With no
    `prior`, the mean of the rows outside the fold is used.
    """
    # One row per fold in a window partition.
    key = Window.partitionBy("column", "category")
    rest_s = F.sum("_s").over(key) - c("_s")
    rest_n = F.sum("_n").over(key) - c("_n")
    if prior is None:
        per_fold = sums.where(c("column") == columns[0][0]).groupBy(fold).agg(
            F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn")
        )
        every = Window.partitionBy(F.lit(1))  # one row per fold
        others = F.try_divide(F.sum("_fs").over(every) - c("_fs"), F.sum("_fn").over(every) - c("_fn"))
        sums = sums.join(per_fold.select(fold, others.alias("_prior")), fold)
        mean = c("_prior")
    else:
        mean = F.lit(prior)
    # A category seen in one fold only has rest_n = 0 and falls back to the prior.
    return sums.select(
        "column", "category", fold, c("_n").alias("rows_of_key"),
        smoothed(rest_s, rest_n, mean, smoothing_of(columns)).alias("enc"),
    )


def full_encoding_table(sums: DataFrame, columns: list[tuple[str, float]], prior: float) -> DataFrame:
    """(column, category, enc, rows_of_key) over all folds."""
    total = sums.groupBy("column", "category").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("rows_of_key"))
    return total.select(
        "column", "category", "rows_of_key",
        smoothed(c("_s"), c("rows_of_key"), F.lit(prior), smoothing_of(columns)).alias("enc"),
    )


def mean_of_sums(sums: DataFrame, column: str) -> float:
    row = sums.where(c("column") == column).agg(F.sum("_s"), F.sum("_n")).first()
    return row[0] / row[1]


def attach_encodings(
    df: DataFrame, table: DataFrame, columns: list[str], prior: float,
    fold: str | None = None, suffix: str = "_te",
) -> DataFrame:
    """Add `<column><suffix>`; categories without an entry get the prior."""
    keys = ["_category"] + ([fold] if fold else [])
    sizes = entries_per_column(table)
    for name in columns:
        own = table.where(c("column") == name).select(
            c("category").alias("_category"), *([fold] if fold else []),
            c("enc").alias("_enc"), c("rows_of_key").alias("_rows"),
        )
        df = lookup(
            df.withColumn("_category", as_category(name)), own, keys,
            weight="_rows", size=sizes.get(name, 0),
        )
        df = df.withColumn(name + suffix, F.coalesce("_enc", F.lit(prior))).drop("_category", "_enc")
    return df


def entries_per_column(table: DataFrame) -> dict[str, int]:
    """Size of a materialized long table per column: one row per encoded column."""
    return {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}


def mean_of(df: DataFrame, target: str) -> float:
    return df.agg(F.avg(target)).first()[0]


def fold_safe_encode(
    df: DataFrame, columns: list[tuple[str, float]], target: str, fold: str,
    train: Column | None = None, prior: str = "global",
) -> DataFrame:
    """Target encodings of training rows from other folds, of other rows from all folds.

    `train` tells the training rows (default: all). `prior` is "global" (mean of
    all training rows) or "fold" (of the other folds). The rows are read twice:
    for the sums, and to attach the encodings.
    """
    names = [n for n, _ in columns]
    sums = fold_sums(df if train is None else df.where(train), columns, target, fold)
    mean = mean_of_sums(sums, names[0])
    table = fold_encoding_table(sums, columns, fold, mean if prior == "global" else None)
    if train is None:
        return attach_encodings(df, materialize(table), names, mean, fold)
    # Other rows look up the encodings of all folds under a fold number of their own.
    full = full_encoding_table(sums, columns, mean).withColumn(fold, F.lit(-1))
    table = materialize(table.unionByName(full).withColumnRenamed(fold, "_fold"))
    keyed = df.withColumn("_fold", F.when(train, c(fold)).otherwise(F.lit(-1)))
    return attach_encodings(keyed, table, names, mean, "_fold").drop("_fold")


def scaling_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, in one aggregate."""
    row = df.agg(
        *[F.avg(n).alias(f"m_{n}") for n in columns],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in columns],
    ).first()
    return {n: (row[f"m_{n}"], row[f"s_{n}"] or 1.0) for n in columns}


def standard_scale(
    df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "_z"
) -> DataFrame:
    """(x - mean) / sd; a constant column keeps its distance to the mean."""
    return add(
        df, {n + suffix: (c(n) - F.lit(m)) / F.lit(s) for n, (m, s) in stats.items()}
    )


def distinct_categories(df: DataFrame, name: str, limit: int = 10_000) -> list[str]:
    """Sorted classes of a column that becomes columns; refuses an unbounded one."""
    rows = df.select(as_category(name).alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{name} has more than {limit} classes: too many for columns")
    return sorted(row.v for row in rows)


def fit_one_hot(train: DataFrame, columns: list[str], missing: str = "missing") -> PipelineModel:
    """0/1 vectors `<column>_hot` for any number of classes, learnt from the training rows.

    A missing category is a class of its own if training rows have one; a category that they
    lack gives zeros only. Apply with `transform` after `fill_missing`.
    """
    indices = [f"{n}_index" for n in columns]
    return Pipeline(stages=[
        StringIndexer(inputCols=columns, outputCols=indices, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # The last index is the one kept for unknown categories.
        OneHotEncoder(inputCols=indices, outputCols=[f"{n}_hot" for n in columns], dropLast=True),
    ]).fit(fill_missing(train, columns, missing))


def fill_missing(df: DataFrame, columns: list[str], missing: str = "missing") -> DataFrame:
    return df.withColumns({n: F.coalesce(c(n).cast("string"), F.lit(missing)) for n in columns})


def one_hot(df: DataFrame, classes: dict[str, list[str]], missing: str = "missing") -> DataFrame:
    """0/1 columns per class; a category outside the classes gives zeros only."""
    block = {}
    for name, values in classes.items():
        filled = F.coalesce(c(name).cast("string"), F.lit(missing))
        for value in values:
            block[f"{name}_is_{value}"] = (filled == value).cast("int")
    return add(df, block)
