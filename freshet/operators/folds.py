"""Folds, train/test union and pseudo-labelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold in [0, folds) from the row's key alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(c(key), F.lit(seed)), F.lit(folds)).cast("int")


def arithmetic_fold(number: Column, folds: int, seed: int = 42) -> Column:
    """Fold of a numeric key, computable in any SQL engine."""
    return ((number * 7919 + seed) % folds).cast("int")


def seeded_fold(key: Column, folds: int, seed: int | Column) -> Column:
    """Fold from the first three digits of a seeded MD5: another partition for every seed, in any SQL engine."""
    digest = F.md5(F.concat(F.lit(seed).cast("string"), F.lit(":"), key.cast("string")))
    digits = [F.instr(F.lit("123456789abcdef"), F.substring(digest, i, 1)) for i in (1, 2, 3)]
    return ((digits[0] * 256 + digits[1] * 16 + digits[2]) % folds).cast("int")


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", fold_of(key, folds, seed))


def with_repeated_folds(
    df: DataFrame, fold: Callable[[Column], Column], repeats: int
) -> DataFrame:
    """Every row once per repeat; `fold` gives the fold from the repeat number."""
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return repeated.withColumn("fold", fold(c("repeat")).cast("int"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables in one, columns matched by name, with a `split` column."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )


def add_pseudo_rows(
    train: DataFrame, test: DataFrame, labels: DataFrame, key: str, target: str, label: str
) -> DataFrame:
    """Training rows plus test rows that carry a predicted target.

    Pseudo rows have no fold, so they train every model and validate none.
    """
    pseudo = test.drop(target).join(
        labels.select(key, c(label).alias(target)), key
    ).withColumn("is_pseudo", F.lit(True))
    return train.withColumn("is_pseudo", F.lit(False)).unionByName(pseudo, allowMissingColumns=True)


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    """Rows a model of this fold may learn from."""
    return df.where(c("fold").isNull() | (c("fold") != fold))


def validation_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(c("fold") == fold)
