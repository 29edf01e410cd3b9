"""Target encodings kept as sums, so that a new batch adds to them without the old rows.

The state has one row per (column, category, fold): the sum of the target and the number of rows.
Merging a batch adds its own sums; every encoding (smoothed, fold-safe, with any prior) follows
from the state alone, so it is the same as if all rows had come at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.durable import materialize, scratch
from freshet.operators.encoding import fold_encoding_table, fold_sums, full_encoding_table, mean_of_sums
from freshet.sources.files import path_exists

c = F.col
STATE = "column string, category string, fold int, _s double, _n bigint"


def merged(states: list[DataFrame]) -> DataFrame:
    """The state over all rows that any of the states has seen."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy("column", "category", "fold").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))


def batch_state(rows: DataFrame, columns: list[tuple[str, float]], target: str, fold: str = "fold") -> DataFrame:
    sums = fold_sums(rows, columns, target, fold)
    return sums.select("column", "category", c(fold).cast("int").alias("fold"), c("_s").cast("double").alias("_s"), "_n")


class EncodingState:
    """The state in a folder: numbered versions of it, of which the last complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        number = 0
        while path_exists(self.spark, f"{self.path}/v{number}/_SUCCESS"):
            number += 1
        return list(range(number))

    def read(self) -> DataFrame:
        """The newest state; without one, an empty one."""
        there = self.versions()
        if not there:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v{there[-1]}")

    def add(self, rows: DataFrame, columns: list[tuple[str, float]], target: str, fold: str = "fold") -> DataFrame:
        """Merges a batch into a new version, which a failed writer leaves incomplete and unused."""
        number = len(self.versions())
        new = merged([self.read(), batch_state(rows, columns, target, fold)])
        new.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return self.read()


def encodings(state: DataFrame, columns: list[tuple[str, float]], leave_out: bool = False) -> DataFrame:
    """(column, category, [fold,] enc, rows_of_key) from the state: over all folds, or without each."""
    state = materialize(state)
    mean = mean_of_sums(state, columns[0][0])
    if leave_out:
        return fold_encoding_table(state, columns, "fold", mean)
    return full_encoding_table(state, columns, mean)


def fresh_state(spark: SparkSession) -> EncodingState:
    return EncodingState(spark, scratch(spark, "encodings"))
