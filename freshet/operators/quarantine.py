"""Accepted and rejected rows from one scan, with the counts that came with it.

Rows are written once, partitioned by whether they break a rule; the counts per rule are observed
metrics of that very job, so no rule costs a pass of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from freshet.operators.validation import rules

c = F.col


@dataclass(frozen=True)
class Quarantine:
    """Where the rows went and what was counted on the way."""

    path: str
    schema: StructType
    rows: int
    rejected: int
    broken: dict[str, int]

    def accepted_rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).where("NOT rejected").drop("rejected", "violations")

    def rejected_rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).where("rejected").drop("rejected")

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def counts(self, spark: SparkSession) -> DataFrame:
        """(rule, rows) of the rules that any row broke."""
        found = [(rule, n) for rule, n in self.broken.items() if n]
        return spark.createDataFrame(found, "rule string, rows bigint")


def quarantine(df: DataFrame, path: str, broken: dict[str, Column] | None = None) -> Quarantine:
    """Writes all rows to `path` with `violations` and the partition `rejected`; an unknown value breaks no rule."""
    broken = rules(df.columns) if broken is None else broken
    checks = [F.when(condition, F.lit(name)) for name, condition in broken.items()]
    marked = df.withColumn("violations", F.array_compact(F.array(*checks)))
    marked = marked.withColumn("rejected", F.size("violations") > 0)
    seen = Observation("quarantine")
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(c("rejected")).alias("rejected")]
    metrics += [F.count_if(F.array_contains("violations", name)).alias(f"rule{i}") for i, name in enumerate(broken)]
    marked.observe(seen, *metrics).write.mode("overwrite").partitionBy("rejected").parquet(path)
    got = seen.get
    return Quarantine(path, marked.schema, got["rows"], got["rejected"], {name: got[f"rule{i}"] for i, name in enumerate(broken)})
