"""Column profiles from mergeable sketches: one aggregate over the columns side by side.

Nothing is unpivoted or shuffled but one row of sketches per task. Sketches of parts of a table
(days, files) can be kept and merged; exact profiles are in `stats.column_profile`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
# 2^12 registers: a relative standard error of 1.6 %.
PRECISION = 12
# Three standard errors and a little.
BOUND = 0.06


def sketched(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(column, dtype, rows, missing, sketch) per column of `df`; no rows give empty sketches."""
    each = [
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(c(f"`{n}`").isNull(), 1)).alias("missing"),
            F.hll_sketch_agg(c(f"`{n}`").cast("string"), F.lit(precision)).alias("sketch"),
        ).alias(f"s{i}")
        for i, n in enumerate(df.columns)
    ]
    named = F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(kind).alias("dtype"), c(f"s{i}").alias("s"))
        for i, (n, kind) in enumerate(df.dtypes)
    ])
    return df.agg(*each).select(F.explode(named).alias("r")).select("r.column", "r.dtype", "r.s.*")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(column, dtype, rows, missing, distinct_estimate) of all parts together."""
    return sketches.groupBy("column", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )
