"""Exact ranks, positions and quantiles without putting a group into one task.

All of them read one ladder: the distinct values of a group in order, each with
the number of rows below it. Values are counted before they are shuffled, range
partitioned on (group, value), and numbered within a slice of a group. Only one
total per (group, slice) is added up across slices, so neither a hot group nor a
hot value ever meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize

c = F.col


# Rows that a slice should hold at most.
SLICE_ROWS = 250_000
# Tables up to so many rows are ordered as a whole for their quantiles. Of larger ones every batch
# shows each of so many values, and quantiles are looked for within this margin.
SMALL_ROWS = 200_000
STRIDE, MARGIN = 32, 0.01
# Columns read at a time: readers of wider tables go row by row.
COLUMNS = 50
# Rows of a group that one task may order; larger groups climb a ladder.
GROUP_ROWS = 100_000


def slices(df: DataFrame, rows: int | None = None) -> int:
    """Slices for so many rows: as many as the session's shuffles have, or more for more rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(rows or 0) // SLICE_ROWS))


def value_ladder(
    df: DataFrame, groups: list[str], value: str, weight: Column | None = None
) -> DataFrame:
    """(groups, value, ties, below, rows): rows with this value, below it, in the group.

    Null values and null groups take no part. `weight` counts a row as that many.
    """
    counted = known_rows(df, [*groups, value]).groupBy(*groups, value).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("ties")
    )
    return climb(counted, groups, [value])


def known_rows(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = df.where(c(name).isNotNull())
    return df


def climb(steps: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds `below` and `rows` to steps that are unique per group and order."""
    # The slice borders come from a sample, so they are fixed by writing them down.
    steps = materialize(steps)
    count = slices(steps, steps.count())
    sliced = materialize(
        steps.repartitionByRange(count, *groups, *order).withColumn("_slice", F.spark_partition_id())
    )
    part = [*groups, "_slice"]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # As many tasks as slices, so that what a task sorts does not grow with the table.
    within = sliced.repartition(count, *part).withColumn("_upto", F.sum("ties").over(upto))
    # At most one row per slice and group: small however large the group is.
    totals = sliced.groupBy(*part).agg(F.sum("ties").alias("_total"))
    across = Window.partitionBy(*groups)
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *part,
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_total").over(across).alias("rows"),
    )
    return within.join(totals, part).select(
        *groups, *order, "ties", (c("_before") + c("_upto") - c("ties")).alias("below"), "rows"
    )


def ladder_quantiles(
    ladder: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], own: str | None = None
) -> DataFrame:
    """One row per group with linearly interpolated quantiles.

    Each wanted quantile falls on one or two steps of a ladder; only those steps
    are kept, so what follows is as small as the result. `own` names a column that
    says which of the quantiles (by number) a step is for; else it is for all.
    """
    wanted = ", ".join(f"{float(p)!r}D" for p in quantiles.values())
    hit = "below <= ceil(q.spot) AND floor(q.spot) < below + ties" + (f" AND q.i = {own}" if own else "")
    spots = f"transform(array({wanted}), (p, i) -> struct(i AS i, p * (rows - 1) AS spot))"
    steps = ladder.select(
        *groups, c(value).alias("_v"), "below", "ties", F.explode(F.expr(f"filter({spots}, q -> {hit})")).alias("_q")
    )
    at = "max(CASE WHEN below <= {0}(_q.spot) AND {0}(_q.spot) < below + ties THEN _v END)"
    found = steps.groupBy(*groups, c("_q.i").alias("_i")).agg(
        F.expr(at.format("floor")).alias("_low"), F.expr(at.format("ceil")).alias("_high"),
        F.expr("max(_q.spot - floor(_q.spot))").alias("_share"),
    )
    return found.groupBy(*groups).agg(
        *[
            F.expr(f"max(CASE WHEN _i = {i} THEN _low + (_high - _low) * _share END)").alias(name)
            for i, name in enumerate(quantiles)
        ]
    )


def group_quantiles(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of `value` per group."""
    return ladder_quantiles(value_ladder(df, groups, value), groups, value, quantiles)


def column_quantiles(
    df: DataFrame, columns: list[str], quantiles: dict[str, float], groups: list[str] = ()
) -> DataFrame:
    """Exact quantiles of many columns: (groups, column, quantiles...).

    Without groups, a range of values is first found around each quantile, and only values within
    it are ordered; those below and above are counted. A column whose range turns out not to
    hold its quantile is ordered as a whole, as are small tables. `df` should be a written table.
    """
    if groups:
        return group_quantiles(
            long_form(df, columns, list(groups)), [*groups, "column"], "value", quantiles
        )
    df = df.select(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(columns)])
    ranges = near_quantiles(df, len(columns), quantiles)
    steps = ranged_ladder(df, ranges)
    reach = "below <= ceil(spot) AND floor(spot) < below + ties"
    probability = F.element_at(F.array(*[F.lit(float(p)) for p in quantiles.values()]), c("_p") + 1)
    missed = steps.where("_side <> 0").withColumn("spot", probability * (c("rows") - 1)).where(reach)
    wrong = {r["_c"] for r in missed.select("_c").distinct().collect()}
    if wrong:
        whole = {k: (None, None) for k in ranges if k[0] in wrong}
        steps = steps.where(~c("_c").isin(sorted(wrong))).unionByName(ranged_ladder(df, whole))
    found = ladder_quantiles(steps.where("_side = 0"), ["_c"], "value", quantiles, own="_p")
    names = F.array(*[F.lit(n) for n in columns])
    return found.select(F.element_at(names, c("_c") + 1).alias("column"), *quantiles)


def by_columns(df: DataFrame, numbers: list[int], own, schema: str) -> DataFrame:
    """What `own`(number, values) gives for the values of columns x<number>, batch by batch, nulls aside."""
    out = None
    for at in range(0, len(numbers), COLUMNS):  # few columns at a time, so that they are read as columns
        part = numbers[at:at + COLUMNS]

        def work(batches, part=part):
            for batch in batches:
                for number, column in zip(part, batch.columns):
                    yield from own(number, column.drop_null().to_numpy(zero_copy_only=False))

        found = df.select(*[f"x{i}" for i in part]).mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out


def near_quantiles(df: DataFrame, columns: int, quantiles: dict[str, float]) -> dict[tuple[int, int], tuple]:
    """For each column x<i> and quantile, by number, values that should lie on either side of it.

    Every batch is sorted and hands on every STRIDE-th value, so that ranks are off by less than a
    stride per batch. An end is None where the range is open; all are for tables of up to SMALL_ROWS rows.
    """
    numbers = list(range(columns))
    open_ends = {(i, p): (None, None) for i in numbers for p in range(len(quantiles))}
    if df.count() <= SMALL_ROWS:
        return open_ends

    def some(number: int, values: np.ndarray):
        kept = np.sort(values)[STRIDE // 2::STRIDE]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), number, "int32")), pa.array(kept)], ["_c", "value"])

    ends = [p for q in quantiles.values() for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    points = by_columns(df, numbers, some, "_c int, value double")
    for row in points.groupBy("_c").agg(F.percentile_approx("value", ends, 1000).alias("ends")).collect():
        for p, q in enumerate(quantiles.values()):
            low, high = row["ends"][2 * p:2 * p + 2]
            open_ends[row["_c"], p] = (low if q > MARGIN else None, high if q < 1 - MARGIN and high == high else None)
    return open_ends


def ranged_ladder(df: DataFrame, ranges: dict[tuple[int, int], tuple]) -> DataFrame:
    """(_c, _p, _side, value, ties, below, rows): the ladders of the values within ranges of columns x<i>.

    All values below a range are one step (side -1), those above it another (side 1).
    Not-a-number is above all numbers. Batches count their values before the shuffle.
    """
    wanted = {}
    for (i, p), ends in ranges.items():
        wanted.setdefault(i, []).append((p, *ends))

    def count(number: int, values: np.ndarray):
        nan = np.isnan(values)
        for p, low, high in wanted[number]:
            under = np.zeros(len(values), bool) if low is None else values < low if low == low else ~nan
            over = np.zeros(len(values), bool) if high is None else (values > high) | nan
            inside, ties = np.unique(values[~under & ~over], return_counts=True)
            ends = [(side, n) for side, n in ((-1, under.sum()), (1, over.sum())) if n]
            k = len(inside) + len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, number, "int32")), pa.array(np.full(k, p, "int32")),
                pa.array(np.array([0] * len(inside) + [side for side, _ in ends], "int32")),
                pa.array(np.append(inside, [0.0] * len(ends))), pa.array(np.append(ties, [n for _, n in ends]).astype("int64")),
            ], ["_c", "_p", "_side", "value", "ties"])

    schema = "_c int, _p int, _side int, value double, ties bigint"
    counted = by_columns(df, sorted(wanted), count, schema).groupBy("_c", "_p", "_side", "value").agg(F.sum("ties").alias("ties"))
    return climb(counted, ["_c", "_p"], ["_side", "value"])


def long_form(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Columns to rows: (ids, column, value double)."""
    return df.select(*ids, *[c(n).cast("double").alias(n) for n in columns]).unpivot(
        ids, columns, "column", "value"
    )


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians as a dictionary; one entry per column."""
    rows = column_quantiles(df, columns, {"median": 0.5}).collect()
    return {row["column"]: row["median"] for row in rows}


def percent_ranks(
    df: DataFrame, group: str, columns: list[str], ids: list[str], suffix: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Rank in (0, 1] within the group, ties averaged, nulls kept null.

    Groups of at most `group_rows` rows are shuffled once for all columns and ordered in place;
    larger ones share one ladder, and the share of a value is looked up per row.
    """
    df = materialize(df.select(*ids, group, *[c(n).cast("double").alias(n) for n in columns]))
    sizes = df.where(c(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    # At most one per `group_rows` rows.
    large = materialize(sizes.where(c("_n") > group_rows).select(group))
    unknown = [F.lit(None).cast("double").alias(n) for n in columns]
    parts = [
        ranks_in_place(df.where(c(group).isNotNull()).join(F.broadcast(large), group, "left_anti"), group, columns, ids),
        df.where(c(group).isNull()).select(*ids, *unknown),
    ]
    if not large.isEmpty():
        parts.append(ranks_by_ladder(df.join(F.broadcast(large), group, "left_semi"), group, columns, ids))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*ids).agg(*[F.max(n).alias(n + suffix) for n in columns])


def ranks_in_place(df: DataFrame, group: str, columns: list[str], ids: list[str]) -> DataFrame:
    """(ids, columns): ranks from windows over whole groups."""
    own = Window.partitionBy(group)
    for n in columns:
        order = own.orderBy(n)  # nulls come first
        upto = F.count(n).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = F.count(n).over(own)
        below = F.rank().over(order) - 1 - (F.count(F.lit(1)).over(own) - rows)
        df = df.select(
            *[x for x in df.columns if x != n], F.when(c(n).isNotNull(), (below + (upto - below + 1) / 2) / rows).alias(n)
        )
    return df.select(*ids, *columns)


def ranks_by_ladder(df: DataFrame, group: str, columns: list[str], ids: list[str]) -> DataFrame:
    """(ids, columns): ranks from one ladder of all columns."""
    rows = long_form(df, columns, [*ids, group])
    ladder = value_ladder(rows, [group, "column"], "value")
    ladder = materialize(
        ladder.select(
            group, "column", "value", "ties",
            ((c("below") + (c("ties") + 1) / 2) / c("rows")).alias("_rank"),
        )
    )
    ranked = lookup(rows, ladder, [group, "column", "value"], weight="ties")
    return ranked.groupBy(*ids).agg(
        *[F.max(F.when(c("column") == n, c("_rank"))).alias(n) for n in columns]
    )


def ordinal_positions(df: DataFrame, groups: list[str], value: str, tiebreak: str) -> DataFrame:
    """(groups, value, tiebreak, position, rows): 0-based place by value, then tiebreak.

    The tiebreak is unique within a group, so every step of the ladder is one row.
    """
    steps = known_rows(df, [*groups, value]).select(
        *groups, value, tiebreak, F.lit(1).cast("bigint").alias("ties")
    )
    placed = climb(steps, groups, [value, tiebreak])
    return placed.select(*groups, value, tiebreak, c("below").alias("position"), "rows")
