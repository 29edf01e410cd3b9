"""Scenario rows: defaults, scoring, sweeps, interventions, comparison, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.constants import (
    DISTRICT_DEFAULTS, DISTRICTS, FEATURE_LABELS, GENERIC_DEFAULTS, GOOD_WHEN_FALLING,
    GOOD_WHEN_RISING, NUMERIC_INPUTS, SCENARIO_TEXT_DEFAULTS, SWEEP_FEATURES, SWEEP_STEPS,
)
from freshet.functions.scalars import (
    relative_reduction, risk_level, round_half_up, rounded_text,
)
from freshet.functions.scorers import Scorer, heuristic_score, overridden, score

c = F.col
KEY_FACTORS = [
    "rainfall_7d_mm", "drainage_index", "elevation_m", "historical_flood_count",
    "infrastructure_score",
]


def default_of(name: str, district: Column) -> Column:
    """Typical value of a measure in the district; other districts get the generic one."""
    at = NUMERIC_INPUTS.index(name)
    table = F.create_map(*[F.lit(x) for d, row in DISTRICT_DEFAULTS.items() for x in (d, float(row[at]))])
    return F.coalesce(table[district], F.lit(float(GENERIC_DEFAULTS[at])))


def district_defaults(districts: DataFrame) -> DataFrame:
    """Default measures of every district in the input."""
    return districts.select(
        "district", *[default_of(n, c("district")).alias(n) for n in NUMERIC_INPUTS]
    )


def scenario_rows(requests: DataFrame, keep: list[str]) -> DataFrame:
    """Complete rows: an override wins over the district's default, which wins over the generic one."""
    present = set(requests.columns)

    def numeric(name: str) -> Column:
        default = default_of(name, c("district"))
        return (F.coalesce(c(name).cast("double"), default) if name in present else default).alias(name)

    def text(name: str, default: str) -> Column:
        return (F.coalesce(c(name), F.lit(default)) if name in present else F.lit(default)).alias(name)

    return requests.select(
        *keep, "district", *[text(n, d) for n, d in SCENARIO_TEXT_DEFAULTS.items()],
        *[numeric(n) for n in NUMERIC_INPUTS], F.lit(0).alias("is_synthetic"),
    )


def simulate(df: DataFrame, scorer: Scorer = heuristic_score) -> DataFrame:
    """Adds the score and its level (of the unrounded score)."""
    scored = df.withColumn("flood_risk_score", score(scorer))
    return scored.withColumn("risk_level", risk_level(c("flood_risk_score")))


def sweep_grid() -> Column:
    """Sweep features as an array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"), F.lit(label).alias("label"),
                F.lit(low).alias("low"), F.lit(high).alias("high"),
            )
            for name, label, _, low, high, _ in SWEEP_FEATURES
        ]
    )


def sweep_points(df: DataFrame, keep: list[str], scorer: Scorer = heuristic_score) -> DataFrame:
    """Scores along evenly spaced values of each sweep feature: one row per point.

    A row fans out to a fixed number of points, which are scored in place.
    """
    last = SWEEP_STEPS - 1
    rows = df.withColumn("_f", F.explode(sweep_grid())).select(
        *df.columns, "_f.*", F.explode(F.expr(f"sequence(0, {last})")).alias("point")
    )
    rows = rows.withColumn("_v", F.expr(f"low + (high - low) / {last}D * point"))
    return rows.select(
        *keep, "feature", "label", "point", round_half_up(c("_v"), 2).alias("value"),
        round_half_up(score(scorer, overridden("feature", "_v")), 4).alias("score"),
    )


def sweep(df: DataFrame, keep: list[str], scorer: Scorer = heuristic_score) -> DataFrame:
    """The same sweep with the values and scores of a feature as arrays of one row.

    The points of a feature never leave their row, so nothing is shuffled.
    """
    last = SWEEP_STEPS - 1
    rows = df.withColumn("_f", F.explode(sweep_grid())).withColumn(
        "_grid",
        F.expr(f"transform(sequence(0, {last}), i -> _f.low + (_f.high - _f.low) / {last}D * i)"),
    )
    result = rounded_text(scorer(overridden("_f.feature", "v")), 4)
    return rows.select(
        *keep, c("_f.feature").alias("feature"), c("_f.label").alias("label"),
        F.expr(f"transform(_grid, v -> {rounded_text('v', 2)})").alias("values"),
        F.expr(f"transform(_grid, v -> {result})").alias("scores"),
    )


def interventions(df: DataFrame, keep: list[str], scorer: Scorer = heuristic_score) -> DataFrame:
    """Effect of raising each improvable feature to its good value, with its rank per row."""
    actions = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("feature"), F.lit(label).alias("label"),
            F.lit(category).alias("category"), F.lit(float(better)).alias("improved"),
            c(name).cast("double").alias("current"),
            score(scorer, overridden(f"'{name}'", f"{better}D")).alias("after"),
        )
        for i, (name, label, category, _, _, better) in enumerate(SWEEP_FEATURES)
        if better is not None
    ]
    based = df.withColumn("_base", score(scorer))
    # Highest reduction first, then listing order: sorting a short array per row.
    scored = based.withColumn("_all", F.array(*actions)).withColumn(
        "_sorted",
        F.array_sort(
            F.transform(
                "_all",
                lambda a: F.struct(
                    (-round_half_up(relative_reduction(c("_base"), a["after"]), 2)).alias("minus_pct"),
                    a["ordinal"].alias("ordinal"), a.alias("action"),
                ),
            )
        ),
    )
    # The outer form: the plain one would first test the array's size and so build it twice.
    rows = scored.select(*keep, "_base", F.posexplode_outer("_sorted").alias("_pos", "_x"))
    a = "_x.action."
    return rows.select(
        *keep, (c("_pos") + 1).alias("position"), c(a + "feature").alias("feature"),
        c(a + "label").alias("feature_label"), c(a + "category").alias("category"),
        round_half_up(c(a + "current"), 4).alias("current_value"),
        round_half_up(c(a + "improved"), 4).alias("improved_value"),
        round_half_up(c("_base"), 4).alias("baseline_score"),
        round_half_up(c(a + "after"), 4).alias("improved_score"),
        (-c("_x.minus_pct")).alias("risk_reduction_pct"),
    )


def compare(
    a: DataFrame, b: DataFrame, key: str, scorer: Scorer = heuristic_score
) -> DataFrame:
    """Both scenarios of a key side by side: scores, levels, delta, verdict and changes.

    `changes` lists features that moved by more than 0.001, largest move first.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        scored = simulate(df, scorer)
        return scored.select(
            key, *[c(n).cast("double").alias(f"{mark}_{n}") for n in NUMERIC_INPUTS],
            c("district").alias(f"district_{mark}"),
            c("flood_risk_score").alias(f"score_{mark}"), c("risk_level").alias(f"level_{mark}"),
        )

    both = side(a, "a").join(side(b, "b"), key)
    moves = []
    for i, name in enumerate(NUMERIC_INPUTS):
        delta = c(f"b_{name}") - c(f"a_{name}")
        by_score = F.when(c("score_b") > c("score_a"), "negative").otherwise("positive")
        rising = F.when(delta > 0, F.lit("positive")).otherwise(by_score)
        falling = F.when(delta < 0, F.lit("positive")).otherwise(by_score)
        direction = by_score
        if name in GOOD_WHEN_RISING:
            direction = rising
        elif name in GOOD_WHEN_FALLING:
            direction = falling
        moves.append(
            F.when(
                F.abs(delta) > 0.001,
                F.struct(
                    (-F.abs(round_half_up(delta, 4))).alias("minus_size"), F.lit(i).alias("ordinal"),
                    F.lit(name).alias("feature"), F.lit(FEATURE_LABELS.get(name, name)).alias("label"),
                    round_half_up(c(f"a_{name}"), 4).alias("value_a"),
                    round_half_up(c(f"b_{name}"), 4).alias("value_b"),
                    round_half_up(delta, 4).alias("delta"), direction.alias("impact_direction"),
                ),
            )
        )
    delta = round_half_up(c("score_b") - c("score_a"), 4)
    return both.select(
        key, "district_a", "district_b",
        round_half_up(c("score_a"), 4).alias("score_a"), "level_a",
        round_half_up(c("score_b"), 4).alias("score_b"), "level_b",
        delta.alias("score_delta"),
        F.when(delta < -0.005, "improved").when(delta > 0.005, "worsened")
        .otherwise("unchanged").alias("risk_improvement"),
        F.array_sort(F.array_compact(F.array(*moves))).alias("changes"),
    )


def feature_changes(compared: DataFrame, key: str) -> DataFrame:
    """The changes of a comparison as rows."""
    rows = compared.select(key, F.posexplode_outer("changes").alias("_pos", "_x"))
    rows = rows.where(c("_pos").isNotNull())
    fields = ["feature", "label", "value_a", "value_b", "delta", "impact_direction"]
    return rows.select(key, (c("_pos") + 1).alias("position"), *[c(f"_x.{n}").alias(n) for n in fields])


def listing_order(district: Column) -> Column:
    """Position in the district list; other districts come last."""
    place = F.array_position(F.array(*[F.lit(d) for d in DISTRICTS]), district)
    return F.when(place > 0, place).otherwise(F.lit(len(DISTRICTS) + 1))


def district_overview(scored: DataFrame) -> DataFrame:
    """Districts by average score, highest first, with level and key factors."""
    per_district = scored.where(c("district").isNotNull()).groupBy("district").agg(
        F.avg("flood_risk_score").alias("_score"), F.count(F.lit(1)).alias("rows"),
        *[F.avg(n).alias(n) for n in KEY_FACTORS],
    )
    shown = round_half_up(c("_score"), 4)
    order = Window.partitionBy(F.lit(1)).orderBy(  # one row per district
        shown.desc_nulls_last(), listing_order(c("district")), "district"
    )
    return per_district.select(
        "district", "rows", shown.alias("flood_risk_score"), risk_level(c("_score")).alias("risk_level"),
        F.row_number().over(order).alias("position"), *KEY_FACTORS,
    )


def overview_totals(overview: DataFrame) -> DataFrame:
    """Highest, lowest and average district."""
    return overview.agg(
        F.min_by("district", "position").alias("highest_risk"),
        F.max_by("district", "position").alias("lowest_risk"),
        round_half_up(F.avg("flood_risk_score"), 4).alias("avg_risk_score"),
    )


def level_counts(overview: DataFrame) -> DataFrame:
    return overview.groupBy("risk_level").agg(F.count(F.lit(1)).alias("districts"))


def score_by_route(
    df: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], scorer: Scorer = heuristic_score
) -> DataFrame:
    """Rows of a version with a fitted model go to it, all others to the heuristic.

    A route takes rows and returns them with `flood_risk_score`.
    """
    known = c("model_version").isin(*routes) if routes else F.lit(False)
    rest = F.coalesce(~known, F.lit(True))
    out = simulate(df.where(rest), scorer).withColumn("route", F.lit("heuristic"))
    for version, route in routes.items():
        fitted = route(df.where(c("model_version") == version))
        fitted = fitted.withColumn("risk_level", risk_level(c("flood_risk_score")))
        out = out.unionByName(
            fitted.withColumn("route", F.lit("model")).select(*out.columns)
        )
    return out
