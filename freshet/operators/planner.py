"""Greedy mitigation plans, one per input row.

A plan tries at most 6 features x 3 values in each of at most 5 rounds. All of
that stays inside the row, as arrays, so planning is a projection: no shuffle, no
join and no driver loop over plans, however many there are. Trace and
alternatives come out as nested arrays and are exploded on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.constants import ACTIONS, LEVEL_THRESHOLDS, PROFILE_FRACTIONS, STALL_TEXT
from freshet.functions.scalars import level_text, reduction_text, rounded_text
from freshet.functions.scorers import Scorer, heuristic_score, plain

c = F.col
EPSILON = "1e-9D"
ROUNDS = 5
FIELDS = ["feature", "label", "category", "target", "rising", "cost_level", "cost", "cheap", "rationale"]
ACTION_NAMES = [action[0] for action in ACTIONS]


def violations() -> Column:
    """What is wrong with a request: an array of text, empty where `plan` can work on it."""
    unknown = lambda name, known: F.when(
        ~F.coalesce(c(name).isin(*known), F.lit(False)),
        F.concat(F.lit(f"unsupported {name} "), F.coalesce(c(name), F.lit("null"))),
    )
    return F.array_compact(
        F.array(unknown("target_risk_level", LEVEL_THRESHOLDS), unknown("budget_profile", PROFILE_FRACTIONS))
    )


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be planned, and the rejected ones with their `violations`."""
    marked = df.withColumn("violations", violations())
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"{float(value)!r}D"
    if isinstance(value, list):
        return f"array({', '.join(literal(v) for v in value)})"
    return "'" + value.replace("'", "\\'") + "'"


def by_value(text: str, table: dict) -> str:
    """Lookup in a small fixed table; other values give null."""
    return f"CASE {text} " + " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in table.items()) + " END"


def fact(feature: str, attribute: str) -> str:
    """An attribute of the action that works on the feature."""
    at = FIELDS.index(attribute)
    return by_value(feature, {action[0]: action[at] for action in ACTIONS})


def struct(**fields: str) -> str:
    return "struct(" + ", ".join(f"{text} AS {name}" for name, text in fields.items()) + ")"


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def options_of(name: str, target: float, rising: bool) -> str:
    """Changes of one feature on the way to its target, nearest first, none beyond it.

    None where the feature is at its target, used up or not allowed.
    """
    now, goal = f"s.now.{name}", literal(target)
    there = f"({now} {'>=' if rising else '<='} {goal} OR abs({now} - {goal}) <= {EPSILON})"
    value = rounded_text(f"{now} + ({goal} - {now}) * f", 6)
    kept = (
        f"NOT {there} AND array_contains(s.open, '{name}')"
        f" AND v >= least({now}, {goal}) AND v <= greatest({now}, {goal})"
    )
    values = f"filter(array_distinct(transform(_fractions, f -> {value})), v -> {kept})"
    return f"transform(sort_array({values}, {literal(rising)}), v -> " + struct(
        feature=f"'{name}'", from_value=now, to_value="v"
    ) + ")"


def utility(reduction: str, feature: str) -> str:
    """Reduction weighed by cost the way the budget profile asks for."""
    cost, cheap = fact(feature, "cost"), fact(feature, "cheap")
    return (
        f"CASE budget_profile WHEN 'aggressive' THEN {reduction}"
        f" WHEN 'low_cost' THEN {reduction} * CASE WHEN {cheap} THEN 1.35D ELSE 0.75D END / {cost}"
        f" ELSE {reduction} / sqrt({cost}) END"
    )


STEP = "struct<feature:string,from_value:double,to_value:double,before:double,score:double>"
TRIAL = "struct<step:int,feature:string,to_value:double,score:double,accepted:boolean>"
ALTERNATIVE = f"struct<name:string,score:double,steps:array<{STEP}>>"


def plan(df: DataFrame, keep: list[str], scorer: Scorer = heuristic_score) -> DataFrame:
    """Plans for scenario rows with model_version, target_risk_level, budget_profile,
    max_steps and allowed_features (null: all; unknown names are ignored).
    """
    every = literal(ACTION_NAMES)
    state = df.select(
        "*",
        F.expr(by_value("target_risk_level", LEVEL_THRESHOLDS)).alias("_threshold"),
        # An unknown profile offers no change; `violations` names it.
        F.expr(f"coalesce({by_value('budget_profile', PROFILE_FRACTIONS)}, CAST(array() AS array<double>))").alias("_fractions"),
        F.expr(f"least(greatest(max_steps, 1), {ROUNDS})").alias("_limit"),
        F.expr(f"if(allowed_features IS NULL, {every}, array_intersect({every}, allowed_features))").alias("_open"),
        F.expr(scorer(plain)).alias("_baseline"),
    )
    start = struct(
        now=struct(**{n: f"CAST({n} AS DOUBLE)" for n in ACTION_NAMES}), score="_baseline", open="_open",
        running="_baseline >= _threshold", stalled="false",
        steps=f"CAST(array() AS array<{STEP}>)", trials=f"CAST(array() AS array<{TRIAL}>)",
        alternatives=f"CAST(array() AS array<{ALTERNATIVE}>)",
    )
    search = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {plan_round(scorer)})"
    # Generated rather than projected: a filter on the result is then not moved
    # below the search, where it would repeat it.
    searched = state.select("*", F.explode(F.array(F.expr(search))).alias("_end"))
    done = searched.select(
        *keep, "district", "model_version", "target_risk_level", "_baseline", "_threshold",
        c("_end.score").alias("_score"), c("_end.stalled").alias("_stalled"),
        c("_end.steps").alias("_steps"), c("_end.trials").alias("_trials"),
        c("_end.alternatives").alias("_alternatives"),
        F.expr("_end.score < _threshold").alias("target_reached"),
    )
    stalled = struct(name=literal(STALL_TEXT), score="_score", steps="_steps")
    best = let(
        "best", best_alternatives(),
        f"if(NOT target_reached AND _stalled, slice(concat(array({stalled}), best), 1, 3), best)",
    )
    return done.select(
        *keep, "district", "model_version",
        F.expr(rounded_text("_baseline", 4)).alias("baseline_score"),
        F.expr(level_text("_baseline")).alias("baseline_risk_level"), "target_risk_level",
        c("_threshold").alias("target_score_threshold"), "target_reached",
        F.expr(rounded_text("_score", 4)).alias("optimized_score"),
        F.expr(level_text("_score")).alias("optimized_risk_level"),
        F.expr(rounded_text(reduction_text("_baseline", "_score"), 2)).alias("risk_reduction_pct"),
        F.expr(f"transform(_steps, x -> {shown_step('x')})").alias("recommended_plan"),
        F.expr(f"transform(_trials, x -> {shown_trial('x')})").alias("search_trace"),
        F.expr(f"transform({best}, a -> {shown_alternative('a')})").alias("alternatives"),
    )


def plan_round(scorer: Scorer) -> str:
    """One greedy step from state `s` in round `r`: try every open feature and
    accept the most useful improvement.
    """

    def candidate(name: str) -> str:
        if name not in ACTION_NAMES:
            return plain(name)
        return f"CASE WHEN o.feature = '{name}' THEN o.to_value ELSE s.now.{name} END"

    options = ", ".join(options_of(a[0], a[3], a[4]) for a in ACTIONS)
    trial = struct(
        feature="o.feature", from_value="o.from_value", to_value="o.to_value",
        before="s.score", score=scorer(candidate),
    )
    improving = f"filter(tried, x -> x.before - x.score > {EPSILON})"
    # Most useful first; then larger reduction, lower cost, feature and value.
    ranked = struct(
        minus_utility=f"-({utility('(x.before - x.score)', 'x.feature')})",
        minus_reduction="x.score - x.before", cost=fact("x.feature", "cost"),
        feature="x.feature", to_value="x.to_value", pick="x",
    )
    accepted = "coalesce(x.feature = pick.feature AND x.to_value = pick.to_value, false)"
    trials = struct(
        step="r", feature="x.feature", to_value="x.to_value", score="x.score", accepted=accepted
    )
    alternative = struct(
        name=f"concat('Alternative via ', {fact('x.feature', 'label')})", score="x.score",
        steps="concat(s.steps, array(x))",
    )
    moved = struct(
        now=struct(**{
            n: f"CASE WHEN pick.feature = '{n}' THEN pick.to_value ELSE s.now.{n} END" for n in ACTION_NAMES
        }),
        score="coalesce(pick.score, s.score)",
        open="coalesce(array_remove(s.open, pick.feature), s.open)",
        running="pick IS NOT NULL AND coalesce(pick.score, 0D) >= _threshold",
        stalled="pick IS NULL",
        steps="if(pick IS NULL, s.steps, concat(s.steps, array(pick)))",
        trials=f"concat(s.trials, transform(tried, x -> {trials}))",
        alternatives=f"concat(s.alternatives, transform(filter(improving, x -> NOT {accepted}), x -> {alternative}))",
    )
    body = let("pick", f"array_min(transform(improving, x -> {ranked})).pick", moved)
    body = let("improving", improving, body)
    body = let("tried", f"transform(flatten(array({options})), o -> {trial})", body)
    return f"if(s.running AND r <= _limit, {body}, s)"


def best_alternatives() -> str:
    """The first best alternative per feature sequence, then the top three.

    Scores are compared as shown, with 4 digits.
    """
    numbered = struct(
        signature="array_join(transform(a.steps, s -> s.feature), '>')",
        shown=rounded_text("a.score", 4), place="i", alternative="a",
    )
    # Sorted by signature, score and place: the first of each signature wins.
    ordered = f"array_sort(transform(_alternatives, (a, i) -> {numbered}))"
    firsts = "filter(ordered, (x, i) -> coalesce(x.signature != get(ordered, i - 1).signature, true))"
    ranked = struct(
        missed="x.alternative.score >= _threshold", shown="x.shown",
        length="size(x.alternative.steps)", name="x.alternative.name", place="x.place",
        alternative="x.alternative",
    )
    best = f"transform(slice(array_sort(transform({firsts}, x -> {ranked})), 1, 3), x -> x.alternative)"
    return let("ordered", ordered, best)


def shown_step(x: str) -> str:
    """A change as shown to a reader."""
    feature, before, after = f"{x}.feature", f"{x}.before", f"{x}.score"
    return struct(
        feature=feature, feature_label=fact(feature, "label"), category=fact(feature, "category"),
        from_value=rounded_text(f"{x}.from_value", 4), to_value=rounded_text(f"{x}.to_value", 4),
        score_before=rounded_text(before, 4), score_after=rounded_text(after, 4),
        absolute_reduction=rounded_text(f"{before} - {after}", 4),
        relative_reduction_pct=rounded_text(reduction_text(before, after), 2),
        cost_level=fact(feature, "cost_level"), rationale=fact(feature, "rationale"),
    )


def shown_alternative(a: str) -> str:
    score = f"{a}.score"
    return struct(
        name=f"{a}.name", optimized_score=rounded_text(score, 4),
        optimized_risk_level=level_text(score), target_reached=f"{score} < _threshold",
        risk_reduction_pct=rounded_text(reduction_text("_baseline", score), 2),
        steps=f"transform({a}.steps, s -> {shown_step('s')})",
    )


def shown_trial(x: str) -> str:
    return struct(
        step=f"{x}.step", tried_feature=f"{x}.feature", tried_value=rounded_text(f"{x}.to_value", 4),
        resulting_score=rounded_text(f"{x}.score", 4),
        resulting_risk_level=level_text(f"{x}.score"), accepted=f"{x}.accepted",
    )


def exploded(plans: DataFrame, nested: str, keep: list[str]) -> DataFrame:
    """Plan steps, trace or alternatives as rows, in order."""
    rows = plans.select(*keep, F.posexplode_outer(nested).alias("_pos", "_x"))
    rows = rows.where(c("_pos").isNotNull())
    return rows.select(*keep, (c("_pos") + 1).alias("position"), "_x.*")
