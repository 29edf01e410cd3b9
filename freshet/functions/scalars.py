"""Scalar building blocks with the null rules the feature set needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.constants import LEVELS, LEVEL_THRESHOLDS


# Above this, a double has no fraction left, and its floor would leave the range of longs.
EXACT = float(2**52)


def clip_low(x: Column, low: float = 0.0) -> Column:
    """max(x, low); null stays null (`greatest` alone would return `low`)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip_unit(x: Column) -> Column:
    """x limited to [0, 1]; null and not-a-number stay."""
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def round_half_up(x: Column, digits: int) -> Column:
    """Round on the binary value, so that equal doubles round equally everywhere.

    Not-a-number, infinities and values too large to hold such digits stay as they are.
    """
    scale = float(10**digits)
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    # Not-a-number counts as larger than any number here.
    return F.when(F.abs(x) < F.lit(EXACT / scale), rounded).otherwise(x)


def logit(p: Column, eps: float = 1e-6) -> Column:
    """log-odds of a probability kept `eps` away from 0 and 1."""
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    """Inverse of `logit`; each branch only takes exp of a non-positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def risk_level(score: Column) -> Column:
    """Low / Medium / High / Critical of the unrounded score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for level in LEVELS[:-1]:
        out = out.when(score < LEVEL_THRESHOLDS[level], F.lit(level))
    return out.otherwise(F.lit(LEVELS[-1]))


def relative_reduction(before: Column, after: Column) -> Column:
    """Reduction in percent of `before`; 0 where `before` is not positive."""
    return F.when(before > 0, (before - after) / before * 100.0).otherwise(F.lit(0.0))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# The same rules as SQL text, for expressions over array elements.


def rounded_text(x: str, digits: int) -> str:
    scale = 10**digits
    rounded = f"floor(({x}) * {scale}D + 0.5D) / {scale}D"
    return f"CASE WHEN abs({x}) < {EXACT / scale!r}D THEN {rounded} ELSE {x} END"


def level_text(score: str) -> str:
    cases = " ".join(f"WHEN {score} < {LEVEL_THRESHOLDS[n]}D THEN '{n}'" for n in LEVELS[:-1])
    return f"CASE WHEN {score} IS NULL THEN NULL {cases} ELSE '{LEVELS[-1]}' END"


def reduction_text(before: str, after: str) -> str:
    return f"CASE WHEN {before} > 0 THEN ({before} - {after}) / {before} * 100D ELSE 0D END"
