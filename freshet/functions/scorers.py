"""Risk scorers as SQL expressions.

A scorer is given how to read a feature (name -> SQL text) and returns SQL text.
The same scorer thus serves plain columns, overridden columns and candidates
inside an array, and always runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.constants import NUMERIC_INPUTS, VERSION_FACTORS

Read = Callable[[str], str]
Scorer = Callable[[Read], str]


def plain(name: str) -> str:
    return f"`{name}`"


def overridden(which: str, value: str) -> Read:
    """Reads the measure named by `which` as `value`, all others as they are."""

    def read(name: str) -> str:
        if name not in NUMERIC_INPUTS:
            return plain(name)
        return f"CASE WHEN {which} = '{name}' THEN {value} ELSE `{name}` END"

    return read


def unit(text: str) -> str:
    return f"least(greatest({text}, 0D), 1D)"


def heuristic_score(read: Read, versioned: bool = True) -> str:
    """Eight capped terms around 0.40, scaled by the model version, within [0, 1].

    A missing feature counts as typical.
    """

    def of(name: str, default: float) -> str:
        return f"coalesce({read(name)}, {default}D)"

    factor = "1D"
    if versioned:
        cases = " ".join(f"WHEN '{n}' THEN {f}D" for n, f in VERSION_FACTORS.items())
        factor = f"CASE {read('model_version')} {cases} ELSE 1D END"
    return unit(
        "(0.40D"
        f" + ({of('rainfall_7d_mm', 50.0)} - 50D) / 1500D * 0.15D"
        f" - ({of('drainage_index', 0.5)} - 0.5D) * 0.12D"
        f" - least(({of('elevation_m', 30.0)} - 30D) / 500D, 0.1D) * 0.08D"
        f" - least(({of('distance_to_river_m', 500.0)} - 500D) / 5000D, 0.1D) * 0.06D"
        f" - ({of('infrastructure_score', 0.5)} - 0.5D) * 0.08D"
        f" + ({of('historical_flood_count', 2.0)} - 2D) * 0.02D"
        f" + ({of('extreme_weather_index', 0.3)} - 0.3D) * 0.10D"
        f" + greatest(({of('nearest_hospital_km', 5.0)} - 5D) / 50D, 0D) * 0.04D"
        f") * {factor}"
    )


def linear_score(read: Read) -> str:
    """A linear scorer over the six actionable features, within [0, 1]."""
    return unit(
        "0.90D"
        f" - {read('drainage_index')} * 0.20D - {read('infrastructure_score')} * 0.15D"
        f" + {read('nearest_evac_km')} * 0.01D + {read('nearest_hospital_km')} * 0.005D"
        f" - {read('distance_to_river_m')} * 0.00002D + {read('built_up_percent')} * 0.001D"
    )


def score(scorer: Scorer = heuristic_score, read: Read = plain) -> Column:
    return F.expr(scorer(read))


def linear_combination(weights: dict[str, float], intercept: float = 0.0) -> Scorer:
    """A fitted linear model as a scorer: intercept plus weighted columns."""
    def scorer(read: Read) -> str:
        terms = [f"{read(n)} * {float(w)!r}D" for n, w in weights.items()]
        return " + ".join([f"{float(intercept)!r}D", *terms])
    return scorer
