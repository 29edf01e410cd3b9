"""Explicit schemas of the observation, prediction and log tables."""

from __future__ import annotations

from pyspark.sql import types as T

from freshet.constants import CATEGORICAL, NUMERIC_INPUTS, PRECOMPUTED, TARGET, TRACKED_COLUMNS


def observation_schema(labelled: bool = True) -> T.StructType:
    """Raw observation rows as shipped in CSV files."""
    schema = T.StructType()
    for name in ["record_id", "generation_date", *CATEGORICAL]:
        schema = schema.add(name, T.StringType())
    for name in ["latitude", "longitude", *NUMERIC_INPUTS, *PRECOMPUTED]:
        schema = schema.add(name, T.DoubleType())
    schema = schema.add("is_synthetic", T.StringType())
    return schema.add(TARGET, T.DoubleType()) if labelled else schema


PREDICTIONS = "record_id string, split string, model string, seed int, repeat int, fold int, pred double"
SUBMISSION = "record_id string, flood_risk_score double"
LOG = (
    "id bigint, timestamp timestamp, model_version string, district string, "
    + ", ".join(f"{name} double" for name in TRACKED_COLUMNS)
    + ", input_features_json string, flood_risk_score double, risk_level string, "
    "inference_time_ms double"
)
