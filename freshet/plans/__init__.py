"""All registered queries and the SQL they are checked against."""

from freshet.plans import (
    blend_queries, encoding_queries, feature_queries, log_queries, model_queries, pipeline_queries,
    scenario_queries, stats_queries,
)

MODULES = [feature_queries, encoding_queries, stats_queries, scenario_queries, log_queries, blend_queries, model_queries,
           pipeline_queries]


def all_queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
