"""Continuous form of simulate-and-log: requests arrive as files, log rows are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.constants import NUMERIC_INPUTS
from freshet.functions.scorers import Scorer, heuristic_score
from freshet.operators.logs import bin_condition, log_rows
from freshet.constants import SCORE_BINS
from freshet.operators.scenario import scenario_rows, simulate


def simulate_and_log(
    requests: DataFrame, log_path: str, checkpoint: str, scorer: Scorer = heuristic_score
) -> StreamingQuery:
    """Scores a stream of requests and appends the log rows, each batch exactly once.

    Every batch writes its own folder and a repeated batch overwrites it.
    """

    def append(batch: DataFrame, number: int) -> None:
        scored = simulate(scenario_rows(batch, ["model_version", "asked_at"]), scorer)
        rows = log_rows(
            scored.withColumn("inference_time_ms", F.lit(0.0)), ["district", *NUMERIC_INPUTS], F.col("asked_at")
        )
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return (
        requests.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_histogram(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Log rows per time window and score bin; rows later than `late` are not waited for."""
    counts = [
        F.count_if(bin_condition(low, high)).alias(f"bin_{i}") for i, (_, low, high) in enumerate(SCORE_BINS)
    ]
    return log.withWatermark("timestamp", late).groupBy(F.window("timestamp", width)).agg(
        F.count(F.lit(1)).alias("total"), *counts
    )
