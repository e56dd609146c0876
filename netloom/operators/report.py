"""Run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.schemas import LOG_NAMES

# Operations per second from which a run is in a class.
HIGH_RATE = 10000
GOOD_RATE = 5000


def run_summary(
    logs: dict[str, DataFrame],
    duration_seconds: int,
    messages: DataFrame | None = None,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Per run: rows of each log, conn+dns operations, whole operations per second and
    their class, number of error lines and largest metric value.

    ``messages`` is ``run_id, line``; ``metrics`` is ``run_id, value``.
    """
    none = F.lit(None)
    parts = [
        df.select("run_id", F.lit(name).alias("log"), none.cast("string").alias("line"), none.cast("double").alias("value"))
        for name, df in logs.items()
    ]
    if messages is not None:
        parts.append(messages.select("run_id", F.lit("_message").alias("log"), "line", none.cast("double").alias("value")))
    if metrics is not None:
        parts.append(metrics.select("run_id", F.lit("_metric").alias("log"), none.cast("string").alias("line"), "value"))
    counts = [F.count_if(F.col("log") == n).alias(f"{n}_rows") for n in LOG_NAMES]
    summary = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("run_id")
        .agg(
            *counts,
            F.count_if(F.col("line").rlike("Error|Failed")).alias("error_lines"),
            F.max("value").alias("max_metric"),
        )
        .withColumn("operations", F.col("conn_rows") + F.col("dns_rows"))
    )
    rate = F.expr(f"conn_rows div {duration_seconds} + dns_rows div {duration_seconds}")
    return summary.withColumn("rate", rate).withColumn(
        "class",
        F.when(F.col("rate") >= HIGH_RATE, "high").when(F.col("rate") >= GOOD_RATE, "good").otherwise("moderate"),
    )
