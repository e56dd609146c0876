"""Payloads that could not be sent yet, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import backlog_name


def backlog_entries(payloads: DataFrame) -> DataFrame:
    """``name, created_at, payload`` for payloads with a ``created_at``."""
    return payloads.select(backlog_name("created_at").alias("name"), "created_at", "payload")


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    """The backlog in sending order: names begin with the time."""
    return spark.read.parquet(path).orderBy("name")


def save_backlog(entries: DataFrame, path: str) -> None:
    entries.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
