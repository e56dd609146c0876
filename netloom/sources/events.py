"""TLS and HTTP event feeds, as tables or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.schemas import TLS_EVENTS


def read_events(spark: SparkSession, path: str, kind: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """One of ``client_hello, server_hello, tls_extension, http_header``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(TLS_EVENTS[kind]).format(fmt).load(path)
