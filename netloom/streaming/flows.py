"""Capture windows and flows of a packet stream, by event time.

Both are Spark's own windowed aggregates with a watermark: a row counts if it comes at most
``lateness`` behind the latest packet seen, later ones are dropped, and a window or flow is
given out once, when no row that still counts can reach it. Packets of one key and
micro-batch are combined before they are shuffled (for flows with
``merge_sessions_early``), so a busy pair of endpoints costs a row per task and open flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.flows import conn_rows


def merge_sessions_early(spark: SparkSession) -> None:
    """Sessions of a task are merged before the shuffle, not only behind it."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def window_counts(packets: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """``run_id, packets, bytes`` of every closed capture window, named as ``capture_window`` names it."""
    counts = (
        packets.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    )
    return counts.select(F.date_format("_w.start", "yyyyMMdd'T'HHmmss'Z'").alias("run_id"), "packets", "bytes")


def flow_stream(packets: DataFrame, gap_seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """conn rows of every closed flow, as ``operators.flows.flows`` gives them for a whole capture.

    A flow is closed when the watermark is past its last packet by the gap. The
    originator is the sender of the earliest packet, whatever order they come in.
    """
    source = F.struct(F.col("ip_src").alias("h"), F.col("sport").alias("p"))
    target = F.struct(F.col("ip_dst").alias("h"), F.col("dport").alias("p"))
    # Sessions that touch are merged, so a silence of exactly the gap does not end a flow.
    session = F.session_window("ts", f"{gap_seconds} seconds")
    merged = (
        packets.where("ip_src is not null")
        .withWatermark("ts", lateness)
        .select(
            "run_id", "proto", "ts", "length", F.least(source, target).alias("_a"), F.greatest(source, target).alias("_b"),
            F.struct(F.unix_micros("ts").alias("t"), "packet_no", (source > target).alias("backward")).alias("_place"),
        )
        .groupBy("run_id", "proto", "_a", "_b", session.alias("_session"))
        .agg(
            F.min("_place").alias("_opener"), F.max(F.unix_micros("ts")).alias("last"),
            F.count("*").alias("packets"), F.sum("length").alias("bytes"),
        )
    )
    return conn_rows(merged.withColumn("first", F.col("_opener.t")), ~F.col("_opener.backward"))
