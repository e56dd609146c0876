"""Which runs and unsent payloads are due for removal, and which are still to send."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retention_hours(configured: int | None, log_retention_days: int = 7) -> int:
    """Not configured falls back to the log retention; 0 removes right after export."""
    return log_retention_days * 24 if configured is None else configured


def _moment(now: datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def retention_report(
    runs: DataFrame, hours: int | None, log_retention_days: int = 7, now: datetime | Column | None = None
) -> DataFrame:
    """``runs`` (with ``run_ts`` and, for 0 hours, ``exported``) plus ``expired``."""
    keep = retention_hours(hours, log_retention_days)
    if keep == 0:
        return runs.withColumn("expired", F.col("exported"))
    cutoff = _moment(now) - F.make_dt_interval(F.lit(0), F.lit(keep))
    return runs.withColumn("expired", F.col("run_ts") < cutoff)


def backlog_due(backlog: DataFrame, max_age_seconds: int, now: datetime | Column | None = None) -> DataFrame:
    """Unsent payloads that have not expired; an age of 0 keeps all."""
    if max_age_seconds <= 0:
        return backlog
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_seconds))
    return backlog.where(~(F.col("created_at") + age < _moment(now)))
