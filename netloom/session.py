"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE picks broadcast joins from measured shuffle sizes and splits skewed
    join partitions, so no operator forces a broadcast of data it has not measured.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, wherever they run.

    Once per application; a cluster that installs the package loses nothing by it.
    """
    context = spark.sparkContext
    if not getattr(context, "_netloom_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="netloom-")) / "netloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._netloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only where nothing is configured (a local test session) is a temporary
    folder made; that is refused on a cluster, where it would be one machine's own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="netloom-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What writes in here shuffle is deleted when they end, not when the driver happens to collect garbage."""
    before = spark.conf.get(_DROPPED, None)
    spark.conf.set(_DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROPPED) if before is None else spark.conf.set(_DROPPED, before)


@contextmanager
def fewer_shuffle_partitions(spark: SparkSession, size: int) -> Iterator[None]:
    """Within, shuffles of about ``size`` bytes have one partition a core and one for every 16 MB, never more than are set.

    Every task of a small shuffle opens a file for each partition, however few its rows are.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism + size // (16 << 20))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fits_broadcast(kept: DataFrame) -> bool:
    """Whether a checkpoint measures below the session's broadcast threshold."""
    spark = kept.sparkSession
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    least = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or given
    most = -1 if least.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(least)
    return most >= 0 and (kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most


def small_side(df: DataFrame) -> DataFrame:
    """A checkpoint of a join's smaller side, marked for broadcast if it was measured below the session's threshold.

    The other side then needs no shuffle. Left to AQE it is shuffled by the join's keys before the small side
    is known, and where few of the partitions have rows AQE prefers to sort them: then one key is one task.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if fits_broadcast(kept) else kept
