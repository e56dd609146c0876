"""A corpus pipeline over ``documents``: five stages, each a filter or an edit of the one before.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. A stage's
own docstring says which documents go. Columns besides those of ``documents`` stay until the
last stage, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from netloom.llm.common import id_remainder, written

#: A document goes if no language has this probability.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no language's ``MIN_LANGUAGE_SCORE``."""
    held = id_remainder(F.col("doc_id"), 4) == 2
    found = language_id.predicted(_carried(docs), language_id.trained(docs, ~held))
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _restored(found.where(kept), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that ten sites share, but where they occur first; drops texts of nothing else."""
    cleaned = line_dedup.without_widespread_lines(_carried(docs, "source"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = _restored(cleaned.where(~F.coalesce(emptied, F.lit(False))), docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every near-duplicate group."""
    lost = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    same = (F.col("doc_id") == F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_key"))
    return docs.join(lost, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_carried(docs), items)
    return _restored(found.where(F.size("hits") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with its columns that an operator doesn't use in one, so that no name clashes with the operator's own."""
    own = ["doc_id", "text", *used]
    return docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("_rest"))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    top = set(found.columns) & set(docs.columns)
    inside = set(found.schema["_rest"].dataType.names)
    return found.select(*[F.col(f"_rest.`{c}`").alias(c) if c in inside else F.col(f"`{c}`") for c in docs.columns if c in inside | top])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language identification cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
