"""Removal of lines that many sites share, by distinct-site spread.

A line's key is its trimmed text, hashed to 128 bits. Lines that occur less often than
``MIN_SITES`` cannot be on as many sites and are dropped from the count at once. The others
are combined per key and site before they meet, and a HyperLogLog sketch of the sites is built
per key; sketches of partial aggregates merge, so a line that stands in a third of all
documents is no hot group. A key whose estimate lies within
the sketch's error of the threshold gets an exact distinct count instead. A line on at least
``MIN_SITES`` sites is kept where it occurs first (smallest document id, then place), so that
no content leaves the corpus, and removed everywhere else.

Built-in functions only. The keys are a table in the shared folder; texts are shuffled once,
to meet the numbers of the lines they lose.

Defined cases: blank lines are never removed; a null text stays null, with no lines. A null
site is no site. A null id comes before all others. Rows of equal id and text are one
document. Extra columns stay;
n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

MIN_SITES = 10
#: Size of a sketch, as a power of two, and the standard errors beyond which an estimate is trusted.
LG_K, ERRORS = 12, 4.0


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, site, place, h1, h2 of every line that is not blank."""
    lines = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("site"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"),
    ).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    return lines.where("line != ''").select(
        "doc_id", "text_key", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def widespread(keys: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and the first place (doc_id, text_key, place) of the lines on ``min_sites`` sites or more."""
    often = keys.groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    by_site = keys.groupBy("h1", "h2", "site").agg(F.min(F.struct("doc_id", "text_key", "place")).alias("first"))
    candidates = written(by_site.join(often, ["h1", "h2"], "left_semi"), "line-sites")
    spread = written(
        candidates.groupBy("h1", "h2").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("first").alias("first")
        ),
        "spread",
    )
    margin = ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites
    near = spread.where(F.abs(F.col("sites") - min_sites) <= max(1.0, margin))
    exact = (
        candidates.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
    )
    counted = spread.join(exact, ["h1", "h2"], "left")
    return counted.where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first")


def without_widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with cleaned text, n_lines and n_removed; other columns stay."""
    keys = written(line_keys(docs), "line-keys")
    place = F.struct("doc_id", "text_key", "place")
    lost = (
        keys.join(widespread(keys, min_sites), ["h1", "h2"]).where(place != F.col("first"))
        .groupBy(F.col("doc_id").alias("_lost_id"), F.col("text_key").alias("_lost_key")).agg(F.collect_set("place").alias("_lost"))
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_lost_id")) & (F.xxhash64("text") == F.col("_lost_key"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return docs.join(lost, same, "left").withColumn("_lines", F.split("text", "\n")).select(
        *others,
        F.when(F.col("_lost").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_removed"),
    )
