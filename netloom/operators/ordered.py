"""Running values over event order, safe for keys that hold most of the rows.

A plain window over a key puts all its rows into one task. Here the order column is
cut into blocks of 2**block_bits numbers; since it numbers the events, a
(key, block) pair has at most that many rows whatever the skew. Windows run inside
the blocks, each block is summed up to one row by a partial aggregate, and what
earlier blocks leave behind is carried over those few summary rows.

Where the numbers have gaps, a block of numbers may hold a single event, and a key would have
as many summary rows as events. ``dense`` then takes the events' ranks as block numbers: one
sort over all tasks more, and every block of a key but its last is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.session import scratch_path, shuffles_dropped, small_side

BLOCK_BITS = 18


def dense_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None, path: str | None = None
) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... per key in the ascending order of ``order``, NULL first.

    ``total`` adds the key's number of rows. No key is brought together: rows are range
    partitioned by key and order and written in that order, a key's rows are counted per
    partition, and the counts before a partition are its offset. Rows equal in all of
    ``order`` are numbered in any order, but they stay in one partition, so ``order``
    should tell most rows apart. The rows are a table in the shared folder; ``path`` names it for
    a caller that drops it when done. The counts meet it unshuffled if they measure small.
    """
    spark, sort = df.sparkSession, [*keys, *order]
    path = path or scratch_path(spark, "numbered")
    # Partition number in the high bits, place in the sorted partition below.
    sorted_rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    with shuffles_dropped(spark):
        sorted_rows.withColumn("_place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    per_key = Window.partitionBy(*keys)
    counts = (
        placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))
        .withColumns({
            "_offset": F.coalesce(F.sum("_n").over(per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_n").over(per_key),
        })
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_in"), "_least", "_offset", "_total")
    )
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    number = (F.col("_place") - F.col("_least") + F.col("_offset")).alias(name)
    return placed.join(small_side(counts), same).select(*df.columns, number, *([F.col("_total").alias(total)] if total else []))


def running_values(
    df: DataFrame,
    keys: list[str],
    order: str,
    firsts: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    include_current: bool = False,
    tie: Column | None = None,
    block_bits: int = BLOCK_BITS,
    dense: bool = False,
) -> DataFrame:
    """Adds, per key, the first / last non-NULL value of expressions before each row.

    ``include_current`` takes the row itself in. ``tie`` orders rows of equal number.
    ``dense`` is for orders that do not number the events: any sortable column, with gaps.
    """
    firsts, lasts = firsts or {}, lasts or {}
    names, columns = [*firsts, *lasts], df.columns
    if dense:
        df = df.withColumn("_tie", tie if tie is not None else F.lit(0))
        df = dense_numbers(df, keys, [order, "_tie"], "_number")
        order, tie = "_number", None
    rows = df.withColumn("_blk", F.shiftright(F.col(order), block_bits)).withColumns(
        {f"_v_{n}": c for n, c in {**firsts, **lasts}.items()}
    )
    within = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(order, *([tie] if tie is not None else []))
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    inside = rows.withColumns(
        {f"_in_{n}": F.first(f"_v_{n}", ignorenulls=True).over(within) for n in firsts}
        | {f"_in_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in lasts}
    )

    def present(name: str) -> Column:
        return F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))

    summary = rows.groupBy(*keys, "_blk").agg(
        *[F.min_by(f"_v_{n}", present(n)).alias(f"_s_{n}") for n in firsts],
        *[F.max_by(f"_v_{n}", present(n)).alias(f"_s_{n}") for n in lasts],
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.withColumns(
            {f"_c_{n}": F.first(f"_s_{n}", ignorenulls=True).over(earlier) for n in firsts}
            | {f"_c_{n}": F.last(f"_s_{n}", ignorenulls=True).over(earlier) for n in lasts}
        )
        .where(" or ".join(f"_c_{n} is not null" for n in names))
        .select(*keys, "_blk", *[f"_c_{n}" for n in names])
    )
    return inside.join(carry, [*keys, "_blk"], "left").select(
        *columns,
        *[F.coalesce(f"_c_{n}", f"_in_{n}").alias(n) for n in firsts],
        *[F.coalesce(f"_in_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def asof_number(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, name: str, block_bits: int = BLOCK_BITS,
    dense: bool = False,
) -> DataFrame:
    """``left`` plus ``name``: the number of the latest ``right`` row of the key before it.

    NULL where there is none, also for a NULL key. Left rows come out once each. Only
    keys and numbers of the right side are moved. ``dense`` as in ``running_values``.
    """
    row = F.struct(*left.columns)
    empty = F.lit(None).cast(left.select(row.alias("s")).schema["s"].dataType)
    own = right.schema[order].dataType
    number = T.LongType() if isinstance(own, T.IntegralType) else own
    events = left.select(*keys, order, row.alias("_l"), F.lit(None).cast(number).alias("_r")).unionByName(
        right.dropna(subset=keys).select(*keys, order, empty.alias("_l"), F.col(order).cast(number).alias("_r"))
    )
    known = running_values(
        events, keys, order, lasts={name: F.col("_r")}, tie=F.col("_l").isNull(), block_bits=block_bits, dense=dense
    )
    return known.where("_l is not null").select("_l.*", name)


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, name: str, block_bits: int = BLOCK_BITS,
    dense: bool = False,
) -> DataFrame:
    """``left`` plus struct ``name``: the latest ``right`` row of the key before it.

    ``order`` is unique on the right side. NULL as in ``asof_number``.
    """
    matched = asof_number(left, right, keys, order, "_match", block_bits, dense)
    rows = right.select(F.col(order).alias("_match"), F.struct("*").alias(name))
    return matched.join(rows, "_match", "left").drop("_match")
