"""Removing every record that touches an excluded subnet.

A row is excluded if any of its address columns, or any element of an address-set
column (DNS answers), lies in one of the subnets. Columns go by name; what is not
an address is never inside. An empty list turns the filter off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.ip import (
    Cidr, cidr_columns, cidr_list, cidr_prefixes, colon_in_cidrs, in_cidrs, ip_family, ip_hex, lookup_prefixes, quad_in_cidrs,
)
from netloom.functions.once import built_once
from netloom.operators.ordered import BLOCK_BITS, dense_numbers, running_values
from netloom.schemas import ADDRESS_COLUMNS, ADDRESS_SET_COLUMNS
from netloom.session import scratch_path

Cidrs = str | list[str]

# Up to so many subnets are one pattern tested on the text; more are a set that an address's
# prefixes are looked up in. Only the expression differs, never the rows.
PATTERNS = 64


def touches(columns: list[str], cidrs: list[Cidr]) -> Column:
    """True where one of the row's addresses is in one of the subnets.

    Dotted quads are matched in compiled code; the costlier test of text with a colon
    is entered only by rows that have some.
    """
    return _touches(tuple(columns), tuple(cidrs)) if cidrs else F.lit(False)


@built_once
def _touches(columns: tuple[str, ...], cidrs: tuple[Cidr, ...]) -> Column:
    if len(cidrs) > PATTERNS:
        own = [F.col(c) for c in ADDRESS_COLUMNS if c in columns]
        sets = [F.col(c) for c in ADDRESS_SET_COLUMNS if c in columns]
        inside = prefix_test(cidrs)
        tests = [F.exists(F.array(*own), inside)] if own else []
        tests += [F.coalesce(F.exists(c, inside), F.lit(False)) for c in sets]
        return reduce(Column.__or__, tests, F.lit(False))
    scalars = [F.col(c) for c in ADDRESS_COLUMNS if c in columns]
    tests = [quad_in_cidrs(c, cidrs) for c in scalars]
    if scalars:
        colon = reduce(Column.__or__, [F.coalesce(c.contains(":"), F.lit(False)) for c in scalars])
        tests.append(colon & F.exists(F.array(*scalars), lambda a: colon_in_cidrs(a, cidrs)))
    for c in ADDRESS_SET_COLUMNS:
        if c in columns:
            tests.append(F.coalesce(F.exists(F.col(c), lambda a: in_cidrs(a, cidrs)), F.lit(False)))
    return reduce(Column.__or__, tests, F.lit(False))


def prefix_test(cidrs: Iterable[Cidr]) -> Callable[[Column], Column]:
    """Whether an address has one of the subnets' prefixes: one hash lookup per prefix length."""
    prefixes = sorted({net.family + p for net in cidrs for p in net.nibble_prefixes()})
    lengths = sorted({len(p) for p in prefixes})

    def inside(address: Column) -> Column:
        return F.coalesce(F.exists(lookup_prefixes(address, lengths), lambda p: p.isin(prefixes)), F.lit(False))

    return inside


def exclude_subnets(df: DataFrame, cidrs: Cidrs, strict: bool = True) -> DataFrame:
    """``df`` without the rows that touch ``cidrs``; works on streams too."""
    nets = cidr_list(cidrs, strict)
    if not nets:
        return df
    return df.where(~touches(df.columns, nets))


def disjoint_ranges(table: DataFrame, cidr_col: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``family, lo, hi``: the addresses of all subnets of a table as ranges that do not overlap.

    Subnets are nested or apart, so the ranges are the subnets that no other one holds. In
    the order of their first addresses a subnet is held by another exactly if the last one that
    is not held reaches its end, which is a running maximum over all subnets of the family.
    """
    found = cidr_columns(table.select(cidr_col), cidr_col).where("valid").groupBy("family", "lo").agg(F.max("hi").alias("hi"))
    numbered = dense_numbers(found, ["family"], ["lo"], "_n")
    # As in running_values: a maximum inside blocks of numbers, then one over the blocks.
    within = Window.partitionBy("family", F.shiftright("_n", block_bits)).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    inside = numbered.withColumns({"_blk": F.shiftright("_n", block_bits), "_before": F.max("hi").over(within)})
    blocks = inside.groupBy("family", "_blk").agg(F.max("hi").alias("_top"))
    earlier = Window.partitionBy("family").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.max("_top").over(earlier)).select("family", "_blk", "_carried")
    reach = F.greatest("_before", "_carried")
    return inside.join(carried, ["family", "_blk"]).where(reach.isNull() | (reach < F.col("hi"))).select("family", "lo", "hi")


def addresses_in_ranges(addresses: DataFrame, ranges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The ``address`` texts of a one-column DataFrame that lie in one of ``disjoint_ranges``.

    Addresses and range starts are put in one order; the latest start at or before an
    address is the only range that can hold it.
    """
    key = ip_hex("address")
    asked = addresses.select(key.alias("lo"), "address").where("lo is not null")
    none = F.lit(None).cast("string")
    events = (
        asked.select(ip_family("lo").alias("family"), "lo", F.lit(1).alias("kind"), "address", none.alias("hi"))
        .unionByName(ranges.select("family", "lo", F.lit(0).alias("kind"), none.alias("address"), "hi"))
    )
    known = running_values(events, ["family"], "lo", lasts={"reach": F.col("hi")}, tie=F.col("kind"), block_bits=block_bits, dense=True)
    return known.where("kind = 1 and lo <= reach").select("address")


def exclude_by_table(
    df: DataFrame, table: DataFrame, cidr_col: str, strict: bool = True, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """``exclude_subnets`` for a table of subnets of any size.

    ``strict`` stops the job at an entry that is no subnet (NULL and blank ones apart);
    otherwise such entries are left out and filter nothing.

    The subnets are merged into disjoint ranges, and the distinct addresses of all address
    columns looked up in them once. What is left out are the distinct combinations of a row's
    address cells that hold one of those found, so the rows themselves are moved once, for one
    anti join, however many address columns they have; AQE splits a combination that most
    rows share on the row side. The combinations are found once and kept, as they are used twice; they,
    the ranges and the lookup are tables in the shared folder, written when this is called.
    """
    if strict:
        entry = F.col(cidr_col)
        bad = F.coalesce(F.trim(entry) != "", F.lit(False)) & cidr_prefixes(cidr_col).isNull()
        table = table.withColumn(cidr_col, F.when(bad, F.raise_error(F.concat(F.lit("invalid CIDR entry: "), entry))).otherwise(entry))
    scalars = [c for c in ADDRESS_COLUMNS if c in df.columns]
    sets = [c for c in ADDRESS_SET_COLUMNS if c in df.columns]
    if not scalars + sets:
        return df
    cells = F.struct(*scalars, *sets)
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "address-cells")
    df.select(cells.alias("_cells")).distinct().write.parquet(path)
    of = lambda c: F.col("_cells")[c]
    own = F.concat(F.array(*map(of, scalars)).cast("array<string>"), *[F.coalesce(of(c), F.array().cast("array<string>")) for c in sets])
    held = spark.read.parquet(path).select("_cells", F.explode(F.array_distinct(own)).alias("address")).where("address is not null")
    inside = addresses_in_ranges(held.select("address").distinct(), disjoint_ranges(table, cidr_col, block_bits), block_bits)
    lost = held.join(inside, "address", "left_semi").select("_cells").distinct()
    return df.withColumn("_cells", cells).join(lost, "_cells", "left_anti").select(*df.columns)


def exclude_from_logs(logs: dict[str, DataFrame], cidrs: Cidrs) -> dict[str, DataFrame]:
    """The filter on every given log. A bad list raises before anything is planned."""
    cidr_list(cidrs, strict=True)
    return {name: exclude_subnets(df, cidrs) for name, df in logs.items()}


def dropped_report(logs: dict[str, DataFrame], cidrs: Cidrs) -> DataFrame:
    """``log, total, dropped`` per log."""
    nets = cidr_list(cidrs, strict=True)
    parts = [
        df.select(F.lit(name).alias("log"), touches(df.columns, nets).alias("_hit"))
        for name, df in logs.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("log")
        .agg(F.count("*").alias("total"), F.count_if("_hit").alias("dropped"))
    )
