"""What several corpus operators share: scratch tables, row keys, hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netloom.session import scratch_path

#: Odd multipliers of the integer mixer (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: read often, computed once, no lineage left."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
    """``written`` with what its write counts on the way: ``rows`` and further aggregates."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]), name)
    return back, {"rows": 0, **{n: v for n, v in seen.get.items() if v is not None}}


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def fields(df: DataFrame, without: Iterable[str] = ()) -> str:
    """The schema of ``df`` but for some columns, as DDL."""
    gone = set(without)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in gone)


def add_columns(
    columns: dict[str, pa.DataType], of_batch: Callable[[pa.RecordBatch], list], drop: Iterable[str] = ()
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: the batch without ``drop``, then what ``of_batch`` returns."""
    dropped = set(drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n not in dropped]
            new = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(of_batch(batch), columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, [*kept, *columns])

    return run
