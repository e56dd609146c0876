"""Columns that are built once."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps
from typing import Any

from pyspark import SparkContext


def built_once(build: Callable[..., Any]) -> Callable[..., Any]:
    """Keeps the columns a function builds for its arguments.

    Every operation of a column is a call from Python to the JVM. The fields of a packet take
    thousands, which are seconds of each micro-batch, more than its jobs. A column belongs to no
    table, so the next batch can use it again; it lives as long as the JVM it was built in.
    """

    @lru_cache(maxsize=64)
    def kept(gateway: Any, *args: Any) -> Any:
        return build(*args)

    @wraps(build)
    def once(*args: Any) -> Any:
        return kept(SparkContext._gateway, *args)

    return once
