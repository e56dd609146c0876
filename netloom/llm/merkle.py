"""A Merkle manifest of a table: every row a leaf, one root, a proof per row.

Rows of a group (a language) are ordered and numbered without bringing a group together, and
every run of ``WIDTH`` consecutive nodes becomes their parent until one is left, the group's
subroot; the subroots are reduced to the root alike. A level is one equi-join of its nodes with
themselves: a node is sent to the indices of the other slots of its run, computed by slot
offsets, and meets the node that is there; the slot-zero node of a run, which then knows all its
siblings, emits the parent. The proofs come down the same levels: a node's path is its own
siblings in front of its parent's path, so only the last join has as many rows as the table.

Levels are tables in the shared folder, each an eighth of the one below. No task holds a
group, no more than a run is gathered in a row, and the paths grow with the logarithm of the rows.

Digests are lowercase hex of sha256; those of several nodes are hashed as concatenated hex text.

Defined cases: a null cell is ``-``; an empty one is ``0:``. Rows with a null group are a group
of their own, the first one. Rows ascend by id, a null id first, rows of equal ids by their digest;
equal rows have equal leaves and places of their own. A group of one row has its leaf as subroot. An
empty table gives no rows. Columns that are not part of the leaf are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.operators.ordered import dense_numbers

#: Nodes that one parent covers.
WIDTH = 8
#: Columns of a documents row that make its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOT, _UP = f"pos % {WIDTH}", f"pos div {WIDTH}"


def digest(*parts: Column) -> Column:
    """sha256 of concatenated text, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def row_digest(columns: list[Column]) -> Column:
    """The leaf of a row: every cell with its length in bytes, so that no two rows share a text."""

    def cell(value: Column) -> Column:
        told = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))

    return digest(*[cell(c) for c in columns])


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, n, pos, hash, ...) plus ``left`` and ``right``: the run's other digests, in order.

    Nodes and shifted copies are both partitioned by (key, pos), so the join and the
    gathering of at most ``WIDTH`` - 1 siblings are one pair of shuffles.
    """
    shifted = (
        nodes.select("key", "n", "pos", "hash", F.explode(F.sequence(F.lit(1), F.lit(WIDTH - 1))).alias("offset"))
        .withColumn("to", F.expr(f"pos - {_SLOT} + ({_SLOT} + offset) % {WIDTH}"))
        .where("to < n")
        .select("key", F.col("to").alias("pos"), F.struct(F.expr(_SLOT).alias("slot"), "hash").alias("sibling"))
    )
    own = [c for c in nodes.columns if c not in ("key", "pos")]
    met = nodes.join(shifted, ["key", "pos"], "left").groupBy("key", "pos").agg(
        *[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list("sibling")).alias("siblings")
    )

    def joined(side: Column) -> Column:
        return F.unhex(F.array_join(F.transform(side, lambda s: F.hex(s["hash"])), ""))

    before = F.filter("siblings", lambda s: s["slot"] < F.expr(_SLOT))
    after = F.filter("siblings", lambda s: s["slot"] > F.expr(_SLOT))
    return met.select(*nodes.columns, joined(before).alias("left"), joined(after).alias("right"))


def climbed(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of all trees with their siblings, and the roots (key, n, pos, hash) found at each height."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, roots, nodes = [], [leaves.where("n = 1")], leaves
    while most > 1:
        level = written(with_siblings(nodes.where("n > 1")), "merkle-level")
        parent = digest(hex_text(F.col("hash")), hex_text(F.col("right"))).alias("hash")
        nodes = level.where(f"{_SLOT} = 0").select("key", F.ceil(F.col("n") / WIDTH).alias("n"), F.expr(_UP).alias("pos"), parent)
        levels.append(level)
        roots.append(nodes.where("n = 1"))
        most = math.ceil(most / WIDTH)
    return levels, roots


def descended(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their paths: ``above`` (key, path, ...) goes on where a tree's root is."""
    carried = [c for c in above.columns if c != "key"]
    step = F.array(F.struct("left", "right"))
    parents = None
    for height in range(len(roots) - 1, -1, -1):
        own = [c for c in roots[height].columns if c != "key"]
        found = roots[height].join(above, "key").select("key", *own, *carried)
        if height < len(levels):
            met = levels[height].withColumn("up", F.expr(_UP))
            over = parents.select("key", F.col("pos").alias("up"), *carried)
            joined = met.join(over, ["key", "up"]).withColumn("path", F.concat(step, "path"))
            found = found.unionByName(joined.select("key", *own, *carried))
        parents = found
    return parents


def manifest(
    docs: DataFrame, group: str = "lang", row_id: str = "doc_id", fields: tuple[str, ...] = FIELDS, held: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: ``row_id``, ``leaf``, ``held_leaf``, ``subroot``, ``root`` and ``path``, all digests as bytes.

    ``path`` are the levels from the leaf to the root, each the digests of the siblings before
    (``left``) and after (``right``). ``held_leaf`` is the digest of the row as someone holds it now:
    of the expressions ``held`` (by column) in place of the columns.
    """
    held = held or {}
    key = F.coalesce(F.concat(F.lit("+"), group), F.lit(""))
    leaves = docs.select(
        key.alias("key"), F.col(row_id).alias("id"), row_digest([F.col(c) for c in fields]).alias("hash"),
        row_digest([held.get(c, F.col(c)) for c in fields]).alias("held"),
    )
    rows = dense_numbers(leaves, ["key"], ["id", "hash"], "pos", "n")
    levels, roots = climbed(rows.select("key", "n", "pos", "hash", "id", "held"))
    subroots = written(_union([r.select("key", "hash") for r in roots]), "merkle-subroots")
    tops = dense_numbers(subroots.select(F.lit("").alias("all"), "key", "hash"), ["all"], ["key"], "pos", "n")
    top_levels, top_roots = climbed(tops.select(F.col("all").alias("key"), "n", "pos", "hash", F.col("key").alias("of")))
    no_path = F.array().cast("array<struct<left: binary, right: binary>>").alias("path")
    root = _union([r.select("key", F.col("hash").alias("root"), no_path) for r in top_roots])
    above = descended(top_levels, top_roots, root).select(F.col("of").alias("key"), F.col("hash").alias("subroot"), "root", "path")
    found = descended(levels, roots, above)
    return found.select(F.col("id").alias(row_id), F.col("hash").alias("leaf"), F.col("held").alias("held_leaf"), "subroot", "root", "path")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give, as hex text."""
    return F.aggregate(path, hex_text(leaf), lambda at, step: F.sha2(F.concat(hex_text(step["left"]), at, hex_text(step["right"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of a path's digests from left to right, level by level."""
    told = F.transform(path, lambda step: F.concat(hex_text(step["left"]), hex_text(step["right"])))
    return F.sha2(F.array_join(told, "").cast("binary"), 256)
