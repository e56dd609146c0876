"""Hard negatives of anchor vectors: exact, with scores bounded by segment summaries first.

A vector is cut into segments and each keeps its mean and its deviation. For one segment of two
vectors the inner product is (length x mean x mean) plus at most, or minus at most, (length x
deviation x deviation); summed over the segments these bound the score. A few long segments
bound all rows of a block at once; who can still matter is bounded again by shorter
segments, level by level, and only what is left gets its exact score.

Two passes over pairs of an anchor block and a row block:

1. positives: the rows of the anchor's label, but those whose upper bound is below the lower
   bounds of as many others as are wanted;
2. negatives: the rows of other labels whose bounds reach the band of some positive, but those
   whose upper bound is below the lower bounds of as many others that are surely in that band.

Each pair of blocks gives its best few; the best of all pairs follow by rank. Rows with one label and
vector are one entry of a block with their smallest ids, as many as any answer can need, so a vector that
a third of all rows share is one entry too. The result is exact: no index, no recall to measure.

How few are left depends on the vectors: segments of like components (signals, smoothed or sorted
features) leave few, those of independent random components leave nearly all to the exact scores.

The work of a task is one pair of blocks (``ANCHORS`` x ``BLOCK``), their number is that of
anchors times rows over the block sizes: a stated query set against all rows.

Defined cases: ``integer_vectors`` leaves out rows with a null id, label or vector, and those with a
null or non-finite component. Repeated rows count once; rows that share only their id are rows of
their own, but never each other's positives. A shorter vector counts as filled up with zeros. Ties go to
the smaller id. Labels that occur once have no positives, so no rows. An empty table gives no rows. Extra
columns are ignored. Scores that 64 bits don't hold stop the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written

#: Segments of each level of the summaries.
LEVELS = (4, 16)
#: Entries of a row block, anchors of an anchor block, anchors bounded at once.
BLOCK, ANCHORS, SLICE = 4096, 4096, 256


def integer_vectors(df: DataFrame, row_id: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components as floor(``scale`` * x)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    taken = df.where(F.coalesce(finite, F.lit(False)) & label.isNotNull() & F.col(row_id).isNotNull())
    return taken.select(F.col(row_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the segments' means and deviations, both times the root of the length."""
    found, dims = [], vectors.shape[1]
    for segments in LEVELS:
        edges = np.unique(np.linspace(0, dims, min(segments, dims) + 1).astype(int))[:-1] if dims else np.zeros(0, int)
        if not len(edges):
            found.append((np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1))))
            continue
        length = np.diff(np.append(edges, dims))
        mean = np.add.reduceat(vectors, edges, axis=1) / length
        spread = np.add.reduceat((vectors - np.repeat(mean, length, axis=1)) ** 2, edges, axis=1)
        found.append((mean * np.sqrt(length), np.sqrt(spread)))
    return found


class Entries:
    """Vectors of a block, with summaries and what their exact products need."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.floats = vectors.astype(np.float64)
        self.levels = summaries(self.floats)
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.top = int(max(abs(int(vectors.max())), abs(int(vectors.min())))) if vectors.size else 0

    @classmethod
    def of(cls, column, dims: int) -> Entries:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        vectors = np.zeros((len(sizes), dims), np.int64)
        vectors[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return cls(vectors)


def bounds(a: Entries, at, b: Entries, rows, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``at`` with ``rows``; a margin covers rounding."""
    (means, spreads), (other_means, other_spreads) = a.levels[level], b.levels[level]
    middle, reach = means[at] @ other_means[rows].T, spreads[at] @ other_spreads[rows].T
    reach += np.multiply.outer(a.norms[at], b.norms[rows]) * 1e-12 + 1e-6
    return middle - reach, middle + reach


def scores(a: Entries, i: int, b: Entries, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of anchor ``i`` with ``rows``."""
    most = a.vectors.shape[1] * a.top * b.top
    if most >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    if most < 1 << 53:
        return (b.floats[rows] @ a.floats[i]).astype(np.int64)
    return b.vectors[rows] @ a.vectors[i]


def _largest(values: np.ndarray, n: int) -> float:
    """The ``n``-th largest value; below everything if there are fewer."""
    return np.partition(values, -n)[-n] if len(values) >= n else -np.inf


def best_of_label(a: Entries, at: np.ndarray, b: Entries, rows: np.ndarray, n: int):
    """(anchor, rows, scores) that hold the anchor's ``n`` best entries among ``rows``, ties included."""
    for part in np.array_split(at, -(-len(at) // SLICE)):
        lower, upper = bounds(a, part, b, rows, 0)
        for i, low, up in zip(part, lower, upper, strict=True):
            left = rows[up >= _largest(low, n)]
            for level in range(1, len(LEVELS)):
                if len(left) > n:
                    (low,), (up,) = bounds(a, [i], b, left, level)
                    left = left[up >= _largest(low, n)]
            yield i, left, scores(a, i, b, left)


def best_in_bands(a: Entries, at: np.ndarray, b: Entries, others, bands, n: int):
    """(anchor, rows, scores) that hold, for each of the anchor's bands, the ``n`` best entries inside.

    ``others`` tells an anchor's rows as slices to leave out; ``bands`` its (least, most) scores.
    """
    every = np.arange(len(b.vectors))
    for part in np.array_split(at, -(-len(at) // SLICE)):
        lower, upper = bounds(a, part, b, every, 0)
        for i, low, up in zip(part, lower, upper, strict=True):
            outside = np.ones(len(every), bool)
            outside[others(i)] = False
            left = every[outside]
            low, up = low[outside], up[outside]
            for level in range(len(LEVELS)):
                if level:
                    (low,), (up,) = bounds(a, [i], b, left, level)
                needed = np.zeros(len(left), bool)
                for least, most in bands(i):
                    reaching = (up >= least) & (low <= most)
                    sure = (low >= least) & (up <= most)
                    needed |= reaching & (up >= _largest(low[sure], n))
                left = left[needed]
                if not len(left):
                    break
            if len(left):
                yield i, left, scores(a, i, b, left)


def _best_ids(ids: list[list[int]], rows: np.ndarray, found: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(id, score) of the ``n`` best rows' ids and of those that tie with them, in their order."""
    kept = found >= _largest(found, n)
    return sorted(((v, int(s)) for r, s in zip(rows[kept], found[kept], strict=True) for v in ids[r]), key=lambda x: (-x[1], x[0]))


def _filled(columns: list[list], *values) -> None:
    """Appends lists, and single values as often as the first list is long."""
    for column, value in zip(columns, values, strict=True):
        column.extend(value if isinstance(value, list) else [value] * len(values[0]))


def _positive_candidates(anchors: pa.Table, block: pa.Table, dims: int, n: int) -> pa.Table:
    out: list[list] = [[], [], [], []]
    if len(block) and len(anchors):
        a, b = Entries.of(anchors.column("vector"), dims), Entries.of(block.column("vector"), dims)
        slots, own, labels = (anchors.column(c).to_numpy() for c in ("slot", "vec_id", "label"))
        ids, of_rows = block.column("ids").to_pylist(), block.column("label").to_numpy()
        order = np.argsort(of_rows, kind="stable")
        for label in np.unique(labels):
            begin, end = np.searchsorted(of_rows[order], [label, label + 1])
            if begin < end:
                # one more, for the anchor may be among them itself
                for i, rows, found in best_of_label(a, np.nonzero(labels == label)[0], b, order[begin:end], n + 1):
                    best = [x for x in _best_ids(ids, rows, found, n + 1) if x[0] != own[i]][:n]
                    _filled(out, [v for v, _ in best], [s for _, s in best], slots[i], own[i])
    return pa.table([pa.array(c, pa.int64()) for c in out], _POSITIVE)


def _negative_candidates(anchors: pa.Table, block: pa.Table, dims: int, n: int, low: int, high: int) -> pa.Table:
    out: list[list] = [[], [], [], []]
    if len(block) and len(anchors):
        a, b = Entries.of(anchors.column("vector"), dims), Entries.of(block.column("vector"), dims)
        slots, labels = anchors.column("slot").to_numpy(), anchors.column("label").to_numpy()
        ids, of_rows = block.column("ids").to_pylist(), block.column("label").to_numpy()
        order = np.argsort(of_rows, kind="stable")
        begins, ends = np.searchsorted(of_rows[order], labels), np.searchsorted(of_rows[order], labels + 1)
        limits = [[(-(-low * s // 100), high * s // 100) for s in told] for told in anchors.column("told").to_pylist()]
        for i, rows, found in best_in_bands(a, np.arange(len(slots)), b, lambda i: order[begins[i] : ends[i]], lambda i: limits[i], n):
            for place, (least, most) in enumerate(limits[i]):
                inside = (found >= least) & (found <= most)
                best = _best_ids(ids, rows[inside], found[inside], n)[:n]
                _filled(out, [v for v, _ in best], [s for _, s in best], slots[i], place)
    return pa.table([pa.array(c, pa.int64()) for c in out], _NEGATIVE)


_POSITIVE = ["positive_id", "positive_score", "slot", "anchor_id"]
_NEGATIVE = ["negative_id", "negative_score", "slot", "place"]


def _best(candidates: DataFrame, keys: list[str], score: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` best per key with their ``rank`` from 1; tasks keep no more than that before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row_id)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mined(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """(vec_id, label, vector) of integers -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Per anchor (a row where ``anchors`` holds) and positive (its best rows of the same label), the
    best rows of other labels with a score from ``low`` to ``high`` percent of the positive's.
    Rows, entries and anchors are tables in the shared folder, so the search begins when this is called.
    """
    rows = written(rows.select("vec_id", "label", "vector").distinct(), "vectors")
    keep = max(positives + 1, negatives)
    smallest = Window.partitionBy("label", "vector").orderBy("vec_id")
    entries = written(
        rows.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= keep)
        .groupBy("label", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "entries",
    )
    seekers = written(rows.where(anchors).withColumn("slot", F.monotonically_increasing_id()), "anchors")
    n, dims = entries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    row_blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-seekers.count() // anchor_block))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = entries.withColumn("r", F.pmod(F.xxhash64("label", "vector"), F.lit(row_blocks)).cast("int")).withColumn("a", every(anchor_blocks))
    asking = seekers.withColumn("a", F.pmod(F.xxhash64("slot"), F.lit(anchor_blocks)).cast("int"))

    def against_all(asking: DataFrame, of_pair, columns: list[str]) -> DataFrame:
        pairs = asking.withColumn("r", every(row_blocks)).groupBy("a", "r").cogroup(told.groupBy("a", "r"))
        return pairs.applyInArrow(of_pair, ", ".join(f"{c} long" for c in columns))

    candidates = against_all(asking, lambda a, b: _positive_candidates(a, b, dims, positives), _POSITIVE)
    best = _best(candidates, ["slot"], "positive_score", "positive_id", positives)
    found = written(
        best.groupBy("slot", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("found")), "positives"
    )
    banded = asking.join(found.select("slot", F.col("found.positive_score").alias("told")), "slot")
    candidates = against_all(banded, lambda a, b: _negative_candidates(a, b, dims, negatives, low, high), _NEGATIVE)
    hard = _best(candidates, ["slot", "place"], "negative_score", "negative_id", negatives)
    positive = F.get("found", F.col("place").cast("int"))
    return hard.join(found, "slot").select(
        "anchor_id", positive["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        positive["positive_score"].alias("positive_score"), "negative_score",
    )
