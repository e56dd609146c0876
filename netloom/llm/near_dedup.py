"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set is its distinct shingles of ``SHINGLE`` words. The sketch has ``COORDINATES`` bins. In
round i every shingle is hashed to one bin with a value between i and i + 1; a bin keeps its
minimum, and the rounds end once every bin is filled. In the second half of at most
2 * ``COORDINATES`` rounds all shingles go to one bin each, so that every bin fills.
Two sketches agree in a coordinate with the probability of the sets' similarity, and the
number of agreements is concentrated as sharply as for independent samples.

Bands of ``ROWS`` coordinates give the buckets: sets with a similarity of 0.8 share one of 32
bands of 4 with probability 1 - 5e-8. Pairs of a bucket are confirmed on the full sets.

No bucket is expanded into pair rows. Documents of equal word sequences are one class first.
Then, turn by turn, pivots of a bucket (the class that shares most, then 8, 128, all that are
left) are held against its members that are not yet known to be in the pivot's component;
used pivots leave the bucket, and a bucket ends once its members are one component. A group of
copies is merged by its first pivot. From the second turn on a pair must also pass an exact
bound on its common shingles, taken from two bitmaps of 2048 bits inside the join, before it
becomes a row. No pair that could still join two components is left out. What remains costly
are many documents of one bucket of which no two are linked: each two bitmaps are compared.

Defined cases: a document without words or text, or without an id, is linked with nothing and
kept. Rows of equal id and text are one document: all kept or none. Ids need not be unique;
each text counts for itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import add_columns, counted, mixed, written
from netloom.llm.components import star_forest

#: Words of a shingle, unless a caller says otherwise.
SHINGLE = 5
#: Linked if LINK_OF * intersection >= LINK * union.
LINK, LINK_OF = 80, 100
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Pivots of a bucket, turn by turn; None: every member left.
PIVOTS = (1, 8, 128, None)
#: Of the bitmaps that bound what two sets have in common.
BITS = 2048
_BIN_BITS = COORDINATES.bit_length() - 1
_VALUE_BITS = 54
#: Words whose hashes a worker remembers at a time.
_REMEMBERED = 500_000
_GROUP = 256


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at exactly space and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit keys of the shingles."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    if not size:
        return w
    key = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        key = mixed(key + w[i : i + len(key)])
    return np.unique(key)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    filled = np.full((len(sets), COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    flat = filled.reshape(-1)
    for turn in range(2 * COORDINATES):
        h = mixed(keys ^ mixed(np.array([turn + 1], np.uint64)))
        value = (h & np.uint64((1 << _VALUE_BITS) - 1)) | np.uint64(turn << _VALUE_BITS)
        if turn < COORDINATES:
            bins = (h >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        else:
            bins = turn - COORDINATES
        np.minimum.at(flat, owner * COORDINATES + bins, value)
        open_ = (filled == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if turn % 8 == 0 or turn < 4:
            still = open_[owner]
            keys, owner = keys[still], owner[still]
    return filled


def bands_of(filled: np.ndarray) -> np.ndarray:
    """BANDS bucket keys per sketch; the band's number is part of the key."""
    rows = filled.reshape(len(filled), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(ROWS):
        key = mixed(key + rows[:, :, i])
    return key.view(np.int64)


def _sketched(batch: pa.RecordBatch, shingle: int) -> list:
    hashes, digests, sets = _WordHashes(), [], []
    bands: list = [None] * batch.num_rows
    sizes = np.zeros(batch.num_rows, np.int64)
    group: list[int] = []

    def flush() -> None:
        if group:
            for i, row in zip(group, bands_of(sketches(sets)), strict=True):
                bands[i] = row
            group.clear()
            sets.clear()

    for i, text in enumerate(batch.column("text")):
        words = words_of(text.as_py())
        digests.append(hashlib.md5(b" ".join(words)).digest())
        if words:
            sets.append(shingle_set(words, hashes, shingle))
            group.append(i)
            sizes[i] = len(sets[-1])
            if len(group) == _GROUP or sum(map(len, sets)) > 1 << 20:
                flush()
    flush()
    digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [digest[:, 0], digest[:, 1], sizes, bands]


def _with_sets(batch: pa.RecordBatch, shingle: int) -> list:
    hashes, found, bits = _WordHashes(), [], []
    for text in batch.column("text"):
        keys = shingle_set(words_of(text.as_py()), hashes, shingle)
        flags = np.zeros(BITS, np.uint8)
        flags[(keys & np.uint64(BITS - 1)).astype(np.int64)] = 1
        found.append(keys.tobytes())
        bits.append(np.packbits(flags).view(np.int64))
    return [found, bits]


def _confirmed(batches):
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        keep = []
        for i in range(batch.num_rows):
            x = np.frombuffer(a[i].as_buffer(), np.uint64)
            y = np.frombuffer(b[i].as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            keep.append(LINK_OF * common >= LINK * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id, kept, text_key.

    ``text_key`` (xxhash64 of the text) tells rows of one id apart. Tables between the steps
    are written to the shared folder, so the steps run when this is called.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, text_key long, h1 long, h2 long, n_shingles long, bands array<long>"
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "n_shingles": pa.int64(), "bands": pa.list_(pa.int64())}
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    sketched = written(keyed.mapInArrow(add_columns(kinds, partial(_sketched, shingle=shingle), ["text"]), schema), "sketches")

    classes = written(
        sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.*", "n", "bands"),
        "classes",
    )
    forest = _linked(docs, classes, shingle)
    component = classes.join(forest, "node", "left").select("node", "h1", "h2", "doc_id", F.coalesce("root", "node").alias("root"))
    first = component.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = component.join(first, "root").select("h1", "h2", "component_id")
    linkable = F.when(F.col("n_shingles") > 0, F.col("doc_id"))
    return (
        sketched.drop("bands").withColumn("named", linkable)
        .join(named.withColumn("linked", F.lit(True)), ["h1", "h2"], "left")
        .select(
            "doc_id", "n_shingles", F.when(F.col("named").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            (F.col("named").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "text_key",
        )
    )


def _linked(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the classes that are linked with another."""
    every = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = every.join(shared, "bucket")
    central = members.groupBy("node").agg(F.sum("members").alias("weight"))
    members = written(members.select("bucket", "node", "n").join(central, "node"), "members")
    candidates = members.select("node").distinct().join(classes.select("node", "doc_id", "text_key"), "node")
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(candidates, ["doc_id", "text_key"])
    sets = texts.select("node", "text").mapInArrow(
        add_columns({"shingles": pa.binary(), "bits": pa.list_(pa.int64())}, partial(_with_sets, shingle=shingle), ["text"]),
        "node long, shingles binary, bits array<long>",
    )
    sets = written(sets.dropDuplicates(["node"]), "sets")

    forest = docs.sparkSession.createDataFrame([], "node long, root long")
    for turn in range(len(PIVOTS)):
        own = members.join(forest, "node", "left").select("bucket", "node", "n", "weight", F.coalesce("root", "node").alias("root"))
        if turn:
            split = own.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
            own, seen = counted(own.join(split, "bucket").join(sets.select("node", "bits"), "node"), "members")
            if not seen["rows"]:
                break
        else:
            own = own.withColumn("bits", F.lit(None).cast("array<long>"))
        links, seen = counted(_links(own, sets, pivots := _pivots(own, turn), bool(turn)), "links")
        if seen["rows"]:
            forest = star_forest(forest.toDF("a", "b").union(links))
        used = pivots.select("bucket", F.col("pivot").alias("node"))
        members = own.select("bucket", "node", "n", "weight").join(used, ["bucket", "node"], "left_anti")
    return forest


def _pivots(own: DataFrame, turn: int) -> DataFrame:
    """The pivots of each bucket: one for each of PIVOTS[turn] parts of its members, or all."""
    row = F.struct((-F.col("weight")).alias("w"), F.col("node").alias("pivot"), F.col("n").alias("p_n"), F.col("root").alias("p_root"), F.col("bits").alias("p_bits"))
    if PIVOTS[turn] is None:
        return own.select("bucket", row.alias("p")).select("bucket", "p.*").drop("w")
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS[turn])).alias("part")
    return own.groupBy("bucket", part).agg(F.min(row).alias("p")).select("bucket", "p.*").drop("w")


def _links(own: DataFrame, sets: DataFrame, pivots: DataFrame, bounded: bool) -> DataFrame:
    """(a, b) of the pairs of a pivot and a member of another component that are linked."""
    possible = (
        (F.col("node") != F.col("pivot")) & (F.col("root") != F.col("p_root"))
        & (LINK_OF * F.least("n", "p_n") >= LINK * F.greatest("n", "p_n"))
    )
    if bounded:
        only = lambda x, y: F.aggregate(
            F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, c: s + c
        )
        common = F.least(F.col("n") - only("bits", "p_bits"), F.col("p_n") - only("p_bits", "bits"))
        possible &= (LINK + LINK_OF) * common >= LINK * (F.col("n") + F.col("p_n"))
    member, pivot = own.drop("weight"), pivots.withColumnRenamed("bucket", "p_bucket")
    pairs = (
        member.join(pivot, (F.col("bucket") == F.col("p_bucket")) & possible)
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    )
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_confirmed, "a long, b long")
