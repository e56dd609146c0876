"""Token sequences of a fixed length, packed by best-fit decreasing.

A document is tokenized and closed by an end id. An overlong document is first cut into full
windows, each a sequence of its own; what is left of every document is packed. Leftovers are
dealt by a hash into groups of about ``GROUP`` (from the table's row count, so a group is
bounded at any size), and each group is packed by itself: longest first, into the open
sequence with the least room that still holds it, which a segment tree indexed by remaining
capacity finds. The leftovers are shuffled once, with their ids; full windows stay where they
are. A group wastes about one sequence in its thousands.

The result holds the ids themselves, one row per piece: the pieces of a sequence_id in the order
of offset are a training sequence. ``digest`` replaces the ids by their checksum.

The ids are those of the ``tokenizers`` file. Its vocabulary, merges and split pattern are
given to a faster encoder of the same algorithm; a text that holds a special token of the file
goes to ``tokenizers`` itself. Tests hold the two against each other.

Defined cases: a null or empty text is the end id alone. Repeated rows and ids are packed
each. A null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

LENGTH = 2048
END_ID = 1
GROUP = 10_000
#: Documents whose ids a worker holds at once.
ROWS = 500
#: What the ByteLevel splitter of the file means (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens", ())]
        plain = (told["pre_tokenizer"] or {}) if told["model"]["type"] == "BPE" and not told["normalizer"] else {}
        if plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not plain.get("add_prefix_space"):
            byte = _byte_characters()
            ranks = {bytes(byte[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            self.fast = None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def encoder(name: str) -> Encoder:
    """One per worker process, not one per task."""
    return Encoder(tokenizer_path(name))


_PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long"
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, start, length, ids, ids_crc32, doc_tokens; all but a document's last piece are full."""

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield of_rows(encode, batch.slice(at, ROWS))

    def of_rows(encode: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts, sizes, parts, sums, totals = [], [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            tokens = np.array([*encode(text.as_py()), end_id], "<u4")
            for start in range(0, len(tokens), length):
                part = tokens[start : start + length]
                ids.append(doc_id.as_py())
                starts.append(start)
                sizes.append(len(part))
                parts.append(part)
                sums.append(zlib.crc32(part.tobytes()))
                totals.append(len(tokens))
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        columns = [pa.array(c, pa.int64()) for c in (ids, starts, sizes, sums, totals)]
        columns.insert(3, pa.ListArray.from_arrays(offsets, pa.array(values)))
        return pa.RecordBatch.from_arrays(columns, _COLUMNS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


class OpenSequences:
    """Sequences by the room they have left: a segment tree over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, sequence: int, room: int) -> None:
        self.by_room[room].append(sequence)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.held[at] += by
            at >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out a sequence with the least room of at least ``size``; None if there is none."""
        at = self.leaves + size
        if not self.held[at]:
            while at > 1 and (at & 1 or not self.held[at + 1]):  # up to the first subtree on the right that holds one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.held[2 * at])
        room = at - self.leaves
        self._count(room, -1)
        return self.by_room[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size; no size is over ``length``."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_, made = OpenSequences(length), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = open_.tightest(size)
        if found is None:
            found, made = (made, length), made + 1
        sequence[i], room = found
        offset[i] = length - room
        if room > size:
            open_.add(int(sequence[i]), room - size)
    return sequence, offset


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, text) -> pieces with their ids, sequence_id and offset.

    A full piece's sequence has an even id, a packed one's an odd id. The pieces are a table in
    the shared folder, so tokenizing runs when this is called.
    """
    groups = max(1, -(-docs.count() // group))
    cut = written(pieces(docs, vocabulary, length, end_id), "pieces")
    whole = cut.where(F.col("length") == length).withColumns(
        {"sequence_id": 2 * F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    part = F.pmod(F.xxhash64(*[c for c in _COLUMNS if c != "ids"]), F.lit(groups)).cast("long")

    def of_group(rows: pa.Table) -> pa.Table:
        keys = [c for c in (*_COLUMNS, "part") if c != "ids"]
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        index = pa.compute.sort_indices(rows.select(keys), sort_keys=order)
        rows = rows.take(index)
        sequence, offset = best_fit_decreasing(rows.column("length").to_numpy(), length)
        number = 2 * ((rows.column("part")[0].as_py() << 32) | sequence) + 1
        return rows.select(_COLUMNS).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    left = cut.where(F.col("length") < length).withColumn("part", part)
    return whole.unionByName(left.groupBy("part").applyInArrow(of_group, f"{_PIECES}, sequence_id long, offset long"))


def digest(pieces: DataFrame) -> DataFrame:
    """Packed pieces without the ids; their checksum stays."""
    return pieces.drop("ids")
