"""Exact SentencePiece ids of texts, each distinct marked word segmented once.

A text's normalised form has a marker for every space. If no piece of the vocabulary holds a
marker after another character, no piece crosses from a word into the markers of the next one,
so a text's ids are those of its chunks (markers and the word behind them) one after another.

1. Documents are cut into chunks in blocks of about ``BLOCK`` characters. A block keeps its
   distinct chunks once, the most frequent first, and per document the places of its chunks in
   that list. This is a table in the shared folder, bucketed by block.
2. The blocks' lists meet by a hash of the chunk: a group of the distinct-chunk table holds all
   occurrences of its chunks in lists, about ``LISTED`` of them, and has the library segment each
   distinct chunk once, whatever number of documents holds it.
3. Each block gets its lists' ids back and its documents are put together by position. The
   bucketed table is read where it lies, so only lists and ids are ever shuffled, never texts or
   places.

A task holds a block: ``BLOCK`` characters, or one document if that is longer. Chunks of a model
whose pieces do cross markers would be wrong, so such a model is refused; so is one whose
normalised chunks don't stay as they are when they are normalised alone.

Defined cases: a null or empty text is the end id alone (or nothing without one) and decodes to
an empty text. Repeated rows and ids are encoded each. A null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import scratch_path

MODEL = "piece_bpe_32k.model"
#: Characters of a block of documents.
BLOCK = 32_000_000
#: Entries of lists in a group of the distinct-chunk table.
LISTED = 250_000
#: Documents decoded at once.
ROWS = 500
MARKER = "▁"


class Segmenter:
    """The library's processor and what the cut at markers asks of its model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{MARKER}]{MARKER}")
        if any(crossing.search(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers")
        self.prefixed = self.library.normalize("a") == f"{MARKER}a"
        if not self.library.normalize("a b").endswith(f"a{MARKER}b"):
            raise ValueError("this model does not mark spaces")
        self.end_id = self.library.eos_id()

    def separated(self, text: str) -> str:
        """A text's chunks with a space between them; its normalised form holds none."""
        # A space in front of every marker, then none between markers.
        apart = self.library.normalize(text).replace(MARKER, f" {MARKER}")
        apart = apart.replace(f"{MARKER} {MARKER}", MARKER * 2).replace(f"{MARKER} {MARKER}", MARKER * 2)
        return apart.removeprefix(" ")

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk, as they are within any text."""
        alone = [c[1:] if self.prefixed else c for c in chunks]
        found = self.library.encode(alone, num_threads=1)
        for i, (chunk, again) in enumerate(zip(chunks, self.library.normalize(alone), strict=True)):
            if chunk == MARKER and not again:  # one marker at a text's end; the library gives an empty text no marker
                found[i] = self.library.encode(f"a{chunk}", num_threads=1)[len(self.library.encode("a", num_threads=1)) :]
            elif again != chunk:
                raise ValueError(f"the chunk {chunk[:80]!r} is not its own normalised form")
        return found


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def segmenter(name: str) -> Segmenter:
    """One per worker process, not one per task."""
    return Segmenter(model_path(name))


def packed(values: Iterable[int] | np.ndarray) -> bytes:
    """32-bit numbers with their first bytes first, then their second bytes, and so on: small numbers compress to little."""
    return np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


#: Rows of documents (``row`` from 0, ``places`` packed) and, with ``row`` -1, of lists (``chunks`` joined by spaces, which no chunk holds).
_BLOCKS = {"block": pa.int64(), "row": pa.int32(), "doc_id": pa.int64(), "size": pa.int64(), "places": pa.binary(), "chunks": pa.string()}
_LISTS = "block long, part int, chunks string"
_IDS = "of long, part int, sizes binary, ids binary"


def blocks(docs: DataFrame, model: str = MODEL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> a row per document with its chunks' places, and one per block with its distinct chunks."""

    def run(batches):
        cut = segmenter(model)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if texts and size + len(text) > block:
                    yield from of_block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(cut.separated(text) or None)
                size += len(text)
        if texts:
            yield from of_block(number, ids, texts)

    def of_block(number: int, ids: list, texts: list[str | None]):
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())
        coded = lists.flatten().dictionary_encode()
        chunks, places = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(places, minlength=len(chunks)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        yield rows_of([(number, -1, None, len(chunks), None, " ".join(chunks.take(pa.array(order)).to_pylist()))])
        parts = np.split(rank[places], ends[:-1])
        for at in range(0, len(ids), 1000):
            yield rows_of([(number, at + i, d, len(p), packed(p), None) for i, (d, p) in enumerate(zip(ids[at : at + 1000], parts[at : at + 1000], strict=True))])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _BLOCKS.values(), strict=True)], list(_BLOCKS))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, row int, doc_id long, size long, places binary, chunks string")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``key``: grouping by it needs no shuffle."""
    spark, name = df.sparkSession, f"netloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "piece-blocks"))
    writer.bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def _parts(chunks: list[str], parts: int) -> list[np.ndarray]:
    """The places of the chunks of each group, ascending."""
    of = np.fromiter((zlib.crc32(c.encode()) for c in chunks), np.uint32, len(chunks)) % np.uint32(parts)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, parts)))


def dealt(lists: DataFrame, parts: int) -> DataFrame:
    """(block, chunks) -> block, part, chunks: a block's list by groups of the distinct-chunk table."""

    def run(batches):
        for batch in batches:
            for block, joined in zip(batch.column("block").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                chunks = joined.split(" ") if joined else []
                rows = [(block, part, " ".join(chunks[i] for i in places)) for part, places in enumerate(_parts(chunks, parts)) if len(places)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["block", "part", "chunks"]).cast(
                        pa.schema({"block": pa.int64(), "part": pa.int32(), "chunks": pa.string()})
                    )

    return lists.select("block", "chunks").mapInArrow(run, _LISTS)


def segmented(lists: DataFrame, model: str = MODEL) -> DataFrame:
    """The ids of every list's chunks; a chunk that many lists hold is segmented once."""

    def of_part(rows: pa.Table) -> pa.Table:
        lists = pc.split_pattern(rows.column("chunks").combine_chunks(), " ")
        coded = lists.flatten().dictionary_encode()
        known = [np.asarray(f, "<u4") for f in segmenter(model).ids(coded.dictionary.to_pylist())]
        sizes, ids = [], []
        for places in np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())[:-1]):
            found = [known[i] for i in places]
            sizes.append(packed([len(f) for f in found]))
            ids.append(packed(np.concatenate(found)))
        return pa.table([rows.column("block"), rows.column("part"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["of", "part", "sizes", "ids"])

    return lists.groupBy("part").applyInArrow(of_part, _IDS)


def encoded(docs: DataFrame, model: str = MODEL, end: bool = True, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(doc_id, text) -> doc_id, ids, decoded: the library's ids of every text and what its decode(ids) gives.

    The blocks are a table of their own, so documents are cut when this is called.
    """
    cut = _bucketed(blocks(docs, model, block), "block")
    lists = cut.where("row = -1")
    parts = max(1, -(-(lists.agg(F.sum("size")).first()[0] or 0) // listed))
    known = segmented(dealt(lists, parts), model)

    def of_block(rows: pa.Table, found: pa.Table) -> pa.Table:
        library, tail = segmenter(model).library, [segmenter(model).end_id] if end else []
        of_rows = rows.column("row").to_numpy()
        joined = rows.column("chunks")[int(np.nonzero(of_rows == -1)[0][0])].as_py()
        places = _parts(joined.split(" ") if joined else [], parts)
        first, size = np.zeros(sum(map(len, places)), np.int64), np.zeros(sum(map(len, places)), np.int64)
        flat, at = [], 0
        for part, sizes, ids in zip(*(found.column(c).to_pylist() for c in ("part", "sizes", "ids")), strict=True):
            sizes = unpacked(sizes).astype(np.int64)
            size[places[part]], first[places[part]] = sizes, at + np.cumsum(sizes) - sizes
            flat.append(unpacked(ids))
            at += len(flat[-1])
        flat = np.concatenate([*flat, np.zeros(0, "<u4")])
        ids, decoded, of_docs = [], [], np.nonzero(of_rows >= 0)[0]
        for row in of_docs:
            own = unpacked(rows.column("places")[int(row)].as_py())
            sizes = size[own]
            ends = np.cumsum(sizes)
            source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[own] - (ends - sizes), sizes)
            ids.append(np.concatenate([flat[source], tail]).astype(np.int32))
        for at in range(0, len(ids), ROWS):
            decoded += library.decode([i.tolist() for i in ids[at : at + ROWS]], num_threads=1)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        return pa.table([rows.column("doc_id").take(pa.array(of_docs)), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return cut.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(of_block, "doc_id long, ids array<int>, decoded string")
