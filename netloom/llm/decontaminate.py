"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Words are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. Each distinct word of the benchmark is one symbol; the automaton's patterns are
the windows of 10 consecutive words of every item (a shorter item is one window), as symbol
sequences. A document's words are mapped to symbols, an unknown word to a symbol that no
pattern has, and the automaton scans them once. Matches give word numbers, which the words'
places map back to the original text.

The items come to the driver and go to every worker only below ``MAX_ITEM_CHARS``; a larger
benchmark is cut into shares by item, one automaton and one pass over the documents each,
with a table in between. Documents are never shuffled for the scan.

Defined cases: a null or wordless document has no words and is clean; a null or wordless item
occurs nowhere. Repeated items count once each by ``item_id``; an item without an id marks
words but is not counted. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import add_columns, fields, written

WINDOW = 10
#: Of one automaton's items: about 260 MB and 4 s in every Python worker.
MAX_ITEM_CHARS = 2_000_000
#: For places in the original text, where A-Z are not lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: UTF-8 bytes: A-Z lower-cased, everything between words a space; bytes of non-ASCII characters are above 0x7F.
_WORD_BYTES = bytes(b if b > 0x7F or bytes([b]).isalnum() else 0x20 for b in bytes(range(256)).lower())
#: The first code point given to a word; below it stand unknown words, from the surrogates on it is skipped.
_FIRST, _SURROGATES, _AFTER, _END = 0x100, 0xD800, 0xE000, 0x110000
_UNKNOWN = "\x00"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Automaton:
    """The windows of ``items`` (id, text), and the scan."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set] = {}
        for item_id, text in items:
            coded = "".join(map(self._symbol, words_of(text)))
            for i in range(max(1, len(coded) - WINDOW + 1)) if coded else ():
                windows.setdefault(coded[i : i + WINDOW], set()).add(item_id)
        self.machine = ahocorasick.Automaton()
        for coded, ids in windows.items():
            self.machine.add_word(coded, (len(coded), tuple(ids)))
        if windows:
            self.machine.make_automaton()
        self.empty = not windows

    def _symbol(self, word: bytes) -> str:
        if word not in self.symbols:
            code = _FIRST + len(self.symbols)
            code += (_AFTER - _SURROGATES) * (code >= _SURROGATES)
            if code >= _END:
                raise ValueError("too many distinct words for one automaton; lower MAX_ITEM_CHARS")
            self.symbols[word] = chr(code)
        return self.symbols[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged ranges [first, last + 1) of word numbers that are hit, and the ids of the items."""
        if self.empty or not words:
            return [], set()
        get = self.symbols.get
        coded = "".join([get(w, _UNKNOWN) for w in words])
        found, ids = [], set()
        for end, (length, of) in self.machine.iter(coded):
            found.append((end + 1 - length, end + 1))
            ids.update(of)
        return merged(found), ids - {None}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


_SPAN = pa.list_(pa.list_(pa.int64()))
_FOUND = {"n_words": pa.int64(), "hits": _SPAN, "places": _SPAN, "items": pa.list_(pa.string())}
_SCHEMA = "n_words long, hits array<array<long>>, places array<array<long>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...), ``items`` (item_id, text) -> one row per document.

    Its columns (those of the names below are replaced), n_words, hits (ranges of word numbers), places (the same ranges as character
    offsets of the original text), items (ids as text, sorted).
    """
    items = items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shares = max(1, -(-chars // max_item_chars))
    empty = F.array().cast("array<array<long>>")
    found = docs.drop(*_FOUND).withColumns({"n_words": F.lit(0).cast("long"), "hits": empty, "places": empty, "items": F.array().cast("array<string>")})
    schema = f"{fields(found, _FOUND)}, {_SCHEMA}"
    for share in range(shares):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == share) if shares > 1 else items
        found = found.mapInArrow(_scanner([tuple(r) for r in own.collect()], docs), schema)
        if share + 1 < shares:
            found = written(found, "scanned")
    return found


_BUILT: dict[str, Automaton] = {}


def _scanner(items: list[tuple], docs: DataFrame):
    sent = docs.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def of_batch(batch: pa.RecordBatch) -> list:
        if name not in _BUILT:  # one per worker process, not one per task
            _BUILT.clear()
            _BUILT[name] = Automaton(sent.value)
        scan = _BUILT[name].scan
        counts, hits, places, ids = [], [], [], []
        for text, earlier, known in zip(*(batch.column(n) for n in ("text", "hits", "items")), strict=True):
            text = text.as_py()
            words = words_of(text)
            spans, own = scan(words)
            if len(earlier):
                spans = merged(spans + [tuple(x) for x in earlier.as_py()])
            counts.append(len(words))
            hits.append(spans)
            places.append(_offsets(text, spans) if spans else [])
            ids.append(sorted(own | set(known.as_py())) if own or len(known) else [])
        return [counts, hits, places, ids]

    return add_columns(_FOUND, of_batch, _FOUND)


def _offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges; A-Z lower-casing keeps every character's place."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[first][0], at[last - 1][1]) for first, last in spans]


def digest(found: DataFrame) -> DataFrame:
    """The counts of ``contamination`` and a hash of the items."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """Every window at every place; for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item_id, other in items:
            own = words_of(other)
            size = min(WINDOW, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids.add(str(item_id))
        joined = ",".join(sorted(ids))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out
