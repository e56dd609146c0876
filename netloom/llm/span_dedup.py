"""Removal of repeated passages: runs of consecutive sentences that occur elsewhere before.

A text is a sequence of words; in scripts without spaces every character is one, and two of
them count as a word of length. It is cut into units after sentences (``.``, ``!``, ``?`` and
their like, or a line's end) that do not end within ``SHORT`` words of another one; and of
``WINDOW`` consecutive words without such an end, after the one with the smallest hash. So
whether a text is cut after a word depends on the ``WINDOW`` words around it only, and
``WINDOW`` words never lack a cut. From each unit on, the shortest run of at least ``RUN``
units and ``MIN_WORDS`` words is hashed to 96 bits (case and white space aside): the words' codes and
places are mixed and added up per unit, the units' hashes mixed in their order. Among the three thousand
million runs of 30 GB two different ones are alike with a probability of less than one in a thousand million;
words have codes of 63 bits, and all of a run's words would have to be alike.

Any 50 words hold a whole run, wherever they stand: cuts are the same ones in both texts from
word WINDOW + 2 to word 50 - WINDOW - 1, the first of them comes within WINDOW words, and the
run ends within RUN * WINDOW (MIN_WORDS - 1 + WINDOW is less): 2 * 8 + 1 + 24 = 41 = 50 - 8 - 1.

Hashes are counted over all documents by partial aggregation, which also finds the first place
(smallest id, then place); all units that a run other than a first one covers are removed. A
text keeps everything else as it was.

A span that a third of all documents share is one pre-aggregated key; the join that follows
can be split. Runs that occur once are mostly left out of both: a bitmap of fixed size, made
from counts of half the hash, knows them; what it lets pass too often is counted exactly.
Texts are shuffled once, and only the numbers of lost units travel to them.

Defined cases: a null or wordless text has no units and stays as it is. A null id comes before
all others. Rows of equal id and text are one document; a run repeated within a document
keeps its first place there. Extra columns stay;
n_units, n_removed and removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import MIX_A, MIX_B, add_columns, fields, mixed, written

RUN, MIN_WORDS = 3, 10
SHORT, WINDOW = 4, 8
#: More than the units of any run, which has no more than MIN_WORDS words, or twice as many characters as words.
LONGEST = 64
WORDS_AT_ONCE = 1 << 16
#: Minima of two, then four, then all words of a window.
_STEPS = (1, 2, 4)
#: Bits of the map of repeated runs (8 MB).
BITS = 1 << 26
#: Characters of scripts without spaces, and the marks that belong to the one before (fixed values).
_ALONE = (
    "\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e4f-\u0e5b\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0ec6\u0ed0-\u0edf\u1000-\u102a\u103f-\u109f\u1780-\u17b3\u17d4-\u17ff"
    "\u3001-\u3098\u309b-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
)
_MARKS = "\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u17b4-\u17d3\u3099\u309a"
_PIECE = re.compile(f"[{_ALONE}][{_MARKS}]*|[^\\s{_ALONE}]+")
_UNSPACED = re.compile(f"[{_ALONE}]")
_ENDS = (".", "!", "?", "\u3002", "\uff01", "\uff1f", "\uff0e", "\uff61", "\u104b", "\u17d4")


#: Part of a word's code that tells whether a sentence ends.
_MARKED = 1 << 31
#: Whether a character splits words, by its number; the last entry stands for all that follow.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])


class _Codes(dict):
    """Words as 32 bits of one hash, ``_MARKED`` if a sentence ends, 31 bits of another; remembers a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        told = word.encode("utf-8", "surrogatepass")
        code = xxhash.xxh32_intdigest(told) << 32 | _MARKED * word.endswith(_ENDS) | xxhash.xxh3_64_intdigest(told) >> 33
        self[word] = code
        return code


_CODES = _Codes()


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, in small letters, and how many of them come before each unit's end."""
    split = _PIECE.findall if _UNSPACED.search(text) else str.split
    lines = [split(line) for line in text.lower().split("\n")]
    n = sum(map(len, lines))
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(lines)), np.uint64, n)
    if not n:
        return codes, np.zeros(0, np.int64)
    marked = codes & np.uint64(_MARKED) != 0
    marked[np.cumsum([len(line) for line in lines if line]) - 1] = True
    ends = np.flatnonzero(marked)
    ends = ends[ends - np.concatenate([[-1], ends[:-1]]) >= SHORT]
    chosen = np.zeros(n, bool)
    chosen[ends] = chosen[-1] = True
    if n >= WINDOW:
        keys = codes >> np.uint64(32) | np.uint64(1)
        keys[ends] = 0
        least = keys << np.uint64(31) | np.arange(n - 1, -1, -1, dtype=np.uint64)  # of equal keys the last one
        for step in _STEPS:
            least = np.minimum(least[:-step], least[step:])
        chosen[n - 1 - (least & np.uint64((1 << 31) - 1)).astype(np.int64)] = True
    return codes, np.flatnonzero(chosen) + 1


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    if _UNSPACED.search(text):
        places = np.array([m.span() for m in _PIECE.finditer(text)], np.int64).reshape(-1, 2)
        return places[:, 0], places[:, 1]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.ones(len(points) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    turns = np.flatnonzero(word[1:] != word[:-1])
    return turns[::2], turns[1::2]


def units(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, words) of each unit; begin and end are places in the text."""
    if not text:
        return
    begins, ends = _places(text)
    begin = 0
    for cut in _cuts(text)[1].tolist():
        words = [text[a:b] for a, b in zip(begins[begin:cut].tolist(), ends[begin:cut].tolist(), strict=True)]
        yield int(begins[begin]), int(ends[cut - 1]), words
        begin = cut


def _unit_hashes(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each unit's words and their order."""
    sizes = np.append(begins[1:], len(codes)) - begins
    rank = np.arange(1, len(codes) + 1) - np.repeat(begins, sizes)
    words = mixed(codes + rank.astype(np.uint64) * MIX_A)
    return np.add.reduceat(words, begins), np.add.reduceat(mixed(words + MIX_B), begins)


def _spans(text: str | None) -> tuple[np.ndarray, ...]:
    """A text's word codes and the first words of its units; the first units of its runs and their numbers of units."""
    codes, cuts = _cuts(text) if text else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n, begins = len(cuts), np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    if n < RUN:
        return codes, begins, begins[:0], begins[:0]
    sizes = np.concatenate([[0], 2 * cuts])  # in half words
    if _UNSPACED.search(text):
        alone = np.cumsum([bool(_UNSPACED.match(text, at)) for at in _places(text)[0].tolist()])
        sizes[1:] -= alone[cuts - 1]
    places = np.arange(n - RUN + 1)
    ends = np.maximum(np.searchsorted(sizes, sizes[:-RUN] + 2 * MIN_WORDS), places + RUN)
    whole = np.searchsorted(ends, n, side="right")
    return codes, begins, places[:whole], (ends - places)[:whole]


def _hashes(codes: np.ndarray, begins: np.ndarray, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and 32 bits of runs of ``counts`` units from the units numbered ``places`` on."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    own = _unit_hashes(codes, begins)
    found = [mixed(u[places]) for u in own]
    for k in range(1, int(counts.max())):
        at = slice(None) if k < RUN else np.flatnonzero(counts > k)
        for h, u in zip(found, own, strict=True):
            h[at] = mixed(h[at] + u[places[at] + k])
    return found[0].view(np.int64), (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _runs(texts: Iterable[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """How many runs each text has, their spans and hashes; texts are hashed together some words at a time."""
    numbers: list[int] = []
    out: list[tuple[np.ndarray, ...]] = []
    some: list[tuple[np.ndarray, ...]] = []
    words = units_before = 0

    def hash_some() -> None:
        codes, begins, places, counts, spans = (np.concatenate(x) for x in zip(*some, strict=True))
        out.append((spans, *_hashes(codes, begins, places, counts)))

    for text in texts:
        codes, begins, places, counts = _spans(text)
        numbers.append(len(places))
        some.append((codes, begins + words, places + units_before, counts, places * LONGEST + counts))
        words, units_before = words + len(codes), units_before + len(begins)
        if words >= WORDS_AT_ONCE:
            hash_some()
            some, words, units_before = [], 0, 0
    if some:
        hash_some()
    if not out:
        return numbers, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return numbers, *(np.concatenate(x) for x in zip(*out, strict=True))


def run_hashes(text: str | None) -> list[tuple[int, int, int, int]]:
    """(first unit, h1, h2, offset) of every run; one of more than ``RUN`` units is given in parts of ``RUN`` that cover it."""
    found = []
    for span, h1, h2 in zip(*[x.tolist() for x in _runs([text])[1:]], strict=True):
        place, count = divmod(span, LONGEST)
        found += [(place + at, h1, h2, at) for at in [*range(0, count - RUN, RUN), count - RUN]]
    return found


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, span, h1, h2 of every run of every text; a span is first unit * ``LONGEST`` + number of units."""
    kinds = {"span": pa.list_(pa.int64()), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int32())}

    def of_batch(batch: pa.RecordBatch) -> list:
        numbers, *found = _runs(t.as_py() for t in batch.column("text"))
        offsets = pa.array(np.cumsum([0, *numbers]), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in found]

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").where("text IS NOT NULL")
    listed = keyed.mapInArrow(
        add_columns(kinds, of_batch, ["text"]), "doc_id long, text_key long, span array<long>, h1 array<long>, h2 array<int>"
    )
    return listed.select("doc_id", "text_key", F.explode(F.arrays_zip("span", "h1", "h2")).alias("r")).select("doc_id", "text_key", "r.*")


def cut_out(text: str, lost: set[int], cuts: np.ndarray | None = None) -> str:
    """``text`` without the units numbered in ``lost``; a line of which nothing is left goes too. ``cuts`` are its cuts, if known."""
    cuts = _cuts(text)[1] if cuts is None else cuts
    at = np.array(sorted(i for i in lost if i < len(cuts)), np.int64)
    begins, ends = _places(text)
    gone = list(zip(begins[np.concatenate([[0], cuts])[at]].tolist(), ends[cuts[at] - 1].tolist(), strict=True)) if len(at) else []
    lines, at, nth = [], 0, 0
    for line in text.split("\n"):
        parts, begin, end = [], at, at + len(line)
        touched = False
        while nth < len(gone) and gone[nth][0] < max(end, at + 1):
            touched = True
            parts.append(text[begin : max(begin, gone[nth][0])])
            begin = min(gone[nth][1], end)
            if gone[nth][1] > end:  # it goes on in the next line
                break
            nth += 1
        rest = text[begin:end]
        if not touched:
            lines.append(line)
        elif left := [x for x in (p.strip(" \t\r") for p in [*parts, rest]) if x]:
            lines.append(" ".join(left))
        at = end + 1
    return "\n".join(lines)


def maybe_repeated(every: DataFrame) -> DataFrame:
    """The rows of ``every`` but for most whose h1 occurs once; a repeated one is never left out."""
    place = F.pmod("h1", F.lit(BITS))
    repeated = every.groupBy("h1").count().where("count > 1").select((place / 8).cast("int").alias("byte"), F.expr("shiftleft(1, int(h1 & 7))").alias("bit"))
    told = repeated.groupBy("byte").agg(F.bit_or("bit").cast("short").alias("bits")).toArrow()  # BITS / 8 rows at most
    bitmap = np.zeros(BITS // 8, np.uint8)
    bitmap[told.column("byte").to_numpy()] = told.column("bits").to_numpy().astype(np.uint8)
    sent = every.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h1").to_numpy() & (BITS - 1)
            yield batch.filter(pa.array((sent.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))

    return every.mapInArrow(run, every.schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with cleaned text, n_units, n_removed and removed (ranges of units); other columns stay."""
    every = maybe_repeated(written(runs(docs), "runs"))
    place = F.struct("doc_id", "text_key", "span")
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    lost = (
        every.join(first, ["h1", "h2"]).where(place != F.col("first"))
        .groupBy(F.col("doc_id").alias("_lost_id"), F.col("text_key").alias("_lost_key")).agg(F.collect_set("span").alias("_lost"))
    )
    joined = docs.join(
        lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_lost_id")) & (F.xxhash64("text") == F.col("_lost_key")), "left"
    ).drop("_lost_id", "_lost_key")

    def of_batch(batch: pa.RecordBatch) -> list:
        texts, counts, gone = [], [], []
        for text, starts in zip(batch.column("text"), batch.column("_lost"), strict=True):
            text, starts = text.as_py(), sorted(starts.as_py() or [])
            ranges: list[list[int]] = []
            for begin, count in (divmod(s, LONGEST) for s in starts):
                if ranges and begin <= ranges[-1][1]:
                    ranges[-1][1] = begin + count
                else:
                    ranges.append([begin, begin + count])
            cuts = _cuts(text)[1] if text else ()
            counts.append(len(cuts))
            gone.append(ranges)
            texts.append(cut_out(text, {i for a, b in ranges for i in range(a, b)}, cuts) if ranges else text)
        return [texts, counts, [sum(b - a for a, b in r) for r in gone], gone]

    others = [c for c in docs.columns if c not in ("text", "n_units", "n_removed", "removed")]
    kinds = {"text": pa.string(), "n_units": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.list_(pa.int64()))}
    rows = joined.select(*others, "text", "_lost")
    schema = f"{fields(rows, ['text', '_lost'])}, text string, n_units long, n_removed long, removed array<array<long>>"
    return rows.mapInArrow(add_columns(kinds, of_batch, ["text", "_lost"]), schema)
