import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm.packing import END_ID, LENGTH, best_fit_decreasing, encoder, packed


def naive(sizes, length):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting)[1]] -= size
        else:
            rooms.append(length - size)
    return sorted(rooms)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_the_naive_one(sizes):
    sequence, offset = best_fit_decreasing(np.array(sizes), 64)
    used = defaultdict(list)
    for s, o, size in zip(sequence, offset, sizes, strict=True):
        used[s].append((o, size))
    for parts in used.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 64
    assert sorted(64 - sum(z for _, z in p) for p in used.values()) == naive(sizes, 64)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_fast_encoder_gives_the_same_ids(text):
    encode = encoder("byte_bpe_50k.json")
    assert encode.fast is not None
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_special_token_text_goes_to_the_exact_encoder():
    assert 50256 in encoder("byte_bpe_50k.json")("a <|endoftext|> b")


def test_round_trip(edge):
    encode = encoder("byte_bpe_50k.json").exact
    expected = defaultdict(int)
    for r in edge.collect():
        ids = np.array([*(encode.encode(r.text, add_special_tokens=False).ids if r.text else []), END_ID], "<u4")
        for start in range(0, len(ids), LENGTH):
            part = ids[start : start + LENGTH]
            expected[r.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    for group in (10_000, 4):
        rows = packed(edge, group=group).collect()
        got = defaultdict(int)
        sequences = defaultdict(list)
        for r in rows:
            got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
            sequences[r.sequence_id].append((r.offset, r.length))
        assert got == expected
        for parts in sequences.values():
            ends = [0]
            for offset, length in sorted(parts):
                assert offset == ends[-1]
                ends.append(offset + length)
            assert ends[-1] <= LENGTH


def test_empty_table(nothing):
    assert packed(nothing).count() == 0


def test_sequences_hold_every_id(edge):
    encode = encoder("byte_bpe_50k.json").exact
    docs = defaultdict(list)
    for r in packed(edge).orderBy("sequence_id", "offset").collect():
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        docs[r.doc_id].append((r.start, r.ids))
    for r in edge.where("text IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        if sum(start == 0 for start, _ in docs[r.doc_id]) == 1:
            assert [i for _, ids in sorted(docs[r.doc_id]) for i in ids] == [*encode.encode(r.text, add_special_tokens=False).ids, END_ID]
    assert any(docs.values())
