"""Hashed character n-grams of many texts at once, in numpy.

Texts are joined into one array of code points, at most ``CHUNK`` long: an overlong text is cut
at a space, so memory is bounded and no n-gram inside a word is lost. Every text is preceded
and followed by a space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = 32
#: Multipliers of the character hash (fixed values).
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, owners): the parts' places in ``codes`` and the rows they belong to.

    A part begins at its leading space and ends with one of its own. Rows without text give no part.
    """
    codes, starts, owners, held = [], [], [], 0
    gap = np.array([SPACE], np.uint32)

    def full() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(codes), np.array(starts), np.array(owners)

    for row, value in enumerate(texts):
        text = value.as_py()
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > chunk:
                end = at + chunk
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                end = cut if cut > at else end
            if held and held + end - at > chunk:
                yield full()
                codes, starts, owners, held = [], [], [], 0
            starts.append(held)
            owners.append(row)
            codes += [gap, code_points(text[at:end]), gap]
            held += end - at + 2
            at = end
    if held:
        yield full()


def lowered(codes: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case, with no change of length."""
    upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
    return codes + np.uint32(32) * upper


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether a code point counts as a letter: A-Z, a-z and, roughly, non-ASCII characters that are no punctuation or space."""
    ascii_ = ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90))
    other = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00)) & ~((codes >= 0x3000) & (codes < 0x3040)) & (codes != 0xFEFF) & (codes != 0xFFFD)
    return ascii_ | other | (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA)


def blank(codes: np.ndarray) -> np.ndarray:
    return (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x2028) | (codes == 0x3000)


def hashed(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A key below 2^bits for the n-gram that begins at each place (the last size - 1 places have none)."""
    n = max(0, len(codes) - size + 1)
    key = np.full(n, size * 0x51ED27 + 1, np.uint32)
    for i in range(size):
        key = (key ^ codes[i : i + n]) * _FACTORS[i]
        key ^= key >> np.uint32(15)
    key *= _FACTORS[5]
    return (key >> np.uint32(32 - bits)).astype(np.int32)


def inside_word(gaps: np.ndarray, size: int) -> np.ndarray:
    """Whether the n-gram at each place holds no gap but at its ends, and is not gaps alone."""
    n = max(0, len(gaps) - size + 1)
    if size <= 2:
        whole = ~gaps[:n]
        return whole if size == 1 else whole | ~gaps[1 : n + 1]
    total = np.concatenate([[0], np.cumsum(gaps, dtype=np.int32)])
    return total[size - 1 : size - 1 + n] == total[1 : n + 1]


def sums(values: np.ndarray, starts: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` (place by place, or place by class) per row, parts added up."""
    per_part = np.add.reduceat(values, np.minimum(starts, len(values) - 1), axis=0)
    out = np.zeros((rows, *values.shape[1:]))
    np.add.at(out, owners, per_part)
    return out
