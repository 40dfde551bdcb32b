"""Words, shingles and their hashes, for many texts at once in one flat buffer of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WIDE = 0xD6E8FEB86659FD93


def _fold(separators: bytes) -> np.ndarray:
    """256 bytes: A-Z in lower case, separators 0, all others as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words are what stands between white space.
BY_SPACE = _fold(b"\0" + SPACES)
#: Words are runs of ASCII letters and digits and of all bytes outside ASCII.
BY_SIGN = _fold(bytes(x for x in range(128) if not chr(x).isalnum()))


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of the rows within them) of consecutive rows; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end - row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; folded bytes of 0 and the ends of rows separate words."""
    inside = np.concatenate(([0], (folded != 0).view(np.int8), [0]))
    step = np.diff(inside)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of _BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        _powers[:] = []
        for factor in (_BASE, pow(_BASE, -1, 2**64)):
            row = np.full(n, factor, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers[0], _powers[1]


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words: differences of one running polynomial sum."""
    power, inverse = _table(len(folded) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * power[: len(folded)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of so many words within a row; first: each row's first word, and their count."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_WIDE) + words[k : k + n]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return at, mix(total[at])
