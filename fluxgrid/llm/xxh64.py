"""XXH64 of many slices of one buffer at once; the digests equal those of the public specification."""

from __future__ import annotations

import numpy as np

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _round(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(lane + word * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The digest of data[s:e] for each s and e; data: bytes."""
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", data.data, strides=(1,))
    size, at = ends - starts, starts.astype(np.int64)
    out = np.full(len(at), (seed + int(P5)) % 2**64, np.uint64)

    if len(long := np.flatnonzero(size >= 32)):
        pos, stripes = at[long], size[long] // 32
        lanes = [np.full(len(long), (seed + x) % 2**64, np.uint64) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            for i, lane in enumerate(lanes):
                lane[on] = _round(lane[on], eight[pos[on] + (32 * k + 8 * i)])
        total = sum((_turn(x, n) for x, n in zip(lanes[1:], (7, 12, 18), strict=True)), _turn(lanes[0], 1))
        for lane in lanes:
            total = (total ^ _round(np.zeros_like(lane), lane)) * P1 + P4
        out[long] = total
        at[long] += 32 * stripes
    out += size.astype(np.uint64)
    rest = size % 32
    for k in range(3):
        on = np.flatnonzero(rest >= 8 * (k + 1))
        word = _round(np.uint64(0), eight[at[on] + 8 * k])
        out[on] = _turn(out[on] ^ word, 27) * P1 + P4
    at, rest = at + rest // 8 * 8, rest % 8
    on = np.flatnonzero(rest >= 4)
    out[on] = _turn(out[on] ^ four[at[on]].astype(np.uint64) * P1, 23) * P2 + P3
    at[on] += 4
    rest %= 4
    for k in range(3):
        on = np.flatnonzero(rest > k)
        out[on] = _turn(out[on] ^ data[at[on] + k].astype(np.uint64) * P5, 11) * P1
    out = (out ^ out >> np.uint64(33)) * P2
    out = (out ^ out >> np.uint64(29)) * P3
    return out ^ out >> np.uint64(32)
