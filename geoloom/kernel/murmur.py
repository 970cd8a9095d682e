"""Murmur3 (x64, 128 bits, seed 0): its first half, as a signed 64-bit number."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_MASK = (1 << 64) - 1
#: Multipliers of the public algorithm; fixed values.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _left(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) & _MASK


def _finish(k: int) -> int:
    k = ((k ^ (k >> 33)) * _F1) & _MASK
    k = ((k ^ (k >> 33)) * _F2) & _MASK
    return k ^ (k >> 33)


def digest(raw: bytes) -> int:
    size = len(raw)
    h1 = h2 = 0
    whole = size - size % 16
    for at in range(0, whole, 16):
        k1 = int.from_bytes(raw[at : at + 8], "little")
        k2 = int.from_bytes(raw[at + 8 : at + 16], "little")
        h1 ^= (_left(k1 * _C1 & _MASK, 31) * _C2) & _MASK
        h1 = ((_left(h1, 27) + h2) * 5 + 0x52DCE729) & _MASK
        h2 ^= (_left(k2 * _C2 & _MASK, 33) * _C1) & _MASK
        h2 = ((_left(h2, 31) + h1) * 5 + 0x38495AB5) & _MASK
    tail = raw[whole:]
    if len(tail) > 8:
        h2 ^= (_left(int.from_bytes(tail[8:], "little") * _C2 & _MASK, 33) * _C1) & _MASK
    if tail:
        h1 ^= (_left(int.from_bytes(tail[:8], "little") * _C1 & _MASK, 31) * _C2) & _MASK
    h1 ^= size
    h2 ^= size
    h1 = (h1 + h2) & _MASK
    h2 = (h2 + h1) & _MASK
    h1 = (_finish(h1) + _finish(h2)) & _MASK
    return h1 - (1 << 64) if h1 >> 63 else h1


def digests(values: Sequence[bytes]) -> np.ndarray:
    """``digest`` of many byte strings at once: the n-th blocks of all that are long enough together."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    if not len(size):
        return np.empty(0, np.int64)
    blocks = size // 16
    # each value takes one more block, of zeros where its tail ends
    start = np.append(0, np.cumsum(blocks + 1))
    room = np.zeros(int(start[-1]) * 16, np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8)
    first = np.cumsum(size) - size
    room[np.repeat(start[:-1] * 16 - first, size) + np.arange(len(flat))] = flat
    words = room.view("<u8").reshape(-1, 2)
    u = np.uint64

    def left(x: np.ndarray, by: int) -> np.ndarray:
        return (x << u(by)) | (x >> u(64 - by))

    def finish(k: np.ndarray) -> np.ndarray:
        k = (k ^ (k >> u(33))) * u(_F1)
        k = (k ^ (k >> u(33))) * u(_F2)
        return k ^ (k >> u(33))

    order = np.argsort(-blocks, kind="stable")
    start, blocks = start[:-1][order], blocks[order]
    h1, h2 = np.zeros(len(size), u), np.zeros(len(size), u)
    with np.errstate(over="ignore"):
        for n in range(int(blocks[0])):
            m = int(np.searchsorted(-blocks, -n, "left"))  # values with a block n
            k1, k2 = words[start[:m] + n].T
            a = h1[:m] ^ (left(k1 * u(_C1), 31) * u(_C2))
            a = (left(a, 27) + h2[:m]) * u(5) + u(0x52DCE729)
            b = h2[:m] ^ (left(k2 * u(_C2), 33) * u(_C1))
            h1[:m], h2[:m] = a, (left(b, 31) + a) * u(5) + u(0x38495AB5)
        k1, k2 = words[start + blocks].T
        length = size[order].astype(u)
        h2 ^= left(k2 * u(_C2), 33) * u(_C1) ^ length
        h1 ^= left(k1 * u(_C1), 31) * u(_C2) ^ length
        h1 = h1 + h2
        h2 = h2 + h1
        h1 = finish(h1) + finish(h2)
    out = np.empty(len(size), np.int64)
    out[order] = h1.view(np.int64)
    return out
