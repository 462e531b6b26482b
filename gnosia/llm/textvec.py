"""Vectorised reading of UTF-8 text: words, 64-bit hashes of byte spans, sums by document.

All functions work on the bytes of many documents at once, without a Python string for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161), U(9650029242287828579), U(2870177450012600261)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8, offs[-1])[offs[0] :] if data is not None and offs[-1] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length) of each word `[^\\x20\\x09-\\x0D]+`, and the first word of each document and the end."""
    if not buf.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    before = np.empty(buf.size, bool)
    before[0], before[1:] = True, space[:-1]
    inner = offs[:-1][offs[:-1] < buf.size]
    before[inner] = True
    after = np.empty(buf.size, bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends - starts, np.searchsorted(starts, offs)


def joined(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each followed by one space; and where each begins."""
    at = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    move = np.repeat(at - starts, lens)
    src = np.arange(move.size, dtype=np.int64) + np.repeat(starts - (np.cumsum(lens) - lens), lens)
    out[src + move] = buf[src]
    return out, at


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of buf: spans below 32 bytes lane by lane for all at once, others by the library."""
    out = np.empty(starts.size, np.uint64)
    if not starts.size:
        return out
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    lane8 = np.ndarray((data.size - 7,), "<u8", data, strides=(1,))
    lane4 = np.ndarray((data.size - 3,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = lens.astype(np.uint64) + (U(seed) + P5)
        at, left = starts.copy(), np.where(lens < 32, lens, 0)
        for _ in range(3):
            m = np.flatnonzero(left >= 8)
            if not m.size:
                break
            k = _rot(lane8[at[m]] * P2, 31) * P1
            h[m] = _rot(h[m] ^ k, 27) * P1 + P4
            at[m] += 8
            left[m] -= 8
        m = np.flatnonzero(left >= 4)
        if m.size:
            h[m] = _rot(h[m] ^ (lane4[at[m]].astype(np.uint64) * P1), 23) * P2 + P3
            at[m] += 4
            left[m] -= 4
        for _ in range(3):
            m = np.flatnonzero(left > 0)
            if not m.size:
                break
            h[m] = _rot(h[m] ^ (data[at[m]].astype(np.uint64) * P5), 11) * P1
            at[m] += 1
            left[m] -= 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    out[:] = h
    long = np.flatnonzero(lens >= 32)
    if long.size:
        mem = data.tobytes()
        digest = xxhash.xxh64_intdigest
        out[long] = [digest(mem[a:b], seed) for a, b in zip(starts[long].tolist(), (starts[long] + lens[long]).tolist(), strict=True)]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values[ptr[i]:ptr[i+1]] for each i."""
    total = np.zeros(values.size + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def gather(ptr: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ptr[i] .. ptr[i] + lens[i] - 1 for each i, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if ends.size else 0, dtype=np.int64) + np.repeat(ptr - (ends - lens), lens)
