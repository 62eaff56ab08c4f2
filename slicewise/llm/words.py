"""Vectorised word and shingle hashing on raw UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A hash
is 64 bits wide, the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: bytes hashed at once; keeps temporaries within the caches
PIECE = 1 << 18
SHINGLE = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _give_back_large_buffers() -> None:
    """Workers are used again and again: buffers over 16 MB, and what is free at the end of the heap, shall go back
    to the system, not stay in the process."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 25)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


_give_back_large_buffers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROLES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _FACTOR) | np.uint64(1)


@lru_cache
def byte_values(lower: bool = False) -> np.ndarray:
    code = np.arange(256)
    if lower:
        code[65:91] += 32
    return mix((code.astype(np.uint64) + np.uint64(1)) * _FACTOR)


@lru_cache
def _word_bytes() -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[[9, 10, 11, 12, 13, 32]] = False
    return is_word


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(PIECE * 2, 1 << (n - 1).bit_length())
        inverse = pow(int(_FACTOR), -1, 1 << 64)
        for name, base in (("up", int(_FACTOR)), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums c; bytes [i, j) hash to ``(c[j] - c[i]) * down[i]``."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(lower)[data] * powers(len(data))[0], out=c[1:])
    return c


def _piece(data: np.ndarray, lower: bool) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _word_bytes()[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    c = rolling(data, lower)
    return mix((c[end] - c[start]) * powers(len(data) + 1)[1][start])


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text, in order; unchanged words with ``lower`` off."""
    if len(data) <= 2 * PIECE:
        return _piece(data, lower)
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _word_bytes()[data[end]]:  # to the end of a word
            gap = np.flatnonzero(~_word_bytes()[data[end : end + PIECE]])
            end += int(gap[0]) if len(gap) else PIECE
        out.append(_piece(data[at : min(end, len(data))], lower))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted; with fewer words one for them all."""
    n = len(words) - width + 1
    if n <= 0:
        return np.unique(mix((words * _ROLES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))) if len(words) else words
    out = words[:n] * _ROLES[0]
    for i in range(1, width):
        out = out + words[i : n + i] * _ROLES[i]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column without nulls, laid end to end, and where each text ends, from 0 on; uncopied."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a binary or string column without nulls, uncopied."""
    data, ends = flat(column)
    ends = ends.tolist()
    for a, b in zip(ends, ends[1:]):
        yield data[a:b]
