"""Vectorised word tables over blocks of texts, shared by the word-based operators.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased first and
all other bytes are kept.  Words are identified by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h * _M1
    h ^= h >> _S32
    h *= _M2
    h ^= h >> _S29
    return h


class Words:
    """The words of a block of texts: ``hashes`` in text order, ``ptr[i]:ptr[i+1]`` those of text i,
    ``starts``/``ends`` their byte ranges in ``buffer`` (lower-cased), ``base[i]`` where text i begins there.
    ``between`` marks the bytes that are in no word."""

    def __init__(self, texts: list[bytes], between: np.ndarray = SPACE):
        self.buffer = buffer = (b"\n".join(texts) + b"\n" + b"\0" * 8).lower()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(buffer, dtype=np.uint8)[:-8]
        space = between[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.ptr = np.searchsorted(self.starts, self.base)
        self.hashes = self._hash(buffer)

    def _hash(self, buffer: bytes) -> np.ndarray:
        windows = np.ndarray((max(len(buffer) - 7, 0),), dtype="<u8", buffer=buffer, strides=(1,))
        length = self.ends - self.starts
        h = mix((windows[self.starts] & _MASKS[np.minimum(length, 8)]) ^ length.astype(np.uint64))
        left = np.flatnonzero(length > 8)
        at = 8
        while len(left):
            part = windows[self.starts[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]
            h[left] = mix(h[left] ^ mix(part + np.uint64(at)))
            at += 8
            left = left[length[left] > at]
        return h

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes of texts; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a column of texts; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def blocks(columns: list, sizes, limit: int = 1 << 20):
    """Ranges of rows whose texts together hold about ``limit`` bytes; one longer text is a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(columns):
        yield begin, len(columns)


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive entries of h."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + np.uint64(k)) ^ h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles.  A text of fewer words (but one at least)
    has its whole word sequence as one shingle; a text without words has none."""
    runs = chain(words.hashes, n)
    out = []
    for a, b in zip(words.ptr[:-1], words.ptr[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix(chain(words.hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(words.hashes[:0])
    return out
