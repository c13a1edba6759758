"""Vectorised word handling over Arrow string columns.

Texts stay in their Arrow buffers: words, word hashes and hashes of word
windows are computed with numpy over a slice of documents at once, so that no
Python string is made per document or per word.

Words are maximal runs of bytes outside ``{0x20, 0x09..0x0D}``.  Null texts
are empty.  A hash of a word of up to eight bytes is a bijection of its bytes
and length; longer words are mixed eight bytes at a time, and words of more
than 64 bytes go through BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer document is one slice).
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Separates runs of letters, digits and bytes beyond ASCII.
NOT_ALNUM = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG_WORD = 64

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_S30, _S27, _S31, _S32 = (np.uint64(k) for k in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection); returns a new array."""
    x = x ^ (x >> _S30)
    x *= _C1
    x ^= x >> _S27
    x *= _C2
    x ^= x >> _S31
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts, in order."""
    return mix(a * _STEP + (b ^ _GOLD))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls being empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents ``(first, last, bytes, offsets)`` of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a run of documents.

    ``starts``/``ends`` are byte positions, ``woff`` the first word of each
    document (one more entry than documents), ``hash`` the words' hashes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        solid = ~between[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            inner = offsets[1:-1]
            before[inner[inner < n]] = False
            after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.woff = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.woff)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.starts, self.ends)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = load[starts] & _MASKS[np.minimum(length, 8)]
    out = mix(out + length.astype(np.uint64) * _GOLD)
    rest, at = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(rest):
        left = length[rest] - at
        out[rest] = combine(out[rest], load[starts[rest] + at] & _MASKS[np.minimum(left, 8)])
        at += 8
        rest = rest[left > 8]
    for i in np.flatnonzero(length > _LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, made by doubling; length ``len(word_hash) - size + 1``.

    Runs that cross documents are included; :func:`window_starts` says which don't.
    """
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, have, power, level = None, 0, word_hash, 1
    left = size
    while left:
        if left & 1:
            part = power[have : have + n]
            done = mix(part + np.uint64(level)) if done is None else combine(done, part)
            have += level
        left >>= 1
        if left:
            power = combine(power[:-level], power[level:])
            level *= 2
    return done


def window_starts(woff: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows within a document, and how many each document has."""
    counts = np.maximum(np.diff(woff) - size + 1, 0)
    total = int(counts.sum())
    first = np.repeat(woff[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(total), counts


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes document by document, and how many each has (repeats included).

    A document with fewer than ``size`` words, but at least one, has its whole
    sequence as its only shingle.
    """
    h = words.hash
    starts, counts = window_starts(words.woff, size)
    win = windows(h, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    total = counts.copy()
    total[short] = 1
    out = np.empty(int(total.sum()), np.uint64)
    at = np.cumsum(total) - total
    is_short = np.zeros(len(total), dtype=bool)
    is_short[short] = True
    full = np.repeat(~is_short, total)
    out[full] = win[starts]
    for d in short:
        acc = np.array([words.counts[d]], np.uint64)
        for k in range(words.woff[d], words.woff[d + 1]):
            acc = combine(acc, h[k : k + 1])
        out[at[d]] = acc[0]
    return out, total


def distinct_sorted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and how many each has."""
    out, n = [], np.zeros(len(counts), np.int64)
    at = 0
    for d, c in enumerate(counts.tolist()):
        if c:
            s = np.sort(values[at : at + c])
            if c > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
            n[d] = len(s)
            at += c
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), n


def reduce_docs(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduce`` over each document's values; ``empty`` for those with none."""
    out = np.full(len(counts), empty, dtype=values.dtype)
    has = counts > 0
    if has.any():
        at = (np.cumsum(counts) - counts)[has]
        out[has] = ufunc.reduceat(values, at)
    return out
