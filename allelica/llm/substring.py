"""Removal of word passages that an earlier document already has (level-wise doubling).

A passage counts as repeated when a run of ``window`` consecutive words of one
document also starts in another.  Comparing all such runs at once would shuffle
one row for each word of the corpus, so lengths grow level by level, and only
what repeats at one length is looked at again at the next:

1. *Anchors*, runs of about half the length.  Of the anchors inside each
   window only the one with the least hash is looked at; equal windows pick
   equal anchors, so a window can repeat only if its anchor does.
2. *Windows* whose anchor occurs in more than one document.
3. On request (:func:`repeat_lengths`), runs of twice the last length whose two
   halves both repeat, again and again until no candidate survives.

Documents are dealt out once, to buckets by a hash of their id; every level
reads the same exchange.  A bucket sends each hash once with the least and
greatest id that has it, whatever the number of its documents that hold the
passage, so a passage in a third of all documents costs each hash bucket one
entry a document bucket.  Blocks of packed numbers travel, not rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import binaries, cut, hash_buckets, id_bucket, input_bytes, pack, partitions, string_array, unpack
from allelica.llm.textblocks import Words, buffers, mix, slices, window_starts, windows

_BLOCK = "to int, src int, n int, h binary, x binary, lo binary, span binary"
_REPLY = "bucket int, n int, h binary, x binary, lo binary, span binary"
_MARKS = 1 << 20
#: Least input of a bucket.
BUCKET_BYTES = 1 << 20
_SALT = np.uint64(0x51ED270B7A3F4A21)


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    out, have, power, level = None, 0, h, 1
    n = len(h) - size + 1
    left = size
    while left:
        if left & 1:
            part = power[have : have + n]
            out = part if out is None else np.minimum(out, part)
            have += level
        left >>= 1
        if left:
            power = np.minimum(power[:-level], power[level:])
            level *= 2
    return out


def _anchors(words: Words, starts: np.ndarray, window: int, base: int) -> np.ndarray:
    """The anchor of each window."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(_least(windows(words.hash, base), window - base + 1)[starts] ^ _SALT)


def _unique(h: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct hash with the least and greatest id, in order of the least id."""
    order = np.argsort(h, kind="stable")
    h, x, ids = h[order], x[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])])) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, x, ids, ids
    lo, hi = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return h[first], x[first], lo, hi


def _blocks(source: int, buckets: int, h: np.ndarray, x: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A bucket's hashes, dealt to hash buckets."""
    h, x, lo, hi = _unique(h, x, ids)
    to = hash_buckets(h, buckets)
    order = np.lexsort((lo, to))
    h, x, lo, hi, to = h[order], x[order], lo[order], hi[order], to[order]
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    rows = [(int(to[a]), source, b - a, h[a:b].tobytes(), x[a:b].tobytes(), pack(lo[a:b]), pack(hi[a:b] - lo[a:b])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    names = ["to", "src", "n", "h", "x", "lo", "span"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)


def _answers(only_later: bool) -> Callable[[pa.Table], pa.Table]:
    """For one hash bucket: tells each document bucket which of its hashes another document has too."""

    def answer(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in binaries(t["h"])])
        x = np.concatenate([np.frombuffer(b, np.uint32) for b in binaries(t["x"])])
        lo = np.concatenate([unpack(b, k) for b, k in zip(binaries(t["lo"]), n.tolist(), strict=True)])
        hi = lo + np.concatenate([unpack(b, k) for b, k in zip(binaries(t["span"]), n.tolist(), strict=True)])
        src = np.repeat(t["src"].to_numpy(), n)
        order = np.argsort(h, kind="stable")
        h, x, lo, hi, src = h[order], x[order], lo[order], hi[order], src[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]))
        size = np.diff(np.append(first, len(h)))
        least, most = np.repeat(np.minimum.reduceat(lo, first), size), np.repeat(np.maximum.reduceat(hi, first), size)
        keep = least < (hi if only_later else most)
        h, x, least, most, src = h[keep], x[keep], least[keep], most[keep], src[keep]
        order = np.lexsort((least, src))
        h, x, least, most, src = h[order], x[order], least[order], most[order], src[order]
        edge = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
        rows = [(int(src[a]), b - a, h[a:b].tobytes(), x[a:b].tobytes(), pack(least[a:b]), pack(most[a:b] - least[a:b])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        names = ["bucket", "n", "h", "x", "lo", "span"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    return answer


class _Known:
    """The hashes that an answer names, with the least id that has each."""

    def __init__(self, t: pa.Table):
        if t.num_rows:
            n = t["n"].to_pylist()
            h = np.concatenate([np.frombuffer(b, np.uint64) for b in binaries(t["h"])])
            x = np.concatenate([np.frombuffer(b, np.uint32) for b in binaries(t["x"])])
            lo = np.concatenate([unpack(b, k) for b, k in zip(binaries(t["lo"]), n, strict=True)])
            order = np.argsort(h)
            self.h, self.x, self.lo = h[order], x[order], lo[order]
        else:
            self.h, self.x, self.lo = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.marks = np.zeros(_MARKS, dtype=bool)
        self.marks[(self.h & np.uint64(_MARKS - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known ones among ``h``, and where each is in the answer."""
        at = np.flatnonzero(self.marks[(h & np.uint64(_MARKS - 1)).astype(np.int64)])
        if not len(at) or not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
        ok = (self.h[k] == h[at]) & (self.x[k] == x[at])
        return at[ok], k[ok]


def _check(h: np.ndarray) -> np.ndarray:
    """Stands in for the 32 check bits of windows: anchors only preselect, and have none."""
    return np.zeros(len(h), np.uint32)


def _window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 independent bits of each run of ``size`` words."""
    h = windows(words.hash, size)
    x = windows(mix(words.hash ^ _SALT), size)
    return h, (x >> np.uint64(32)).astype(np.uint32)


def _inputs(docs: DataFrame, id_col: str, text_col: str, buckets: int, parts: int, carry: list[str]) -> DataFrame:
    more = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    return d.withColumn("bucket", id_bucket(F.col("id"), buckets, F.col("text"))).repartition(parts, "bucket")


def _ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which are not null."""
    known = t["id"].is_valid().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)
    return t["id"].fill_null(0).to_numpy(), known


def _emit_anchors(window: int, base: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def emit(t: pa.Table) -> pa.Table:
        ids, known = _ids(t)
        hs, ds = [], []
        for i, _, data, off in slices(*buffers(t["text"])):
            words = Words(data, off)
            starts, counts = window_starts(words.woff, window)
            a = _anchors(words, starts, window, base)
            doc = np.repeat(np.arange(len(counts)), counts)
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
            new &= known[i + doc]
            hs.append(a[new])
            ds.append(ids[i + doc[new]])
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        d = np.concatenate(ds) if ds else np.zeros(0, np.int64)
        return _blocks(t["bucket"][0].as_py(), buckets, h, _check(h), d)

    return emit


def _emit_windows(window: int, base: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def emit(t: pa.Table, reply: pa.Table) -> pa.Table:
        found = _Known(reply)
        ids, known = _ids(t)
        hs, xs, ds = [], [], []
        for i, _, data, off in slices(*buffers(t["text"])) if len(found.h) else ():
            words = Words(data, off)
            starts, counts = window_starts(words.woff, window)
            a = _anchors(words, starts, window, base)
            doc = np.repeat(np.arange(len(counts)), counts)
            at, _k = found.find(a, _check(a))
            at = at[known[i + doc[at]]]
            if len(at):
                h, x = _window_hashes(words, window)
                hs.append(h[starts[at]])
                xs.append(x[starts[at]])
                ds.append(ids[i + doc[at]])
        if not hs:
            return _blocks(0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return _blocks(t["bucket"][0].as_py(), buckets, np.concatenate(hs), np.concatenate(xs), np.concatenate(ds))

    return emit


def _emit_doubled(size: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Runs of ``2 * size`` words whose halves both repeat."""

    def emit(t: pa.Table, reply: pa.Table) -> pa.Table:
        found = _Known(reply)
        ids, known = _ids(t)
        hs, xs, ds = [], [], []
        for i, _, data, off in slices(*buffers(t["text"])) if len(found.h) else ():
            words = Words(data, off)
            starts, counts = window_starts(words.woff, 2 * size)
            if not len(starts):
                continue
            h, x = _window_hashes(words, size)
            again = np.zeros(len(h), dtype=bool)
            again[found.find(h, x)[0]] = True
            doc = np.repeat(np.arange(len(counts)), counts)
            both = again[starts] & again[starts + size] & known[i + doc]
            h, x = _window_hashes(words, 2 * size)
            hs.append(h[starts[both]])
            xs.append(x[starts[both]])
            ds.append(ids[i + doc[both]])
        if not hs:
            return _blocks(0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return _blocks(t["bucket"][0].as_py(), buckets, np.concatenate(hs), np.concatenate(xs), np.concatenate(ds))

    return emit


def _mark(window: int, carried: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def mark(t: pa.Table, reply: pa.Table) -> pa.Table:
        found = _Known(reply)
        ids, known = _ids(t)
        out = []
        for i, j, data, off in slices(*buffers(t["text"])):
            words = Words(data, off)
            n = len(words.starts)
            gone = np.zeros(n + 1, np.int32)
            starts, counts = window_starts(words.woff, window)
            if len(found.h) and len(starts):
                doc = np.repeat(np.arange(len(counts)), counts)
                h, x = _window_hashes(words, window)
                at, k = found.find(h[starts], x[starts])
                hit = starts[at[(found.lo[k] < ids[i + doc[at]]) & known[i + doc[at]]]]
                gone[hit] += 1
                gone[hit + window] -= 1
            keep = np.cumsum(gone[:n]) == 0
            text, offsets, kept = _join_words(data, words, keep)
            more = [f"c{k}" for k in range(carried)]
            own = [t["id"].slice(i, j - i).combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(words.counts - kept, pa.int64())]
            out.append(pa.table([*own, string_array(text, offsets), *[t[c].slice(i, j - i) for c in more]], names=["id", "n_words", "n_removed", "kept_text", *more]))
        return pa.concat_tables(out)

    return mark


def _join_words(data: np.ndarray, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes, offsets, and the number kept."""
    ndocs = len(words.counts)
    first, last, doc = words.starts[keep], words.ends[keep], words.doc[keep]
    more = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, bool)
    step = np.zeros(len(data) + 2, np.int8)
    step[first] += 1
    step[last + more] -= 1
    inside = np.cumsum(step[: len(data)], dtype=np.int8).astype(bool)
    spaced = data.copy()
    spaced[last[more]] = 0x20
    length = np.bincount(doc, weights=(last - first + more), minlength=ndocs).astype(np.int64) if len(doc) else np.zeros(ndocs, np.int64)
    kept = np.bincount(doc, minlength=ndocs)
    return spaced[inside], np.concatenate([[0], np.cumsum(length)]), kept


def _setup(docs: DataFrame, id_col: str, text_col: str, window: int, carry: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, int, int, int]:
    if window < 2:
        raise ValueError("window must be at least 2 words")
    parts = partitions(docs)
    # smaller buckets would send blocks of a few numbers to each other
    buckets = min(2 * parts, max(8, input_bytes(docs) // BUCKET_BYTES))
    return _inputs(docs, id_col, text_col, buckets, parts, list(carry)), buckets, parts, (window + 1) // 2


def _repeated(dealt: DataFrame, window: int, base: int, buckets: int, parts: int, only_later: bool) -> DataFrame:
    """Answers for windows of ``window`` words."""
    by = lambda df, key: df.repartition(parts, key).groupBy(key)
    anchors = dealt.groupBy("bucket").applyInArrow(_emit_anchors(window, base, buckets), _BLOCK)
    reply = by(anchors, "to").applyInArrow(_answers(False), _REPLY)
    wide = dealt.groupBy("bucket").cogroup(by(reply, "bucket")).applyInArrow(_emit_windows(window, base, buckets), _BLOCK)
    return by(wide, "to").applyInArrow(_answers(only_later), _REPLY)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Windows are judged on the input, not on what is left.  Returns one row for
    each input row: ``id``, ``n_words``, ``n_removed`` and ``kept_text``, the
    kept words joined by one space (empty if none).  Longer levels cannot
    change this (a longer repeat consists of repeated windows), so doubling ends
    at ``window``; :func:`repeat_lengths` goes on.

    Null or empty texts have no words.  Rows with a null id are returned with
    nothing removed, and are nobody's earlier document.  Rows with equal ids
    count as one document: they don't remove from each other.  Columns named in
    ``carry`` are returned too, as ``c0``, ``c1`` and so on, so that they clash
    with nothing; other columns of the input are not read.
    """
    dealt, buckets, parts, base = _setup(docs, id_col, text_col, window, carry)
    later = _repeated(dealt, window, base, buckets, parts, True)
    more = [f"c{k} {dealt.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(carry))]
    return (
        dealt.groupBy("bucket")
        .cogroup(later.repartition(parts, "bucket").groupBy("bucket"))
        .applyInArrow(_mark(window, len(carry)), ", ".join(["id long, n_words long, n_removed long, kept_text string", *more]))
    )


def repeat_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The longest doubled length (``window``, twice that, ...) at which each document shares a run of words with another.

    Doubles until no candidate survives.  Returns ``id`` and ``length`` for the
    documents that share a run of at least ``window`` words; one row for an id.
    """
    dealt, buckets, parts, base = _setup(docs, id_col, text_col, window)
    by = lambda df, key: df.repartition(parts, key).groupBy(key)
    reply, size, out = cut(_repeated(dealt, window, base, buckets, parts, False)), window, None
    while not reply.isEmpty():
        holds = dealt.groupBy("bucket").cogroup(by(reply, "bucket")).applyInArrow(_holders(size), "id long, length int")
        out = holds if out is None else out.unionByName(holds)
        wide = dealt.groupBy("bucket").cogroup(by(reply, "bucket")).applyInArrow(_emit_doubled(size, buckets), _BLOCK)
        reply, size = cut(by(wide, "to").applyInArrow(_answers(False), _REPLY)), 2 * size
    if out is None:
        return docs.sparkSession.createDataFrame([], "id long, length int")
    return out.groupBy("id").agg(F.max("length").alias("length"))


def _holders(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def hold(t: pa.Table, reply: pa.Table) -> pa.Table:
        found = _Known(reply)
        ids, known = _ids(t)
        out = [np.zeros(0, np.int64)]
        for i, _, data, off in slices(*buffers(t["text"])) if len(found.h) else ():
            words = Words(data, off)
            starts, counts = window_starts(words.woff, size)
            if len(starts):
                at, _k = found.find(*(a[starts] for a in _window_hashes(words, size)))
                doc = np.unique(np.repeat(np.arange(len(counts)), counts)[at])
                out.append(ids[i + doc[known[i + doc]]])
        got = np.unique(np.concatenate(out))
        return pa.table([pa.array(got, pa.int64()), pa.array(np.full(len(got), size), pa.int32())], names=["id", "length"])

    return hold

