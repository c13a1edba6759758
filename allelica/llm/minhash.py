"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document's set of word shingles gets a signature of ``COORDINATES``
minimum hashes.  Documents with equal sets are one class (they are linked
without comparing); each class is posted under the pairs (coordinate, value) of
its signature's prefix.  Two signatures that agree in at least ``MATCHES`` of K
coordinates agree in one of the first ``K - MATCHES + 1``, so the rest needs no
postings (prefix), and a pair is counted only under the first coordinate that
it shares (skip).  Pairs that agree often enough are only candidates: their
components are compared on the full sets of shingles, and what reaches the
threshold is linked.

At similarity 0.8 a pair agrees in fewer than 12 of 32 coordinates with
probability 2.3e-8.

No task holds more than a bounded block of a posting list or of a candidate
component; larger ones are compared block by block, and tasks return spanning
forests, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import cut, partitions
from allelica.llm.graph import Forest, block_tasks, by_task, components, join_classes, whole_groups
from allelica.llm.textblocks import Words, buffers, distinct_sorted, mix, reduce_docs, seeds, shingles, slices

COORDINATES = 32
MATCHES = 12
_MULTIPLY = seeds(COORDINATES, 20)
_LEFT, _RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Rows of a posting list, and rows and bytes of text of a candidate component, in one block.
POSTING_BLOCK, GROUP_BLOCK, GROUP_BYTES = 2048, 1024, 12 << 20
_SMALL = 16


def _sign(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(*buffers(batch["text"])):
                values, n = distinct_sorted(*shingles(Words(data, off, lower=True), size))
                left = reduce_docs(np.add, mix(values ^ _LEFT), n, 0).view(np.int64)
                right = reduce_docs(np.add, mix(values ^ _RIGHT), n, 0).view(np.int64)
                sig = np.empty((j - i, COORDINATES), np.int32)
                for k, m in enumerate(_MULTIPLY):
                    sig[:, k] = (reduce_docs(np.minimum, values * m, n, 0) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                signature = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * COORDINATES, sig.ravel())
                yield pa.record_batch([batch["id"].slice(i, j - i), pa.array(n), pa.array(left), pa.array(right), signature], names=["id", "n", "left", "right", "sig"])

    return sign


def _agree(p: np.ndarray, q: np.ndarray, at: np.ndarray, matches: int) -> np.ndarray:
    """Which pairs of signatures agree often enough, and first in coordinate ``at``."""
    same = p == q
    return (np.count_nonzero(same, axis=-1) >= matches) & (same.argmax(axis=-1) == at)


def _collide(matches: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of each posting list, as a spanning forest."""

    def collide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["key", "a", "b"], 20_000):
            ids, own = t["id"].to_numpy(), t["own"].to_numpy()
            sig = t["sig"].combine_chunks()
            sig = sig.values.to_numpy()[sig.offsets[0].as_py() :][: len(ids) * COORDINATES].reshape(-1, COORDINATES)
            at, cross = t["key"].to_numpy() >> 32, t["a"].to_numpy() != t["b"].to_numpy()
            size = np.diff(edges)
            out = []
            for s in np.unique(size[(size > 1) & (size <= _SMALL)]).tolist():
                i, j = np.triu_indices(s, 1)
                base = edges[:-1][size == s][:, None]
                p, q = (base + i).ravel(), (base + j).ravel()
                ok = (own[p] != own[q]) | ~cross[p]
                p, q = p[ok], q[ok]
                for k in range(0, len(p), 50_000):
                    x, y = p[k : k + 50_000], q[k : k + 50_000]
                    hit = _agree(sig[x], sig[y], at[x], matches)
                    out.append((ids[x[hit]], ids[y[hit]]))
            for g in np.flatnonzero(size > _SMALL).tolist():
                lo, hi = edges[g], edges[g + 1]
                s, mine, c = sig[lo:hi], own[lo:hi], int(at[lo])
                forest = Forest(hi - lo)
                step = max(1, (1 << 18) // len(s))
                for k in range(0, len(s), step):
                    same = s[k : k + step, None, c] == s[None, :, c]  # all, but for block tasks' sake
                    for m in range(c):
                        same &= s[k : k + step, None, m] != s[None, :, m]
                    if cross[lo]:
                        same &= mine[k : k + step, None] != mine[None, :]
                    x, y = np.nonzero(same)
                    new = (x + k < y) & (forest.label[x + k] != forest.label[y])
                    x, y = x[new] + k, y[new]
                    for v in range(0, len(x), 50_000):
                        u, w = x[v : v + 50_000], y[v : v + 50_000]
                        hit = np.count_nonzero(s[u] == s[w], axis=1) >= matches
                        forest.join(u[hit], w[hit])
                out.append(forest.edges(ids[lo:hi]))
            yield _edge_batch(out)

    return collide


def _edge_batch(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.record_batch([pa.array(np.concatenate([none, *(x[k] for x in out)])) for k in (0, 1)], names=["a", "b"])


def _confirm(size: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within candidate components, by their full sets, as a spanning forest."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["grp", "a", "b"], 2_000):
            ids, own = t["id"].to_numpy(), t["own"].to_numpy()
            cross = t["a"].to_numpy() != t["b"].to_numpy()
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                values, counts = [], []
                for _, _, data, off in slices(*buffers(t["text"].slice(lo, hi - lo))):
                    v, n = distinct_sorted(*shingles(Words(data, off, lower=True), size))
                    values.append(v)
                    counts.append(n)
                forest = _linked(np.concatenate(values), np.concatenate(counts), own[lo:hi] if cross[lo] else None, percent)
                out.append(forest.edges(ids[lo:hi]))
            yield _edge_batch(out)

    return confirm


def _linked(values: np.ndarray, n: np.ndarray, own: np.ndarray | None, percent: int) -> Forest:
    """Links ``100 * intersection >= percent * union`` among sorted sets laid end to end; if ``own``, only across blocks."""
    rows, off = len(n), np.concatenate([[0], np.cumsum(n)])
    forest = Forest(rows)
    if rows <= _SMALL:
        for i in range(rows):
            for j in range(i + 1, rows):
                if forest.label[i] == forest.label[j] or (own is not None and own[i] == own[j]):
                    continue
                if 100 * min(n[i], n[j]) < percent * max(n[i], n[j]):
                    continue
                x, y = values[off[i] : off[i + 1]], values[off[j] : off[j + 1]]
                k = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(k, len(x) - 1)] == y))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    forest.join(np.array([i]), np.array([j]))
        return forest
    word, doc = np.unique(values, return_inverse=True)[1], np.repeat(np.arange(rows), n)
    df = np.bincount(word)
    new = np.cumsum(df > 1) - 1
    shared = df[word] > 1
    word, doc = new[word[shared]], doc[shared]
    order = np.argsort(word, kind="stable")
    word, doc = word[order], doc[order]
    both = np.zeros((rows, rows), np.float32)
    width = 2048
    for c in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        lo, hi = np.searchsorted(word, [c, c + width])
        x = np.zeros((rows, width), np.float32)
        x[doc[lo:hi], word[lo:hi] - c] = 1
        both += x @ x.T
    for i in range(0, rows, 128):
        inter = both[i : i + 128].astype(np.int64)
        ok = 100 * inter >= percent * (n[i : i + 128, None] + n[None, :] - inter)
        if own is not None:
            ok &= own[i : i + 128, None] != own[None, :]
        x, y = np.nonzero(ok)
        forest.join(x + i, y)
    return forest


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, matches: int = MATCHES
) -> DataFrame:
    """Groups documents linked by word shingles of Jaccard similarity of at least ``percent`` percent.

    Returns one row for each input row: ``id``, ``n_shingles`` (size of its set
    of distinct ``shingle``-word sequences, A-Z lower-cased; with fewer words
    the whole sequence is its only one), ``component_id`` (the smallest id
    reachable by links, itself included) and ``kept`` (``id = component_id``).

    Null texts and texts without words have an empty set, are linked with
    nothing and are kept.  Rows with a null id are linked with nothing, have a
    null component and are kept.  Rows with equal ids count as one document in
    links; each is returned.  Whole texts count, however long.  An empty table
    gives no rows.  Other columns of the input are not read.
    """
    parts = partitions(docs)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(d.mapInArrow(_sign(shingle), "id long, n long, left long, right long, sig array<int>"))
    real = signed.where("n > 0 and id is not null")
    classes = cut(real.groupBy("left", "right", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig")))

    posted = classes.select("id", F.posexplode(F.slice("sig", 1, COORDINATES - matches + 1)).alias("at", "value"))
    key = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    lists = block_tasks(posted.select("id", key.alias("key")), "key", "id", POSTING_BLOCK)
    pairs = by_task(lists.join(classes.select("id", "sig"), "id"), parts, "key").mapInArrow(_collide(matches), "a long, b long")
    group = components(pairs)

    texts = classes.select("id").distinct().join(group.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    # rows that repeat an id and its text would only meet themselves
    texts = texts.join(d, "id").groupBy("id", "grp", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    found = block_tasks(texts, "grp", "id", GROUP_BLOCK, F.octet_length("text"), GROUP_BYTES)
    links = by_task(found, parts, "grp").mapInArrow(_confirm(shingle, percent), "a long, b long")
    linked = components(links)

    named = classes.select("left", "right", "n", "copies", F.col("id").alias("node")).join(linked, "node", "left")
    named = named.select("left", "right", "n", "copies", F.coalesce("component", "node").alias("component_id"))
    out = join_classes(real.select("left", "right", "n", "id"), named, ["left", "right", "n"], ["component_id"]).select("id", "n", "component_id")
    rest = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(rest).select("id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    )
