"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction of a product code: the vector is rotated at random and
cut into equal blocks, and a direction is one code word for each block.  A vector
falls into the filters whose directions it exceeds its threshold on; the
threshold is its own, so that each vector has the same number of filters.  List
decoding finds them from the blocks' best code words, without looking at the rest
of the code.  Codes grow with the vectors of a label, in words and then in blocks,
so that the number of vectors that share a filter by chance does not.

Vectors meet in two steps.  First short rows meet within (label, filter): a sketch
of 128 signs and the filters that come before this one.  Only where two sketches
are close, and under the first filter that both share, whole vectors meet and are
verified by their cosine in double precision.  Equal vectors with equal labels are
one class and are not compared.  Larger groups are compared block by block; tasks
return numbers of links and spanning forests, not pairs.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import cut, partitions, small
from allelica.llm.graph import Forest, blocks_of, components, join_classes, whole_groups
from allelica.llm.textblocks import mix

#: Vectors that are aimed to share a filter by chance, and code words of a block, at most: beyond them there is a block more.
SHARE, WORDS = 8, 512
#: Caps of a fine code are narrower than near pairs are apart if vectors are short: below ``FINE`` numbers
#: codes stay small, and below ``SHORT`` all vectors of a label are compared.
FINE, SHORT = 16, 8
BLOCK_ROWS = 1024
#: Signs of a sketch; a near pair's differ in ``spread`` standard deviations more than expected at most.
SIGNS, SPREAD = 128, 6.0
#: Codes that a worker keeps.
_CODES = 8
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def filters_of(blocks: int) -> int:
    """Filters that each vector falls into; directions of more blocks are less sharp, and take more."""
    return max(10, 8 * (blocks - 1))


def code_size(dim: int, n: int) -> tuple[int, int]:
    """Blocks of a code for ``n`` vectors of ``dim`` numbers, and words of each block."""
    blocks = 2
    while dim >= FINE and 8 * (blocks + 1) <= dim and (n * filters_of(blocks) / SHARE) ** (1 / blocks) > WORDS:
        blocks += 1
    words = math.ceil((n * filters_of(blocks) / SHARE) ** (1 / blocks))
    return blocks, max(16, words if dim >= FINE else min(words, 42))


class Code:
    """A random product code for vectors of ``dim`` numbers, ``n`` of one label."""

    def __init__(self, dim: int, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = dim
        self.signs = rng.standard_normal((dim, SIGNS)).astype(np.float32)
        self.one = dim < SHORT
        if self.one:
            return
        self.blocks, self.words = code_size(dim, n)
        self.take = filters_of(self.blocks)
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.turn = (q * np.sign(np.diag(r))).astype(np.float32)
        edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.parts = []
        for a, b in zip(edges[:-1], edges[1:]):
            c = rng.standard_normal((self.words, b - a))
            self.parts.append((a, b, (c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dim)).astype(np.float32)))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Each vector's filters, one row a vector; ``x`` holds unit vectors.

        The best sums of two descending lists lie at places (i, j) with
        (i + 1) * (j + 1) of ``take`` at most, so blocks join one after the other.
        """
        if self.one:
            # a single number: vectors of one sign are parallel
            return (x[:, :1] > 0).astype(np.int64) if self.dim == 1 else np.zeros((len(x), 1), np.int64)
        y, total, name = x @ self.turn, None, None
        for a, b, c in self.parts:
            s = y[:, a:b] @ c.T
            k = min(self.take, self.words)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(s, best, 1)
            order = np.argsort(-s, axis=1, kind="stable")
            s, best = np.take_along_axis(s, order, 1), np.take_along_axis(best, order, 1)
            if total is None:
                total, name = s, best.astype(np.int64)
                continue
            i, j = (at.ravel() for at in np.indices((total.shape[1], k)))
            ok = (i + 1) * (j + 1) <= self.take
            s, best = total[:, i[ok]] + s[:, j[ok]], name[:, i[ok]] * self.words + best[:, j[ok]]
            order = np.argsort(-s, axis=1, kind="stable")[:, : self.take]
            total, name = np.take_along_axis(s, order, 1), np.take_along_axis(best, order, 1)
        return name

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """128 signs of each vector, as two integers."""
        return np.packbits(x @ self.signs > 0, axis=1).view(np.int64).reshape(-1, 2)


def sketch_limit(cosine: float) -> int:
    """Signs that the sketches of vectors of this cosine differ in, at most."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + SPREAD * math.sqrt(SIGNS * p * (1 - p)))


def _units(vec: pa.Array, dim: int) -> np.ndarray:
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's sketch and keys, the hashes of its label's filters in ascending order."""
    codes: OrderedDict[tuple[int, int], Code] = OrderedDict()
    for batch in batches:
        dims, ns = batch["dim"].to_numpy(), batch["n"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (ns[1:] != ns[:-1]), [True]])) if len(dims) else [0]
        for lo, hi in zip(edge[:-1], edge[1:]):
            of = int(dims[lo]), int(ns[lo])
            if of not in codes:
                codes[of] = Code(*of)
                if len(codes) > _CODES:
                    codes.popitem(last=False)
            codes.move_to_end(of)
            for i in range(lo, hi, 1024):
                part = batch.slice(i, min(1024, hi - i))
                x = _units(part["vec"], of[0]).astype(np.float32)
                names, signs = codes[of].decode(x), codes[of].sketch(x)
                keys = mix(part["lh"].to_numpy().astype(np.uint64)[:, None] + names.astype(np.uint64) * _GOLD).view(np.int64)
                keys.sort(axis=1)
                off = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(off, pa.array(keys.ravel()))
                yield pa.record_batch([*(part[c] for c in ("k1", "k2", "id", "lh")), pa.array(signs[:, 0]), pa.array(signs[:, 1]), lists], names=["k1", "k2", "id", "lh", "s1", "s2", "keys"])


def _before(t: pa.Table) -> np.ndarray:
    """The filters before a row's own, one row each; gaps hold numbers that no other row has."""
    lists = t["before"].combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.repeat(-1 - np.arange(len(n), dtype=np.int64)[:, None], max(1, int(n.max(initial=0))), axis=1)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy().view(np.uint32)
    return out


def _first(before: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of rows share no filter before this one."""
    out = np.ones(len(p), dtype=bool)
    for k in range(0, len(p), 1 << 14):
        x, y = before[p[k : k + (1 << 14)]], before[q[k : k + (1 << 14)]]
        for c in range(x.shape[1]):
            out[k : k + (1 << 14)] &= ~(x[:, c : c + 1] == y).any(1)
    return out


def _meet(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The (key, node) rows that have a partner with a close sketch, under the first filter that both share."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["key", "a", "b"], 16_384):
            sign = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], axis=1).view(np.uint64)
            cross, own, before = t["a"].to_numpy() != t["b"].to_numpy(), t["own"].to_numpy(), _before(t)
            size, has = np.diff(edges), np.zeros(t.num_rows, dtype=bool)

            def close(p: np.ndarray, q: np.ndarray) -> None:
                near = np.bitwise_count(sign[p] ^ sign[q]).sum(1, dtype=np.int64) <= limit
                p, q = p[near], q[near]
                ok = _first(before, p, q) & ((own[p] != own[q]) | ~cross[p])
                has[p[ok]] = has[q[ok]] = True

            for s in np.unique(size[(size > 1) & (size <= 64)]).tolist():
                i, j = np.triu_indices(s, 1)
                base = edges[:-1][size == s]
                step = max(1, (1 << 18) // len(i))
                for k in range(0, len(base), step):
                    b = base[k : k + step, None]
                    close((b + i).ravel(), (b + j).ravel())
            for g in np.flatnonzero(size > 64).tolist():
                lo, hi = int(edges[g]), int(edges[g + 1])
                for k in range(lo, hi, 128):
                    p = np.arange(k, min(k + 128, hi))
                    i, j = np.nonzero(p[:, None] < np.arange(lo, hi)[None, :])
                    close(p[i], lo + j)
            yield pa.record_batch([t[c].combine_chunks().filter(pa.array(has)) for c in ("key", "node")], names=["key", "node"])

    return meet


def _verify(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers of links (``links`` above 0) of classes, and forests' edges (0) between ids."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["key", "lh", "a", "b"], 2048):
            k1, k2, ids, copies, own = (t[c].to_numpy() for c in ("k1", "k2", "id", "copies", "own"))
            cross, before, vec = t["a"].to_numpy() != t["b"].to_numpy(), _before(t), t["vec"].combine_chunks()
            rows: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = vec.slice(lo, hi - lo)
                x, forest, number = _units(part, len(part[0])), Forest(hi - lo), np.zeros(hi - lo, np.int64)
                for k in range(0, hi - lo, 512):
                    i, j = np.nonzero(x[k : k + 512] @ x.T >= least)
                    i += k
                    ok = i < j
                    if cross[lo]:
                        ok &= own[lo + i] != own[lo + j]
                    i, j = i[ok], j[ok]
                    mine = _first(before, lo + i, lo + j)
                    i, j = i[mine], j[mine]
                    np.add.at(number, i, copies[lo + j])
                    np.add.at(number, j, copies[lo + i])
                    forest.join(i, j)
                has = lo + np.flatnonzero(number)
                p, q = forest.edges(ids[lo:hi])
                rows.append((k1[has], k2[has], number[has - lo], np.zeros(len(has), np.int64)))
                rows.append((p, q, np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)))
            cols = [np.concatenate([np.zeros(0, np.int64), *(r[c] for r in rows)]) for c in range(3)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["one", "two", "links"])

    return verify


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """Links vectors with equal labels whose cosine is at least ``cosine``.

    Returns one row for each input row: ``id``, ``n_links`` (other rows linked
    directly), ``component_id`` (the smallest id reachable by links, itself
    included) and ``kept`` (``id = component_id``).  No pair below the
    threshold is linked; a pair above it is missed if it shares no filter
    (the tests measure the share that is found).

    Null and zero vectors, vectors with null, infinite or not-a-number
    components, and rows with a null label link with nothing.  Vectors of
    different lengths link with nothing but their own kind; any number of lengths
    may occur.  Rows with a null id have no links, a null component, and are kept.
    Rows that repeat a vector and its label link with each other.  Rows with one id
    and different vectors are counted each, and are one node of components.  An
    empty table gives no rows.  Other columns are not read.
    """
    parts = partitions(vectors)
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda c: c != 0), F.lit(False))
    # the class of a vector: its label and all its components; the hash of a label and a length
    v = v.withColumns({"ok": usable, "k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit(7), "vec", "label"), "dim": F.size("vec"), "lh": F.xxhash64("label", F.size("vec"))})
    real = v.where("ok")
    sizes = cut(real.groupBy("dim", "lh").count().groupBy("dim").agg(F.max("count").alias("n")))
    lengths = sizes.count()
    sized = real.join(small(sizes, lengths), "dim").select("k1", "k2", "id", "lh", "dim", "n", "vec")
    if lengths > 1:
        sized = sized.sortWithinPartitions("dim")
    decoded = sized.mapInArrow(_filters, "k1 long, k2 long, id long, lh long, s1 long, s2 long, keys array<long>")
    classes = cut(decoded.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("lh", "s1", "s2", "keys")]))

    before = F.transform(F.expr("slice(keys, 1, at)"), lambda k: F.shiftright(k, 32).cast("int")).alias("before")
    posted = classes.select(F.col("k1").alias("node"), "s1", "s2", "keys", F.posexplode("keys").alias("at", "key")).select("key", "node", "s1", "s2", before)
    meeting = blocks_of(posted, ["key"], "node", BLOCK_ROWS).repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    need = cut(meeting.mapInArrow(_meet(sketch_limit(cosine)), "key long, node long").distinct())

    wanted = need.select("node").distinct().withColumnRenamed("node", "k1")
    few = real.select("k1", "k2", "vec").join(small(wanted, need.count()), "k1", "left_semi")
    whole = few.groupBy("k1", "k2").agg(F.first("vec").alias("vec"))
    named = need.join(classes.withColumnRenamed("k1", "node").drop("s1", "s2"), "node")
    named = named.select("key", F.col("node").alias("k1"), "k2", "id", "copies", "lh", "keys", (F.array_position("keys", F.col("key")) - 1).cast("int").alias("at"))
    tasks = blocks_of(named.select("key", "k1", "k2", "id", "copies", "lh", before), ["key", "lh"], "k1", BLOCK_ROWS).join(whole, ["k1", "k2"])
    tasks = tasks.repartition(parts, "key", "lh", "a", "b").sortWithinPartitions("key", "lh", "a", "b")
    found = cut(tasks.mapInArrow(_verify(cosine), "one long, two long, links long"))

    number = found.where("links > 0").groupBy(F.col("one").alias("k1"), F.col("two").alias("k2")).agg(F.sum("links").alias("links"))
    linked = components(found.where("links = 0"), "one", "two")
    groups = classes.select("k1", "k2", "id", "copies").join(number, ["k1", "k2"], "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    groups = groups.select("k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    held = join_classes(real.select("id", "k1", "k2"), groups, ["k1", "k2"], ["n", "c"]).select("id", "n", "c")
    rest = v.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    out = held.unionByName(rest).select("id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
