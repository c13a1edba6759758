"""Packing documents into bins of a fixed size by conflict-constrained best fit.

Documents are dealt by a hash to shards of about ``SHARD`` pieces, so that hot
sources spread over all of them; shards pack on their own.  Within a shard pieces
go in descending size to the bin with the least room that fits and doesn't
conflict: bins are ordered by their room, carry bitmaps of the sources and
duplicate clusters that they hold, and the search goes on from the tightest bin
to its successors until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import cut
from allelica.llm.mixing import count_words

SHARD = 4000
_OUT = "id long, piece int, start long, tokens long, bin long, slot int, offset long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece; pieces come in the order given.

    A bin holds each source and each cluster once at most.  Of bins with equal
    room the one opened first is taken.
    """
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        k = bisect_left(room, (size, -1))
        while k < len(room):
            b = room[k][1]
            if not (has_source[b] & s or has_cluster[b] & c):
                break
            k += 1
        if k < len(room):
            left, b = room.pop(k)
            has_source[b] |= s
            has_cluster[b] |= c
        else:
            left, b = capacity, len(has_source)
            has_source.append(s)
            has_cluster.append(c)
        if left > size:
            insort(room, (left - size, b))
        out.append(b)
    return out


def _pack(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        null = t["id"].is_null().to_numpy()
        ids = t["id"].fill_null(0).to_numpy()
        piece, copy, words, tokens, cluster = (t[c].to_numpy() for c in ("piece", "copy", "words", "tokens", "cluster"))
        source = np.unique(np.array(t["source"].fill_null("").to_pylist(), dtype=str), return_inverse=True)[1]
        source = np.where(t["source"].is_null().to_numpy(), source.max() + 1, source)
        # rows that all of these leave tied are copies of each other
        order = np.lexsort((copy, words, cluster, source, piece, ids, null, -tokens))
        source, cluster, tokens = source[order], np.unique(cluster, return_inverse=True)[1][order], tokens[order]
        bins = np.array(best_fit(tokens.tolist(), source.tolist(), cluster.tolist(), capacity), dtype=np.int64)
        by = np.argsort(bins, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], bins[by][1:] != bins[by][:-1]]))
        length = np.diff(np.append(first, len(by)))
        slot, offset = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        slot[by] = np.arange(len(by)) - np.repeat(first, length)
        before = np.cumsum(tokens[by]) - tokens[by]
        offset[by] = before - np.repeat(before[first], length)
        own = t.take(pa.array(order))
        return pa.table(
            [own["id"], own["piece"], own["start"], own["tokens"], pa.array((t["shard"][0].as_py() << 32) | bins), pa.array(slot, pa.int32()), pa.array(offset, pa.int64())],
            names=["id", "piece", "start", "tokens", "bin", "slot", "offset"],
        )

    return pack


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """Packs all documents into bins of ``capacity`` words.

    No bin holds two pieces of one source, or of one duplicate cluster (by
    default, documents of equal text).  A longer document is cut into pieces of
    ``capacity`` words, which fill bins of their own, and a rest.  Returns one
    row for each piece: ``id``, ``piece``, ``start`` (its first word in the
    document), ``tokens``, ``bin``, ``slot`` and ``offset`` (its place and first
    word in the bin).  A bin's number is its shard's and its own within the
    shard, so that no two bins share one.

    Documents without words, nulls included, return one row of no words and a
    null bin.  Null sources are a source of their own.  Repeated rows, and
    different texts of one id or of none, are packed each.  An empty table gives
    no rows.  Other columns are not read.  Bins are the same for the same rows,
    whatever their partitioning; their number in a shard exceeds what fits by
    conflicts and one bin's rest.
    """
    text = F.col(text_col).cast("string")
    d = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (cluster if cluster is not None else F.xxhash64(text)).cast("long").alias("cluster"),
        count_words(text).alias("words"),
    )
    n = F.greatest(F.ceil(F.col("words") / F.lit(capacity)), F.lit(1)).cast("int")
    # repeated rows stay rows of their own, wherever they lie; words are counted once
    d = cut(d.groupBy("id", "source", "cluster", "words").agg(F.count("*").alias("copies")))
    pieces = d.agg(F.sum(n * F.col("copies")).alias("n")).first().n or 0
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    d = d.withColumn("start", F.col("piece").cast("long") * capacity)
    d = d.withColumn("tokens", F.least(F.lit(capacity), F.col("words") - F.col("start")).cast("long"))
    empty = d.where("tokens = 0").select("id", "piece", "start", "tokens", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("offset"))
    own = F.pmod(F.xxhash64("id", "source", "cluster", "words", "piece", "copy"), F.lit(max(1, -(-pieces // shard)))).cast("int")
    dealt = d.where("tokens > 0").select(own.alias("shard"), "id", "piece", "copy", "start", "tokens", "source", "cluster", "words")
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), _OUT).unionByName(empty)
