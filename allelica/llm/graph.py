"""Connected components, and groups of rows dealt to tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import HOT_ROWS, SMALL_ROWS, cut, small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The connected components of a graph, as ``node`` and ``component`` (its smallest node).

    Edges point from the larger to the smaller node.  A round replaces each
    edge's smaller end by that node's own least neighbour (large star), then links
    the ends that a node has to the least of them (small star), until every
    node has one edge and no end has any.  A round is written to the checkpoint
    folder.  Edges that repeat are dropped before they are dealt by a node, since
    all members of a component repeat those between its former centres.  Edges with
    a null end and loops are left out; nodes without other edges are not returned.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.distinct().repartition("u"))
    while True:
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if low.where("n > 1").isEmpty() and e.join(low.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        x = e.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("w")).repartition("u")
        least = x.groupBy("u").agg(F.min("w").alias("m"))
        ends = x.join(least, "u").where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        e = cut(ends.unionByName(least.select("u", F.col("m").alias("v"))).distinct().repartition("u"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows with their class's ``values``; ``classes`` has the columns ``on`` and ``copies``, its number of rows.

    The largest classes of many rows, ``SMALL_ROWS`` at most, are joined by a
    broadcast, so that no key of the shuffled join is hot.
    """
    hot = cut(classes.where(F.col("copies") > HOT_ROWS).orderBy(F.desc("copies")).limit(SMALL_ROWS).select(*on, *values, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return rows.join(classes.select(*on, *values), on)
    marked = rows.join(F.broadcast(hot), on, "left")
    rest = marked.where("_hot is null").drop("_hot", *values).join(classes.select(*on, *values), on)
    return marked.where("_hot").drop("_hot").select(*rest.columns).unionByName(rest)


def blocks_of(rows: DataFrame, keys: list[str], row_id: str, limit: int) -> DataFrame:
    """:func:`block_tasks` for small rows: only keys of more than ``limit`` rows are looked up, and groups of one stay."""
    heavy = cut(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("blocks")))
    n = heavy.count()
    if not n:
        return rows.withColumns({c: F.lit(0) for c in ("a", "b", "own")})
    d = rows.join(small(heavy, n), keys, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("blocks")).cast("int"), F.lit(0)))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return d.select(*rows.columns, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")


def block_tasks(rows: DataFrame, key: str, row_id: str, limit: int, weight: Column | None = None, heavy: int = 0) -> DataFrame:
    """Deals rows that must be compared within ``key`` to tasks of bounded size.

    Groups of one row are left out: they have no pair.  A group of more than
    ``limit`` rows (or of more ``weight`` than ``heavy``) is split into blocks
    by a hash of ``row_id``, and each pair of blocks ``(a, b)`` is a task; every
    pair of rows meets in exactly one task, if rows of one block meet only where
    ``a = b``.  Adds ``a``, ``b`` and the row's own block ``own``.
    """
    total = F.sum(weight).alias("w") if weight is not None else F.lit(0).alias("w")
    size = rows.groupBy(key).agg(F.count("*").alias("rows"), total).where("rows > 1")
    n = F.ceil(F.col("rows") / F.lit(limit))
    if weight is not None:
        n = F.greatest(n, F.ceil(F.col("w") / F.lit(heavy)))
    split = size.select(key, n.cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(row_id), F.col("blocks")).cast("int")
    out = rows.join(split, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(*rows.columns, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")


def by_task(rows: DataFrame, parts: int, key: str) -> DataFrame:
    return rows.repartition(parts, key, "a", "b").sortWithinPartitions(key, "a", "b")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables of whole groups of about ``rows`` rows, with the groups' edges."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            edges = _edges(table, keys)
            last = int(edges[-2])
            if last:
                yield table.slice(0, last), edges[:-1]
            rest = table.slice(last)
            # a group that goes on is gathered without looking at its rows again each time
            held, count = rest.combine_chunks().to_batches(), 0 if not last else rest.num_rows
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class Forest:
    """Connected components of a small graph, with numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        lab = self.label
        while True:
            x, y = lab[p], lab[q]
            apart = x != y
            if not apart.any():
                break
            p, q, x, y = p[apart], q[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            root = np.arange(len(lab))
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            lab = root[lab]
        self.label = lab

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's id with its component's smallest, where they differ."""
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, self.label, ids)
        centre = low[self.label]
        other = ids != centre
        return ids[other], centre[other]
