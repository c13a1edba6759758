import random

import numpy as np
import pyarrow as pa
import pytest

from allelica.llm import graph
from allelica.llm.graph import Forest, block_tasks, blocks_of, components, join_classes, whole_groups


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(30)] + [(None, 3), (4, None), (7, 7), edges[0]]
    df = spark.createDataFrame(edges, "a long, b long")
    got = [(r.node, r.component) for r in components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    p, q = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    f = Forest(300)
    f.join(p[:100], q[:100])
    f.join(p[100:], q[100:])
    want = brute(list(zip(p.tolist(), q.tolist())))
    assert [want.get(i, i) for i in range(300)] == f.label.tolist()
    ids = rng.permutation(300) - 150
    node, centre = f.edges(ids)
    low = {}
    for i, x in zip(f.label.tolist(), ids.tolist()):
        low[i] = min(x, low.get(i, x))
    assert sorted(zip(node.tolist(), centre.tolist())) == sorted((x, low[i]) for i, x in zip(f.label.tolist(), ids.tolist()) if x != low[i])


def test_block_tasks_meet_once(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 5), (3, 40)) for i in range(n)]
    got = block_tasks(spark.createDataFrame(rows, "key long, id long"), "key", "id", 10).collect()
    met = {}
    for x in got:
        for y in got:
            if (x.key, x.a, x.b) == (y.key, y.a, y.b) and x.id < y.id and (x.a == x.b or x.own != y.own):
                met[x.key, x.id, y.id] = met.get((x.key, x.id, y.id), 0) + 1
    assert met == {(k, i, j): 1 for k, n in ((2, 5), (3, 40)) for i in range(n) for j in range(i + 1, n)}


def test_whole_groups():
    key = np.repeat(np.arange(30), np.arange(30) % 7)
    t = pa.table({"k": key, "v": np.arange(len(key))})
    for size in (1, 4, 1000):
        parts = list(whole_groups(t.to_batches(max_chunksize=3), ["k"], size))
        assert [x for p, _ in parts for x in p["v"].to_pylist()] == list(range(len(key)))
        assert sum(len(e) - 1 for _, e in parts) == len(set(key.tolist()))


def test_blocks_of_meet_once(spark, monkeypatch):
    monkeypatch.setattr("allelica.llm.common.SMALL_ROWS", 0)
    rows = [(k, i) for k, n in ((1, 1), (2, 5), (3, 40)) for i in range(n)]
    got = blocks_of(spark.createDataFrame(rows, "key long, id long"), ["key"], "id", 10).collect()
    met = {}
    for x in got:
        for y in got:
            if (x.key, x.a, x.b) == (y.key, y.a, y.b) and x.id < y.id and (x.a == x.b or x.own != y.own):
                met[x.key, x.id, y.id] = met.get((x.key, x.id, y.id), 0) + 1
    assert met == {(k, i, j): 1 for k, n in ((2, 5), (3, 40)) for i in range(n) for j in range(i + 1, n)}
    assert {r.a for r in got if r.key == 2} == {0} and len({(r.a, r.b) for r in got if r.key == 3}) == 10


def test_join_classes(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k % 7 if k < 20 else 1, k) for k in range(40)], "k long, i long")
    classes = rows.groupBy("k").count().selectExpr("k", "count as copies", "k * 10 as v").where("k <> 6")
    got = sorted((r.k, r.i, r.v) for r in join_classes(rows, classes, ["k"], ["v"]).collect())
    assert got == sorted((r.k, r.i, 10 * r.k) for r in rows.collect() if r.k != 6)
