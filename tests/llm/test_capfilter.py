import numpy as np
import pytest

from allelica.llm.capfilter import Code, code_size, filters_of, near_vectors


def brute(rows, least):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((k, np.array(v, float)))
    links = {k: 0 for k in range(len(rows))}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for a, (k, u) in enumerate(ok):
        for m, v in ok[:a]:
            if rows[k][2] == rows[m][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                links[k] += 1
                links[m] += 1
                pairs.add((k, m))
                x, y = find(rows[k][0]), find(rows[m][0])
                root[max(x, y)] = min(x, y)
    return {r[0]: (links[k], find(r[0])) for k, r in enumerate(rows) if r[0] is not None}, len(pairs)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for c in range(60):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            noise = rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.14, 0.16])
            rows.append((k, [float(x) for x in base + noise], int(c % 3)))
            k += 1
    tight = rng.standard_normal(64)
    for _ in range(50):
        rows.append((k, [float(x) for x in tight + rng.standard_normal(64) * 0.05], 1))
        k += 1
    rows += [(900 + j, rows[j][1], rows[j][2]) for j in range(20)] + [(950 + j, rows[0][1], rows[0][2]) for j in range(5)]
    rows += [(990, None, 1), (991, [0.0] * 64, 1), (992, [float("nan")] * 64, 1), (993, [None] + [1.0] * 63, 1), (994, rows[0][1], None), (995, [1.0, 2.0], 1), (996, [2.0, 4.0], 1), (997, [3.0], 1), (998, [], 1), (999, [float("inf")] * 64, 1), (-7, [5.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, filter int")
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    want, pairs = brute(rows, 0.98)
    assert set(got) == set(want)
    found = sum(n for n, _ in got.values()) / 2
    assert all(got[i][0] <= want[i][0] for i in want), "no link below the threshold"
    assert found >= 0.98 * pairs, (found, pairs)
    assert got[996] == (1, 995) and got[997] == (1, -7) and got[990] == (0, 990)


def planted(rng, n, dim, cosine):
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("dim", [64, 768])
@pytest.mark.parametrize("n", [10**3, 10**5, 10**7])
def test_planted_pairs_share_a_filter(n, dim):
    """Recall at the threshold, with the codes of 1,000 to 10,000,000 vectors of one label."""
    rng, code = np.random.default_rng(3), Code(dim, n)
    blocks, words = code_size(dim, n)
    assert n * filters_of(blocks) <= 8 * words**blocks and words <= 512
    for cosine in (0.98, 0.99):
        one, two = (code.decode(x.astype(np.float32)) for x in planted(rng, 1000, dim, cosine))
        assert one.shape == (1000, filters_of(blocks))
        assert (one[:, :, None] == two[:, None, :]).any((1, 2)).mean() >= 0.985, (n, dim, cosine)


def test_decoding_finds_the_best_directions():
    rng, code = np.random.default_rng(6), Code(64, 3_000_000)
    assert code.blocks == 3
    small = Code(24, 40)
    small.blocks, small.words, small.take = 3, 8, 16
    small.parts = [(a, a + 8, rng.standard_normal((8, 8)).astype(np.float32)) for a in (0, 8, 16)]
    x = planted(rng, 50, 24, 0.5)[0].astype(np.float32)
    y = x @ small.turn
    s = [y[:, a:b] @ c.T for a, b, c in small.parts]
    every = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(50, -1)
    want = np.sort(np.argsort(-every, axis=1)[:, :16], axis=1)
    assert (np.sort(small.decode(x), axis=1) == want).all()


def test_isolated_pairs(spark):
    """Pairs of all lengths at the threshold, each without other near vectors."""
    rng = np.random.default_rng(4)
    rows = []
    for dim, n in ((4, 3), (8, 5), (64, 400)):
        for x, y in zip(*planted(rng, n, dim, 0.9801), strict=True):
            rows += [(len(rows), [float(v) for v in x], n), (len(rows) + 1, [float(v) for v in y], n)]
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want, _ = brute(rows, 0.98)
    assert sum(got[i] != want[i] for i in want) <= 2


def test_many_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim in [*range(1, 40), 9, 9, 24]:
        for x, y in zip(*planted(rng, 2, dim, 0.985) if dim > 1 else rng.uniform(1, 2, (2, 2, 1)), strict=True):
            rows += [(len(rows), [float(v) for v in x], 1), (len(rows) + 1, [float(v) for v in y], 1)]
    rng.shuffle(rows)
    for kind in ("double", "float"):
        exact = [(i, [float(np.float32(x)) if kind == "float" else x for x in v], k) for i, v, k in rows]
        got = {r.id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(exact, f"vec_id long, embedding array<{kind}>, label int")).collect()}
        assert got == brute(exact, 0.98)[0]


def test_repeated_ids_and_hot_classes(spark, monkeypatch):
    from allelica.llm import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 3)
    rng = np.random.default_rng(8)
    a, b, c = (x[0].tolist() for x in (planted(rng, 1, 32, 0.5)[0], *planted(rng, 1, 32, 0.99)))
    rows = [(1, a, 1), (1, b, 1), (2, c, 1), (9, None, 1), (9, a, 1), *((10 + k, b, 1) for k in range(6)), (None, b, 1)]
    got = sorted((r.id or -1, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    want = sorted([(1, 1, 1), (9, 1, 1), (1, 7, 1), (2, 7, 1), (9, 0, 9), (-1, 0, None), *((10 + k, 7, 1) for k in range(6))], key=str)
    assert sorted(got, key=str) == want


def test_blocks(spark, monkeypatch):
    from allelica.llm import capfilter

    monkeypatch.setattr(capfilter, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    rows = [(k, [float(x) for x in base + rng.standard_normal(64) * 0.01], 1) for k in range(120)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
