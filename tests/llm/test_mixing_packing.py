import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from allelica.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, epoch int, bin string"


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        s = rng.choice(["big"] * 6 + ["mid", "mid", "small", None])
        n = rng.choice([0, 1, 5, 30, 90, 250])
        out.append((i, " ".join(["w"] * n) if rng.random() < 0.9 else ("same text" if rng.random() < 0.5 else None), s, 1, "b"))
    return out + [(900, "", "empty only", 1, "b"), out[0], out[0], (None, "null id here", "mid", 1, "b")]


def test_exponents():
    p = np.array([0.7, 0.2, 0.1, 0.0])
    a = mixing.find_exponent(p, 1.0, None)
    w = mixing.weights(p, a)
    assert mixing.entropy(w) == pytest.approx(1.0) and w[3] == 0 and w.sum() == pytest.approx(1)
    a = mixing.find_exponent(p, None, 3.0)
    assert mixing.epochs_of(p, mixing.weights(p, a)).max() == pytest.approx(3.0)
    assert mixing.find_exponent(p, 9.0, None) == 0.0 and mixing.find_exponent(p, 0.0, None) == 1.0 and mixing.find_exponent(p, None, 1.0) == 1.0
    # the limit binds
    assert mixing.find_exponent(p, 1.09, 2.0) == pytest.approx(mixing.find_exponent(p, None, 2.0))


@pytest.mark.parametrize("most", [1.0, 2.5])
def test_mix_against_brute_force(spark, most):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df, most_epochs=most).collect()
    assert got == [] or list(got[0].asDict()) == ["doc_id", "text", "source", "epoch", "bin", "_epoch", "place"]
    words = lambda t: len((t or "").split())
    total = Counter()
    for _, t, s, *_ in data:
        total[s] += words(t)
    names = sorted(total, key=lambda s: (s is not None, s or ""))
    p = np.array([total[s] for s in names]) / sum(total.values())
    e = mixing.epochs_of(p, mixing.weights(p, mixing.find_exponent(p, None, most)))
    n = Counter((r.doc_id, r.text, r.source) for r in got)
    copies = Counter((i, t, s) for i, t, s, *_ in data)
    for s, x in zip(names, e):
        full, budget = int(np.floor(x + 1e-9)), int(round((x - np.floor(x + 1e-9)) * total[s]))
        mine = sorted((place(i, t), i, t) for i, t, q in copies if q == s)
        used = 0
        for _, i, t in mine:
            used += words(t) * copies[i, t, s]
            assert n[i, t, s] == copies[i, t, s] * (full + (used <= budget and budget > 0)), (s, i, x)
    assert all(r.place == place(r.doc_id, r.text, r._epoch) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def place(i, text, epoch=None):
    k = int(hashlib.md5(f"3:{'' if i is None else i}:{text or ''}".encode()).hexdigest()[:15], 16)
    return k if epoch is None else int(hashlib.md5(f"3:{epoch}:{k}".encode()).hexdigest()[:15], 16)


def test_ties_whatever_the_partitions(spark):
    """Ids that are null or repeat, and rows that repeat, in 1, 3 and 7 partitions."""
    rng = random.Random(7)
    data = [(rng.choice([None, 7, i]), f"{'w ' * rng.choice([3, 12, 25])}{i % 90}", rng.choice(["big"] * 5 + ["small"]), i % 2, "b") for i in range(300)]
    data += data[:40]
    frames = [spark.createDataFrame(data, SCHEMA).repartition(k) for k in (1, 3, 7)]
    mixed = [sorted(map(str, mixing.mix(f, most_epochs=1.7).collect())) for f in frames]
    assert mixed[0] == mixed[1] == mixed[2] and len(mixed[0]) > len(data)
    packed = [packing.pack(f, capacity=10, shard=50).collect() for f in frames]
    assert sorted(map(str, packed[0])) == sorted(map(str, packed[1])) == sorted(map(str, packed[2]))
    bins = defaultdict(list)
    for r in packed[0]:
        bins[r.bin].append(r)
    assert all(sum(r.tokens for r in b) <= 10 and sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())
    assert sum(r.tokens for r in packed[0]) == sum(len(t.split()) for _, t, *_ in data)


def test_more_sources_than_the_driver_sums_up(spark, monkeypatch):
    data = [(i, "w " * (1 + i % 13), f"s{min(i % 40, 16)}", 1, "b") for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted(map(str, mixing.mix(df, target_entropy=2.6, most_epochs=None).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    monkeypatch.setattr("allelica.llm.common.SMALL_ROWS", 3)
    assert sorted(map(str, mixing.mix(df, target_entropy=2.6, most_epochs=None).collect())) == want and len(want) > 200


@pytest.mark.parametrize("words", [300_000])
def test_very_long_text(spark, words):
    data = [(1, "w " * words, "a", 1, "b"), (2, "v " * 50, "b", 1, "b"), (3, None, None, 1, "b")]
    df = spark.createDataFrame(data, SCHEMA)
    bins = check_bins(data, packing.pack(df, capacity=1024).collect(), 1024, lambda i: i)
    assert len(bins) == 294  # 292 full, a rest of 992, and 50
    assert Counter(r.doc_id for r in mixing.mix(df, most_epochs=2.0).collect()) == {1: 1, 2: 2, 3: 1}


def check_bins(data, got, capacity, cluster):
    words = {i: len((t or "").split()) for i, t, *_ in data}
    source = {i: s for i, _, s, *_ in data}
    bins, pieces = defaultdict(list), Counter()
    for r in got:
        pieces[(r.id, r.piece)] += 1
        assert r.start == r.piece * capacity and (r.bin is None) == (r.tokens == 0)
        if r.bin is not None:
            bins[r.bin].append(r)
    want = Counter()
    for i, t, *_ in data:
        for k in range(max(1, -(-words[i] // capacity))):
            want[(i, k)] += 1
    assert pieces == want
    for b in bins.values():
        b.sort(key=lambda r: r.slot)
        assert [r.slot for r in b] == list(range(len(b))) and [r.offset for r in b] == [sum(x.tokens for x in b[:k]) for k in range(len(b))]
        assert sum(r.tokens for r in b) <= capacity
        assert len({source[r.id] for r in b}) == len(b) and len({cluster(r.id) for r in b}) == len(b)
    return bins


def test_packing(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    got = packing.pack(df, capacity=100, shard=150).collect()
    text = {i: t for i, t, *_ in data}
    check_bins(data, got, 100, lambda i: text[i])
    again = packing.pack(df.repartition(7), capacity=100, shard=150).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.pack(df.limit(0)).count() == 0


def test_full_pieces_of_rows_with_one_id(spark):
    texts = [" ".join([w] * n) for w, n in (("a", 20), ("b", 20), ("c", 30), ("a", 20))]
    for i in (None, 7):
        got = packing.pack(spark.createDataFrame([(i, t, "s") for t in texts], "doc_id long, text string, source string"), capacity=10).collect()
        assert len({r.bin for r in got}) == len(got) == 9 and {r.tokens for r in got} == {10}


def brute_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for z, s, c in zip(sizes, sources, clusters):
        ok = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + z <= capacity and all(x[1] != s and x[2] != c for x in b)]
        k = min(ok)[1] if ok else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((z, s, c))
        out.append(k)
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        n = 80
        z = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
        s, c = [rng.randrange(6) for _ in range(n)], [rng.randrange(40) for _ in range(n)]
        assert packing.best_fit(z, s, c, 100) == brute_fit(z, s, c, 100)
