import random
import re

import pytest

from allelica.llm.minhash import near_duplicates

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = SPLIT.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for (a, _), s in zip(rows, sets):
        c = a if a is None or not s else find(a)
        out.append((a, len(s), c, a is None or a == c))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÄé") for _ in range(rng.randrange(1, 12)))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = word()
            rows.append((k * 3, rng.choice([" ", "\n"]).join(w)))
            k += 1
    # a group of more copies than the small path takes, exact ones among them
    base = [word() for _ in range(150)]
    for i in range(40):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rng.shuffle(rows)
    return rows + [(5001, None), (5002, ""), (5003, " \n"), (5004, "one"), (5005, "ONE"), (5006, "one two"), (None, rows[0][1]), (None, None), (5007, " ".join(base * 40))]


@pytest.mark.parametrize("n, percent", [(4, 80), (5, 90)])
def test_against_brute_force(spark, n, percent):
    rows = cases(n)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = sorted((tuple(r) for r in near_duplicates(df, shingle=n, percent=percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_blocks(spark, monkeypatch):
    from allelica.llm import minhash

    monkeypatch.setattr(minhash, "POSTING_BLOCK", 20)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 10)
    rows = cases(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df, shingle=4).collect()), key=str)
    assert got == brute(rows, 4, 80)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
