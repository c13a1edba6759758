import random
import re

import pytest
from pyspark.sql import functions as F

from allelica.llm.common import id_bucket
from allelica.llm.substring import remove_repeated, repeat_lengths

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words = {}
    for k, (i, text) in enumerate(rows):
        words[k] = SPLIT.findall(text or "")
        for a in range(len(words[k]) - window + 1):
            key = tuple(words[k][a : a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        gone = [False] * len(words[k])
        for a in range(len(words[k]) - window + 1):
            if i is not None and first[tuple(words[k][a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = [w for w, g in zip(words[k], gone) if not g]
        out.append((i, len(words[k]), sum(gone), " ".join(kept)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "Ünï", "longerwordthanusual", "x" * 70, "c", "z,", "日本", "of"]
    passages = [[rng.choice(vocab) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(1, 20))]
        rows.append((i * 7 - 100, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(5, None), (None, rows[3][1]), (9, ""), (11, " \n"), rows[50], rows[50], (12, "   ")]


@pytest.mark.parametrize("window", [2, 5, 13])
def test_against_brute_force(spark, window):
    rows = cases(window)
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, bucket string, id int")
    got = sorted(map(tuple, remove_repeated(df, window=window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated(df).count() == 0
    assert repeat_lengths(df).count() == 0


def test_one_long_document_and_exact_copies(spark):
    text = " ".join(str(k * k) for k in range(60_000))
    df = spark.createDataFrame([(3, text), (1, text), (2, "q " + text)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated(df).collect()}
    assert got[1][1] == 0 and got[3] == (60_000, 60_000, "") and got[2] == (60_001, 60_000, "q")


def test_doubling_until_nothing_survives(spark):
    rows = cases(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.length for r in repeat_lengths(df, window=5).collect()}
    holders, want, size = {}, {}, 5
    while True:
        holders = {}
        for i, t in rows:
            w = SPLIT.findall(t or "")
            for a in range(len(w) - size + 1) if i is not None else ():
                holders.setdefault(tuple(w[a : a + size]), set()).add(i)
        hit = set().union(*[h for h in holders.values() if len(h) > 1] or [set()])
        if not hit:
            break
        want |= dict.fromkeys(hit, size)
        size *= 2
    assert got == want


@pytest.mark.parametrize("buckets", [24, 23, 102])
def test_small_ids_are_dealt_to_all_buckets(spark, buckets):
    df = spark.range(40_000).select(id_bucket(F.col("id"), buckets, F.lit("x")).alias("b"))
    n = [r["count"] for r in df.groupBy("b").count().collect()]
    assert len(n) == buckets and max(n) < 1.5 * 40_000 / buckets
