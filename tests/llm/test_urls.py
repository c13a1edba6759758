import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelica.llm import urls
from allelica.llm.textblocks import buffers


def test_models_count_all_urls_that_rules_decide(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    good = [f"http://{word()}.org/fr/{word()}" for _ in range(150)]
    bad = [f"http://{word()}.net/{word()}?{word()}" for _ in range(200)]
    free = [f"http://{word()}.com/{word()}" for _ in range(100)] + ["", None, "x"]
    rules = [("net/", "block"), ("org/fr/", "allow")]
    every = [*good, *bad, *free, *good[:9], *bad[:30]]
    df = spark.createDataFrame(list(enumerate(every)), "page_id long, url string").repartition(3)
    model = urls.train(df, rules, per_class=20)

    def fit(kind):
        d = spark.createDataFrame([(u,) for u in set(kind)], "url string")
        return [r.url for r in d.orderBy(F.xxhash64("url")).collect()][20 // urls.HELD_OUT :]

    one, two = (urls.Markov(*buffers(pa.array(fit(kind), pa.string()))) for kind in (good, bad))
    data, off = buffers(pa.array(every, pa.string()))
    want = (one.log_likelihood(data, off) - two.log_likelihood(data, off)) / np.maximum(np.diff(off), 1)
    got = {r.id: r for r in urls.judge(df, model, rules).collect()}
    assert len(got) == len(every)
    assert [got[k].ratio for k in range(len(every))] == pytest.approx(want)
    for k, u in enumerate(every):
        if u and got[k].rule is None:
            assert (got[k].verdict == "allow") == (got[k].ratio >= model.threshold)


def test_all_labelled_urls_count_and_calibrate(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4)))
    good = sorted({f"http://{word()}.org/fr/{word()}" for _ in range(120)})
    bad = sorted({f"http://{word()}.org/de/{word()}" for _ in range(170)})
    df = spark.createDataFrame(list(enumerate([*good, *bad, "http://ab.com/fr/c"])), "page_id long, url string").repartition(3)
    rules = [("org/de/", "block"), ("org/fr/", "allow")]
    model = urls.train(df, rules)

    def ratios(fit_good, fit_bad, of):
        one, two = (urls.Markov(*buffers(pa.array(x, pa.string()))) for x in (fit_good, fit_bad))
        data, off = buffers(pa.array(of, pa.string()))
        return (one.log_likelihood(data, off) - two.log_likelihood(data, off)) / np.diff(off)

    every = [*good, *bad]
    got = {r.id: r.ratio for r in urls.judge(df, model, rules).collect()}
    assert [got[k] for k in range(len(every))] == pytest.approx(ratios(good, bad, every))
    fold = {r.url: r.fold for r in df.select("url", F.pmod(F.xxhash64("url"), F.lit(urls.HELD_OUT)).alias("fold")).collect()}
    scored = []
    for f in range(urls.HELD_OUT):
        here = [u for u in every if fold[u] == f]
        scored += zip(ratios(*([u for u in kind if fold[u] != f] for kind in (good, bad)), here).tolist(), [u in good for u in here])
    scored.sort()
    r, lost, blocked, best = [x for x, _ in scored], 0, 0, (0, scored[0][0] - 1e-9)
    for k, (_, kind) in enumerate(scored[:-1]):
        lost, blocked = lost + kind, blocked + (not kind)
        if r[k + 1] - r[k] > 1e-12:
            best = min(best, (lost * len(bad) - blocked * len(good), (r[k] + r[k + 1]) / 2))
    assert model.threshold == pytest.approx(best[1], abs=1e-9)
