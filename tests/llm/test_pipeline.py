import random
from collections import Counter

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelica.llm import quality
from allelica.llm.textblocks import buffers
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_mixing_packing import check_bins
from tests.llm.test_substring import brute as repeat_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 string, id long, score double, grp long"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = [word() for _ in range(30)]
    docs, labels = [], []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(20, 90))]
        if i % 9 == 0:
            w[5:5] = passage
        if i % 10 == 3 and docs:
            w = docs[-1][1].split() + [word()]
        low = i % 6 == 5
        text = " ".join(x.upper() + "!!" for x in w) if low else " ".join(w)
        docs.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text)))
        labels.append((i, 0 if low else 1, 0))
    docs += [(500, None, None, None, None), (501, "", "en", "b", 0), (502, "word", None, "a", 4), docs[7], (None, docs[8][1], "en", "a", 1), (503, " ".join([word() for _ in range(15_000)]), "en", "b", 5)]
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 0)]
    return [(*d, "x", 1, 2.0, 3) for d in docs], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = corpus(4)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_each_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "substring dedup", "source mixing", "best-fit packing"]
    before = rows(docs)

    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"), F.lit(True))
    kept = cp.keep_good(spark, docs, tables)
    score = model.score(*buffers(pa.array([r[1] for r in before], pa.string())))
    want = [r for r, s in zip(before, score) if s >= 0.5]
    assert Counter(rows(kept)) == Counter(want) and 0 < len(want) < len(before)
    low = {i for i in range(150) if i % 6 == 5}
    assert not low & {r[0] for r in want} and len({r[0] for r in want} & (set(range(150)) - low)) >= 120

    step = docs.join(kept.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_semi")
    step = step.unionByName(docs.where("doc_id is null or text is null"))
    before = rows(step)
    after = rows(cp.drop_near_copies(spark, step, tables))
    stay = {r[0] for r in near_brute([(r[0], r[1]) for r in before], 5, 80) if r[3]}
    assert Counter(after) == Counter({r: (1 if r[0] is not None else n) for r, n in Counter(before).items() if r[0] is None or r[0] in stay})

    step = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in after], SCHEMA)
    got = rows(cp.drop_repeats(spark, step, tables))
    cut = {(i, n, k): t for i, n, k, t in repeat_brute([(r[0], r[1]) for r in after], 13)}
    want = Counter()
    for (i, n, k), t in cut.items():
        for r in (r for r in after if r[0] == i):
            if k == 0:
                want[r] = 1
            elif k < n:
                want[(i, t, r[2], r[3], len(t))] = 1
    assert Counter(got) == want and any(k for _, _, k in cut)

    step = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in got], SCHEMA)
    mixed = cp.mix_sources(spark, step, tables)
    assert mixed.columns == cp.COLUMNS
    again = Counter(rows(mixed))
    assert set(again) == set(got) and all(1 <= n <= 2 for n in again.values()) and sum(again.values()) > len(got)

    packed = cp.pack_bins(spark, mixed, tables).withColumnRenamed("doc_id", "id").collect()
    data = [r[:2] + (r[3],) for r in again.elements()]
    check_bins(data, packed, cp.CAPACITY, lambda i: i)


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(5)]
    # 1: two texts; 2: a near copy of 1's first and one of its own; 3: near copies of each other; 4: a row twice, with two sources
    docs = [(1, text[0]), (1, text[1]), (2, text[0] + " x"), (2, text[2]), (3, text[3]), (3, text[3] + " y"), (4, text[4]), (4, text[4]), (5, None), (5, "")]
    data = [(i, t, "en", "ba"[k % 2], k % 2) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(cp.drop_near_copies(spark, df.repartition(5), ""))
    assert len(got) == len(set(got)) == 7 and set(got) <= set(data)
    assert {r[:2] for r in got} - {(3, text[3]), (3, text[3] + " y")} == {(1, text[0]), (1, text[1]), (2, text[2]), (4, text[4]), (5, None), (5, "")}
    assert [r[3] for r in got if r[0] == 4] == ["a"]
    again = rows(cp.drop_near_copies(spark, df.repartition(2, "n_chars"), ""))
    assert Counter(again) == Counter(got)


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_run_writes_every_document_that_stays(spark, tables):
    out = cp.run(spark, tables)
    assert {"doc_id", "bin", "tokens"} <= set(out.columns) and out.count() > 100


def test_stages_read_what_the_stage_before_wrote(spark, tables, monkeypatch):
    import os

    seen = []

    def spied(stage):
        def call(spark, docs, sf_dir):
            seen.append(sorted({os.path.dirname(f) for f in docs.inputFiles()}))
            return stage(spark, docs, sf_dir)

        return call

    monkeypatch.setattr(cp, "STAGES", [(n, spied(f)) for n, f in cp.STAGES])
    out = cp.run(spark, tables)
    assert len(seen) == 5 and seen[0][0].endswith("documents.parquet")
    assert [[os.path.basename(d) for d in s] for s in seen[1:]] == [["0"], ["1"], ["2"], ["3"]]
    assert {os.path.basename(os.path.dirname(f)) for f in out.inputFiles()} == {"4"}
    assert out.count() > 100


def test_run_scores_every_row_once(spark, tables, monkeypatch):
    """One training pass and one scoring pass, whatever the later stages do."""
    fits, scored = [], spark.sparkContext.accumulator(0)
    apply, fit = quality._apply, quality.fit

    def counted(model):
        inner = apply(model)

        def score(batches):
            def seen():
                for batch in batches:
                    scored.add(batch.num_rows)
                    yield batch

            yield from inner(seen())

        return score

    monkeypatch.setattr(quality, "_apply", counted)
    monkeypatch.setattr(quality, "fit", lambda texts, y: fits.append(len(texts)) or fit(texts, y))
    assert cp.run(spark, tables).count() > 100
    assert scored.value == spark.read.parquet(f"{tables}/documents.parquet").count() and len(fits) == 1
