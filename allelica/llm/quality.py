"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A document's features are indicators of hashed n-grams: lower-cased words,
runs of one to three word *shapes* (letter case, digits, punctuation at the
ends, length, and whether the word repeats one of the two before it), and runs
of shapes for punctuation only.  Each indicator is scaled by its class
log-count ratio, and a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.linear import bounded_sample, hinge_dual, logistic_fit, sigmoid
from allelica.llm.textblocks import Words, buffers, combine, mix, reduce_docs, slices

BITS = 18
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1500
#: Weight of the hinge-loss weights against their mean size (interpolation of the naive Bayes and the support vectors).
_BETA = 0.25
_KIND = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 4 digit, 8 other ASCII, 16 beyond ASCII
for _b in range(256):
    _ch = chr(_b)
    _KIND[_b] = 16 if _b >= 0x80 else 0 if _ch.isspace() else 1 if _ch.islower() else 2 if _ch.isupper() else 4 if _ch.isdigit() else 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document, document by document, and how many each has."""
    words = Words(data, offsets, lower=True)
    n, doc = len(words.starts), words.doc
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(docs, np.int64)
    h = words.hash
    kind = _KIND[data]
    shape = np.bitwise_or.reduceat(kind, words.starts).astype(np.uint64)
    first, last = data[words.starts], data[words.ends - 1]
    ends = (np.where(kind[words.ends - 1] == 8, last, 0).astype(np.uint64) << np.uint64(8)) | np.where(kind[words.starts] == 8, first, 0).astype(np.uint64)
    capital = (kind[words.starts] == 2).astype(np.uint64)
    length = np.minimum(np.log2(words.ends - words.starts + 1).astype(np.uint64), np.uint64(7))
    again = np.zeros(n, np.uint64)
    for k in (1, 2):
        same = np.zeros(n, dtype=bool)
        same[k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
        again |= same.astype(np.uint64) << np.uint64(k - 1)
    token = mix((shape << np.uint64(40)) | (ends << np.uint64(16)) | (capital << np.uint64(8)) | again)
    full = combine(token, length)
    parts, whose = [mix(h ^ np.uint64(11)), full], [doc, doc]
    run = token
    for k in (1, 2):
        run = combine(run[:-1], token[k:])
        inside = doc[k:] == doc[:-k]
        parts.append(run[inside] ^ np.uint64(k))
        whose.append(doc[k:][inside])
    bins = np.concatenate(parts) >> np.uint64(64 - BITS)
    key = np.sort((np.concatenate(whose).astype(np.uint64) << np.uint64(BITS)) | bins)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=docs)


class Model:
    """Scores by ``sigmoid(slope * (weight of the active features + bias) + shift)``."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.bias, self.slope, self.shift = weight.astype(np.float32), bias, slope, shift

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, n = features(data, offsets)
        total = reduce_docs(np.add, self.weight[f].astype(np.float64), n, 0.0)
        return sigmoid(self.slope * (total + self.bias) + self.shift)


def fit(texts: list[str | None], y: np.ndarray) -> Model:
    """Fits the model; without examples of both classes, scores are the share of class 1 (0.5 with none)."""
    y = np.asarray(y, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 20.0 * (2 * y[0] - 1) if len(y) else 0.0)
    rows: list[np.ndarray] = []
    for _, _, data, off in slices(*buffers(pa.array(texts, pa.string()))):
        f, n = features(data, off)
        rows += np.split(f, np.cumsum(n)[:-1])
    count = np.zeros((2, 1 << BITS))
    for r, k in zip(rows, y.tolist(), strict=True):
        count[k, r] += 1
    seen = count.sum(0) > 1
    count += 1.0
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[~seen] = 0.0
    rows = [r[seen[r]] for r in rows]
    unit = float(np.sqrt(np.mean([(ratio[r] ** 2).sum() for r in rows]) + 1e-12))
    ratio /= unit
    share = np.bincount(y, minlength=2) / len(y)
    w, bias = hinge_dual(rows, ratio, 2.0 * y - 1, 0.5 / share[y])
    mean = float(np.abs(w[seen]).mean())
    w = (1 - _BETA) * mean + _BETA * w if _BETA < 1 and mean else w
    weight = w * ratio
    margin = np.array([float(weight[r].sum()) for r in rows])
    slope, shift = logistic_fit(margin, y.astype(float), 0.5 / share[y])
    return Model(weight, 0.0, slope, shift)


def _apply(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rest = [batch.column(k) for k in range(batch.num_columns)]
            for i, j, data, off in slices(*buffers(batch["text"])):
                cols = [c.slice(i, j - i) for c in rest]
                yield pa.record_batch([*cols, pa.array(m.score(data, off))], names=[*batch.schema.names, "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, eligible, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class among the ``eligible`` rows of ``labels``."""
    sample = bounded_sample(labels, label, id_col, eligible, per_class)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # bounded: 2 * per_class ids; of rows with one id the least text is used
    got = d.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    return fit([None if t is None else t for t in got["text"].tolist()], got["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id`` and ``score``, 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a document without features.  Only
    the text, all of it, is an input of the score.  Ids may be null or repeat; an
    empty table gives no rows.  Other columns are not read, whatever their names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_apply(shared), "id long, text string, score double").drop("text")


def split_low(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.col(f"c{names.index(text_col)}").cast("string").alias("text")
    schema = ", ".join(f"c{k} {t.dataType.simpleString()}" for k, t in enumerate(flat.schema)) + ", text string, score double"
    kept = flat.select("*", text).mapInArrow(_apply(shared), schema).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
