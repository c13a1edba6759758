"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (lower-cased runs of letters and digits), their stems and their endings
are scored by their log-odds between toxic and other labelled documents under
an informative Dirichlet prior, their frequencies in both; odds that aren't significant count as none,
and every token pays a fixed price, so that clean text drifts downwards.  A
linear-time scan finds every maximal-scoring segment of a document.  The
scores of such segments in clean text follow an extreme-value law, whose two
parameters are estimated; by it, a document's segments become one P-value,
and a logistic curve turns that into a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.linear import bounded_sample, logistic_fit, sigmoid, without_copies
from allelica.llm.textblocks import NOT_ALNUM, Words, buffers, slices, span_hashes

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 2000
#: Strength of the prior (following frequencies, and for each form), least z-value and size of odds that count,
#: largest odds, price of each token.
PRIOR, FLAT, Z_LEAST, ODDS_LEAST, ODDS_MOST, PRICE = 500.0, 0.5, 2.5, 2.0, 8.0, 0.1
#: Largest expected number of segments as good in clean text for a segment to be reported.
SIGNIFICANT = 0.05
_TABLE = 1 << 16


#: A token also counts as its stems, its first so many bytes, and as its last so many.
STEMS, ENDINGS = (4, 5, 6, 7), (5,)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, lower=True, between=NOT_ALNUM)


def _forms(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens, of their stems and of their endings, each with the tokens that have one."""
    length = words.ends - words.starts
    yield np.arange(len(length)), words.hash
    for kind, k in [(1, k) for k in STEMS] + [(2, k) for k in ENDINGS]:
        at = np.flatnonzero(length > k)
        first = words.starts[at] if kind == 1 else words.ends[at] - k
        yield at, span_hashes(words.data, first, first + k) ^ np.uint64(kind)


def segments(score: list[float], at: list[int], price: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments ``(score, first, last)`` of a sequence in linear time (Ruzzo and Tompa 1999).

    ``score`` and ``at`` give the tokens of positive score and where they are;
    all tokens between cost ``price`` each.
    """
    kept: list[list] = []  # [sum before, sum after, first, last, previous with a smaller sum before]
    total, last = 0.0, -1
    for s, p in zip(score, at, strict=True):
        total -= price * (p - last - 1)
        left, total, last = total, total + s, p
        item = [left, total, p, p, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= item[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= item[1]:
                item[4] = j
                kept.append(item)
                break
            item = [kept[j][0], item[1], kept[j][2], item[3], -1]
            del kept[j:]
    return [(b - a, i, j) for a, b, i, j, _ in kept]


class Model:
    """Gains of tokens, stems and endings by hash, and the parameters of the extreme-value law and the logistic curve."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.gain = hashes[order], odds[order] - PRICE
        self.marks = np.zeros(_TABLE, dtype=bool)
        self.marks[(self.hashes & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        self.decay, self.density, self.slope, self.shift = 1.0, 1.0, 0.0, 0.0

    def gains(self, words: Words) -> np.ndarray:
        """The gain of each token, the largest of its forms; 0 where it only pays its price."""
        best = np.zeros(len(words.starts))
        if not len(self.hashes):
            return best
        for token, h in _forms(words):
            at = np.flatnonzero(self.marks[(h & np.uint64(_TABLE - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            ok = self.hashes[k] == h[at]
            token, k = token[at[ok]], k[ok]
            best[token] = np.maximum(best[token], self.gain[k])
        return best

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int, int]], Words]]:
        """For each document: its number of tokens, and its maximal-scoring segments by token."""
        words = _tokens(data, offsets)
        gain = self.gains(words)
        at = np.flatnonzero(gain)
        gain = gain[at]
        edge = np.searchsorted(at, words.woff)
        for d, n in enumerate(words.counts.tolist()):
            a, b = edge[d], edge[d + 1]
            yield n, (segments(gain[a:b].tolist(), (at[a:b] - words.woff[d]).tolist(), PRICE) if b > a else []), words

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> float:
        """Minus the logarithm of the P-value of a document's best segments (sum statistics over their number)."""
        bits = sorted((self.decay * s - math.log(self.density * max(n, 1)) for s, _, _ in found), reverse=True)
        best, total, fact = 0.0, 0.0, 0.0
        for r, x in enumerate(bits, 1):
            total += x
            if total <= 0 or r > 1 and x <= 0:
                break
            # P(sum of r normalised scores >= t) is about e^-t t^(r-1) / (r! (r-1)!), halved for each further r
            if r > 1:
                fact += math.log(r) + math.log(r - 1) if r > 2 else math.log(r)
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + fact - r * math.log(2.0))
        return best

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each document, and its significant segments as byte spans with their expected number."""
        value, spans = [], []
        for d, (n, found, words) in enumerate(self.found(data, offsets)):
            value.append(self.evidence(n, found) if found else 0.0)
            mine = []
            for s, i, j in found:
                e = self.density * n * math.exp(-self.decay * s)
                if e <= SIGNIFICANT:
                    w = words.woff[d]
                    mine.append((int(words.starts[w + i] - offsets[d]), int(words.ends[w + j] - offsets[d]), e))
            spans.append(mine)
        return sigmoid(self.slope * np.array(value) + self.shift), spans


def fit(texts: list[str | None], y: np.ndarray) -> Model:
    """Fits the model; without examples of both classes, scores are near that of the only class (0 with none)."""
    y = np.asarray(y, dtype=np.int64)
    none = Model(np.zeros(0, np.uint64), np.zeros(0))
    if len(set(y.tolist())) < 2:
        none.shift = 20.0 if len(y) and y[0] else -20.0
        return none
    one = without_copies(texts)
    texts, y = [texts[i] for i in one], y[one]
    if len(set(y.tolist())) < 2:
        return fit([], y[:1])
    hs, cs, total = [], [], np.zeros(2)
    for i, _, data, off in slices(*buffers(pa.array(texts, pa.string()))):
        w = _tokens(data, off)
        doc = w.doc
        for token, h in _forms(w):
            # a document counts each form once, however often it repeats it
            order = np.lexsort((h, doc[token]))
            d, h = doc[token][order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
            hs.append(h[new])
            cs.append(y[i + d[new]])
            total += np.bincount(cs[-1], minlength=2)
    vocab, inv = np.unique(np.concatenate(hs), return_inverse=True)
    cls = np.concatenate(cs)
    count = np.stack([np.bincount(inv[cls == k], minlength=len(vocab)) for k in (0, 1)]).astype(float)
    alpha = FLAT + PRIOR * count.sum(0) / total.sum()
    post = count + alpha
    rest = total[:, None] + PRIOR + FLAT * len(vocab) - post
    odds = np.log(post[1] / rest[1]) - np.log(post[0] / rest[0])
    z = odds / np.sqrt(1 / post[1] + 1 / post[0])
    good = (z >= Z_LEAST) & (odds >= ODDS_LEAST)
    model = Model(vocab[good], np.minimum(odds[good], ODDS_MOST))

    # how often clean tokens gain what; the largest gain is still possible where clean text never showed it
    clean = [model.gains(_tokens(data, off)) for _, _, data, off in slices(*buffers(pa.array([t for t, k in zip(texts, y.tolist(), strict=True) if k == 0], pa.string())))]
    gain, times = np.unique(np.concatenate(clean), return_counts=True)
    gain, times = np.append(gain, model.gain.max(initial=PRICE)), np.append(times, 0.5)
    gain[gain == 0] = -PRICE
    p = times / times.sum()
    mean = lambda x: float((p * np.exp(np.minimum(x * gain, 700))).sum())
    if (p * gain).sum() < 0:
        lo, hi = 1e-6, 1.0
        while mean(hi) < 1.0 and hi < 64:
            lo, hi = hi, 2 * hi
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(mid) < 1.0 else (lo, mid)
        model.decay = lo
    seen = [(n, found) for _, _, data, off in slices(*buffers(pa.array(texts, pa.string()))) for n, found, _ in model.found(data, off)]
    rate = [n * math.exp(-model.decay * max([0.0, *(s for s, _, _ in f)])) for (n, f), k in zip(seen, y.tolist(), strict=True) if k == 0 and n]
    model.density = 1.0 / max(float(np.mean(rate)), 1e-9) if rate else 1.0
    x = np.array([model.evidence(n, f) for n, f in seen])
    share = np.bincount(y, minlength=2) / len(y)
    model.slope, model.shift = logistic_fit(x, y.astype(float), 0.5 / share[y])
    return model


def train(docs: DataFrame, labels: DataFrame, eligible, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class among the ``eligible`` rows of ``labels``."""
    sample = bounded_sample(labels, label, id_col, eligible, per_class)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # bounded: 2 * per_class ids; of rows with one id the least text is used
    got = d.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    return fit(got["text"].tolist(), got["y"].to_numpy())


def _apply(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, off in slices(*buffers(batch["text"])):
                value, spans = m.score(data, off)
                found = pa.array([[{"first": a, "last": b, "expected": e} for a, b, e in x] for x in spans], span)
                yield pa.record_batch([batch["id"].slice(i, j - i), pa.array(value), found], names=["id", "score", "spans"])

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id``, ``score`` (0 to 1, higher: likelier toxic) and ``spans``.

    ``spans`` are the significant toxic passages: bytes ``first`` to ``last``
    of the UTF-8 text, and how many as good are expected in a clean text of
    that length.  Null and empty texts have none.  Only the text, all of it, is
    read, whatever the names of other columns.  Ids may be null or repeat; an empty
    table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_apply(shared), "id long, score double, spans array<struct<first: int, last: int, expected: double>>")
