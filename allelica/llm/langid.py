"""Language identification by hierarchical discrimination.

A document's features are the relative frequencies of hashed byte trigrams of
its letters (A-Z lower-cased, other ASCII bytes being one separator).  The
language family is predicted first, by naive Bayes; linear support vector
machines, one for each pair of languages of that family, then vote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import cut, small
from allelica.llm.linear import hinge_dual_dense, likely, sigmoid
from allelica.llm.textblocks import buffers, slices

BITS = 13
#: Training documents of each language, at most, and of all languages, about: with more than 200 languages each has fewer.
PER_LANGUAGE, SAMPLE = 400, 80_000

#: Families of ISO 639-1 codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _b in range(256):
    if _b >= 0x80:
        _FOLD[_b] = _b
    elif chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins, document by document, and how many each document has."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    t = _FOLD[data].astype(np.uint32)
    code = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    inside = np.ones(len(bins), dtype=bool)
    for k in (1, 2):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(bins))]] = False
    # three separators say nothing
    inside &= code != 0x202020
    total = np.concatenate([[0], np.cumsum(inside)])
    at = np.minimum(offsets, len(bins))
    return bins[inside], np.diff(total[at])


class Model:
    """Families, their log-likelihood ratios, and a linear machine for each pair of languages of a family."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({_FAMILY.get(x, f"only {x}") for x in self.langs})
        family = [self.families.index(_FAMILY.get(x, f"only {x}")) for x in self.langs]
        self.members = [[k for k, f in enumerate(family) if f == g] for g in range(len(self.families))]
        self.pairs = [(i, j) for m in self.members for a, i in enumerate(m) for j in m[a + 1 :]]
        at = {x: k for k, x in enumerate(self.langs)}
        y = np.array([at[x] for x in langs], dtype=np.int64)
        rows = len(self.families) + len(self.pairs)
        self.weight, self.bias = np.zeros((1 << BITS, max(rows, 1)), np.float32), np.zeros(max(rows, 1))
        if not len(y):
            return
        of, every = np.array(family)[y], np.zeros(1 << BITS)
        for g in range(len(self.families)):
            total, n = self._sum([texts[k] for k in np.flatnonzero(of == g)])
            self.weight[:, g] = total / n
            every += total
        base = every / len(y) + 1e-7
        for g in range(len(self.families)):
            p = self.weight[:, g] + 0.02 * base
            self.weight[:, g] = np.log(p / p.sum()) - np.log(base / base.sum())
        for k, (i, j) in enumerate(self.pairs, len(self.families)):
            use = np.flatnonzero((y == i) | (y == j))
            sign = np.where(y[use] == j, 1.0, -1.0)
            share = np.array([(sign < 0).mean(), (sign > 0).mean()])
            x = np.concatenate([f for f, _ in self._frequencies([texts[k] for k in use])])
            w, b = hinge_dual_dense(x * 20.0, sign, 5.0 / share[(sign > 0).astype(int)])
            self.weight[:, k], self.bias[k] = w * 20.0, b

    @staticmethod
    def _frequencies(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Relative frequencies of trigrams, a few documents at a time, and how many these are."""
        for _, _, data, off in slices(*buffers(pa.array(texts, pa.string()))):
            bins, n = _grams(data, off)
            edge = np.concatenate([[0], np.cumsum(n)])
            for i in range(0, len(n), 256):
                m = n[i : i + 256]
                doc = np.repeat(np.arange(len(m)), m)
                f = np.bincount((doc << BITS) | bins[edge[i] : edge[i + len(m)]], minlength=len(m) << BITS).reshape(len(m), -1)
                yield (f / np.maximum(m, 1)[:, None]).astype(np.float32), len(m)

    def _sum(self, texts: list[str]) -> tuple[np.ndarray, int]:
        total, n = np.zeros(1 << BITS), 0
        for f, m in self._frequencies(texts):
            total, n = total + f.sum(0, dtype=np.float64), n + m
        return total, n

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (its index) and score of each document."""
        bins, n = _grams(data, offsets)
        docs = len(n)
        value = np.zeros((docs, self.weight.shape[1]))
        has = np.flatnonzero(n)
        if len(has):
            at = (np.cumsum(n) - n)[has]
            for k in range(self.weight.shape[1]):
                value[has, k] = np.add.reduceat(self.weight[:, k][bins].astype(np.float64), at) / n[has]
        nf = len(self.families)
        lift = value[:, :nf] * np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(lift - lift.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        votes = np.zeros((docs, len(self.langs)))
        margin = np.zeros((docs, len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            m = value[:, nf + k] + self.bias[nf + k]
            votes[:, j] += m > 0
            votes[:, i] += m <= 0
            s = sigmoid(2.0 * m)
            margin[:, j] += s
            margin[:, i] += 1 - s
        lang, score = np.zeros(docs, np.int64), np.zeros(docs)
        for g, members in enumerate(self.members):
            d = np.flatnonzero(best == g)
            if not len(d):
                continue
            m = np.array(members)
            # votes first, then the sum of the margins; ties go to the first in order
            rank = votes[np.ix_(d, m)] * 1000 + margin[np.ix_(d, m)]
            win = m[rank.argmax(1)]
            lang[d] = win
            score[d] = p[d, g] * (margin[d, win] / (len(m) - 1) if len(m) > 1 else 1.0)
        return lang, np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, eligible: Column, lang: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` documents of each language among the ``eligible`` rows with a language.

    Of ids with a small hash those with the least are taken, found without reading
    texts, all languages at once.  Documents of all languages together are about
    ``SAMPLE`` at most.  Of rows with one id the least language and text count.
    """
    ok = docs.where(eligible & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    both = ok.select(F.col(id_col).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"))
    sizes = cut(both.groupBy("lang").agg(F.count("*").alias("rows")))
    langs = sizes.count()
    if not langs:
        return Model([], [])
    each = max(1, min(per_language, SAMPLE // langs))
    few = both.join(small(sizes, langs), "lang").where(likely("id", each, F.col("rows"))).select("id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= each).select("id", "lang")
    d = ok.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # bounded: about SAMPLE rows
    got = d.join(F.broadcast(sample), ["id", "lang"]).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row")).select("id", "row.*").toPandas().sort_values("id")
    return Model(got["text"].tolist(), got["lang"].tolist())


def _apply(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            real = batch["real"].to_numpy(zero_copy_only=False)
            for i, j, data, off in slices(*buffers(batch["text"])):
                ok = real[i:j]
                lang, score = m.predict(data, off) if m.langs else (np.zeros(j - i, np.int64), np.zeros(j - i))
                lang = np.where(ok & bool(m.langs), lang, len(m.langs))
                score = np.where(ok, score, 0.0)
                yield pa.record_batch([batch["id"].slice(i, j - i), pa.array(names[lang].tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id``, ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 where the text is null or has no letter, or where the
    model has no languages.  Texts with too few letters for a trigram get the
    most likely family and language without evidence; of languages that tie the
    first in the alphabet wins.  Whole texts count, however long.  Ids may be null
    or repeat; an empty table gives no rows.  Only the text is read, so other
    columns may have any name.
    """
    text = F.col(text_col).cast("string")
    real = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), real.alias("real"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_apply(shared), "id long, lang_pred string, score double")
