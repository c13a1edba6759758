"""Linear classifiers fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.llm.textblocks import Words, buffers, reduce_docs, seeds, slices


def bounded_sample(labels: DataFrame, label: str, id_col: str, eligible: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the least hash.

    Labels are 0 or 1; an id with contradicting labels counts as 1.  Only ids
    and labels are read, so that no text moves before the sample is known.
    """
    ok = labels.where(eligible & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    ok = ok.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = {r.y: r.n for r in ok.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = [ok.where(F.col("y") == y).where(likely("id", per_class, F.lit(n.get(y, 0)))).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    return take[0].unionByName(take[1])


def likely(id_col: str, wanted: int, rows: Column) -> Column:
    """Whether an id's hash is small enough for it to be among the ``wanted`` least of so many rows; four times as many are let through.

    What is sorted afterwards doesn't grow with the rows or partitions.
    """
    share = F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (rows <= 4 * wanted) | (share * rows < 4 * wanted)


def hinge_dual(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent.

    ``rows`` lists each example's active features; a feature's value is its
    ``scale``; ``y`` is -1 or 1, ``c`` each example's cost.  Returns the weights
    (not multiplied by ``scale``) and the bias, an always active feature of
    value 1.
    """
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([1.0 + float((scale[r] ** 2).sum()) for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            g = y[i] * (float(w[r] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), c[i])
            d = (new - alpha[i]) * y[i]
            if d:
                most = max(most, abs(d))
                w[r] += d * x
                bias += d
                alpha[i] = new
        if most < 1e-4 * float(c.max()):
            break
    return w, bias


def hinge_dual_dense(x: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 200, seed: int = 7) -> tuple[np.ndarray, float]:
    """:func:`hinge_dual` for a dense matrix."""
    w, bias = np.zeros(x.shape[1]), 0.0
    alpha = np.zeros(len(x))
    norm = 1.0 + (x**2).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (float(w @ x[i]) + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), c[i])
            d = (new - alpha[i]) * y[i]
            if d:
                most = max(most, abs(d))
                w += d * x[i]
                bias += d
                alpha[i] = new
        if most < 1e-4 * float(c.max()):
            break
    return w, bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        g = np.array([(weight * (p - y) * x).sum() + ridge * a, (weight * (p - y)).sum() + ridge * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5.0 / max(1e-12, float(np.abs(d).max())))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def without_copies(texts: list[str | None], agree: int = 6, of: int = 16) -> np.ndarray:
    """Positions of examples that aren't near copies of an earlier one, by minimum hashes of their words.

    Copies in a sample count a document's words many times over.
    """
    sig = []
    for _, _, data, off in slices(*buffers(pa.array(texts, pa.string()))):
        w = Words(data, off, lower=True)
        # pairs of words: single ones are shared by all documents of a language
        pairs = w.hash * np.uint64(3) + np.roll(w.hash, -1)
        sig.append(np.stack([reduce_docs(np.minimum, pairs * m, w.counts, 0) for m in seeds(of, 5)], axis=1))
    seen: dict[tuple[int, int], list[int]] = {}
    keep = []
    table = np.concatenate(sig) if sig else np.zeros((0, of), np.uint64)
    for i, row in enumerate(table):
        near = {j for k, v in enumerate(row.tolist()) for j in seen.get((k, v), ())}
        if any(np.count_nonzero(table[j] == row) >= agree for j in near):
            continue
        keep.append(i)
        for k, v in enumerate(row.tolist()):
            seen.setdefault((k, v), []).append(i)
    return np.array(keep, dtype=np.int64)
