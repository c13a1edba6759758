"""How many reads of a base sequencing errors can explain at a depth."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.draws import uniform

FDR, ERROR, DEEPEST = 1e-6, 1e-3, 10_000


def tail(n: int, p: float, k: int) -> float:
    """P(Binomial(n, p) >= k)."""
    out, term = 0.0, math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if k <= n else 0.0
    for i in range(k, n + 1):
        out += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        if term < out * 1e-17:
            break
    return out


@lru_cache
def steps(fdr: float = FDR, error: float = ERROR, deepest: int = DEEPEST) -> tuple[tuple[int, int], ...]:
    """``(depth, reads)``: from that depth on, so many reads of a base are needed.

    k is the least number whose expected count among the three wrong bases is
    below ``fdr``; the model keeps the column before it, k - 1.
    """
    out, k = [], 1
    for n in range(1, deepest):
        while 3 * tail(n, error / 3, k) >= fdr:
            k += 1
        if not out or out[-1][1] != k - 1:
            out.append((n, k - 1))
    return tuple(out)


def from_table(rows: list[tuple[int, list[float]]], fdr: float = FDR) -> tuple[tuple[int, int], ...]:
    """The same from a table of probabilities: for each depth, those of 1, 2, ... wrong bases."""
    out: list[tuple[int, int]] = []
    for depth, probs in sorted(rows):
        k = next((i for i, p in enumerate(probs) if p < fdr), len(probs))
        if not out or out[-1][1] != k:
            out.append((depth, k))
    return tuple(out)


def min_bases(depth: str, model: tuple[tuple[int, int], ...] | None = None) -> Column:
    """Reads needed at ``depth`` (an expression), as nested conditions: nothing to join. Deeper sites than the model's keep its last value."""
    model = model or steps()
    cases = " ".join(f"WHEN {depth} >= {n} THEN {k}" for n, k in reversed(model[1:]))
    return F.expr(f"CASE {cases} ELSE {model[0][1]} END" if cases else f"{model[0][1]}")


def table(spark: SparkSession, deepest: int = DEEPEST, fdr: float = FDR) -> DataFrame:
    """``coverage``, ``min_bases`` for 1 to ``deepest - 1``."""
    d = spark.range(1, deepest).select(F.col("id").alias("coverage"))
    return d.withColumn("min_bases", min_bases("coverage", steps(fdr, ERROR, deepest)))


def _between(column: str, low: float, high: float) -> Column:
    return F.size(F.filter(column, lambda x: (x >= low) & (x < high)))


def simulate(spark: SparkSession, deepest: int, bootstraps: int, error: float = ERROR, seed: int = 0) -> DataFrame:
    """The table of probabilities by simulation: ``coverage``, ``errors``, ``probability``.

    Each bootstrap draws ``coverage`` reads; a read is wrong with probability
    ``error`` and then one of three bases. The probability of i errors is the
    number of bases with at least i, divided by the bootstraps.
    """
    draws = spark.range(1, deepest).select(F.col("id").alias("coverage"))
    draws = draws.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(bootstraps))))
    # a draw's number of errors on each base, by one uniform number for each read
    u = F.transform(F.sequence(F.lit(1), F.col("coverage")), lambda i: uniform(seed, "coverage", "boot", i))
    draws = draws.withColumn("u", u)
    counts = [_between("u", k * error / 3, (k + 1) * error / 3) for k in range(3)]
    got = draws.select("coverage", F.explode(F.array(*counts)).alias("n")).where("n > 0")
    got = got.withColumn("errors", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return got.groupBy("coverage", "errors").agg((F.count("*") / F.lit(bootstraps)).alias("probability"))
