"""Column expressions over the four base counts. Bases are ordered A, C, T, G; ties go to the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ["A", "C", "T", "G"]


def total(prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, [F.col(prefix + b) for b in BASES])


def top_base(counts: list[Column]) -> Column:
    """The base with the greatest count.

    A count and its base's rank are one number, so that the expression stays small
    where other ones contain it.
    """
    most = F.greatest(*[c * 4 + (len(BASES) - 1 - k) for k, c in enumerate(counts)])
    return F.substring(F.lit("".join(reversed(BASES))), (most % 4 + 1).cast("int"), F.lit(1))


def consensus(prefix: str = "") -> Column:
    return top_base([F.col(prefix + b) for b in BASES])


def runner_up(con: Column, prefix: str = "") -> Column:
    """The base with the greatest count once the consensus base's count is zero (so the first of zeros may be the consensus itself)."""
    return top_base([F.when(con == b, F.lit(0)).otherwise(F.col(prefix + b)) for b in BASES])


def count_of(base: Column, prefix: str = "") -> Column:
    """The count of a named base; null for any other name."""
    out = F.lit(None).cast("long")
    for b in BASES:
        out = F.when(base == b, F.col(prefix + b)).otherwise(out)
    return out


def present(count: Column, depth: Column, min_bases: Column, min_freq: float) -> Column:
    """Whether a base is more than sequencing error: enough reads and frequency."""
    return (count >= min_bases) & (count / F.nullif(depth, F.lit(0)) >= F.lit(min_freq))


def square_sum(prefix: str = "") -> Column:
    """Clonality: the sum of squared base frequencies."""
    t = F.nullif(total(prefix), F.lit(0))
    return reduce(lambda a, b: a + b, [(F.col(prefix + b) / t) * (F.col(prefix + b) / t) for b in BASES])


def expected_breadth(coverage: Column) -> Column:
    """Breadth expected of reads placed at random."""
    return F.lit(1.0) - F.exp(F.lit(-0.883) * coverage)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))
