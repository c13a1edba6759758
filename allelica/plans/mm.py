"""Mismatch levels: level m uses the read pairs with at most m mismatches.

A level exists at a key only where a pair of exactly that many mismatches is;
later levels inherit the last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_MM = 100


def by_position(keys: list[str]) -> list[str]:
    """The keys with the position first. Sorts compare eight bytes of the first key, which names of samples and scaffolds share."""
    return sorted(keys, key=lambda k: k != "position")


def collapse(df: DataFrame, keys: list[str], level: int | None = None, mm: str = "mm") -> DataFrame:
    """The last row of each key at or below ``level``; all columns. An aggregation, not a sort."""
    if level is not None:
        df = df.where(F.col(mm) <= level)
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), mm).alias("_last"))
    return out.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*df.columns)


def cumulate(df: DataFrame, keys: list[str], values: list[str], mm: str = "mm") -> DataFrame:
    """Running sums of ``values`` over ascending levels."""
    w = Window.partitionBy(*by_position(keys)).orderBy(mm).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({v: F.sum(v).over(w) for v in values})


def carry_forward(df: DataFrame, keys: list[str], levels: DataFrame, on: list[str], mm: str = "mm") -> DataFrame:
    """Repeats each row at every level of ``levels`` from its own up to the next row's of the same key.

    ``levels`` has the columns ``on`` and ``mm`` (distinct, a few dozen for each ``on``).
    """
    nxt = F.lead(mm).over(Window.partitionBy(*by_position(keys)).orderBy(mm))
    left = df.withColumn("_next", nxt)
    right = levels.select(*[F.col(c).alias(f"_l_{c}") for c in on], F.col(mm).alias("_level"))
    cond = (F.col("_level") >= F.col(mm)) & (F.col("_next").isNull() | (F.col("_level") < F.col("_next")))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_l_{c}"))
    out = left.join(right, cond)
    return out.withColumn(mm, F.col("_level")).select(*df.columns)


def with_last(df: DataFrame, keys: list[str], values: list[str], mm: str = "mm") -> DataFrame:
    """Adds each row's ``values`` at the level before, as ``was_<value>``; null at the first."""
    w = Window.partitionBy(*by_position(keys)).orderBy(mm)
    return df.withColumns({f"was_{v}": F.lag(v).over(w) for v in values})


def change(now: Column, was: Column) -> Column:
    """What a value adds at its level, and its last one takes off; nulls count as nothing."""
    now, was = (F.coalesce(c.cast("long") if isinstance(c, Column) else c, F.lit(0)) for c in (now, was))
    return now - was


def histogram_changes(df: DataFrame, keys: list[str], values: list[str], mm: str = "mm") -> DataFrame:
    """How many more rows have each value at each level than at the level before: ``keys, mm, kind, value, n``.

    ``kind`` is the value's name; ``df`` comes from :func:`with_last`.
    """
    one = lambda v, c, n: F.struct(F.lit(v).alias("kind"), F.col(c).cast("double").alias("value"), F.lit(n).alias("n"))
    each = F.array(*[x for v in values for x in (one(v, v, 1), one(v, f"was_{v}", -1))])
    d = df.select(*keys, mm, F.explode(each).alias("x")).select(*keys, mm, "x.*").where("value is not null")
    return d.groupBy(*keys, mm, "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def sums(changes: DataFrame, keys: list[str], kinds: list[str], mm: str = "mm") -> DataFrame:
    """What :func:`histogram_changes` adds up to: changes of number (``<kind>_n``), sum (``_s``) and sum of squares (``_q``) of each kind of value."""
    n, v = F.col("n"), F.col("value")
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    return changes.groupBy(*keys, mm).agg(*[f for k in kinds for f in (of(k, n).alias(f"{k}_n"), of(k, n * v).alias(f"{k}_s"), of(k, n * v * v).alias(f"{k}_q"))])


def medians(changes: DataFrame, keys: list[str], levels: DataFrame, on: list[str], zeros: DataFrame, kinds: list[str], mm: str = "mm") -> DataFrame:
    """The median of each kind of value at each level, as ``<kind>_median``.

    ``zeros`` has rows ``keys, mm, kind, n`` that count as value 0.  Rows are different
    values, not positions.
    """
    by = [*keys, "kind", "value"]
    d = cumulate(changes, by, ["n"], mm)
    d = carry_forward(d, by, levels, on, mm).where("n > 0").select(*keys, mm, "kind", "value", "n")
    d = d.unionByName(zeros.where("n > 0").select(*keys, mm, "kind", F.lit(0.0).alias("value"), "n"))
    return d.groupBy(*keys, mm).agg(*[F.expr(f"percentile(if(kind = '{k}', value, null), 0.5D, n)").alias(f"{k}_median") for k in kinds])


def ani_to_mm(ani: float, read_length: int) -> int:
    """The level that keeps pairs of at least ``ani`` identity; an ANI above 1 is in percent. Halves round to even."""
    share = ani / 100 if ani > 1 else ani
    return round(read_length - read_length * share)
