"""Older measures kept as cross-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import BASES, total
from allelica.operators.genes import in_genes


def forward_fill(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def entropy() -> Column:
    """Entropy of the four base frequencies, in nats; null without reads."""
    t = F.nullif(total(), F.lit(0))
    return reduce(lambda a, b: a + b, [F.when(F.col(b) > 0, -(F.col(b) / t) * F.ln(F.col(b) / t)).otherwise(F.lit(0.0) * t) for b in BASES])


def gene_diversity(clon: DataFrame, genes: DataFrame, keys: list[str], least: int = 120) -> DataFrame:
    """Mean diversity of genes with at least ``least`` counted sites."""
    d = in_genes(clon, genes, ["gene"]).groupBy(*keys, "gene").agg(F.count("*").alias("sites"), (F.lit(1.0) - F.avg("clonality")).alias("pi"))
    return d.where(F.col("sites") >= least)
