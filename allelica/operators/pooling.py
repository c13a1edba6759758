"""Pooling of SNVs: the counts of every sample at every position that any sample calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import BASES, consensus, runner_up, total
from allelica.operators.variants import nonredundant

CLASSES = ["SNS", "SNV", "con_SNV", "pop_SNV", "DivergentSite"]


def called_positions(snv: DataFrame) -> DataFrame:
    """Non-cryptic calls, each position's last."""
    return nonredundant(snv, ["sample", "scaffold"])


def missing_positions(called: DataFrame) -> DataFrame:
    """For each sample with any call: positions that only others call."""
    own = called.select("sample", "scaffold", "position")
    every = own.select("scaffold", "position").distinct()
    return every.crossJoin(own.select("sample").distinct()).join(own, ["sample", "scaffold", "position"], "left_anti").select("sample", "scaffold", "position")


def counts_at(positions: DataFrame, sites: DataFrame, most: int = 100) -> DataFrame:
    """Counts of pairs with at most ``most`` mismatches at the given positions, zeros where there are none."""
    by = ["sample", "scaffold", "position"]
    c = sites.where(F.col("mm") <= most).join(positions, by, "left_semi").groupBy(*by).agg(*[F.sum(b).alias(b) for b in BASES])
    return positions.join(c, by, "left").fillna(0, BASES)


def pooled_data(called: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts for every sample and position."""
    own = called.select("sample", "scaffold", "position", *BASES)
    return own.unionByName(counts_at(missing_positions(called), sites))


def pooled_info(called: DataFrame, data: DataFrame) -> DataFrame:
    """One row for each position: pooled counts and bases, classes of calls, and in how many samples it is seen."""
    by = ["scaffold", "position"]
    t = total()
    d = data.groupBy(*by).agg(*[F.sum(b).alias(b) for b in BASES], F.count_if(t > 0).alias("sample_detections"), F.count_if(t >= 5).alias("sample_5x_detections"))
    d = d.withColumn("depth", total()).withColumn("con_base", consensus())
    d = d.withColumn("var_base", runner_up(F.col("con_base")))
    c = called.groupBy(*by).agg(
        F.first("ref_base").alias("ref_base"),
        *[F.count_if(F.col("class") == k).alias(f"{k}_count") for k in CLASSES],
        F.array_join(F.array_sort(F.collect_set("con_base")), ",").alias("sample_con_bases"),
    )
    return d.join(c, by)


def encoded(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with integer keys for samples and scaffolds, and the table of keys, by sorted names."""
    names = data.select(F.lit("sample").alias("kind"), F.col("sample").alias("name")).distinct().unionByName(data.select(F.lit("scaffold").alias("kind"), F.col("scaffold").alias("name")).distinct())
    keys = names.withColumn("key", F.dense_rank().over(Window.partitionBy("kind").orderBy("name")) - 1)
    k = lambda kind: keys.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("key").alias(f"{kind}_key"))
    return data.join(k("sample"), "sample").join(k("scaffold"), "scaffold").select("sample_key", "scaffold_key", "position", *BASES), keys
