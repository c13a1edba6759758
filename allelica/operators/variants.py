"""Variant calls at every mismatch level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import BASES, consensus, count_of, present, ratio, runner_up, total
from allelica.operators.nullmodel import min_bases
from allelica.plans.mm import by_position, collapse

MIN_COV, MIN_FREQ = 5, 0.05


def site_class(ref: Column, con: Column, var: Column, alleles: Column, ref_present: Column) -> Column:
    """The kind of a called site."""
    return (
        F.when(~F.coalesce(ref.isin(*BASES), F.lit(False)), F.lit("AmbiguousReference"))
        .when(alleles == 0, F.lit("DivergentSite"))
        .when(alleles == 1, F.lit("SNS"))
        .when(ref == con, F.lit("SNV"))
        .when((ref == var) | F.coalesce(ref_present, F.lit(False)), F.lit("con_SNV"))
        .otherwise(F.lit("pop_SNV"))
    )


def evaluate_sites(cum: DataFrame, min_cov: int = MIN_COV, min_freq: float = MIN_FREQ, model=None) -> DataFrame:
    """Consensus, runner-up and number of alleles of each (site, level) that is deep enough, and whether it is called.

    A site is called if several alleles are present, none is, or the only one isn't the reference's.
    """
    d = cum.withColumn("position_coverage", total()).where(F.col("position_coverage") >= min_cov)
    d = d.withColumn("_need", min_bases("position_coverage", model))
    here = lambda b: present(F.col(b), F.col("position_coverage"), F.col("_need"), min_freq)
    alleles = sum(here(b).cast("int") for b in BASES)
    d = d.withColumn("allele_count", alleles).withColumn("con_base", consensus())
    d = d.withColumn("var_base", runner_up(F.col("con_base")))
    ref = F.col("ref_base")
    called = (F.col("allele_count") != 1) | F.coalesce(F.col("con_base") != ref, F.lit(True))
    ref_here = present(count_of(ref), F.col("position_coverage"), F.col("_need"), min_freq)
    kind = site_class(ref, F.col("con_base"), F.col("var_base"), F.col("allele_count"), ref_here)
    return d.withColumn("called", called).withColumn("class", F.when(F.col("called"), kind)).drop("_need")


def snvs(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Called rows of :func:`evaluate_sites`, with frequencies and the cryptic flag.

    A position is cryptic if, after a level that called it with two or more
    alleles, a later one calls it with one or doesn't call it at all.
    """
    pos = by_position([*keys, "position"])
    before = Window.partitionBy(*pos).orderBy("mm").rowsBetween(Window.unboundedPreceding, -1)
    many = F.coalesce(F.max(F.col("called") & (F.col("allele_count") >= 2)).over(before), F.lit(False))
    lost = many & (~F.col("called") | (F.col("allele_count") == 1))
    d = sites.withColumn("_lost", lost)
    d = d.withColumn("cryptic", F.max("_lost").over(Window.partitionBy(*pos))).where("called")
    freq = lambda base: ratio(count_of(base), F.col("position_coverage"))
    return d.select(
        *[k for k in keys if k != "ref_base"], "position", "mm", "ref_base", "con_base", "var_base", *BASES, "position_coverage", "allele_count", "class", "cryptic",
        freq(F.col("ref_base")).alias("ref_freq"), freq(F.col("con_base")).alias("con_freq"), freq(F.col("var_base")).alias("var_freq"),
    )


def nonredundant(snv: DataFrame, keys: list[str], level: int | None = None) -> DataFrame:
    """Each position's last row, cryptic positions left out."""
    return collapse(snv.where(~F.col("cryptic")), [*keys, "position"], level)


def reference_counts(snv: DataFrame, keys: list[str], level: int | None = None) -> DataFrame:
    """Numbers of differing sites with pairs of at most ``level`` mismatches."""
    last = collapse(snv, [*keys, "position"], level)
    c = F.col("class")
    return last.groupBy(*keys).agg(
        F.count_if(F.col("allele_count") == 1).alias("SNS_count"),
        F.count_if(F.col("allele_count") > 1).alias("SNV_count"),
        F.count("*").alias("divergent_site_count"),
        F.count_if(c.isin("SNS", "con_SNV", "pop_SNV")).alias("consensus_divergent_sites"),
        F.count_if(c.isin("SNS", "pop_SNV")).alias("population_divergent_sites"),
    )
