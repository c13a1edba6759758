"""The tables behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import ratio


def with_ani(df: DataFrame, read_length: int) -> DataFrame:
    """Each level's identity."""
    return df.withColumn("ANI", (F.lit(read_length) - F.col("mm")) / F.lit(float(read_length)))


def offsets(lengths: DataFrame, stb: DataFrame) -> DataFrame:
    """Where each scaffold starts in its genome, longest first."""
    d = lengths.join(stb, "scaffold")
    w = Window.partitionBy("genome").orderBy(F.desc("length"), "scaffold").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def windowed(values: DataFrame, offs: DataFrame, keys: list[str], value: str, how: str, windows: int = 100) -> DataFrame:
    """A value along a genome in about ``windows`` windows: ``sum`` over length, ``mean``, or ``density`` of rows.

    Windows include both ends, so a position on a boundary counts in both of its windows.
    """
    total = offs.groupBy("genome").agg(F.sum("length").alias("total"))
    d = values.join(offs.select("scaffold", "genome", "offset"), "scaffold").join(total, "genome")
    d = d.withColumn("w", F.greatest(F.expr(f"total div {windows}"), F.lit(1))).withColumn("at", F.col("position") + F.col("offset"))
    k = F.expr("at div w")
    both = F.when((F.col("at") % F.col("w") == 0) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    g = d.withColumn("window", F.explode(both)).groupBy(*keys, "genome", "window")
    agg = {"sum": F.sum(value) / F.first("w"), "mean": F.avg(value), "density": F.count("*") / F.first("w")}[how]
    return g.agg(agg.cast("double").alias("value"))


def pair_ani_distribution(coverage: DataFrame, lengths: DataFrame, keys: list[str], read_length: int) -> DataFrame:
    """Read pairs at each level, from depths of that level alone."""
    d = coverage.groupBy(*keys, "mm").agg(F.sum("coverage").alias("bases"))
    return with_ani(d.withColumn("pairs", F.col("bases") / F.lit(2.0 * read_length)), read_length).select(*keys, "mm", "ANI", "pairs")


def major_allele_frequencies(snv: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of biallelic sites by the greater of reference and variant frequency, in hundredths from one half."""
    d = snv.where((F.col("allele_count") >= 2) & ~F.col("cryptic")).withColumn("f", F.greatest("var_freq", "ref_freq")).where("f >= 0.5")
    return d.groupBy(*keys, F.floor(F.col("f") * 100 + 1e-9).cast("long").alias("bin")).agg(F.count("*").alias("sites"))


def linkage_decay(linkage: DataFrame, keys: list[str], width: int = 5, least: int = 5) -> DataFrame:
    """Mean r2 and D' by distance, in all bins up to the farthest pair's; null with fewer than ``least`` values."""
    enough = lambda c: F.when(F.count(c) >= least, F.avg(c)).alias(c)
    g = linkage.groupBy(*keys, (F.floor(F.col("distance") / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("pairs"), enough("r2"), enough("d_prime"))
    top = g.groupBy(*keys).agg(F.max("bin").alias("top"))
    every = top.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"), F.lit(width).cast("long"))).alias("bin"))
    return every.join(g, [*keys, "bin"], "left").fillna(0, ["pairs"])


def linkage_by_type(linkage: DataFrame, types: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Mean r2 by distance for pairs of synonymous sites, of non-synonymous ones, and all."""
    t = lambda s: types.select(*keys, F.col("position").alias(f"position_{s}"), F.col("mutation_type").alias(f"type_{s}"))
    d = linkage.join(t("A"), [*keys, "position_A"]).join(t("B"), [*keys, "position_B"])
    same = F.when((F.col("type_A") == F.col("type_B")) & F.col("type_A").isin("S", "N"), F.concat_ws("-", "type_A", "type_B"))
    d = d.withColumn("series", F.explode(F.array_compact(F.array(F.lit("all"), same))))
    return d.groupBy(*keys, "series", "distance").agg(F.count("*").alias("pairs"), F.when(F.count("r2") >= least, F.avg("r2")).alias("r2"))


def read_filtering(report: DataFrame) -> DataFrame:
    """Pairs left after each filter of each scaffold, and their share, most first."""
    names = ["unfiltered_pairs", "pass_pairing_filter", "pass_min_read_ani", "pass_min_mapq", "pass_max_insert", "pass_min_insert", "filtered_pairs"]
    d = report.select("scaffold", F.expr("unfiltered_reads / 2").alias("total_pairs"), *names)
    long = d.unpivot(["scaffold", "total_pairs"], names, "filter", "pairs")
    return long.withColumn("share", ratio(F.col("pairs"), F.col("total_pairs"))).orderBy(F.desc("pairs"), "scaffold", "filter")


def rank_curve(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """A metric's values in descending order with their ranks from 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.where(F.col(value).isNotNull()).select(*keys, tie, value, (F.row_number().over(w) - 1).alias("rank"))
