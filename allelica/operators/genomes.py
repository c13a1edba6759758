"""Roll-up of scaffold tables to genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import expected_breadth, ratio
from allelica.plans.lineage import cut
from allelica.plans.mm import carry_forward, collapse, cumulate, histogram_changes, medians, sums, with_last

EDGE, SHORTEST = 100, 200


def add_genome(df: DataFrame, stb: DataFrame) -> DataFrame:
    """Each row's genome; null for scaffolds of none. Spark broadcasts the map if it is small."""
    return df.join(stb.select("scaffold", "genome"), "scaffold", "left")


def genome_lengths(lengths: DataFrame, stb: DataFrame) -> DataFrame:
    """Total length of each genome's scaffolds; unknown scaffolds count as nothing."""
    return stb.join(lengths, "scaffold", "left").groupBy("genome").agg(F.sum(F.coalesce("length", F.lit(0))).cast("long").alias("genome_length"))


def genome_scaffold_info(info: DataFrame, stb: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Each genome at each level of the whole table, its scaffolds as at the last level up to it.

    Breadth and coverage are weighted by length and divided by the genome's
    length; diversity is weighted by the counted bases, unknown ones being 0.
    """
    info = cut(info)  # a row for each scaffold and level, read twice
    levels = info.select(*keys, "mm").distinct() if keys else info.select("mm").distinct()
    at = carry_forward(info, [*keys, "scaffold"], levels, keys)
    d = add_genome(at, stb).where(F.col("genome").isNotNull())
    d = d.withColumn("considered", F.col("breadth_minCov") * F.col("length"))
    n = F.col("considered")
    weighted = lambda c: ratio(F.sum(F.coalesce(c, F.lit(0.0)) * n), F.sum(n))
    g = d.groupBy(*keys, "genome", "mm").agg(
        F.count("*").alias("detected_scaffolds"),
        F.sum(F.col("breadth") * F.col("length")).alias("covered"),
        F.sum(F.col("coverage") * F.col("length")).alias("bases"),
        F.sum(n).alias("considered"),
        weighted("nucl_diversity").alias("nucl_diversity"),
        weighted("nucl_diversity_rarefied").alias("nucl_diversity_rarefied"),
        *[F.sum(c).alias(c) for c in ("SNS_count", "SNV_count", "divergent_site_count", "consensus_divergent_sites", "population_divergent_sites")],
    )
    size = stb.groupBy("genome").agg(F.count("*").alias("true_scaffolds"))
    g = g.join(genome_lengths(lengths, stb), "genome").join(size, "genome")
    length = F.col("genome_length")
    ani = lambda c: F.coalesce(ratio(F.col("considered") - F.col(c), F.col("considered")), F.lit(0.0))
    cov = ratio(F.col("bases"), length)
    return g.select(
        *keys, "genome", "mm", "detected_scaffolds", "true_scaffolds", length.alias("length"), ratio(F.col("covered"), length).alias("breadth"), cov.alias("coverage"),
        "nucl_diversity", "nucl_diversity_rarefied", ratio(F.col("considered"), length).alias("breadth_minCov"), expected_breadth(cov).alias("breadth_expected"),
        "SNS_count", "SNV_count", "divergent_site_count", "consensus_divergent_sites", "population_divergent_sites",
        ani("consensus_divergent_sites").alias("conANI_reference"), ani("population_divergent_sites").alias("popANI_reference"),
    )


def placed(lengths: DataFrame, stb: DataFrame, edge: int = EDGE, shortest: int = SHORTEST) -> DataFrame:
    """Where scaffolds lie in their genome, longest first, ends masked and short ones left out: ``scaffold, genome, offset, inner``."""
    d = add_genome(lengths.where(F.col("length") >= shortest), stb).where(F.col("genome").isNotNull()).withColumn("inner", F.col("length") - 2 * edge)
    before = Window.partitionBy("genome").orderBy(F.desc("length"), "scaffold").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("scaffold", "genome", F.coalesce(F.sum("inner").over(before), F.lit(0)).alias("offset"), "inner")


def inner_lengths(places: DataFrame) -> DataFrame:
    return places.groupBy("genome").agg(F.sum("inner").alias("length")).where("length > 0")


def genome_depths(coverage: DataFrame, places: DataFrame, keys: list[str], edge: int = EDGE) -> DataFrame:
    """Depths at a genome's positions (``keys, genome, position, mm, coverage``); what has no row is zero."""
    d = coverage.join(places, "scaffold").where((F.col("position") >= edge) & (F.col("position") < F.col("inner") + edge))
    return d.select(*keys, "genome", (F.col("position") - edge + F.col("offset")).alias("position"), "mm", "coverage")


def masked_stats(coverage: DataFrame, stb: DataFrame, lengths: DataFrame, keys: list[str], edge: int = EDGE, shortest: int = SHORTEST) -> DataFrame:
    """Median, deviation and standard error of a genome's depths at each level of the table, scaffold ends masked and short scaffolds left out.

    Zero depths count, by arithmetic: only covered positions have rows, and a
    level is the one before and what changes.
    """
    places = placed(lengths, stb, edge, shortest)
    by = [*keys, "genome"]
    d = cumulate(genome_depths(coverage, places, keys, edge), [*by, "position"], ["coverage"]).withColumnRenamed("coverage", "depth")
    d = with_last(d, [*by, "position"], ["depth"])
    changes = cut(histogram_changes(d, by, ["depth"]))
    levels = coverage.select(*keys, "mm").distinct()
    every = inner_lengths(places).crossJoin(F.broadcast(levels))  # some dozens of levels for each sample
    run = Window.partitionBy(*by).orderBy("mm").rowsBetween(Window.unboundedPreceding, 0)
    names = ["depth_n", "depth_s", "depth_q"]
    g = every.join(sums(changes, by, ["depth"]), [*by, "mm"], "left").fillna(0, names)
    g = g.withColumns({c: F.sum(c).over(run) for c in names})
    zeros = g.select(*by, "mm", F.lit("depth").alias("kind"), (F.col("length") - F.col("depth_n")).alias("n"))
    middle = medians(changes, by, levels, keys, zeros, ["depth"])
    n = F.col("length")
    mean = F.col("depth_s") / n
    var = F.greatest(F.col("depth_q") / n - mean * mean, F.lit(0.0))
    return g.join(middle, [*by, "mm"]).select(
        *by, "mm", F.col("depth_median").cast("int").alias("coverage_median"), F.sqrt(var).alias("coverage_std"), F.when(n > 1, F.sqrt(var / (n - 1))).alias("coverage_SEM")
    )


def read_rollup(report: DataFrame, stb: DataFrame) -> DataFrame:
    """Read numbers of each genome summed, everything else averaged without weights; names get ``reads_``."""
    d = add_genome(report.where("scaffold <> 'all_scaffolds'"), stb).where(F.col("genome").isNotNull())
    cols = [c for c in report.columns if c != "scaffold"]
    summed = lambda c: c.startswith(("pass_", "unfiltered_", "filtered_"))
    return d.groupBy("genome").agg(*[(F.sum(c) if summed(c) else F.avg(c)).alias(f"reads_{c}") for c in cols])


def linkage_rollup(linkage: DataFrame, stb: DataFrame, keys: list[str]) -> DataFrame:
    """Mean linkage of each genome at each level, pairs as at the last level up to it."""
    pair = [*keys, "scaffold", "position_A", "position_B"]
    levels = linkage.select(*keys, "mm").distinct()
    at = carry_forward(linkage.select(*pair, "mm", "r2", "d_prime", "distance"), pair, levels, keys)
    d = add_genome(at, stb).where(F.col("genome").isNotNull())
    return d.groupBy(*keys, "genome", "mm").agg(
        F.avg("r2").alias("r2_mean"), F.avg("d_prime").alias("d_prime_mean"), F.avg("distance").alias("SNV_distance_mean"), F.count("*").alias("linked_SNV_count")
    )


def genome_info(info: DataFrame, stats: DataFrame | None = None, reads: DataFrame | None = None, linkage: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """All genome tables in one: by genome and level where they have levels, by genome elsewhere."""
    keys = list(keys)
    d = info
    if stats is not None:
        on = [*keys, "genome", *(["mm"] if "mm" in stats.columns else [])]
        d = d.join(stats, on, "left")
    if reads is not None:
        d = d.join(reads, "genome", "left")
    if linkage is not None:
        return d.join(linkage, [*keys, "genome", "mm"], "left")
    none = {c: F.lit(None).cast("double") for c in ("r2_mean", "d_prime_mean", "SNV_distance_mean")}
    return d.withColumns({**none, "linked_SNV_count": F.lit(None).cast("long")})


def selected(info: DataFrame, genomes: list[str] | None = None, breadth: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """Genomes named, or else those of at least ``breadth``."""
    last = collapse(info, [*keys, "genome"])
    chosen = F.col("genome").isin(*genomes) if genomes else F.col("breadth") >= breadth
    return last.where(chosen).select(*keys, "genome").distinct()
