"""Pileup: base counts, coverage, clonality and the scaffold table.

Observations have ``scaffold, position, pair, mm, base`` and whatever keys the
caller puts in front (``sample``, ``split_number``, ``ref_base``). Every table
keeps those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import BASES, expected_breadth, ratio, square_sum, total
from allelica.functions.draws import uniform
from allelica.plans.lineage import cut
from allelica.plans.mm import MAX_MM, change, collapse, cumulate, histogram_changes, medians, sums, with_last

WINDOW_LENGTH, MIN_COV, RAREFIED = 10_000, 5, 50


def splits(fasta: DataFrame, window: int = WINDOW_LENGTH) -> DataFrame:
    """Windows of each scaffold (0-based, both ends included); the last takes the remainder."""
    n = (F.expr(f"length div {window}") + 1).cast("int")
    d = fasta.select("scaffold", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("split_number"))
    size = F.expr("length div n")
    end = F.when(F.col("split_number") == F.col("n") - 1, F.col("length") - 1).otherwise((F.col("split_number") + 1) * size - 1)
    return d.select("scaffold", "split_number", (F.col("split_number") * size).cast("long").alias("start"), end.cast("long").alias("end"))


def split_of(position: Column, length: Column, window: int = WINDOW_LENGTH) -> Column:
    """The window that a position lies in."""
    n = F.floor(length / window) + 1
    return F.least(F.floor(position / F.greatest(F.floor(length / n), F.lit(1))), n - 1).cast("int")


def keep_pairs(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observations of kept pairs, with the pair's mismatch level."""
    return obs.drop("mm").join(pairs.select("scaffold", "pair", "mm"), ["scaffold", "pair"])


def site_counts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of A, C, T and G at each (keys, position, mm); other letters don't count.

    A plain sum: Spark aggregates on the map side, so deep sites spread over tasks.
    """
    by = [*keys, "position", "mm"]
    return obs.where(F.col("base").isin(*BASES)).groupBy(*by).agg(*[F.count_if(F.col("base") == b).alias(b) for b in BASES])


def with_reference(sites: DataFrame, sequences: DataFrame, block: int = 1000) -> DataFrame:
    """Adds ``ref_base`` from ``scaffold, sequence``. Sites meet pieces of ``block`` bases, not whole sequences."""
    d = sequences.select("scaffold", F.col("sequence").cast("binary").alias("raw"), F.length("sequence").alias("n")).where("n > 0")
    d = d.select("scaffold", "raw", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {block} as int)"))).alias("_block"))
    d = d.select("scaffold", "_block", F.substring("raw", F.col("_block") * block + 1, F.lit(block)).cast("string").alias("_piece"))
    out = sites.withColumn("_block", F.expr(f"cast(position div {block} as int)")).join(d, ["scaffold", "_block"])
    return out.withColumn("ref_base", F.expr(f"substring(_piece, cast(position % {block} as int) + 1, 1)")).drop("_block", "_piece")


def cumulative(sites: DataFrame, keys: list[str], most: int = MAX_MM) -> DataFrame:
    """Counts over all levels up to each row's own."""
    return cumulate(sites.where(F.col("mm") <= most), [*keys, "position"], BASES)


def coverage(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Depth at each level alone (not cumulative), where there is any."""
    return sites.select(*keys, "position", "mm", total().alias("coverage")).where("coverage > 0")


def dense_coverage(sites: DataFrame, keys: list[str], lengths: DataFrame, level: int = MAX_MM) -> DataFrame:
    """Depth of pairs with at most ``level`` mismatches at every position of every scaffold that has reads, zeros included."""
    c = sites.where(F.col("mm") <= level).groupBy(*keys, "position").agg(F.sum(total()).alias("coverage"))
    every = positions(sites.select(*keys).distinct().join(lengths, "scaffold"), keys)
    return every.join(c, [*keys, "position"], "left").fillna(0, ["coverage"])


def positions(df: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """Every position of each row's ``length``, made block by block, so that no array is as long as a scaffold."""
    blocks = df.select(*keys, "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("_block"))
    first = F.col("_block") * block
    return blocks.select(*keys, F.explode(F.sequence(first, F.least(first + block, F.col("length")) - 1)).alias("position"))


def clonality(cum: DataFrame, keys: list[str], min_cov: int = MIN_COV, rarefied: int = RAREFIED) -> DataFrame:
    """Clonality of cumulative counts at sites of at least ``min_cov`` reads.

    ``clonality_rarefied`` is what ``rarefied`` reads drawn from such a site have
    on average, S + (1 - S) / n: the closed form of resampling, at sites that deep.
    """
    s, t = square_sum(), total()
    rare = F.when(t >= rarefied, s + (F.lit(1.0) - s) / F.lit(float(rarefied)))
    return cum.where(t >= min_cov).select(*keys, "position", "mm", s.alias("clonality"), rare.alias("clonality_rarefied"))


def clonality_at(clon: DataFrame, keys: list[str], level: int = MAX_MM) -> DataFrame:
    """Each position's clonality at the largest level up to ``level``."""
    return collapse(clon, [*keys, "position"], level)


def scaffold_info(
    sites: DataFrame, snvs: DataFrame, lengths: DataFrame, keys: list[str], min_cov: int = MIN_COV, rarefied: int = RAREFIED
) -> DataFrame:
    """One row for each (keys, mm) of each level that has coverage.

    A level is the one before and what changes: sums over positions and histograms
    of values are made of changes, so rows are sites and not sites times levels.  Zero
    depths count in mean, median and deviation by arithmetic, without rows for
    them. The median depth is truncated to an integer; the deviation is that of the
    population, and the standard error that of the sample.  Without counted sites
    ANIs are 0 and diversities null.
    """
    cum = cumulative(sites, keys).withColumn("depth", total()).where("depth > 0")
    cum = cum.select(*keys, "position", "mm", "depth", F.when(F.col("depth") >= min_cov, square_sum()).alias("clon"))
    cum = cum.withColumn("rare", F.when(F.col("depth") >= rarefied, F.col("clon") + (F.lit(1.0) - F.col("clon")) / F.lit(float(rarefied))))
    cum = with_last(cum, [*keys, "position"], ["depth", "clon", "rare"])
    by = [*keys, "mm"]
    # rows are different values, far fewer than sites
    changes = cut(histogram_changes(cum, keys, KINDS))
    d = sums(changes, keys, KINDS).join(reference_changes(snvs, keys), by, "left")
    names = [*[f"{k}_{x}" for k in KINDS for x in "nsq"], *REFERENCE]
    run = Window.partitionBy(*keys).orderBy("mm").rowsBetween(Window.unboundedPreceding, 0)
    d = d.fillna(0, names).withColumns({c: F.sum(c).over(run) for c in names}).join(lengths, "scaffold")
    zeros = d.select(*by, F.lit("depth").alias("kind"), (F.col("length") - F.col("depth_n")).alias("n"))
    d = d.join(medians(changes, keys, changes.select(*by).distinct(), keys, zeros, KINDS), by)
    n = F.col("length")
    mean = F.col("depth_s") / n
    var = F.greatest(F.col("depth_q") / n - mean * mean, F.lit(0.0))
    ani = lambda x: F.coalesce(ratio(F.col("clon_n") - F.col(x), F.col("clon_n")), F.lit(0.0))
    return d.select(
        *keys, "mm", "length",
        (F.col("depth_n") / n).alias("breadth"), mean.alias("coverage"), F.col("depth_median").cast("int").alias("coverage_median"),
        F.sqrt(var).alias("coverage_std"), F.when(n > 1, F.sqrt(var / (n - 1))).alias("coverage_SEM"),
        (F.lit(1.0) - ratio(F.col("clon_s"), F.col("clon_n"))).alias("nucl_diversity"), (F.lit(1.0) - F.col("clon_median")).alias("nucl_diversity_median"),
        (F.lit(1.0) - ratio(F.col("rare_s"), F.col("rare_n"))).alias("nucl_diversity_rarefied"), (F.lit(1.0) - F.col("rare_median")).alias("nucl_diversity_rarefied_median"),
        (F.col("clon_n") / n).alias("breadth_minCov"), (F.col("rare_n") / n).alias("breadth_rarefied"),
        expected_breadth(mean).alias("breadth_expected"), *REFERENCE,
        ani("consensus_divergent_sites").alias("conANI_reference"), ani("population_divergent_sites").alias("popANI_reference"),
    )


#: Values of a site that are counted by histogram.
KINDS = ["depth", "clon", "rare"]
#: Numbers of sites that differ from the reference.
REFERENCE = ["SNS_count", "SNV_count", "divergent_site_count", "consensus_divergent_sites", "population_divergent_sites"]


def reference_changes(snvs: DataFrame, keys: list[str]) -> DataFrame:
    """By how much the numbers of ``REFERENCE`` change at each level, each site being as at the last level that called it."""
    d = with_last(snvs.select(*keys, "position", "mm", "allele_count", "class"), [*keys, "position"], ["allele_count", "class"])
    n, was, c, wc = F.col("allele_count"), F.col("was_allele_count"), F.col("class"), F.col("was_class")
    con, pop = ("SNS", "con_SNV", "pop_SNV"), ("SNS", "pop_SNV")
    parts = [(n == 1, was == 1), (n > 1, was > 1), (n.isNotNull(), was.isNotNull()), (c.isin(*con), wc.isin(*con)), (c.isin(*pop), wc.isin(*pop))]
    return d.groupBy(*keys, "mm").agg(*[F.sum(change(x, y)).alias(name) for name, (x, y) in zip(REFERENCE, parts, strict=True)])


def draws_between(column: str, low: Column, high: Column) -> Column:
    """How many numbers of an array lie in ``[low, high)``."""
    return F.size(F.filter(column, lambda x: (x >= low) & (x < high)))


def rarefy(cum: DataFrame, keys: list[str], n: int = RAREFIED, seed: int = 0) -> DataFrame:
    """Clonality of ``n`` reads drawn from each site deep enough, seeded by the site, whatever the partitioning."""
    d = cum.where(total() >= n)
    u = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: uniform(seed, *keys, "position", "mm", i) * total())
    d = d.withColumn("u", u)
    edges, below = [], F.lit(0).cast("long")
    for b in BASES:
        edges.append((below, below + F.col(b)))
        below = below + F.col(b)
    picks = [draws_between("u", lo, hi) for lo, hi in edges]
    s = sum((p / n) * (p / n) for p in picks)
    return d.select(*keys, "position", "mm", s.alias("clonality_rarefied"))
