"""Comparison of samples: coverage overlap, consensus and population identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import BASES, present, ratio
from allelica.operators.nullmodel import min_bases
from allelica.plans.lineage import cut
from allelica.plans.mm import collapse, cumulate

MIN_COV, MIN_FREQ = 5, 0.05
PAIR = ["scaffold", "name1", "name2"]
#: What a comparison takes of a call.
CALL = ["ref_base", "con_base", "var_base", "allele_count", *BASES]


def shared_scaffolds(coverage: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Scaffolds that at least two samples have; ``only`` restricts them."""
    d = coverage.select("sample", "scaffold").distinct().groupBy("scaffold").agg(F.count("*").alias("samples")).where("samples >= 2")
    return d if only is None else d.join(only.select("scaffold").distinct(), "scaffold", "left_semi")


def database_mode(genome_info: DataFrame, stb: DataFrame, breadth: float = 0.5) -> DataFrame:
    """Scaffolds of each sample's genomes with enough counted breadth."""
    g = collapse(genome_info, ["sample", "genome"]).where(F.col("breadth_minCov") >= breadth)
    return g.select("sample", "genome").join(stb, "genome").select("sample", "scaffold")


def sample_pairs(coverage: DataFrame, samples: DataFrame | None = None, self_comparisons: bool = False) -> DataFrame:
    """Ordered pairs of samples for each scaffold. ``samples`` has ``sample`` and ``ord``; by default names decide."""
    d = coverage.select("sample", "scaffold").distinct()
    d = d.withColumn("ord", F.col("sample")) if samples is None else d.join(samples, "sample")
    a = d.select("scaffold", F.col("sample").alias("name1"), F.col("ord").alias("o1"))
    b = d.select("scaffold", F.col("sample").alias("name2"), F.col("ord").alias("o2"))
    cond = F.col("o1") <= F.col("o2") if self_comparisons else F.col("o1") < F.col("o2")
    return a.join(b, "scaffold").where(cond).select("scaffold", "name1", "name2")


def pair_levels(coverage: DataFrame, pairs: DataFrame) -> DataFrame:
    """Levels of each pair: those that either sample has on the scaffold."""
    levels = coverage.select("sample", "scaffold", "mm").distinct()
    one, two = (pairs.join(levels.withColumnRenamed("sample", n), [n, "scaffold"]).select(*PAIR, "mm") for n in ("name1", "name2"))
    return one.unionByName(two).distinct()


def overlap_sites(coverage: DataFrame, table: DataFrame | None = None, min_cov: int = MIN_COV) -> DataFrame:
    """Each sample's positions that it covers enough: from which level on, and its call in ``table``, if there is one.

    Depth doesn't fall with levels, so a position has one row, whatever the number of levels and pairs.
    """
    w = Window.partitionBy("position", "sample", "scaffold").orderBy("mm")
    depth = F.sum("coverage").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = coverage.select("sample", "scaffold", "position", F.col("mm").alias("from"), "coverage", depth.alias("_depth"))
    d = d.where((F.col("_depth") >= min_cov) & (F.col("_depth") - F.col("coverage") < min_cov)).select("sample", "scaffold", "position", "from")
    return d if table is None else d.join(table.select("sample", "scaffold", "position", *CALL), ["position", "sample", "scaffold"], "left")


def paired_sites(sites: DataFrame, columns: list[str] = ()) -> DataFrame:
    """Each two samples at each position that both cover enough, in both orders and with themselves, ``mm`` the level from which on; ``columns`` of either get its number."""
    side = lambda k: sites.select("scaffold", "position", F.col("sample").alias(f"name{k}"), F.col("from").alias(f"from_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    d = side(1).join(side(2), ["position", "scaffold"])
    return d.withColumn("mm", F.greatest("from_1", "from_2")).drop("from_1", "from_2")


def coverage_overlap(sites: DataFrame, levels: DataFrame, min_freq: float = MIN_FREQ) -> DataFrame:
    """Positions both cover over positions either covers, at each level, and how many of them differ by consensus and by population.

    Positions count where they begin to, and add up over levels. With sites of no calls there are no differences.
    """
    calls = "con_base" in sites.columns
    # numbers don't depend on the order of a pair
    d = paired_sites(sites, CALL if calls else []).where("name1 <= name2")
    d = with_snps(d, min_freq) if calls else d.withColumns({"consensus_SNP": F.lit(False), "population_SNP": F.lit(False)})
    both = d.groupBy("scaffold", F.col("name1").alias("_low"), F.col("name2").alias("_high"), "mm").agg(F.count("*").alias("both"), F.count_if("consensus_SNP").alias("consensus_SNPs"), F.count_if("population_SNP").alias("population_SNPs"))
    own, pairs, none = sites.groupBy("scaffold", "sample", F.col("from").alias("mm")).agg(F.count("*").alias("own")), levels.select(*PAIR).distinct(), F.lit(0).cast("long")
    names = ["both", "own", "consensus_SNPs", "population_SNPs"]
    row = lambda df: df.select(*PAIR, "mm", *[c if c in df.columns else none.alias(c) for c in names])
    named = pairs.withColumns({"_low": F.least("name1", "name2"), "_high": F.greatest("name1", "name2")})
    changes = row(levels).unionByName(row(both.join(named, ["scaffold", "_low", "_high"])))
    for n in ("name1", "name2"):
        changes = changes.unionByName(row(pairs.join(own.withColumnRenamed("sample", n), ["scaffold", n])))
    d = cumulate(changes.groupBy(*PAIR, "mm").agg(*[F.sum(c).alias(c) for c in names]), PAIR, names)
    either = F.col("own") - F.col("both")
    return d.where(either > 0).select(*PAIR, "mm", F.col("both").alias("compared_bases_count"), F.coalesce(ratio(F.col("both"), either), F.lit(0.0)).alias("coverage_overlap"), *names[2:])


def snp_table(snv: DataFrame) -> DataFrame:
    """Each sample's last call at each position, whatever its level, cryptic ones included."""
    cols = ["sample", "scaffold", "position", "mm", "ref_base", "con_base", "var_base", "allele_count", *BASES]
    return collapse(snv.select(*cols), ["sample", "scaffold", "position"]).drop("mm")


def _present(base: Column, side: int, min_freq: float) -> Column:
    return F.coalesce(present(count_of_side(base, side), F.col(f"depth_{side}"), F.col(f"need_{side}"), min_freq), F.lit(False))


def with_needs(d: DataFrame) -> DataFrame:
    """Adds each side's depth, and the reads that a base needs to be present."""
    d = d.withColumns({f"depth_{k}": F.expr(" + ".join(f"{b}_{k}" for b in BASES)) for k in (1, 2)})
    return d.withColumns({f"need_{k}": min_bases(f"depth_{k}") for k in (1, 2)})


def count_of_side(base: Column, side: int) -> Column:
    out = F.lit(None).cast("long")
    for b in BASES:
        out = F.when(base == b, F.col(f"{b}_{side}")).otherwise(out)
    return out


def consensus_snp() -> Column:
    """Consensus bases differ; where only one sample has a call, its consensus isn't the reference."""
    has1, has2 = F.col("con_base_1").isNotNull(), F.col("con_base_2").isNotNull()
    one = F.coalesce(F.col("con_base_1") != F.col("ref_base_1"), F.lit(False))
    two = F.coalesce(F.col("con_base_2") != F.col("ref_base_2"), F.lit(False))
    return F.when(has1 & has2, F.col("con_base_1") != F.col("con_base_2")).when(has1, one).otherwise(two)


def population_snp(min_freq: float = MIN_FREQ) -> Column:
    """No allele is shared: neither consensus is present in the other sample, and not both have the same variant.

    Where only one sample has a call, the other is taken to have the reference base.  Expects
    ``depth_1``, ``need_1`` and so on, see :func:`with_needs`.
    """
    has1, has2 = F.col("con_base_1").isNotNull(), F.col("con_base_2").isNotNull()
    only = lambda k: ~_present(F.col(f"ref_base_{k}"), k, min_freq)
    same_var = (F.col("allele_count_1") > 1) & (F.col("allele_count_2") > 1) & (F.col("var_base_1") == F.col("var_base_2"))
    both = ~(_present(F.col("con_base_1"), 2, min_freq) | _present(F.col("con_base_2"), 1, min_freq) | F.coalesce(same_var, F.lit(False)))
    return (
        F.when(has1 & has2, F.when(F.col("con_base_1") == F.col("con_base_2"), F.lit(False)).otherwise(both))
        .when(has1, consensus_snp() & only(1))
        .otherwise(consensus_snp() & only(2))
    )


def with_snps(paired: DataFrame, min_freq: float = MIN_FREQ) -> DataFrame:
    """Adds ``consensus_SNP`` and ``population_SNP``; sites that neither sample has a call of don't differ."""
    called = F.col("con_base_1").isNotNull() | F.col("con_base_2").isNotNull()
    d = with_needs(paired)
    return d.withColumns({"consensus_SNP": F.coalesce(called & consensus_snp(), F.lit(False)), "population_SNP": F.coalesce(called & population_snp(min_freq), F.lit(False))})


def snp_differences(sites: DataFrame, levels: DataFrame, min_freq: float = MIN_FREQ) -> DataFrame:
    """Positions covered by both that differ by consensus or by population, at each level from the one on from which both cover them."""
    d = paired_sites(sites, CALL).where(F.col("con_base_1").isNotNull() | F.col("con_base_2").isNotNull())
    d = with_snps(d, min_freq).where("consensus_SNP or population_SNP").withColumnRenamed("mm", "_from")
    each = [F.col(f"{c}_{k}") for k in (1, 2) for c in ("con_base", "ref_base", "var_base")]
    depth = [F.col(f"depth_{k}").alias(f"position_coverage_{k}") for k in (1, 2)]
    d = d.join(levels, PAIR).where(F.col("mm") >= F.col("_from"))
    return d.select(*PAIR, "mm", "position", *each, *depth, *[f"{b}_{k}" for k in (1, 2) for b in BASES], "consensus_SNP", "population_SNP")


def scaffold_comparison(overlap: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each pair, scaffold and level, also without any SNP; ANIs are null without compared bases."""
    d = overlap.join(lengths, "scaffold")
    bases = F.col("compared_bases_count")
    return d.select(
        *PAIR, "mm", "length", "coverage_overlap", "compared_bases_count", (bases / F.col("length")).alias("percent_genome_compared"), "consensus_SNPs", "population_SNPs",
        ratio(bases - F.col("consensus_SNPs"), bases).alias("conANI"), ratio(bases - F.col("population_SNPs"), bases).alias("popANI"),
    )


def genome_comparison(comparison: DataFrame, stb: DataFrame, genome_lengths: DataFrame, mm_level: bool = False) -> DataFrame:
    """Comparisons of genomes: means weighted by compared bases, null without any."""
    by = ["genome", "name1", "name2", *(["mm"] if mm_level else [])]
    d = comparison if mm_level else collapse(comparison, ["scaffold", "name1", "name2"])
    d = d.join(stb, "scaffold")
    n = F.col("compared_bases_count")
    mean = lambda c: ratio(F.sum(F.col(c) * n), F.sum(n)).alias(c)
    g = d.groupBy(*by).agg(mean("coverage_overlap"), mean("popANI"), mean("conANI"), *[F.sum(c).alias(c) for c in ("compared_bases_count", "consensus_SNPs", "population_SNPs")])
    return g.join(genome_lengths, "genome").withColumn("percent_compared", ratio(F.col("compared_bases_count"), F.col("genome_length"))).drop("genome_length")


def symmetric(comparison: DataFrame, value: str, group: list[str]) -> DataFrame:
    """All ordered pairs of samples of each group: the mean of both directions, 1 with itself, null if never compared."""
    a = cut(comparison.select(*group, "name1", "name2", value))  # read three times
    both = a.unionByName(a.select(*group, F.col("name1").alias("name2"), F.col("name2").alias("name1"), value))
    mean = both.groupBy(*group, "name1", "name2").agg(F.avg(value).alias(value))
    names = both.select(*group, "name1").distinct()
    every = names.join(names.withColumnRenamed("name1", "name2"), group)
    d = every.join(mean, [*group, "name1", "name2"], "left")
    return d.withColumn(value, F.when(F.col("name1") == F.col("name2"), F.lit(1.0)).otherwise(F.col(value)))


def clusterable(genomes: DataFrame) -> DataFrame:
    """Genomes all of whose comparisons have compared bases."""
    bad = genomes.where("compared_bases_count = 0").select("genome").distinct()
    return genomes.join(bad, "genome", "left_anti")


def scaffold_similarity(coverage: DataFrame) -> DataFrame:
    """Jaccard similarity of the sample sets of scaffolds that share a sample."""
    d = coverage.select("sample", "scaffold").distinct()
    n = d.groupBy("scaffold").agg(F.count("*").alias("n"))
    a, b = d.withColumnRenamed("scaffold", "scaffold1"), d.withColumnRenamed("scaffold", "scaffold2")
    both = a.join(b, "sample").where("scaffold1 < scaffold2").groupBy("scaffold1", "scaffold2").agg(F.count("*").alias("both"))
    out = both.join(n.toDF("scaffold1", "n1"), "scaffold1").join(n.toDF("scaffold2", "n2"), "scaffold2")
    return out.select("scaffold1", "scaffold2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("similarity"))
