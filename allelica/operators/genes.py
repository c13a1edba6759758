"""Gene tables: coverage, diversity, and synonymous and non-synonymous variation.

Positions meet genes by a range join on position bins, so that long scaffolds
with many genes don't compare every site with every gene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.functions.bases import ratio
from allelica.functions.codons import codons, synonymous_sites, translate
from allelica.plans.mm import by_position, carry_forward, change, collapse, cumulate, with_last

#: Positions of a bin. A site meets the genes of its bin, and a gene has a row for each bin that it touches.
BIN = 64


def in_genes(sites: DataFrame, genes: DataFrame, columns: list[str], bin_size: int = BIN) -> DataFrame:
    """Each site with each gene that covers it (both ends included). ``columns`` of the genes are added."""
    g = genes.select("scaffold", *[c for c in columns if c != "scaffold"], F.col("start").alias("_s"), F.col("end").alias("_e"))
    g = g.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / bin_size), F.floor(F.col("_e") / bin_size))))
    d = sites.withColumn("_bin", F.floor(F.col("position") / bin_size)).join(g, ["_bin", "scaffold"])
    return d.where((F.col("position") >= F.col("_s")) & (F.col("position") <= F.col("_e"))).drop("_bin", "_s", "_e")


def with_length(genes: DataFrame) -> DataFrame:
    return genes.withColumn("gene_length", F.abs(F.col("end") - F.col("start")) + 1)


def gene_coverage(coverage: DataFrame, genes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean depth and breadth of each gene at each level of its scaffold; genes without reads have zeros.

    ``coverage`` isn't cumulative over levels; depths and new positions add up.
    """
    levels = coverage.select(*keys, "mm").distinct()
    first = coverage.groupBy(*keys, "position").agg(F.min("mm").alias("first"))
    hit = in_genes(coverage.join(first, by_position([*keys, "position"])), genes, ["gene"])
    part = hit.groupBy(*keys, "gene", "mm").agg(F.sum("coverage").alias("s"), F.count_if(F.col("mm") == F.col("first")).alias("n"))
    every = with_length(genes).select("scaffold", "gene", "gene_length").join(levels, "scaffold")
    low = part.withColumnRenamed("mm", "_mm")
    by = [*keys, "gene"]
    d = every.join(low, by, "left").where(F.col("_mm").isNull() | (F.col("_mm") <= F.col("mm")))
    got = d.groupBy(*by, "mm").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    d = every.join(got, [*by, "mm"], "left").fillna(0, ["s", "n"])
    return d.select(*by, "mm", (F.col("s") / F.col("gene_length")).alias("coverage"), (F.col("n") / F.col("gene_length")).alias("breadth"))


def _totals(sites: DataFrame, parts: dict[str, Column], by: list[str], levels: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of what changes in each gene at each level, from the gene's first level on.

    Sites are those of levels at which they change, not of all levels; what is
    repeated at every level are the genes' totals.
    """
    d = sites.groupBy(*by, "mm").agg(*[c.alias(n) for n, c in parts.items()])
    return carry_forward(cumulate(d, by, list(parts)), by, levels, keys)


def gene_clonality(clon: DataFrame, genes: DataFrame, keys: list[str]) -> DataFrame:
    """Nucleotide diversity and counted breadth of each gene at each level, positions as at the last level up to it."""
    d = with_last(clon.select(*keys, "position", "mm", "clonality"), [*keys, "position"], ["clonality"])
    d = in_genes(d, with_length(genes), ["gene", "gene_length"])
    now, was = F.col("clonality"), F.coalesce("was_clonality", F.lit(0.0))
    parts = {"s": F.sum(now - was), "n": F.count_if(F.col("was_clonality").isNull())}
    d = _totals(d, parts, [*keys, "gene", "gene_length"], clon.select(*keys, "mm").distinct(), keys)
    return d.select(*keys, "gene", "mm", (F.lit(1.0) - F.col("s") / F.col("n")).alias("nucl_diversity"), (F.col("n") / F.col("gene_length")).alias("breadth_minCov"))


def site_numbers(genes: DataFrame) -> DataFrame:
    """Synonymous and non-synonymous sites of each gene; codons with other letters and stops don't count."""
    s = F.aggregate(F.transform(codons(F.col("sequence")), lambda c: F.coalesce(synonymous_sites(c), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    n = F.size(F.filter(codons(F.col("sequence")), lambda c: synonymous_sites(c).isNotNull()))
    return genes.select("gene", s.alias("S_sites"), (n * 3 - s).alias("N_sites"))


def mutations(snv: DataFrame, genes: DataFrame, keys: list[str]) -> DataFrame:
    """Each SNV's last row with its genes and what it does to the protein.

    ``I``: in no gene; ``M``: in several (named in order, with commas); else ``S``
    or ``N``, by the codon with the consensus base, or with the variant base where the
    consensus is the gene's own, read on the gene's strand. ``mutation`` tells amino acids (if they
    differ) and the offset from the gene's start. Rows with one or two alleles only.
    """
    last = collapse(snv.select(*keys, "position", "mm", "ref_base", "con_base", "var_base", "allele_count", "class", "cryptic"), [*keys, "position"])
    last = last.where((F.col("allele_count") > 0) & (F.col("allele_count") <= 2))
    hit = in_genes(last.select(*keys, "position"), genes, ["gene"]).groupBy(*keys, "position").agg(F.array_sort(F.collect_set("gene")).alias("in_genes"))
    d = last.join(hit, by_position([*keys, "position"]), "left")
    one = d.where(F.size("in_genes") == 1).withColumn("gene", F.col("in_genes")[0])
    g = genes.select("scaffold", "gene", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "direction", F.col("sequence").alias("g_seq"))
    one = one.join(g, ["scaffold", "gene"])
    reverse = F.col("direction") == -1
    at = F.when(reverse, F.col("g_end") - F.col("position")).otherwise(F.col("position") - F.col("g_start")).cast("int")
    comp = lambda b: F.when(reverse, F.translate(b, "ACGT", "TGCA")).otherwise(b)
    one = one.withColumn("k", at)
    one = one.withColumn("old", F.expr("substring(g_seq, k - k % 3 + 1, 3)")).withColumn("own", F.expr("substring(g_seq, k + 1, 1)"))
    new = F.when(comp(F.col("con_base")) == F.col("own"), comp(F.col("var_base"))).otherwise(comp(F.col("con_base")))
    one = one.withColumn("new", F.concat(F.expr("substring(old, 1, k % 3)"), new, F.expr("substring(old, k % 3 + 2, 2)")))
    a, b = translate(F.col("old")), translate(F.col("new"))
    offset = (F.col("position") - F.col("g_start")).cast("string")
    n = F.coalesce(a != b, F.lit(False))
    one = one.select(*keys, "position", F.when(n, "N").otherwise("S").alias("t"), F.when(n, F.concat(F.lit("N:"), a, offset, b)).otherwise(F.concat(F.lit("S:"), offset)).alias("m"))
    d = d.join(one, by_position([*keys, "position"]), "left")
    size = F.coalesce(F.size("in_genes"), F.lit(0))
    kind = F.when(size <= 0, F.lit("I")).when(size > 1, F.lit("M")).otherwise(F.col("t"))
    return d.select(*keys, "position", "mm", "ref_base", "con_base", "var_base", "allele_count", "class", "cryptic", F.array_join("in_genes", ",").alias("gene"), kind.alias("mutation_type"), F.when(size == 1, F.col("m")).alias("mutation"))


def gene_snp_counts(snv: DataFrame, types: DataFrame, genes: DataFrame, keys: list[str]) -> DataFrame:
    """SNVs of each gene at each level: SNS have one allele, SNVs exactly two; synonymous and not.

    dN/dS of substitutions and pN/pS of variants are null without synonymous ones.
    """
    d = with_last(snv.select(*keys, "position", "mm", "allele_count"), [*keys, "position"], ["allele_count"])
    d = d.join(types.select(*keys, "position", "mutation_type"), by_position([*keys, "position"]), "left")
    d = in_genes(d, genes, ["gene"])
    parts = {"divergent_site_count": F.count_if(F.col("was_allele_count").isNull())}
    for kind, alleles in (("SNS", 1), ("SNV", 2)):
        more = change(F.col("allele_count") == alleles, F.col("was_allele_count") == alleles)
        parts[f"{kind}_count"] = F.sum(more)
        parts |= {f"{kind}_{t}_count": F.sum(F.when(F.col("mutation_type") == t, more).otherwise(0)) for t in "SN"}
    g = _totals(d, parts, [*keys, "gene"], snv.select(*keys, "mm").distinct(), keys).join(site_numbers(genes), "gene")

    def nonsyn(kind: str):
        return F.when(
            (F.col(f"{kind}_S_count") > 0) & (F.col("S_sites") > 0),
            ratio(F.col(f"{kind}_N_count"), F.col("N_sites")) / ratio(F.col(f"{kind}_S_count"), F.col("S_sites")),
        )

    return g.withColumns({"dNdS_substitutions": nonsyn("SNS"), "pNpS_variants": nonsyn("SNV")})


def gene_info(genes: DataFrame, coverage: DataFrame, clon: DataFrame, counts: DataFrame, keys: list[str], level: int | None = None) -> DataFrame:
    """The gene table at a level: coverage, diversity and SNVs of the genes that have reads."""
    by = [*keys, "gene"]
    c = collapse(coverage, by, level).drop("mm").where("coverage > 0")
    d = c.join(with_length(genes).select("gene", "gene_length"), "gene")
    return d.join(collapse(clon, by, level).drop("mm"), by, "left").join(collapse(counts, by, level).drop("mm"), by, "left")


