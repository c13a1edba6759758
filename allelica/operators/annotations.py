"""Gene annotations: totals and tables by sample, annotation and genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.functions.bases import ratio

MIN_GENE_BREADTH, MIN_GENOME_BREADTH = 0.8, 0.5


def detected_genes(gene_info: DataFrame, genome_info: DataFrame, min_gene: float = MIN_GENE_BREADTH, min_genome: float = MIN_GENOME_BREADTH) -> DataFrame:
    """Genes with coverage and enough breadth, of genomes with enough breadth."""
    good = genome_info.where(F.col("breadth") >= min_genome).select("sample", "genome").distinct()
    return gene_info.where((F.col("coverage") > 0) & (F.col("breadth") >= min_gene)).join(good, ["sample", "genome"], "left_semi")


def sample_totals(detected: DataFrame, annotations: DataFrame) -> DataFrame:
    """Detected genes and genomes, bases on genes, annotations and annotated genes of each sample."""
    t = detected.groupBy("sample").agg(
        F.count_distinct("gene").alias("detected_genes"), F.count_distinct("genome").alias("detected_genomes"),
        F.sum(F.floor(F.col("gene_length") * F.col("coverage"))).cast("long").alias("bases_mapped_to_genes"),
    )
    a = detected.join(annotations.distinct(), "gene").groupBy("sample").agg(F.count_distinct("anno").alias("detected_annotations"), F.count_distinct("gene").alias("detected_genes_with_anno"))
    return t.join(a, "sample", "left").fillna(0, ["detected_annotations", "detected_genes_with_anno"])


def long_table(detected: DataFrame, annotations: DataFrame) -> DataFrame:
    """Genes and bases of each (sample, annotation, genome)."""
    d = detected.join(annotations.distinct(), "gene")
    return d.groupBy("sample", "anno", "genome").agg(F.count("*").alias("genes"), F.sum(F.floor(F.col("gene_length") * F.col("coverage"))).cast("long").alias("bases"))


def by_annotation(long: DataFrame) -> DataFrame:
    return long.groupBy("sample", "anno").agg(F.sum("genes").alias("genes"), F.sum("bases").alias("bases"), F.count("*").alias("genomes"))


def wide_table(long: DataFrame, value: str, samples: DataFrame, annos: list[str] | None = None) -> DataFrame:
    """One column for each annotation; samples without any stay, with zeros."""
    d = by_annotation(long)
    p = d.groupBy("sample").pivot("anno", annos) if annos else d.groupBy("sample").pivot("anno")
    return samples.select("sample").distinct().join(p.agg(F.sum(value)), "sample", "left").fillna(0)


def fraction_table(long: DataFrame, totals: DataFrame) -> DataFrame:
    """Genes, bases and genomes of each annotation as shares of the sample's totals, 0 where those are."""
    d = by_annotation(long).join(totals, "sample")
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return d.select(
        "sample", "anno", share("genes", "detected_genes").alias("genes_fraction"), share("bases", "bases_mapped_to_genes").alias("bases_fraction"), share("genomes", "detected_genomes").alias("genomes_fraction")
    )
