"""Quick profile: which genomes are there, from reads alone; and rarefaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.bases import ratio
from allelica.functions.draws import uniform

BIN = 1 << 16


def contig_coverage(reads: DataFrame, lengths: DataFrame, cutoff: float = 0.0, keys: list[str] = (), bin_size: int = BIN) -> DataFrame:
    """Mean depth, covered bases and reads of each scaffold, where covered bases over length exceed ``cutoff``.

    Covered bases come from merging the reads' spans within bins of positions, so
    that a long or deep scaffold spreads over tasks.  ``keys`` of the reads are kept.
    """
    d = reads.select(*keys, "scaffold", "ref_start", "ref_end").join(lengths, "scaffold")
    d = d.select(*keys, "scaffold", "length", F.greatest("ref_start", F.lit(0)).alias("a"), F.least(F.col("ref_end") + 1, F.col("length")).alias("b")).where("a < b")
    # equal spans first; a span is counted in the bin that it starts in
    d = d.groupBy(*keys, "scaffold", "length", "a", "b").agg(F.count("*").alias("n"))
    d = d.withColumn("bin", F.explode(F.sequence(F.expr(f"a div {bin_size}"), F.expr(f"(b - 1) div {bin_size}"))))
    starts = F.col("a") >= F.col("bin") * bin_size
    d = d.withColumns({"bases": F.when(starts, (F.col("b") - F.col("a")) * F.col("n")).otherwise(0), "n": F.when(starts, F.col("n")).otherwise(0), "a": F.greatest("a", F.col("bin") * bin_size), "b": F.least("b", (F.col("bin") + 1) * bin_size)})
    before = Window.partitionBy(*keys, "scaffold", "bin").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("reach", F.coalesce(F.max("b").over(before), F.lit(0)))
    new = F.greatest(F.col("b") - F.greatest("a", "reach"), F.lit(0))
    g = d.groupBy(*keys, "scaffold", "length").agg(F.sum("bases").alias("bases"), F.sum(new).alias("covered_bases"), F.sum("n").alias("reads"))
    return g.where(F.col("covered_bases") / F.col("length") > cutoff).select(*keys, "scaffold", "length", (F.col("bases") / F.col("length")).alias("mean"), "covered_bases", "reads")


def genome_coverage(contigs: DataFrame, lengths: DataFrame, stb: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Breadth, coverage and reads of each genome; scaffolds without reads count with their length."""
    every = stb.join(lengths, "scaffold")
    if keys:
        every = every.crossJoin(F.broadcast(contigs.select(*keys).distinct()))  # the samples or shares compared
    d = every.join(contigs.drop("length"), [*keys, "scaffold"], "left").fillna(0, ["mean", "covered_bases", "reads"])
    n = F.sum("length")
    return d.groupBy(*keys, "genome").agg(n.alias("length"), ratio(F.sum("covered_bases"), n).alias("breadth"), ratio(F.sum(F.col("mean") * F.col("length")), n).alias("coverage"), F.sum("reads").alias("reads"))


def present_scaffolds(genomes: DataFrame, stb: DataFrame, breadth: float = 0.5) -> DataFrame:
    """Scaffolds of genomes with at least ``breadth``."""
    return genomes.where(F.col("breadth") >= breadth).select("genome").join(stb, "genome").select("scaffold", "genome")


def steps(spark, start: int, step: int, end: int, available: int, iterations: int = 1) -> DataFrame:
    """Numbers of reads to draw: from ``start`` on by ``step`` up to ``end`` and to what there is, each several times."""
    last = min(end, available)
    d = spark.range(start, last + 1, step).select(F.col("id").alias("subset"))
    return d.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def rarefaction(reads: DataFrame, lengths: DataFrame, stb: DataFrame, fractions: list[float], seed: int = 0) -> DataFrame:
    """Genome coverage of growing shares of the reads, in one pass; mates stay together, and a share holds the smaller ones."""
    shares = F.array(*[F.lit(float(f)) for f in fractions])
    d = reads.withColumn("u", uniform(seed, "read_name")).withColumn("fraction", F.explode(F.filter(shares, lambda f: f > F.col("u"))))
    return genome_coverage(contig_coverage(d, lengths, keys=["fraction"]), lengths, stb, ["fraction"])


def mean_read_length(reads: DataFrame, first: int = 10_000) -> DataFrame:
    """Mean length of the first reads of the file."""
    return reads.orderBy("file_order").limit(first).agg(F.avg("length").alias("mean_length"))
