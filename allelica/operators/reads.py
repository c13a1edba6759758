"""Read pairs: construction, pairing filters, quality filters and reports.

Reads have ``scaffold, read_name, nm, mapq, length, ref_start, ref_end`` and
``file_order``, the order in which a file lists them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.functions.draws import uniform

#: Insert sizes of what isn't a pair, and of pairs merged over two scaffolds.
NO_INSERT, MERGED_INSERT = -1, -2
PAIRING = ("paired_only", "non_discordant", "all_reads")
DEFAULTS = {"min_read_ani": 0.95, "min_mapq": -1, "max_insert_relative": 3.0, "min_insert": 50}
#: For databases of many genomes: less strict identity, no mismatch levels, genomes of at least this coverage.
DATABASE_MODE = {"min_read_ani": 0.92, "skip_mm": True, "min_genome_coverage": 1}


def pair_reads(reads: DataFrame) -> DataFrame:
    """One row for each (scaffold, read name).

    Mismatches, lengths and reads are summed, mapping quality is the best. The
    insert of exactly two reads runs from the first one's start to the last
    one's end, the other way round if that isn't positive; otherwise it is -1.
    ``start`` and ``stop`` are those of a single read, 0 once reads are paired.
    """
    agg = reads.groupBy("scaffold", F.col("read_name").alias("pair")).agg(
        F.sum("nm").alias("nm"),
        F.max("mapq").alias("mapq"),
        F.sum("length").alias("length"),
        F.count("*").alias("reads"),
        # numbers one by one, not as structs, so that pairs are hashed and not sorted
        F.min_by("ref_start", "file_order").alias("f_start"),
        F.min_by("ref_end", "file_order").alias("f_end"),
        F.max_by("ref_start", "file_order").alias("l_start"),
        F.max_by("ref_end", "file_order").alias("l_end"),
    )
    forward = F.col("l_end") - F.col("f_start")
    insert = F.when(F.col("l_end") > F.col("f_start"), forward).otherwise(F.col("f_end") - F.col("l_start"))
    one = F.col("reads") == 1
    return agg.select(
        "scaffold", "pair", "nm",
        F.when(F.col("reads") == 2, insert).otherwise(F.lit(NO_INSERT)).cast("long").alias("insert_distance"),
        "mapq", "length", "reads",
        F.when(one, F.col("f_start")).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(one, F.col("f_end")).otherwise(F.lit(0)).cast("long").alias("stop"),
    )


def _priority(pairs: DataFrame, priority: DataFrame | None) -> DataFrame:
    if priority is None:
        return pairs.withColumn("priority", F.lit(False))
    p = priority.select(F.col("pair")).distinct().withColumn("priority", F.lit(True))
    return pairs.join(p, "pair", "left").withColumn("priority", F.coalesce("priority", F.lit(False)))


def pairing_filter(pairs: DataFrame, how: str = "paired_only", priority: DataFrame | None = None) -> DataFrame:
    """Keeps pairs by a pairing rule; priority pairs (a table with ``pair``) always stay.

    ``paired_only``: exactly two reads. ``non_discordant``: the name occurs on one
    scaffold only. ``all_reads``: names on several scaffolds are merged into each
    of them: mismatches, lengths, reads and mapping qualities are summed, the
    insert becomes -2.
    """
    p = _priority(pairs, priority)
    if how == "paired_only":
        return p.where((F.col("reads") == 2) | F.col("priority"))
    # a pair has a row for each scaffold, so windows of names stay small
    w = Window.partitionBy("pair")
    p = p.withColumn("_on", F.count("*").over(w))
    if how == "non_discordant":
        return p.where((F.col("_on") == 1) | F.col("priority")).drop("_on")
    if how != "all_reads":
        raise ValueError(f"pairing filter must be one of {PAIRING}")
    several = F.col("_on") > 1
    merged = {c: F.when(several, F.sum(c).over(w)).otherwise(F.col(c)) for c in ("nm", "length", "reads", "mapq")}
    return p.withColumns({**merged, "insert_distance": F.when(several, F.lit(MERGED_INSERT)).otherwise(F.col("insert_distance")).cast("long")}).drop("_on")


def unfiltered_tallies(pairs: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Reads, pairs, singletons and priority reads of each scaffold before any filter."""
    return _priority(pairs, priority).groupBy("scaffold").agg(
        F.sum("reads").alias("unfiltered_reads"),
        F.count_if(F.col("reads") == 2).alias("unfiltered_pairs"),
        F.count_if(F.col("reads") == 1).alias("unfiltered_singletons"),
        F.count_if("priority").alias("unfiltered_priority_reads"),
    )


def insert_limit(paired: DataFrame, relative: float = DEFAULTS["max_insert_relative"]) -> DataFrame:
    """One row: ``max_insert``, the median insert of all two-read pairs times ``relative``."""
    return paired.where("reads = 2").agg((F.percentile("insert_distance", F.lit(0.5)) * F.lit(relative)).alias("max_insert"))


def evaluate(paired: DataFrame, min_read_ani: float = 0.95, min_mapq: int = -1, min_insert: int = 50, max_insert_relative: float = 3.0) -> DataFrame:
    """Adds ``pid`` and a flag for each quality filter; all comparisons are strict.

    Inserts are only judged for two reads with a known insert; a merged pair of two
    reads has insert -2 and so fails the least insert. ``mm`` is the pair's mismatches.
    """
    d = paired.crossJoin(F.broadcast(insert_limit(paired, max_insert_relative)))  # one row
    pid = F.lit(1.0) - F.col("nm") / F.nullif(F.col("length"), F.lit(0))
    judged = (F.col("reads") == 2) & (F.col("insert_distance") != NO_INSERT)
    flags = {
        "pass_min_read_ani": F.coalesce(pid > min_read_ani, F.lit(False)),
        "pass_min_mapq": F.col("mapq") > min_mapq,
        "pass_max_insert": ~judged | F.coalesce(F.col("insert_distance") < F.col("max_insert"), F.lit(True)),
        "pass_min_insert": ~judged | (F.col("insert_distance") > min_insert),
    }
    d = d.withColumn("pid", pid).withColumns(flags)
    return d.withColumn("kept", reduce(lambda a, b: a & b, [F.col(f) for f in flags])).withColumn("mm", F.col("nm")).drop("max_insert")


def filtered_tallies(evaluated: DataFrame) -> DataFrame:
    """How many pairs of each scaffold pass each filter, and all of them."""
    kept = F.col("kept")
    return evaluated.groupBy("scaffold").agg(
        F.count("*").alias("pass_pairing_filter"),
        *[F.count_if(c).alias(c) for c in ("pass_min_read_ani", "pass_min_mapq", "pass_max_insert", "pass_min_insert")],
        F.count_if(kept & (F.col("reads") == 2)).alias("filtered_pairs"),
        F.count_if(kept & (F.col("reads") == 1)).alias("filtered_singletons"),
        F.count_if(kept & F.col("priority")).alias("filtered_priority_reads"),
    )


MEANS = {"mean_mistmaches": "nm", "mean_insert_distance": "insert_distance", "mean_mapq_score": "mapq", "mean_pair_length": "length", "mean_PID": "pid"}


def read_report(pairs: DataFrame, evaluated: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """The report of all scaffolds: tallies, means over pairs that pass the pairing filter, and an ``all_scaffolds`` row.

    In that row numbers are summed, and means and medians are averaged over
    scaffolds, weighted by their pairs.
    """
    means = evaluated.groupBy("scaffold").agg(*[F.avg(c).alias(n) for n, c in MEANS.items()], F.median("insert_distance").alias("median_insert"))
    per = unfiltered_tallies(pairs, priority).join(filtered_tallies(evaluated), "scaffold", "left").join(means, "scaffold", "left")
    counts = [c for c in per.columns if c != "scaffold" and c not in MEANS and c != "median_insert"]
    per = per.fillna(0, counts)
    weight = F.when(F.col("pass_pairing_filter") > 0, F.col("pass_pairing_filter"))
    top = per.agg(
        *[F.sum(c).alias(c) for c in counts],
        *[(F.sum(F.col(c) * weight) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), weight)), F.lit(0))).alias(c) for c in [*MEANS, "median_insert"]],
    ).withColumn("scaffold", F.lit("all_scaffolds"))
    return per.unionByName(top)


def detailed_mapping(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("scaffold", "pair", "nm", "insert_distance", "mapq", "length", "reads", "start", "stop")


def kept_pairs(evaluated: DataFrame, skip_mm: bool = False) -> DataFrame:
    """``scaffold, pair, mm`` of the pairs that pass everything; without mismatch levels mm is 0."""
    return evaluated.where("kept").select("scaffold", "pair", (F.lit(0) if skip_mm else F.col("mm")).cast("int").alias("mm"))


def filter_scaffolds(fasta: DataFrame, report: DataFrame, min_reads: int = 1) -> DataFrame:
    """Scaffolds with at least ``min_reads`` filtered pairs, most first."""
    r = report.where((F.col("scaffold") != "all_scaffolds") & (F.col("filtered_pairs") >= min_reads)).select("scaffold", "filtered_pairs")
    return fasta.join(r, "scaffold").orderBy(F.desc("filtered_pairs"), "scaffold")


def genome_coverage_prefilter(report: DataFrame, lengths: DataFrame, stb: DataFrame, min_coverage: float = 1.0) -> DataFrame:
    """Scaffolds of genomes whose estimated coverage is at least ``min_coverage``; those of no genome go too."""
    r = report.where("scaffold <> 'all_scaffolds'").select("scaffold", (F.col("filtered_pairs") * F.col("mean_pair_length")).alias("bases"))
    d = lengths.join(stb, "scaffold").join(r, "scaffold", "left")
    g = d.groupBy("genome").agg((F.sum(F.coalesce("bases", F.lit(0.0))) / F.nullif(F.sum("length"), F.lit(0))).alias("estimated_coverage"))
    good = g.where(F.col("estimated_coverage") >= min_coverage)
    return d.select("scaffold", "genome", "length").join(good, "genome")


def subsample(reads: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the read names by a hash, so that mates stay together."""
    return reads.where(uniform(seed, "read_name") < fraction)
