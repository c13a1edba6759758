"""Linkage disequilibrium between polymorphic sites that share read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.functions.bases import BASES
from allelica.functions.draws import uniform
from allelica.operators.pileup import draws_between
from allelica.plans.mm import collapse, cumulate

MIN_SNP = 20


def polymorphic(snv: DataFrame, keys: list[str]) -> DataFrame:
    """Sites with two or more alleles at some level, and the consensus and variant bases they had."""
    return snv.where("allele_count >= 2").groupBy(*keys, "position").agg(
        F.array_distinct(F.flatten(F.collect_set(F.array("con_base", "var_base")))).alias("bases")
    )


def linked_observations(obs: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Observations at polymorphic sites that show one of the site's bases."""
    d = obs.join(sites, [*keys, "position"]).where(F.array_contains("bases", F.col("base")))
    return d.select(*keys, "position", "pair", "mm", "base")


def co_occurrence(linked: DataFrame, keys: list[str]) -> DataFrame:
    """How often each two sites of one window show each combination of bases in one pair.

    A pair's sites come together once, sorted, and each meets those after it.  Windows of ``keys``
    bound their number, whatever the length of reads.
    """
    by = [*keys, "pair", "mm"]
    d = linked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("position", "base"))).alias("own")).where(F.size("own") > 1)
    d = d.select(*keys, "mm", "own", F.posexplode("own").alias("at", "a"))
    d = d.select(*keys, "mm", F.col("a.position").alias("position_A"), F.col("a.base").alias("base_A"), F.explode(F.expr("slice(own, at + 2, size(own))")).alias("b"))
    d = d.select(*keys, "mm", "position_A", F.col("b.position").alias("position_B"), "base_A", F.col("b.base").alias("base_B")).where("position_A < position_B")
    return d.groupBy(*keys, "position_A", "position_B", "mm", "base_A", "base_B").agg(F.count("*").alias("n"))


def _alleles(cum: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The two most frequent bases of a site at a level, and their counts; ties in base order."""
    order = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate(BASES)]))
    d = cum.withColumn("o", order)
    return d.select(
        *keys, F.col("position").alias(f"position_{side}"), "mm", F.col("o")[0]["b"].alias(f"major_{side}"), F.col("o")[1]["b"].alias(f"minor_{side}"),
        (-F.col("o")[1]["n"]).alias(f"least_{side}"), sum(F.col(b) for b in BASES).alias(f"depth_{side}"),
    )


def linkage(pairs: DataFrame, sites: DataFrame, keys: list[str], min_snp: int = MIN_SNP) -> DataFrame:
    """r2 and D' of each two sites at each level that both sites and their links have.

    Links accumulate over levels. Needed: ``min_snp`` reads over both sites, four
    alleles that occur, and more than ``min_snp`` links between them. r2 is null
    if an allele is missing from the links, D' where there is no disequilibrium.
    ``counts`` are the links of major-major, major-minor, minor-major and
    minor-minor alleles.
    """
    by = [*keys, "position_A", "position_B"]
    combos = [f"c_{x}{y}" for x in BASES for y in BASES]
    wide = pairs.groupBy(*by, "mm").agg(*[F.sum(F.when((F.col("base_A") == c[2]) & (F.col("base_B") == c[3]), F.col("n")).otherwise(0)).alias(c) for c in combos])
    wide = cumulate(wide, by, combos)
    cum = cumulate(sites, [*keys, "position"], BASES)
    d = wide.join(_alleles(cum, keys, "A"), [*keys, "position_A", "mm"]).join(_alleles(cum, keys, "B"), [*keys, "position_B", "mm"])
    # both alleles of both sites occur; the major one does if the minor one does
    d = d.where((F.col("depth_A") + F.col("depth_B") >= min_snp) & (F.least("least_A", "least_B") > 0))
    pick = lambda x, y: sum(F.when((x == c[2]) & (y == c[3]), F.col(c)).otherwise(0) for c in combos).cast("long")
    counts = [pick(F.col(f"{x}_A"), F.col(f"{y}_B")) for x in ("major", "minor") for y in ("major", "minor")]
    d = d.withColumn("counts", F.array(*counts))
    n = [F.col("counts")[k] for k in range(4)]
    d = d.withColumn("total", sum(n)).where(F.col("total") > min_snp)
    r2, dp = disequilibrium(*n)
    return d.select(
        *by, "mm", "major_A", "minor_A", "major_B", "minor_B", "counts", "total",
        (F.col("position_B") - F.col("position_A")).alias("distance"), r2.alias("r2"), dp.alias("d_prime"),
    )


def disequilibrium(ab: Column, ab_: Column, a_b: Column, a_b_: Column) -> tuple[Column, Column]:
    """r2 and D' from the four numbers of links (AB, Ab, aB, ab)."""
    t = F.nullif(ab + ab_ + a_b + a_b_, F.lit(0))
    pab, pa, pb = ab / t, (ab + ab_) / t, (ab + a_b) / t
    qa, qb = F.lit(1.0) - pa, F.lit(1.0) - pb
    d = pab - pa * pb
    below = F.nullif(pa * qa * pb * qb, F.lit(0.0))
    none = (ab + ab_ == 0) | (a_b + a_b_ == 0) | (ab + a_b == 0) | (ab_ + a_b_ == 0)
    r2 = F.when(~none, d * d / below)
    # exact in integers: D has the sign of ab * ab' - ab_ * a_b
    sign = ab * a_b_ - ab_ * a_b
    low, high = F.greatest(-pa * pb, -qa * qb), F.least(pa * qb, qa * pb)
    dp = F.when(sign < 0, d / F.nullif(low, F.lit(0.0))).when(sign > 0, d / F.nullif(high, F.lit(0.0)))
    return r2, dp


def published(table: DataFrame) -> DataFrame:
    """The table with the names that users know: alleles in upper case are the major ones."""
    names = {"major_A": "allele_A", "minor_A": "allele_a", "major_B": "allele_B", "minor_B": "allele_b"}
    rest = [c for c in table.columns if c not in names and c != "counts"]
    counts = [F.col("counts")[k].alias(c) for k, c in enumerate(("countAB", "countAb", "countaB", "countab"))]
    return table.select(*rest, *[F.col(c).alias(n) for c, n in names.items()], *counts)


def nonredundant(table: DataFrame, keys: list[str], level: int | None = None) -> DataFrame:
    return collapse(table, [*keys, "position_A", "position_B"], level)


def rarefied(table: DataFrame, n: int = MIN_SNP, seed: int = 0) -> DataFrame:
    """r2 and D' of ``n`` links drawn from each row's links, seeded by the row."""
    u = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: uniform(seed, "scaffold", "position_A", "position_B", "mm", i) * F.col("total"))
    d, below, picks = table.withColumn("u", u), F.lit(0).cast("long"), []
    for k in range(4):
        lo, hi = below, below + F.col("counts")[k]
        picks.append(draws_between("u", lo, hi))
        below = hi
    d = d.withColumns({f"_p{k}": p for k, p in enumerate(picks)})
    r2, dp = disequilibrium(*[F.col(f"_p{k}") for k in range(4)])
    return d.withColumns({"r2_normalized": r2, "d_prime_normalized": dp}).drop("u", *[f"_p{k}" for k in range(4)])


def decay(table: DataFrame, width: int = 5, least: int = 5) -> DataFrame:
    """Mean r2 and D' by distance in bins of ``width``; null with fewer than ``least`` values."""
    d = table.withColumn("bin", F.floor(F.col("distance") / width).cast("long") * width)
    enough = lambda c: F.when(F.count(c) >= least, F.avg(c))
    return d.groupBy("bin").agg(F.count("*").alias("pairs"), enough("r2").alias("r2"), enough("d_prime").alias("d_prime"))

