"""Replication index: the slope of a genome's sorted, smoothed coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, SLIDE, FOLD, TRIM, EPS = 5000, 100, 8.0, 0.05, 1e-50
LEAST_KEPT, LEAST_COVERAGE, LEAST_R2, MOST_FRAGMENTS = 0.98, 5.0, 0.9, 175.0


def sliding_mean(coverage: DataFrame, lengths: DataFrame, group: list[str], width: int = WIDTH, slide: int = SLIDE) -> DataFrame:
    """Mean coverage of all whole windows of ``width`` positions that start at multiples of ``slide``.

    Rows of ``coverage`` are positions; what has none is zero.  ``lengths`` has
    ``group`` and ``length``.  Sums of blocks of ``slide`` positions come first, so
    that the window function only sees one row for each block.
    """
    last = F.expr(f"(length - 1) div {slide}")
    grid = lengths.where("length > 0").select(*group, "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    grid = grid.select(*group, "block", F.least(F.lit(slide), F.col("length") - F.col("block") * slide).alias("n"))
    sums = coverage.groupBy(*group, F.expr(f"position div {slide}").alias("block")).agg(F.sum("coverage").alias("s"))
    return _windows(grid.join(sums, [*group, "block"], "left").fillna(0, ["s"]), group, width, slide).withColumnRenamed("mean", "y")


def _windows(blocks: DataFrame, group: list[str], width: int, slide: int) -> DataFrame:
    if width % slide:
        raise ValueError("width must be a multiple of slide")
    w = Window.partitionBy(*group).orderBy("block").rowsBetween(0, width // slide - 1)
    d = blocks.withColumns({"total": F.sum("s").over(w), "have": F.sum("n").over(w)}).where(F.col("have") == width)
    return d.select(*group, (F.col("block") * slide).alias("start"), (F.col("total") / width).alias("mean"))


def sliding_gc(sequences: DataFrame, places: DataFrame, group: list[str], width: int = WIDTH, slide: int = SLIDE, edge: int = 0) -> DataFrame:
    """GC content of the same windows.

    ``places`` tells where the inner part of a scaffold (``edge`` bases left out at
    both ends) lies in its group: ``scaffold``, ``group``, ``offset`` and ``inner``.
    """
    d = sequences.select("scaffold", F.col("sequence").cast("binary").alias("raw")).join(places.where("inner > 0"), "scaffold")
    d = d.withColumn("block", F.explode(F.sequence(F.expr(f"offset div {slide}"), F.expr(f"(offset + inner - 1) div {slide}"))))
    first = F.greatest(F.col("block") * slide, F.col("offset"))
    n = F.least((F.col("block") + 1) * slide, F.col("offset") + F.col("inner")) - first
    # bytes are cut out without looking at those before
    d = d.select(*group, "block", n.alias("n"), F.substring("raw", (first - F.col("offset") + edge + 1).cast("int"), n.cast("int")).cast("string").alias("s"))
    d = d.groupBy(*group, "block").agg(F.sum(F.length("s") - F.length(F.translate("s", "GC", ""))).alias("s"), F.sum("n").alias("n"))
    return _windows(d, group, width, slide).withColumnRenamed("mean", "gc")


def kept_windows(windows: DataFrame, group: list[str], fold: float = FOLD) -> DataFrame:
    """Windows with coverage within ``fold`` of the median, as log2; ``kept_share`` is the share that stays."""
    med = windows.groupBy(*group).agg(F.median("y").alias("med"), F.count("*").alias("all_windows"))
    d = windows.join(med, group).where((F.col("y") > 0) & (F.col("med") > 0))
    d = d.where(F.greatest("y", "med") / F.least("y", "med") <= fold)
    return d.withColumn("log2", F.log2(F.greatest(F.col("y"), F.lit(EPS)))).withColumn("kept_share", F.count("*").over(Window.partitionBy(*group)) / F.col("all_windows"))


def fit(kept: DataFrame, lengths: DataFrame, group: list[str], value: str = "log2") -> DataFrame:
    """The line through sorted values, both ends trimmed; iRep is 2 to the slope times the length.

    ``lengths`` has ``group`` and ``length``.
    """
    w = Window.partitionBy(*group)
    d = kept.withColumn("i", F.row_number().over(w.orderBy(value, "start")) - 1).withColumn("n", F.count("*").over(w)).join(lengths, group)
    d = d.withColumn("x", F.floor(F.col("i") * F.col("length") / F.col("n")).cast("long") + 1)
    lo = F.floor(F.col("n") * TRIM)
    d = d.where((F.col("i") >= lo) & (F.col("i") < F.col("n") - lo))
    return d.groupBy(*group).agg(
        F.regr_slope(value, "x").alias("slope"), F.regr_r2(value, "x").alias("r2"), F.first("length").alias("length"), F.first("kept_share").alias("kept_windows")
    ).withColumn("raw_iRep", F.pow(F.lit(2.0), F.col("slope") * F.col("length")))


def gc_corrected(kept: DataFrame, gc: DataFrame, group: list[str], worst: float = 0.01) -> DataFrame:
    """Values without their dependence on GC: a line is fitted, the worst windows go, it is fitted again and taken off."""
    d = kept.join(gc, [*group, "start"])
    line = lambda t: t.groupBy(*group).agg(F.regr_slope("log2", "gc").alias("m"), F.regr_intercept("log2", "gc").alias("b"), F.avg("log2").alias("mean"))
    e = d.join(line(d), group).withColumn("err", F.round(F.abs(F.col("log2") - (F.col("m") * F.col("gc") + F.col("b"))), 9))
    w = Window.partitionBy(*group)
    ranked = e.withColumn("r", F.row_number().over(w.orderBy(F.desc("err"), "start"))).withColumn("all", F.count("*").over(w))
    good = ranked.where(F.col("r") > F.floor(F.col("all") * worst)).drop("m", "b", "mean", "all")
    out = good.join(line(good), group)
    return out.withColumn("corrected", F.col("log2") + F.col("mean") - (F.col("m") * F.col("gc") + F.col("b"))).drop("m", "b", "mean", "err", "r")


def irep(coverage: DataFrame, lengths: DataFrame, group: list[str], scaffolds: DataFrame | None = None, gc: DataFrame | None = None, width: int = WIDTH, slide: int = SLIDE) -> DataFrame:
    """iRep of each group, null where windows, coverage, fit or assembly aren't good enough.

    Rows of ``coverage`` are positions of one level; what has none is zero.  The
    coverage that is judged is the mean over all positions.  The value is
    that of the fit without GC correction, whether ``gc`` windows are there
    (``iRep_GC_corrected``) or not.  ``scaffolds`` has ``group`` and ``scaffolds``.
    """
    kept = kept_windows(sliding_mean(coverage, lengths, group, width, slide), group)
    d = fit(kept, lengths, group).join(coverage.groupBy(*group).agg(F.sum("coverage").alias("bases")), group)
    bad = (F.col("kept_windows") < LEAST_KEPT) | (F.col("bases") / F.col("length") < LEAST_COVERAGE) | (F.col("r2") < LEAST_R2) | F.col("r2").isNull()
    if scaffolds is not None:
        d = d.join(scaffolds, group, "left")
        bad = bad | (F.col("scaffolds") / (F.col("length") / F.lit(1e6)) > MOST_FRAGMENTS)
    d = d.withColumn("iRep", F.when(~bad, F.col("raw_iRep"))).drop("bases")
    if gc is None:
        return d.withColumn("iRep_GC_corrected", F.lit(False))
    return d.join(gc.select(*group, F.lit(True).alias("iRep_GC_corrected")).distinct(), group, "left").fillna(False, ["iRep_GC_corrected"])
