"""Mixing sources to target weights by temperature.

Source weights are the sources' token shares raised to an exponent and
normalised.  The exponent is bisected until the weights reach a target entropy,
or until no source is repeated more often than a limit allows.  Weights are then
realised by whole epochs of each source and a part of one more: documents are
permuted by a hash, in ``CELLS`` blocks, and taken block by block until the
source's token budget is met.

Sources are a table. Only numbers of tokens are looked at on the driver, and where
there are more than ``SOURCES`` of them, Spark sums up the entropy of each exponent
that is tried.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelica.llm.common import cut, small

#: Blocks of a permutation (a power of two), sources whose entropy is summed up on the driver, at most, and bits of a place.
CELLS, SOURCES, BITS = 4096, 100_000, 60
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def weights(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Shares to a power, normalised; sources without tokens have no weight."""
    w = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), exponent), 0.0)
    return w / w.sum() if w.sum() else w


def epochs_of(shares: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How often each source is read if the least read one is read once."""
    ratio = np.divide(w, shares, out=np.ones_like(w), where=shares > 0)
    has = shares > 0
    return np.where(has, ratio / ratio[has].min(), 1.0) if has.any() else np.ones_like(w)


def find_exponent(shares: np.ndarray, target_entropy: float | None, most_epochs: float | None) -> float:
    """:func:`search_exponent` for shares in memory."""
    has = shares[shares > 0]
    spread = float(has.max() / has.min()) if len(has) else 1.0
    return search_exponent(lambda a: entropy(weights(shares, a)), spread, target_entropy, most_epochs)


def search_exponent(entropy_of: Callable[[float], float], spread: float, target_entropy: float | None, most_epochs: float | None) -> float:
    """The largest exponent in [0, 1] whose weights reach ``target_entropy``, but not less than ``most_epochs`` allows.

    Entropy falls and repetition falls as the exponent grows to 1; the smallest
    source is repeated most, ``spread`` (largest share by smallest) to the power
    of 1 minus the exponent.  Without a target, the least exponent that the
    repetition limit allows.  A target beyond the entropy of equal weights gives 0
    (limit permitting).
    """

    def bisect(holds: Callable[[float], bool]) -> float:
        lo, hi = 0.0, 1.0  # holds at lo, not at hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    out = 0.0
    if target_entropy is not None and entropy_of(0.0) > target_entropy:
        out = 1.0 if entropy_of(1.0) >= target_entropy else bisect(lambda a: entropy_of(a) >= target_entropy)
    if most_epochs is not None and spread ** (1.0 - out) > most_epochs:
        out = 1.0 if most_epochs <= 1 else 1.0 - bisect(lambda b: spread**b <= most_epochs)
    return out


def source_plan(sources: DataFrame, target_entropy: float | None, most_epochs: float | None) -> DataFrame:
    """Adds ``weight`` and ``epochs`` to sources ``s`` with ``t`` tokens."""
    has = sources.where("t > 0")
    n, total, low, high = has.agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if not n:
        return sources.withColumns({"weight": F.lit(0.0), "epochs": F.lit(1.0)})
    share = F.col("t") / F.lit(float(total))

    def summed(a: float) -> float:
        # of weights p^a / z the entropy is ln z - a * sum(p^a ln p) / z
        z, e = has.agg(F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))).first()
        return math.log(z) - a * e / z

    if target_entropy is None or n > SOURCES:
        entropy_of = summed
    else:
        shares = np.sort(np.array([float(r.t) for r in has.select("t").collect()])) / float(total)
        entropy_of = lambda a: entropy(weights(shares, a))
    a = search_exponent(entropy_of, high / low, target_entropy, most_epochs)
    z = has.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
    e = F.pow(F.col("t") / F.lit(float(high)), F.lit(a - 1.0))
    # epochs a hair beside a whole number are that number
    e = F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)
    some = F.col("t") > 0
    return sources.withColumns({"weight": F.when(some, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(0.0), "epochs": F.when(some, e).otherwise(1.0)})


def _place(*parts: Column) -> Column:
    """``BITS`` bits of a hash that any SQL engine has."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    most_epochs: float | None = 4.0,
    seed: int = 3,
) -> DataFrame:
    """Repeats documents so that sources have their weights; no document is left out.

    The source that is read least is read once; the others whole epochs and,
    in the last one, documents in permuted order while the sum of their tokens
    stays within the rest of the budget (the first one that would exceed it ends the
    epoch).  Tokens are words.  Returns all columns of ``docs`` and ``epoch``
    (from 1), ``place`` (the document's place in that epoch's
    permutation; blocks are its upper bits); names of the input that clash with these keep
    theirs, and the new ones get underscores in front until they don't.

    Places depend on id and text alone: rows of one source, id and text have one
    place, and are taken together or not at all, so the result is the same for the
    same rows, whatever their partitioning.  A null source is a source of its own;
    null ids and null texts count as empty ones.  Documents without words cost
    nothing; sources without words are read once.  An empty table gives no rows.
    """
    names = docs.columns
    new = []
    for n in ("epoch", "place"):
        while n in names:
            n = "_" + n
        new.append(n)
    kinds = [f.dataType for f in docs.schema]
    d = docs.toDF(*[f"c{k}" for k in range(len(names))])
    col = lambda name: F.col(f"c{names.index(name)}")
    source, tokens = col(source_col).cast("string"), count_words(col(text_col).cast("string"))
    d = d.withColumn("key", _place(F.lit(seed), col(id_col), col(text_col)))
    shift = BITS - int(math.log2(CELLS))
    cell = F.shiftright("key", shift)

    # blocks: a source has at most CELLS rows here; words are counted once, but for those of the last blocks
    block = cut(d.select(source.alias("s"), cell.alias("cell"), tokens.alias("t")).groupBy("s", "cell").agg(F.sum("t").alias("t")))
    plan = source_plan(cut(block.groupBy("s").agg(F.sum("t").alias("t"))), target_entropy, most_epochs)
    full = F.floor("epochs").cast("int")
    plan = cut(plan.select(F.col("s").alias("s2"), full.alias("full"), F.round((F.col("epochs") - full) * F.col("t")).cast("long").alias("rest")))
    n = plan.count()
    upto = block.withColumn("upto", F.sum("t").over(Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    # the block in which the budget ends, and what is left of the budget there
    edge = upto.join(small(plan, n), F.col("s").eqNullSafe(F.col("s2"))).where("upto > rest and rest > 0").groupBy("s")
    edge = cut(edge.agg(F.min_by(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("t")).alias("left")), "cell").alias("e")).select(F.col("s").alias("s3"), F.col("e.cell").alias("edge"), F.col("e.left").alias("left")))
    near = d.select(source.alias("s"), "key", cell.alias("cell"), col(text_col).cast("string").alias("text")).join(small(edge, n), F.col("s").eqNullSafe(F.col("s3")) & (F.col("cell") == F.col("edge")))
    near = near.groupBy("s3", "left", "key").agg(F.sum(count_words(F.col("text"))).alias("t"))
    run = Window.partitionBy("s3").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    taken = near.withColumn("upto", F.sum("t").over(run)).where("upto <= left").groupBy(F.col("s3").alias("s4")).agg(F.max("key").alias("at"))
    ends = plan.join(small(edge, n), F.col("s2").eqNullSafe(F.col("s3")), "left").join(small(taken, n), F.col("s2").eqNullSafe(F.col("s4")), "left")
    # the last place of the epoch that isn't whole
    last = F.when(F.col("rest") == 0, F.lit(-1)).when(F.col("edge").isNull(), F.lit(1 << BITS)).otherwise(F.coalesce("at", F.shiftleft("edge", shift) - 1))
    ends = cut(ends.select("s2", "full", last.cast("long").alias("last")))
    d = d.join(small(ends, n), source.eqNullSafe(F.col("s2")))
    times = F.col("full") + (F.col("key") <= F.col("last")).cast("int")
    both = d.withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    out = [F.col(f"c{k}").cast(kinds[k]).alias(n) for k, n in enumerate(names)]
    return both.select(*out, F.col("epoch").alias(new[0]), _place(F.lit(seed), F.col("epoch"), F.col("key")).alias(new[1]))
