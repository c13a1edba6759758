"""URL filter: rules on host and path, then a character language-model ratio.

Two variable-order Markov models over the bytes of a URL, one of accepted and
one of rejected URLs, are smoothed by Witten-Bell interpolation: each order
backs off to the next lower one by the number of different bytes that followed
its context.  A URL that no rule decides is allowed where the difference of
the two log-likelihoods, divided by its length, reaches a threshold that is
calibrated on labelled URLs, each scored by counts that leave out its fold.

Counts are tables: every different URL that a rule decides is counted and
calibrates, and pages are scored in slices, which ask for the weight of each of
their different byte sequences once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import cut
from allelica.llm.textblocks import buffers

#: Bytes of context, at most.
ORDER = 5
#: Folds of the labelled URLs; of every so many one is kept for calibration, where only some are.
HELD_OUT = 5
#: Pages that are scored at once, about.
SLICE = 8000
_START = 0
#: Bits of a number of context and byte, which a fold's stand above.
_FOLD = 59


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits.

    A rule is a host, ``/`` and the rest of a path; it fits the host and its
    subdomains where the path starts with its own.  Of rules equally long the
    first in the alphabet wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each byte: its context of 0 to ``ORDER`` bytes as a number (start marks in front), and the byte."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(data)) - offsets[:-1][doc]
    ctx, out = np.zeros(len(data), np.uint64), []
    for k in range(ORDER + 1):
        # the order is part of the number, so that contexts of different orders differ
        out.append(ctx | np.uint64(k + 1) << np.uint64(48))
        back = np.full(len(data), _START, np.uint64)
        ok = at > k
        back[ok] = data[np.flatnonzero(ok) - k - 1]
        ctx = ctx | back << np.uint64(8 * k)
    return out, data.astype(np.uint64)


class Markov:
    """A Witten-Bell interpolated byte model of variable order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        contexts, byte = _contexts(data, offsets)
        pair, ctx = [], []
        for c in contexts:
            pair.append(c << np.uint64(8) | byte)
            ctx.append(c)
        self.pair, self.pair_n = np.unique(np.concatenate(pair), return_counts=True)
        self.ctx, kinds = np.unique(self.pair >> np.uint64(8), return_counts=True)
        self.kinds = kinds
        all_ctx, total = np.unique(np.concatenate(ctx), return_counts=True)
        self.total = total

    def log_likelihood(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each URL's probability."""
        contexts, byte = _contexts(data, offsets)
        p = np.full(len(data), 1 / 256)
        for c in contexts:
            k = np.minimum(np.searchsorted(self.ctx, c), max(len(self.ctx) - 1, 0))
            known = (self.ctx[k] == c) if len(self.ctx) else np.zeros(len(c), bool)
            pair = c << np.uint64(8) | byte
            j = np.minimum(np.searchsorted(self.pair, pair), max(len(self.pair) - 1, 0))
            n = np.where(self.pair[j] == pair, self.pair_n[j], 0) if len(self.pair) else np.zeros(len(c))
            if len(self.ctx):
                p = np.where(known, (n + self.kinds[k] * p) / (self.total[k] + self.kinds[k]), p)
        total = np.concatenate([[0.0], np.cumsum(np.log(p))])
        return total[offsets[1:]] - total[offsets[:-1]]


class Model:
    """The two models in memory and the calibrated threshold of their ratio; :class:`Tables` is the same over tables."""

    def __init__(self, urls: list[str], accepted: np.ndarray):
        held = np.arange(len(urls)) % HELD_OUT == HELD_OUT - 1
        arr = pa.array(urls, pa.string())
        self.sure = None if accepted.any() and not accepted.all() else (bool(accepted[0]) if len(accepted) else True)
        self.threshold = 0.0
        if self.sure is None:
            self.good, self.bad = (Markov(*buffers(arr.filter(pa.array(~held & (accepted == k))))) for k in (True, False))
            ratio = self.ratio(*buffers(arr.filter(pa.array(held))))
            self.threshold = _cut(ratio, accepted[held])

    def ratio(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Difference of log-likelihoods, divided by the length (0 for an empty URL)."""
        if self.sure is not None:
            return np.full(len(offsets) - 1, 1.0 if self.sure else -1.0)
        d = self.good.log_likelihood(data, offsets) - self.bad.log_likelihood(data, offsets)
        return d / np.maximum(np.diff(offsets), 1)


def _cut(ratio: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the least sum of the two error rates, in the middle of its interval."""
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(ratio)
    r, g = ratio[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    value = np.concatenate([[r[0] - 1e-9], (r[1:] + r[:-1]) / 2, [r[-1] + 1e-9]])
    # cuts between equal values aren't possible
    error = np.where(np.concatenate([[True], r[1:] > r[:-1], [True]]), lost + passed, np.inf)
    return float(value[int(error.argmin())])


def _ruled(d: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    d = d.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return d.withColumns({"rule": rule, "by_rule": verdict})


class Tables:
    """The two models as one table of counts (``pair``, ``good``, ``bad``), and the calibrated threshold of their ratio.

    Without URLs of both kinds there is no table, and ``sure`` is the only kind known.
    """

    def __init__(self, counts: DataFrame | None, sure: bool | None):
        self.counts, self.sure, self.threshold = counts, sure, 0.0


def train(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", per_class: int | None = None) -> Tables:
    """Fits the models on all different URLs that rules decide, and calibrates the threshold on all of them.

    For the threshold a URL is scored by the counts of the other of ``HELD_OUT`` folds.  With ``per_class`` only one in
    ``HELD_OUT`` of so many URLs of each verdict, at most, calibrate: those with the least hash, which aren't counted.
    """
    d = _ruled(pages.select(F.col(url_col).cast("string").alias("url")), rules).where(F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "allow").alias("good")).distinct()
    d = cut(d.withColumn("h", F.xxhash64("url")))
    n = {r.good: r["count"] for r in d.groupBy("good").count().collect()}
    if len(n) < 2:
        return Tables(None, next(iter(n), True))
    if per_class is None:
        fold, folds, fitted, held = F.pmod("h", F.lit(HELD_OUT)), HELD_OUT, F.lit(True), F.lit(True)
    else:
        last = {kind: d.where(F.col("good") == kind).select("h").orderBy("h").limit(min(per_class, n[kind]) // HELD_OUT).collect()[-1:] for kind in (True, False)}
        kept = F.lit(False)
        for kind, row in last.items():
            kept = kept | ((F.col("good") == kind) & (F.col("h") <= row[0].h)) if row else kept
        fold, folds, fitted, held = F.when(kept, 0).otherwise(1), 2, F.col("fold") != 0, F.col("fold") == 0
    d = d.select("url", "good", fold.cast("int").alias("fold"))
    counts = d.mapInArrow(_count, "fold int, pair long, good long, bad long").groupBy("fold", "pair").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = cut(counts)
    model = Tables(cut(counts.where(fitted).groupBy("pair").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))), None)
    others = F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("fold"))
    got = _ratios(d.where(held).select(F.col("good").cast("long").alias("id"), "url", "fold"), counts.select(F.explode(others).alias("fold"), "pair", "good", "bad"))
    model.threshold = _threshold(got.select("id", "ratio"))
    return model


def _threshold(scored: DataFrame) -> float:
    """:func:`_cut` over a table of ratios, ``id`` being 1 for good ones; only sums of ranges reach the driver."""
    d = cut(scored.groupBy("ratio").agg(F.sum("id").alias("good"), F.sum(1 - F.col("id")).alias("bad")))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(d.repartitionByRange(parts, "ratio").withColumn("part", F.spark_partition_id()))
    before, good, bad = [], 0, 0
    for r in d.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect():
        before.append((r.part, good, bad))
        good, bad = good + r.good, bad + r.bad
    if not good or not bad:
        return 0.0
    start = d.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long")
    to_here = Window.partitionBy("part").orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost, blocked = (F.sum(kind).over(to_here) + F.col(f"{kind}_before") for kind in ("good", "bad"))
    error = (lost * F.lit(bad) - blocked * F.lit(good)).alias("error")
    best, least = d.join(F.broadcast(start), "part").select(error, "ratio").agg(F.min(F.struct("error", "ratio")), F.min("ratio")).first()
    if best.error >= 0:
        return least - 1e-9
    above = d.where(F.col("ratio") > best.ratio).agg(F.min("ratio")).first()[0]
    return best.ratio + 1e-9 if above is None else (best.ratio + above) / 2


def _pairs(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each byte: its context of 0 to ``ORDER`` bytes and itself, as one number."""
    contexts, byte = _contexts(data, offsets)
    return [(c << np.uint64(8) | byte).astype(np.int64) for c in contexts]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = batch["good"].to_numpy(zero_copy_only=False).astype(bool)
        data, off = buffers(batch["url"])
        kind, fold = (np.repeat(a, np.diff(off)) for a in (good, batch["fold"].to_numpy().astype(np.int64)))
        pair, at = np.unique(np.concatenate(_pairs(data, off)) | np.tile(fold, ORDER + 1) << _FOLD, return_inverse=True)
        kind = np.tile(kind, ORDER + 1)
        n = [np.bincount(at[k], minlength=len(pair)).astype(np.int64) for k in (kind, ~kind)]
        own = [pa.array((pair >> _FOLD).astype(np.int32)), pa.array(pair & ((1 << _FOLD) - 1))]
        yield pa.record_batch([*own, *map(pa.array, n)], names=["fold", "pair", "good", "bad"])


def _asked(t: pa.Table) -> pa.Table:
    pair = np.unique(_pairs(*buffers(t["url"]))[ORDER])
    return pa.table([pa.array(np.full(len(pair), t["slice"][0].as_py(), np.int64)), pa.array(pair)], names=["slice", "pair"])


def _sum(t: pa.Table, weights: pa.Table) -> pa.Table:
    data, off = buffers(t["url"])
    n = np.diff(off)
    pair, weight = weights["pair"].to_numpy(), weights["weight"].to_numpy()
    order = np.argsort(pair)
    w = weight[order][np.searchsorted(pair[order], _pairs(data, off)[ORDER])] if len(data) else np.zeros(0)
    total = np.bincount(np.repeat(np.arange(len(n)), n), weights=w, minlength=len(n))
    return pa.table([t["id"], t["url"], pa.array(total / np.maximum(n, 1))], names=["id", "url", "ratio"])


def _at_order(pair: Column, k: int) -> Column:
    """The number of a context of ``k`` bytes and a byte, from that of a longer context."""
    ctx = F.shiftright(pair, 8).bitwiseAND(F.lit((1 << 8 * k) - 1))
    return F.shiftleft(ctx.bitwiseOR(F.lit(k + 1 << 48)), 8).bitwiseOR(pair.bitwiseAND(F.lit(255)))


def _weights(asked: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Differences of the logarithms of both models' probabilities (``weight``) of the ``pair`` numbers asked for; models of their own for each ``by``."""
    keys = [*by, "pair"]
    zero = F.lit(0).cast("long")
    wanted = asked.select(*keys).distinct().select(*by, F.explode(F.array(*[_at_order(F.col("pair"), k) for k in range(ORDER + 1)])).alias("pair")).distinct()
    both = wanted.select(*keys, zero.alias("good"), zero.alias("bad"), F.lit(1).alias("wanted")).unionByName(counts.select(*keys, "good", "bad", F.lit(0).alias("wanted")))
    both = both.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("wanted").alias("wanted"))
    of = Window.partitionBy(*by, F.shiftright("pair", 8))
    for kind in ("good", "bad"):
        both = both.withColumns({f"{kind}_total": F.sum(kind).over(of), f"{kind}_kinds": F.sum(F.when(F.col(kind) > 0, 1).otherwise(0)).over(of)})
    both = cut(both.where("wanted = 1").drop("wanted"))
    lower = None
    for k in range(ORDER + 1):
        level = both.where(F.shiftright("pair", 56) == k + 1)
        if lower is None:
            level = level.withColumns({"p_good": F.lit(1 / 256), "p_bad": F.lit(1 / 256)})
        else:
            level = level.withColumn("up", _at_order(F.col("pair"), k - 1)).join(lower, [*by, "up"])
        p = {kind: F.when(F.col(f"{kind}_total") > 0, (F.col(kind) + F.col(f"{kind}_kinds") * F.col(f"p_{kind}")) / (F.col(f"{kind}_total") + F.col(f"{kind}_kinds"))).otherwise(F.col(f"p_{kind}")) for kind in ("good", "bad")}
        lower = level.select(*by, F.col("pair").alias("up"), p["good"].alias("p_good"), p["bad"].alias("p_bad"))
    return lower.select(*by, F.col("up").alias("pair"), (F.log("p_good") - F.log("p_bad")).alias("weight"))


def _ratios(d: DataFrame, counts: DataFrame) -> DataFrame:
    """``id`` and ``url`` with the difference of log-likelihoods, divided by the length (0 for an empty or null URL).

    With a ``fold`` in both, the counts of a URL's own fold are taken.
    """
    by = ["fold"] if "fold" in d.columns else []
    slices = max(1, -(-d.count() // (SLICE * (HELD_OUT if by else 1))))
    own = F.pmod(F.xxhash64("id", "url"), F.lit(slices))
    d = d.withColumn("slice", F.col("fold") * slices + own if by else own)
    asked = cut(d.groupBy("slice").applyInArrow(_asked, "slice long, pair long"))
    asked = asked.withColumn("fold", F.floor(F.col("slice") / slices).cast("int")) if by else asked
    weights = asked.join(_weights(asked, counts, by), [*by, "pair"]).select("slice", "pair", "weight")
    return d.groupBy("slice").cogroup(weights.groupBy("slice")).applyInArrow(_sum, "id long, url string, ratio double")


def judge(pages: DataFrame, model: Tables, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: ``id``, ``host``, ``path``, ``rule``, ``ratio`` and ``verdict`` (allow or block).

    The rule's verdict, else allow where ``ratio`` reaches the model's
    threshold.  A null URL has empty host and path, ratio 0 and no rule, and is
    blocked; an empty one has ratio 0.  Without labelled URLs of both kinds the
    only kind known is the verdict, allow if none is.  Page ids may be null or
    repeat; rows that repeat are judged each.  URLs of any length count whole.  An
    empty table gives no rows.  Other columns are not read.
    """
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    d = d.withColumn("ratio", F.lit(1.0 if model.sure else -1.0)) if model.counts is None else _ratios(d, model.counts)
    d = _ruled(d, rules)
    own = F.when(F.col("url").isNotNull() & (F.col("ratio") >= F.lit(model.threshold)), F.lit("allow")).otherwise(F.lit("block"))
    ratio = F.when(F.col("url").isNull(), F.lit(0.0)).otherwise(F.col("ratio"))
    return d.select("id", "host", "path", "rule", ratio.alias("ratio"), F.coalesce("by_rule", own).alias("verdict"))
