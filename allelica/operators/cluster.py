"""Hierarchical clustering of the samples of each genome.

A genome's distance matrix is as large as its number of samples squared and is
clustered in one task; genomes are clustered in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges ``(a, b, height, size)`` by the Lance-Williams update; new clusters are numbered from n on."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n = len(distance)
    squared = method in ("centroid", "median", "ward")
    d = distance.astype(float) ** 2 if squared else distance.astype(float)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), list(range(n)), np.ones(n, dtype=bool)
    out = []
    for step in range(n - 1):
        flat = int(np.where(alive[:, None] & alive[None, :], d, np.inf).argmin())
        i, j = sorted(divmod(flat, n))
        h = d[i, j]
        si, sj = size[i], size[j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (si * d[i] + sj * d[j]) / (si + sj)
        elif method == "weighted":
            new = (d[i] + d[j]) / 2
        elif method == "centroid":
            new = (si * d[i] + sj * d[j]) / (si + sj) - si * sj * h / (si + sj) ** 2
        elif method == "median":
            new = (d[i] + d[j]) / 2 - h / 4
        else:
            t = si + sj + size
            new = ((si + size) * d[i] + (sj + size) * d[j] - size * h) / t
        out.append((min(name[i], name[j]), max(name[i], name[j]), float(np.sqrt(max(h, 0.0)) if squared else h), int(si + sj)))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        size[i], name[i] = si + sj, n + step
    return out


def flat_clusters(merges: list[tuple[int, int, float, int]], n: int, height: float) -> np.ndarray:
    """Cluster numbers from 1, in order of the first member; merges up to ``height``, all below them included."""
    most, parent = {}, list(range(2 * n - 1)) if n else []
    for k, (a, b, h, _) in enumerate(merges):
        most[n + k] = max(h, most.get(a, 0.0), most.get(b, 0.0))
        if most[n + k] <= height:
            parent[a] = parent[b] = n + k
    roots = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    order: dict[int, int] = {}
    return np.array([order.setdefault(r, len(order) + 1) for r in roots], dtype=int)


def _cluster(height: float, method: str, least_compared: float | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def cluster(p: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"genome": [], "sample": [], "number": []}).astype({"genome": str, "sample": str, "number": int})
        similar = p["popANI"].to_numpy(float)
        if least_compared is not None:
            if (p["compared_bases_count"] == 0).any():
                return none
            similar = np.where(p["percent_compared"].to_numpy(float) < least_compared, 0.0, similar)
        names = sorted({*p["name1"], *p["name2"]})
        at = {s: k for k, s in enumerate(names)}
        total, n = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
        for a, b, x in zip(p["name1"], p["name2"], similar):
            if not np.isnan(x):
                for i, j in ((at[a], at[b]), (at[b], at[a])):
                    total[i, j] += x
                    n[i, j] += 1
        # the mean of both directions; what was never compared is as far apart as can be
        d = np.where(n > 0, 1.0 - total / np.maximum(n, 1), 1.0)
        np.fill_diagonal(d, 0.0)
        return pd.DataFrame({"genome": p["genome"].iloc[0], "sample": names, "number": flat_clusters(linkage(d, method), len(names), height)})

    return cluster


def strain_clusters(genomes: DataFrame, ani: float = 0.99999, method: str = "average", least_compared: float = 0.1) -> DataFrame:
    """Strains of each genome by population ANI; pairs with too little compared are as far apart as can be.

    Genomes with a comparison without bases are left out. Clusters are called
    ``<genome>_<cluster>``, genomes being numbered by name among those clustered.
    """
    return _named(genomes, 1.0 - ani, method, least_compared)


def recluster(genomes: DataFrame, ani: float = 99.0, method: str = "single") -> DataFrame:
    """Clusters again by an ANI in percent, whatever the share compared; what was never compared is far apart."""
    return _named(genomes, 1.0 - ani / 100.0, method, None)


def _named(genomes: DataFrame, height: float, method: str, least_compared: float | None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    cols = ["genome", "name1", "name2", "popANI"] + ([] if least_compared is None else ["compared_bases_count", "percent_compared"])
    # a hair of slack: heights are sums of rounded numbers
    c = genomes.select(*cols).groupBy("genome").applyInPandas(_cluster(height + 1e-12, method, least_compared), "genome string, sample string, number int")
    one = c.groupBy("genome").agg(F.collect_list(F.struct("sample", "number")).alias("all"))
    # one row for each clustered genome
    ranked = one.withColumn("index", F.row_number().over(Window.orderBy("genome")) - 1).withColumn("x", F.explode("all"))
    return ranked.select("genome", F.col("x.sample").alias("sample"), F.concat_ws("_", "index", "x.number").alias("cluster"))


def greedy_clusters(genomes: DataFrame, ani: float = 0.99999, overlap: float = 0.5) -> DataFrame:
    """Samples join the first representative that they are close enough to, in order of names, or become one."""

    def assign(p: pd.DataFrame) -> pd.DataFrame:
        close = {(a, b) for a, b, x, c in zip(p["name1"], p["name2"], p["popANI"], p["coverage_overlap"]) if x >= ani and c >= overlap}
        reps: list[str] = []
        out = []
        for s in sorted({*p["name1"], *p["name2"]}):
            r = next((r for r in reps if (r, s) in close or (s, r) in close), None)
            if r is None:
                reps.append(s)
                r = s
            out.append((p["genome"].iloc[0], s, r))
        return pd.DataFrame(out, columns=["genome", "sample", "representative"])

    return genomes.select("genome", "name1", "name2", "popANI", "coverage_overlap").groupBy("genome").applyInPandas(assign, "genome string, sample string, representative string")
