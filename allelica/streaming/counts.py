"""An extension: base counts kept up to date while reads arrive.

Site counts are plain sums, so a stream of observations can be aggregated as it
comes; everything downstream works on the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.operators.pileup import site_counts


def running_site_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a streaming table of observations; write it in ``update`` or ``complete`` mode."""
    return site_counts(stream, keys)


def windowed_site_counts(stream: DataFrame, keys: list[str], time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts for each time window; windows close once data is later than ``late``, so ``append`` mode works."""
    d = stream.withWatermark(time, late).withColumn("window", F.window(time, window))
    return site_counts(d, ["window", *keys])
