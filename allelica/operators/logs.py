"""Log analytics. Events have ``run_id, time, log_type, unit, pid, status, ram``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Time, kind and key=value pairs of log lines like ``20-06-17 18:20:19 DEBUG Checkpoint key=value;key=value``; others are left out."""
    c = F.col(column)
    time = F.try_to_timestamp(F.regexp_extract(c, r"^(\d\d-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yy-MM-dd HH:mm:ss"))
    d = lines.withColumn("time", time).withColumn("log_type", F.regexp_extract(c, r"^\S+ \S+ \S+\s+(\w+)", 1)).withColumn("text", F.regexp_extract(c, r"^\S+ \S+ \S+\s+\w+\s+(.*)$", 1))
    return d.where(F.col("time").isNotNull()).withColumn("fields", key_values(F.col("text")))


def key_values(text: Column) -> Column:
    """``a=1;b=2`` as a map; the last of equal keys."""
    pairs = F.filter(F.split(text, ";"), lambda x: F.instr(x, "=") > 0)
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("value"))
    items = F.transform(pairs, entry)
    # the last of equal keys: keep an entry if no later one has its key
    last = F.filter(items, lambda e, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def latest_run(events: DataFrame) -> DataFrame:
    """Events of the run with the latest event."""
    last = events.agg(F.max_by("run_id", F.struct("time", "run_id")).alias("run_id"))
    return events.join(F.broadcast(last), "run_id", "left_semi")


def paired(events: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: str = "event_id") -> DataFrame:
    """Runtime and change of memory from the first start to the first end (in file order) of each unit, and its number of starts."""
    first = lambda what, c: F.min_by(F.when(F.col("status") == what, F.col(c)), F.when(F.col("status") == what, F.col(order)))
    g = events.groupBy(*keys).agg(
        first(start, "time").alias("started"), first(end, "time").alias("ended"), first(start, "ram").alias("ram_start"), first(end, "ram").alias("ram_end"), F.count_if(F.col("status") == start).alias("runs")
    )
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return g.where("runs > 0").select(*keys, seconds.alias("runtime"), (F.col("ram_end") - F.col("ram_start")).alias("ram_change"), "runs")


def efficiency(runs: DataFrame, wall: Column, processes: Column) -> DataFrame:
    """Work done by each process and the share of wall time that it kept it busy."""
    d = runs.groupBy("pid").agg(F.sum("runtime").alias("busy"), F.count("*").alias("units"), F.max("runtime").alias("longest"))
    return d.withColumn("efficiency", 100.0 * F.col("busy") / F.nullif(wall * processes, F.lit(0.0)))


def checkpoints(events: DataFrame, keys: list[str], total: str = "main") -> DataFrame:
    """Duration of each checkpoint and its percentage of the whole."""
    p = paired(events, [*keys, "unit"])
    whole = p.where(F.col("unit") == total).select(*keys, F.col("runtime").alias("whole"))
    d = p.join(whole, keys, "left") if keys else p.crossJoin(F.broadcast(whole))
    return d.withColumn("percent", 100.0 * F.col("runtime") / F.nullif(F.col("whole"), F.lit(0.0))).drop("whole")


def failures(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.where(F.col("status") == "failure").groupBy(*keys).agg(F.count("*").alias("failures"), F.count_distinct("unit").alias("units"))


BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]


def bytes_text(n: Column, largest: str = "YiB") -> Column:
    """Bytes as text with one decimal and a unit up to ``largest``, in steps of 1024; halves round to even."""
    size = n.cast("double")
    text = lambda k: F.format_string("%.1f%s", F.bround(size / 1024.0**k, 1), F.lit(BYTE_UNITS[k]))
    last = BYTE_UNITS.index(largest)
    out = text(last)
    for k in reversed(range(last)):
        out = F.when(F.abs(size) < 1024.0 ** (k + 1), text(k)).otherwise(out)
    return out


def overall(events: DataFrame) -> DataFrame:
    """Start, end, runtime, version and command of each run, and whether it finished; of one that didn't, the end is its last event.

    Events have ``run_id, time, log_type, fields``.
    """
    first = lambda kind, c: F.min_by(F.when(F.col("log_type") == kind, c), F.when(F.col("log_type") == kind, F.col("time")))
    g = events.groupBy("run_id").agg(
        first("program_start", F.col("time")).alias("started"), first("program_end", F.col("time")).alias("end"), F.max("time").alias("last"),
        first("program_start", F.col("fields")["version"]).alias("version"), first("program_start", F.col("fields")["cmd"]).alias("command"),
    )
    ended = F.coalesce("end", "last")
    return g.where("started is not null").select("run_id", "version", "command", "started", ended.alias("ended"), F.col("end").isNotNull().alias("finished"), _seconds(F.col("started"), ended).alias("runtime"))


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def parallel_units(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """One row for each unit and step (``keys``): first start and end, runtime, change of memory, number of starts and process.

    Events have ``status`` (start or end), ``time``, ``ram`` and ``pid``.
    """
    first = lambda what, c: F.min_by(F.when(F.col("status") == what, F.col(c)), F.when(F.col("status") == what, F.col(order)))
    g = events.where(F.col("status").isin("start", "end")).groupBy(*keys).agg(
        F.min_by("pid", order).alias("pid"), first("start", "time").alias("started"), first("end", "time").alias("ended"), first("start", "ram").alias("ram_start"), first("end", "ram").alias("ram_end"), F.count_if(F.col("status") == "start").alias("runs")
    )
    g = g.where("runs > 0")
    return g.withColumns({"runtime": _seconds(F.col("started"), F.col("ended")), "ram_change": F.col("ram_end") - F.col("ram_start")})


def multiprocessing(units: DataFrame, keys: list[str]) -> DataFrame:
    """How well each group of units (``keys``) ran in parallel: wall time, processes, their average number and efficiency, and units' times."""
    wall = _seconds(F.min("started"), F.max("ended"))
    busy, pids = F.sum("runtime"), F.count_distinct("pid")
    return units.groupBy(*keys).agg(
        wall.alias("wall"), pids.alias("processes"), (busy / F.nullif(wall, F.lit(0.0))).alias("mean_processes"), (100.0 * busy / F.nullif(wall * pids, F.lit(0.0))).alias("efficiency"),
        F.count_distinct("unit").alias("units"), F.avg("runtime").alias("mean_runtime"), F.median("runtime").alias("median_runtime"), F.max("runtime").alias("longest"),
        F.max_by("unit", F.struct("runtime", "unit")).alias("longest_unit"),
    )


def process_efficiency(units: DataFrame, keys: list[str]) -> DataFrame:
    """Each process's share of the time from its first start to the last end of its group, and the memory that it starts units with."""
    last = units.groupBy(*keys).agg(F.max("ended").alias("last"))
    g = units.groupBy(*keys, "pid").agg(
        F.sum("runtime").alias("busy"), F.min("started").alias("first"), F.min_by("ram_start", "started").alias("ram_first"), F.max_by("ram_start", "started").alias("ram_last"), F.min("ram_start").alias("ram_least"), F.max("ram_start").alias("ram_most")
    )
    span = _seconds(F.col("first"), F.col("last"))
    return g.join(last, keys).select(*keys, "pid", "busy", (100.0 * F.col("busy") / F.nullif(span, F.lit(0.0))).alias("efficiency"), "ram_first", "ram_last", "ram_least", "ram_most")


def step_shares(units: DataFrame, keys: list[str], step: str = "command", whole: str = "whole") -> DataFrame:
    """The share of all parallel work that each step inside a unit takes."""
    all_ = units.where(F.col(step) == whole).groupBy(*keys).agg(F.sum("runtime").alias("all"))
    d = units.where(F.col(step) != whole).groupBy(*keys, step).agg(F.sum("runtime").alias("runtime"))
    return d.join(all_, keys).select(*keys, step, "runtime", (100.0 * F.col("runtime") / F.nullif(F.col("all"), F.lit(0.0))).alias("percent"))


def plots(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """How long each plot took: until the next one starts; what follows the first ``finished`` doesn't count."""
    w = Window.partitionBy(*keys).orderBy("time", order)
    done = F.max(F.col("plot") == "finished").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = events.withColumns({"next": F.lead("time").over(w), "done": done})
    return d.where("not done and next is not null").select(*keys, order, "plot", _seconds(F.col("time"), F.col("next")).alias("runtime"))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds, without those that are 0 in front."""
    s = F.floor(seconds).cast("long")
    parts = [(F.floor(s / 86400), "day"), (F.floor(s % 86400 / 3600), "hour"), (F.floor(s % 3600 / 60), "minute"), (s % 60, "second")]
    named = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))) for n, unit in parts]
    return F.coalesce(F.nullif(F.concat_ws(", ", *named), F.lit("")), F.lit("0 seconds"))
