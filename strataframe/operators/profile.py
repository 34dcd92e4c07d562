"""Job timings: step durations, run totals, time series and model counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def profile_deltas(events: DataFrame, run: str = "run", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add ``delta`` seconds since the run's previous event; a run's first event is its start and takes 0."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(run).orderBy(ts, seq)
    return events.withColumn("delta", F.coalesce((micros - F.lag(micros).over(order)) / 1e6, F.lit(0.0)))


def known_steps(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events whose step the computation's version declares; ``steps (computation, version, step)``."""
    return events.join(steps, ["computation", "version", "step"], "left_semi")


def step_time(deltas: DataFrame) -> DataFrame:
    """Seconds per run and step; steps of a loop add up."""
    return deltas.groupBy("computation", "version", "run", "step").agg(F.sum("delta").alias("seconds"))


def profiles(deltas: DataFrame) -> DataFrame:
    """Entries ``(computation, version, run, start_time, steps map)``."""
    starts = deltas.groupBy("computation", "version", "run").agg(F.min("ts").alias("start_time"))
    steps = step_time(deltas).groupBy("computation", "version", "run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "seconds")))).alias("steps"))
    return starts.join(steps, ["computation", "version", "run"])


def in_range(profile: DataFrame, start: str, stop: str) -> DataFrame:
    """Runs that began between two times, both included."""
    ts = F.col("start_time").cast("timestamp")
    return profile.where(ts.between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))


def mean_step(profile: DataFrame) -> DataFrame:
    return profile.select("computation", "version", F.explode("steps").alias("step", "seconds")).groupBy("computation", "version", "step").agg(F.avg("seconds").alias("mean_seconds"))


def total_time(profile: DataFrame) -> DataFrame:
    total = F.aggregate(F.transform(F.array_sort(F.map_entries("steps")), lambda e: e["value"]), F.lit(0.0), lambda acc, v: acc + v)
    return profile.withColumn("total", total)


def timeseries(profile: DataFrame) -> DataFrame:
    """``(start_time, computation, version, run, step, ms)``."""
    return profile.select("start_time", "computation", "version", "run", F.explode("steps").alias("step", "seconds")).withColumn("ms", F.col("seconds") * 1000).drop("seconds")


def runs(profile: DataFrame) -> DataFrame:
    return profile.groupBy("computation", "version").agg(F.count(F.lit(1)).alias("runs"), F.max("start_time").alias("last_start"))


def last_step(profile: DataFrame) -> DataFrame:
    """The latest seconds of each step by computation and version."""
    rows = profile.select("computation", "version", "run", "start_time", F.explode("steps").alias("step", "seconds")).where("seconds IS NOT NULL")
    return rows.groupBy("computation", "version", "step").agg(F.max_by("seconds", F.struct("start_time", "run")).alias("seconds"))


def metadata_table(profile: DataFrame, columns: list[str], metadata: str = "metadata") -> DataFrame:
    """A fixed list of metadata keys as columns, missing ones null."""
    return profile.select("*", *[F.try_element_at(F.col(metadata), F.lit(c)).alias(c) for c in columns]).drop(metadata)


def model_counts(series: DataFrame, faults: DataFrame, contacts: DataFrame | None = None, dips: DataFrame | None = None, unit: bool = True, fault: bool = True) -> DataFrame:
    """Counts that describe a model: eroding and onlapping series, units without the dummy, faults, limits.

    With ``contacts (is_fault)`` and ``dips (is_fault)`` also the contact lines, which have two points each, and the
    dips, of units and of faults where asked for.
    """
    a = series.agg(F.count_if(F.col("relation") == "erode").alias("erode_series"), F.count_if(F.col("relation") == "onlap").alias("onlap_series"), (F.count(F.lit(1)) - 1).alias("units"))
    b = faults.agg(F.count_if(~F.col("infinite")).alias("finite_faults"), F.count_if("infinite").alias("infinite_faults"), F.coalesce(F.sum(F.coalesce(F.size("stops_on"), F.lit(0))), F.lit(0)).alias("limits"))
    out = a.join(F.broadcast(b))  # one row each
    sides = [side for side, asked in ((False, unit), (True, fault)) if asked]
    for rows, name, each in ((contacts, "contact_data", 2), (dips, "dips", 1)):
        if rows is not None:
            of = [F.floor(F.count_if(F.col("is_fault") == side) / each) for side in sides]
            out = out.join(F.broadcast(rows.agg(sum(of, F.lit(0)).cast("long").alias(name))))
    return out


def job_counts(jobs: DataFrame, **inputs: DataFrame) -> DataFrame:
    """Rows of each job's inputs, by the input's name; zero where a job has none.  All tables have a column ``job``."""
    out = jobs.select("job")
    for name, rows in inputs.items():
        out = out.join(rows.groupBy("job").agg(F.count(F.lit(1)).alias(name)), "job", "left")
    return out.na.fill(0, list(inputs))


def waypoints(segments: DataFrame, *keys: str) -> DataFrame:
    """Points between which a tunnel runs: one more than its path functions."""
    return segments.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("waypoints"))
