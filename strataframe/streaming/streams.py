"""Task and profile streams: windowed counts, latest states, limits and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from strataframe.runtime import shared_folder


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive; event times become instants so that they can carry a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def task_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling counts by state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "state", "n")


def latest_states(events: DataFrame) -> DataFrame:
    """The latest state of every task; for update or complete mode, state grows with tasks."""
    return events.groupBy("task").agg(F.max_by("state", F.struct("ts", "id")).alias("state"))


def sliding_runtime(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "name").agg(F.avg("runtime").alias("avg_runtime")).select(F.col("w.start").alias("bucket"), "name", "avg_runtime")


#: Relative error of the values that a sketch tells.
SKETCH_ERROR = 0.01


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def runtime_sketches(events: DataFrame, slide: str = "1 day", late: str = "1 day", error: float = SKETCH_ERROR, value: str = "runtime") -> DataFrame:
    """Sketches ``(bucket, name, sgn, bin, n)`` of a value by tumbling window: counts of values by the power of
    (1 + error) / (1 - error) that they do not exceed.

    Counts add up, so sketches of windows, batches and names can be merged in any order, and a window holds at most
    as many rows as there are powers (1,460 / error for all doubles), however many events it has.  Values that are
    null or not finite take no part.
    """
    x = F.col(value).cast("double")
    power = F.ceil(F.log(F.abs(x)) / F.log(F.lit(_gamma(error)))).cast("int")
    told = events.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select("ts", "name", F.signum(x).cast("int").alias("sgn"), F.when(x == 0, 0).otherwise(power).alias("bin"))
    counted = told.withWatermark("ts", late).groupBy(F.window("ts", slide).alias("w"), "name", "sgn", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), "name", "sgn", "bin", "n")


def sliding_quantiles(sketches: DataFrame, qs: list[float], width: str = "7 days", slide: str = "1 day", error: float = SKETCH_ERROR) -> DataFrame:
    """Quantiles ``(bucket, name, n, p..)`` of windows merged from the sketches of ``runtime_sketches``.

    The value of rank ceil(q n), counted from 1, is told within ``error`` of itself; windows begin at ``bucket``.
    Only sketches are moved: each goes to the windows that cover it and counts are added before and after.
    """
    merged = sketches.groupBy(F.window("bucket", width, slide).alias("w"), "name", "sgn", "bin").agg(F.sum("n").alias("n"))
    by_window = Window.partitionBy("w", "name")
    upto = by_window.orderBy("sgn", F.col("sgn") * F.col("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"_upto": F.sum("n").over(upto), "_n": F.sum("n").over(by_window)})
    gamma = _gamma(error)
    known = F.col("sgn") * F.lit(2 / (1 + gamma)) * F.pow(F.lit(gamma), F.col("bin"))
    reached = lambda q: F.when(F.col("_upto") >= F.ceil(F.col("_n") * F.lit(float(q))), F.struct("_upto", known.alias("v")))
    out = ranked.groupBy("w", "name").agg(F.max("_n").alias("n"), *[F.min(reached(q))["v"].alias(f"p{round(q * 100)}") for q in qs])
    return out.select(F.col("w.start").alias("bucket"), "name", "n", *[f"p{round(q * 100)}" for q in qs])


def first_of_task(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per task id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task"])


def retained_stream(events: DataFrame, hours: float = 8) -> DataFrame:
    """Rows no older than ``hours`` when they are read."""
    return events.where(F.col("ts") >= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(int(hours))))


#: States that end a task.  Fixed values.
ENDS = ("SUCCESS", "FAILURE", "REVOKED")


def overdue_tasks(events: DataFrame, hours: float = 6, late: str = "1 hour") -> DataFrame:
    """``(task, started)`` of tasks that began and had no end within ``hours``, emitted once the watermark passes that.

    The limit runs from the latest start: a task may have begun and ended before, and a new start sets its timer
    anew.  A task's state is its latest start and end; it goes when its timer ends, ended tasks' as well, so the
    state holds what happened within ``hours`` and the lateness.  Rows without a task or a time are left out.
    """
    limit = int(hours * 3600e3)
    schema = T.StructType([T.StructField("task", events.schema["task"].dataType), T.StructField("started", T.TimestampType())])

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended = state.get if state.exists else (None, None)
        is_open = lambda: started is not None and (ended is None or ended < started)
        if state.hasTimedOut:
            state.remove()
            if is_open():
                yield pd.DataFrame({"task": [key[0]], "started": [pd.Timestamp(started, unit="us", tz="UTC")]})
            return
        for rows in frames:
            for kinds, last in ((("STARTED",), started), (ENDS, ended)):
                times = rows.loc[rows["state"].isin(kinds), "us"].tolist() + ([] if last is None else [last])
                if kinds == ENDS:
                    ended = max(times, default=None)
                else:
                    started = max(times, default=None)
        known = [t for t in (started, ended) if t is not None]
        if known:
            state.update((started, ended))
            state.setTimeoutTimestamp(max((started if is_open() else max(known)) // 1000 + limit, state.getCurrentWatermarkMs() + 1))

    asked = events.where("task IS NOT NULL AND ts IS NOT NULL").select("task", "ts", "state", F.unix_micros("ts").alias("us"))
    return asked.withWatermark("ts", late).groupBy("task").applyInPandasWithState(follow, schema, "started long, ended long", "append", "EventTimeTimeout")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what has arrived, then give its result table, from Parquet files in the shared folder.

    Tasks write every batch to a folder of its own, so a batch that is run again replaces itself and no row
    reaches the driver; in complete mode the latest batch is the result.
    """
    spark, folder, batches = stream.sparkSession, shared_folder(stream.sparkSession, name), []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{batch}")
        batches.append(batch)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{folder}/{b}" for b in (wanted[-1:] if mode == "complete" else wanted)]
    return spark.read.schema(stream.schema).parquet(*paths)
