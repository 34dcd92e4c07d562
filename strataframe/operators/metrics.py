"""Task outcomes and counters: rates, quantiles, counts by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataframe.operators.spatial import segmented
from strataframe.runtime import cut

#: States of a task that are counted.  Fixed values.
STATES = ("RECEIVED", "SENT", "STARTED", "SUCCESS", "FAILURE", "REJECTED", "RETRY", "REVOKED")


def _is(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def task_stats(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(*[_is(s).alias(s.lower()) for s in STATES])


def success_rate(events: DataFrame, *keys: str) -> DataFrame:
    """Successes among successes and failures; null where there are neither."""
    ok, bad = _is("SUCCESS"), _is("FAILURE")
    return events.groupBy(*keys).agg((ok / F.nullif(ok + bad, F.lit(0))).alias("success_rate"))


def avg_runtime(events: DataFrame, *keys: str) -> DataFrame:
    """Mean runtime of groups that ran at all; only positive means."""
    return events.groupBy(*keys).agg((F.sum("runtime") / F.nullif(F.count("runtime"), F.lit(0))).alias("avg_runtime")).where("avg_runtime > 0")


def failures(events: DataFrame, *keys: str) -> DataFrame:
    return events.where("state = 'FAILURE'").groupBy(*keys).agg(F.count(F.lit(1)).alias("failures")).where("failures > 0")


def top(rows: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(k)


def latest_state(events: DataFrame) -> DataFrame:
    """The latest state of every task; equal times are decided by event id."""
    return events.groupBy("task").agg(F.max_by("state", F.struct("ts", "id")).alias("state"))


def poll_status(ids: DataFrame, events: DataFrame) -> DataFrame:
    """The state of each asked task id; unknown ids are pending."""
    return ids.join(latest_state(events), "task", "left").select("task", F.coalesce("state", F.lit("PENDING")).alias("state"))


def queue_length(events: DataFrame) -> DataFrame:
    """By queue and name: tasks whose latest event is a start, and tasks seen."""
    last = events.groupBy("queue", "name", "task").agg(F.max_by("state", F.struct("ts", "id")).alias("state"))
    return last.groupBy("queue", "name").agg(F.count_if(F.col("state") == "STARTED").alias("active"), F.count(F.lit(1)).alias("tasks"))


def runtime_quantiles(events: DataFrame, bounds: list[float], qs: list[float], *keys: str) -> DataFrame:
    """Quantiles from cumulative buckets, linear inside a bucket; above the last bound, that bound."""
    les = F.array(*[F.lit(float(b)) for b in bounds])
    counts = events.where("runtime IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("runtime") <= b) for b in bounds]).alias("cum"))

    def at(q: float) -> Column:
        want = F.col("n") * F.lit(q)
        k = F.array_position(F.transform("cum", lambda c: c >= want), F.lit(True))
        high, below = F.element_at(les, F.greatest(k, F.lit(1)).cast("int")), F.when(k > 1, F.element_at("cum", F.greatest(k - 1, F.lit(1)).cast("int"))).otherwise(F.lit(0))
        low = F.when(k > 1, F.element_at(les, F.greatest(k - 1, F.lit(1)).cast("int"))).otherwise(F.lit(0.0))
        here = F.element_at("cum", F.greatest(k, F.lit(1)).cast("int")) - below
        return F.when(k == 0, F.lit(float(bounds[-1]))).otherwise(low + (high - low) * (want - below) / F.nullif(here, F.lit(0)))

    return counts.select(*keys, *[at(q).alias(f"p{round(q * 100)}") for q in qs])


def _micros(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


_SAMPLE = ("series", "_t", "seq")


def counter_steps(samples: DataFrame) -> DataFrame:
    """Samples in the order of their series, time and number, with ``_d``, what each rose by, ``_p``, the time of the one
    before it, and ``_c``, what its series rose by up to it.

    A fall is a reset and counts its new value; the first sample of a series rises by nothing.  Samples are sorted
    into range partitions, so those of one hot series lie in many of them; within a partition steps are told by its own
    rows, and one row a partition carries the last sample and the sums over to the next.
    """
    placed = segmented(samples.withColumn("_t", _micros()), *_SAMPLE)
    inside = Window.partitionBy("_part").orderBy("_at")
    here = F.struct("series", F.col("value").alias("v"), F.col("_t").alias("t"))
    last = placed.groupBy("_part").agg(F.max_by(here, "_at").alias("_last"))
    carried = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))  # one row a partition
    met = placed.join(F.broadcast(carried), "_part").withColumn("_before", F.coalesce(F.lag(here).over(inside), "_before"))
    own = F.col("_before.series").eqNullSafe(F.col("series")) & F.col("_before").isNotNull()
    rise = F.when(F.col("value") < F.col("_before.v"), F.col("value")).otherwise(F.col("value") - F.col("_before.v"))
    steps = cut(met.withColumns({"_d": F.when(own & F.col("_before.v").isNotNull(), rise).otherwise(F.lit(0.0)), "_p": F.when(own, F.col("_before.t"))}).drop("_before"))
    parts = steps.groupBy("_part", "series").agg(F.sum("_d").alias("_s"))
    earlier = Window.partitionBy("series").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("_part", F.col("series").alias("_series"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_base"))
    so_far = F.sum("_d").over(Window.partitionBy("_part", "series").orderBy("_at"))
    summed = steps.withColumn("_c", so_far).join(firsts.withColumnRenamed("_part", "_q"), (F.col("_part") == F.col("_q")) & F.col("series").eqNullSafe(F.col("_series")))
    return summed.withColumn("_c", F.col("_c") + F.col("_base")).drop("_q", "_series", "_base")


def counter_increase(samples: DataFrame) -> DataFrame:
    """What each counter rose by; a fall is a reset and counts its new value."""
    return counter_steps(samples).groupBy("series").agg(F.sum("_d").alias("increase"))


def counter_rate(samples: DataFrame) -> DataFrame:
    """Rise per second over the whole range, and between the last two samples."""
    last = F.struct("_t", "seq")
    return counter_steps(samples).groupBy("series").agg(
        (F.sum("_d") / F.nullif((F.max("_t") - F.min("_t")) / 1e6, F.lit(0.0))).alias("rate"),
        (F.max_by("_d", last) / F.nullif((F.max_by("_t", last) - F.max_by("_p", last)) / 1e6, F.lit(0.0))).alias("irate"),
    )


def tasks_over_time(events: DataFrame, width: str = "1 day", *keys: str) -> DataFrame:
    bucket = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(bucket.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), *keys, "n")


def overdue(events: DataFrame, hours: float = 6) -> DataFrame:
    """Tasks that began a stretch and had no end within ``hours`` of its start, as of the last event seen."""
    begun = events.groupBy("task").agg(F.max(F.when(F.col("state") == "STARTED", F.col("ts"))).alias("started"), F.max(F.when(F.col("state").isin("SUCCESS", "FAILURE", "REVOKED"), F.col("ts"))).alias("ended"))
    now = events.agg(F.max("ts").alias("now"))
    late = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")) > hours * 3600e6
    return begun.join(F.broadcast(now)).where(F.col("started").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("started"))) & late).select("task", "started")


def retained(events: DataFrame, hours: float = 8) -> DataFrame:
    """Events of the last ``hours`` before the latest one."""
    now = events.agg(F.max("ts").alias("_now"))
    age = F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.join(F.broadcast(now)).where(age <= hours * 3600e6).drop("_now")


def _trailing(seconds: float, *keys: str):
    return Window.partitionBy(*keys).orderBy("_t").rangeBetween(-int(seconds * 1e6), Window.currentRow)


def trailing_increase(samples: DataFrame, seconds: float) -> DataFrame:
    """Samples with ``increase``, what their counter rose by in the ``seconds`` up to them, ends included.

    Rises are told between samples of the range; what the first of them rose by before it is left out.  Every sample
    asks for the first one of its range: asking rows and samples are sorted together into range partitions, where a
    row finds the next sample behind it, or else the first one of the next partition that has any.  A sum is then two
    running sums apart.  Samples of one time all count for each other.
    """
    steps = cut(counter_steps(samples).withColumn("_id", F.struct("_part", "_at")).drop("_part", "_at"))
    kind = F.lit(0).alias("_k")
    asking = steps.select("series", (F.col("_t") - int(seconds * 1e6)).alias("_t"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("_c"), kind, "_id")
    told = steps.select("series", "_t", F.col("seq").cast("long").alias("seq"), "_c", F.lit(1).alias("_k"), "_id")
    placed = segmented(asking.unionByName(told), "series", "_t", "_k", "seq")
    sample = F.when(F.col("_k") == 1, F.struct("series", "_c"))
    heads = placed.groupBy("_part").agg(F.min_by(sample, F.when(F.col("_k") == 1, F.col("_at"))).alias("_head"))
    # read backwards, so that a frame grows by a row and is not read anew for each
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", F.last("_head", ignorenulls=True).over(later).alias("_next"))  # one row a partition
    behind = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_own", F.last(sample, ignorenulls=True).over(behind)).where("_k = 0").join(F.broadcast(heads), "_part")
    first = found.select("_id", F.coalesce("_own", "_next")["_c"].alias("_first"))
    # of equal times, the range of each reaches to the last
    upto = steps.groupBy("series", "_t").agg(F.max("_c").alias("_upto")).withColumnsRenamed({"series": "_series", "_t": "_time"})
    met = steps.join(first, "_id").join(upto, F.col("series").eqNullSafe(F.col("_series")) & (F.col("_t") == F.col("_time")))
    return met.select(*samples.columns, (F.col("_upto") - F.col("_first")).alias("increase"))


def trailing_counts(events: DataFrame, seconds: float, width: str = "1 day", *keys: str) -> DataFrame:
    """Buckets ``(bucket, keys..., n)`` with the tasks of the trailing ``seconds`` up to each bucket, it included.

    Events are counted by bucket first, so the window sees buckets and not events.
    """
    counted = tasks_over_time(events, width, *keys).withColumn("_t", F.unix_micros("bucket"))
    return counted.withColumn("n", F.sum("n").over(_trailing(seconds, *keys))).drop("_t")


def workers_up(events: DataFrame, seconds: float, *keys: str, worker: str = "worker") -> DataFrame:
    """Workers seen in the last ``seconds`` before the latest event, and workers seen at all."""
    now = events.agg(F.max("ts").alias("_now"))
    last = events.groupBy(*keys, worker).agg(F.max("ts").alias("_last")).join(F.broadcast(now))  # one row
    age = F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    return last.groupBy(*keys).agg(F.count_if(age <= seconds * 1e6).alias("up"), F.count(F.lit(1)).alias("workers"))


def runtime_percentiles(events: DataFrame, qs: list[float], key: str) -> DataFrame:
    """Exact percentiles of raw runtimes, linear between the two nearest ranks.

    Runtimes are ranked by range partitions, so the values of one key never meet in one task; only the ranks
    that a percentile asks for are kept.
    """
    from strataframe.operators.spatial import ranked

    rows = ranked(events.where("runtime IS NOT NULL").select(key, F.col("runtime").cast("double").alias("runtime")), key, "runtime")
    first = rows.groupBy(key).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    asked = first.select(key, "_first", "_n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    at = (F.col("_n") - 1) * F.col("q")
    ends = asked.select(key, "q", (at - F.floor(at)).alias("_share"), (F.col("_first") + F.floor(at)).alias("low"), (F.col("_first") + F.ceil(at)).alias("high"))
    wanted = ends.select(key, "q", F.explode(F.array(F.struct(F.col("low").alias("pos"), (1 - F.col("_share")).alias("w")), F.struct(F.col("high").alias("pos"), F.col("_share").alias("w")))).alias("e"))
    met = wanted.select(key, "q", "e.pos", "e.w").join(rows.select("pos", "runtime"), "pos")
    by_q = met.groupBy(key, "q").agg(F.sum(F.col("runtime") * F.col("w")).alias("v"))
    return by_q.groupBy(key).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{round(q * 100)}") for q in qs])
