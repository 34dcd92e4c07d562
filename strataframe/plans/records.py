"""Registered queries over job timings, task events, counters and streams, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.functions import vector as V
from strataframe.operators import metrics as M, profile as P
from strataframe.plans.views import oracle, view
from strataframe.runtime import shared_folder
from strataframe.streaming import stores, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its oracle if SQL has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _r(*names: str) -> list:
    return [V.tidy(F.col(n)).alias(n) for n in names]


_D = """dl AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY ts, seq)) / 1e6, 0e0) AS delta FROM profile_events),
st AS (SELECT computation, version, run, step, sum(delta) AS seconds FROM dl GROUP BY ALL),
pr AS (SELECT computation, version, run, min(ts) AS start_time FROM dl GROUP BY ALL)"""
_FROM, _TO = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def _deltas(spark, sf):
    return P.profile_deltas(view(spark, sf, "profile_events"))


def _profiles(spark, sf):
    return P.profiles(_deltas(spark, sf))


@query(f"WITH {_D} SELECT run, seq, step, round(delta, 6) + 0e0 AS delta FROM dl")
def profile_deltas(spark, sf):
    return _deltas(spark, sf).select("run", "seq", "step", *_r("delta"))


@query(f"WITH {_D} SELECT run, step, round(seconds, 6) + 0e0 AS seconds FROM st")
def profile_step_time(spark, sf):
    return P.step_time(_deltas(spark, sf)).select("run", "step", *_r("seconds"))


@query("SELECT run, seq, step FROM profile_events WHERE step IN ('click', 'view', 'purchase') AND NOT (computation = 'voxels' AND step = 'view') AND version IN (1, 2, 3, 4)")
def profile_known_steps(spark, sf):
    rows = view(spark, sf, "profile_events")
    declared = rows.select("computation", "version").distinct().withColumn("step", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")))).where("NOT (computation = 'voxels' AND step = 'view')")
    return P.known_steps(rows, declared).select("run", "seq", "step")


@query(f"WITH {_D} SELECT computation, version, run FROM pr WHERE start_time BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'")
def profile_in_range(spark, sf):
    return P.in_range(_profiles(spark, sf), _FROM, _TO).select("computation", "version", "run")


@query(f"WITH {_D} SELECT computation, version, step, round(avg(seconds), 4) + 0e0 AS mean_seconds FROM st JOIN pr USING (computation, version, run) WHERE start_time BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}' GROUP BY ALL")
def profile_mean_step(spark, sf):
    return P.mean_step(P.in_range(_profiles(spark, sf), _FROM, _TO)).select("computation", "version", "step", V.tidy(F.col("mean_seconds"), 4).alias("mean_seconds"))


@query(f"WITH {_D} SELECT computation, version, run, round(sum(seconds), 6) + 0e0 AS total FROM st GROUP BY ALL")
def profile_total(spark, sf):
    return P.total_time(_profiles(spark, sf)).select("computation", "version", "run", *_r("total"))


@query(f"WITH {_D} SELECT computation, version, run, step, round(seconds * 1000, 3) + 0e0 AS ms, epoch_us(start_time) AS start_us FROM st JOIN pr USING (computation, version, run) WHERE start_time BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'")
def profile_timeseries(spark, sf):
    rows = P.timeseries(P.in_range(_profiles(spark, sf), _FROM, _TO))
    return rows.select("computation", "version", "run", "step", V.tidy(F.col("ms"), 3).alias("ms"), F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"))


@query(f"WITH {_D} SELECT computation, version, count(*) AS runs, epoch_us(max(start_time)) AS last_us FROM pr GROUP BY ALL")
def profile_runs(spark, sf):
    return P.runs(_profiles(spark, sf)).select("computation", "version", "runs", F.unix_micros(F.col("last_start").cast("timestamp")).alias("last_us"))


@query(f"WITH {_D} SELECT computation, version, step, round(max_by(seconds, (start_time, run)), 6) + 0e0 AS seconds FROM st JOIN pr USING (computation, version, run) GROUP BY ALL")
def profile_last_step(spark, sf):
    return P.last_step(_profiles(spark, sf)).select("computation", "version", "step", *_r("seconds"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def profile_table(spark, sf):
    """Job metadata merged from columns and JSON, as a fixed list of columns."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select("event_id", V.merge_metadata(F.create_map(F.lit("kind"), F.col("event_type")), V.parse_metadata(F.col("props"))).alias("metadata"))
    return P.metadata_table(rows, ["kind", "k", "missing"])


@query("""SELECT count(*) FILTER (relation = 'erode') AS erode_series, count(*) FILTER (relation = 'onlap') AS onlap_series, count(*) - 1 AS units,
(SELECT count(*) FROM faults WHERE NOT infinite) AS finite_faults, (SELECT count(*) FROM faults WHERE infinite) AS infinite_faults, (SELECT count(stops_on) FROM faults) AS limits,
(SELECT count(*) FILTER (NOT is_fault) // 2 + count(*) FILTER (is_fault) // 2 FROM contact_points) AS contact_data, (SELECT count(*) FROM dips) AS dips FROM series""")
def model_counts(spark, sf):
    f = view(spark, sf, "faults").withColumn("stops_on", F.filter(F.array("stops_on"), lambda x: x.isNotNull()))
    return P.model_counts(view(spark, sf, "series"), f, view(spark, sf, "contact_points"), view(spark, sf, "dips"))


@query("SELECT count(*) FILTER (is_fault) // 2 AS contact_data, (SELECT count(*) FROM dips WHERE is_fault) AS dips FROM contact_points")
def fault_model_counts(spark, sf):
    """Contact lines and dips of faults alone, as fault jobs count them."""
    f = view(spark, sf, "faults").withColumn("stops_on", F.filter(F.array("stops_on"), lambda x: x.isNotNull()))
    return P.model_counts(view(spark, sf, "series"), f, view(spark, sf, "contact_points"), view(spark, sf, "dips"), unit=False).select("contact_data", "dips")


@query("""SELECT n_nationkey AS job, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS springs, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS drillholes,
(SELECT count(*) FROM sections WHERE section_id % 25 = n_nationkey) AS sections, (SELECT count(*) FROM supplier WHERE s_suppkey % 25 = n_nationkey) AS gwb_parts,
(SELECT CAST(sum(w) AS BIGINT) FROM (SELECT count(*) + 1 AS w FROM tunnels WHERE CAST(floor(tunnel / 10) AS INT) % 25 = n_nationkey GROUP BY tunnel)) AS waypoints FROM nation""")
def job_counts(spark, sf):
    """Inputs of every job, each counted apart and joined, zero where there are none; waypoints of all its tunnels."""
    jobs = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("job"))
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    inputs = {
        "springs": suppliers.select(F.col("s_nationkey").alias("job")),
        "drillholes": spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("job")),
        "sections": view(spark, sf, "sections").select((F.col("section_id") % 25).alias("job")),
        "gwb_parts": view(spark, sf, "boxes").select((F.col("mesh_id") % 25).cast("int").alias("job")),
    }
    tunnels = view(spark, sf, "tunnels").withColumn("job", F.floor(F.col("tunnel") / 10).cast("int") % 25)
    points = P.waypoints(tunnels, "job", "tunnel").groupBy("job").agg(F.sum("waypoints").alias("waypoints"))
    return P.job_counts(jobs, **inputs).join(points, "job", "left")


_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in M.STATES)


@query(f"SELECT queue, name, {_COUNTS} FROM task_events GROUP BY ALL")
def task_stats(spark, sf):
    return M.task_stats(view(spark, sf, "task_events"), "queue", "name")


@query("SELECT queue, task % 5 AS job, round(count(*) FILTER (state = 'SUCCESS') / nullif(count(*) FILTER (state IN ('SUCCESS', 'FAILURE')), 0), 6) + 0e0 AS success_rate FROM task_events GROUP BY ALL")
def success_rate(spark, sf):
    rows = view(spark, sf, "task_events").withColumn("job", F.col("task") % 5)
    return M.success_rate(rows, "queue", "job").select("queue", "job", *_r("success_rate"))


@query("SELECT name, round(sum(runtime) / nullif(count(runtime), 0), 5) + 0e0 AS avg_runtime FROM task_events GROUP BY name HAVING sum(runtime) > 0")
def avg_runtime(spark, sf):
    return M.avg_runtime(view(spark, sf, "task_events"), "name").select("name", V.tidy(F.col("avg_runtime"), 5).alias("avg_runtime"))


@query("SELECT name, exception, count(*) AS failures FROM task_events WHERE state = 'FAILURE' GROUP BY ALL")
def failures_by_exception(spark, sf):
    return M.failures(view(spark, sf, "task_events"), "name", "exception")


@query("SELECT task, count(*) AS failures FROM task_events WHERE state = 'FAILURE' GROUP BY ALL ORDER BY failures DESC, task LIMIT 10")
def top_failures(spark, sf):
    return M.top(M.failures(view(spark, sf, "task_events"), "task"), "failures", 10, "task")


@query("SELECT task, max_by(state, (ts, id)) AS state FROM task_events GROUP BY task UNION ALL SELECT c_custkey, 'PENDING' FROM customer WHERE c_custkey NOT IN (SELECT task FROM task_events)")
def poll_status(spark, sf):
    events = view(spark, sf, "task_events")
    ids = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("task")).union(events.select("task")).distinct()
    return M.poll_status(ids, events)


@query("WITH l AS (SELECT queue, name, task, max_by(state, (ts, id)) AS state FROM task_events GROUP BY ALL) SELECT queue, name, count(*) FILTER (state = 'STARTED') AS active, count(*) AS tasks FROM l GROUP BY ALL")
def queue_length(spark, sf):
    return M.queue_length(view(spark, sf, "task_events"))


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0]


@query(f"""WITH b AS (SELECT unnest({_BOUNDS}::DOUBLE[]) AS le, unnest(range({len(_BOUNDS)})) AS k),
c AS (SELECT name, le, k, count(*) FILTER (runtime <= le) AS cum, count(*) AS n FROM task_events, b GROUP BY ALL),
w AS (SELECT *, coalesce(lag(cum) OVER s, 0) AS below, coalesce(lag(le) OVER s, 0e0) AS low FROM c WINDOW s AS (PARTITION BY name ORDER BY le)),
q AS (SELECT name, qq, min_by(low + (le - low) * (n * qq - below) / nullif(cum - below, 0), k) AS v FROM w, (VALUES (0.5e0), (0.95e0), (0.99e0)) AS t(qq) WHERE cum >= n * qq GROUP BY ALL)
SELECT name, round(coalesce(max(v) FILTER (qq = 0.5e0), 400e0), 6) AS p50, round(coalesce(max(v) FILTER (qq = 0.95e0), 400e0), 6) AS p95, round(coalesce(max(v) FILTER (qq = 0.99e0), 400e0), 6) AS p99 FROM q GROUP BY name""")
def runtime_quantiles(spark, sf):
    return M.runtime_quantiles(view(spark, sf, "task_events"), _BOUNDS, [0.5, 0.95, 0.99], "name").select("name", *_r("p50", "p95", "p99"))


_INC = "inc AS (SELECT *, lag(value) OVER w AS prev, lag(epoch_us(ts)) OVER w AS pt FROM counters WINDOW w AS (PARTITION BY series ORDER BY ts, seq)), d AS (SELECT *, CASE WHEN prev IS NULL THEN 0e0 WHEN value < prev THEN value ELSE value - prev END AS dv FROM inc)"


@query(f"WITH {_INC} SELECT series, round(sum(dv), 3) + 0e0 AS increase FROM d GROUP BY series")
def counter_increase(spark, sf):
    return M.counter_increase(view(spark, sf, "counters")).select("series", V.tidy(F.col("increase"), 3).alias("increase"))


@query(f"WITH {_INC} SELECT series, round(sum(dv) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) + 0e0 AS rate, round(max_by(dv, (ts, seq)) / ((max_by(epoch_us(ts), (ts, seq)) - max_by(pt, (ts, seq))) / 1e6), 6) + 0e0 AS irate FROM d GROUP BY series")
def counter_rate(spark, sf):
    return M.counter_rate(view(spark, sf, "counters")).select("series", *_r("rate", "irate"))


@query(f"""WITH {_INC}, t AS (SELECT *, epoch_us(ts) AS us FROM d)
SELECT series, seq, round(sum(dv) OVER w - arg_min(dv, (us, seq)) OVER w, 3) + 0e0 AS increase FROM t
WINDOW w AS (PARTITION BY series ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""")
def counter_increase_week(spark, sf):
    """What each counter rose by in the week up to each of its samples."""
    rows = M.trailing_increase(view(spark, sf, "counters"), 7 * 86400)
    return rows.select("series", "seq", V.tidy(F.col("increase"), 3).alias("increase"))


@query("""SELECT queue, count(*) FILTER (age <= 86400000000) AS up, count(*) AS workers
FROM (SELECT queue, task % 37 AS worker, epoch_us((SELECT max(ts) FROM task_events)) - epoch_us(max(ts)) AS age FROM task_events GROUP BY ALL) GROUP BY queue""")
def workers_up(spark, sf):
    """Workers of each queue seen on the last day."""
    return M.workers_up(view(spark, sf, "task_events").withColumn("worker", F.col("task") % 37), 86400, "queue")


@query("SELECT name, round(quantile_cont(runtime, 0.5), 6) + 0e0 AS p50, round(quantile_cont(runtime, 0.95), 6) + 0e0 AS p95, round(quantile_cont(runtime, 0.99), 6) + 0e0 AS p99 FROM task_events WHERE runtime IS NOT NULL GROUP BY name")
def runtime_percentiles(spark, sf):
    return M.runtime_percentiles(view(spark, sf, "task_events"), [0.5, 0.95, 0.99], "name").select("name", *_r("p50", "p95", "p99"))


_DAY = "epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))"


@query(f"SELECT {_DAY} AS bucket_us, queue, count(*) AS n FROM task_events GROUP BY ALL")
def tasks_over_time(spark, sf):
    return M.tasks_over_time(view(spark, sf, "task_events"), "1 day", "queue").select(F.unix_micros("bucket").alias("bucket_us"), "queue", "n")


@query(f"""WITH c AS (SELECT {_DAY} AS bucket_us, queue, count(*) AS c FROM task_events GROUP BY ALL)
SELECT bucket_us, queue, CAST(sum(c) OVER (PARTITION BY queue ORDER BY bucket_us RANGE BETWEEN 518400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM c""")
def tasks_trailing(spark, sf):
    """Tasks of the week that ends with each day, by queue."""
    rows = M.trailing_counts(view(spark, sf, "task_events"), 6 * 86400, "1 day", "queue")
    return rows.select(F.unix_micros("bucket").alias("bucket_us"), "queue", "n")


@query("""WITH t AS (SELECT task, max(ts) FILTER (state = 'STARTED') AS started, max(ts) FILTER (state IN ('SUCCESS', 'FAILURE', 'REVOKED')) AS ended FROM task_events GROUP BY task)
SELECT task, epoch_us(started) AS started_us FROM t WHERE started IS NOT NULL AND (ended IS NULL OR ended < started) AND epoch_us((SELECT max(ts) FROM task_events)) - epoch_us(started) > 6 * 3600000000""")
def overdue_tasks(spark, sf):
    return M.overdue(view(spark, sf, "task_events")).select("task", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"))


@query("SELECT id, name, state FROM task_events WHERE epoch_us((SELECT max(ts) FROM task_events)) - epoch_us(ts) <= 8 * 3600000000")
def retained_events(spark, sf):
    return M.retained(view(spark, sf, "task_events")).select("id", "name", "state")


def _stream(spark, sf):
    """The events table as a stream of files, with the columns of ``task_events``."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = streams.event_stream(spark, f"{sf}/events.parquet*", schema)
    state = F.expr("CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_id % 11 = 0 THEN 'RETRY' WHEN event_id % 13 = 0 THEN 'REVOKED' WHEN event_id % 7 = 0 THEN 'STARTED' ELSE 'SUCCESS' END")
    return raw.select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("name"), state.alias("state"), F.col("user_id").alias("task"), F.col("value").alias("runtime"))


def _drain(spark, stream, mode="complete"):
    return streams.drained(stream, "drained", shared_folder(spark, "stream"), mode)


@query(f"SELECT {_DAY} AS bucket_us, state, count(*) AS n FROM task_events GROUP BY ALL")
def stream_task_counts(spark, sf):
    return _drain(spark, streams.task_counts(_stream(spark, sf))).select(F.unix_micros("bucket").alias("bucket_us"), "state", "n")


@query("SELECT task, max_by(state, (ts, id)) AS state FROM task_events GROUP BY task")
def stream_latest_state(spark, sf):
    """Every batch writes the tasks that it names; the store is read back once the stream is drained."""
    store, events = shared_folder(spark, "states"), _stream(spark, sf)
    stores.upsert_states(events, store).awaitTermination()
    return stores.read_states(spark, store, events.schema)


@query("""WITH d AS (SELECT CAST(ts AS DATE) - CAST(k AS INT) AS bucket, name, runtime FROM task_events, range(7) AS q(k))
SELECT epoch_us(CAST(bucket AS TIMESTAMP)) AS bucket_us, name, round(avg(runtime), 5) + 0e0 AS avg_runtime FROM (SELECT CAST(bucket AS DATE) AS bucket, name, runtime FROM d) GROUP BY ALL""")
def stream_sliding_runtime(spark, sf):
    return _drain(spark, streams.sliding_runtime(_stream(spark, sf))).select(F.unix_micros("bucket").alias("bucket_us"), "name", V.tidy(F.col("avg_runtime"), 5).alias("avg_runtime"))


_GAMMA = repr((1 + streams.SKETCH_ERROR) / (1 - streams.SKETCH_ERROR))


@query(f"""WITH v AS (SELECT CAST(ts AS DATE) AS day, name, CAST(sign(runtime) AS INT) AS sgn, CASE WHEN runtime = 0 THEN 0 ELSE CAST(ceil(ln(abs(nullif(runtime, 0e0))) / ln({_GAMMA}e0)) AS INT) END AS bin
  FROM task_events WHERE runtime IS NOT NULL AND isfinite(runtime)),
m AS (SELECT CAST(day - CAST(k AS INT) AS DATE) AS bucket, name, sgn, bin, count(*) AS c FROM v, range(7) AS q(k) GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY bucket, name ORDER BY sgn, sgn * bin) AS upto, sum(c) OVER (PARTITION BY bucket, name) AS n FROM m)
SELECT epoch_us(CAST(bucket AS TIMESTAMP)) AS bucket_us, name, CAST(max(n) AS BIGINT) AS n, {", ".join(f"round(arg_min(sgn * (2e0 / (1e0 + {_GAMMA}e0)) * pow({_GAMMA}e0, bin), upto) FILTER (upto >= ceil(n * {q}e0)), 5) + 0e0 AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))}
FROM r GROUP BY bucket, name""")
def stream_sliding_quantiles(spark, sf):
    """Medians and upper quantiles of the runtimes of each week, by day and name, from sketches that a stream keeps by day."""
    kept = _drain(spark, streams.runtime_sketches(_stream(spark, sf)))
    out = streams.sliding_quantiles(kept, [0.5, 0.95, 0.99])
    return out.select(F.unix_micros("bucket").alias("bucket_us"), "name", "n", *[V.tidy(F.col(p), 5).alias(p) for p in ("p50", "p95", "p99")])


@query("SELECT CAST(count(DISTINCT task) AS BIGINT) AS tasks FROM task_events")
def stream_distinct_tasks(spark, sf):
    """Task ids that a deduplicating stream lets through once, its watermark spanning all events."""
    return _drain(spark, streams.first_of_task(_stream(spark, sf), "400 days"), "append").agg(F.count(F.lit(1)).alias("tasks"))
