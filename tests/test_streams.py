"""Streams that keep stores: latest states, timing entries and sketches, with batches that are lost and run again."""

import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import metrics
from strataframe.sources import readers
from strataframe.streaming import stores, streams

START = datetime.datetime(2024, 1, 1)
EVENT = "ts timestamp, id long, name string, state string, task long, runtime double"


def _fill(spark, folder, rows, schema, files):
    """``rows`` as files that a stream reads one by one, in order."""
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        newest = max((e for e in os.scandir(folder) if e.name.startswith("part")), key=lambda e: e.stat().st_ctime_ns)
        os.utime(newest.path, (1_700_000_000 + 10 * k,) * 2)
    return spark.createDataFrame(rows, schema)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _events(n, tasks, seed=1):
    draw = random.Random(seed)
    kinds = ("STARTED", "SUCCESS", "RETRY")
    at = [START + datetime.timedelta(hours=draw.randrange(400)) for _ in range(n)]
    return [(at[k], k, draw.choice("ab"), draw.choice(kinds), draw.choice([None, *range(tasks)]), draw.uniform(-5, 50)) for k in range(n)]


def _run(query):
    query.awaitTermination()


def test_latest_states_by_batch_equal_the_whole(spark, tmp_path):
    rows = _events(300, 40)
    whole = _fill(spark, str(tmp_path / "in"), rows, EVENT, 19)
    store = str(tmp_path / "store")
    _run(stores.upsert_states(_stream(spark, str(tmp_path / "in"), EVENT), store))
    runs = stores.Runs(spark, store)
    assert [f.rsplit("=")[-1] for f in runs.committed()] == ["0-000000016", "0-000000017", "0-000000018", "1-000000000", "1-000000001"]
    got, want = stores.read_states(spark, store).collect(), metrics.latest_state(whole).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 41
    # a run holds a row for each task that its batch names, and no other
    named = {r[4] for r in rows[16 * 300 // 19 : 17 * 300 // 19]}
    assert {r.task for r in spark.read.parquet(runs.folder(0, 16)).collect()} == named
    # more files: the store goes on from where it was
    late = [(START + datetime.timedelta(days=90), 1000, "a", "REVOKED", 3, None)]
    spark.createDataFrame(late, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _run(stores.upsert_states(_stream(spark, str(tmp_path / "in"), EVENT), store))
    assert {r.task: r.state for r in stores.read_states(spark, store).collect()}[3] == "REVOKED"


@pytest.mark.parametrize("lost", ["before", "within", "after"])
def test_states_of_a_lost_batch(spark, tmp_path, monkeypatch, lost):
    """A batch that dies before its run is written, before its runs are dropped, or once all is done runs again."""
    whole = _fill(spark, str(tmp_path / "in"), _events(80, 9), EVENT, 9)
    store, drop, has, dead = str(tmp_path / "store"), stores.Runs.drop, stores.Runs.has, []

    def die_once(at, number):
        if at == lost and number == 7 and not dead:
            dead.append(at)
            raise RuntimeError("the executor is gone")

    def dropping(self, level, number):
        if number == 3:
            die_once("within", 7)  # some inputs of the merge are gone
        drop(self, level, number)
        die_once("after", number)

    def asked(self, level, number):
        die_once("before", number)
        return has(self, level, number)

    monkeypatch.setattr(stores.Runs, "drop", dropping)
    monkeypatch.setattr(stores.Runs, "has", asked)
    with pytest.raises(Exception, match="gone"):
        _run(stores.upsert_states(_stream(spark, str(tmp_path / "in"), EVENT), store))
    assert dead
    _run(stores.upsert_states(_stream(spark, str(tmp_path / "in"), EVENT), store))
    assert sorted(map(str, stores.read_states(spark, store).collect())) == sorted(map(str, metrics.latest_state(whole).collect()))


def test_states_of_no_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _run(stores.upsert_states(_stream(spark, str(tmp_path / "in"), EVENT), str(tmp_path / "store")))
    assert stores.read_states(spark, str(tmp_path / "store")).collect() == []


PROFILE = "computation string, version int, start_time timestamp, steps map<string,double>"


def test_entries_are_appended_once(spark, tmp_path, monkeypatch):
    rows = [(f"c{k % 2}", k % 3, START + datetime.timedelta(hours=k), {"a": k / 1000}) for k in range(12)]
    _fill(spark, str(tmp_path / "in"), rows, PROFILE, 4)
    store, once, dead = str(tmp_path / "store"), stores.Runs.once, []

    def dying(self, level, number, write):
        once(self, level, number, write)
        if number == 2 and not dead:
            dead.append(number)
            raise RuntimeError("the driver is gone")  # the batch is written, and the stream does not know

    monkeypatch.setattr(stores.Runs, "once", dying)
    with pytest.raises(Exception, match="gone"):
        _run(stores.append_profiles(_stream(spark, str(tmp_path / "in"), PROFILE), store))
    _run(stores.append_profiles(_stream(spark, str(tmp_path / "in"), PROFILE), store))
    told = lambda: sorted((r.computation, r.version, r.start_time, r.steps["a"]) for r in stores.read_profiles(spark, store).collect())
    want = sorted((c, v, t, float(k)) for k, (c, v, t, _) in enumerate(rows))
    assert told() == want
    # what a batch left without its mark is not read
    lost = stores.Runs(spark, store).folder(0, 9)
    os.makedirs(f"{lost}/computation=c0/version=0")
    with open(f"{lost}/computation=c0/version=0/part-0.json", "w") as f:
        f.write('{"metadata":{"start_time":"2024-01-01 00:00:00"},"steps":{"a":1.0}}\n')
    assert told() == want


def test_a_repeated_batch_of_entries_changes_nothing(spark, tmp_path):
    p = spark.createDataFrame([("voxels", 3, START, {"a": 0.25}), (None, None, None, {})], PROFILE)
    store = str(tmp_path / "store")
    assert stores.read_profiles(spark, store).collect() == []
    for batch in (0, 1, 1, 0):
        stores.append_profile_batch(p, store, batch)
    assert stores.read_profiles(spark, store).count() == 4
    stores.append_profile_batch(p.limit(0), store, 2)
    assert stores.read_profiles(spark, store).count() == 4
    keys = spark.createDataFrame([("profiling:voxels:v3",), ("profiling:voxels:v12",), ("profiling:mesh:v1",)], "key string")
    assert {r.version for r in readers.list_profile_versions(keys, "voxels").collect()} == {"v3", "v12"}


def test_sketched_quantiles_are_within_their_error(spark, tmp_path):
    draw = random.Random(4)
    wide = [draw.choice([-1, 1, 1, 1]) * math.exp(draw.uniform(-20, 20)) for _ in range(4000)] + [0.0] * 30
    rows = [(START + datetime.timedelta(hours=draw.randrange(240)), k, draw.choice("ab"), "S", 1, v) for k, v in enumerate(wide)]
    rows += [(START, -1, "a", "S", 1, None), (START, -2, "a", "S", 1, float("nan")), (START, -3, "a", "S", 1, float("inf")), (None, -4, "a", "S", 1, 1.0)]
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    _fill(spark, str(tmp_path / "in"), rows, EVENT, 3)
    kept = streams.drained(streams.runtime_sketches(_stream(spark, str(tmp_path / "in"), EVENT), late="30 days"), "sketches", str(tmp_path / "c"))
    got = {(r.bucket, r.name): r for r in streams.sliding_quantiles(kept, [0.01, 0.5, 0.95, 0.99]).collect()}
    known = [r for r in rows if r[0] is not None and r[5] is not None and math.isfinite(r[5])]
    days = {START.date() + datetime.timedelta(days=k) for k in range(-6, 10)}
    assert {(b.date(), n) for b, n in got} == {(d, n) for d in days for n in "ab"}
    for (bucket, name), row in got.items():
        values = sorted(r[5] for r in known if r[2] == name and bucket <= r[0] < bucket + datetime.timedelta(days=7))
        assert row.n == len(values)
        for q in (0.01, 0.5, 0.95, 0.99):
            exact = values[math.ceil(q * len(values)) - 1]
            assert abs(row[f"p{round(q * 100)}"] - exact) <= abs(exact) * (streams.SKETCH_ERROR + 1e-9)
    # sketches are merged in any order and cut
    halves = kept.withColumn("n", F.floor(F.col("n") / 2)).unionByName(kept.withColumn("n", F.col("n") - F.floor(F.col("n") / 2))).where("n > 0")
    again = streams.sliding_quantiles(halves, [0.01, 0.5, 0.95, 0.99])
    assert {(r.bucket, r.name): r for r in again.collect()} == got
