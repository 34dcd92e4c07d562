"""Stores that streams write by batch: what a batch wrote counts once it is committed, however often it runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strataframe.sources import readers, writers

#: Runs of one level that are merged into one of the next.
FAN = 8


class Runs:
    """Folders ``run=<level>-<number>`` of a store.  The mark that Spark's committer leaves in a folder is its commit.

    A folder without the mark is what a lost batch left: it is never read, and written over when the batch runs
    again.  Every row comes from a batch, so a batch that runs again finds its folder committed and leaves it.
    """

    def __init__(self, spark: SparkSession, store: str):
        self._spark, self._store = spark, store.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self._store).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, level: int, number: int) -> str:
        return f"{self._store}/run={level}-{number:09d}"

    def has(self, level: int, number: int) -> bool:
        return self._files.exists(self._path(self.folder(level, number) + "/_SUCCESS"))

    def committed(self) -> list[str]:
        """Committed folders, in order of their names."""
        if not self._files.exists(self._path(self._store)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self._store))]
        told = sorted((int(m[1]), int(m[2])) for m in (re.fullmatch(r"run=(\d+)-(\d+)", n) for n in names) if m)
        return [self.folder(*run) for run in told if self.has(*run)]

    def once(self, level: int, number: int, write: Callable[[str], None]) -> None:
        if not self.has(level, number):
            write(self.folder(level, number))

    def drop(self, level: int, number: int) -> None:
        self._files.delete(self._path(self.folder(level, number)), True)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task").agg(F.max(F.struct("ts", "id", "state")).alias("last"))


def _merged(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*folders).groupBy("task").agg(F.max("last").alias("last"))


def upsert_states(events: DataFrame, store: str) -> StreamingQuery:
    """Keep the latest state of every task of a stream in ``store``, a batch at a time; starts the query.

    A batch writes one row for each task that it names, sorted by task, and nothing else: no state is held for
    the tasks of earlier batches.  ``FAN`` runs are merged into one of the next level, so a row is written again
    once a level, the logarithm of the batches.  The latest of latest states is the same however runs are
    merged, so a run may be read beside the ones that it was made from.  The checkpoint lies within the store.
    """
    spark = events.sparkSession
    runs = Runs(spark, store)

    def keep(rows: DataFrame, batch: int) -> None:
        ends = [level for level in range(20) if (batch + 1) % FAN**level == 0]
        done = max((level for level in ends if runs.has(level, batch // FAN**level)), default=-1)
        for level in ends:
            number = batch // FAN**level
            below = [(level - 1, n) for n in range(number * FAN, (number + 1) * FAN)] if level else []
            if level > done:
                kept = _merged(spark, [runs.folder(*run) for run in below]) if level else _latest(rows)
                kept.sortWithinPartitions("task").write.mode("overwrite").parquet(runs.folder(level, number))
            for run in below:
                runs.drop(*run)

    stream = events.select("task", "ts", "id", "state").writeStream.foreachBatch(keep).outputMode("append")
    return stream.option("checkpointLocation", f"{runs._store}/_checkpoint").trigger(availableNow=True).start()


def read_states(spark: SparkSession, store: str, schema=None) -> DataFrame:
    """``(task, state)`` as of the last committed batch; equal times are decided by event id, then by the state's name.

    An empty store gives no rows, with ``schema``'s types if it is given.
    """
    folders = Runs(spark, store).committed()
    if not folders:
        kinds = {f.name: f.dataType.simpleString() for f in schema} if schema is not None else {}
        return spark.createDataFrame([], f"task {kinds.get('task', 'bigint')}, state {kinds.get('state', 'string')}")
    return _merged(spark, folders).select("task", F.col("last.state").alias("state"))


def append_profiles(profiles: DataFrame, store: str) -> StreamingQuery:
    """Append a stream's timing entries to the store, each batch once, by computation and version; starts the query.

    A batch has a folder of its own in ``store``; one that is run again, after its executor or the driver was
    lost, finds its folder committed or writes it over.  The checkpoint lies within the store, so that batch
    numbers and folders belong together.
    """
    runs = Runs(profiles.sparkSession, store)

    def keep(rows: DataFrame, batch: int) -> None:
        runs.once(0, batch, lambda path: writers.append_profile_json(rows, path, mode="overwrite"))

    query = profiles.writeStream.foreachBatch(keep).option("checkpointLocation", f"{store.rstrip('/')}/_checkpoint")
    return query.trigger(availableNow=True).start()


def append_profile_batch(profile: DataFrame, store: str, batch: int) -> None:
    """Append a table's entries as batch ``batch``; a batch that the store holds already changes nothing."""
    runs = Runs(profile.sparkSession, store)
    runs.once(0, batch, lambda path: writers.append_profile_json(profile, path, mode="overwrite"))


def read_profiles(spark: SparkSession, store: str) -> DataFrame:
    """Entries of all committed batches, as ``readers.read_profile_json`` gives them."""
    return readers.read_profile_json(spark, Runs(spark, store).committed(), base=store)
