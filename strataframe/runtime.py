"""Session helpers shared by operators: the shared folder, tables that cut lineage, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Rows of a key beyond which its rows are dealt to several tasks.
SPREAD_ROWS = 2048
#: Keys of many rows that may be broadcast; beyond it they are joined by a shuffle.
HOT_KEYS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new temporary one only where it is unset and the master local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder that the driver and every executor can reach."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    at, files = _at(df.sparkSession, path)
    files.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and sizes are known from then on.

    The table stays as long as the driver lives, since results may read it, and goes when the driver ends.
    """
    return _stored(df, shared_folder(df.sparkSession, "cut"))


class Scratch:
    """Tables of one job in a folder of the shared one; each can be dropped once its successor is written."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark, self._root, self._paths = spark, shared_folder(spark, label), {}
        self._made = 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self._root}/{self._made}"
        self._made += 1
        table = _stored(df, path)
        self._paths[id(table)] = (table, path)
        return table

    def cut_told(self, df: DataFrame, **told: Column) -> tuple[DataFrame, dict]:
        """A table and aggregates over its rows, taken while it is written."""
        seen = Observation()
        table = self.cut(df.observe(seen, *[value.alias(name) for name, value in told.items()]))
        return table, seen.get

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path is not None:
                at, files = _at(self._spark, path)
                files.delete(at, True)

    def keep_only(self, table: DataFrame) -> DataFrame:
        """Drop every table but ``table``, the result."""
        self.drop(*[t for t, _ in self._paths.values() if t is not table])
        return table


def sized_broadcast(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side only if its counted rows stay within ``limit``; beyond it Spark shuffles."""
    return F.broadcast(small) if rows <= limit else small


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows by ``by`` to all shuffle partitions, however few bytes they are: their work is far larger than they."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def join_by_key(rows: DataFrame, keys: DataFrame, on: str, count: str, by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keys``, one row per value of ``on``, where a value may hold any share of ``rows``.

    ``keys`` is a stored table and its column ``count`` tells the rows of the value.  A value of more than
    ``SPREAD_ROWS`` is met in several tasks: its rows are dealt by a hash of ``by``, its key row goes to each.
    """
    hot = keys.where(F.col(count) > SPREAD_ROWS).select(on, F.ceil(F.col(count) / SPREAD_ROWS).cast("int").alias("_parts"))
    n = hot.count()
    if n == 0:
        return rows.join(keys, on, how)
    part = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    dealt = rows.join(sized_broadcast(hot, n, HOT_KEYS), on, "left").withColumn("_part", part).drop("_parts")
    last = F.when(F.col(count) > SPREAD_ROWS, F.ceil(F.col(count) / SPREAD_ROWS).cast("int")).otherwise(1) - 1
    copies = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    return dealt.join(copies, [on, "_part"], how).drop("_part")
