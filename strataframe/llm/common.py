"""Expressions that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of code points other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 512


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand Python at most ``BATCH_ROWS`` rows at once.

    Texts may be long, and a batch is held as Arrow buffers on both sides and as Python strings; a lower
    setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes; the polynomial's table is made by its rule, four bits at a time."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    halves = rf"regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '.')"
    values = f"list_transform({halves}, lambda x: CAST('0x' || x AS BIGINT))"
    step = f"lambda c, b: xor(c >> 4, CAST({steps} AS BIGINT[])[1 + (xor(c, b) & 15)])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), {step}))"
