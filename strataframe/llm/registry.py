"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import bpe, chat, extraction, merkle, mixing, neardup, pii, pipeline, quality, runs, sharding, topk, toxicity, warc

_MODULES = (mixing, topk, bpe, extraction, quality, warc, toxicity, neardup, chat, pii, merkle, sharding, runs, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
