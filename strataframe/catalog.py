"""All registered queries of the library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataframe.plans import geometry, records

FLAGSHIP = "project_springs"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**geometry.QUERIES, **records.QUERIES}
ORACLES: dict[str, str] = {**geometry.ORACLES, **records.ORACLES}
