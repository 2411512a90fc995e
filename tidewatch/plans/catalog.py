"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import pipeline, reference

FLAGSHIP = "entity_nodes"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reference.QUERIES, **pipeline.QUERIES}


def sql() -> dict[str, str]:
    return {**reference.SQL, **pipeline.SQL}
