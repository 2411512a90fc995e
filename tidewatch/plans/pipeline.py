"""Queries of the general data-preparation operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.events import host_of, kind_type_of
from tidewatch.functions.timestamps import already_utc_iso, with_instant
from tidewatch.operators import dedup, drift, feature_table, nested, sessions
from tidewatch.plans.pipeline_sql import SQL  # noqa: F401
from tidewatch.runtime import scratch_path, table

GAP_US = 1_800_000_000


def located(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """idr_events with utc_us; wall-clock text in the zone of the row's sensor.

    The sensor table is joined without a hint: Catalyst broadcasts it where its
    own size estimate allows and else shuffles, splitting hot sensors.
    """
    zones = table(spark, d, "sensors").where(F.col("sensor_id").isNotNull()).groupBy("sensor_id").agg(F.min("clock_zone").alias("clock_zone"))
    events = table(spark, d, "idr_events").select("row_no", "timestamp", "sensor_id", "received_at", *columns)
    joined = events.join(zones, "sensor_id", "left")
    return with_instant(joined, "timestamp", "clock_zone", "received_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the feature table over every delivery, with or without an instant."""
    vectors, index = _vectors(located(spark, d, "severity", "kind", "metadata").select(
        host_of(F.col("metadata")).alias("entity"), kind_type_of(F.col("kind")).alias("kind_type"), "severity", "utc_us"
    ))
    return feature_table.cells_of(vectors, index).select(F.col("entity").alias("host"), "kind_type")


def _vectors(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = feature_table.sparse_cells(events)
    index = feature_table.type_index(cells)
    return feature_table.sparse_vectors(cells, index), index


def _once(spark: SparkSession, d: str) -> DataFrame:
    """Delivered-once events with entity, kind_type, severity and utc_us."""
    surplus = dedup.surplus_rows(table(spark, d, "idr_events"))
    events = located(spark, d, "severity", "kind", "metadata").join(surplus, "row_no", "left_anti")
    return events.select(
        "row_no", "utc_us", "severity", host_of(F.col("metadata")).alias("entity"), kind_type_of(F.col("kind")).alias("kind_type")
    )


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """The sparse feature table: one row per host with aligned arrays."""
    vectors, _ = _vectors(_once(spark, d))
    return vectors


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells the sparse vectors hold: count, severity total and latest instant per host and type."""
    vectors, index = _vectors(_once(spark, d))
    return feature_table.cells_of(vectors, index).withColumnRenamed("entity", "host")


def p2_feature_columns(spark: SparkSession, d: str) -> DataFrame:
    """The wide feature table: one row per host, three columns per type."""
    from tidewatch.runtime import materialise

    cells = materialise(feature_table.sparse_cells(_once(spark, d)), "cells")
    index = feature_table.type_index(cells)
    return feature_table.expand(feature_table.sparse_vectors(cells, index), index.count())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = located(spark, d, "metadata").select(host_of(F.col("metadata")).alias("entity"), "utc_us")
    return sessions.sessions(rows, GAP_US).select(F.col("entity").alias("host"), "start_us", "end_us")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every host with duration and the number of events, each event counted once."""
    rows = located(spark, d, "metadata")
    surplus = dedup.surplus_rows(table(spark, d, "idr_events")).withColumn("weight", F.lit(0))
    weighed = rows.join(surplus, "row_no", "left").select(
        host_of(F.col("metadata")).alias("entity"), "utc_us", F.coalesce("weight", F.lit(1)).alias("weight")
    )
    return sessions.sessions(weighed, GAP_US).withColumnRenamed("entity", "host")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d).where(F.col("utc_us").isNotNull() & ~already_utc_iso(F.col("timestamp"))).select("row_no", "utc_us")


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    """Row and instant of every row, null where the text names none."""
    return located(spark, d).select("row_no", "utc_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The nested objects of labeled_windows, read from the tables of their variants, top objects left out."""
    routed = nested.write_variants(nested.window_nodes(table(spark, d, "labeled_windows")), scratch_path(spark, "variants"))
    return routed.where(F.col("parent_path").isNotNull()).select("window_id", "event_pos", "parent_path", "node_path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The supertype table of the nested objects of labeled_windows, top objects included."""
    return nested.window_nodes(table(spark, d, "labeled_windows"), as_text=True)


def p5_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The subtype tables of the nested objects of idr_events and their sizes."""
    docs = [("kind", False), ("metadata", True)]
    return nested.shape_catalog(nested.node_table(table(spark, d, "idr_events"), ["row_no"], docs))


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of labeled_windows and idr_events routed to the tables of their shapes; what each table holds, read from there."""
    docs = [("kind", False), ("metadata", True)]
    whole = nested.window_nodes(table(spark, d, "labeled_windows")).select(F.concat_ws("/", "window_id", "event_pos").alias("record"), *nested.NODE_COLUMNS)
    events = nested.node_table(table(spark, d, "idr_events"), ["row_no"], docs).select(F.col("row_no").cast("string").alias("record"), *nested.NODE_COLUMNS)
    routed = nested.write_variants(whole.unionByName(events), scratch_path(spark, "variants"))
    return routed.groupBy("shape_id").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("parent_path").alias("n_parent_paths"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus_rows(table(spark, d, "idr_events"))


def p6_once(spark: SparkSession, d: str) -> DataFrame:
    """idr_events with exactly one row per delivered event, received_at in microseconds."""
    return dedup.delivered_once(table(spark, d, "idr_events")).withColumn("received_at", F.unix_micros("received_at"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "landed_lines"))


def p7_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Landed lines that no table is made of."""
    return drift.unreadable_lines(table(spark, d, "landed_lines"))


def p7_findings(spark: SparkSession, d: str) -> DataFrame:
    """The landed findings as one table under unified names and types."""
    return drift.typed_table(drift.unified_lines(table(spark, d, "landed_lines")), "finding", drift.FINDING_COLUMNS)


def p7_events(spark: SparkSession, d: str) -> DataFrame:
    """The landed events as one table under unified names and types."""
    return drift.typed_table(drift.unified_lines(table(spark, d, "landed_lines")), "event", drift.EVENT_COLUMNS)


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_cells, p2_features, p2_feature_columns, p3_found, p3_sessions, p4_found, p4_instants, p5_found, p5_nodes, p5_shapes, p5_variants,
        p6_found, p6_once, p7_found, p7_unreadable, p7_findings, p7_events,
    )
}
