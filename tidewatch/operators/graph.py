"""The temporal entity graph of windows: nodes, histories, edges, decay, budget.

All operators take a projected event table (window_id, id, timestamp,
entities, relations, features) and work on all windows at once.  An entity's or
an edge's aggregates are computed where it hashes to; only what is ordered over
a whole window (gaps, node order) goes by time buckets or by the number of
nodes, never by the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions.entities import normalised_delta

#: Width of the time buckets over which gaps inside a window are found.
BUCKET_SECONDS = 3600


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _with_gap(rows: DataFrame, keys: list[str], out: str, bucket_seconds: int) -> DataFrame:
    """Add the seconds since the row before of the same keys (0 for the first), by (timestamp, id).

    Gaps are found inside time buckets; the first of a bucket looks at the last
    of the bucket before, of which there is one row, so hot keys are split.
    """
    bucket = F.floor(F.unix_micros("timestamp") / F.lit(bucket_seconds * 1_000_000))
    cut = rows.withColumn("_tw_b", bucket)
    ends = cut.groupBy(*keys, "_tw_b").agg(F.max("timestamp").alias("_tw_end"))
    before = F.lag("_tw_end").over(Window.partitionBy(*keys).orderBy("_tw_b"))
    known = ends.select(*keys, "_tw_b", before.alias("_tw_before"))
    inside = F.lag("timestamp").over(Window.partitionBy(*keys, "_tw_b").orderBy("timestamp", "id"))
    gap = F.coalesce(seconds_between(F.col("timestamp"), F.coalesce("_tw_in", "_tw_before")), F.lit(0.0))
    return cut.withColumn("_tw_in", inside).join(known, [*keys, "_tw_b"]).withColumn(out, gap).drop("_tw_b", "_tw_in", "_tw_before")


def with_stream_gap(events: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add gap_seconds since the event before in its window (0 for the first), by (timestamp, id)."""
    return _with_gap(events, ["window_id"], "gap_seconds", bucket_seconds)


def mentions(events: DataFrame, *columns: str) -> DataFrame:
    """One row per event and entity: window_id, id, timestamp, pos, entity and ``columns``."""
    return events.select("window_id", "id", "timestamp", *columns, F.posexplode("entities").alias("pos", "entity"))


def with_entity_gap(rows: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add entity_gap_seconds since the entity was last seen in its window (0 at first)."""
    return _with_gap(rows, ["window_id", "entity"], "entity_gap_seconds", bucket_seconds)


def nodes(rows: DataFrame) -> DataFrame:
    """(window_id, entity, first_ts, first_id, first_pos, last_ts, n_events)."""
    first = F.min(F.struct("timestamp", "id", "pos"))
    seen = rows.groupBy("window_id", "entity").agg(first.alias("f"), F.max("timestamp").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
    return seen.select("window_id", "entity", F.col("f.timestamp").alias("first_ts"), F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_pos"), "last_ts", "n_events")


def with_node_index(seen: DataFrame) -> DataFrame:
    """Add node_index from 0 in order of first sight.  The window ranks entities, not events."""
    order = Window.partitionBy("window_id").orderBy("first_ts", "first_id", "first_pos")
    return seen.withColumn("node_index", F.row_number().over(order) - 1)


def budget(seen: DataFrame, max_nodes: int) -> DataFrame:
    """Add ``kept``: the ``max_nodes`` entities seen last in each window, ties by larger id."""
    if max_nodes < 1:
        raise ValueError("max_nodes must be at least 1")
    order = Window.partitionBy("window_id").orderBy(F.desc("last_ts"), F.desc("entity"))
    return seen.withColumn("recency", F.row_number().over(order)).withColumn("kept", F.col("recency") <= max_nodes)


def histories(rows: DataFrame, max_steps: int) -> DataFrame:
    """The last ``max_steps`` rows of each entity, with step counted from the latest (1)."""
    own = Window.partitionBy("window_id", "entity").orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("step", F.row_number().over(own)).where(F.col("step") <= max_steps)


def evidence(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(window_id, entity, evidence_ids): distinct event ids in order of first sight, the latest ``limit`` of them.

    The cut comes before the collecting, and Spark takes it before the shuffle, too.
    """
    key = ["window_id", "entity"]
    seen = rows.groupBy(*key, "id").agg(F.min("timestamp").alias("timestamp"))
    if limit is not None:
        latest = Window.partitionBy(*key).orderBy(F.desc("timestamp"), F.desc("id"))
        seen = seen.withColumn("_tw_r", F.row_number().over(latest)).where(F.col("_tw_r") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id")))
    return seen.groupBy(*key).agg(F.transform(ordered, lambda x: x["id"]).alias("evidence_ids"))


def emitted(events: DataFrame) -> DataFrame:
    """One row per emitted relation: window_id, id, timestamp, pos, left, right, relation."""
    return events.select("window_id", "id", "timestamp", F.posexplode("relations").alias("pos", "e")).select("window_id", "id", "timestamp", "pos", "e.left", "e.right", "e.relation")


def within_nodes(relations: DataFrame, kept: DataFrame) -> DataFrame:
    """Only the relations both of whose ends are in ``kept`` (window_id, entity)."""
    for end in ("left", "right"):
        relations = relations.join(kept.select("window_id", F.col("entity").alias(end)), ["window_id", end], "left_semi")
    return relations


def relation_counts(relations: DataFrame) -> DataFrame:
    """(window_id, relation, n): one count per emitted relation, repeated ones included."""
    return relations.groupBy("window_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def typed_edges(relations: DataFrame) -> DataFrame:
    """(window_id, left, right, relation, first_ts, first_id, first_pos, n): distinct relations, as first seen."""
    first = F.min(F.struct("timestamp", "id", "pos"))
    found = relations.groupBy("window_id", "left", "right", "relation").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    return found.select("window_id", "left", "right", "relation", F.col("f.timestamp").alias("first_ts"), F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_pos"), "n")


def edges(relations: DataFrame) -> DataFrame:
    """(window_id, a, b, last_ts): undirected pairs, a < b, and when they were last reinforced.

    All relations of a pair collapse.  A relation of an entity with itself only
    touches the diagonal and is no pair.
    """
    pair = relations.where(F.col("left") != F.col("right"))
    return pair.groupBy("window_id", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.max("timestamp").alias("last_ts"))


def decayed(pairs: DataFrame, clock: DataFrame, half_life: float | None) -> DataFrame:
    """Add weight: 0.5 ** (age / half_life) against the window's last event, or 1 without a half-life.

    ``clock``: (window_id, last_event_ts).
    """
    if half_life is None:
        return pairs.withColumn("weight", F.lit(1.0))
    if half_life <= 0:
        raise ValueError("half_life must be positive or None")
    age = seconds_between(F.col("last_event_ts"), F.col("last_ts"))
    return pairs.join(clock, "window_id").withColumn("weight", F.pow(F.lit(0.5), age / F.lit(half_life))).drop("last_event_ts")


def clock(events: DataFrame) -> DataFrame:
    """(window_id, last_event_ts, first_id): end of the stream and the first event by (timestamp, id)."""
    first = F.min(F.struct("timestamp", "id"))
    return events.groupBy("window_id").agg(F.max("timestamp").alias("last_event_ts"), first["id"].alias("first_id"))


def normalised(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(window_id, src, dst, weight): both directions and the diagonal, over the roots of both degrees.

    A node's degree is 1 for its self-loop plus the weights of its pairs.
    """
    both = pairs.select("window_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        pairs.select("window_id", F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    )
    sums = both.groupBy("window_id", "src").agg(F.sum("weight").alias("w"))
    degree = seen.select("window_id", F.col("entity").alias("src")).join(sums, ["window_id", "src"], "left").select("window_id", "src", (F.coalesce("w", F.lit(0.0)) + 1).alias("d"))
    other = degree.select("window_id", F.col("src").alias("dst"), F.col("d").alias("d2"))
    scaled = both.join(degree, ["window_id", "src"]).join(other, ["window_id", "dst"])
    diagonal = degree.select("window_id", "src", F.col("src").alias("dst"), (F.lit(1.0) / F.col("d")).alias("weight"))
    return scaled.select("window_id", "src", "dst", (F.col("weight") / (F.sqrt("d") * F.sqrt("d2"))).alias("weight")).unionByName(diagonal)


def message_pass(adjacency: DataFrame, state: DataFrame, value: str = "value") -> DataFrame:
    """(window_id, entity, value): each node's neighbourhood sum, by join and partial aggregation."""
    sent = adjacency.join(state.select("window_id", F.col("entity").alias("dst"), F.col(value).alias("_tw_v")), ["window_id", "dst"])
    return sent.groupBy("window_id", F.col("src").alias("entity")).agg(F.sum(F.col("weight") * F.col("_tw_v")).alias(value))


def node_rows(events: DataFrame, max_steps: int, time_mode: str = "global") -> DataFrame:
    """History rows with the 22 features as ``f`` (array) and the entity gap as ``gap``, per entity and step."""
    if time_mode not in ("global", "per_entity", "time_aware"):
        raise ValueError(f"unknown time_mode: {time_mode}")
    gapped = with_stream_gap(events) if time_mode == "global" else events.withColumn("gap_seconds", F.lit(0.0))
    # a step's gap needs the step before it, so one more than asked for is kept until then
    rows = histories(mentions(gapped, "gap_seconds", *config.FEATURES), max_steps + 1)
    before = F.lag("timestamp").over(Window.partitionBy("window_id", "entity").orderBy(F.desc("step")))
    own = normalised_delta(F.coalesce(seconds_between(F.col("timestamp"), before), F.lit(0.0)))
    rows = rows.withColumn("_tw_own", own).where(F.col("step") <= max_steps)
    delta = normalised_delta(F.col("gap_seconds")) if time_mode == "global" else F.col("_tw_own")
    vector = F.array(*[delta if name == "delta_seconds_log" else F.col(name) for name in config.FEATURES])
    return rows.select("window_id", "entity", "id", "timestamp", "step", vector.alias("f"), F.col("_tw_own").alias("gap"))
