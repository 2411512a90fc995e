"""Per-entity feature table: sparse, mergeable vectors over indexed event types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rank of a severity; any other text counts 0.
SEVERITY_RANK = {"INFO": 1, "WARNING": 2, "HIGH": 3, "CRITICAL": 4, "IMPOSSIBLE": 5}


def severity_rank(severity):
    """Rank 1 to 5 of a severity in any case, 0 for anything else or null."""
    text = F.upper(severity)
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(text == name, value).otherwise(rank)
    return rank.cast("long")


def type_index(events: DataFrame, kind: str = "kind_type") -> DataFrame:
    """(kind_type, type_idx): the distinct types numbered from 0 in text order.

    One row per type.  The window runs over the distinct types only, whose
    number is the width of the feature table.
    """
    from pyspark.sql import Window

    types = events.select(F.col(kind).alias("kind_type")).where(F.col("kind_type").isNotNull()).distinct()
    return types.select("kind_type", (F.row_number().over(Window.orderBy("kind_type")) - 1).alias("type_idx"))


def sparse_cells(events: DataFrame) -> DataFrame:
    """The non-zero cells (entity, kind_type, n_events, severity_total, last_us).

    ``events`` has entity, kind_type, severity, utc_us (null where unreadable).
    A null entity or type makes no cell.  Partial aggregation runs before the
    shuffle, so a hot entity sends one row per type and task.
    """
    return (
        events.where(F.col("entity").isNotNull() & F.col("kind_type").isNotNull())
        .groupBy("entity", "kind_type")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(severity_rank(F.col("severity"))).alias("severity_total"),
            F.max("utc_us").alias("last_us"),
        )
    )


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Merge cells of disjoint sets of events: counts and totals add, the latest time wins."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("entity", "kind_type").agg(
        F.sum("n_events").alias("n_events"),
        F.sum("severity_total").alias("severity_total"),
        F.max("last_us").alias("last_us"),
    )


def sparse_vectors(cells: DataFrame, index: DataFrame) -> DataFrame:
    """One row per entity: idx, counts, totals and latest as aligned arrays, sorted by type index.

    An array has at most one element per type, so its size is bounded by the
    width of the table whatever the number of events.
    """
    cell = F.struct("type_idx", "n_events", "severity_total", "last_us")
    packed = cells.join(index, "kind_type").groupBy("entity").agg(F.sort_array(F.collect_list(cell)).alias("v"))
    return packed.select(
        "entity",
        F.col("v.type_idx").alias("idx"),
        F.col("v.n_events").alias("counts"),
        F.col("v.severity_total").alias("totals"),
        F.col("v.last_us").alias("latest"),
    )


def cells_of(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """The cells (entity, kind_type, n_events, severity_total, last_us) that the vectors hold."""
    zipped = F.explode(F.arrays_zip("idx", "counts", "totals", "latest"))
    return (
        vectors.select("entity", zipped.alias("z"))
        .select("entity", F.col("z.idx").alias("type_idx"), F.col("z.counts").alias("n_events"), F.col("z.totals").alias("severity_total"), F.col("z.latest").alias("last_us"))
        .join(index, "type_idx")
        .drop("type_idx")
    )


def expand(vectors: DataFrame, n_types: int) -> DataFrame:
    """One column triple per type index: n_<i> (0 if absent), sev_<i> (0), last_us_<i> (null)."""
    lookup = vectors.select(
        "entity",
        F.map_from_arrays("idx", "counts").alias("c"),
        F.map_from_arrays("idx", "totals").alias("t"),
        F.map_from_arrays("idx", "latest").alias("l"),
    )
    columns = []
    for i in range(n_types):
        columns.append(F.coalesce(F.try_element_at("c", F.lit(i)), F.lit(0)).alias(f"n_{i}"))
        columns.append(F.coalesce(F.try_element_at("t", F.lit(i)), F.lit(0)).alias(f"sev_{i}"))
        columns.append(F.try_element_at("l", F.lit(i)).alias(f"last_us_{i}"))
    return lookup.select("entity", *columns)


def feature_table(events: DataFrame, max_types: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(wide table, type index).  One row per entity, one column triple per type.

    The number of columns has to be known to plan the table, so the index is
    counted; more than ``max_types`` types raise, since a table that wide should
    stay in sparse form (``sparse_vectors``).  No events: no rows, no columns.
    """
    index = type_index(events)
    n_types = index.count()
    if n_types > max_types:
        raise ValueError(f"{n_types} types are more than max_types={max_types}; use sparse_vectors")
    return expand(sparse_vectors(sparse_cells(events), index), n_types), index
