"""Ranking of entities: suppressions, stable top-k, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppressed(entity: Column, rules: list[str]) -> Column:
    """Whether a rule names the entity: exactly, or as a prefix that ends in ``:``."""
    hit = F.lit(False)
    for rule in rules:
        hit = hit | (entity == rule)
        if rule.endswith(":"):
            hit = hit | entity.startswith(rule)
    return hit


def top_k(scored: DataFrame, k: int, rules: list[str] | None = None) -> DataFrame:
    """The ``k`` best entities per window by score, ties by node_index; suppressed ones sink and then drop out.

    The cut comes before the drop, so fewer than k remain only where a window has
    fewer entities that are not suppressed.  Null scores rank last.
    """
    hit = suppressed(F.col("entity"), rules or [])
    order = Window.partitionBy("window_id").orderBy(F.col("_tw_hit"), F.desc_nulls_last("score"), "node_index")
    ranked = scored.withColumn("_tw_hit", hit).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).where(~F.col("_tw_hit")).drop("_tw_hit")


def attention_pool(nodes: DataFrame, score: str, values: list[str]) -> DataFrame:
    """Softmax-weighted sums of ``values`` per window, from partial aggregates.

    The largest score of a window is subtracted before exponentiation; windows
    without rows have no row.
    """
    top = nodes.groupBy("window_id").agg(F.max(score).alias("_tw_top"))
    weighed = nodes.join(top, "window_id").withColumn("_tw_w", F.exp(F.col(score) - F.col("_tw_top")))
    total = F.sum("_tw_w")
    return weighed.groupBy("window_id").agg(*[(F.sum(F.col("_tw_w") * F.col(v)) / total).alias(v) for v in values])


def static_pool(rows: DataFrame, values: list[str]) -> DataFrame:
    """Mean and maximum of ``values`` per window and entity."""
    parts = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("max", F.max))]
    return rows.groupBy("window_id", "entity").agg(*parts)
