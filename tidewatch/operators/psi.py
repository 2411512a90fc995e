"""Feature histograms and population stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import config

SMOOTHING = 1e-4


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the bin of a value: right-open, the last one closed; null outside.

    The value is rounded to single precision first, as feature vectors are.
    """
    x = value.cast("float").cast("double")
    found = F.when(x == edges[-1], len(edges) - 2)
    for i in range(len(edges) - 1):
        found = found.when((x >= edges[i]) & (x < edges[i + 1]), i)
    return found


def histogram(rows: DataFrame, keys: list[str], names: list[str], edges: list[float] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, feature, bin, n) of the values inside the edges; empty bins have no row.

    Rows are first counted per combination of bins, before anything is shuffled
    or unfolded; ``weight`` names a column that says how often a row counts.
    """
    bins = F.array(*[bin_of(F.col(n), edges or config.DRIFT_EDGES) for n in names])
    many = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    combined = rows.select(*keys, *([weight] if weight else []), bins.alias("_tw_bins")).groupBy(*keys, "_tw_bins").agg(many.alias("n"))
    cells = combined.select(*keys, "n", F.posexplode("_tw_bins").alias("_tw_i", "bin")).where(F.col("bin").isNotNull())
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("_tw_i"))
    return cells.groupBy(*keys, feature.alias("feature"), "bin").agg(F.sum("n").alias("n"))


def psi(observed: DataFrame, baseline: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """(keys, feature, psi): observed (keys, feature, bin, n) against baseline (feature, bin, n).

    Every bin counts, empty ones with the smoothing alone.
    """
    grid = observed.select(*keys, "feature").distinct().select(*keys, "feature", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    base = baseline.select("feature", "bin", F.col("n").alias("m"))
    cells = grid.join(observed, [*keys, "feature", "bin"], "left").join(base, ["feature", "bin"], "left")
    cells = cells.select(*keys, "feature", (F.coalesce("n", F.lit(0)) + SMOOTHING).alias("o"), (F.coalesce("m", F.lit(0)) + SMOOTHING).alias("t"))
    # windows over the bins of one feature: n_bins rows each
    own = Window.partitionBy(*keys, "feature")
    share = cells.withColumn("o", F.col("o") / F.sum("o").over(own)).withColumn("t", F.col("t") / F.sum("t").over(own))
    return share.groupBy(*keys, "feature").agg(F.sum((F.col("o") - F.col("t")) * F.log(F.col("o") / F.col("t"))).alias("psi"))


def drift(values: DataFrame, keys: list[str], flag: float = config.DRIFT_FLAG) -> DataFrame:
    """(keys, psi_max, psi_mean, flagged_features in the order of the vector)."""
    order = F.array(*[F.lit(n) for n in config.FEATURES])
    hit = F.when(F.col("psi") >= flag, F.struct(F.array_position(order, F.col("feature")).alias("i"), "feature"))
    summed = values.groupBy(*keys).agg(F.max("psi").alias("m"), F.avg("psi").alias("a"), F.array_sort(F.collect_list(hit)).alias("h"))
    return summed.select(*keys, F.bround("m", 6).alias("psi_max"), F.bround("a", 6).alias("psi_mean"), F.transform("h", lambda x: x["feature"]).alias("flagged_features"))
