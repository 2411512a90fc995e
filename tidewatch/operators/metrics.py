"""Evaluation metrics over (label, score) tables, and chronological splits.

Curves are built on the distinct scores: rows are first counted per score, so
ties cost one row and the running sums go over distinct scores only.  Those
running sums need one global order; scores are cut into ranges whose totals are
summed first, and each range is then ordered on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024


def per_score(rows: DataFrame) -> DataFrame:
    """(score, pos, neg) of every distinct score; rows without label or score do not count."""
    known = rows.where(F.col("label").isNotNull() & F.col("score").isNotNull())
    hit = F.col("label").cast("int") == 1
    return known.groupBy("score").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("pos"), F.sum(F.when(hit, 0).otherwise(1)).alias("neg"))


def curve(rows: DataFrame) -> DataFrame:
    """(score, pos, neg, tp, fp, all_pos, all_neg): counts at the threshold ``score``, that is of scores >= it.

    Scores are taken to lie mostly in [0, 1]; the ranges are equal parts of it.
    """
    cells = per_score(rows).withColumn("r", F.floor(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) * RANGES))
    totals = cells.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    # one row per range, RANGES + 1 at most
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    base = totals.select(
        "r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"),
        F.sum("rp").over(whole).alias("all_pos"), F.sum("rn").over(whole).alias("all_neg"),
    )
    own = Window.partitionBy("r").orderBy(F.desc("score"))
    run = cells.withColumn("sp", F.sum("pos").over(own)).withColumn("sn", F.sum("neg").over(own)).join(base, "r")
    return run.select("score", "pos", "neg", (F.col("bp") + F.col("sp")).alias("tp"), (F.col("bn") + F.col("sn")).alias("fp"), "all_pos", "all_neg")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def roc_auc(points: DataFrame) -> DataFrame:
    """(roc_auc): share of (positive, negative) pairs in the right order, ties half; null with one class."""
    right = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    return points.agg(_rate(right, F.max("all_pos") * F.max("all_neg")).alias("roc_auc"))


def average_precision(points: DataFrame) -> DataFrame:
    """(pr_auc): sum over distinct thresholds of the gain in recall times the precision; null without positives."""
    return points.agg(F.sum(_rate(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def recall_at_fpr(points: DataFrame, cap: float) -> DataFrame:
    """(recall): highest recall at a false positive rate of at most ``cap``; 0 without positives, 1 without negatives."""
    best = F.max(F.when(F.col("fp") <= F.lit(cap) * F.col("all_neg"), _rate(F.col("tp"), F.col("all_pos"))))
    got = F.when(F.max("all_pos") == 0, 0.0).when(F.max("all_neg") == 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return points.agg(got.alias("recall"))


def threshold_at_fpr(points: DataFrame, target: float) -> DataFrame:
    """(tau, dev_fpr, dev_tpr): the threshold of highest recall within the target, of equal ones the highest.

    Null tau (alert on nothing) with rates 0 where no point is admissible.
    """
    fpr, tpr = F.coalesce(_rate(F.col("fp"), F.col("all_neg")), F.lit(0.0)), F.coalesce(_rate(F.col("tp"), F.col("all_pos")), F.lit(0.0))
    best = points.where((fpr <= target) & (tpr > 0)).agg(F.max(F.struct(tpr.alias("t"), F.col("score").alias("s"), fpr.alias("f"))).alias("b"))
    return best.select(F.col("b.s").alias("tau"), F.coalesce("b.f", F.lit(0.0)).alias("dev_fpr"), F.coalesce("b.t", F.lit(0.0)).alias("dev_tpr"))


def confusion(rows: DataFrame, tau: float) -> DataFrame:
    """(tp, fp, tn, fn, realized_fpr, realized_tpr, precision) when alerting on scores >= tau."""
    alert, hit = F.col("score") >= F.lit(tau), F.col("label") == 1
    n = lambda c: F.count_if(c)
    counts = rows.agg(n(alert & hit).alias("tp"), n(alert & ~hit).alias("fp"), n(~alert & ~hit).alias("tn"), n(~alert & hit).alias("fn"))
    return counts.select(
        "*",
        F.coalesce(_rate(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)).alias("realized_fpr"),
        F.coalesce(_rate(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("realized_tpr"),
        _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def log_loss(rows: DataFrame, clip: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(clip)), F.lit(1 - clip))
    return rows.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def calibration_bins(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, mean_score, mean_label): equal bins, closed above, the first closed below as well."""
    at = F.greatest(F.ceil(F.col("score") * bins), F.lit(1)).cast("int")
    # the ceiling of a product may be one off at an edge; the edges decide
    at = F.when(F.col("score") > at / F.lit(float(bins)), at + 1).when((F.col("score") <= (at - 1) / F.lit(float(bins))) & (at > 1), at - 1).otherwise(at)
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("mean_label"))


def calibration_errors(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(ece, mce): mean and largest gap between mean score and mean label over the bins."""
    gap = F.abs(F.col("mean_score") - F.col("mean_label"))
    return calibration_bins(rows, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def precision_at_k(rows: DataFrame, k: int, key: str) -> DataFrame:
    """(precision_at_k) of the k highest scores, ties by ``key``."""
    return rows.orderBy(F.desc("score"), key).limit(k).agg(F.avg(F.col("label").cast("double")).alias("precision_at_k"))


def chronological_split(windows: DataFrame, shares: tuple[float, ...] = (0.6, 0.8)) -> DataFrame:
    """Add ``segment``: 0, 1, .. by position in (start, window_id) order against int(n * share).

    The order is over windows, one row each.
    """
    order = Window.orderBy("start", "window_id")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = windows.withColumn("_tw_i", F.row_number().over(order) - 1).withColumn("_tw_n", n)
    segment = F.lit(0)
    for share in shares:
        segment = segment + F.when(F.col("_tw_i") >= F.floor(F.col("_tw_n") * F.lit(share)), 1).otherwise(0)
    return placed.withColumn("segment", segment).drop("_tw_i", "_tw_n")


def rolling_folds(windows: DataFrame, folds: int = 3) -> DataFrame:
    """(window_id, fold, segment): expanding windows of 40 % and steps of 15 %; segments train, validation, test."""
    if folds not in (2, 3):
        raise ValueError("folds must be 2 or 3")
    order = Window.orderBy("start", "window_id")
    placed = windows.select("window_id", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    out = None
    for fold in range(3 - folds, 3):
        end = lambda base: F.floor(F.col("n") * F.lit(base + fold * 0.15))  # noqa: E731, B023
        segment = F.when(F.col("i") < end(0.40), "train").when(F.col("i") < end(0.55), "validation").when(F.col("i") < end(0.70), "test")
        part = placed.select("window_id", F.lit(fold).alias("fold"), segment.alias("segment")).where(F.col("segment").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def holdout_split(windows: DataFrame, holdout: float = 0.5) -> DataFrame:
    """Add ``is_test``: the later part, the cut rounded half to even and kept at 2 or more from either end."""
    if not 0.1 <= holdout <= 0.9:
        raise ValueError("holdout must be between 0.1 and 0.9")
    order = Window.orderBy("start", "window_id")
    placed = windows.withColumn("_tw_i", F.row_number().over(order) - 1).withColumn("_tw_n", F.count(F.lit(1)).over(Window.partitionBy()))
    cut = F.least(F.greatest(F.bround(F.col("_tw_n") * F.lit(1.0 - holdout), 0), F.lit(2)), F.col("_tw_n") - 2)
    return placed.withColumn("is_test", F.col("_tw_i") >= cut).drop("_tw_i", "_tw_n")


def cv_summary(scores: DataFrame) -> DataFrame:
    """(variant, mean, std, n) over (variant, fold, value), sample deviation, 0 for one fold."""
    return scores.groupBy("variant").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))
