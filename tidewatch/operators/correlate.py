"""Interval joins: pairs of rows whose times lie within a reach of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(first: DataFrame, second: DataFrame, at: str, reach_us: int) -> DataFrame:
    """Pairs with first.at <= second.at <= first.at + reach, as an equi-join.

    Times (in microseconds) are cut into bins one reach wide.  A row of ``first``
    can only meet the bin it is in and the next one, so it is sent to both; the
    exact condition then decides.  Rows with a null time meet none.  Columns of
    the two sides must differ except for ``at``; the result has first_at and
    second_at instead.
    """
    if reach_us < 0:
        raise ValueError("reach_us must not be negative")
    width = max(reach_us, 1)
    bin_ = lambda c: F.floor(c / F.lit(width))
    left = first.withColumnRenamed(at, "first_at").withColumn("_tw_bin", F.explode(F.array(bin_(F.col("first_at")), bin_(F.col("first_at")) + 1)))
    right = second.withColumnRenamed(at, "second_at").withColumn("_tw_bin", bin_(F.col("second_at")))
    return left.join(right, "_tw_bin").where(F.col("second_at").between(F.col("first_at"), F.col("first_at") + reach_us)).drop("_tw_bin")
