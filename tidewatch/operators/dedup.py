"""Messages delivered more than once: an idempotent, hash-bucketed store of sorted runs.

``DeliveryStore.upsert`` collapses each batch to one row per identifier
(map-side first, so a message delivered a million times crosses the network
once per task), hashes it into buckets and adds each bucket of each run as one
sorted file.  Which row survives does not depend on how often or in which order
rows arrive, so a batch written again changes nothing.  ``compact`` merges the
runs of each bucket where it lies: all are hashed alike, so nothing is shuffled,
and equal identifiers of several runs collapse to one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.events import canonical_id
from tidewatch.runtime import delete_path, materialise, scratch_path, shuffle_width

#: Runs a table of many batches is upserted as; bounds the files of the store, not the batches.
RUNS = 8


class DeliveryStore:
    """Survivors by run and identifier, in ``buckets`` hash buckets; one table, partitioned by run."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "deliveries")
        self.buckets = buckets or shuffle_width(spark)
        self.table = f"tw_deliveries_{uuid.uuid4().hex}"
        self.empty = True

    def upsert(self, batches: DataFrame) -> None:
        """Add the survivors of each run of ``batches`` (run, key, received_us, row_no)."""
        # one file per run and bucket, whatever the number of tasks before
        placed = survivors(batches, "run", "key").repartition(self.buckets, "key").sortWithinPartitions("run", "key")
        out = placed.write.mode("append").format("parquet").option("path", self.path)
        out.partitionBy("run").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.table)
        self.empty = False

    def merged(self) -> DataFrame:
        """One row per identifier over all runs: key, received_us, row_no."""
        if self.empty:
            raise ValueError("nothing was upserted")
        return survivors(self.spark.table(self.table), "key")

    def compact(self) -> DataFrame:
        """``merged``, written once; the runs it replaces are deleted."""
        whole = materialise(self.merged(), "compacted")
        self.drop()
        return whole

    def drop(self) -> None:
        """Delete the runs and the catalogue's entry."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.path)
        self.empty = True


def survivors(deliveries: DataFrame, *keys: str) -> DataFrame:
    """The row with the earliest ``received_us`` of each key, among equals the smallest ``row_no``.

    A null ``received_us`` counts as later than any time.
    """
    first = F.min(F.struct(F.col("received_us").isNull().alias("late"), "received_us", "row_no"))
    return deliveries.groupBy(*keys).agg(first.alias("f")).select(*keys, "f.received_us", "f.row_no")


def run_of(batch: F.Column, runs: int = RUNS) -> F.Column:
    """The run a batch belongs to; a null batch has one, too."""
    return F.pmod(F.xxhash64(batch), F.lit(runs)).cast("int")


def deliveries(events: DataFrame, runs: int = RUNS) -> DataFrame:
    """run, key, received_us and row_no of every row whose id is neither null nor blank; without ``batch_id`` all are one run."""
    run = run_of(F.col("batch_id"), runs) if "batch_id" in events.columns else F.lit(0)
    return events.select(
        run.alias("run"), canonical_id(F.col("id")).alias("key"), F.unix_micros("received_at").alias("received_us"), "row_no"
    ).where(F.col("key").isNotNull())


def surplus_rows(events: DataFrame, runs: int = RUNS) -> DataFrame:
    """``row_no`` of every delivery that is not the one kept.

    Kept of all rows with the same id, across all batches: the earliest
    ``received_at``, among equals the smallest ``row_no``.  Rows without an id are
    never surplus; an empty table has none.  ``row_no`` must be unique; where it
    repeats, the copies share a fate.
    """
    store = DeliveryStore(events.sparkSession)
    landed = deliveries(events, runs)
    store.upsert(landed)
    kept = store.compact().select("row_no")
    return landed.select("row_no").join(kept, "row_no", "left_anti").distinct()


def delivered_once(events: DataFrame, runs: int = RUNS) -> DataFrame:
    """The rows of ``events`` without the surplus deliveries, all columns kept."""
    return events.join(surplus_rows(events, runs), "row_no", "left_anti")
