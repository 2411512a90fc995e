"""Attack stages and the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import config


def attack_table(spark) -> DataFrame:
    """(kind_type, tactic, technique, technique_name): a fixed table of a dozen rows."""
    rows = [(k, *v) for k, v in config.ATTACK.items()]
    return spark.createDataFrame(rows, "kind_type string, tactic string, technique string, technique_name string")


def stages(events: DataFrame) -> DataFrame:
    """(window_id, kind_type, tactic, technique, technique_name, first_event_id, first_ts): one per mapped kind.

    The first event of a kind by (timestamp, id) anchors it; kinds without a
    mapping are no stage.  The mapping is fixed and small, so it is broadcast.
    """
    mapped = events.join(F.broadcast(attack_table(events.sparkSession)), "kind_type")
    first = mapped.groupBy("window_id", "kind_type", "tactic", "technique", "technique_name").agg(F.min(F.struct("timestamp", "id")).alias("f"))
    return first.select("window_id", "kind_type", "tactic", "technique", "technique_name", F.col("f.id").alias("first_event_id"), F.col("f.timestamp").alias("first_ts"))


def stage_list() -> Column:
    """Aggregate: the stages of a window as an array of structs by first sight."""
    fields = ["tactic", "technique", "technique_name", "kind_type", "first_event_id"]
    ordered = F.array_sort(F.collect_list(F.struct("first_ts", "first_event_id", F.struct(*fields).alias("s"))))
    return F.transform(ordered, lambda x: x["s"])


def next_stage(found: DataFrame) -> DataFrame:
    """(window_id, next_stage): the first tactic behind the furthest observed that is not observed itself.

    ``kill-chain-complete`` where there is none; windows without stages are not
    in ``found`` and have to be filled with ``unknown``.
    """
    order = F.array(*[F.lit(t) for t in config.TACTICS])
    furthest = F.max(F.array_position(order, F.col("tactic")))
    seen = found.groupBy("window_id").agg(furthest.cast("int").alias("p"), F.collect_set("tactic").alias("seen"))
    rest = F.array_except(F.slice(order, F.col("p") + 1, len(config.TACTICS)), F.col("seen"))
    return seen.select("window_id", F.coalesce(F.get(rest, F.lit(0)), F.lit("kill-chain-complete")).alias("next_stage"))


def mapping_problems(reference: DataFrame, techniques: DataFrame) -> DataFrame:
    """(kind_type, problem): entries of the mapping that a reference does not back.

    ``reference``: (tactic); ``techniques``: (technique, tactics array).
    """
    mapping = attack_table(reference.sparkSession)
    no_tactic = mapping.join(reference, "tactic", "left_anti").select("kind_type", F.lit("unknown tactic").alias("problem"))
    no_technique = mapping.join(techniques, "technique", "left_anti").select("kind_type", F.lit("unknown technique").alias("problem"))
    wrong = mapping.join(techniques, "technique").where(~F.array_contains("tactics", F.col("tactic"))).select("kind_type", F.lit("tactic not of technique").alias("problem"))
    return no_tactic.unionByName(no_technique).unionByName(wrong)
