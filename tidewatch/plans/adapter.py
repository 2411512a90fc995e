"""The driver's events table as security events, for both engines.

Fixed values: the rules below say what each row of ``events`` stands for; the
SQL side states the same rules over columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.entities import project
from tidewatch.runtime import materialise, spread, table


def envelope(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """(window_id, id, timestamp, source, severity, kind_json, metadata_json) of every row of events."""
    e = (spread(table(spark, d, "events")) if events is None else events).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t, k = F.col("event_type"), F.col("k")
    of = lambda *pairs: F.coalesce(*[F.when(t == a, b) for a, b in pairs])
    on = lambda types, c: F.when(t.isin(*types), c)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    user, ip = text("U", F.col("user_id")), text("10.0.0.", k)
    names = [("click", "socket_lineage"), ("view", "ntp_time_shift"), ("purchase", "suspicious_beacon"), ("signup", "bgp_anomaly"), ("error", "nvme_latency_anomaly")]
    sources = [("click", "kernel_ebpf"), ("view", "network_zeek"), ("purchase", "kernel_ebpf"), ("signup", "sentinel_correlation"), ("error", "hardware_nvme")]
    kind = F.to_json(F.struct(
        of(*[(a, F.lit(b)) for a, b in names]).alias("type"),
        on(["click", "purchase"], 4000 + F.col("user_id")).alias("pid"),
        on(["click"], text("H", k % 5)).alias("exe_sha256"),
        on(["click"], k % 2 == 0).alias("is_signed"),
        on(["click", "purchase", "signup"], ip).alias("dst_ip"),
        on(["view"], ip).alias("ntp_server"),
        on(["click", "view", "purchase"], user).alias("user"),
        on(["purchase"], text("D", k % 7, ".Example.")).alias("domain"),
        on(["signup"], text("10.", k % 4, ".0.0/16")).alias("prefix"),
        on(["signup"], 64500 + k % 8).alias("observed_origin_asn"),
        on(["signup"], F.struct(F.when(k % 3 == 0, "subprefix_hijack_local_infra").otherwise("route_leak").alias("kind"))).alias("kind"),
        on(["error"], text("nvme", k % 4)).alias("device"),
        on(["error"], k % 2 == 1).alias("concurrent_exfil"),
    ))
    value = F.col("value")
    severity = F.when(value < 5, "INFO").when(value < 20, "WARNING").when(value < 60, "HIGH").when(value < 150, "CRITICAL").otherwise("IMPOSSIBLE")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("window_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        of(*[(a, F.lit(b)) for a, b in sources]).alias("source"),
        severity.alias("severity"),
        kind.alias("kind_json"),
        F.to_json(F.struct(text("host-", F.col("user_id") % 19).alias("host"))).alias("metadata_json"),
    )


def projected(spark: SparkSession, d: str) -> DataFrame:
    """The envelope with entities, relations and features; all its kinds are known, so no Python is involved."""
    return project(envelope(spark, d), any_kind=False)


def graph_events(spark: SparkSession, d: str) -> DataFrame:
    """Entities and relations of the envelope, written once for queries that read them several times."""
    return materialise(projected(spark, d).select("window_id", "id", "timestamp", "entities", "relations"), "graph-events")


EV = """ev AS (
  SELECT strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS window_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, event_type AS t, value,
    'host:host-' || (user_id % 19) AS host, CAST(props ->> '$.k' AS INTEGER) AS k,
    CASE event_type WHEN 'click' THEN 'socket_lineage' WHEN 'view' THEN 'ntp_time_shift' WHEN 'purchase' THEN 'suspicious_beacon'
      WHEN 'signup' THEN 'bgp_anomaly' ELSE 'nvme_latency_anomaly' END AS kind_type,
    CASE event_type WHEN 'view' THEN 'network_zeek' WHEN 'signup' THEN 'sentinel_correlation' WHEN 'error' THEN 'hardware_nvme'
      ELSE 'kernel_ebpf' END AS source,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'process:host-' || (user_id % 19) || ':' || (4000 + user_id) END AS process,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'user:u' || user_id END AS usr
  FROM events),
evx AS (
  SELECT *, CASE WHEN t = 'click' THEN 'hash:h' || (k % 5) END AS hash,
    CASE WHEN t <> 'error' THEN 'ip:10.0.0.' || k END AS ip,
    CASE WHEN t = 'signup' THEN 'prefix:10.' || (k % 4) || '.0.0/16' END AS prefix,
    CASE WHEN t = 'signup' THEN 'asn:' || (64500 + k % 8) END AS asn,
    CASE WHEN t = 'purchase' THEN 'domain:d' || (k % 7) || '.example' END AS dom,
    CASE WHEN t = 'error' THEN 'device:' || substr(host, 6) || ':nvme' || (k % 4) END AS dev
  FROM ev)"""
ENT = """ent AS (
  SELECT window_id, id, ts, pos, entity FROM (
    SELECT window_id, id, ts, unnest([host, process, hash, ip, prefix, asn, dom, dev, usr]) AS entity,
      unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS pos FROM evx) WHERE entity IS NOT NULL)"""
REL = """rel AS (
  SELECT window_id, id, ts, "left", "right", relation FROM (
    SELECT window_id, id, ts,
      unnest([host, coalesce(process, host), coalesce(process, host), ip, prefix, dom, host, host, usr, usr]) AS "left",
      unnest([process, hash, ip, prefix, asn, CASE WHEN dom IS NOT NULL THEN ip END, dom, dev, CASE WHEN usr IS NOT NULL THEN host END,
        CASE WHEN usr IS NOT NULL THEN process END]) AS "right",
      unnest(['executes', 'identified_by', 'connects_to', 'belongs_to', 'originated_by', 'resolves_or_connects', 'queries_or_visits',
        'contains', 'authenticates_to', 'owns']) AS relation
    FROM evx) WHERE "left" IS NOT NULL AND "right" IS NOT NULL)"""
NODES = """nodes AS (
  SELECT window_id, entity, min(ts) AS first_ts, arg_min(id, (ts, id, pos)) AS first_id, arg_min(pos, (ts, id, pos)) AS first_pos,
    max(ts) AS last_ts, count(*) AS n_events FROM ent GROUP BY ALL)"""
