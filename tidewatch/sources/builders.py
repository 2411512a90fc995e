"""Labeled windows for training sets: from a campaign template and audit logs, and from a labelling rule.

Windows are rows of a schedule and their events are made where the rows are.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.rules import PARTS

EVENTS = "window_id string, label int, id string, timestamp timestamp, source string, severity string, kind_json string, metadata_json string"
START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
#: Events of a template that are read to the driver at most.
MAX_TEMPLATE = 10_000

# Namespace of the ids, attributes by label (benign, malicious), and the harness's stages by label.
NAMESPACE = uuid.UUID("6f4d9d2e-0000-4000-8000-000000000002")
BY_LABEL = {
    "is_signed": (True, False), "concurrent_exfil": (False, True), "offset_seconds": (0.3, 90.0), "ntp_shift_seconds": (0.3, 90.0),
    "deviation_pct": (8.0, 350.0), "observed_us": (110, 450),
}
HASH_HEADS = ("5a", "de")
TRUSTED = ("142.250.80.46", "8.8.8.8", "1.1.1.1", "157.240.1.35")
PATHS = ("/usr/bin/updater", "/tmp/.x/update")
_KEYS = {p.name: p.keys for p in PARTS}


def _names(index: int, label: int) -> tuple[str, str, str, int]:
    """Host, address, hash and process number of the window ``index``."""
    return f"host-{index:04d}", f"198.51.{index % 256}.{10 + index % 200}", f"{HASH_HEADS[label]}{index:062x}"[-64:], 4000 + index


def _row(window: str, label: int, name: str, at: dt.datetime, source: str, severity: str, kind: dict, host: str) -> tuple:
    return window, label, name, at, source, severity, json.dumps(kind), json.dumps({"host": host})


def instantiate(template: list[dict], index: int, label: int, start: dt.datetime, stages: int | None, jitter: np.ndarray) -> list[tuple]:
    """The template as one campaign of its own: shared names, attributes of its label, its time; cut after ``stages`` events.

    Of a template event: source, severity, kind (dict), offset (seconds from the first).
    """
    host, ip, digest, pid = _names(index, label)
    window = f"w{index:04d}-{'mal' if label else 'ben'}"
    shared = {k: ip for k in _KEYS["ip"]} | {"exe_sha256": digest} | {k: pid for k in _KEYS["process"]} | {k: v[label] for k, v in BY_LABEL.items()}
    out = []
    for n, event in enumerate(template[:stages]):
        kind = copy.deepcopy(event["kind"])
        kind |= {k: v for k, v in shared.items() if k in kind}
        name = uuid.uuid5(NAMESPACE, f"{index}|{bool(label)}|{n}|{kind.get('type')}")
        at = start + dt.timedelta(seconds=event["offset"] + float(jitter[n]))
        out.append(_row(window, label, str(name), at, event["source"], event["severity"] if label else "INFO", kind, host))
    return out


def schedule(positives: int, negatives: int, seed: int = 7, truncated: float = 0.5) -> pd.DataFrame:
    """(index, label, stages): positives and negatives mixed over time, some positives cut after 2 to 5 stages (-1 for whole ones)."""
    rng = np.random.default_rng(seed)
    label = rng.permutation(np.repeat([1, 0], [positives, negatives]))
    cut = (label == 1) & (rng.random(len(label)) < truncated)
    return pd.DataFrame({"index": np.arange(len(label)), "label": label, "stages": np.where(cut, rng.integers(2, 6, len(label)), -1)})


def audit_clusters(rows: DataFrame, least: int = 3, want: int | None = None) -> DataFrame:
    """(rank, prefix, n, first_row) of rows (prefix, row_no): prefixes with ``least`` rows or more, largest first, ties by first row.

    Counted before anything is ranked; with ``want`` only that many are.
    """
    found = rows.where(F.col("prefix").isNotNull() & (F.col("prefix") != "")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row")).where(F.col("n") >= least)
    if want is not None:
        found = found.orderBy(F.desc("n"), "first_row").limit(want)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_row")) - 1)


def background(events: DataFrame, clusters: DataFrame, per_window: int = 3) -> DataFrame:
    """(index, place, source, severity, kind_json, metadata_json, id): the first events of the cluster whose rank is the window's index.

    ``events``: prefix, row_no and an event's fields; ``place`` counts from 0.  Only
    the first ``per_window`` of a cluster are taken, before the shuffle, too.
    """
    order = Window.partitionBy("prefix").orderBy("row_no")
    first = events.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < per_window)
    chosen = first.join(clusters.select("prefix", F.col("rank").alias("index")), "prefix")
    return chosen.select("index", "place", "id", "source", "severity", "kind_json", "metadata_json")


def kill_chain_windows(
    spark: SparkSession, template: DataFrame, positives: int = 40, negatives: int = 40, seed: int = 7, truncated: float = 0.5, around: DataFrame | None = None
) -> DataFrame:
    """Events of labeled windows: a campaign of ``template`` each, malicious or benign by label, three hours apart.

    ``template``: timestamp, id, source, severity, kind_json of one campaign, at most
    ``MAX_TEMPLATE`` events.  ``around``: a ``background`` that is stamped into the
    windows a second after their start and on.
    """
    rows = template.orderBy("timestamp", "id").limit(MAX_TEMPLATE + 1).collect()
    if not 0 < len(rows) <= MAX_TEMPLATE:
        raise ValueError(f"a template has 1 to {MAX_TEMPLATE} events")
    shape = [{"source": r["source"], "severity": r["severity"], "kind": json.loads(r["kind_json"]), "offset": (r["timestamp"] - rows[0]["timestamp"]).total_seconds()} for r in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for index, label, stages in frame[["index", "label", "stages"]].itertuples(index=False):
                jitter = np.random.default_rng((seed, int(index))).uniform(0, 0.5, len(shape))
                out += instantiate(shape, int(index), int(label), START + dt.timedelta(hours=3 * int(index)), None if stages < 0 else int(stages), jitter)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    plan = spark.createDataFrame(schedule(positives, negatives, seed, truncated))
    made = plan.mapInPandas(run, EVENTS)
    if around is None:
        return made
    window = F.format_string("w%04d-%s", F.col("index"), F.when(F.col("label") == 1, "mal").otherwise("ben"))
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("index").cast("int") * 3, secs=F.col("place").cast("int") + 1)
    extra = around.join(plan, "index").select(window.alias("window_id"), F.col("label").cast("int").alias("label"), "id", at.alias("timestamp"), "source", "severity", "kind_json", "metadata_json")
    return made.unionByName(extra)


def harness_windows(spark: SparkSession, each: int = 40) -> DataFrame:
    """Events of ``2 * each`` windows, every other one malicious in intent, labelled by ``confirmed``.

    Ids follow from the window and the stage, so that the same windows come again.
    """

    def stages(index: int) -> list[tuple[str, str, dict]]:
        bad = 1 - index % 2
        host, _, digest, pid = _names(index, bad)
        ip = f"198.51.{index % 256}.{10 + index % 200}"
        lead = [
            ("kernel_ebpf", "HIGH", {"type": "physics_anomaly", "dst_ip": TRUSTED[index % 4], "expected_ttl_range": [48, 58], "observed_ttl": 63, "rtt_ms": 2.0, "reason": "single-hop intercept"}),
            ("sentinel_correlation", "HIGH", {"type": "igmp_quic_correlation", "window_ms": 200}),
        ]
        of = {k: v[bad] for k, v in BY_LABEL.items()}
        return (lead if bad else []) + [
            ("kernel_ebpf", ("INFO", "HIGH")[bad], {"type": "socket_lineage", "pid": pid, "tgid": pid, "exe_path": PATHS[bad], "exe_sha256": digest, "dst_ip": ip, "dst_port": 443, "is_signed": of["is_signed"]}),
            ("network_zeek", "HIGH", {"type": "ntp_time_shift", "offset_seconds": of["offset_seconds"], "ntp_server": ip}),
            ("hardware_nvme", ("INFO", "CRITICAL")[bad], {"type": "nvme_latency_anomaly", "device": "/dev/nvme0", "baseline_us": 100} | {k: of[k] for k in ("observed_us", "deviation_pct", "concurrent_exfil")}),
        ]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for index in frame["id"].tolist():
                for n, (source, severity, kind) in enumerate(stages(index)):
                    name = str(uuid.uuid5(NAMESPACE, f"harness|{index}|{n}"))
                    out.append(_row(f"w{index:04d}", 0, name, START + dt.timedelta(hours=3 * index, seconds=n), source, severity, kind, f"host-{index:04d}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    events = spark.range(2 * each).mapInPandas(run, EVENTS).drop("label")
    return events.join(confirmed(events), "window_id")


def confirmed(events: DataFrame, trusted: tuple[str, ...] = TRUSTED) -> DataFrame:
    """(window_id, label): 1 where a correlator would confirm an intrusion, by its visible recipe.

    A physics anomaly towards a highly trusted address and an IGMP to QUIC
    correlation, both before a latency anomaly with exfiltration.  An
    approximation: the correlator itself is not at hand.
    """
    kind, of = F.get_json_object("kind_json", "$.type"), lambda k: F.get_json_object("kind_json", f"$.{k}")
    first = lambda hit: F.min(F.when(hit, F.col("timestamp")))
    seen = events.groupBy("window_id").agg(
        first((kind == "physics_anomaly") & of("dst_ip").isin(*trusted)).alias("p"), first(kind == "igmp_quic_correlation").alias("q"),
        F.max(F.when((kind == "nvme_latency_anomaly") & (of("concurrent_exfil") == "true"), F.col("timestamp"))).alias("x"),
    )
    return seen.select("window_id", F.coalesce((F.col("p") <= F.col("x")) & (F.col("q") <= F.col("x")), F.lit(False)).cast("int").alias("label"))
