"""The event-analytics engine: columns against plain Python, batch against stream, readers and reports."""

import datetime as dt
import hashlib
import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions.entities import project
from tidewatch.model import train
from tidewatch.model.nn import VARIANTS, Model, Spec
from tidewatch.functions.rules import read_event
from tidewatch.model.window import window_tensors
from tidewatch.operators import attack, campaigns, correlate, graph, metrics, psi, ranking, reputation, score
from tidewatch.sources import readers, sinks
from tidewatch.sources.simulator import SCENARIOS, simulate, simulated_events
from tidewatch.streaming.scorer import Scorer, Stream, score_stream

T0 = dt.datetime(2025, 3, 1, 12, 0, 0, tzinfo=dt.UTC)
COLUMNS = "window_id string, id string, timestamp timestamp, source string, severity string, kind_json string, metadata_json string"

# Each kind below takes other branches of the extraction rules.
EDGE_KINDS = [
    ({"type": "triage_classification", "dest_ips": ["1.1.1.1", "2.2.2.2", "1.1.1.1"], "sha256": "ABC"}, {"host": "a"}, "kernel_ebpf"),
    ({"type": "octet_reversal_detected", "ptr_query": "Some.Host..", "forward_ip": "8.8.8.8"}, {"hostname": "b"}, "network_zeek"),
    ({"type": "never_seen", "sni": "x", "src_ip": "10.0.0.1", "gateway_ip": "10.0.0.2"}, {}, "network_suricata"),
    ({"type": "socket_lineage", "tgid": 7, "exe_sha256": "", "dst_ip": "", "is_signed": False}, {"host": ""}, "odd"),
    ({"type": "socket_lineage", "pid": 0, "tgid": 0, "session_id": 0, "user": "ROOT", "cloud_resource": "S3://B"}, {"host": "c"}, "hardware_rtc"),
    ({"type": "quic_heartbeat", "username": "Ann", "sid": "s1", "arn": "ARN:x", "target_host": "z", "device": "d0", "pid": 4}, {"host": "c"}, "hardware_x"),
    ({"type": "bgp_anomaly", "prefix": "10.0.0.0/8", "observed_origin_asn": 0, "legitimate_origin_asn": None, "dst_ip": "9.9.9.9", "kind": {"kind": "route_leak"}}, {"host": "d"}, "sentinel_correlation"),
    ({"type": "bgp_anomaly", "prefix": "p", "observed_origin_asn": 5, "legitimate_origin_asn": 6, "kind": {"kind": "subprefix_hijack_local_infra"}}, {"host": "d"}, "sentinel_correlation"),
    ({"type": "hsts_time_manipulation", "domain": "A.b.", "account": "", "user": None, "dst_ip": "3.3.3.3", "is_signed": None}, {"host": "e"}, "network_zeek"),
    ({"type": "nvme_latency_anomaly", "concurrent_exfil": False, "device": "n1"}, {"host": "e"}, "hardware_nvme"),
    ({"type": "nvme_latency_anomaly", "concurrent_exfil": 1, "dest_ips": [], "pid": 12}, {"host": "e"}, "hardware_nvme"),
    ({"type": "x"}, {}, "y"),
]


def _edge_events():
    return [{"id": f"e{i:02d}", "timestamp": T0 + dt.timedelta(seconds=7 * i), "source": s, "severity": ["HIGH", "info", "odd"][i % 3], "kind": k, "metadata": m} for i, (k, m, s) in enumerate(EDGE_KINDS)]


def _frame(spark, windows):
    rows = [(w, e["id"], e["timestamp"], e["source"], e["severity"], json.dumps(e["kind"]), json.dumps(e["metadata"])) for w, events in windows.items() for e in events]
    return spark.createDataFrame(rows, COLUMNS)


def test_projection_agrees_with_plain_python(spark):
    events = _edge_events() + simulate(1, 3) + simulate(0, 4, "lateral_movement")
    got = {r["id"]: r for r in project(_frame(spark, {"w": events})).collect()}
    for e in events:
        want, r = read_event(e), got[e["id"]]
        assert r["entities"] == want.entities
        assert [tuple(x) for x in r["relations"]] == want.relations
        assert np.allclose([r[n] for n in config.FEATURES], want.features), e
    bad = spark.createDataFrame([("w", "1", T0, "s", "INFO", None, None), ("w", "2", T0, "s", None, "{bad", "[]")], COLUMNS)
    assert [r["entities"] for r in project(bad).collect()] == [["host:unknown-host"]] * 2


def test_schema_hash_and_buckets():
    assert config.schema_hash() == "88310d5b8c464ec74ab88904dff2a5d4"  # fixed value: the layout other findings name
    assert [config.kind_bucket(k) for k in ("socket_lineage", "mac_flapping", "physics_anomaly", "ntp_time_shift", "unknown")] == [0, 1, 2, 3, 3]


@pytest.fixture(scope="module")
def windows():
    return {f"{s}-{y}": simulate(y, 11 + i, s) for i, s in enumerate(SCENARIOS[:4]) for y in (0, 1)} | {"edge": _edge_events()}


@pytest.mark.parametrize("mode", ["global", "time_aware"])
def test_node_scores_agree_with_plain_python(spark, windows, mode):
    model = Model(Spec(time_mode=mode, half_life=600.0), seed=5)
    if "time" in model.w:
        model.w["time"].value[:] = 0.3
    got = {}
    for r in score.node_scores(project(_frame(spark, windows)), model).collect():
        got.setdefault(r["window_id"], {})[r["node_index"]] = r
    for w, events in windows.items():
        t = window_tensors(events, 24, mode, 600.0)
        top, logits = model.forward(t.x[None], t.mask[None], t.adjacency[None], t.gaps[None])
        rows = [got[w][i] for i in range(len(t.nodes))]
        assert [r["entity"] for r in rows] == t.nodes
        assert np.allclose([r["logit"] for r in rows], logits.value[0], atol=1e-6)
        assert abs(rows[0]["graph_logit"] - top.value[0]) < 1e-6


def test_every_entity_of_a_large_window_is_scored(spark):
    # more nodes than the 2,048 that were once kept
    events = [{"id": f"e{i:04d}", "timestamp": T0 + dt.timedelta(seconds=i), "source": "network_zeek", "severity": "HIGH", "kind": {"type": "socket_lineage", "user": f"u{i // 3}"}, "metadata": {"host": f"h{i % 1600}"}} for i in range(3000)]
    model = Model(Spec(half_life=600.0), seed=5).freeze()
    t = window_tensors(events, 24, "time_aware", 600.0)
    args = t.x[None], t.mask[None], t.adjacency[None], t.gaps[None]
    top, logits = model.forward(*args)
    rows = score.node_scores(project(_frame(spark, {"w": events})), model).orderBy("node_index").collect()
    assert len(t.nodes) > 2048 and [r["entity"] for r in rows] == t.nodes
    assert np.allclose([r["logit"] for r in rows], logits.value[0], atol=1e-6) and abs(rows[0]["graph_logit"] - top.value[0]) < 1e-6
    less = t.x.copy()
    shown = [f for f in range(less.shape[2]) if less[..., f].any()]
    less[..., shown[0]] = 0.0
    fall = logits.value[0] - model.forward(less[None], *args[1:])[1].value[0]
    assert np.allclose([r["attribution"][shown[0]] for r in rows], fall, atol=1e-6)


def test_findings(spark, windows):
    data = train.simulated(20, 7)
    model = Model(Spec(half_life=3600.0), seed=2)
    model.feature_stats = train.snapshot(data)
    events = project(_frame(spark, windows))
    plain = {r["window_id"]: r for r in score.findings(events, model).collect()}
    hushed = {r["window_id"]: r for r in score.findings(events, model, rules=["host:", "ip:9.9.9.9"]).collect()}
    for w, own in windows.items():
        r, t = plain[w], window_tensors(own, 24, "time_aware", 3600.0)
        assert r["graph_nodes"] == len(t.nodes) and r["graph_relations"] == t.relations
        assert r["campaign_id"] == "idr-campaign-" + min((e["timestamp"], e["id"]) for e in own)[1][:8]
        assert len(r["related_entities"]) == min(5, len(t.nodes)) and [x["entity"] for x in r["entity_evidence"]] == r["related_entities"]
        assert hushed[w]["escalation_probability"] == r["escalation_probability"] and not any(e.startswith("host:") for e in hushed[w]["related_entities"])
        assert [e for e in t.nodes if e.startswith("host:") or e == "ip:9.9.9.9"] == hushed[w]["applied_suppressions"]
        assert r["feature_drift"]["psi_max"] >= r["feature_drift"]["psi_mean"] >= 0
    assert plain["v0_easy-1"]["predicted_next_stage"] == "exfiltration" and len(plain["v0_easy-1"]["observed_attack_stages"]) == 6


def test_stream_equals_batch(spark, windows, tmp_path):
    model = Model(Spec(half_life=3600.0), seed=9)
    model.feature_stats = train.snapshot(train.simulated(20, 7))
    _frame(spark, windows).withColumnRenamed("window_id", "stream_id").repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(COLUMNS.replace("window_id", "stream_id")).parquet(str(tmp_path / "in"))
    run = score_stream(source, model).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    found = {r["stream_id"]: json.loads(r["body"]) for r in spark.read.parquet(str(tmp_path / "out")).where("output = 'finding'").collect()}
    for r in score.findings(project(_frame(spark, windows)), model).collect():
        got = found[r["window_id"]]
        assert abs(got["escalation_probability"] - r["escalation_probability"]) < 2e-6 and got["graph_relations"] == r["graph_relations"]
        assert got["predicted_next_stage"] == r["predicted_next_stage"] and got["campaign_id"] == r["campaign_id"]
        assert abs(got["feature_drift"]["psi_max"] - r["feature_drift"]["psi_max"]) < 1e-4


def test_stream_rules():
    model, stream = Model(seed=1).freeze(), Stream()
    at = lambda e: int(e["timestamp"].timestamp() * 1e6)
    events = simulate(1, 3)
    assert all(stream.ingest(model, e, at(e), 6) for e in events)
    assert not stream.ingest(model, events[0], at(events[0]), 6)  # older than the clock
    assert stream.ingest(model, events[-1], at(events[-1]), 6)  # as old as it
    assert len(stream.entities) == 6 and stream.evictions and stream.relations["executes"] == 2
    assert all(a in stream.entities and b in stream.entities for a, b in stream.edges)
    with pytest.raises(ValueError):
        Scorer(Model(Spec(use_sequence=False)))


def test_training_floors_and_round_trip(tmp_path):
    report, model = train.ablation(40, 2, 7)
    # fixed values: ceilings of the Brier score by arm
    ceilings = {"static_baseline": 0.42, "s6_only": 0.34, "gnn_only": 0.35, "s6_gnn": 0.34, "s6_gnn_uniform_pool": 0.26}
    for name in VARIANTS:
        assert report["metrics"][name]["roc_auc"] >= 0.8 and report["metrics"][name]["brier"] <= ceilings[name]
    model.save(tmp_path / "m")
    again, batch = Model.load(tmp_path / "m"), train.simulated(20, 99)
    assert np.allclose(train.logits_of(again, batch), train.logits_of(model, batch)) and again.calibration() == model.calibration()
    text = (tmp_path / "m/manifest.json").read_text()
    (tmp_path / "m/manifest.json").write_text(text.replace(config.schema_hash(), "0" * 32))
    with pytest.raises(ValueError):
        Model.load(tmp_path / "m")
    pairs = [(simulate(i % 2, i), i % 2) for i in range(60)]
    verdict = train.validate(model, pairs, provenance="site capture 7", target_fpr=0.1)
    assert verdict["verdict"] in ("go", "no-go") and len(verdict["gates"]) == 9 and "| roc_auc |" in train.model_card(verdict)
    with pytest.raises(ValueError):
        train.validate(model, pairs, gates={"nope": 1})
    with pytest.raises(ValueError):
        train.validate(model, [(simulate(1, i), 1) for i in range(8)])
    assert train.is_binding("site capture") and not train.is_binding("Simulator run") and not train.is_binding(" ")


def test_calibration_never_worsens():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        z, y = rng.normal(size=50) * 3, (rng.random(50) < 0.3).astype(float)
        s, b = train.calibrate(z, y)
        assert train.nll(s * z + b, y) <= train.nll(z, y) + 1e-12 and 0.2 <= s <= 5 and abs(b) <= 5


def test_simulator(spark):
    sizes = {"distractor": 9, "stale_preamble": 10}
    for s in SCENARIOS:
        for y in (0, 1):
            events = simulate(y, 5, s)
            assert events == simulate(y, 5, s) and (s == "truncated" or len(events) == sizes.get(s, 6))
            assert all(e["id"].startswith("00000000") for e in events)
    assert {e["kind"]["user"] for e in simulate(1, 4, "lateral_movement")} == {"svc-account-04"}
    grid = spark.createDataFrame([(1, 2, "v0_easy"), (0, 2, "graded")], "label int, seed int, scenario string")
    assert simulated_events(spark, grid).groupBy("window_id").count().count() == 2


def test_metrics_agree_with_numpy(spark):
    rng = random.Random(1)
    rows = [(int(p > rng.random()), round(p, 2)) for p in (rng.random() for _ in range(400))]
    frame = spark.createDataFrame(rows, "label int, score double")
    want = train.metrics(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]))
    points = metrics.curve(frame)
    one = lambda df: df.first()[0]
    assert math.isclose(one(metrics.roc_auc(points)), want["roc_auc"]) and math.isclose(one(metrics.average_precision(points)), want["pr_auc"])
    assert math.isclose(one(metrics.brier(frame)), want["brier"]) and math.isclose(one(metrics.log_loss(frame)), want["log_loss"])
    ece = metrics.calibration_errors(frame).first()
    assert math.isclose(ece["ece"], want["ece"]) and math.isclose(ece["mce"], want["max_calibration_error"])
    assert math.isclose(one(metrics.recall_at_fpr(points, 0.01)), want["recall_at_fpr_1pct"])
    tau = metrics.threshold_at_fpr(points, 0.05).first()
    assert np.allclose([tau["tau"], tau["dev_fpr"], tau["dev_tpr"]], train.threshold(*(np.array(c, float) for c in zip(*rows, strict=True)), 0.05))
    ones = metrics.curve(frame.where("label = 1"))
    assert one(metrics.recall_at_fpr(ones, 0.01)) == 1.0 and one(metrics.recall_at_fpr(metrics.curve(frame.where("label = 0")), 0.01)) == 0.0
    assert one(metrics.roc_auc(ones)) is None and metrics.confusion(frame, 2.0).first()["precision"] is None


def test_ranking_budget_and_stages(spark):
    scores = [0.5, 0.9, 0.5, 0.5, 0.7, 0.99]
    frame = spark.createDataFrame([("w", f"e{i}" if i < 5 else "host:x", i, s) for i, s in enumerate(scores)], "window_id string, entity string, node_index int, score double")
    assert [r["entity"] for r in ranking.top_k(frame, 6, ["host:"]).orderBy("rank").collect()] == ["e1", "e4", "e0", "e2", "e3"]
    seen = spark.createDataFrame([("w", e, T0 + dt.timedelta(minutes=m)) for e, m in (("a", 0), ("b", 5), ("c", 5), ("d", 9))], "window_id string, entity string, last_ts timestamp")
    assert {r["entity"] for r in graph.budget(seen, 2).where("kept").collect()} == {"c", "d"}
    with pytest.raises(ValueError):
        graph.budget(seen, 0)
    kinds = spark.createDataFrame([("w", "1", T0, "nvme_latency_anomaly"), ("w", "2", T0, "mac_flapping"), ("v", "3", T0, "none")], "window_id string, id string, timestamp timestamp, kind_type string")
    assert [tuple(r) for r in attack.next_stage(attack.stages(kinds)).collect()] == [("w", "command-and-control")]
    reference = spark.createDataFrame([("collection",)], "tactic string")
    techniques = spark.createDataFrame([("T1005", ["collection"]), ("T1557", ["discovery"])], "technique string, tactics array<string>")
    problems = {tuple(r) for r in attack.mapping_problems(reference, techniques).collect()}
    assert ("bgp_anomaly", "tactic not of technique") in problems and not any(k == "nvme_latency_anomaly" for k, _ in problems)


def test_histogram_edges(spark):
    values = [0.0, 0.15, 0.3, 0.29999, 1.5, 1.51, -0.1, 0.65, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(psi.bin_of(F.col("v"), config.DRIFT_EDGES)).collect()]
    for v, b in zip(values, got, strict=True):
        want = np.flatnonzero(np.histogram([np.float32(v)], config.DRIFT_EDGES)[0]) if v is not None else []
        assert b == (int(want[0]) if len(want) else None)


def test_registry(tmp_path):
    known = campaigns.Registry()
    first = known.resolve(["hash:a", "domain:b", "host:x", "process:x:1"], "t1")
    assert first[1:] == (False, 1) and first[0] == "idr-campaign-" + hashlib.blake2s(b"domain:b\nhash:a\nhost:x", digest_size=6).hexdigest()
    assert known.resolve(["hash:a", "domain:b", "host:y"], "t2") == (first[0], True, 2)
    assert known.resolve(["host:x"], "t3")[1] is False and known.resolve(["process:x:1", "session:x:2"], "t4")[0] == campaigns.UNFINGERPRINTED
    known.save(tmp_path / "r.json")
    assert campaigns.Registry.load(tmp_path / "r.json").resolve(["hash:a", "domain:b"], "t5")[:2] == (first[0], True)
    assert campaigns.Registry.load(tmp_path / "none.json").rows == []


def test_reputation(spark):
    trust, prefixes = reputation.seed_tables(spark)
    more = prefixes.unionByName(spark.createDataFrame([("8.8.8.128", 25, "AS1"), ("22.0.0.0", 8, "AS7922"), ("1.2.3.4", 40, "AS2"), ("bad", 8, "AS3"), ("0.0.0.0", 0, "AS0")], prefixes.schema))
    asked = spark.createDataFrame([(x,) for x in ("8.8.8.8", "8.8.8.200", "142.251.80.46", "93.184.216.34", "nonsense", None, "142.250.3.22")], "ip string")
    got = {r["ip"]: (r["asn"], r["trust"]) for r in reputation.with_trust(reputation.with_asn(asked, "ip", more), "asn", trust).collect()}
    assert got["8.8.8.8"] == ("AS15169", "HighTrust") and got["8.8.8.200"] == ("AS1", "Unknown") and got["142.251.80.46"][0] == "AS15169"
    assert got["93.184.216.34"] == ("AS0", "Unknown") and got["nonsense"] == (None, "Unknown")
    assert [r["ip"] for r in reputation.octet_reversals(asked, "ip", more, trust).collect()] == ["142.250.3.22"]


def test_interval_join(spark):
    rng = random.Random(2)
    a, b = ([(i, rng.choice([None, rng.randrange(5000)])) for i in range(80)] for _ in range(2))
    got = correlate.interval_join(spark.createDataFrame(a, "x int, at long"), spark.createDataFrame(b, "y int, at long"), "at", 500)
    assert {(r["x"], r["y"]) for r in got.collect()} == {(i, j) for i, s in a for j, t in b if None not in (s, t) and s <= t <= s + 500}


def test_readers_and_writers(spark, tmp_path):
    good = {"id": 5, "timestamp": "2025-03-01T12:00:00.5+01:00", "source": "s", "severity": "high", "kind": {"type": "x"}, "metadata": None}
    lines = [json.dumps(good), "", json.dumps({"id": 1, "kind": {}}), json.dumps(good | {"kind": 3}), json.dumps(good | {"metadata": "m"}), json.dumps(good | {"timestamp": "never"}), "{bad"]
    (tmp_path / "e.ndjson").write_text("\n".join(lines))
    rows = {r["line_no"]: r for r in readers.read_events(spark, str(tmp_path / "e.ndjson"), "PERMISSIVE").collect()}
    assert rows[1]["error"] is None and (rows[1]["id"], rows[1]["severity"], rows[1]["metadata_json"]) == ("5", "HIGH", "{}")
    assert rows[1]["timestamp"] == dt.datetime(2025, 3, 1, 11, 0, 0, 500000) or rows[1]["timestamp"].microsecond == 500000
    assert [rows[i]["error"].split(":")[0] for i in (3, 4, 5, 6, 7)] == ["missing fields", "kind must be an object", "metadata must be an object", "invalid timestamp", "invalid JSON"]
    assert rows[3]["error"].endswith("severity, source, timestamp") and 2 not in rows
    with pytest.raises(Exception, match="e.ndjson:3"):
        readers.read_events(spark, str(tmp_path / "e.ndjson")).collect()
    events = _frame(spark, {"w": simulate(1, 3)}).withColumn("label", F.lit(1))
    sinks.write_events(events, str(tmp_path / "out"))
    again = readers.read_events(spark, str(tmp_path / "out"))
    assert sorted(r["id"] for r in again.collect()) == sorted(e["id"] for e in simulate(1, 3))
    sinks.write_labeled_windows(events, str(tmp_path / "lw"))
    body = next(p for p in (tmp_path / "lw").iterdir() if p.suffix == ".txt" and p.stat().st_size).read_text()
    (tmp_path / "set").mkdir()
    (tmp_path / "set/a.labeled.ndjson").write_text(body + json.dumps({"window_id": "v", "label": 2, "events": []}) + "\n")
    (tmp_path / "set/other.ndjson").write_text("ignored")
    found = readers.read_labeled_windows(spark, str(tmp_path / "set")).orderBy("line_no", "event_pos").collect()
    assert len(found) == 7 and found[-1]["error"] == "label must be 0 or 1" and found[0]["label"] == 1


def test_audit_log(spark):
    space = uuid.uuid5(uuid.NAMESPACE_DNS, "tests")
    record = {"kind": {"observed_moas": {"n": 3}}, "prefix": "10.0.0.0/8", "observed_origin_asn": 7, "ts": {"secs_since_epoch": 1740830400, "nanos_since_epoch": 500_000_000}}
    lines = [(1, json.dumps(record)), (2, "{bad"), (3, json.dumps(record | {"kind": {"hijack": {}}, "ts": "2025-03-01T00:00:00Z"})), (4, json.dumps(record | {"prefix": "other"}))]
    frame = spark.createDataFrame(lines, "line_no long, value string")
    rows = readers.audit_events(frame, space.hex, "10.0.0.0/8").collect()
    when = "2025-03-01T12:00:00.500000+00:00"
    assert [r["line_no"] for r in rows] == [1, 3] and [r["severity"] for r in rows] == ["WARNING", "HIGH"]
    assert rows[0]["timestamp"] == when and rows[0]["id"] == str(uuid.uuid5(space, f"10.0.0.0/8|{when}|observed_moas|7"))
    assert json.loads(rows[0]["kind_json"])["kind"]["kind"] == "observed_moas" and json.loads(rows[1]["kind_json"])["confidence"] == "high"
    assert readers.audit_events(frame, space.hex, max_events=1).count() == 1


def test_technique_bundle(spark):
    schema = "objects array<struct<id:string,type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_shortname:string,tactic_refs:array<string>,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    ref, phase = [("other", "X"), ("mitre-attack", "T1")], [("mitre-attack", "impact"), ("else", "no")]
    item = lambda i, t, **k: (i, t, k.get("name"), k.get("revoked"), None, k.get("short"), k.get("refs"), k.get("ext"), k.get("ph"))
    objects = [item("m", "x-mitre-matrix", refs=["t2", "t1"]), item("t1", "x-mitre-tactic", short="impact"), item("t2", "x-mitre-tactic", short="collection"), item("a", "attack-pattern", name="A", ext=ref, ph=phase), item("b", "attack-pattern", name="B", ext=ref, revoked=True)]
    tactics, techniques = readers.attack_reference(spark.createDataFrame([(objects,)], schema))
    assert [r["tactic"] for r in tactics.orderBy("pos").collect()] == ["collection", "impact"]
    assert [tuple(r) for r in techniques.collect()] == [("T1", "A", ["impact"])]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[model]\nhidden_dim = 8\n")
    loaded, usual = config.read_settings(tmp_path / "c.toml"), config.Settings()
    assert loaded["model.hidden_dim"] == 8 and loaded.sections()["graph"] == usual.sections()["graph"] and loaded.digest() != usual.digest()
    for changed, error in (({"model.depth": 1}, KeyError), ({"scoring.top_k": "5"}, TypeError)):
        with pytest.raises(error):
            config.Settings(changed)


def test_log_lines(capsys):
    sinks.logger("info").info("done", extra={"fields": {"n": 1}})
    out = capsys.readouterr()
    assert out.out == ""
