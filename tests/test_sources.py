"""Wire format, validators, dataset builders, event timestamps, split files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import validators
from tidewatch.functions.timestamps import iso_instant, unknown_zones, with_instant
from tidewatch.sources import builders, readers, wire

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
MICRO = dt.timedelta(microseconds=1)


def _iso_shapes():
    """(text, microseconds or None), by rule: every date, separator, time and offset that may stand together."""
    day = lambda *d: (dt.datetime(*d, tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // MICRO
    dates = {"2026-03-01": day(2026, 3, 1), "20260301": day(2026, 3, 1), "2026-W09-7": day(2026, 3, 1), "2026W097": day(2026, 3, 1), "2026-W09": day(2026, 2, 23), "2026-13-01": None, "2026-02-30": None, "2026-3-01": None, "2026": None}
    hms = lambda h, m=0, s=0, us=0: ((h * 60 + m) * 60 + s) * 1_000_000 + us
    times = {
        "11": hms(11), "1109": hms(11, 9), "11:09": hms(11, 9), "110930": hms(11, 9, 30), "11:09:30": hms(11, 9, 30), "11:09:30.5": hms(11, 9, 30, 500_000), "11:09:30,5": hms(11, 9, 30, 500_000),
        "11:09:30.123456789": hms(11, 9, 30, 123_456), "24:00": hms(24), "24:00:00": hms(24), "24:00:01": None, "11:60:00": None, "11:09:60": None, "9:09:30": None, "11:09.5": None, "11.5": None,
    }
    zones = {"": 0, "Z": 0, "z": None, "+00": 0, "+0000": 0, "+09": hms(9), "+0930": hms(9, 30), "+09:30": hms(9, 30), "-05": -hms(5), "+09:30:15": hms(9, 30, 15), "+093015": hms(9, 30, 15), "+5": None, "+24:00": None}
    for d, du in dates.items():
        yield d, du
        for separator in ("T", " ", "_") if d == "2026-03-01" else ("T",):
            for t, tu in times.items():
                for z, zu in zones.items():
                    yield f"{d}{separator}{t}{z}", None if None in (du, tu, zu) else du + tu - zu
    for text in ("", "notatime", "2026-03-01T", " 2026-03-01T11:09:30Z", "2026-03-01T11:09:30Z ", "1772363340", "03/01/2026 11:09:30", "0001-01-01T00:00+23:59", "2026-W60-1", "20260232T24:00:00"):
        yield text, None
    yield "20260300T24:00:00", day(2026, 3, 1)
    yield "2026-01-31T24:00:00", day(2026, 2, 1)


def test_event_timestamps(spark):
    shapes = dict(_iso_shapes())
    got = dict(spark.createDataFrame([(t,) for t in shapes], "t string").select("t", iso_instant(F.col("t"))).collect())
    wrong = {t: (got[t], us) for t, us in shapes.items() if got[t] != us}
    assert len(shapes) > 1500 and not wrong


def test_zones_without_a_slash(spark):
    rows = [("2024-07-01T12:00:00", z) for z in ("CET", "Japan", "EST5EDT", "EST", "Nowhere/X", None)]
    frame = spark.createDataFrame(rows, "timestamp string, zone string")
    hours = [(r["utc_us"] // 3_600_000_000) % 24 for r in with_instant(frame, "timestamp", "zone").collect()]
    assert hours == [10, 3, 16, 17, 12, 12]
    assert [tuple(r) for r in unknown_zones(frame, "zone").collect()] == [("Nowhere/X", 1)]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = {r["line_no"]: r["value"] for r in got if r["file"].endswith("a.txt")}
    assert own == {i: line for i, line in enumerate(lines, 1) if line} and len(got) == len(own) + 2


def test_wire_format(spark):
    good = wire.new_event("kernel_ebpf", "HIGH", "igmp_trigger", src_ip="1.1.1.1", group_addr="224.0.0.1")["kind"]
    for bad in ({"src_ip": "1.1.1.1"}, {"src_ip": "1", "group_addr": "2", "more": 3}):
        with pytest.raises(ValueError):
            wire.new_event("kernel_ebpf", "HIGH", "igmp_trigger", **bad)
    lineage = {"type": "socket_lineage", "pid": 1, "tgid": 2, "exe_path": "/x", "exe_sha256": "ab", "dst_ip": "1.1.1.1", "dst_port": 443, "is_signed": True}
    route = {"type": "bgp_anomaly", "kind": {"kind": "bogon"}, "prefix": "10.0.0.0/8", "observed_origin_asn": 1}
    cases = [
        (good, False, []), (lineage, False, []), (lineage | {"dst_port": 65536, "is_signed": "yes", "extra": 1}, False, ["dst_port", "is_signed"]), (lineage | {"pid": -1, "tgid": 1.5}, False, ["pid", "tgid"]),
        ({"type": "ntp_time_shift", "offset_seconds": 3, "ntp_server": None}, False, ["ntp_server"]), ({"type": "no_such"}, True, []), ({}, True, []), (route, False, []),
        (route | {"kind": {"kind": "observed_moas", "observed_origins": ["x"]}}, False, ["kind.observed_origins"]), (route | {"kind": {"kind": "odd"}, "prefix": 5}, False, ["prefix", "kind.kind"]),
        ({"type": "triage_classification", "family": "f", "confidence": "c", "score": 4294967295, "source_path": "p", "dest_ips": []}, False, []),
        ({"type": "mac_flapping", "gateway_ip": "g", "old_mac": "a", "new_mac": "b", "flap_count": 1, "window_seconds": 2**64 - 1}, False, []),
    ]
    frame = spark.createDataFrame([(i, json.dumps(k)) for i, (k, _, _) in enumerate(cases)] + [(99, None), (98, "[]")], "i int, kind_json string")
    got = {r["i"]: (r["unknown_kind"], r["wrong_fields"]) for r in wire.with_wire_problems(frame).collect()}
    assert got == {i: (u, w) for i, (_, u, w) in enumerate(cases)} | {99: (True, []), 98: (True, [])}


def test_validators(spark):
    names = {"eth0": True, "wlan0.1:2_a-b": True, "": False, "a" * 15: True, "a" * 16: False, "eth 0": False, "eth0\n": False, "ethé": False}
    paths = {"/dev/nvme0": True, "/dev/disk/by-id/x_1": True, "/dev/": True, "/dev/../etc": False, "/etc/x": False, "/dev/a b": False}
    for table, check in ((names, validators.is_interface_name), (paths, validators.is_device_path)):
        assert dict(spark.createDataFrame([(n,) for n in table], "n string").select("n", check(F.col("n"))).collect()) == table
    good = {"kernel.suspicious_rtt_ms": 0.1, "network.zeek_socket_path": "/var/x.sock", "sentinel.panic_interface": "eth0", "sentinel.ws_listen_addr": "127.0.0.1:9700", "dashboard.listen_addr": "[::1]:80"}
    assert validators.setting_problems(good) == [] and validators.setting_problems({}) == []
    bad = {"hardware.mac_flap_threshold": 0, "network.zeek_socket_path": "../x", "sentinel.panic_interface": "eth0; x", "sentinel.ws_listen_addr": "localhost:1", "dashboard.listen_addr": "1.2.3.4:70000"}
    assert len(validators.setting_problems(bad)) == 5


def test_builders(spark):
    events = builders.harness_windows(spark, 6)
    labels = dict(events.select("window_id", "label").distinct().collect())
    assert labels == {f"w{i:04d}": 1 - i % 2 for i in range(12)}
    assert events.where("label = 1").count() == 30 and events.where("label = 0").count() == 18
    template = events.where("window_id = 'w0000'")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["p", "q", "p", None, "", "p", "q", "q", "q", "r"])], "row_no long, prefix string")
    clusters = builders.audit_clusters(rows)
    assert [tuple(r) for r in clusters.select("rank", "prefix", "n", "first_row").collect()] == [(0, "q", 4, 1), (1, "p", 3, 0)]
    assert builders.audit_clusters(rows, want=1).count() == 1
    lines = rows.select("*", *[F.lit("x").alias(c) for c in ("id", "source", "severity", "kind_json", "metadata_json")])
    around = builders.background(lines.where("prefix is not null"), clusters, 2)
    windows = builders.kill_chain_windows(spark, template, 8, 4, around=around)
    again = builders.kill_chain_windows(spark, template, 8, 4, around=around)
    got = windows.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
    by = {}
    for r in got:
        by.setdefault(r["window_id"], []).append(r)
    assert len(by) == 12 and sum(w.endswith("-mal") for w in by) == 8 and sum(r["id"] == "x" for r in got) == 4
    for w, own in by.items():
        made = [r for r in own if r["id"] != "x"]
        assert len(made) in ((2, 3, 4, 5) if w.endswith("-mal") else (5,)) and len({r["label"] for r in own}) == 1
        kinds = [json.loads(r["kind_json"]) for r in made]
        assert all(k.get("concurrent_exfil") in (None, w.endswith("-mal")) for k in kinds)
        assert {json.loads(r["metadata_json"])["host"] for r in made} == {f"host-{int(w[1:5]):04d}"}
