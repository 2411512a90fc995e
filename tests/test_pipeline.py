"""The general operators against plain Python versions, and their defined edge cases."""

import datetime as dt
import itertools
import json
import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.events import canonical_id, host_of
from tidewatch.functions.timestamps import known_zones, with_instant
from tidewatch.operators import dedup, drift, feature_table, nested, sessions
from tidewatch.plans import pipeline

T0 = dt.datetime(2025, 3, 1, 12, 0, 0, tzinfo=dt.UTC)

TEXTS = [
    "2025-02-15T09:18:12.952+00:00", "2025-02-15T04:20:15.855315-05:00", "2025-02-15 02:36:29.106", "20250215T140954.410215Z", "2025-W07-6T13:58:27.694000Z",
    "02/15/2025 12:19:03.429000 AM", "02/15/2025 12:48:11.112000 PM", "Sat, 15 Feb 2025 11:08:42 +0530", "1739605033.316016", "1739604376183", "1739706790000000",
    "1739701693228515342", " 2025-02-16t15:43:58.919502z\t", "2025-02-16 12:03:27.023079 AEDT", "2025-02-15T16:40:02.934000+01:00[Europe/Berlin]", "2025-02-19T00:58:03.327219+08",
    "2025-02-15T16:10:20,049000", "2025-13-01 00:00:00", "0000-00-00T00:00:00Z", "2025-02-30T10:00:00Z", "2024-02-29T10:00:00Z", "2025-02-15T25:00:00Z", "null", "n/a", "--", "", None, "17",
    "2025-03-30 02:30:00", "2025-10-26 02:30:00", "2025-10-26 02:59:59.999999", "2025-10-26 03:00:00", "2025-03-09 02:30:00", "2025-11-02 01:30:00", "2025-04-06 02:30:00", "2025-10-05 02:15:00",
]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata", None])
def test_instants_agree_with_zoneinfo(spark, zone):
    received = [dt.datetime(2025, 10, 26, 0, 45, tzinfo=dt.UTC), dt.datetime(2025, 12, 1, tzinfo=dt.UTC), dt.datetime(2025, 1, 1, tzinfo=dt.UTC), None]
    rows = [(i, t, zone, r) for i, (t, r) in enumerate(itertools.product(TEXTS, received))]
    frame = spark.createDataFrame(rows, "i int, timestamp string, zone string, received timestamp")
    got = {r["i"]: r["utc_us"] for r in with_instant(frame, "timestamp", "zone", "received").collect()}
    assert got == {i: brute.instant(t, z, r) for i, t, z, r in rows}


def test_instant_policies_and_clashing_columns(spark):
    frame = spark.createDataFrame([("2025-10-26 02:30:00", "Europe/Berlin", 7), ("2025-03-30 02:30:00", "Europe/Berlin", 8)], "timestamp string, zone string, utc_us int")
    hour = 3_600_000_000
    early, skipped = (brute.instant(t, "Europe/Berlin", None) for t in ("2025-10-26 02:30:00", "2025-03-30 02:30:00"))
    at = lambda **k: [r["utc_us"] for r in with_instant(frame, "timestamp", "zone", **k).collect()]
    assert at(ambiguous="later") == [early + hour, skipped]
    assert at(ambiguous="null", nonexistent="offset_after") == [None, skipped - hour]
    assert at(ambiguous="earlier", nonexistent="null") == [early, None]
    with pytest.raises(ValueError):
        with_instant(frame, ambiguous="guess")
    odd = spark.createDataFrame([("2025-10-26 02:30:00", "Nowhere/Land"), ("2025-10-26 24:00:00Z", None), ("2025-060T10:00:00Z", None)], "timestamp string, zone string")
    assert [r["utc_us"] for r in with_instant(odd, "timestamp", "zone").collect()] == [brute.instant(t, None, None) for t in ("2025-10-26 02:30:00", "2025-10-27T00:00:00Z", "2025-03-01T10:00:00Z")]


def test_every_listed_zone_is_known_to_the_jvm(spark):
    zones = sorted(known_zones(spark))
    frame = spark.createDataFrame([("2025-07-01 00:00:00", z) for z in zones], "timestamp string, zone string")
    assert with_instant(frame, "timestamp", "zone").where(F.col("utc_us").isNull()).count() == 0


def test_hosts_and_ids(spark):
    metas = ['{"host":"a"}', '{"host":"","hostname":"b"}', '{"host":5}', '{"host":null,"hostname":"c"}', "[]", "null", "{}", None, "", "{bad", '{"hostname": "d", "host": ["x"]}']
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "i int, m string")
    assert {r["i"]: r["h"] for r in frame.select("i", host_of(F.col("m")).alias("h")).collect()} == {i: brute.host(m) for i, m in enumerate(metas)}
    u = "c433d5d7-f1ca-4888-a54a-da0f01232539"
    ids = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, f" {u}\t", u.replace("-", ""), None, "", "  ", "msg-7", " msg-7 ", "c433d5d7"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string")
    assert {r["i"]: r["k"] for r in frame.select("i", canonical_id(F.col("x")).alias("k")).collect()} == {i: brute.same_id(x) for i, x in enumerate(ids)}


def test_surplus_rows(spark):
    rng = random.Random(3)
    base = ["c433d5d7-f1ca-4888-a54a-da0f0123%04x" % i for i in range(30)]
    rows = []
    for n in range(300):
        i = base[rng.randrange(30)] if rng.random() < 0.66 else base[0]  # one id holds a third
        i = rng.choice([i, i.upper(), "{" + i + "}", None, " "])
        rows.append((n, i, rng.choice([T0 + dt.timedelta(seconds=rng.randrange(9)), None]), "x"))
    frame = spark.createDataFrame(rows, "row_no long, id string, received_at timestamp, key string")
    frame = frame.withColumn("batch_id", F.when(F.col("row_no") % 7 > 0, F.concat(F.lit("b"), (F.col("row_no") % 11).cast("string"))))
    want = brute.surplus([r[:3] for r in rows])
    assert {r[0] for r in dedup.surplus_rows(frame).collect()} == want
    once = dedup.delivered_once(frame)
    assert once.columns == frame.columns and {r["row_no"] for r in once.collect()} == {r[0] for r in rows} - want
    assert dedup.surplus_rows(frame.limit(0)).count() == 0


def test_store_is_idempotent_and_merges_runs(spark):
    rows = [(n, f"{n % 7:032x}", T0 - dt.timedelta(seconds=n)) for n in range(40)]
    frame = spark.createDataFrame(rows, "row_no long, id string, received_at timestamp")
    store = dedup.DeliveryStore(spark, buckets=3)
    for part in ("row_no < 20", "row_no >= 20", "row_no >= 20"):  # a batch written again changes nothing
        store.upsert(dedup.deliveries(frame.where(part)))
    merged = store.merged()
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    whole = dedup.survivors(dedup.deliveries(frame), "key")
    assert sorted(map(tuple, store.compact().collect())) == sorted(map(tuple, whole.collect()))
    assert not spark.catalog.tableExists(store.table)
    with pytest.raises(ValueError):
        dedup.DeliveryStore(spark).compact()


@pytest.mark.parametrize(("gap", "spread"), [(1_800_000_000, 40_000_000_000), (10, 300), (1_500_000, 90_000_000), (0, 20)])
def test_sessions(spark, gap, spread):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "a", "b", None, "hot"]), rng.choice([None, rng.randrange(-spread, spread)])) for _ in range(600)]
    rows += [("edge", 0), ("edge", gap), ("edge", 2 * gap + 1), ("one", 5)]
    frame = spark.createDataFrame(rows, "entity string, utc_us long").withColumn("slot", F.lit(1))
    got = {(r["entity"], r["start_us"], r["end_us"], r["n_events"]) for r in sessions.sessions(frame, gap).collect()}
    assert got == set(brute.sessions(rows, gap))
    weighed = sessions.sessions(frame.withColumn("weight", F.lit(2)), gap).agg(F.sum("n_events")).first()[0]
    assert weighed == 2 * sum(e is not None and t is not None for e, t in rows)
    assert sessions.sessions(frame.limit(0), gap).count() == 0


def test_closing():
    for _ in range(50):
        rng = np.random.default_rng(_)
        at = np.unique(rng.integers(0, 500, 20))
        reach = int(rng.integers(1, 40))
        starts, ends = sessions.runs_of(at, reach)
        cut = np.flatnonzero(np.diff(at) > reach)
        assert starts.tolist() == at[np.r_[0, cut + 1]].tolist() and ends.tolist() == at[np.r_[cut, len(at) - 1]].tolist()


def test_feature_table(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["h1", "h1", "h2", None]), rng.choice(["x", "y", "z", None]), rng.choice(["info", "HIGH", "odd", None]), rng.choice([None, rng.randrange(1000)])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "entity string, kind_type string, severity string, utc_us long")
    cells = {(r["entity"], r["kind_type"]): (r["n_events"], r["severity_total"], r["last_us"]) for r in feature_table.sparse_cells(frame).collect()}
    rank = {"INFO": 1, "HIGH": 3}
    for key in {r[:2] for r in rows if r[0] and r[1]}:
        own = [r for r in rows if r[:2] == key]
        assert cells[key] == (len(own), sum(rank.get((r[2] or "").upper(), 0) for r in own), max((r[3] for r in own if r[3] is not None), default=None))
    assert len(cells) == len({r[:2] for r in rows if r[0] and r[1]})
    merged = feature_table.merge_cells(feature_table.sparse_cells(frame.limit(100)), feature_table.sparse_cells(frame.subtract(frame.limit(0)).limit(0)))
    assert merged.count() > 0
    wide, index = feature_table.feature_table(frame)
    names = {r["kind_type"]: r["type_idx"] for r in index.collect()}
    for r in wide.collect():
        for kind, i in names.items():
            assert (r[f"n_{i}"], r[f"sev_{i}"], r[f"last_us_{i}"]) == cells.get((r["entity"], kind), (0, 0, None))
    back = feature_table.cells_of(feature_table.sparse_vectors(feature_table.sparse_cells(frame), index), index)
    assert {(r["entity"], r["kind_type"]): (r["n_events"], r["severity_total"], r["last_us"]) for r in back.collect()} == cells
    empty, _ = feature_table.feature_table(frame.limit(0))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        feature_table.feature_table(frame, max_types=2)


def _random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind >= 6:
        return {rng.choice("abcd"): _random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 5:
        return [_random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, 3, 2.5, True, rng.choice(["t", '{"q": {"r": 1}}', "[1, {}]", "{broken", "[1"])][kind]


def test_nested_nodes(spark):
    rng = random.Random(11)
    texts = [json.dumps(_random_json(rng)) for _ in range(300)] + [None, "", "{bad", "[1]", "7", "{}", '{"a":' * 60 + "1" + "}" * 60, "[" * 100_000]
    frame = spark.createDataFrame([(f"w{i}", i % 3, t, t) for i, t in enumerate(texts)], "window_id string, event_pos int, kind string, metadata string").withColumn("shape", F.lit(0))
    table = nested.node_table(frame, ["window_id", "event_pos"], [("kind", False), ("metadata", True)], include_top=False)
    got = sorted((r["window_id"], r["event_pos"], r["parent_path"], r["node_path"]) for r in table.collect())
    want = sorted(x for i, t in enumerate(texts[:-1]) for root in ("kind", "metadata") for x in brute.nodes(f"w{i}", i % 3, root, t))
    assert got == want


def test_shapes_and_typed_tables(spark):
    docs = ['{"b": 1, "a": {"x": "s", "y": 2.5}}', '{"a": {"y": 1.5, "x": "t"}, "b": 7}', '{"a": {"x": 1}, "l": [{"k": true}, {"k": false}, null]}']
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "row_no long, kind string")
    nodes = nested.node_table(frame, ["row_no"], [("kind", False)]).cache()
    shapes = {r["shape"]: (r["shape_id"], r["n_nodes"]) for r in nested.shape_catalog(nodes).collect()}
    assert sum(n for _, n in shapes.values()) == 8 and len(shapes) == 5
    shape = next(s for s in shapes if s == '"x":s,"y":f')
    rows = nested.variant_table(nodes, shapes[shape][0], shape).orderBy("row_no").collect()
    assert [(r["row_no"], r["parent_path"], r["node_path"], r["value"]["x"], r["value"]["y"]) for r in rows] == [(0, "kind", "kind.a", "s", 2.5), (1, "kind", "kind.a", "t", 1.5)]
    assert nested.parse_shape('"a,b":[s|n],"c":i') == [("a,b", "[s|n]"), ("c", "i")]
    windows = spark.createDataFrame([("w", None), ("v", [])], "window_id string, events array<struct<kind:string,metadata:string>>")
    assert nested.window_nodes(windows).count() == 0


def _lines(files):
    return [(i, feed, seq, None, 1, payload if isinstance(payload, str) else json.dumps(payload)) for i, (feed, seq, payload) in enumerate(files)]


_LANDED = "line_id long, feed string, file_seq int, landed_at timestamp, line_no int, payload string"


def test_schema_changes(spark):
    files = [
        ("f", 1, {"a": 1, "user_name": "x", "o": {"p": 1.5, "q": None}, "feature_schema_hash": "h1", "gone": [1]}),
        ("f", 3, {"a": "1", "userName": "y", "o": {"p": 1.5, "q": 2}, "feature_schema_hash": "h2", "fresh": True}),
        ("f", 3, {"a": "1", "userName": None, "o": {"p": 1.5}}), ("g", 1, {"z": 1}), ("f", 2 + 5, {"a": "k", "userName": "y", "o": {}, "feature_schema_hash": None}),
    ]
    frame = spark.createDataFrame(_lines(files) + _lines(files)[:2], _LANDED)
    got = {tuple(r) for r in drift.changes(frame).collect()}
    assert got == brute.schema_changes([(f, s, json.dumps(p)) for f, s, p in files])
    broken = spark.createDataFrame(_lines([("f", 1, {"a": 1}), ("f", 2, "{bad"), ("f", 3, "[]"), (None, 1, {"a": 1})]), _LANDED)
    assert {tuple(r) for r in drift.changes(broken).collect()} == {("f", 2, "removed", "a", "")}
    assert drift.changes(frame.limit(0)).count() == 0


def test_several_renames_at_once(spark):
    frame = spark.createDataFrame(_lines([("f", 1, {"user_name": "u", "host_addr": "a"}), ("f", 2, {"hostAddr": "a", "userName": "u", "other": "zz"})]), _LANDED)
    got = {tuple(r)[2:] for r in drift.changes(frame).collect()}
    assert got == {("renamed", "user_name", "userName"), ("renamed", "host_addr", "hostAddr"), ("added", "other", "")}


def test_assignment_is_optimal():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        w = rng.random((n, m))
        pairs = drift.assign(w)
        small, big = min(n, m), max(n, m)
        best = max(sum((w[i, j] if n <= m else w[j, i]) for i, j in enumerate(p)) for p in itertools.permutations(range(big), small))
        assert len(pairs) == small and abs(sum(w[i, j] for i, j in pairs) - best) < 1e-9


def test_new_field_under_a_renamed_ones_old_name(spark):
    files = [("events.x", 1, {"a": 1}), ("events.x", 2, {"a_value": 1}), ("events.x", 3, {"a_value": 1, "a": 2}), ("events.x", 4, {"a_value": 3, "a": 4})]
    rows = {r["line_id"]: r["fields"] for r in drift.unified_lines(spark.createDataFrame(_lines(files), _LANDED)).collect()}
    assert rows == {0: {"a": "1"}, 1: {"a": "1"}, 2: {"a": "1", "a@3": "2"}, 3: {"a": "3", "a@3": "4"}}


def _names(*files):
    rows = [("f", i + 1, sorted(paths), list(renames), list(renames.values())) for i, (paths, renames) in enumerate(files)]
    out = drift._chain(("f",), pd.DataFrame(rows, columns=["feed", "file_seq", "paths", "renamed_from", "renamed_to"]))
    return [dict(zip(g["field_path"], g["canonical_path"], strict=True)) for _, g in out.groupby("file_seq")]


def test_absent_fields_keep_their_names():
    got = _names(("ax", {}), ("bx", {"a": "b"}), ("x", {}), ("bx", {}), ("abx", {}))
    assert got == [{"a": "a", "x": "x"}, {"b": "a", "x": "x"}, {"x": "x"}, {"b": "a", "x": "x"}, {"a": "a@5", "b": "a", "x": "x"}]
    # back under its first name, then a stranger under the name it had in between
    assert _names(("ax", {}), ("bx", {"a": "b"}), ("x", {}), ("ax", {}), ("abx", {}))[3:] == [{"a": "a", "x": "x"}, {"a": "a", "b": "b", "x": "x"}]
    # a rename to the path of an absent field goes before the memory of that path
    assert _names(("ac", {}), ("c", {}), ("a", {"c": "a"}))[2] == {"a": "c"}
    rng = np.random.default_rng(3)
    files, before = [], set()
    for _ in range(300):
        paths = {p for p in "abcdefg" if rng.random() < 0.6} or {"a"}
        gone, came = sorted(before - paths), sorted(paths - before)
        files.append((paths, dict(list(zip(gone, came, strict=False))[: int(rng.integers(0, 3))])))
        before = paths
    assert all(len(set(names.values())) == len(names) for names in _names(*files))


def test_unified_tables(spark):
    files = [("findings.x", 1, {"campaign_id": "c", "graph_nodes": 4, "drift": {"m": 1}}), ("findings.x", 2, {"campaign_id": "d", "graphNodes": 5, "extra": "e"}), ("findings.x", 3, {"campaign_id": "e", "GraphNodes": "many"})]
    unified = drift.unified_lines(spark.createDataFrame(_lines(files), _LANDED))
    rows = {r["line_id"]: r for r in drift.typed_table(unified, "finding", drift.FINDING_COLUMNS).collect()}
    assert [rows[i]["graph_nodes"] for i in range(3)] == [4, 5, None]
    assert rows[1]["rest"] == {"extra": "e"} and rows[0]["rest"] == {"drift.m": "1"}


def test_deep_json_and_variants(spark, tmp_path):
    deep = '{"a":' * 20_000 + "1" + "}" * 20_000
    value, depth = nested.decode(deep), 0
    while isinstance(value, dict):
        value, depth = value["a"], depth + 1
    assert depth == 20_000
    assert [nested.decode(t) for t in ('{"a": NaN}', "[Infinity]", "{bad", "", None)] == [None] * 5
    for text in ('{"a": [1, {"b": null}], "c": "x\\u00e9\\n"}', '[]', '{"a": {}, "b": [[], [true, -1.5e3]]}', "7"):
        assert nested._decode_deep(text) == json.loads(text)
    for text in ("[1,]", '{"a" 1}', "[}", "{} {}", '{"a":}', "[01]", "]"):
        with pytest.raises(ValueError):
            nested._decode_deep(text)
    rows = [(i, json.dumps({"type": "t", "n": i, "o": {"x": "y"}} if i % 3 else {"type": "u", "f": 0.5})) for i in range(30)]
    nodes = nested.node_table(spark.createDataFrame(rows, "row_no long, kind string"), ["row_no"], [("kind", False)])
    nested.write_variants(nodes, str(tmp_path / "variants"))
    shapes = nested.shape_catalog(nodes).collect()
    tables = {r["shape"]: nested.read_variant(spark, str(tmp_path / "variants"), r["shape_id"], r["shape"]) for r in shapes}
    assert sum(t.count() for t in tables.values()) == 50 and len(tables) == 3
    held = next(t for s, t in tables.items() if '"n"' in s).select("row_no", "value.n").collect()
    assert len(held) == 20 and all(r["n"] == r["row_no"] for r in held)


def test_variants_are_written_typed(spark, tmp_path):
    deep = "[" * 3_000 + "1" + "]" * 3_000
    doc = {
        "": "e", "a`b.c": 1, "x": 1, "X": 2.5, "ok": True, "none": None, "big": 10**20, "tags": ["p", None, "q"], "ports": [22, 2**62], "far": [10**19, 2**70], "shares": [0.5, None],
        "marks": [False], "empty": [], "nulls": [None, None], "mixed": [1, "s", {"k": [7]}, [2.5]], "rows": [{"k": [7]}, None, {"k": [8]}], "odd": "\ud800!", "text": '{"l": [1, 2]}', "o": {},
    }
    rows = [(0, json.dumps(doc)[:-1] + f', "deep": {deep}}}'), (1, json.dumps({"k": [9], "\ud800": {}})), (2, None)]
    nodes = nested.node_table(spark.createDataFrame(rows, "row_no long, metadata string"), ["row_no"], [("metadata", True)])
    path = str(tmp_path / "typed")
    routed = nested.write_variants(nodes, path)
    assert routed.schema["fields"].dataType.simpleString() == nested.FIELDS_DDL == spark.read.parquet(path).schema["fields"].dataType.simpleString()
    tables = {r["shape"]: nested.read_variant(spark, path, r["shape_id"], r["shape"]) for r in nested.shape_catalog(routed).collect()}
    assert all("from_json" not in t._jdf.queryExecution().toString() for t in tables.values())
    held = {r["node_path"]: dict(zip(r["value"].__fields__, r["value"], strict=True)) if r["value"] else {} for t in tables.values() for r in t.where("row_no = 0").collect()}
    lists = {f"metadata.{at}": {"k": [n]} for at, n in (("mixed[2]", 7), ("rows[0]", 7), ("rows[2]", 8))}
    want = {k: v for k, v in doc.items() if k not in ("rows", "text", "o")} | {
        "big": str(10**20), "far": [str(10**19), str(2**70)], "nulls": "[null,null]", "mixed": '[1,"s",null,[2.5]]', "odd": "\ufffd!", "deep": deep,
    }
    assert held == {"metadata": want, "metadata.text": {"l": [1, 2]}, "metadata.o": {}} | lists
    assert [type(held["metadata"][k]) for k in ("x", "X", "ok", "ports", "marks")] == [int, float, bool, list, list]
    assert {r["node_path"] for r in routed.where("row_no = 1").collect()} == {"metadata", "metadata.\ufffd"}


def test_found_objects_come_from_their_variants(spark, tmp_path):
    kinds = [None, "[1]", '{"type": "t", "o": {"l": [{"x": 1}, 2, {"y": {}}]}}', '{"type": "t"}']
    windows = spark.createDataFrame([("w", [(k, '{"t": "[{}]"}') for k in kinds]), ("v", []), ("u", None)], "window_id string, events array<struct<kind:string,metadata:string>>")
    windows.write.parquet(str(tmp_path / "labeled_windows.parquet"))
    found = pipeline.p5_found(spark, str(tmp_path))
    assert found.inputFiles() and all("-variants-" in f for f in found.inputFiles())
    below = [("kind", "kind.o"), ("kind.o", "kind.o.l[0]"), ("kind.o", "kind.o.l[2]"), ("kind.o.l[2]", "kind.o.l[2].y")]
    assert sorted(map(tuple, found.collect())) == sorted([("w", 2, *b) for b in below] + [("w", i, "metadata", "metadata.t[0]") for i in range(4)])
    windows.where("window_id <> 'w'").write.parquet(str(tmp_path / "none" / "labeled_windows.parquet"))
    assert pipeline.p5_found(spark, str(tmp_path / "none")).count() == 0
