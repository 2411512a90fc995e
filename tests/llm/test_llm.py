"""The operators on records and texts against plain versions, and their defined edge cases."""

import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing, overlap, packing, spans, tokens

EVENTS = "window_id string, label int, split string, source string, events array<struct<id:string,timestamp:string,source:string,severity:string,kind:string,metadata:string>>"


def _event(n, rng=None):
    kind = {"type": "t", "n": n, "o": {"a": 1, "b": [1, 2]}}
    text = json.dumps(dict(reversed(kind.items())), indent=1) if rng and rng.random() < 0.5 else json.dumps(kind)
    return (str(rng.random() if rng else n), "x", "s", rng.choice(["high", "HIGH"]) if rng else "HIGH", text, '{"host": "h"}')


def _windows(rng, n=160):
    base = [[rng.randrange(60) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for i in range(n):
        ids = list(rng.choice(base)) if rng.random() < 0.67 else list(base[0])
        if rng.random() < 0.5:
            ids[rng.randrange(len(ids))] = rng.randrange(60)
        ids += [ids[0]] * rng.randrange(2) + [99] * (rng.random() < 0.9)  # 99 is in almost every window
        rows.append((f"w{i:04d}", rng.choice([0, 1, None]), rng.choice(["train", "train", "test", "validation", None]), "q", [_event(k, rng) for k in ids]))
    return rows + [("none", 1, "test", "q", []), ("null", 1, "train", "q", None), ("odd", 0, "train", "q", [None]), ("odd2", 0, "test", "q", [None])]


def _sets(rows):
    out = {}
    for w, _, split, _, events in rows:
        if split and events:
            out[w] = (split, frozenset(None if e is None else (e[2], e[3].upper(), json.dumps(json.loads(e[4]), sort_keys=True), brute.host(e[5])) for e in events))
    return out


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_cross_split_pairs(spark, least):
    rows = _windows(random.Random(1))
    frame = spark.createDataFrame(rows, EVENTS).withColumn("contents", F.lit(1))
    sets = _sets(rows)
    want = set()
    for a, (sa, x) in sets.items():
        for b, (sb, y) in sets.items():
            if sa == "train" and sb != "train" and len(x & y) >= least * len(x | y) - 1e-9:
                want.add((a, b))
    got = [(r["train_id"], r["other_id"]) for r in overlap.cross_split_pairs(frame, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap.overlap_report(frame, least)
    labels = {r[0]: r[1] for r in rows}
    assert sum(r["n_overlapping"] for r in report.collect()) == len({b for _, b in want})
    differ = {b for a, b in want if None not in (labels[a], labels[b]) and labels[a] != labels[b]}
    assert sum(r["n_disagreeing"] for r in report.collect()) == len(differ)
    assert overlap.cross_split_pairs(frame.limit(0)).count() == 0


def test_token_counts(spark):
    if not Path(tokens.TOKENIZER).exists():
        pytest.skip("no tokenizer files here")
    texts = [None, "", " ", "a line\nand another", "naïve 日本語 text ​ x", "word " * 30_000, "<|endoftext|>"]
    frame = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame).collect()}
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert b"".join(tokens.encoder(tokens.TOKENIZER).decode_tokens_bytes(encode(texts[4]))).decode() == texts[4]


_COUNTS = "doc_id long, source string, n_tokens long"


@pytest.mark.parametrize("shard_items", [8192, 40])
def test_packing(spark, shard_items):
    rng = random.Random(2)
    rows = [((1 << 60) + i, rng.choice(["a", "a", "b", None]), rng.choice([0, 1, 7, 20, 63, 64, 65, 200, rng.randrange(1, 65)])) for i in range(500)]
    packed = packing.pack_counts(spark.createDataFrame(rows, _COUNTS), 64, shard_items).collect()
    got = defaultdict(list)
    for r in packed:
        got[r["doc_id"]].append(r)
    fill = Counter()
    for doc, source, n in rows:
        parts = sorted(got.pop(doc), key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in parts] == list(range(max(1, -(-n // 64)))) and sum(p["n_tokens"] for p in parts) == n
        assert all(p["source"] == source for p in parts) and all(p["n_tokens"] == 64 for p in parts[:-1])
        for p in parts:
            assert (p["container_id"] is None) == (p["n_tokens"] == 0)
            fill[p["container_id"]] += p["n_tokens"]
    assert not got
    del fill[None]
    assert max(fill.values()) <= 64 and len(fill) <= 1.03 * -(-sum(n for _, _, n in rows) // 64) + 1
    assert packing.pack_counts(spark.createDataFrame([], _COUNTS), 64).count() == 0


def test_windows_follow_the_shares():
    rng = random.Random(4)
    items = [(rng.randrange(1, 30), s, i) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 100)]
    total = {s: sum(x[0] for x in items if x[1] == s) for s in "abc"}
    shares = {s: t / sum(total.values()) for s, t in total.items()}
    owed = {}
    windows = packing.fill_windows(items, shares, owed, 200)
    assert sorted(x[2] for w in windows for x in w) == list(range(1000))
    half = windows[: len(windows) // 2]
    for s in "abc":  # from the start on, not only in the end
        assert abs(sum(x[0] for w in half for x in w if x[1] == s) / sum(x[0] for w in half for x in w) - shares[s]) < 0.05
    assert sum(sum(x[0] for x in w) for w in windows[:-3]) / (200 * (len(windows) - 3)) > 0.98


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 5):
            assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.quotas(np.array([0.5, 0.3, 0.2]), np.array([1000, 10, 1000]), 100).tolist() == [64, 10, 26]
    assert mixing.quotas(np.array([0.5, 0.5]), np.array([3, 4]), 100).tolist() == [3, 4]
    assert mixing.quotas(np.array([1 / 3] * 3), np.array([9, 9, 9]), 10).sum() == 10
    shards = [mixing.shard_counts(np.array([500, 300, 7]), 64, k, 1) for k in range(13)]
    drawn = [c for c, _ in shards]
    assert np.sum(drawn, 0).tolist() == [500, 300, 7] and all(d.sum() == 64 for d in drawn[:-1])
    assert all((s == np.sum(drawn[:k], 0)).all() for k, (_, s) in enumerate(shards))


def test_folded_contents(spark):
    event = lambda source, kind, sev="high": ("1", "x", source, sev, kind, '{"host": "H"}')
    rows = [
        ("a", 0, "train", "q", [event("Net  Zeek", '{"type": "Beacon!", "n": 1}')]), ("b", 1, "test", "q", [event("net zeek.", '{"n": 1, "type": "beacon"}', "HIGH")]),
        ("c", 1, "test", "q", [event("netzeek", '{"n": 1, "type": "beacon"}')]),
    ]
    frame = spark.createDataFrame(rows, EVENTS)
    assert overlap.cross_split_pairs(frame).count() == 0
    assert [(r["train_id"], r["other_id"]) for r in overlap.cross_split_pairs(frame, fold=True).collect()] == [("a", "b")]
    found = overlap.overlapping_windows(frame, fold=True).collect()
    assert [(r["window_id"], r["exact"], r["train_zeros"], r["train_ones"]) for r in found] == [("b", True, 1, 0)]


def test_packing_to_targets(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(800)]
    targets = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "source string, target_share double")
    packed = packing.pack_counts(spark.createDataFrame(rows, _COUNTS), 100, targets=targets)
    mixed = packing.container_mixture(packed).where("source = 'a'").orderBy("container_id").collect()
    # a's 400 items fill 50 windows to four fifths; b has the rest alone
    assert sorted(round(r["share"], 1) for r in mixed) == [0.8] * 50
    awkward = spark.createDataFrame([(i, "a", 60) for i in range(300)], _COUNTS)
    assert packing.pack_counts(awkward, 100, 50, carry_items=None).select("container_id").distinct().count() == 300


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]) if i % 3 else "a", rng.choice([0, 5, 130, rng.randrange(900)])) for i in range(900)] + [(900 + i, "tiny", 40) for i in range(10)]
    counts = spark.createDataFrame(rows, _COUNTS)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 4), ("tiny", 0.2, 3), ("absent", 0.1, 2), ("c", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_counts(counts, targets, block=32, shard_slots=100, seed=3).collect()
    total = sum(n for _, _, n in rows)
    assert abs(sum(r["n_tokens"] for r in mixed) - total / 2) <= 32
    sizes, used = {i: n for i, _, n in rows}, defaultdict(set)
    slots = Counter()
    for r in mixed:
        assert r["source"] in ("a", "b", "tiny") and 0 <= r["token_start"] and r["token_start"] + r["n_tokens"] <= sizes[r["doc_id"]]
        slots[r["shard"], r["slot"]] += r["n_tokens"]
        for t in range(r["token_start"], r["token_start"] + r["n_tokens"]):
            assert (t, r["use_no"]) not in used[r["doc_id"]]
            used[r["doc_id"]].add((t, r["use_no"]))
    limit = {"a": 1, "b": 4, "tiny": 3}
    assert set(slots.values()) == {32} and all(r["use_no"] < limit[r["source"]] for r in mixed)
    shares = {r["source"]: r for r in mixing.mix_shares(mixing.mix_counts(counts, targets, block=32, shard_slots=100, seed=3), targets).collect()}
    assert shares["tiny"]["mix_tokens"] == 400 // 32 * 32 * 3 and shares["absent"]["mix_tokens"] == 0
    assert abs(shares["a"]["actual_share"] / shares["b"]["actual_share"] - 0.75) < 0.02
    assert mixing.mix_counts(counts.limit(0), targets).count() == 0


def _documents(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60)[:160], prose(80)[:159], prose(200), "日本語😀" * 60, "-" * 400, "ab" * 200]
    texts = [None, "", "short", shared[0], shared[0], prose(40)[:160]]
    for _ in range(120):
        parts = [prose(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 4))]
        for s in rng.sample(shared, rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), s)
        texts.append("\n".join(parts))
    # passages of whole sentences in several texts, cut at sentences, inside them, or continued differently
    line = lambda: prose(rng.randrange(4, 14)) + rng.choice([". ", "! ", ".\n", "? "])
    passages = ["".join(line() for _ in range(rng.randrange(3, 12))) for _ in range(4)]
    for i in range(60):
        p = passages[0] if i % 3 == 0 else rng.choice(passages)
        cut = sorted(rng.sample(range(len(p)), 2)) if rng.random() < 0.5 else (0, len(p))
        texts.append("".join(line() for _ in range(rng.randrange(4))) + p[cut[0] : cut[1]] + "".join(line() for _ in range(rng.randrange(4))))
    return texts + texts[10:16]


def _runs(texts, span):
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t or "") - span + 1):
            holders[t[k : k + span]].add(i)
    return holders


@pytest.mark.parametrize("by_join", [False, True])
def test_shared_spans(spark, monkeypatch, by_join):
    monkeypatch.setattr(spans, "PART", 600)  # texts in several parts
    spans._powers.cache_clear()
    texts = _documents(random.Random(8))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    holders = _runs(texts, 160)
    want = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    bits = 0 if by_join else spans.FILTER_BITS
    got = [(r[0], r[1]) for r in spans.shared_pairs(frame, filter_bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r[0], r[1]) for r in spans.sentence_pairs(frame).collect()} <= want
    shares = {r["doc_id"]: (r["n_chars"], r["n_shared"]) for r in spans.shared_share(frame, filter_bits=bits).collect()}
    for i, t in enumerate(texts):
        covered = {k + j for k in range(len(t or "") - 159) if len(holders[t[k : k + 160]]) > 1 for j in range(160)}
        assert shares[i] == (len(t or ""), len(covered))
    assert spans.shared_pairs(frame.limit(0)).count() == 0


def test_running_min_and_hashes():
    values = np.random.default_rng(0).integers(0, 1 << 60, 300).astype(np.uint64)
    for width in (1, 2, 7, 97):
        assert spans.running_min(values, width).tolist() == [int(values[i : i + width].min()) for i in range(300 - width + 1)]
    hashed = spans.Hashed(np.tile(values[:50], 4), spans._ODD[0])
    hashes = hashed.every(20)
    at = np.array([0, 50, 3])
    assert len(set(hashed.between(at, at + 31)[:2].tolist())) == 1 and len(set(hashed.between(at, at + 31).tolist())) == 2
    assert hashes[:31].tolist() == hashes[50:81].tolist() and len(set(hashes[:50].tolist())) == 50


def test_queries_are_registered():
    import __spark_entry__

    assert {"p1_found", "p8_packing", "p9_mix", "p10_found"} <= __spark_entry__.queries().keys()
