"""Command line: demo, score, stream, export, validate, benchmark and the ablations.

Only results go to stdout; logs go to stderr as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F


def _events(spark, path: str):
    from tidewatch.sources.readers import read_events

    return read_events(spark, path).withColumn("window_id", F.lit("w0"))


def _windows(spark, path: str) -> list[tuple[list[dict], int]]:
    """Labeled windows by (start, window_id), as training input; their number is bounded there."""
    from tidewatch.model.train import MAX_WINDOWS
    from tidewatch.sources.readers import envelopes, read_labeled_windows

    rows = envelopes(read_labeled_windows(spark, path).withColumnRenamed("error", "window_error"))
    bad = rows.where(F.col("window_error").isNotNull() | F.col("error").isNotNull()).orderBy("file", "line_no").first()
    if bad:
        raise SystemExit(f"{bad['file']}:{bad['line_no']}: {bad['window_error'] or bad['error']}")
    found: dict[str, tuple[list[dict], int]] = {}
    if rows.select("window_id").distinct().limit(MAX_WINDOWS + 1).count() > MAX_WINDOWS:
        raise SystemExit(f"more than {MAX_WINDOWS} windows")
    for r in rows.select("window_id", "label", "id", "timestamp", "source", "severity", "kind_json", "metadata_json").toLocalIterator():
        event = {"id": r["id"], "timestamp": r["timestamp"], "source": r["source"], "severity": r["severity"], "kind": json.loads(r["kind_json"]), "metadata": json.loads(r["metadata_json"])}
        found.setdefault(r["window_id"], ([], r["label"]))[0].append(event)
    return [found[w] for w in sorted(found, key=lambda w: (min(e["timestamp"] for e in found[w][0]), w))]


def _score(spark, args, model):
    from tidewatch.functions.entities import project
    from tidewatch.operators.score import findings

    out = findings(project(_events(spark, args.events)), model, args.top_k, args.suppress)
    return json.loads(out.drop("window_id").toJSON().first())


def _stream(spark, args, model):
    from tidewatch.streaming.scorer import Stream

    stream, rejected = Stream(), []
    rows = _events(spark, args.events).orderBy("timestamp", "id").withColumn("us", F.unix_micros("timestamp"))
    for r in rows.toLocalIterator():
        event = {"id": r["id"], "source": r["source"], "severity": r["severity"], "kind": json.loads(r["kind_json"]), "metadata": json.loads(r["metadata_json"])}
        if not stream.ingest(model.freeze(), event, r["us"], args.max_nodes):
            rejected.append(r["id"])
    finding = stream.finding(model, args.top_k, args.suppress)
    return finding | {"evictions": [{"entity": n, "last_seen_us": t, "reason": "node_budget"} for n, t in stream.evictions], "rejected": rejected}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    parser.add_argument("--log-level", default="info", choices=["debug", "info", "warning", "error"])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("score", "stream"):
        c = commands.add_parser(name)
        c.add_argument("events")
        c.add_argument("--model", required=True)
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--suppress", action="append", default=[])
        c.add_argument("--registry")
        c.add_argument("--max-nodes", type=int, default=4096)
    for name in ("demo", "ablation"):
        c = commands.add_parser(name)
        for flag, default in (("--samples", 80), ("--epochs", 3), ("--seed", 7)):
            c.add_argument(flag, type=int, default=default)
        c.add_argument("--scenario", default="v0_easy")
        c.add_argument("--data")
        c.add_argument("--output")
    for name in ("time-ablation", "decay-ablation"):
        c = commands.add_parser(name)
        for flag, default in (("--samples", 60), ("--epochs", 2), ("--seed", 7)):
            c.add_argument(flag, type=int, default=default)
    c = commands.add_parser("export")
    c.add_argument("model")
    c.add_argument("out")
    c.add_argument("--version", default="development")
    c = commands.add_parser("validate")
    c.add_argument("data")
    c.add_argument("--model", required=True)
    c.add_argument("--out")
    c.add_argument("--card")
    c.add_argument("--target-fpr", type=float, default=0.01)
    c.add_argument("--holdout", type=float, default=0.5)
    c.add_argument("--data-provenance", default="unspecified")
    c.add_argument("--gate", action="append", default=[], metavar="KEY=VALUE")
    commands.add_parser("benchmark").add_argument("manifest")
    args = parser.parse_args(argv)

    from tidewatch.model import train
    from tidewatch.model.nn import Model
    from tidewatch.operators.campaigns import Registry
    from tidewatch.runtime import local_session
    from tidewatch.sources.sinks import logger

    log = logger(args.log_level)
    log.info("started", extra={"fields": {"command": args.command}})
    status = 0
    if args.command in ("score", "stream"):
        spark, model = local_session(), Model.load(args.model)
        result = (_score if args.command == "score" else _stream)(spark, args, model)
        if args.registry:
            from tidewatch.functions.entities import project

            registry = Registry.load(args.registry)
            nodes = [r[0] for r in project(_events(spark, args.events)).select(F.explode("entities")).distinct().toLocalIterator()]
            result["campaign_id"], result["continues_campaign"], result["windows_observed"] = registry.resolve(nodes, result.get("scored_at") or "")
            registry.save(args.registry)
    elif args.command in ("demo", "ablation"):
        data = train.batch_of(_windows(local_session(), args.data)) if args.data else None
        result, model = train.ablation(args.samples, args.epochs, args.seed, scenario=args.scenario, data=data)
        if args.output:
            model.save(args.output)
    elif args.command == "time-ablation":
        modes = {m: {"time_mode": m} for m in ("global", "per_entity", "time_aware")}
        result = train.mode_ablation(modes, ("v0_easy", "low_and_slow", "timing_only"), args.samples, args.epochs, args.seed)
    elif args.command == "decay-ablation":
        lives = {"none": {}, "3600": {"half_life": 3600.0}, "86400": {"half_life": 86400.0}}
        result = train.mode_ablation(lives, ("distractor", "stale_preamble"), args.samples, args.epochs, args.seed)
    elif args.command == "export":
        model = Model.load(args.model)
        model.version = args.version
        model.save(args.out)
        result = json.loads((Path(args.out) / "manifest.json").read_text())
    elif args.command == "validate":
        gates = {k: float(v) for k, v in (g.split("=", 1) for g in args.gate)}
        model = Model.load(args.model)
        result = train.validate(model, _windows(local_session(), args.data), args.target_fpr, args.holdout, args.data_provenance, gates)
        if args.card:
            Path(args.card).write_text(train.model_card(result))
        if result["verdict"] != "go":
            status = 2
        elif args.out:
            model.save(args.out)
    else:
        result = train.benchmark(json.loads(Path(args.manifest).read_text()))
        status = 0 if result["pass"] else 1
    print(json.dumps(result, indent=2, default=str))
    log.info("finished", extra={"fields": {"command": args.command, "status": status}})
    return status


if __name__ == "__main__":
    sys.exit(main())
