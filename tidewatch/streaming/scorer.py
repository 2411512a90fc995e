"""Incremental scoring: one keyed state per stream, advanced event by event.

The clock, the node budget and the first event belong to the whole stream, so a
stream is one key; many streams run in parallel.  Events of a micro-batch are
taken in (timestamp, id) order; what is older than the clock is rejected to its
own output rows and never enters the state.
"""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch import config
from tidewatch.model.nn import Model, Var
from tidewatch.functions.rules import read_event
from tidewatch.model.window import DELTA, delta, scaled

DEFAULT_NODES = 4096
OUTPUT = "stream_id string, output string, id string, body string"


@dataclass
class Entity:
    state: np.ndarray
    output: np.ndarray
    last: int
    count: int = 0
    evidence: list[str] = field(default_factory=list)


@dataclass
class Stream:
    """Carried state of one stream; times are microseconds."""

    clock: int | None = None
    first: tuple[int, str] | None = None
    entities: dict[str, Entity] = field(default_factory=dict)
    edges: dict[tuple[str, str], int] = field(default_factory=dict)
    relations: dict[str, int] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)
    drift: np.ndarray | None = None
    evictions: list[tuple[str, int]] = field(default_factory=list)

    def ingest(self, model: Model, event: dict, at: int, max_nodes: int) -> bool:
        """Advance by one event; false, and nothing changes, if it is older than the clock."""
        if self.clock is not None and at < self.clock:
            return False
        gap = 0 if self.clock is None else at - self.clock
        self.clock = at
        self.first = min(self.first or (at, event["id"]), (at, event["id"]))
        kind = str(event["kind"].get("type", "unknown"))
        if kind in config.ATTACK:
            self.stages.setdefault(kind, event["id"])
        parts = read_event(event)
        known = [self.entities.get(e) for e in parts.entities]
        gaps = np.array([delta((at - k.last) / 1e6) if k else 0.0 for k in known])
        rows = np.tile(parts.features, (len(known), 1))
        rows[:, DELTA] = delta(gap / 1e6) if model.spec.time_mode == "global" else gaps
        h, s = model.spec.hidden, model.spec.state
        state = Var(np.stack([k.state if k else np.zeros((h, s)) for k in known]))
        output = Var(np.stack([k.output if k else np.zeros(h) for k in known]))
        state, output = model.step(model.project(rows), state, output, np.ones((len(known), 1)), gaps)
        if model.feature_stats:
            edges = np.asarray(model.feature_stats["bin_edges"])
            one = np.stack([np.histogram(c, edges)[0] for c in rows.astype(np.float32).T])
            self.drift = one if self.drift is None else self.drift + one
        for i, name in enumerate(parts.entities):
            entity = known[i] or Entity(state.value[i], output.value[i], at)
            entity.state, entity.output, entity.last, entity.count = state.value[i], output.value[i], at, entity.count + 1
            if event["id"] not in entity.evidence:
                entity.evidence = [*entity.evidence, event["id"]][-config.EVIDENCE_LIMIT :]
            self.entities[name] = entity
        for left, right, name in parts.relations:
            self.edges[min(left, right), max(left, right)] = at
            self.relations[name] = self.relations.get(name, 0) + 1
        if max_nodes and len(self.entities) > max_nodes:
            order = sorted(self.entities, key=lambda e: (self.entities[e].last, e), reverse=True)
            for name in order[max_nodes:]:
                self.evictions.append((name, self.entities.pop(name).last))
            self.edges = {k: v for k, v in self.edges.items() if k[0] in self.entities and k[1] in self.entities}
        return True

    def finding(self, model: Model, top_k: int, rules: list[str]) -> dict:
        """The finding over the carried state."""
        names = list(self.entities)
        index = {n: i for i, n in enumerate(names)}
        weights = np.eye(len(names))
        for (a, b), last in self.edges.items():
            w = 1.0 if model.spec.half_life is None else 0.5 ** ((self.clock - last) / 1e6 / model.spec.half_life)
            weights[index[a], index[b]] = weights[index[b], index[a]] = w
        nodes = model._norm("seq", Var(np.stack([e.output for e in self.entities.values()])))
        top, logits = model.relate(nodes.reshape(1, len(names), model.spec.hidden), np.ones((1, len(names))), scaled(weights)[None])
        hit = [any(n == r or (r.endswith(":") and n.startswith(r)) for r in rules) for n in names]
        order = np.argsort(-np.where(hit, -np.inf, logits.value[0]), kind="stable")[:top_k]
        ranked = [names[i] for i in order if not hit[i]]
        drift = None
        if model.feature_stats and self.drift is not None:
            base = np.asarray(model.feature_stats["histograms"]) + 1e-4
            seen, base = self.drift + 1e-4, base / base.sum(1, keepdims=True)
            seen = seen / seen.sum(1, keepdims=True)
            psi = ((seen - base) * np.log(seen / base)).sum(1)
            drift = {"psi_max": round(float(psi.max()), 6), "psi_mean": round(float(psi.mean()), 6), "flagged_features": [n for n, v in zip(config.FEATURES, psi, strict=True) if v >= config.DRIFT_FLAG]}
        seen_tactics = {config.TACTICS.index(config.ATTACK[k][0]) for k in self.stages}
        ahead = [t for i, t in enumerate(config.TACTICS) if seen_tactics and i > max(seen_tactics)]
        return {
            "campaign_id": f"idr-campaign-{self.first[1][:8]}", "escalation_probability": round(float(model.probability(top.value[0])), 6),
            "raw_escalation_probability": round(float(1 / (1 + np.exp(-top.value[0]))), 6), "calibration": model.calibration(),
            "predicted_next_stage": (ahead[0] if ahead else "kill-chain-complete") if seen_tactics else "unknown",
            "observed_attack_stages": [dict(zip(("tactic", "technique", "technique_name"), config.ATTACK[k], strict=True)) | {"kind_type": k, "first_event_id": i} for k, i in self.stages.items()],
            "related_entities": ranked, "entity_evidence": [], "applied_suppressions": [n for n, x in zip(names, hit, strict=True) if x],
            "evidence_event_ids": list(dict.fromkeys(i for n in ranked for i in self.entities[n].evidence)), "model_version": model.version,
            "graph_nodes": len(names), "graph_relations": self.relations, "engine_version": config.ENGINE_VERSION, "feature_schema_hash": config.schema_hash(),
            "feature_drift": drift, "continues_campaign": False, "windows_observed": 1,
        }


class Scorer(StatefulProcessor):
    """Emits per micro-batch and stream: one finding, the evictions of the batch, and rejected events."""

    def __init__(self, model: Model, max_nodes: int = DEFAULT_NODES, top_k: int = 5, rules: list[str] | None = None):
        if not model.spec.use_sequence:
            raise ValueError("streaming needs a model with the recurrence")
        self.model, self.max_nodes, self.top_k, self.rules = model.freeze(), max_nodes, top_k, rules or []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("stream", "blob binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["timestamp", "id"])
        stream = pickle.loads(self.cell.get()[0]) if self.cell.exists() else Stream()
        stream.evictions, out = [], []
        at = events["timestamp"].dt.as_unit("us").astype("int64")
        for us, e in zip(at, events.itertuples(index=False), strict=True):
            event = {"id": e.id, "source": e.source, "severity": e.severity, "kind": json.loads(e.kind_json), "metadata": json.loads(e.metadata_json or "{}")}
            if not stream.ingest(self.model, event, int(us), self.max_nodes):
                out.append((key[0], "rejected", e.id, json.dumps({"reason": "older than the stream's clock", "timestamp_us": int(us)})))
        out += [(key[0], "eviction", n, json.dumps({"last_seen_us": last, "reason": "node_budget"})) for n, last in stream.evictions]
        if stream.entities:
            found = stream.finding(self.model, self.top_k, self.rules)
            out.append((key[0], "finding", found["campaign_id"], json.dumps(found)))
        self.cell.update((pickle.dumps(stream),))
        yield pd.DataFrame(out, columns=["stream_id", "output", "id", "body"])

    def close(self) -> None:
        pass


def score_stream(events: DataFrame, model: Model, max_nodes: int = DEFAULT_NODES, top_k: int = 5, rules: list[str] | None = None) -> DataFrame:
    """(stream_id, output, id, body): findings, evictions and rejected events of a stream of events.

    ``events``: stream_id, id, timestamp, source, severity, kind_json,
    metadata_json.  State lives in RocksDB; ``max_nodes`` 0 is no bound.
    """
    columns = ["stream_id", "id", "timestamp", "source", "severity", "kind_json", "metadata_json"]
    return events.select(*columns).groupBy("stream_id").transformWithStateInPandas(Scorer(model, max_nodes, top_k, rules), OUTPUT, "append", "none")
