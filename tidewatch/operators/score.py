"""Findings: windows scored by the model.

The JVM builds histories and the normalised adjacency of all windows; one
grouped map per window runs the model, histories by blocks of nodes and the
adjacency by its pairs; ranking, evidence, stages and drift are relational again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.model.nn import N_FEATURES, Model, Pairs, as_var
from tidewatch.operators import attack, campaigns, graph, psi, ranking
from tidewatch.runtime import materialise

#: Nodes whose histories are unfolded into one dense array at a time; bounds memory, not what is scored.
NODE_BLOCK = 512

_OUT = "window_id string, entity string, node_index int, logit double, graph_logit double, attribution array<double>"


def _unfolded(f: pd.Series, gaps: pd.Series, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x [n, steps, f], mask and gaps [n, steps] of histories, each at the end of its row."""
    n = len(f)
    x, mask, since = np.zeros((n, steps, N_FEATURES)), np.zeros((n, steps)), np.zeros((n, steps))
    for i, (rows, g) in enumerate(zip(f, gaps, strict=True)):
        k = len(g)
        x[i, steps - k :], since[i, steps - k :], mask[i, steps - k :] = np.stack(list(rows)), g, 1.0
    return x, mask, since


def _scorer(model: Model, steps: int, explain: bool):
    model = model.freeze()

    def run(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node_index").reset_index(drop=True)
        n = len(nodes)
        if not n:
            return pd.DataFrame(columns=["window_id", "entity", "node_index", "logit", "graph_logit", "attribution"])
        states = np.zeros((n, model.spec.hidden))
        hidden: dict[int, dict[int, np.ndarray]] = {}  # feature -> block -> states without it, where the block has it
        for at in range(0, n, NODE_BLOCK):
            block = slice(at, at + NODE_BLOCK)
            x, mask, gaps = _unfolded(nodes["f"].iloc[block], nodes["gaps"].iloc[block], steps)
            states[block] = model.encode(x, mask, gaps).value
            for f in range(N_FEATURES) if explain else ():
                if x[..., f].any():
                    less = x.copy()
                    less[..., f] = 0.0
                    hidden.setdefault(f, {})[at] = model.encode(less, mask, gaps).value
        place = pd.Series(range(n), index=nodes["entity"])
        adjacency = Pairs(n, pairs["src"].map(place).to_numpy(int), pairs["dst"].map(place).to_numpy(int), pairs["weight"].to_numpy(float))
        active = (nodes["gaps"].map(len).to_numpy() > 0).astype(float)[None]
        relate = lambda of: model.relate(as_var(of[None]), active, adjacency)
        top, logits = relate(states)
        base = logits.value[0]
        why = np.zeros((n, N_FEATURES if explain else 0))
        for f, blocks in hidden.items():
            less = states.copy()
            for at, own in blocks.items():
                less[at : at + NODE_BLOCK] = own
            why[:, f] = base - relate(less)[1].value[0]
        return pd.DataFrame({"window_id": nodes["window_id"], "entity": nodes["entity"], "node_index": nodes["node_index"], "logit": base, "graph_logit": float(top.value[0]), "attribution": list(why)})

    return run


def node_scores(events: DataFrame, model: Model, steps: int = config.DEFAULTS["graph.score_max_steps"], explain: bool = True) -> DataFrame:
    """(window_id, entity, node_index, logit, graph_logit, attribution) of projected events; every entity of a window is a node."""
    rows = graph.node_rows(events, steps, model.spec.time_mode)
    # read several times below, and far smaller than the events
    seen = graph.with_node_index(graph.nodes(graph.mentions(events)))
    seen = materialise(seen.select("window_id", "entity", "node_index"), "nodes")
    pairs = graph.decayed(graph.edges(graph.within_nodes(graph.emitted(events), seen)), graph.clock(events).select("window_id", "last_event_ts"), model.spec.half_life)
    pairs = materialise(pairs, "pairs")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("s"), "f", "gap")))
    packed = rows.groupBy("window_id", "entity").agg(ordered.alias("h"))
    nodes = seen.select("window_id", "entity", "node_index").join(packed, ["window_id", "entity"]).select("window_id", "entity", "node_index", F.col("h.f").alias("f"), F.col("h.gap").alias("gaps"))
    # both sides come from the same events; fresh names keep their columns apart
    left = nodes.toDF("window_id", "entity", "node_index", "f", "gaps")
    right = graph.normalised(pairs, seen).select(F.col("window_id").alias("pair_window"), "src", "dst", "weight").toDF("pair_window", "src", "dst", "weight")
    return left.groupBy("window_id").cogroup(right.groupBy("pair_window")).applyInPandas(_scorer(model, steps, explain), _OUT)


def findings(events: DataFrame, model: Model, top_k: int = config.DEFAULTS["scoring.top_k"], rules: list[str] | None = None, steps: int = config.DEFAULTS["graph.score_max_steps"], registry: list[dict] | None = None) -> DataFrame:
    """One row per window: the finding.

    With a ``registry`` (the rows of a ``campaigns.Registry``, [] for an empty one)
    windows in time order continue the campaigns they match; without one each is a
    campaign of its own, named after its first event.  Suppressed entities leave the ranking and the evidence, nothing else.
    """
    # the events' JSON is parsed once and the model runs once, however often the parts below read them
    events = materialise(events, "projected")
    scored = materialise(node_scores(events, model, steps), "scored")
    rows = graph.mentions(events)
    proof = graph.evidence(rows)
    ranked = ranking.top_k(scored.withColumn("score", F.col("logit")), top_k, rules)
    best = ranked.select("window_id", "entity", "rank")
    edges = graph.typed_edges(graph.emitted(events))
    inside = edges.join(best.select("window_id", F.col("entity").alias("left")), ["window_id", "left"]).join(best.select("window_id", F.col("entity").alias("right")), ["window_id", "right"])
    order = ["first_ts", "first_id", "first_pos"]
    side = lambda own, peer: inside.select("window_id", F.col(own).alias("entity"), F.struct(*order, F.struct(F.col(peer).alias("peer"), "relation").alias("e")).alias("e"))
    peers = side("left", "right").unionByName(side("right", "left").join(inside.where("left = right").select("window_id", F.col("left").alias("entity")).distinct(), ["window_id", "entity"], "left_anti"))
    peers = peers.groupBy("window_id", "entity").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]).alias("related_edges"))
    names = F.array(*[F.lit(n) for n in config.FEATURES])
    weighed = F.transform("attribution", lambda a, i: F.struct((-a).alias("m"), i.alias("i"), F.struct(F.get(names, i).alias("feature"), F.bround(a, 6).alias("attribution")).alias("t"), a.alias("a")))
    top = F.transform(F.filter(F.slice(F.array_sort(weighed), 1, 3), lambda x: x["a"] > 0), lambda x: x["t"])
    kinds = rows.join(events.select("window_id", "id", "kind_type"), ["window_id", "id"]).join(F.broadcast(attack.attack_table(events.sparkSession)), "kind_type")
    # at most one row per technique is collected
    sighted = kinds.groupBy("window_id", "entity", "technique").agg(F.min(F.struct("timestamp", "id")).alias("first"))
    techniques = sighted.groupBy("window_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "technique"))), lambda x: x["technique"]).alias("attack_techniques"))
    key = ["window_id", "entity"]
    empty = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    full = ranked.join(proof, key).join(peers, key, "left").join(techniques, key, "left").select(
        "window_id", "rank", "entity", "evidence_ids",
        F.struct(
            "entity", F.bround(1 / (1 + F.exp(-F.col("logit"))), 6).alias("node_probability"), F.col("evidence_ids").alias("evidence_event_ids"),
            empty("related_edges", "array<struct<peer:string,relation:string>>").alias("related_edges"), top.alias("top_features"), empty("attack_techniques", "array<string>").alias("attack_techniques"),
        ).alias("record"),
    )
    listed = full.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity", "evidence_ids", "record"))).alias("r"))
    listed = listed.select(
        "window_id", F.transform("r", lambda x: x["entity"]).alias("related_entities"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: x["evidence_ids"]))).alias("evidence_event_ids"), F.transform("r", lambda x: x["record"]).alias("entity_evidence"),
    )
    hit = ranking.suppressed(F.col("entity"), rules or [])
    per = scored.groupBy("window_id").agg(
        F.max("graph_logit").alias("g"), F.count(F.lit(1)).cast("int").alias("graph_nodes"),
        F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("node_index", "entity")))), lambda x: x["entity"]).alias("applied_suppressions"),
    )
    counts = graph.relation_counts(graph.emitted(events)).groupBy("window_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("graph_relations"))
    found = attack.stages(events)
    staged = found.groupBy("window_id").agg(attack.stage_list().alias("observed_attack_stages")).join(attack.next_stage(found), "window_id")
    first = graph.clock(events).select("window_id", F.concat(F.lit("idr-campaign-"), F.substring("first_id", 1, 8)).alias("campaign_id"))
    if registry is None:
        first = first.select("*", F.lit(False).alias("continues_campaign"), F.lit(1).cast("bigint").alias("windows_observed"))
    else:
        starts = events.groupBy("window_id").agg(F.min("timestamp").alias("start"))
        first = campaigns.resolve_windows(campaigns.fingerprints(scored), starts, registry)
    out = per.join(first, "window_id").join(listed, "window_id", "left").join(counts, "window_id", "left").join(staged, "window_id", "left")
    if model.feature_stats:
        edges_, base = model.feature_stats["bin_edges"], model.feature_stats["histograms"]
        baseline = events.sparkSession.createDataFrame([(config.FEATURES[i], b, int(n)) for i, row in enumerate(base) for b, n in enumerate(row)], "feature string, bin int, n bigint")
        history = graph.node_rows(events, steps, model.spec.time_mode).select("window_id", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(config.FEATURES)])
        drifted = psi.drift(psi.psi(psi.histogram(history, ["window_id"], config.FEATURES, edges_), baseline, ["window_id"], len(edges_) - 1), ["window_id"])
        out = out.join(drifted.select("window_id", F.struct("psi_max", "psi_mean", "flagged_features").alias("feature_drift")), "window_id", "left")
    else:
        out = out.withColumn("feature_drift", F.lit(None).cast("struct<psi_max:double,psi_mean:double,flagged_features:array<string>>"))
    sig = lambda z: F.bround(1 / (1 + F.exp(-z)), 6)
    return out.select(
        "window_id", "campaign_id", sig(F.col("g") / max(model.temperature, 1e-3) + model.bias).alias("escalation_probability"), sig(F.col("g")).alias("raw_escalation_probability"),
        F.lit(model.calibration()).alias("calibration"), F.coalesce("next_stage", F.lit("unknown")).alias("predicted_next_stage"), "observed_attack_stages",
        "related_entities", "entity_evidence", "applied_suppressions", "evidence_event_ids", F.lit(model.version).alias("model_version"), "graph_nodes", "graph_relations",
        F.lit(config.ENGINE_VERSION).alias("engine_version"), F.lit(config.schema_hash()).alias("feature_schema_hash"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("scored_at"), "feature_drift",
        "continues_campaign", "windows_observed",
    )
