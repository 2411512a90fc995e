"""Queries of the event-analytics operators over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions.entities import normalised_delta
from tidewatch.operators import attack, campaigns, graph, metrics, psi, ranking, reputation
from tidewatch.plans.adapter import ENT, EV, NODES, REL, envelope, graph_events, projected
from tidewatch.runtime import materialise, table
from tidewatch.sources import builders, wire
from tidewatch.sources.simulator import SCENARIOS, simulated_events

QUERIES: dict = {}
SQL: dict[str, str] = {}
HALF_LIFE = 3600.0
MAX_NODES = 40
MAX_STEPS = 24


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def us(name: str, out: str | None = None):
    return F.unix_micros(F.col(name)).alias(out or name)


def _rounded(c, places: int = 6):
    return F.round(c, places)


_FLAGS = [n for n in config.FEATURES if n != "delta_seconds_log"]
_BUCKET = {k: config.kind_bucket(k) for k in ("socket_lineage", "ntp_time_shift", "suspicious_beacon", "bgp_anomaly", "nvme_latency_anomaly")}
_SEVERITY = "CASE WHEN value < 5 THEN 0.05 WHEN value < 20 THEN 0.25 WHEN value < 60 THEN 0.65 WHEN value < 150 THEN 0.85 ELSE 1.0 END"
_PRIOR = "CASE t WHEN 'click' THEN 0.12 WHEN 'view' THEN 0.42 WHEN 'purchase' THEN 0.72 WHEN 'signup' THEN 0.48 ELSE 0.52 END"
_CASES = {
    "severity": _SEVERITY, "kind_prior": _PRIOR, "has_process": "t IN ('click', 'purchase')",
    "unsigned_process": "t = 'click' AND k % 2 = 1", "has_ip": "t <> 'error'", "has_hash": "t = 'click'", "has_domain": "t = 'purchase'",
    "has_asn_or_prefix": "t = 'signup'", "has_hardware": "t = 'error'", "concurrent_exfil": "t = 'error' AND k % 2 = 1",
    "production_bgp_anomaly": "t = 'signup' AND k % 3 = 0", "source_kernel": "t IN ('click', 'purchase')", "source_network": "t = 'view'",
    "source_hardware": "t = 'error'", "source_correlation": "t = 'signup'",
    **{f"kind_hash_{i}": "kind_type IN (" + ", ".join(f"'{k}'" for k, b in _BUCKET.items() if b == i) + ")" if i in _BUCKET.values() else "false" for i in range(4)},
    "has_user": "usr IS NOT NULL", "has_identity_pivot": "t IN ('click', 'purchase')",
}
_FEATURE_COLUMNS = ", ".join(f"CAST({_CASES[n]} AS DOUBLE) AS {n}" for n in _FLAGS)


@query(f"WITH {EV} SELECT window_id, id, {_FEATURE_COLUMNS} FROM evx")
def event_projection_flags(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("window_id", "id", *_FLAGS)


@query(f"WITH {EV}, {ENT} SELECT window_id, id, string_agg(entity, '|' ORDER BY pos) AS entities FROM ent GROUP BY ALL")
def event_entities(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("window_id", "id", F.array_join("entities", "|").alias("entities"))


@query(f"""WITH {EV} SELECT window_id, id, round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 6) AS gap_seconds,
  round(ln(1 + coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0)) / 12, 6) AS delta FROM evx WINDOW w AS (PARTITION BY window_id ORDER BY ts, id)""")
def inter_event_delta(spark: SparkSession, d: str) -> DataFrame:
    gapped = graph.with_stream_gap(envelope(spark, d).select("window_id", "id", "timestamp"))
    return gapped.select("window_id", "id", _rounded("gap_seconds").alias("gap_seconds"), _rounded(normalised_delta(F.col("gap_seconds"))).alias("delta"))


@query(f"""WITH {EV}, {ENT} SELECT window_id, id, entity, round(ln(1 + coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER
  (PARTITION BY window_id, entity ORDER BY ts, id)) / 1e6, 0)) / 12, 6) AS delta FROM ent""")
def per_entity_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.with_entity_gap(graph.mentions(projected(spark, d)))
    return rows.select("window_id", "id", "entity", _rounded(normalised_delta(F.col("entity_gap_seconds"))).alias("delta"))


@query(f"WITH {EV}, {ENT}, {NODES} SELECT window_id, entity, epoch_us(first_ts) AS first_ts, first_id, epoch_us(last_ts) AS last_ts, n_events FROM nodes")
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(graph.mentions(projected(spark, d))).select("window_id", "entity", us("first_ts"), "first_id", us("last_ts"), "n_events")


@query(f"""WITH {EV}, {ENT}, {NODES} SELECT window_id, entity, CAST(row_number() OVER (PARTITION BY window_id ORDER BY first_ts, first_id, first_pos) - 1 AS INTEGER) AS node_index FROM nodes""")
def entity_first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_node_index(graph.nodes(graph.mentions(projected(spark, d)))).select("window_id", "entity", "node_index")


@query(f"WITH {EV}, {REL} SELECT window_id, relation, count(*) AS n FROM rel GROUP BY ALL")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_counts(graph.emitted(projected(spark, d)))


@query(f"""WITH {EV}, {REL} SELECT window_id, "left", "right", relation, epoch_us(min(ts)) AS first_ts, count(*) AS n FROM rel GROUP BY ALL""")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.typed_edges(graph.emitted(projected(spark, d))).select("window_id", "left", "right", "relation", us("first_ts"), "n")


_EDGES = """edges AS (SELECT window_id, least("left", "right") AS a, greatest("left", "right") AS b, max(ts) AS last_ts FROM rel
  WHERE "left" <> "right" GROUP BY ALL)"""


@query(f"WITH {EV}, {REL}, {_EDGES} SELECT window_id, a, b, epoch_us(last_ts) AS last_ts FROM edges")
def edge_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(graph.emitted(projected(spark, d))).select("window_id", "a", "b", us("last_ts"))


_DECAY = f"""clock AS (SELECT window_id, max(ts) AS e FROM evx GROUP BY ALL),
decay AS (SELECT window_id, a, b, pow(0.5, (epoch_us(e) - epoch_us(last_ts)) / 1e6 / {HALF_LIFE}) AS weight FROM edges JOIN clock USING (window_id))"""


def _decayed(events: DataFrame) -> DataFrame:
    return graph.decayed(graph.edges(graph.emitted(events)), graph.clock(events), HALF_LIFE)


@query(f"WITH {EV}, {REL}, {_EDGES}, {_DECAY} SELECT window_id, a, b, round(weight, 6) AS weight FROM decay")
def edge_decay(spark: SparkSession, d: str) -> DataFrame:
    return _decayed(graph_events(spark, d)).select("window_id", "a", "b", _rounded("weight").alias("weight"))


_NORMAL = """both_ways AS (SELECT window_id, a AS src, b AS dst, weight FROM decay UNION ALL SELECT window_id, b, a, weight FROM decay),
degree AS (SELECT window_id, entity, 1 + coalesce(sum(weight), 0) AS deg FROM (SELECT DISTINCT window_id, entity FROM ent) n
  LEFT JOIN both_ways b ON n.window_id = b.window_id AND n.entity = b.src GROUP BY ALL),
adj AS (SELECT b.window_id, src, dst, weight / (sqrt(x.deg) * sqrt(y.deg)) AS weight FROM both_ways b
  JOIN degree x ON b.window_id = x.window_id AND b.src = x.entity JOIN degree y ON b.window_id = y.window_id AND b.dst = y.entity
  UNION ALL SELECT window_id, entity, entity, 1 / deg FROM degree)"""
_NORMAL = _NORMAL.replace("SELECT window_id, entity, 1 + coalesce", "SELECT n.window_id, n.entity, 1 + coalesce")


def _adjacency(events: DataFrame) -> DataFrame:
    return graph.normalised(materialise(_decayed(events), "decayed"), graph.mentions(events).select("window_id", "entity").distinct())


@query(f"WITH {EV}, {ENT}, {REL}, {_EDGES}, {_DECAY}, {_NORMAL} SELECT window_id, src, dst, round(weight, 6) AS weight FROM adj")
def degree_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _adjacency(graph_events(spark, d)).select("window_id", "src", "dst", _rounded("weight").alias("weight"))


_LRU = f"""lru AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY last_ts DESC, entity DESC) AS r FROM nodes)"""


@query(f"WITH {EV}, {ENT}, {NODES}, {_LRU} SELECT window_id, entity FROM lru WHERE r <= {MAX_NODES}")
def lru_budget_keep(spark: SparkSession, d: str) -> DataFrame:
    return graph.budget(graph.nodes(graph.mentions(projected(spark, d))), MAX_NODES).where("kept").select("window_id", "entity")


@query(f"WITH {EV}, {ENT}, {NODES}, {_LRU} SELECT window_id, entity, epoch_us(last_ts) AS last_seen, 'node_budget' AS reason FROM lru WHERE r > {MAX_NODES}")
def lru_evictions(spark: SparkSession, d: str) -> DataFrame:
    dropped = graph.budget(graph.nodes(graph.mentions(projected(spark, d))), MAX_NODES).where(~F.col("kept"))
    return dropped.select("window_id", "entity", us("last_ts", "last_seen"), F.lit("node_budget").alias("reason"))


@query(f"""WITH {EV}, {ENT}, {REL}, {NODES}, {_LRU}, kept AS (SELECT window_id, entity FROM lru WHERE r <= {MAX_NODES})
SELECT window_id, relation, count(*) AS n FROM rel r WHERE EXISTS (FROM kept k WHERE k.window_id = r.window_id AND k.entity = r."left")
  AND EXISTS (FROM kept k WHERE k.window_id = r.window_id AND k.entity = r."right") GROUP BY ALL""")
def budget_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    events = graph_events(spark, d)
    kept = graph.budget(graph.nodes(graph.mentions(events)), MAX_NODES).where("kept")
    return graph.relation_counts(graph.within_nodes(graph.emitted(events), kept))


@query(f"""WITH {EV}, {ENT} SELECT window_id, entity, id, CAST(step AS INTEGER) AS step FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id, entity ORDER BY ts DESC, id DESC) AS step FROM ent) WHERE step <= {MAX_STEPS}""")
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return graph.histories(graph.mentions(projected(spark, d)), MAX_STEPS).select("window_id", "entity", "id", "step")


@query(f"""WITH {EV}, {ENT} SELECT window_id, entity, string_agg(id, ',' ORDER BY ts, id) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id, entity ORDER BY ts DESC, id DESC) AS r FROM ent) WHERE r <= {config.EVIDENCE_LIMIT} GROUP BY ALL""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    found = graph.evidence(graph.mentions(projected(spark, d)), config.EVIDENCE_LIMIT)
    return found.select("window_id", "entity", F.array_join("evidence_ids", ",").alias("evidence"))


@query(f"""WITH {EV}, {ENT}, vals AS (SELECT window_id, id, {_SEVERITY} AS severity, {_PRIOR} AS kind_prior FROM evx)
SELECT e.window_id, entity, round(avg(severity), 6) AS mean_severity, CAST(max(severity) AS DOUBLE) AS max_severity, round(avg(kind_prior), 6) AS mean_kind_prior,
  CAST(max(kind_prior) AS DOUBLE) AS max_kind_prior FROM ent e JOIN vals v ON e.window_id = v.window_id AND e.id = v.id GROUP BY ALL""")
def static_history_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = ranking.static_pool(graph.mentions(projected(spark, d), "severity", "kind_prior"), ["severity", "kind_prior"])
    return pooled.select("window_id", "entity", _rounded("mean_severity").alias("mean_severity"), "max_severity", _rounded("mean_kind_prior").alias("mean_kind_prior"), "max_kind_prior")


_ATTACK = "attack(kind_type, tactic, technique, technique_name, tactic_no) AS (VALUES " + ", ".join(
    f"('{k}', '{a}', '{b}', '{c}', {config.TACTICS.index(a) + 1})" for k, (a, b, c) in config.ATTACK.items()
) + ")"
_STAGES = """stages AS (SELECT window_id, kind_type, tactic, technique, technique_name, tactic_no, arg_min(id, (ts, id)) AS first_event_id
  FROM evx JOIN attack USING (kind_type) GROUP BY ALL)"""


@query(f"WITH {EV}, {_ATTACK}, {_STAGES} SELECT * EXCLUDE (tactic_no) FROM stages")
def attack_stages(spark: SparkSession, d: str) -> DataFrame:
    return attack.stages(projected(spark, d)).drop("first_ts")


_TACTICS = "tactics(tactic, no) AS (VALUES " + ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(config.TACTICS)) + ")"


@query(f"""WITH {EV}, {_ATTACK}, {_STAGES}, {_TACTICS}, top AS (SELECT window_id, max(tactic_no) AS m FROM stages GROUP BY ALL)
SELECT window_id, coalesce(arg_min(tactic, no), 'kill-chain-complete') AS next_stage FROM top LEFT JOIN tactics ON no > m GROUP BY ALL""")
def next_stage(spark: SparkSession, d: str) -> DataFrame:
    return attack.next_stage(attack.stages(projected(spark, d)))


_EDGE_SQL = config.DRIFT_EDGES
_HISTORY = f"""hist AS (SELECT window_id, feature, bin, count(*) AS n FROM (
  SELECT window_id, unnest({_FLAGS!r}) AS feature, unnest([{", ".join(f"CAST({_CASES[n]} AS FLOAT)" for n in _FLAGS)}]) AS value FROM
    (SELECT x.* FROM ent JOIN evx x USING (window_id, id))) JOIN (SELECT unnest(range(10)) AS bin) ON
  (CAST(value AS DOUBLE) >= list_extract({_EDGE_SQL}::DOUBLE[], bin + 1) AND CAST(value AS DOUBLE) < list_extract({_EDGE_SQL}::DOUBLE[], bin + 2)) GROUP BY ALL)"""


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    """Every event counts once per entity that mentions it."""
    events = projected(spark, d).withColumn("n_entities", F.size("entities"))
    return psi.histogram(events, ["window_id"], _FLAGS, weight="n_entities")


@query(f"WITH {EV}, {ENT}, {_HISTORY} SELECT window_id, feature, CAST(bin AS INTEGER) AS bin, n FROM hist")
def feature_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d)


_SPLIT_DAY = "2024-01-16"
_PSI = f"""base AS (SELECT feature, bin, sum(n) AS m FROM hist WHERE window_id < '{_SPLIT_DAY}' GROUP BY ALL),
grid AS (SELECT window_id, feature, bin FROM (SELECT DISTINCT window_id, feature FROM hist WHERE window_id >= '{_SPLIT_DAY}'), (SELECT unnest(range(10)) AS bin)),
cell AS (SELECT g.*, coalesce(h.n, 0) + 1e-4 AS o, coalesce(b.m, 0) + 1e-4 AS t FROM grid g LEFT JOIN hist h USING (window_id, feature, bin) LEFT JOIN base b USING (feature, bin)),
share AS (SELECT window_id, feature, o / sum(o) OVER w AS o, t / sum(t) OVER w AS t FROM cell WINDOW w AS (PARTITION BY window_id, feature)),
psi AS (SELECT window_id, feature, sum((o - t) * ln(o / t)) AS psi FROM share GROUP BY ALL)"""


def _psi(spark: SparkSession, d: str) -> DataFrame:
    counts = materialise(_histogram(spark, d), "histogram")
    base = counts.where(F.col("window_id") < _SPLIT_DAY).groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    return psi.psi(counts.where(F.col("window_id") >= _SPLIT_DAY), base, ["window_id"], 10)


@query(f"WITH {EV}, {ENT}, {_HISTORY}, {_PSI} SELECT window_id, feature, round(psi, 6) AS psi FROM psi")
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    return _psi(spark, d).select("window_id", "feature", _rounded("psi").alias("psi"))


@query(f"""WITH {EV}, {ENT}, {_HISTORY}, {_PSI} SELECT window_id, round_even(max(psi), 6) AS psi_max, round_even(avg(psi), 6) AS psi_mean,
  coalesce(string_agg(feature, ',' ORDER BY list_position({config.FEATURES!r}, feature)) FILTER (psi >= 0.2), '') AS flagged FROM psi GROUP BY ALL""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    return psi.drift(_psi(spark, d), ["window_id"]).select("window_id", "psi_max", "psi_mean", F.array_join("flagged_features", ",").alias("flagged"))


@query(f"""WITH {EV}, {ENT}, {NODES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY
  entity LIKE 'host:%' OR entity = 'user:u1', n_events DESC, first_ts, first_id, first_pos) AS rank FROM nodes)
SELECT window_id, CAST(rank AS INTEGER) AS rank, entity, n_events FROM ranked WHERE rank <= 5 AND NOT (entity LIKE 'host:%' OR entity = 'user:u1')""")
def suppressed_topk(spark: SparkSession, d: str) -> DataFrame:
    seen = graph.with_node_index(graph.nodes(graph.mentions(projected(spark, d)))).withColumn("score", F.col("n_events"))
    return ranking.top_k(seen, 5, ["host:", "user:u1"]).select("window_id", "rank", "entity", "n_events")


_PRINTS = "prints AS (SELECT window_id, entity, CASE split_part(entity, ':', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.ENTITY_WEIGHT.items()) + """ END AS weight
  FROM nodes WHERE split_part(entity, ':', 1) NOT IN ('process', 'session')),
sums AS (SELECT window_id, sum(weight) AS w FROM prints GROUP BY ALL),
days AS (SELECT window_id AS a, lag(window_id) OVER (ORDER BY window_id) AS b FROM sums),
jac AS (SELECT a, b, sum(x.weight) / (any_value(s.w) + any_value(t.w) - sum(y.weight)) AS score FROM days JOIN prints x ON x.window_id = a
  JOIN prints y ON y.window_id = b AND y.entity = x.entity JOIN sums s ON s.window_id = a JOIN sums t ON t.window_id = b GROUP BY a, b)"""


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.fingerprints(graph.mentions(projected(spark, d)))


@query(f"WITH {EV}, {ENT}, {NODES}, {_PRINTS} SELECT a, b, round(score, 6) AS score FROM jac")
def fingerprint_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Every window against the one before it."""
    from pyspark.sql import Window

    prints = materialise(_prints(spark, d), "prints")
    days = prints.select("window_id").distinct()
    steps = days.select(F.col("window_id").alias("a"), F.lag("window_id").over(Window.orderBy("window_id")).alias("b")).where(F.col("b").isNotNull())
    scores = campaigns.jaccard(prints.withColumnRenamed("window_id", "a"), prints.withColumnRenamed("window_id", "b"), steps)
    return scores.select("a", "b", _rounded("score").alias("score"))


@query(f"""WITH {EV}, {ENT}, {NODES}, {_PRINTS.split('days AS')[0].rstrip().rstrip(',')},
sc AS (SELECT x.window_id AS a, y.window_id AS b, sum(x.weight) / (any_value(s.w) + any_value(t.w) - sum(y.weight)) AS score FROM prints x
  JOIN prints y ON x.entity = y.entity AND y.window_id < x.window_id JOIN sums s ON s.window_id = x.window_id JOIN sums t ON t.window_id = y.window_id GROUP BY 1, 2)
SELECT a, b, score FROM (SELECT a, b, round(score, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS r FROM sc) WHERE r = 1 AND score >= 0.5""")
def campaign_match(spark: SparkSession, d: str) -> DataFrame:
    """Every window against all earlier ones: the closest at or above the threshold."""
    prints = materialise(_prints(spark, d), "prints")
    left, right = prints.withColumnRenamed("window_id", "a"), prints.withColumnRenamed("window_id", "b")
    scores = campaigns.jaccard(left, right, campaigns.candidates(left, right).where("b < a"))
    return campaigns.best_match(scores.withColumn("score", _rounded("score")))


@query()
def campaign_windows(spark: SparkSession, d: str) -> DataFrame:
    """The campaign of every window, folded over the windows in time order; no SQL, since a match changes later ones."""
    events = graph_events(spark, d)
    starts = events.groupBy("window_id").agg(F.min("timestamp").alias("start"))
    return campaigns.resolve_windows(campaigns.fingerprints(graph.mentions(events)), starts)


@query(f"""WITH {EV}, {ENT}, {REL}, {NODES}, {_EDGES}, {_DECAY}, {_NORMAL}
SELECT adj.window_id, src AS entity, round(sum(weight * n_events), 4) AS value FROM adj JOIN nodes n ON n.window_id = adj.window_id AND n.entity = dst GROUP BY ALL""")
def message_pass(spark: SparkSession, d: str) -> DataFrame:
    events = graph_events(spark, d)
    state = graph.nodes(graph.mentions(events)).select("window_id", "entity", F.col("n_events").cast("double").alias("value"))
    return graph.message_pass(_adjacency(events), state).select("window_id", "entity", _rounded("value", 4).alias("value"))


@query("""WITH v AS (SELECT label AS window_id, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT window_id, vec_id, max(x) FILTER (i = 1) AS score, max(x) FILTER (i = 2) AS a, max(x) FILTER (i = 3) AS b FROM v GROUP BY ALL),
w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY window_id)) AS e FROM s)
SELECT window_id, round(sum(e * a) / sum(e), 6) AS a, round(sum(e * b) / sum(e), 6) AS b FROM w GROUP BY ALL""")
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Softmax pooling of embeddings per label: the first component scores, the next two are pooled."""
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("window_id"), part(0).alias("score"), part(1).alias("a"), part(2).alias("b"))
    return ranking.attention_pool(rows, "score", ["a", "b"]).select("window_id", _rounded("a").alias("a"), _rounded("b").alias("b"))


# Labels and scores for the metrics: whether an order is large, and its customer's share of a fixed scale.
_SCORED = """scored AS (SELECT o_orderkey AS id, CAST(o_totalprice > 150000 AS INTEGER) AS label,
  round(least(greatest((o_totalprice + (o_custkey % 97) * 3000) / 800000.0, 0), 1), 3) AS score FROM orders)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    value = F.round(F.least(F.greatest((F.col("o_totalprice") + (F.col("o_custkey") % 97) * 3000) / 800000.0, F.lit(0.0)), F.lit(1.0)), 3)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 150000).cast("int").alias("label"), value.alias("score"))


_CURVE = """cells AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM cells WINDOW w AS (ORDER BY score DESC))"""


def _one(frame: DataFrame) -> DataFrame:
    return frame.select(*[_rounded(c).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


@query(f"WITH {_SCORED}, {_CURVE} SELECT round(sum(neg * (tp - pos + pos / 2)) / (max(ap) * max(an)), 6) AS roc_auc FROM curve")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.roc_auc(metrics.curve(scored(spark, d))))


@query(f"WITH {_SCORED}, {_CURVE} SELECT round(sum(pos / ap * tp / (tp + fp)), 6) AS pr_auc FROM curve")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.average_precision(metrics.curve(scored(spark, d))))


@query(f"WITH {_SCORED} SELECT round(avg(pow(score - label, 2)), 6) AS brier FROM scored")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.brier(scored(spark, d)))


@query(f"""WITH {_SCORED}, c AS (SELECT label, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM scored)
SELECT round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM c""")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.log_loss(scored(spark, d)))


@query(f"""WITH {_SCORED}, b AS (SELECT bin, count(*) AS n, avg(score) AS s, avg(label) AS l FROM scored JOIN (SELECT unnest(range(1, 16)) AS bin) ON
  (score > (bin - 1) / 15.0::DOUBLE OR bin = 1) AND score <= bin / 15.0::DOUBLE GROUP BY ALL)
SELECT round(sum(abs(s - l) * n) / sum(n), 6) AS ece, round(max(abs(s - l)), 6) AS mce FROM b""")
def ece15(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.calibration_errors(scored(spark, d)))


@query(f"WITH {_SCORED}, {_CURVE} SELECT round(coalesce(max(tp / ap) FILTER (fp <= 0.01 * an), 0), 6) AS recall FROM curve")
def recall_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.recall_at_fpr(metrics.curve(scored(spark, d)), 0.01))


@query(f"WITH {_SCORED} SELECT round(avg(label), 6) AS precision_at_k FROM (FROM scored ORDER BY score DESC, id LIMIT 100)")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.precision_at_k(scored(spark, d), 100, "id"))


@query(f"""WITH {_SCORED}, {_CURVE}, ok AS (SELECT score, fp / an AS fpr, tp / ap AS tpr FROM curve WHERE fp <= 0.05 * an AND tp > 0)
SELECT round(arg_max(score, (tpr, score)), 6) AS tau, round(coalesce(arg_max(fpr, (tpr, score)), 0), 6) AS dev_fpr, round(coalesce(max(tpr), 0), 6) AS dev_tpr FROM ok""")
def threshold_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.threshold_at_fpr(metrics.curve(scored(spark, d)), 0.05))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label = 0) AS fp,
  count(*) FILTER (score < 0.4 AND label = 0) AS tn, count(*) FILTER (score < 0.4 AND label = 1) AS fn FROM scored)
SELECT *, round(fp / (fp + tn), 6) AS realized_fpr, round(tp / (tp + fn), 6) AS realized_tpr, round(tp / (tp + fp), 6) AS precision FROM c""")
def confusion_at_tau(spark: SparkSession, d: str) -> DataFrame:
    return _one(metrics.confusion(scored(spark, d), 0.4))


_WINDOWS = f"WITH {EV}, win AS (SELECT window_id, min(ts) AS start FROM evx GROUP BY ALL), pl AS (SELECT window_id, row_number() OVER (ORDER BY start, window_id) - 1 AS i, count(*) OVER () AS n FROM win)"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return envelope(spark, d).groupBy("window_id").agg(F.min("timestamp").alias("start"))


@query(f"{_WINDOWS} SELECT window_id, CAST(CAST(i >= floor(n * 0.6) AS INTEGER) + CAST(i >= floor(n * 0.8) AS INTEGER) AS INTEGER) AS segment FROM pl")
def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chronological_split(_windows(spark, d)).select("window_id", "segment")


@query(f"""{_WINDOWS}, f AS (SELECT unnest([0, 1, 2]) AS fold)
SELECT window_id, fold, segment FROM (SELECT window_id, fold, CASE WHEN i < floor(n * (0.40::DOUBLE + fold * 0.15::DOUBLE)) THEN 'train' WHEN i < floor(n * (0.55::DOUBLE + fold * 0.15::DOUBLE))
  THEN 'validation' WHEN i < floor(n * (0.70::DOUBLE + fold * 0.15::DOUBLE)) THEN 'test' END AS segment FROM pl, f) WHERE segment IS NOT NULL""")
def rolling_origin_folds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rolling_folds(_windows(spark, d))


@query(f"{_WINDOWS} SELECT window_id, i >= least(greatest(round_even(n * 0.5, 0), 2), n - 2) AS is_test FROM pl")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.holdout_split(_windows(spark, d)).select("window_id", "is_test")


def _ips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "idr_events").select(F.get_json_object("kind", "$.dst_ip").alias("ip"))


_BITS = "(split_part({0}, '.', 1)::BIGINT << 24) + (split_part({0}, '.', 2)::BIGINT << 16) + (split_part({0}, '.', 3)::BIGINT << 8) + split_part({0}, '.', 4)::BIGINT"
_LPM = f"""pre AS (SELECT len, asn, (({_BITS.format('network')}) >> (32 - len)) AS key FROM prefix_asn WHERE len BETWEEN 0 AND 32),
asked AS (SELECT DISTINCT kind ->> '$.dst_ip' AS ip FROM idr_events WHERE regexp_full_match(kind ->> '$.dst_ip', '[0-9]+(\\.[0-9]+){{3}}')),
both_ips AS (SELECT ip AS x FROM asked UNION SELECT array_to_string(list_reverse(string_split(ip, '.')), '.') FROM asked),
lpm AS (SELECT x, arg_max(asn, (len, -rn)) AS asn FROM both_ips LEFT JOIN (SELECT *, row_number() OVER (ORDER BY asn) AS rn FROM pre) p ON (({_BITS.format('x')}) >> (32 - len)) = key GROUP BY x),
known AS (SELECT x, lpm.asn, coalesce(trust, 'Unknown') AS trust FROM lpm LEFT JOIN asn_trust t ON t.asn = lpm.asn)"""


@query(f"WITH {_LPM} SELECT ip, asn, trust FROM asked JOIN known ON x = ip")
def lpm_asn(spark: SparkSession, d: str) -> DataFrame:
    """System and trust of every destination address of idr_events."""
    asked = _ips(spark, d).where(reputation.ip_bits(F.col("ip")).isNotNull()).distinct()
    return reputation.with_trust(reputation.with_asn(asked, "ip", table(spark, d, "prefix_asn")), "asn", table(spark, d, "asn_trust")).select("ip", "asn", "trust")


@query(f"""WITH {_LPM} SELECT a.ip, r.x AS reversed_ip, f.asn AS forward_asn, r.asn AS reversed_asn FROM asked a JOIN known f ON f.x = a.ip
  JOIN known r ON r.x = array_to_string(list_reverse(string_split(a.ip, '.')), '.') WHERE lower(replace(f.trust, '_', '')) = 'hightrust' AND lower(replace(r.trust, '_', '')) = 'residentialisp'""")
def octet_reversal(spark: SparkSession, d: str) -> DataFrame:
    return reputation.octet_reversals(_ips(spark, d), "ip", table(spark, d, "prefix_asn"), table(spark, d, "asn_trust"))


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "idr_events").select("row_no", F.get_json_object("kind", "$.prefix").alias("prefix"), "id", "source", "severity", F.col("kind").alias("kind_json"), F.col("metadata").alias("metadata_json"))


@query("""SELECT row_number() OVER (ORDER BY n DESC, first_row) - 1 AS rank, * FROM (SELECT kind ->> '$.prefix' AS prefix, count(*) AS n, min(row_no) AS first_row
  FROM idr_events WHERE kind ->> '$.prefix' <> '' GROUP BY ALL) WHERE n >= 3""")
def audit_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes reported at least three times, ranked by how often."""
    return builders.audit_clusters(_prefixes(spark, d).select("row_no", "prefix"))


@query()
def kill_chain_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows from a simulated campaign as the template, with clusters of idr_events around them."""
    grid = spark.createDataFrame([(1, 7, "v0_easy")], "label int, seed int, scenario string")
    found = _prefixes(spark, d)
    around = builders.background(found.where(F.col("prefix").isNotNull()), builders.audit_clusters(found.select("row_no", "prefix")))
    return builders.kill_chain_windows(spark, simulated_events(spark, grid), around=around)


@query()
def harness_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the labelling rule, as many of either intent as there are suppliers."""
    return builders.harness_windows(spark, table(spark, d, "supplier").count())


@query(f"""SELECT coalesce(kind ->> '$.type', '') AS kind_type, coalesce(kind ->> '$.type', '') NOT IN ({', '.join(repr(k) for k in wire.FIELDS)}) AS unknown_kind, count(*) AS n
  FROM idr_events GROUP BY ALL""")
def wire_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind, and whether the wire format knows it."""
    events = wire.with_wire_problems(table(spark, d, "idr_events").select("kind"), "kind")
    kind = F.coalesce(F.get_json_object("kind", "$.type"), F.lit("")).alias("kind_type")
    return events.groupBy(kind, "unknown_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT window_id, string_agg(DISTINCT kind_type, ',' ORDER BY kind_type) AS modalities, count(*) AS n_events FROM evx GROUP BY ALL")
def window_modalities(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_join(F.sort_array(F.collect_set("kind_type")), ",").alias("modalities")
    return projected(spark, d).groupBy("window_id").agg(kinds, F.count(F.lit(1)).alias("n_events"))


@query("""WITH g AS (SELECT event_id, ts FROM events WHERE event_type = 'signup'), q AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase')
SELECT g.event_id AS first_id, q.event_id AS second_id FROM g JOIN q ON q.ts >= g.ts AND q.ts <= g.ts + INTERVAL 500 MILLISECOND""")
def interval_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of signups and purchases within 500 ms after."""
    from tidewatch.operators.correlate import interval_join

    e = table(spark, d, "events")
    side = lambda t, n: e.where(F.col("event_type") == t).select(F.col("event_id").alias(n), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return interval_join(side("signup", "first_id"), side("purchase", "second_id"), "at", 500_000).select("first_id", "second_id")


def _model():
    from tidewatch.model.nn import Model, Spec

    return Model(Spec(half_life=HALF_LIFE), seed=7)


@query()
def finding_probability(spark: SparkSession, d: str) -> DataFrame:
    """A finding for every day, by untrained weights; no SQL, since a model scores."""
    from tidewatch.operators.score import findings

    return findings(projected(spark, d), _model(), rules=["host:"]).drop("scored_at")


@query()
def node_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Logits and attributions of every entity of every day."""
    from tidewatch.operators.score import node_scores

    return node_scores(materialise(projected(spark, d), "projected"), _model())


@query()
def stream_finding(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, each day a keyed stream; the last finding and all evictions of each."""
    from tidewatch.runtime import scratch_path
    from tidewatch.streaming.scorer import OUTPUT, score_stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = table(spark, d, "events").schema
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        events = envelope(spark, d, source).withColumnRenamed("window_id", "stream_id")
        out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
        run = score_stream(events, _model(), max_nodes=MAX_NODES).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(OUTPUT).parquet(out)


@query()
def simulated_windows(spark: SparkSession, d: str) -> DataFrame:
    """Both labels of every scenario for as many seeds as there are suppliers."""
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed"))
    grid = seeds.select("seed", F.explode(F.array(F.lit(0), F.lit(1))).alias("label")).select("label", "seed", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario"))
    return simulated_events(spark, grid)


@query()
def idr_projection(spark: SparkSession, d: str) -> DataFrame:
    """Entities, relations and features of the events of labeled_windows."""
    from tidewatch.functions.entities import project
    from tidewatch.operators.nested import exploded_events

    e = exploded_events(table(spark, d, "labeled_windows"))
    events = e.select("window_id", "event_pos", "id", "source", F.upper("severity").alias("severity"), F.col("kind").alias("kind_json"), F.coalesce("metadata", F.lit("{}")).alias("metadata_json"))
    return project(events)
