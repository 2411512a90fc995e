"""Queries of this subpackage over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import mixing, overlap, packing, spans
from tidewatch.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "labeled_windows"))
    return pairs.select(F.least("train_id", "other_id").alias("window_id_a"), F.greatest("train_id", "other_id").alias("window_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows by evaluation split and source, with those whose labels disagree."""
    return overlap.overlap_report(table(spark, d, "labeled_windows"))


def p1_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation windows whose label differs from a training window's they overlap with, which they count by label."""
    found = overlap.overlapping_windows(table(spark, d, "labeled_windows"))
    return found.where(overlap.disagrees()).select("window_id", "split", "source", "label", "exact", "train_zeros", "train_ones")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """The fill of every container."""
    return packing.container_fill(packing.pack(table(spark, d, "documents")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """What each source gives to each container, filled to the shares of mix_targets."""
    return packing.container_mixture(packing.pack(table(spark, d, "documents"), targets=table(spark, d, "mix_targets")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, slot by slot."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in the mix."""
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document also stands in another."""
    return spans.shared_share(table(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document goes where each repeated sentence run is kept once."""
    return spans.removed_share(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_disagreements, p8_packing, p8_fill, p8_mixture, p9_mix, p9_shares, p10_found, p10_shares, p10_sentences)}

# Contents of windows: a kind is told apart by the sorted list of its leaves, which neither key order nor spacing changes.
_PAIRS = """ev AS (SELECT window_id, split, source AS window_source, label, unnest(events) AS e FROM labeled_windows WHERE split IS NOT NULL AND len(events) > 0),
said AS (SELECT *, row_number() OVER () AS n, e.source AS src, upper(e.severity) AS sev, e.kind AS kind, e.metadata AS metadata FROM ev),
host AS (SELECT n, coalesce(CASE WHEN json_type(metadata, '$.host') = 'VARCHAR' AND metadata ->> '$.host' <> '' THEN metadata ->> '$.host' END,
  CASE WHEN json_type(metadata, '$.hostname') = 'VARCHAR' AND metadata ->> '$.hostname' <> '' THEN metadata ->> '$.hostname' END, 'unknown-host') AS host FROM said),
kinds AS (SELECT k.kind, string_agg(t.fullkey || '=' || t.type || ':' || coalesce(t.atom::VARCHAR, ''), chr(10) ORDER BY t.fullkey) AS body
  FROM (SELECT DISTINCT kind FROM said WHERE kind IS NOT NULL) k, json_tree(k.kind) t GROUP BY k.kind),
cells AS (SELECT DISTINCT window_id, split, window_source, label, md5(concat_ws(chr(1), coalesce('=' || src, '-'), coalesce('=' || sev, '-'), coalesce('=' || body, '-'), host)) AS c
  FROM said JOIN host USING (n) LEFT JOIN kinds USING (kind)),
sizes AS (SELECT window_id, any_value(split) AS split, any_value(window_source) AS source, any_value(label) AS label, count(*) AS size FROM cells GROUP BY window_id),
met AS (SELECT a.window_id AS t, b.window_id AS o, count(*) AS shared FROM cells a JOIN cells b USING (c) WHERE a.split = 'train' AND b.split <> 'train' GROUP BY ALL),
pairs AS (SELECT t, o, shared, x.size + y.size - shared AS total, x.label AS t_label, y.label AS o_label FROM met JOIN sizes x ON x.window_id = t JOIN sizes y ON y.window_id = o
  WHERE shared >= (x.size + y.size - shared) * 0.6 - 1e-9)"""
_OVERLAPPING = """found AS (SELECT o AS window_id, bool_or(shared = total) AS exact, count(*) FILTER (t_label = 0) AS train_zeros, count(*) FILTER (t_label = 1) AS train_ones FROM pairs GROUP BY o),
held AS (SELECT window_id, w.split, w.source, w.label, exact, train_zeros, train_ones, f.window_id IS NOT NULL AS hit,
  coalesce((w.label = 0 AND train_ones > 0) OR (w.label = 1 AND train_zeros > 0), false) AS differs
  FROM (SELECT * FROM labeled_windows WHERE split IS NOT NULL AND split <> 'train') w LEFT JOIN found f USING (window_id))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT least(t, o) AS window_id_a, greatest(t, o) AS window_id_b FROM pairs",
    "p1_report": f"""WITH {_PAIRS}, {_OVERLAPPING} SELECT split, source, count(*) AS n_windows, count_if(hit)::BIGINT AS n_overlapping, count_if(hit AND exact)::BIGINT AS n_exact,
  count_if(differs)::BIGINT AS n_disagreeing FROM held GROUP BY ALL""",
    "p1_disagreements": f"WITH {_PAIRS}, {_OVERLAPPING} SELECT window_id, split, source, label, exact, train_zeros, train_ones FROM held WHERE differs",
    "p10_found": """WITH d AS (SELECT doc_id, text, unnest(range(0, length(text) // 2000 + 1)) AS k FROM documents WHERE length(text) >= 160),
piece AS (SELECT doc_id, substr(text, k * 2000 + 1, 2159) AS p FROM d),
w AS (SELECT DISTINCT doc_id, hash(substr(p, i::INT, 160)) AS h FROM (SELECT doc_id, p, unnest(range(1, least(length(p) - 158, 2001))) AS i FROM piece WHERE length(p) >= 160)),
r AS (SELECT doc_id, h FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shares": """WITH d AS (SELECT doc_id, text, unnest(range(0, length(text) // 2000 + 1)) AS k FROM documents WHERE length(text) >= 160),
piece AS (SELECT doc_id, k * 2000 AS o, substr(text, k * 2000 + 1, 2159) AS p FROM d),
w AS (SELECT doc_id, o + i - 1 AS spot, hash(substr(p, i::INT, 160)) AS h FROM (SELECT doc_id, o, p, unnest(range(1, least(length(p) - 158, 2001))) AS i FROM piece WHERE length(p) >= 160)),
r AS (SELECT doc_id, spot FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
steps AS (SELECT doc_id, least(160, coalesce(lead(spot) OVER (PARTITION BY doc_id ORDER BY spot) - spot, 160)) AS step FROM r),
covered AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0) AS n_shared, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0::DOUBLE END AS share
FROM documents LEFT JOIN covered USING (doc_id)""",
}
