"""SQL of the general data-preparation queries, written apart from the operators' own rules."""

from __future__ import annotations

HOST = """coalesce(
  CASE WHEN json_type(metadata, '$.host') = 'VARCHAR' AND metadata ->> '$.host' <> '' THEN metadata ->> '$.host' END,
  CASE WHEN json_type(metadata, '$.hostname') = 'VARCHAR' AND metadata ->> '$.hostname' <> '' THEN metadata ->> '$.hostname' END,
  'unknown-host')"""
ID = r"""CASE WHEN trim(id, E' \t\r\n') <> '' THEN regexp_replace(lower(trim(id, E' \t\r\n')), '^urn:uuid:|[{}\-]', '', 'g') END"""
KIND = "coalesce(kind ->> '$.type', 'unknown')"

# Offsets in minutes of zone abbreviations.
_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660, "JST": 540, "BST": 60, "EET": 120, "EEST": 180, "MSK": 180, "BRT": -180,
}
_ABBREVIATED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ABBREVIATIONS.items())
_LOCAL = "epoch_us(timezone(clock_zone, make_timestamptz({0}))) - ({0})"

#: inst(row_no, utc_us): what the timestamp of each row of idr_events denotes.
INSTANTS = rf"""raw AS (
  SELECT row_no, received_at, upper(trim("timestamp", E' \t\r\n\f')) AS s, clock_zone FROM idr_events LEFT JOIN
    (SELECT sensor_id, min(clock_zone) AS clock_zone FROM sensors WHERE sensor_id IS NOT NULL GROUP BY sensor_id) z USING (sensor_id)),
dated AS (
  SELECT *, CASE
      WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') THEN try_strptime(s[1:10], '%Y-%m-%d')
      WHEN regexp_matches(s, '^[0-9]{{4}}-W[0-9]{{2}}-[0-9][T ]') THEN try_strptime(s[1:10], '%G-W%V-%u')
      WHEN regexp_matches(s, '^[0-9]{{8}}T') THEN try_strptime(s[1:8], '%Y%m%d')
      WHEN regexp_matches(s, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} ') THEN try_strptime(s[1:10], '%m/%d/%Y')
      WHEN regexp_matches(s, '^[A-Z]{{3}}, [0-9]{{2}} [A-Z]{{3}} [0-9]{{4}} ') THEN try_strptime(s[6:16], '%d %b %Y') END AS day,
    CASE WHEN regexp_matches(s, '^[0-9]{{8}}T') THEN s[10:11] || ':' || s[12:13] || ':' || s[14:]
      WHEN regexp_matches(s, '^[A-Z]{{3}},') THEN s[18:] ELSE s[12:] END AS clock FROM raw),
timed AS (
  SELECT *, regexp_extract(clock, '^([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(?:[.,]([0-9]+))?(?: ([AP]M))? ?([A-Z]+|[+-][0-9:]+)?(?:\[.*\])?$',
    ['h', 'm', 's', 'f', 'half', 'zone']) AS p FROM dated),
walled AS (
  SELECT *, CASE WHEN day IS NOT NULL AND p.h <> '' AND try_cast(p.h AS INT) < 24 AND try_cast(p.m AS INT) < 60 AND try_cast(p.s AS INT) < 60 THEN epoch_us(day)
    + (CASE WHEN p.half = '' THEN try_cast(p.h AS INT) ELSE try_cast(p.h AS INT) % 12 + CASE p.half WHEN 'PM' THEN 12 ELSE 0 END END * 3600 + try_cast(p.m AS INT) * 60 + try_cast(p.s AS INT))::BIGINT * 1000000
    + rpad(coalesce(p.f, '')[1:6], 6, '0')::BIGINT END AS wall,
  CASE WHEN p.zone = '' THEN NULL WHEN p.zone[1] IN ('+', '-') THEN CASE p.zone[1] WHEN '-' THEN -1 ELSE 1 END
      * (try_cast(p.zone[2:3] AS INT) * 60 + CASE WHEN length(p.zone) > 3 THEN try_cast(p.zone[-2:] AS INT) ELSE 0 END)
    ELSE CASE p.zone {_ABBREVIATED} END END AS minutes,
  CASE WHEN regexp_full_match(s, '[0-9]{{1,19}}([.][0-9]+)?') THEN split_part(s, '.', 1)::HUGEINT END AS number, split_part(s, '.', 2) AS part FROM timed),
around AS (
  SELECT *, {_LOCAL.format("wall - 86400000000")} AS o1, {_LOCAL.format("wall + 86400000000")} AS o2 FROM walled),
inst AS (
  SELECT row_no, CASE
      WHEN number BETWEEN 978307200 AND 4133980799 THEN number * 1000000 + rpad(part[1:6], 6, '0')::BIGINT
      WHEN number BETWEEN 978307200000 AND 4133980799999 THEN number * 1000 + rpad(part[1:3], 3, '0')::BIGINT
      WHEN number BETWEEN 978307200000000 AND 4133980799999999 THEN number
      WHEN number BETWEEN 978307200000000000 AND 4133980799999999999 THEN number // 1000
      WHEN number IS NOT NULL OR wall IS NULL THEN NULL
      WHEN minutes IS NOT NULL THEN wall - minutes * 60000000::BIGINT
      WHEN p.zone <> '' THEN NULL
      WHEN clock_zone IS NULL THEN wall
      WHEN o1 = o2 THEN wall - o1
      WHEN ok1 AND ok2 THEN CASE WHEN greatest(wall - o1, wall - o2) <= epoch_us(received_at) THEN greatest(wall - o1, wall - o2) ELSE least(wall - o1, wall - o2) END
      WHEN ok2 AND NOT ok1 THEN wall - o2 ELSE wall - o1 END::BIGINT AS utc_us
  FROM (SELECT *, {_LOCAL.format("wall - o1")} = o1 AS ok1, {_LOCAL.format("wall - o2")} = o2 AS ok2 FROM around))"""

_UTC_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+]00:00)"
_SURPLUS = f"""surplus AS (SELECT row_no FROM (SELECT row_no, k, row_number() OVER (PARTITION BY k ORDER BY received_at, row_no) AS n
  FROM (SELECT row_no, received_at, {ID} AS k FROM idr_events)) WHERE k IS NOT NULL AND n > 1)"""
_SESSIONS = f"""placed AS (SELECT {HOST} AS host, utc_us, CAST(s.row_no IS NULL AS INT) AS once FROM idr_events e JOIN inst i ON e.row_no = i.row_no LEFT JOIN surplus s ON s.row_no = e.row_no
  WHERE utc_us IS NOT NULL),
cut AS (SELECT *, coalesce(CAST(utc_us - lag(utc_us) OVER (PARTITION BY host ORDER BY utc_us) > 1800000000 AS INT), 0) AS fresh FROM placed),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY utc_us ROWS UNBOUNDED PRECEDING) AS no FROM cut)"""

#: The objects below kind and metadata of each event: one step down per recursion.
_NESTED = """ev AS (SELECT window_id, unnest(events) AS e, generate_subscripts(events, 1) - 1 AS event_pos FROM labeled_windows),
tops AS (SELECT window_id, event_pos, 'kind' AS root, e.kind AS doc FROM ev UNION ALL SELECT window_id, event_pos, 'metadata', e.metadata FROM ev),
walk(window_id, event_pos, root, parent, path, doc, depth) AS (
  SELECT window_id, event_pos, root, '', root, doc::JSON, 0 FROM tops WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'
  UNION ALL
  SELECT window_id, event_pos, root, CASE kind WHEN 'OBJECT' THEN path ELSE parent END, path || step, CASE WHEN decoded IS NULL THEN child ELSE decoded END, depth + 1
  FROM (
    SELECT *, CASE WHEN kind = 'OBJECT' AND root = 'metadata' AND json_type(child) = 'VARCHAR' AND json_valid(child ->> '$')
        AND json_type(child ->> '$') IN ('OBJECT', 'ARRAY') THEN (child ->> '$')::JSON END AS decoded
    FROM (
      SELECT window_id, event_pos, root, parent, path, depth, 'OBJECT' AS kind, '.' || key AS step, json_extract(doc, '$."' || key || '"') AS child
      FROM (SELECT *, unnest(json_keys(doc)) AS key FROM walk WHERE json_type(doc) = 'OBJECT')
      UNION ALL
      SELECT window_id, event_pos, root, parent, path, depth, 'ARRAY', '[' || i || ']', json_extract(doc, '$[' || i || ']')
      FROM (SELECT *, unnest(range(json_array_length(doc)::BIGINT)) AS i FROM walk WHERE json_type(doc) = 'ARRAY')))
  WHERE decoded IS NOT NULL OR json_type(child) IN ('OBJECT', 'ARRAY'))"""

#: Fields of each file, and those that came or left against the file before.  Renames where one field left and one came only.
_DRIFT = """leaf AS (SELECT feed, file_seq, replace(t.fullkey[3:], '"', '') AS path, t.type, t.atom ->> '$' AS value FROM landed_lines l, json_tree(l.payload) t
  WHERE feed IS NOT NULL AND file_seq IS NOT NULL AND t.type <> 'OBJECT' AND NOT contains(t.fullkey, '[')),
named AS (SELECT feed, file_seq, path, list_sort(list(DISTINCT CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'DOUBLE' THEN 'fraction'
    ELSE 'integer' END) FILTER (type <> 'NULL')) AS kinds, list_sort(list(DISTINCT value) FILTER (type = 'VARCHAR' AND path = 'feature_schema_hash')) AS hashes FROM leaf GROUP BY ALL),
field AS (SELECT feed, file_seq, path, hashes, CASE WHEN kinds IS NULL THEN NULL WHEN len(kinds) = 1 THEN kinds[1] WHEN kinds = ['fraction', 'integer'] THEN 'fraction' ELSE 'text' END AS kind FROM named),
step AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed, file_seq FROM landed_lines WHERE feed IS NOT NULL AND file_seq IS NOT NULL)),
after AS (SELECT f.*, true AS here FROM field f JOIN step s USING (feed, file_seq) WHERE prev IS NOT NULL),
before AS (SELECT s.feed, s.file_seq, f.path, f.kind AS old_kind, f.hashes AS old_hashes, true AS there FROM step s JOIN field f ON f.feed = s.feed AND f.file_seq = s.prev),
met AS (SELECT *, here IS NOT NULL AS is_new, there IS NOT NULL AS is_old FROM after FULL JOIN before USING (feed, file_seq, path)),
moved AS (SELECT *, regexp_replace(path, '[^.]*$', '') AS parent, coalesce(kind, old_kind) AS sort FROM met WHERE NOT (is_new AND is_old)),
lone AS (SELECT feed, file_seq, max(path) FILTER (is_old) AS gone, max(path) FILTER (is_new) AS come FROM moved WHERE sort IS NOT NULL
  GROUP BY feed, file_seq, parent, sort HAVING count_if(is_old) = 1 AND count_if(is_new) = 1)"""

SQL = {
    "p2_found": f"SELECT DISTINCT {HOST} AS host, {KIND} AS kind_type FROM idr_events",
    "p2_cells": f"""WITH {INSTANTS}, {_SURPLUS} SELECT {HOST} AS host, {KIND} AS kind_type, count(*) AS n_events,
  CAST(sum(CASE upper(severity) WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'IMPOSSIBLE' THEN 5 ELSE 0 END) AS BIGINT) AS severity_total,
  max(utc_us) AS last_us FROM idr_events JOIN inst USING (row_no) ANTI JOIN surplus USING (row_no) GROUP BY ALL""",
    "p3_found": f"WITH {INSTANTS}, {_SURPLUS}, {_SESSIONS} SELECT host, min(utc_us) AS start_us, max(utc_us) AS end_us FROM numbered GROUP BY host, no",
    "p3_sessions": f"""WITH {INSTANTS}, {_SURPLUS}, {_SESSIONS} SELECT host, min(utc_us) AS start_us, max(utc_us) AS end_us,
  max(utc_us) - min(utc_us) AS duration_us, CAST(sum(once) AS BIGINT) AS n_events FROM numbered GROUP BY host, no""",
    "p4_found": f"""WITH {INSTANTS} SELECT row_no, utc_us FROM inst JOIN idr_events USING (row_no)
  WHERE utc_us IS NOT NULL AND NOT coalesce(regexp_full_match("timestamp", '{_UTC_ISO}'), false)""",
    "p4_instants": f"WITH {INSTANTS} SELECT row_no, utc_us FROM inst",
    "p5_found": f"WITH RECURSIVE {_NESTED} SELECT window_id, CAST(event_pos AS INT) AS event_pos, parent AS parent_path, path AS node_path FROM walk WHERE depth > 0 AND json_type(doc) = 'OBJECT'",
    "p7_found": f"""WITH {_DRIFT} SELECT feed, file_seq, 'retyped' AS change_kind, path AS field_path, '' AS new_path FROM met WHERE is_new AND is_old AND kind <> old_kind
  UNION ALL SELECT feed, file_seq, 'rehashed', path, '' FROM met WHERE is_new AND is_old AND path = 'feature_schema_hash' AND hashes <> old_hashes
  UNION ALL SELECT feed, file_seq, 'renamed', gone, come FROM lone
  UNION ALL SELECT feed, file_seq, CASE WHEN is_old THEN 'removed' ELSE 'added' END, path, '' FROM moved m
    WHERE NOT EXISTS (FROM lone l WHERE l.feed = m.feed AND l.file_seq = m.file_seq AND m.path IN (l.gone, l.come))""",
    "p7_unreadable": """SELECT line_id, feed, file_seq, CASE WHEN feed IS NULL OR file_seq IS NULL THEN 'no feed or file_seq' ELSE 'payload is no JSON object' END AS problem
  FROM landed_lines WHERE feed IS NULL OR file_seq IS NULL OR payload IS NULL OR NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT'""",
    "p6_found": f"WITH {_SURPLUS} SELECT row_no FROM surplus",
    "p6_once": f"WITH {_SURPLUS} SELECT * REPLACE (epoch_us(received_at) AS received_at) FROM idr_events ANTI JOIN surplus USING (row_no)",
}
