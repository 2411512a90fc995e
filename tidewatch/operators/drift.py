"""Schemas that drift between files: profile, match, report, unify.

A narrow pass profiles the fields of each file (type, nulls, a bottom-k sketch
of the values), partly aggregated per Arrow batch, so that what is shuffled is
as large as the schemas and not as the data.  Consecutive files of a feed are
compared field by field; fields that left and came are matched as a bipartite
graph weighted by name similarity and value overlap.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.nested import decode
from tidewatch.runtime import materialise

SKETCH = 16
#: Similarity a rename needs where several fields could be meant.
LIKENESS = 0.3
HASH_FIELD = "feature_schema_hash"
_KIND = {str: "text", bool: "boolean", int: "integer", float: "fraction", list: "list", type(None): "null"}
PROFILE = "feed string, file_seq int, field_path string, kind string, n bigint, sketch array<bigint>, hash string"


def leaves(value: dict) -> list[tuple[str, object]]:
    """(dotted path, value) of everything in ``value`` that is not an object."""
    stack, out = [("", value)], []
    while stack:
        prefix, node = stack.pop()
        for key, child in node.items():
            if type(child) is dict:
                stack.append((f"{prefix}{key}.", child))
            else:
                out.append((prefix + key, child))
    return out


def _sketch_hash(value: object) -> int:
    text = value if type(value) is str else json.dumps(value)
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feed", pa.string()), ("file_seq", pa.int32()), ("field_path", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("hash", pa.string())])
    for batch in batches:
        seen: dict[tuple, list] = {}
        files = zip(batch.column("feed").to_pylist(), batch.column("file_seq").to_pylist(), batch.column("payload").to_pylist(), strict=True)
        for feed, seq, payload in files:
            value = decode(payload)
            if type(value) is not dict:
                continue
            for path, leaf in leaves(value):
                kind = _KIND[type(leaf)]
                mark = leaf if path == HASH_FIELD and kind == "text" else None
                cell = seen.setdefault((feed, seq, path, kind, mark), [0, set()])
                cell[0] += 1
                if kind != "null":
                    cell[1].add(_sketch_hash(leaf))
                    if len(cell[1]) > 8 * SKETCH:
                        cell[1] = set(sorted(cell[1])[:SKETCH])
        rows = [(f, s, p, k, n, sorted(h)[:SKETCH], m) for (f, s, p, k, m), (n, h) in seen.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def profiles(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, field_path, kind, n_values, n_null, sketch, hashes) of every field of every file.

    ``kind`` is text, integer, fraction, boolean or list by the non-null values
    (integers beside fractions are fractions, other mixtures text), null where
    there are none.  Lines landed twice change only the counts.  Payloads that are
    no JSON object, and lines without feed or file_seq, carry no field.
    """
    raw = lines.where(F.col("feed").isNotNull() & F.col("file_seq").isNotNull()).select("feed", "file_seq", "payload")
    parts = raw.mapInArrow(_profile, PROFILE)
    kinds = F.array_remove(F.sort_array("kinds"), "null")
    kind = (
        F.when(F.size(kinds) == 0, F.lit(None))
        .when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
        .when(F.array_size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("fraction")))) == 0, "fraction")
        .otherwise("text")
    )
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH)
    return (
        parts.groupBy("feed", "file_seq", "field_path")
        .agg(
            F.collect_set("kind").alias("kinds"),
            F.sum("n").alias("n_values"),
            F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("n_null"),
            smallest.alias("sketch"),
            F.sort_array(F.collect_set("hash")).alias("hashes"),
        )
        .select("feed", "file_seq", "field_path", kind.alias("kind"), "n_values", "n_null", "sketch", "hashes")
    )


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight bipartite matching of the smaller side (Hungarian method)."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights).astype(float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < least[free]
            least[free[better]] = slack[better]
            back[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def words(path: str) -> set[str]:
    """The lower-case words of a field's last part, split at underscores, digits and capitals."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", path.rpartition(".")[2])}


def likeness(old: str, new: str, old_sketch: list[int], new_sketch: list[int]) -> float:
    """Similarity in [0, 1] of two fields: words and letters of the names, overlap of the values."""
    a, b = words(old), words(new)
    shared = len(a & b) / max(1, min(len(a), len(b)))
    letters = SequenceMatcher(None, old.rpartition(".")[2].lower(), new.rpartition(".")[2].lower()).ratio()
    x, y = set(old_sketch), set(new_sketch)
    values = len(x & y) / max(1, min(len(x), len(y)))
    return 0.4 * shared + 0.4 * letters + 0.2 * values


def _matched(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in frame.itertuples(index=False):
        left, came = list(row.left), list(row.came)
        weights = np.array([[likeness(a["path"], b["path"], a["sketch"], b["sketch"]) for b in came] for a in left])
        lone = len(left) == len(came) == 1
        for i, j in assign(weights):
            if lone or weights[i, j] >= LIKENESS:
                out.append((row.feed, row.file_seq, left[i]["path"], came[j]["path"]))
    return pd.DataFrame(out, columns=["feed", "file_seq", "field_path", "new_path"])


def _match_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield _matched(frame).astype({"file_seq": "int32"})


def file_fields(lines: DataFrame) -> DataFrame:
    """``profiles`` without the counts, written once: as large as the schemas, and read several times."""
    return materialise(profiles(lines).select("feed", "file_seq", "field_path", "kind", "sketch", "hashes"), "profiles")


def changes(lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(feed, file_seq, change_kind, field_path, new_path): what changed against the file before.

    The file before is the one of the same feed with the next lower file_seq
    that has any line.  ``renamed``: of the fields that left and those that came
    with the same type and parent, the pair if there is one of each, else the
    pairs of the best matching that are alike by ``LIKENESS``; the rest is
    ``removed`` and ``added``.  ``retyped``: both files know the type and it
    differs.  ``rehashed``: both files have values of feature_schema_hash and they
    differ.  The first file of a feed has no changes; no lines give no rows.
    ``fields`` are the ``file_fields`` of the lines where they are known already.
    """
    fields = file_fields(lines) if fields is None else fields
    files = lines.where(F.col("feed").isNotNull() & F.col("file_seq").isNotNull()).select("feed", "file_seq").distinct()
    before = F.lag("file_seq").over(Window.partitionBy("feed").orderBy("file_seq"))
    steps = files.select("feed", "file_seq", before.alias("prev_seq")).where(F.col("prev_seq").isNotNull())
    new = steps.select("feed", "file_seq").join(fields, ["feed", "file_seq"])
    old = steps.join(fields.withColumnRenamed("file_seq", "prev_seq"), ["feed", "prev_seq"]).select(
        "feed", "file_seq", "field_path", F.col("kind").alias("old_kind"), F.col("sketch").alias("old_sketch"), F.col("hashes").alias("old_hashes"), F.lit(True).alias("was")
    )
    both = new.withColumn("is", F.lit(True)).join(old, ["feed", "file_seq", "field_path"], "full_outer")
    base = ["feed", "file_seq"]
    same = both.where(F.col("is") & F.col("was"))
    blank = F.lit("").alias("new_path")
    retyped = same.where(F.col("kind") != F.col("old_kind")).select(*base, F.lit("retyped").alias("change_kind"), "field_path", blank)
    rehashed = same.where((F.col("field_path") == HASH_FIELD) & (F.size("hashes") > 0) & (F.size("old_hashes") > 0) & (F.col("hashes") != F.col("old_hashes"))).select(
        *base, F.lit("rehashed").alias("change_kind"), "field_path", blank
    )
    parent = F.regexp_replace("field_path", r"[^.]*$", "")
    gone, fresh = F.col("is").isNull(), F.col("was").isNull()
    moved = both.where(gone | fresh).select(
        *base, "field_path", parent.alias("parent"), F.coalesce("kind", "old_kind").alias("type"), gone.alias("gone"), F.coalesce("sketch", "old_sketch").alias("sketch")
    )
    cell = F.struct(F.col("field_path").alias("path"), "sketch")
    moved = materialise(moved, "moved")
    groups = (
        moved.groupBy(*base, "parent", "type")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("gone"), cell))).alias("left"),
            F.sort_array(F.collect_list(F.when(~F.col("gone"), cell))).alias("came"),
        )
        .where(F.col("type").isNotNull() & (F.size("left") > 0) & (F.size("came") > 0))
        .select(*base, "left", "came")
    )
    renames = materialise(groups.mapInPandas(_match_batches, "feed string, file_seq int, field_path string, new_path string"), "renames")
    renamed = renames.select(*base, F.lit("renamed").alias("change_kind"), "field_path", "new_path")
    used = renames.select(*base, F.explode(F.array("field_path", "new_path")).alias("field_path"))
    plain = moved.join(used, [*base, "field_path"], "left_anti").select(
        *base, F.when(F.col("gone"), "removed").otherwise("added").alias("change_kind"), "field_path", blank
    )
    return retyped.unionByName(rehashed).unionByName(renamed).unionByName(plain)


def _chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The name under which each field of each file of one feed is unified: that of its first appearance.

    A field missing from some files keeps its name for when it comes back.  No two
    fields of a file share one: a newcomer whose name another field of the file is
    unified under gets ``name@file_seq``.  If only an absent field is unified under
    it, the newcomer is taken for that field under its first name.
    """
    frame = frame.sort_values(["file_seq"])
    known: dict[str, str] = {}
    absent: dict[str, str] = {}
    out = []
    for row in frame.itertuples(index=False):
        pairs = dict(zip(row.renamed_from, row.renamed_to, strict=True))
        names = {b: known[a] for a, b in pairs.items()}
        absent |= {p: c for p, c in known.items() if p not in pairs}
        # of the present paths, what they were called when last seen; a renamed field's name goes before its new path's
        names |= {p: absent[p] for p in row.paths if p in absent and p not in names}
        used = set(names.values())
        for p in row.paths:
            if p not in names:
                name = p if p not in used else f"{p}@{row.file_seq}"
                while name in used or name != p and name in absent.values():  # a field may itself be called so
                    name += "@"
                names[p] = name
                used.add(name)
        known = names
        absent = {p: c for p, c in absent.items() if p not in known and c not in used}
        out.extend((key[0], row.file_seq, p, c) for p, c in known.items())
    return pd.DataFrame(out, columns=["feed", "file_seq", "field_path", "canonical_path"]).astype({"file_seq": "int32"})


def canonical_fields(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, field_path, canonical_path): every field under its first name in the feed.

    One group per feed, as large as its files times their fields, not its lines.
    """
    known = file_fields(lines)
    renamed = changes(lines, known).where(F.col("change_kind") == "renamed")
    pairs = renamed.groupBy("feed", "file_seq").agg(F.sort_array(F.collect_list(F.struct("field_path", "new_path"))).alias("p"))
    fields = known.groupBy("feed", "file_seq").agg(F.sort_array(F.collect_set("field_path")).alias("paths"))
    none = F.array().cast("array<string>")
    steps = fields.join(pairs, ["feed", "file_seq"], "left").select(
        "feed", "file_seq", "paths", F.coalesce("p.field_path", none).alias("renamed_from"), F.coalesce("p.new_path", none).alias("renamed_to")
    )
    return steps.groupBy("feed").applyInPandas(_chain, "feed string, file_seq int, field_path string, canonical_path string")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["line_id", "feed", "file_seq", "field_path", "value"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for line, feed, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("line_id", "feed", "file_seq", "payload")), strict=True):
            value = decode(payload)
            if type(value) is dict:
                rows.extend((line, feed, seq, p, x if type(x) is str else None if x is None else json.dumps(x)) for p, x in leaves(value))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """(line_id, feed, file_seq, problem) of the lines that no table is made of: no place named, or no JSON object."""
    nowhere = F.col("feed").isNull() | F.col("file_seq").isNull()
    shape = F.schema_of_variant(F.try_parse_json("payload"))
    # text the strict parser refuses may still be an object to the lenient one (a repeated key, say)
    broken = ~F.coalesce(shape.startswith("OBJECT"), F.json_object_keys("payload").isNotNull())
    problem = F.when(nowhere, "no feed or file_seq").when(broken, "payload is no JSON object")
    return lines.select("line_id", "feed", "file_seq", problem.alias("problem")).where(F.col("problem").isNotNull())


def unified_lines(lines: DataFrame) -> DataFrame:
    """(line_id, record_sort, fields): every line under the unified names, one row per line_id.

    ``record_sort`` is ``finding`` or ``event`` by the feed's name; ``fields`` maps
    canonical path to value as text (lists and numbers as JSON).  A line without a
    readable payload has no row here but one in ``unreadable_lines``.
    """
    # a line landed twice under one line_id counts once; which copy is the same whichever is taken
    raw = lines.where(F.col("feed").isNotNull() & F.col("file_seq").isNotNull()).select("line_id", "feed", "file_seq", "payload")
    cells = raw.mapInArrow(_values, "line_id bigint, feed string, file_seq int, field_path string, value string")
    named = cells.join(canonical_fields(lines), ["feed", "file_seq", "field_path"])
    pair = F.struct(F.col("canonical_path"), F.col("value"))
    return named.groupBy("line_id", "feed").agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("fields")).select(
        "line_id", F.when(F.col("feed").startswith("findings."), "finding").otherwise("event").alias("record_sort"), "fields"
    )


# The columns of the unified tables and their types.
FINDING_COLUMNS = {
    "campaign_id": "string", "escalation_probability": "double", "raw_escalation_probability": "double", "calibration": "string",
    "predicted_next_stage": "string", "model_version": "string", "graph_nodes": "bigint", "engine_version": "string",
    "feature_schema_hash": "string", "scored_at": "string", "continues_campaign": "boolean", "windows_observed": "bigint",
    "related_entities": "array<string>", "evidence_event_ids": "array<string>", "applied_suppressions": "array<string>",
}
EVENT_COLUMNS = {"id": "string", "timestamp": "string", "source": "string", "severity": "string", "kind.type": "string"}


def typed_table(unified: DataFrame, sort: str, columns: dict[str, str]) -> DataFrame:
    """The lines of one sort with ``columns`` cast to their types and the other fields left in ``rest``.

    A value that does not fit its column's type gives null there and stays in ``rest``.
    """
    out = []
    fits = []
    for path, kind in columns.items():
        text = F.try_element_at("fields", F.lit(path))
        value = F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)
        out.append(value.alias(path.replace(".", "_")))
        fits.append(F.when(value.isNotNull(), F.lit(path)))
    taken = F.array_compact(F.array(*fits))
    rest = F.map_filter("fields", lambda k, _: ~F.array_contains(F.col("_tw_taken"), k))
    own = unified.where(F.col("record_sort") == sort)
    return own.select("line_id", *out, "fields", taken.alias("_tw_taken")).withColumn("rest", rest).drop("fields", "_tw_taken")
