"""Deeply nested JSON to related flat tables, by a bottom-up tree automaton.

A node's state follows from its own form and its children's states: scalars
have one state per JSON type, a list the set of its elements' states, an object
its sorted (key, state) pairs.  Objects with the same state have the same
shape and go to the same typed table; all of them keep the supertype's keys
(record, position, path) and the path of their parent.

Values are typed where the record is read: ``fields`` holds them in one array
per type, and which member lies where follows from the shape
(``variant_columns``), so one write takes the typed rows of every shape and no
table is parsed again.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ["parent_path", "node_path", "depth", "shape_id", "shape", "fields"]
_SCALAR = {str: "s", bool: "b", int: "i", float: "f", type(None): "n"}
#: By state: the type of a member's column and the array of ``fields`` it is kept in; g is an integer beyond 64 bits, kept as its digits.
_TYPES = {"s": ("string", "texts"), "i": ("bigint", "integers"), "f": ("double", "fractions"), "b": ("boolean", "flags"), "g": ("string", "texts")}
#: The arrays of ``fields``; lists of one scalar type are kept whole in those of the second half.
_ARRAYS = ["texts", "integers", "fractions", "flags", "text_lists", "integer_lists", "fraction_lists", "flag_lists"]
_ARROW = [pa.string(), pa.int64(), pa.float64(), pa.bool_()] * 2
_DDL = ["string", "bigint", "double", "boolean"]
FIELDS_DDL = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in zip(_ARRAYS, _DDL + [f"array<{t}>" for t in _DDL], strict=True)) + ">"
#: Transitions that a worker remembers; beyond that it starts afresh.
MEMO = 100_000


class Automaton:
    """States of objects, named by a hash of the transition that reaches them, each with the plan by which its values are typed."""

    def __init__(self) -> None:
        self.states: dict[str, tuple[str, list]] = {}

    def state(self, shape: str, members: list[tuple[str, str]]) -> tuple[str, list]:
        found = self.states.get(shape)
        if found is None:
            if len(self.states) >= MEMO:
                self.states.clear()
            found = self.states[shape] = xxhash.xxh64_hexdigest("{" + shape + "}"), _plan(members)
        return found


_TOKEN = re.compile(r"[ \t\r\n]*([\[\]{},:]|\"|-?[0-9][0-9.eE+-]*|true|false|null)")
_WORDS = {"true": True, "false": False, "null": None}


def _not_json(word: str):
    raise ValueError(f"{word} is not JSON")


def _decode_deep(text: str):
    """As ``json.loads``, without recursion: for values nested deeper than the interpreter's stack."""
    at, holders, key, done, want = 0, [], [], None, "value"
    while True:
        token = _TOKEN.match(text, at)
        if not token:
            raise ValueError(f"no JSON at {at}")
        word, at = token[1], token.end()
        if word in "]}" and want in ("end", "first"):
            if not holders or (word == "]") != (type(holders[-1]) is list):
                raise ValueError(f"{word} at {at}")
            done = holders.pop()
            key.pop()
        elif word == "," and want == "end" and holders:
            want = "value" if type(holders[-1]) is list else "key"
            continue
        elif word == '"' and (want == "key" or (want == "first" and type(holders[-1]) is dict)):
            key[-1], at = json.decoder.scanstring(text, at, True)
            colon = _TOKEN.match(text, at)
            if not colon or colon[1] != ":":
                raise ValueError(f"no colon at {at}")
            at, want = colon.end(), "value"
            continue
        elif want == "value" or (want == "first" and type(holders[-1]) is list):
            if word in "[{":
                holders.append([] if word == "[" else {})
                key.append(None)
                want = "first"
                continue
            if word == '"':
                done, at = json.decoder.scanstring(text, at, True)
            elif word in _WORDS:
                done = _WORDS[word]
            else:
                done = json.loads(word)
        else:
            raise ValueError(f"{word} at {at}")
        if not holders:
            if text[at:].strip(" \t\r\n"):
                raise ValueError(f"more than one value at {at}")
            return done
        if type(holders[-1]) is list:
            holders[-1].append(done)
        else:
            holders[-1][key[-1]] = done
        want = "end"


def decode(text: str | None):
    """The JSON value of a text, however deeply it is nested; None where it is no JSON."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_not_json)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _decode_deep(text)
    except ValueError:
        return None


def _decoded_text(value: str):
    """The object or list that a text stands for, else the text."""
    head = value.lstrip(" \t\r\n")[:1]
    if head == "{" or head == "[":
        found = decode(value)
        if isinstance(found, (dict, list)):
            return found
    return value


def _scalar_state(value) -> str:
    state = _SCALAR[type(value)]
    return "g" if state == "i" and not -(1 << 63) <= value < 1 << 63 else state


def _kinds(state: str) -> set[str]:
    """The states of the elements of a list with this state."""
    out, level, start = set(), 0, 1
    for at, sign in enumerate(state):
        if level == 1 and sign in "|]" and at > start:
            out.add(state[start:at])
            start = at + 1
        level += {"[": 1, "]": -1}.get(sign, 0)
    return out


def _column(state: str) -> tuple[str, str | None] | None:
    """Type of the column of a member with this state, and its array of ``fields``; a null needs no array.

    Lists of one scalar type, with or without nulls, are typed; so are empty ones,
    as text.  Objects and lists of them have no column, since objects are rows
    whose paths tell their positions.  Any other list is kept as JSON text, with
    null for the objects in it.
    """
    if state[0] != "[":
        return ("string", None) if state == "n" else _TYPES.get(state)
    kinds = _kinds(state)
    if not kinds:
        return "array<string>", "text_lists"
    held = kinds - {"n"}
    if len(held) == 1 and held <= _TYPES.keys():
        kind, array = _TYPES[held.pop()]
        return f"array<{kind}>", f"{array[:-1]}_lists"
    return None if held and all(k[0] != "[" and k not in _TYPES for k in held) else ("string", "texts")


def _list_text(value: list) -> str:
    """JSON text of a list, however deep, with null for the objects in it."""
    out, todo = [], [(value,)]
    while todo:
        item = todo.pop()
        if type(item) is str:
            out.append(item)
            continue
        (item,) = item
        if type(item) is list:
            out.append("[")
            todo.append("]")
            for k in range(len(item) - 1, -1, -1):
                todo.append((item[k],))
                if k:
                    todo.append(",")
        else:
            out.append("null" if type(item) is dict else json.dumps(item))
    return "".join(out)


def _digits(value: list) -> list:
    return [None if x is None else str(x) for x in value]


def _plan(members: list[tuple[str, str]]) -> list[tuple]:
    """(key, place of its array, function to apply or None) of each member of a shape that is kept in ``fields``."""
    out = []
    for key, state in members:
        column = _column(state)
        if column and column[1]:
            apply = str if state == "g" else None
            if state[0] == "[":
                apply = _list_text if column[0] == "string" else _digits if "g" in _kinds(state) else None
            out.append((key, _ARRAYS.index(column[1]), apply))
    return out


_NOTHING = ()


def _typed(value: dict, plan: list[tuple]) -> list:
    """The arrays of ``fields`` for an object."""
    arrays: list = [_NOTHING] * len(_ARRAYS)
    for key, at, apply in plan:
        item = apply(value[key]) if apply else value[key]
        if arrays[at]:
            arrays[at].append(item)
        else:
            arrays[at] = [item]
    return arrays


def walk(top: dict, root: str, text_is_json: bool, automaton: Automaton, as_text: bool = False) -> list[tuple]:
    """(parent_path, node_path, depth, shape_id, shape, fields) of ``top`` and every object below it.

    Iterative in two passes: down to list the nodes, then back up to find the
    states, each node after all nodes below it.
    """
    # a node: value, nearest object's path, own path, depth, index of the containing node, key
    nodes: list[list] = [[top, None, root, 0, -1, ""]]
    i = 0
    while i < len(nodes):
        value, parent, path, depth, _, _ = nodes[i]
        if type(value) is dict:
            for key, child in value.items():
                if text_is_json and type(child) is str:
                    child = _decoded_text(child)
                    if type(child) is not str:
                        value = nodes[i][0] = {**value, key: child}
                if type(child) is dict or type(child) is list:
                    nodes.append([child, path, f"{path}.{key}", depth + 1, i, key])
        else:
            for k, child in enumerate(value):
                if type(child) is dict or type(child) is list:
                    nodes.append([child, parent, f"{path}[{k}]", depth, i, ""])
        i += 1
    below: list[dict | set] = [{} if type(n[0]) is dict else set() for n in nodes]
    out = []
    for i in range(len(nodes) - 1, -1, -1):
        value, parent, path, depth, holder, key = nodes[i]
        if type(value) is dict:
            states = below[i]
            members = [(k, states.get(k) or _scalar_state(value[k])) for k in sorted(value)]
            shape = ",".join(f"{json.dumps(k)}:{state}" for k, state in members)
            name, plan = automaton.state(shape, members)
            fields = json.dumps({k: v for k, v in value.items() if k not in states}) if as_text else _typed(value, plan)
            out.append((parent, path, depth, name, shape, fields))
        else:
            kinds = below[i] | {_scalar_state(x) for x in value if type(x) in _SCALAR}
            name = "[" + "|".join(sorted(kinds)) + "]"
        if holder >= 0:
            if type(nodes[holder][0]) is dict:
                below[holder][key] = name
            else:
                below[holder].add(name)
    out.reverse()
    return out


def _texts(values: list) -> pa.Array:
    """Half a surrogate pair, which JSON can escape but UTF-8 not hold, becomes U+FFFD."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v and v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def _lists(values: list, of: pa.DataType, levels: int) -> pa.Array:
    """An array of the lists in ``values``, which are lists of lists at two levels; nothing is null, which takes less room."""
    ends = pa.array(itertools.accumulate(map(len, values), initial=0), pa.int32())
    flat = list(itertools.chain.from_iterable(values))
    below = _lists(flat, of, 1) if levels > 1 else _texts(flat) if of == pa.string() else pa.array(flat, of)
    return pa.ListArray.from_arrays(ends, below, mask=pa.array([v is _NOTHING for v in values], pa.bool_()))


def _fields(rows: list[list]) -> pa.Array:
    made = [_lists([r[at] for r in rows], of, 1 if at < len(_DDL) else 2) for at, of in enumerate(_ARROW)]
    return pa.StructArray.from_arrays(made, names=_ARRAYS)


def _walk_batches(keys: list[str], docs: list[tuple[str, bool]], include_top: bool, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            for doc, text_is_json in docs:
                for i, text in enumerate(batch.column(doc).to_pylist()):
                    value = decode(text)
                    if type(value) is not dict:
                        continue
                    found = walk(value, doc, text_is_json, automaton, as_text)
                    if not include_top:
                        found = found[1:]
                    rows.extend(found)
                    take.extend([i] * len(found))
            if not as_text:
                # equal shapes side by side: what is shuffled is compressed in blocks
                order = sorted(range(len(rows)), key=lambda at: rows[at][4])
                rows, take = [rows[at] for at in order], [take[at] for at in order]
            parent, path, depth, shape_id, shape, fields = zip(*rows, strict=True) if rows else [()] * len(NODE_COLUMNS)
            made = [_texts(parent), _texts(path), pa.array(depth, pa.int32()), _texts(shape_id), _texts(shape), _texts(fields) if as_text else _fields(fields)]
            kept = [batch.column(k).take(pa.array(take, pa.int64())) for k in keys]
            yield pa.record_batch([*kept, *made], names=[*keys, *NODE_COLUMNS])

    return run


def node_table(df: DataFrame, keys: list[str], docs: list[tuple[str, bool]], include_top: bool = True, as_text: bool = False) -> DataFrame:
    """Supertype table: one row per JSON object in the ``docs`` columns of ``df``.

    ``keys`` name the columns that identify a record; ``docs`` are pairs of a
    column of JSON text and whether text below it that is itself a JSON object or
    list counts as that.  Text that is null, no JSON, or at its top no object has
    no nodes; null and scalar list elements keep their positions.  ``fields`` has
    the object's own scalars and lists of scalars, typed (see
    ``variant_columns``), or with ``as_text`` the JSON text of its scalars, nested
    members left out.
    A narrow pass: nothing is shuffled.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = ["string", "string", "int", "string", "string", "string" if as_text else FIELDS_DDL]
    ddl = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} {t}" for n, t in zip(NODE_COLUMNS, kinds, strict=True)])
    needed = df.select(*[F.col(f"`{c}`") for c in [*keys, *(d for d, _ in docs)]])
    return needed.mapInArrow(_walk_batches(keys, docs, include_top, as_text), ddl)


def exploded_events(windows: DataFrame) -> DataFrame:
    """(window_id, event_pos, id, timestamp, source, severity, kind, metadata) of the events arrays.

    Positions count from 0 as stored; a null element keeps its position and
    yields a row of nulls; null and empty arrays yield none.
    """
    return windows.select("window_id", F.posexplode("events").alias("event_pos", "e")).select("window_id", "event_pos", "e.*")


def window_nodes(windows: DataFrame, include_top: bool = True, as_text: bool = False) -> DataFrame:
    """``node_table`` over kind and metadata of the events of labeled windows."""
    docs = [("kind", False), ("metadata", True)]
    return node_table(exploded_events(windows), ["window_id", "event_pos"], docs, include_top, as_text)


def shape_catalog(nodes: DataFrame) -> DataFrame:
    """(shape_id, shape, n_nodes): the subtype tables there are and their sizes."""
    return nodes.groupBy("shape_id").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n_nodes"))


#: Folders the variants' tables are kept in: a fixed number, since shapes have a long tail.
VARIANT_FOLDERS = 64


def _folder(shape_id: Column) -> Column:
    return F.pmod(F.xxhash64(shape_id), F.lit(VARIANT_FOLDERS)).cast("int")


def write_variants(nodes: DataFrame, path: str, salt: int = 16) -> DataFrame:
    """Route every node, typed, to its variant's table: one write, shapes sorted within a fixed number of folders.

    A frequent shape is spread over ``salt`` tasks, so no task holds all of it.
    Gives back what was written, all variants together; no nodes are an empty table.
    """
    spread = F.pmod(F.xxhash64("node_path", "fields"), F.lit(salt))
    placed = nodes.withColumn("folder", _folder(F.col("shape_id"))).repartition("folder", spread)
    placed.sortWithinPartitions("folder", "shape_id").write.partitionBy("folder").parquet(path)
    return nodes.sparkSession.read.schema(placed.schema).parquet(path)


def read_variant(spark: SparkSession, path: str, shape_id: str, shape: str) -> DataFrame:
    """The typed table of one shape out of what ``write_variants`` wrote; only its folder is read, and in it only its row groups."""
    own = spark.read.parquet(path).where(F.col("folder") == _folder(F.lit(shape_id)))
    return variant_table(own.drop("folder"), shape_id, shape)


def variant_columns(shape: str) -> list[tuple[str, str, str | None, int]]:
    """(key, type, array of ``fields``, position in it) of the columns of a shape: its scalars and lists of scalars."""
    used: Counter = Counter()
    out = []
    for key, state in parse_shape(shape):
        column = _column(state)
        if column:
            out.append((key, *column, used[column[1]]))
            used[column[1]] += 1
    return out


def parse_shape(shape: str) -> list[tuple[str, str]]:
    """The (key, state) pairs of a shape text."""
    reader, at, out = json.JSONDecoder(), 0, []
    while at < len(shape):
        key, at = reader.raw_decode(shape, at)
        stop, level = at + 1, 0
        while stop < len(shape) and (level or shape[stop] != ","):
            level += {"[": 1, "]": -1}.get(shape[stop], 0)
            stop += 1
        out.append((key, shape[at + 1 : stop]))
        at = stop + 1
    return out


def variant_table(nodes: DataFrame, shape_id: str, shape: str) -> DataFrame:
    """The typed table of one shape: the supertype's columns and a struct ``value`` of its members."""
    own = nodes.where(F.col("shape_id") == shape_id).drop("shape")
    columns = [(F.get(f"fields.{array}", F.lit(at)) if array else F.lit(None).cast(kind)).alias(key) for key, kind, array, at in variant_columns(shape)]
    return own.withColumn("value", F.struct(*columns) if columns else F.lit(None)).drop("fields")
