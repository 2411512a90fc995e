"""Entities, relations and features of events, as column expressions over their JSON text.

A kind is parsed once, to a map of variants; a second map holds form, text and
truth of each member, and all rules read these.  Whether a key is
present, is not null, or is truthy are three different things; the tables in
``functions.rules`` say which a rule takes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from tidewatch import config
from tidewatch.functions import rules
from tidewatch.functions.events import UNKNOWN_HOST

MEMBERS = "_tw_members"
READ = "_tw_read"
META = "_tw_meta"


def lookup(table: dict, key: Column, default) -> Column:
    """A value of a small fixed table."""
    items = ", ".join(f"'{k}', {v!r}D" if isinstance(v, float) else f"'{k}', {v!r}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({items})"), key), F.lit(default))


@pandas_udf(IntegerType())
def _bucket(kinds: pd.Series) -> pd.Series:
    return kinds.map({k: config.kind_bucket(k) for k in kinds.dropna().unique()}).astype("Int32")


def kind_bucket(kind_type: Column, any_kind: bool = False) -> Column:
    """Bucket 0 to 3 of a kind.  Known kinds come from a table; others need ``any_kind`` and a vectorised UDF."""
    known = {k: config.kind_bucket(k) for k in config.KIND_PRIOR}
    found = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in known.items()) + ")"), kind_type)
    return F.coalesce(found, _bucket(kind_type)) if any_kind else found


def kept_apart(value: Column) -> Column:
    """The value, in a form the optimizer evaluates once per row where it is defined.

    The condition always holds.  Without it a projection is merged into the one
    above, where a lambda evaluates it once per element, and is copied into the
    filters inferred from an explode.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def members(text: Column) -> Column:
    """The members of a JSON object as a map of variants; empty for text that is none."""
    found = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.coalesce(found, F.create_map().cast("map<string,variant>"))


def rendered(value: Column, form: Column) -> Column:
    """The value as printed: strings unquoted, null as None, booleans capitalised, whole fractions with .0."""
    raw = value.cast("string")
    whole = form.rlike(r"^DECIMAL\(([1-9]|1[0-8]),0\)$")
    return F.when(form == "VOID", "None").when(form == "BOOLEAN", F.when(raw == "true", "True").otherwise("False")).when(whole, F.concat(raw, F.lit(".0"))).otherwise(raw)


def is_truthy(value: Column, form: Column) -> Column:
    """Whether the value counts as true: not absent, null, false, zero, or empty."""
    raw = value.cast("string")
    found = (
        F.when(form == "STRING", raw != "")
        .when(form == "VOID", False)
        .when(form == "BOOLEAN", raw == "true")
        .when(form.startswith("ARRAY") | form.startswith("OBJECT"), ~raw.isin("[]", "{}"))
        .otherwise(raw.try_cast("double") != 0)
    )
    return F.coalesce(found, F.lit(False))


def read_members(held: Column) -> Column:
    """form, text and truth of every member of a map of variants, by key."""
    formed = F.transform(F.map_values(held), lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("form")))
    read = F.transform(formed, lambda x: F.struct(x["form"].alias("form"), rendered(x["v"], x["form"]).alias("text"), is_truthy(x["v"], x["form"]).alias("truthy")))
    return F.map_from_arrays(F.map_keys(held), read)


def _read(key: str) -> Column:
    return F.try_element_at(F.col(READ), F.lit(key))


def given(key: str) -> Column:
    return _read(key)["form"] != "VOID"


def truthy(*keys: str) -> Column:
    hit = F.lit(False)
    for key in keys:
        hit = hit | F.coalesce(_read(key)["truthy"], F.lit(False))
    return hit


def present(*keys: str) -> Column:
    return F.arrays_overlap(F.map_keys(MEMBERS), F.array(*[F.lit(k) for k in keys]))


_FOLDS = {"plain": lambda c: c, "lower": F.lower, "domain": lambda c: F.rtrim(F.lower(c), F.lit("."))}


def _part(part: rules.Part) -> Column:
    """The entities of one sort: an array, distinct in order of appearance."""
    head = F.concat(F.lit(f"{part.name}:"), F.col("host"), F.lit(":")) if part.own else F.lit(f"{part.name}:")
    shape = lambda c: F.concat(head, _FOLDS[part.fold](c))
    spots = F.array(*[_read(k) for k in part.keys])
    counts = (lambda x: x["form"] != "VOID") if part.counts == "given" else (lambda x: x["truthy"])
    if part.pick == "first":
        best = F.coalesce(F.get(F.filter(spots, lambda x: x["truthy"]), F.lit(0)), _read(part.keys[-1]))
        spots = F.array(best)
    found = F.transform(F.filter(spots, lambda x: F.coalesce(counts(x), F.lit(False))), lambda x: shape(x["text"]))
    for key in part.lists:
        listed = F.try_variant_get(F.try_element_at(F.col(MEMBERS), F.lit(key)), "$", "array<variant>")
        texts = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: rendered(v, F.schema_of_variant(v)))
        found = F.concat(found, F.transform(texts, lambda t: F.concat(head, F.coalesce(t, F.lit("None")))))
    return F.array_distinct(found)


def with_parts(events: DataFrame) -> DataFrame:
    """Add the parts entities and relations are made of.

    ``events`` has kind_json and metadata_json.  Added: kind_type, host and one
    array per sort of entity (``_tw_<sort>``), each distinct in order of
    appearance, with its prefix.  Kinds and metadata that are no readable object
    are treated as empty ones.
    """
    kept = [c for c in events.columns if c not in ("kind_type", "host")]
    step = events.select(*kept, kept_apart(members(F.col("kind_json"))).alias(MEMBERS), kept_apart(members(F.col("metadata_json"))).alias(META))
    step = step.select(*kept, MEMBERS, kept_apart(read_members(F.col(MEMBERS))).alias(READ), kept_apart(read_members(F.col(META))).alias(META))
    of = [F.try_element_at(F.col(META), F.lit(k)) for k in ("host", "hostname")]
    named = F.coalesce(*[F.when(x["truthy"], x["text"]) for x in of])
    step = step.select(*kept, MEMBERS, READ, F.coalesce(named, F.lit(UNKNOWN_HOST)).alias("host"), F.coalesce(_read("type")["text"], F.lit("unknown")).alias("kind_type"))
    return step.select("*", *[kept_apart(_part(p)).alias(f"_tw_{p.name}") for p in rules.PARTS])


def entities() -> Column:
    """The event's entities, host first, distinct in order."""
    host = F.array(F.concat(F.lit("host:"), F.col("host")))
    return F.array_distinct(F.concat(host, *[F.col(f"_tw_{p.name}") for p in rules.PARTS]))


def relations() -> Column:
    """The event's relations as an array of (left, right, relation), in order of derivation."""
    host = F.concat(F.lit("host:"), F.col("host"))
    sides = {p.name: F.col(f"_tw_{p.name}") for p in rules.PARTS}
    sides |= {"host": F.array(host), "actor": F.when(F.size("_tw_process") > 0, F.col("_tw_process")).otherwise(F.array(host))}

    def pairs(held: dict[str, Column], left: str, right: str, name: str) -> Column:
        edge = lambda a, b: F.struct(a.alias("left"), b.alias("right"), F.lit(name).alias("relation"))
        return F.flatten(F.transform(held[left], lambda a: F.transform(held[right], lambda b: edge(a, b))))

    def block(each: str | None, triples) -> Column:
        if each is None:
            return F.concat(*[pairs(sides, *t) for t in triples])
        return F.flatten(F.transform(sides[each], lambda x: F.concat(*[pairs(sides | {each: F.array(x)}, *t) for t in triples])))

    return F.concat(*[block(each, triples) for each, triples in rules.RELATIONS])


def normalised_delta(seconds: Column) -> Column:
    return F.log1p(F.greatest(seconds, F.lit(0.0))) / F.lit(config.DELTA_LOG_DIVISOR)


def features(delta_seconds: Column | None = None, any_kind: bool = True) -> dict[str, Column]:
    """The 22 features by name, over the columns of ``with_parts`` plus source and severity."""
    kind, source = F.col("kind_type"), F.col("source")
    group = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in rules.SOURCE_NAMES.items()) + ")"), source)
    for start, no in rules.SOURCE_STARTS.items():
        group = F.coalesce(group, F.when(source.startswith(start), no))
    group = F.coalesce(group, F.lit(len(rules.SOURCE_GROUPS) - 1))
    bucket, has_user = kind_bucket(kind, any_kind), F.size("_tw_user") > 0
    inner = F.try_variant_get(F.try_element_at(F.col(MEMBERS), F.lit("kind")), "$.kind", "string")
    tests = {name: (present(*keys) if keys else F.lit(False)) | truthy(*true) for name, (keys, true) in rules.KEY_FEATURES.items()}
    tests |= {
        "unsigned_process": (_read(rules.UNSIGNED_KEY)["form"] == "BOOLEAN") & ~_read(rules.UNSIGNED_KEY)["truthy"],
        "has_ip": F.exists(F.map_keys(MEMBERS), lambda k: k.endswith(rules.ADDRESS_SUFFIX) | k.isin(*rules.ADDRESS_KEYS)),
        "has_hardware": kind.isin(*config.HARDWARE_KINDS),
        "production_bgp_anomaly": (kind == rules.LOCAL_HIJACK[0]) & (inner == rules.LOCAL_HIJACK[1]),
        "has_user": has_user,
        "has_identity_pivot": has_user & present(*rules.REACH_KEYS),
        **{name: group == i for i, name in enumerate(rules.SOURCE_GROUPS)},
        **{f"kind_hash_{i}": bucket == i for i in range(4)},
    }
    values = {
        "severity": lookup(config.SEVERITY_WEIGHT, F.upper("severity"), config.SEVERITY_DEFAULT),
        "kind_prior": lookup(config.KIND_PRIOR, kind, config.KIND_PRIOR_DEFAULT),
        "delta_seconds_log": normalised_delta(delta_seconds if delta_seconds is not None else F.lit(0.0)),
        **{name: F.coalesce(test, F.lit(False)).cast("double") for name, test in tests.items()},
    }
    return {name: values[name] for name in config.FEATURES}


def project(events: DataFrame, any_kind: bool = True) -> DataFrame:
    """Add kind_type, host, entities, relations and the 22 features (gap 0) to events.

    One narrow pass in which each kind is parsed once; with ``any_kind`` false,
    kinds outside the table have no kind_hash bit and no Python worker is started.
    """
    parts = with_parts(events)
    named = {"entities": kept_apart(entities()), "relations": kept_apart(relations())}
    return parts.withColumns({**named, **features(any_kind=any_kind)}).drop(MEMBERS, READ, *[f"_tw_{p.name}" for p in rules.PARTS])
