"""Column expressions over event envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_HOST = "unknown-host"


def json_text(doc: Column, key: str) -> Column:
    """The value of a top-level key of a variant, only where it is a JSON string."""
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def host_of(metadata: Column) -> Column:
    """``host``, else ``hostname``, where a non-empty JSON string; else ``unknown-host``.

    ``metadata`` is JSON text.  Text the strict parser refuses (such as an object
    with a repeated key) is read leniently; anything else gives ``unknown-host``.
    """
    doc = F.try_parse_json(metadata)
    lenient = [F.when(doc.isNull(), F.get_json_object(metadata, f"$.{key}")) for key in ("host", "hostname")]
    return F.coalesce(
        non_empty(json_text(doc, "host")),
        non_empty(json_text(doc, "hostname")),
        *[non_empty(x) for x in lenient],
        F.lit(UNKNOWN_HOST),
    )


def kind_type_of(kind: Column) -> Column:
    """``type`` of a kind object as text; ``unknown`` where it is missing or null."""
    return F.coalesce(F.get_json_object(kind, "$.type"), F.lit("unknown"))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spacing; text that is no JSON stays as it is."""
    return F.coalesce(F.try_parse_json(text).cast("string"), text)


def canonical_id(raw: Column) -> Column:
    """One spelling for every way of writing a UUID; null for a null or blank id.

    Braces, a ``urn:uuid:`` prefix, hyphens, case and outer blanks do not count.
    Text that is no UUID stands for itself without its outer blanks, marked so
    that it never equals a UUID.
    """
    text = F.lower(F.btrim(raw, F.lit(" \t\r\n\f ")))
    bare = F.regexp_replace(text, r"^urn:uuid:|[{}\-]", "")
    return F.when(text != "", F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.concat(F.lit("="), F.btrim(raw))))
