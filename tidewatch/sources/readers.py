"""Readers: event lines, labeled windows, audit logs, technique bundles.

Files are read as text, split where they are large, and lines keep their number
within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import iso_instant

FIELDS = ("id", "timestamp", "source", "severity", "kind", "metadata")
REQUIRED = ("id", "kind", "severity", "source", "timestamp")


def as_text(doc: Column, raw: Column, key: str) -> Column:
    """A value as Python would print it: booleans capitalised, null as None, else the token."""
    form = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
    text = F.get_json_object(raw, f"$.{key}")
    return F.when(form == "VOID", "None").when(form == "BOOLEAN", F.initcap(text)).otherwise(text)


def envelopes(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Parse and validate event lines; every column of ``lines`` is kept.

    Added: id, timestamp (TIMESTAMP, UTC; text without a zone is UTC), source,
    severity (upper case), kind_json, metadata_json and error, which is null for
    a valid event and else says what is wrong with the first thing that is.
    Missing fields are named in order.  A falsy metadata is an empty object.
    """
    text = F.col(raw)
    base = lines.withColumn("_tw_doc", F.try_parse_json(text))
    doc = F.col("_tw_doc")
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    form = lambda key: F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys)
    meta = F.get_json_object(text, "$.metadata")
    falsy = form("metadata").isNull() | (form("metadata") == "VOID") | meta.isin("[]", "{}", "0", "false", "", "0.0")
    kind = F.get_json_object(text, "$.kind")
    error = (
        F.when(doc.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), "event must be an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~form("kind").startswith("OBJECT"), "kind must be an object")
        .when(~F.array_contains(F.json_object_keys(kind), "type"), "kind must contain type")
        .when(~falsy & ~form("metadata").startswith("OBJECT"), "metadata must be an object")
    )
    parsed = base.select(
        *lines.columns, as_text(doc, text, "id").alias("id"), as_text(doc, text, "timestamp").alias("_tw_ts"), as_text(doc, text, "source").alias("source"),
        F.upper(as_text(doc, text, "severity")).alias("severity"), kind.alias("kind_json"), F.when(falsy, "{}").otherwise(meta).alias("metadata_json"), error.alias("error"),
        (form("timestamp") == "STRING").alias("_tw_string"),
    )
    # only a JSON string names a time
    timed = parsed.withColumn("_tw_us", iso_instant(F.when(F.col("_tw_string"), F.col("_tw_ts"))))
    late = F.when(F.col("error").isNull() & F.col("_tw_us").isNull(), F.concat(F.lit("invalid timestamp: "), F.coalesce("_tw_ts", F.lit("")))).otherwise(F.col("error"))
    return timed.withColumn("timestamp", F.timestamp_micros("_tw_us")).withColumn("error", late).drop("_tw_ts", "_tw_us", "_tw_string")


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, value): the lines of files that are not blank, numbered from 1 as they stand.

    Large files are split: lines are counted per block, and a line's number is its
    place in its block behind the lines of the blocks before.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_tw_block")]
    # ids count up by one within a task, and a block's lines are read by one task in order
    raw = reader.text(path).select(*where, "value", F.monotonically_increasing_id().alias("_tw_id"))
    blocks = raw.groupBy("file", "_tw_block").agg(F.min("_tw_id").alias("_tw_first"), F.count(F.lit(1)).alias("_tw_n"))
    before = F.sum("_tw_n").over(Window.partitionBy("file").orderBy("_tw_block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select("file", "_tw_block", "_tw_first", F.coalesce(before, F.lit(0)).alias("_tw_before"))
    line_no = F.col("_tw_id") - F.col("_tw_first") + F.col("_tw_before") + 1
    return raw.join(placed, ["file", "_tw_block"]).select("file", line_no.alias("line_no"), "value").where(F.btrim("value") != "")


def read_events(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Events of newline-delimited JSON.

    FAILFAST raises at the first bad line, naming file and line; PERMISSIVE keeps
    bad lines with their error; DROPMALFORMED leaves them out.
    """
    found = envelopes(numbered_lines(spark, path))
    if mode == "PERMISSIVE":
        return found
    if mode == "DROPMALFORMED":
        return found.where(F.col("error").isNull()).drop("error")
    where = F.concat_ws(":", "file", F.col("line_no").cast("string"), "error")
    stop = F.when(F.col("error").isNotNull(), F.raise_error(where).cast("string"))
    return found.withColumn("id", F.coalesce(stop, F.col("id"))).drop("error")


def read_labeled_windows(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, window_id, label, event_pos, value, error): the events of ``*.labeled.ndjson`` files.

    A window needs window_id, a label of 0 or 1 and at least one event; where one
    is missing the line comes once, with the error and no event.
    """
    lines = numbered_lines(spark, path, "*.labeled.ndjson")
    doc = F.try_parse_json("value")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(k) for k in ("events", "label", "window_id")]), keys)
    label = F.get_json_object("value", "$.label")
    events = F.from_json(F.get_json_object("value", "$.events"), "array<string>")
    error = (
        F.when(doc.isNull(), "invalid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~F.coalesce(label.isin("0", "1"), F.lit(False)), "label must be 0 or 1")
        .when(F.coalesce(F.size(events), F.lit(0)) < 1, "events must not be empty")
    )
    checked = lines.select("file", "line_no", F.get_json_object("value", "$.window_id").alias("window_id"), label.try_cast("int").alias("label"), error.alias("error"), events.alias("events"))
    some = F.when(F.col("error").isNull(), F.col("events"))
    return checked.select("file", "line_no", "window_id", "label", "error", F.posexplode_outer(some).alias("event_pos", "value"))


# Tags of the audit log that calibrate only, and the namespace of its event ids.
CALIBRATION_TAGS = [
    "observed_origin_flap", "observed_moas", "observed_squat_burst", "observed_squat_dormant", "observed_as_path_prepend",
    "observed_valley_free_violation", "observed_subprefix_more_specific", "observed_rpki_invalid", "rpki_transition", "bogon",
]


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The version 5 UUID of a name: a SHA-1 of namespace and name with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def audit_events(lines: DataFrame, namespace_hex: str, prefix: str | None = None, max_lines: int = 200_000, max_events: int = 64) -> DataFrame:
    """Events of an audit log: (line_no, value) with line_no from 1 as they stand.

    A bounded export, like the log's own: the first ``max_lines`` lines are read,
    malformed and blank ones skipped, one prefix kept if named, and the first
    ``max_events`` events returned in line order.
    """
    kind = F.get_json_object("value", "$.kind")
    tag = F.get(F.json_object_keys(kind), F.lit(0))
    read = lines.where(F.col("line_no") <= max_lines).select("line_no", "value", kind.alias("kind"), tag.alias("tag")).where(F.col("tag").isNotNull())
    of = lambda k: F.get_json_object("value", f"$.{k}")
    secs, nanos = of("ts.secs_since_epoch").try_cast("bigint"), F.coalesce(of("ts.nanos_since_epoch").try_cast("bigint"), F.lit(0))
    micros = secs * 1_000_000 + F.floor(nanos / 1000).cast("bigint")
    stamp = F.timestamp_micros(micros)
    iso = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(micros, F.lit(1_000_000)) != 0, F.date_format(stamp, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    when = F.coalesce(iso, of("ts"))
    name = F.concat_ws("|", F.coalesce(of("prefix"), F.lit("")), when, "tag", F.coalesce(of("observed_origin_asn"), F.lit("None")))
    quiet = F.col("tag").isin(*CALIBRATION_TAGS)
    inner = F.map_concat(F.create_map(F.lit("kind"), F.col("tag")), F.coalesce(F.from_json(F.get_json_object("value", "$.kind.*"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    body = F.to_json(F.struct(
        F.lit("bgp_anomaly").alias("type"), inner.alias("kind"), F.coalesce(of("prefix"), F.lit("")).alias("prefix"), of("observed_origin_asn").try_cast("bigint").alias("observed_origin_asn"),
        of("legitimate_origin_asn").try_cast("bigint").alias("legitimate_origin_asn"), F.when(quiet, "low").otherwise("high").alias("confidence"),
    ))
    out = read.select(
        "line_no", of("prefix").alias("prefix"), uuid5(namespace_hex, name).alias("id"), when.alias("timestamp"), F.lit("sentinel_correlation").alias("source"),
        F.when(quiet, "WARNING").otherwise("HIGH").alias("severity"), body.alias("kind_json"), F.lit('{"host":"bgp-collector"}').alias("metadata_json"),
    )
    if prefix is not None:
        out = out.where(F.col("prefix") == prefix)
    return out.orderBy("line_no").limit(max_events).drop("prefix")


def attack_reference(bundle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tactics, techniques) of a STIX bundle with an ``objects`` array column.

    tactics: (pos, tactic) in the matrix's order; techniques: (technique, name,
    tactics), revoked and deprecated ones left out.
    """
    objects = bundle.select(F.explode("objects").alias("o")).select("o.*")
    refs = objects.where(F.col("type") == "x-mitre-matrix").select(F.posexplode("tactic_refs").alias("pos", "id"))
    tactics = refs.join(objects.where(F.col("type") == "x-mitre-tactic").select("id", F.col("x_mitre_shortname").alias("tactic")), "id").select("pos", "tactic")
    live = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    own = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    phases = F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    techniques = objects.where((F.col("type") == "attack-pattern") & live).select(own.alias("technique"), "name", phases.alias("tactics")).where(F.col("technique").isNotNull())
    return tactics, techniques


def time_offsets(events: DataFrame) -> DataFrame:
    """Add offset_seconds of each event from the first of its window."""
    first = events.groupBy("window_id").agg(F.min("timestamp").alias("_tw_first"))
    return events.join(first, "window_id").withColumn("offset_seconds", (F.unix_micros("timestamp") - F.unix_micros("_tw_first")) / 1e6).drop("_tw_first")


