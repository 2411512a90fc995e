"""Events as sensors send them: which fields each kind has, and of what type.

Fixed values: the table below states the wire format.  A field is
``name form``; forms are text, flag, number, texts (a list), wholes (a list),
byte, port, count, big (whole numbers of 8, 16, 32 and 64 bits), bytes2 (two
bytes) and nested (the object of an anomaly).  ``?`` marks fields that may be
null or missing.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.entities import kept_apart, members

# Fixed values, see above.
FIELDS = {
    "igmp_trigger": "src_ip text, group_addr text",
    "quic_heartbeat": "src_ip text, dst_ip text, dst_port port, pid count, exe_path text",
    "igmp_quic_correlation": "igmp_event_id text, quic_event_id text, window_ms big",
    "socket_lineage": "pid count, tgid count, exe_path text, exe_sha256 text, dst_ip text, dst_port port, is_signed flag",
    "suspicious_beacon": "pid count, exe_path text, exe_sha256 text, dst_ip text, asn_owner text",
    "physics_anomaly": "dst_ip text, expected_ttl_range bytes2, observed_ttl byte, rtt_ms number, reason text",
    "octet_reversal_detected": "forward_ip text, reversed_ip text, forward_asn text, reversed_asn text, ptr_query text",
    "ntp_time_shift": "offset_seconds number, ntp_server text",
    "hsts_time_manipulation": "domain text, cert_expiry text, ntp_shift_seconds number",
    "nvme_latency_anomaly": "device text, baseline_us big, observed_us big, deviation_pct number, concurrent_exfil flag",
    "mac_flapping": "gateway_ip text, old_mac text, new_mac text, flap_count count, window_seconds big",
    "rtc_clock_divergence": "software_time text, rtc_time text, drift_seconds number",
    "impossible_state": "correlated_event_ids texts, description text, kill_chain_stage text",
    "panic_response": "reason text, actions_taken texts",
    "triage_classification": "family text, variant text?, family_type text?, confidence text, score count, source_path text, sha256 text?, dest_ips texts?",
    "bgp_anomaly": "kind nested, prefix text, observed_origin_asn count, legitimate_origin_asn count?, confidence text?",
}
ROUTE_FIELDS = {
    "subprefix_hijack_local_infra": "covered_local_prefix text, hijacker_asn count",
    "bogon": "",
    "observed_moas": "observed_origins wholes",
    "observed_rpki_invalid": "authorized_origin count?",
    "observed_origin_flap": "previous_origin count, new_origin count",
    "observed_squat_burst": "lifetime_secs big",
    "observed_squat_dormant": "silent_days big",
    "observed_as_path_prepend": "n_self_prepends byte, path wholes",
    "observed_valley_free_violation": "path wholes, violation_at big",
    "observed_subprefix_more_specific": "covered_prefix text, cover_origin_asn count, new_origin_asn count",
    "rpki_transition": "from text, to text",
}
BITS = {"byte": 8, "port": 16, "count": 32, "big": 64}


def fields_of(table: dict[str, str], kind: str) -> list[tuple[str, str, bool]]:
    """(name, form, may be missing) of a kind's fields."""
    split = [part.split() for part in table[kind].split(",") if part.strip()]
    return [(name, form.rstrip("?"), form.endswith("?")) for name, form in split]


def _spec(table: dict[str, str], kind: Column) -> Column:
    """The fields of a row's kind as an array of structs; null for a kind that is not in the table."""
    row = lambda f: f"named_struct('name', '{f[0]}', 'form', '{f[1]}', 'may', {str(f[2]).lower()})"
    none = "cast(array() as array<struct<name:string,form:string,may:boolean>>)"
    entries = [f"'{k}', " + (f"array({', '.join(map(row, fields_of(table, k)))})" if fields_of(table, k) else none) for k in table]
    return F.try_element_at(F.expr(f"map({', '.join(entries)})"), kind)


def fits(value: Column, form: Column) -> Column:
    """Whether a variant is of a wire form."""
    seen, text = F.schema_of_variant(value), value.cast("string")
    whole = text.try_cast("decimal(38,0)")
    is_whole = seen.isin("BIGINT") | seen.rlike(r"^DECIMAL\((19|2[0-9]|3[0-8]),0\)$")
    top = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', cast({2**b - 1} as decimal(38,0))" for k, b in BITS.items()) + ")"), form)
    return (
        F.when(form == "text", seen == "STRING")
        .when(form == "flag", seen == "BOOLEAN")
        .when(form == "number", is_whole | seen.startswith("DECIMAL") | (seen == "DOUBLE"))
        .when(form == "texts", seen.isin("ARRAY<STRING>", "ARRAY<VOID>"))
        .when(form.isin("wholes", "bytes2"), seen.isin("ARRAY<BIGINT>", "ARRAY<VOID>"))
        .when(form == "nested", seen.startswith("OBJECT"))
        .otherwise(is_whole & (whole >= 0) & (whole <= top))
    )


def _wrong(held: Column, spec: Column) -> Column:
    """Names of the fields that are missing or of another form."""

    def bad(field: Column) -> Column:
        value = F.try_element_at(held, field["name"])
        absent = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
        return F.when(absent, ~field["may"]).otherwise(~F.coalesce(fits(value, field["form"]), F.lit(False)))

    return F.transform(F.filter(spec, bad), lambda f: f["name"])


def with_wire_problems(events: DataFrame, kind: str = "kind_json") -> DataFrame:
    """Add ``unknown_kind`` and ``wrong_fields`` (an array, empty where all is well) by the wire format.

    A narrow pass.  Kinds that are no JSON object, or have no type of the table, are
    unknown and have no wrong fields; fields beyond the table do not count.  The
    object inside a route anomaly is checked by its own table, its fields as
    ``kind.name``.
    """
    base = events.withColumn("_tw_members", kept_apart(members(F.col(kind))))
    name = F.try_variant_get(F.try_element_at("_tw_members", F.lit("type")), "$", "string")
    inner = F.try_variant_get(F.try_element_at("_tw_members", F.lit("kind")), "$", "map<string,variant>")
    base = base.withColumns({"_tw_kind": name, "_tw_inner": kept_apart(F.when(name == "bgp_anomaly", inner))})
    route = F.try_variant_get(F.try_element_at("_tw_inner", F.lit("kind")), "$", "string")
    spec, nested = _spec(FIELDS, F.col("_tw_kind")), _spec(ROUTE_FIELDS, route)
    none = F.array().cast("array<string>")
    inside = F.when(F.col("_tw_inner").isNotNull(), F.when(nested.isNull(), F.array(F.lit("kind.kind"))).otherwise(F.transform(_wrong(F.col("_tw_inner"), nested), lambda n: F.concat(F.lit("kind."), n))))
    wrong = F.concat(F.coalesce(_wrong(F.col("_tw_members"), spec), none), F.coalesce(inside, none))
    return base.withColumns({"unknown_kind": spec.isNull(), "wrong_fields": wrong}).drop("_tw_members", "_tw_kind", "_tw_inner")


def new_event(source: str, severity: str, kind: str, metadata: dict | None = None, **values) -> dict:
    """A fresh event of a known kind with an id and the present time; fields the kind does not have, or lacks, raise."""
    if kind not in FIELDS:
        raise ValueError(f"unknown kind: {kind}")
    known = fields_of(FIELDS, kind)
    lacking = [n for n, _, may in known if not may and n not in values]
    surplus = values.keys() - {n for n, _, _ in known}
    if lacking or surplus:
        raise ValueError(f"{kind}: missing {lacking}, unknown {sorted(surplus)}")
    return {"id": str(uuid.uuid4()), "timestamp": datetime.now(UTC).isoformat(), "source": source, "severity": severity, "kind": {"type": kind} | values, "metadata": metadata}
