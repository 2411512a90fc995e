"""The rules that turn an event into entities, relations and features, as data.

Two readers interpret them: ``functions.entities`` as column expressions over
whole tables, ``read_event`` below for one event in plain Python (training sets
and keyed streams).  Tests hold the two against each other.

Fixed values: the keys, their order, the folds and the names of relations and
features have to be exactly these for results to agree with findings made
elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewatch import config
from tidewatch.functions.events import UNKNOWN_HOST


@dataclass(frozen=True)
class Part:
    """One sort of entity: the keys it is read from and how.

    ``pick``: ``each`` key that counts gives an entity; ``first`` takes the first
    truthy key, else the last one.  ``counts``: ``truthy`` or ``given`` (not null).
    ``fold``: ``plain``, ``lower`` or ``domain`` (lower case without final dots).
    ``own``: the entity belongs to the event's host and carries its name.
    """

    name: str
    keys: tuple[str, ...]
    pick: str = "each"
    counts: str = "truthy"
    fold: str = "plain"
    own: bool = False
    lists: tuple[str, ...] = ()


PARTS = (
    Part("process", ("pid", "tgid"), pick="first", counts="given", own=True),
    Part("hash", ("exe_sha256", "sha256"), fold="lower"),
    Part("ip", ("src_ip", "dst_ip", "forward_ip", "reversed_ip", "ntp_server", "gateway_ip"), lists=("dest_ips",)),
    Part("prefix", ("prefix",)),
    Part("asn", ("observed_origin_asn", "legitimate_origin_asn"), counts="given"),
    Part("domain", ("domain", "ptr_query"), fold="domain"),
    Part("device", ("device",), own=True),
    Part("user", ("user", "username", "account"), pick="first", fold="lower"),
    Part("session", ("session_id", "sid"), pick="first", counts="given", own=True),
    Part("cloud", ("cloud_resource", "arn"), fold="lower"),
)
#: (sort whose entities are gone through one by one, or None; its relations as (left sort, right sort, name)).
#: ``actor`` is the process, or the host where there is none.
RELATIONS = (
    (None, (("host", "process", "executes"), ("actor", "hash", "identified_by"), ("actor", "ip", "connects_to"))),
    ("prefix", (("ip", "prefix", "belongs_to"), ("prefix", "asn", "originated_by"))),
    ("domain", (("domain", "ip", "resolves_or_connects"), ("host", "domain", "queries_or_visits"))),
    (None, (("host", "device", "contains"),)),
    ("user", (("user", "host", "authenticates_to"), ("user", "process", "owns"), ("user", "cloud", "accesses"))),
    ("session", (("host", "session", "contains"), ("session", "process", "spawns"))),
)
#: Features that ask for keys: those of which one is there, and those of which one is truthy.
KEY_FEATURES = {
    "has_process": (("pid", "tgid"), ()),
    "has_hash": (("exe_sha256",), ("sha256",)),
    "has_domain": (("domain", "sni", "ptr_query"), ()),
    "has_asn_or_prefix": (("prefix", "observed_origin_asn", "asn_owner"), ()),
    "concurrent_exfil": ((), ("concurrent_exfil",)),
}
ADDRESS_SUFFIX, ADDRESS_KEYS = "_ip", ("dest_ips", "ntp_server")
REACH_KEYS = ("dst_ip", "dest_ips", "target_host", "cloud_resource", "arn")
LOCAL_HIJACK = ("bgp_anomaly", "subprefix_hijack_local_infra")
UNSIGNED_KEY = "is_signed"
#: Group of a source: these by name, then by how it starts, else the last group.
SOURCE_GROUPS = ("source_kernel", "source_network", "source_hardware", "source_correlation")
SOURCE_NAMES = {"kernel_ebpf": 0, "network_zeek": 1, "network_suricata": 1}
SOURCE_STARTS = {"hardware_": 2}

FOLDS = {"plain": str, "lower": lambda v: str(v).lower(), "domain": lambda v: str(v).lower().rstrip(".")}


@dataclass
class Reading:
    """What one event says."""

    entities: list[str]
    relations: list[tuple[str, str, str]]
    features: np.ndarray


def _values(part: Part, kind: dict) -> list:
    counts = (lambda v: v is not None) if part.counts == "given" else bool
    if part.pick == "first":
        chosen = [next((kind[k] for k in part.keys if kind.get(k)), kind.get(part.keys[-1]))]
    else:
        chosen = [kind.get(k) for k in part.keys]
    listed = [v for k in part.lists if isinstance(kind.get(k), list) for v in kind[k]]
    return [FOLDS[part.fold](v) for v in chosen if counts(v)] + listed


def read_event(event: dict) -> Reading:
    """Entities, relations and features (gap 0) of an event of dicts."""
    kind, meta = event["kind"], event.get("metadata") or {}
    host = str(meta.get("host") or meta.get("hostname") or UNKNOWN_HOST)
    found = {"host": [f"host:{host}"]}
    for part in PARTS:
        scope = f"{part.name}:{host}:" if part.own else f"{part.name}:"
        found[part.name] = list(dict.fromkeys(scope + str(v) for v in _values(part, kind)))
    found["actor"] = found["process"] or found["host"]
    relations = []
    for each, triples in RELATIONS:
        for one in found[each] if each else (None,):
            sides = found if each is None else found | {each: [one]}
            relations += [(a, b, name) for left, right, name in triples for a in sides[left] for b in sides[right]]
    entities = list(dict.fromkeys(e for name in ("host", *(p.name for p in PARTS)) for e in found[name]))
    return Reading(entities, relations, _features(event, kind, bool(found["user"])))


def _features(event: dict, kind: dict, has_user: bool) -> np.ndarray:
    name, source, inner = str(kind.get("type", "unknown")), event["source"], kind.get("kind")
    group = SOURCE_NAMES.get(source, next((g for s, g in SOURCE_STARTS.items() if source.startswith(s)), len(SOURCE_GROUPS) - 1))
    on = {f for f, (given, truthy) in KEY_FEATURES.items() if any(k in kind for k in given) or any(kind.get(k) for k in truthy)}
    on |= {SOURCE_GROUPS[group], f"kind_hash_{config.kind_bucket(name)}"}
    tests = {
        "unsigned_process": kind.get(UNSIGNED_KEY) is False,
        "has_ip": any(k.endswith(ADDRESS_SUFFIX) or k in ADDRESS_KEYS for k in kind),
        "has_hardware": name in config.HARDWARE_KINDS,
        "production_bgp_anomaly": (name, inner.get("kind") if isinstance(inner, dict) else None) == LOCAL_HIJACK,
        "has_user": has_user,
        "has_identity_pivot": has_user and any(k in kind for k in REACH_KEYS),
    }
    on |= {f for f, hit in tests.items() if hit}
    weights = {
        "severity": config.SEVERITY_WEIGHT.get(event["severity"].upper(), config.SEVERITY_DEFAULT),
        "kind_prior": config.KIND_PRIOR.get(name, config.KIND_PRIOR_DEFAULT),
    }
    return np.array([weights.get(f, float(f in on)) for f in config.FEATURES])
