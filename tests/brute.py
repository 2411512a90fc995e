"""Plain Python versions of the operators, written independently, for comparison on small tables."""

from __future__ import annotations

import datetime as dt
import json
import re
import zoneinfo
from collections import defaultdict

UTC = dt.UTC
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
NAMED = {"CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "AEST": 600, "AEDT": 660, "Z": 0, "UTC": 0, "GMT": 0}


def micros(moment: dt.datetime) -> int:
    return (moment - EPOCH) // dt.timedelta(microseconds=1)


def _six(digits):
    return int(((digits or "") + "000000")[:6])


def _offset(text):
    if text in NAMED:
        return NAMED[text]
    m = re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", text)
    return None if not m else (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))


def instant(text, zone, received):
    if text is None:
        return None
    s = text.strip().upper()
    if m := re.fullmatch(r"(\d+)(?:\.(\d+))?", s):
        for unit in (1, 10**3, 10**6, 10**9):
            if 978307200 * unit <= int(m[1]) < 4133980800 * unit:
                return {1: lambda: int(m[1]) * 10**6 + _six(m[2]), 10**3: lambda: int(m[1]) * 1000 + _six(m[2]) // 1000, 10**6: lambda: int(m[1]), 10**9: lambda: int(m[1]) // 1000}[unit]()
        return None
    s = re.sub(r"\[.*\]$", "", s)
    day = None
    try:
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](.*)", s):
            day, rest = dt.date(int(m[1]), int(m[2]), int(m[3])), m[4]
        elif m := re.fullmatch(r"(\d{4})-W(\d\d)-(\d)T(.*)", s):
            day, rest = dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])), m[4]
        elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(.*)", s):
            day, rest = dt.date(int(m[1]), int(m[2]), int(m[3])), f"{m[4]}:{m[5]}:{m[6]}{m[7]}"
        elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (.*)", s):
            day, rest = dt.date(int(m[3]), int(m[1]), int(m[2])), m[4]
        elif m := re.fullmatch(r"[A-Z]{3}, (\d\d) ([A-Z]{3}) (\d{4}) (.*)", s):
            day, rest = dt.datetime.strptime(f"{m[1]} {m[2]} {m[3]}", "%d %b %Y").date(), m[4]
        else:
            return None
        m = re.fullmatch(r"(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?(AM|PM))? ?(\S*)", rest)
        if not m:
            return None
        hour = int(m[1]) if not m[5] else int(m[1]) % 12 + 12 * (m[5] == "PM")
        wall = dt.datetime(day.year, day.month, day.day, hour, int(m[2]), int(m[3]), _six(m[4]))
    except ValueError:
        return None
    if m[6]:
        off = _offset(m[6])
        return None if off is None else micros(wall.replace(tzinfo=UTC)) - off * 60_000_000
    tz = zoneinfo.ZoneInfo(zone) if zone else UTC
    first, second = (micros(wall.replace(tzinfo=tz, fold=f).astimezone(UTC)) for f in (0, 1))
    back = (EPOCH + dt.timedelta(microseconds=first)).astimezone(tz).replace(tzinfo=None)
    if back != wall:  # skipped: fold 0 is the offset before the change
        return first
    return second if first != second and received is not None and second <= micros(received) else first


def host(metadata):
    try:
        value = json.loads(metadata) if metadata else None
    except ValueError:
        value = None
    if isinstance(value, dict):
        for key in ("host", "hostname"):
            if isinstance(value.get(key), str) and value[key]:
                return value[key]
    return "unknown-host"


def same_id(raw):
    text = (raw or "").strip().lower()
    bare = re.sub(r"^urn:uuid:|[{}-]", "", text)
    return None if not text else bare if re.fullmatch("[0-9a-f]{32}", bare) else "=" + (raw or "").strip()


def surplus(rows):
    """rows: (row_no, id, received_at)."""
    groups = defaultdict(list)
    for row_no, raw, received in rows:
        if (key := same_id(raw)) is not None:
            groups[key].append((received is None, received, row_no))
    return {r for g in groups.values() for _, _, r in sorted(g)[1:]}


def sessions(rows, gap):
    """rows: (entity, instant)."""
    by = defaultdict(list)
    for entity, at in rows:
        if entity is not None and at is not None:
            by[entity].append(at)
    out = []
    for entity, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((entity, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((entity, start, last, n))
    return out


def nodes(window_id, pos, root, text):
    try:
        top = json.loads(text) if text else None
    except ValueError:
        return []
    out = []

    def visit(value, parent, path):
        if isinstance(value, dict):
            if path != root:
                out.append((window_id, pos, parent, path))
            for key, child in value.items():
                if root == "metadata" and isinstance(child, str):
                    try:
                        found = json.loads(child)
                        child = found if isinstance(found, (dict, list)) else child
                    except ValueError:
                        pass
                visit(child, path, f"{path}.{key}")
        elif isinstance(value, list):
            for i, child in enumerate(value):
                visit(child, parent, f"{path}[{i}]")

    if isinstance(top, dict):
        visit(top, None, root)
    return out


def schema_changes(lines):
    """lines: (feed, file_seq, payload)."""
    name = {str: "text", int: "integer", float: "fraction", bool: "boolean", list: "list"}
    files, hashes = defaultdict(lambda: defaultdict(set)), defaultdict(set)

    def visit(value, prefix, key):
        for k, child in value.items():
            if isinstance(child, dict):
                visit(child, f"{prefix}{k}.", key)
            else:
                files[key][prefix + k] |= {name[type(child)]} if child is not None else set()
                if prefix + k == "feature_schema_hash" and isinstance(child, str):
                    hashes[key].add(child)

    for feed, seq, payload in lines:
        files[feed, seq]
        visit(json.loads(payload), "", (feed, seq))
    out = set()
    for feed in {f for f, _ in files}:
        seqs = sorted(s for f, s in files if f == feed)
        for a, b in zip(seqs, seqs[1:], strict=False):
            old, new = files[feed, a], files[feed, b]
            gone, came = set(old) - set(new), set(new) - set(old)
            group = lambda names, of: {(p.rpartition(".")[0], *of[p]): [q for q in names if (q.rpartition(".")[0], *of[q]) == (p.rpartition(".")[0], *of[p])] for p in names if of[p]}
            left, right = group(gone, old), group(came, new)
            for key in left.keys() & right.keys():
                if len(left[key]) == len(right[key]) == 1:
                    out.add((feed, b, "renamed", left[key][0], right[key][0]))
                    gone.discard(left[key][0])
                    came.discard(right[key][0])
            out |= {(feed, b, "removed", p, "") for p in gone} | {(feed, b, "added", p, "") for p in came}
            out |= {(feed, b, "retyped", p, "") for p in old.keys() & new.keys() if old[p] and new[p] and old[p] != new[p]}
            if hashes[feed, a] and hashes[feed, b] and hashes[feed, a] != hashes[feed, b]:
                out.add((feed, b, "rehashed", "feature_schema_hash", ""))
    return out
