"""Writers: findings, event lines, labeled windows, logs."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_json() -> F.Column:
    """An event as one line of JSON, kind and metadata as objects and not as text."""
    # microseconds only where there are any
    part = F.when(F.unix_micros("timestamp") % 1_000_000 != 0, F.date_format("timestamp", ".SSSSSS")).otherwise("")
    when = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), part, F.date_format("timestamp", "xxx"))
    body = F.struct("id", when.alias("timestamp"), "source", "severity", F.try_parse_json("kind_json").alias("kind"), F.try_parse_json("metadata_json").alias("metadata"))
    return F.to_json(body)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    events.select(event_json().alias("value")).write.mode(mode).text(path)


def write_labeled_windows(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line per window with its events in time order; ``events`` has window_id and label."""
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id", event_json().alias("e"))))
    lines = events.groupBy("window_id", "label").agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ",").alias("e"))
    head = F.to_json(F.struct("window_id", "label"))
    lines.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"events":['), "e", F.lit("]}")).alias("value")).write.mode(mode).text(path)


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    findings.write.mode(mode).json(path)


class JsonLines(logging.Formatter):
    """A log record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        body = {"ts": datetime.now(UTC).isoformat(), "level": record.levelname.lower(), "event": record.getMessage()}
        return json.dumps(body | getattr(record, "fields", {}))


def logger(level: str = "info") -> logging.Logger:
    """The package's logger, writing to stderr only."""
    log = logging.getLogger("tidewatch")
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level.upper())
    return log
