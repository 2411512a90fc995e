"""Filling fixed-capacity containers: mixture-controlled packing.

Items are spread over packing shards by hash, so a source that holds a third of
all items is split evenly.  In a shard every source is a queue; windows (the
containers) are filled by deficit round-robin: each window credits every source
its share of the capacity, the source that is owed most and has an item that
fits serves its largest such item.  Windows that a shard could not fill well
are dissolved; their items and the shard's closing deficits are carried to the
next level, where the leftovers of many shards are packed together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import TOKENIZER, token_counts
from tidewatch.runtime import materialise

CAPACITY = 2048
SHARD_ITEMS = 8192
#: Shards whose leftovers are packed together on the next level.
FAN_IN = 64
#: A window filled less than this is dissolved while there is a next level ...
WELL_FILLED = 0.99
#: ... but a shard carries no more items than this; further windows stay as they are.
CARRY_ITEMS = 512

#: piece_no of the rows that carry a source's deficit and no item; the packed tables hold no nulls,
#: which pandas would answer with floats.
NO_PIECE = -1

_PACKED = "grp bigint, doc_id bigint, piece_no int, source string, share double, n_tokens bigint, container_id string, slot int, deficit double"


class Queue:
    """Items of one source by size, with the largest that fits found by a bit mask of the sizes present."""

    def __init__(self) -> None:
        self.by_size: dict[int, list] = {}
        self.mask = 0

    def push(self, size: int, item) -> None:
        self.by_size.setdefault(size, []).append(item)
        self.mask |= 1 << size

    def largest(self, room: int) -> int:
        """Size of the largest item of at most ``room``; -1 where there is none."""
        return (self.mask & ((2 << room) - 1)).bit_length() - 1

    def pop(self, size: int):
        stack = self.by_size[size]
        item = stack.pop()
        if not stack:
            self.mask ^= 1 << size
        return item


def fill_windows(items: list[tuple[int, str, object]], shares: dict[str, float], owed: dict[str, float], capacity: int) -> list[list]:
    """Pack (size, source, item) into windows; ``owed`` holds the deficits before and after.

    A source's deficit is bounded by what it can still serve: a queue that runs
    empty forgets its claim, as in deficit round-robin.
    """
    queues: dict[str, Queue] = {}
    for size, source, item in items:
        queues.setdefault(source, Queue()).push(size, (size, source, item))
    left, windows = len(items), []
    while left:
        for source in queues:
            owed[source] = owed.get(source, 0.0) + shares.get(source, 0.0) * capacity
        room, window = capacity, []
        while room:
            best, claim, size = "", float("-inf"), -1
            for source, queue in queues.items():
                if owed[source] > claim and (found := queue.largest(room)) >= 0:
                    best, claim, size = source, owed[source], found
            if size < 0:
                break
            window.append(queues[best].pop(size))
            owed[best] -= size
            room -= size
            left -= 1
        for source in [s for s, q in queues.items() if not q.mask]:
            del queues[source]
            owed[source] = min(owed[source], 0.0)
        windows.append(window)
    return windows


def _pack(level: int, last: bool, capacity: int, carry_items: int | None):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        carried = frame[frame["piece_no"] < 0]
        owed = carried.groupby("source")["deficit"].sum().to_dict()
        own = frame[frame["piece_no"] >= 0].sort_values(["n_tokens", "doc_id", "piece_no"])
        shares = dict(zip(own["source"], own["share"], strict=True))
        items = list(zip(own["n_tokens"].tolist(), own["source"].tolist(), zip(own["doc_id"].tolist(), own["piece_no"].tolist(), strict=True), strict=True))
        windows = fill_windows(items, shares, owed, capacity)
        keep = [True] * len(windows)
        if not last:
            carry = len(items) if carry_items is None else carry_items
            for i in sorted(range(len(windows)), key=lambda i: sum(x[0] for x in windows[i])):
                if sum(x[0] for x in windows[i]) >= WELL_FILLED * capacity or len(windows[i]) > carry:
                    break
                keep[i], carry = False, carry - len(windows[i])
        rows = []
        for i, window in enumerate(windows):
            name = f"w{level}-{key[0]}-{i}" if keep[i] else ""
            for slot, (size, source, (doc, piece)) in enumerate(window):
                if not keep[i]:
                    owed[source] = owed.get(source, 0.0) + size
                rows.append((key[0], doc, piece, source, shares[source], size, name, slot, 0.0))
        if not last:
            rows.extend((key[0], 0, NO_PIECE, s, 0.0, 0, "", 0, d) for s, d in owed.items())
        out = pd.DataFrame(rows, columns=["grp", "doc_id", "piece_no", "source", "share", "n_tokens", "container_id", "slot", "deficit"])
        return out.astype({"grp": "int64", "doc_id": "int64", "piece_no": "int32", "share": "float64", "n_tokens": "int64", "slot": "int32", "deficit": "float64"})

    return pack


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, source, n_tokens): texts longer than the capacity in pieces of it and a rest.

    Texts without tokens are one piece of none.  A null source is a queue of its own.
    """
    n = F.col("n_tokens")
    last = F.greatest(F.floor((n - 1) / F.lit(capacity)), F.lit(0)).cast("int")
    rows = counts.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return rows.select("doc_id", "piece_no", "source", F.least(n - F.col("piece_no") * F.lit(capacity), F.lit(capacity)).alias("n_tokens"))


def pack_counts(
    counts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, targets: DataFrame | None = None, carry_items: int | None = CARRY_ITEMS
) -> DataFrame:
    """(doc_id, piece_no, source, n_tokens, container_id, slot) for counts of (doc_id, source, n_tokens).

    Every token of every text is in exactly one piece and every piece in exactly
    one container, of at most ``capacity``; a text that fits is one piece.  Pieces
    without tokens have a null container and slot.  doc_id must be unique.

    Windows are filled to the proportions of ``targets`` (source, target_share) as
    long as their sources last, without them to those of the corpus; sources
    without a target only fill what others leave.  ``carry_items`` bounds what a
    shard passes on from windows it filled badly; beyond it they stay as they are
    (``container_fill`` shows them), None passes all on.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = pieces(counts, capacity)
    full = F.col("n_tokens") == capacity
    whole = items.where(full | (F.col("n_tokens") == 0)).select(
        "doc_id", "piece_no", "source", "n_tokens",
        F.when(full, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string"))).alias("container_id"),
        F.when(full, F.lit(0)).alias("slot"),
    )
    loose = items.where(~full & (F.col("n_tokens") > 0))
    by_source = loose.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    all_sources = by_source.agg(F.sum("tokens").alias("all_tokens"), F.sum("items").alias("all_items"))
    totals = all_sources.first()
    groups = max(1, -(-(totals["all_items"] or 0) // shard_items))
    if targets is None:
        shares = by_source.select("source", (F.col("tokens") / F.lit(totals["all_tokens"] or 1)).alias("share"))
    else:
        wanted = targets.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("target_share").alias("t"))
        shares = by_source.select("source").join(wanted, "source", "left").select("source", F.coalesce("t", F.lit(0.0)).alias("share"))
    level_in = loose.join(shares, "source").select(
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).alias("grp"), "doc_id", "piece_no", "source", "share", "n_tokens",
        F.lit("").alias("container_id"), F.lit(0).alias("slot"), F.lit(0.0).alias("deficit"),
    )
    out, level = whole, 0
    while True:
        last = groups == 1
        packed = level_in.groupBy("grp").applyInPandas(_pack(level, last, capacity, carry_items), _PACKED)
        if not last:
            packed = materialise(packed, f"packed{level}")
        done = packed.where(F.col("container_id") != "")
        out = out.unionByName(done.select("doc_id", "piece_no", "source", "n_tokens", "container_id", "slot"))
        if last:
            return out.withColumn("source", F.when(F.col("source") != "", F.col("source")))
        groups = -(-groups // FAN_IN)
        level_in = packed.where(F.col("container_id") == "").withColumn("grp", F.floor(F.col("grp") / FAN_IN) if groups > 1 else F.lit(0).cast("long"))
        level += 1


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, targets: DataFrame | None = None) -> DataFrame:
    """``pack_counts`` of the texts of ``documents`` by the tokens of ``tokenizer``; texts are tokenised once."""
    return pack_counts(materialise(token_counts(documents, tokenizer), "tokens"), capacity, targets=targets)


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, n_tokens, fill) of every container."""
    held = packed.where(F.col("container_id").isNotNull()).groupBy("container_id")
    total = held.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return total.withColumn("fill", F.col("n_tokens") / F.lit(capacity))


def container_mixture(packed: DataFrame) -> DataFrame:
    """(container_id, source, n_tokens, share): what part of each container's tokens each source gives."""
    parts = packed.where(F.col("container_id").isNotNull()).groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    return parts.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("container_id")))
