"""Sessions from occupancy bitmaps.

Each entity's instants set bits at a resolution; a bitmap covers one chunk of
time.  A morphological closing whose structuring element is one bit short of
the gap joins bits that are certainly close enough: dilation and erosion, each
by shifts that double.  Runs of the closed bitmap are joined with the counts
and exact ends of their bits.  What is left to decide exactly (gaps within one
bit of the limit, runs cut by a chunk's border) is decided on the few runs: an
entity has at most one run per gap and chunk border, whatever its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 1 << 15
RUNS = "entity string, start_us bigint, end_us bigint, n_events bigint"


def close_bits(bits: int, reach: int) -> int:
    """Fill the zeros between set bits at most ``reach`` positions apart."""
    if reach <= 1 or not bits:
        return bits
    wide, done = bits, 1
    while done < reach:  # dilation by `reach` bits
        step = min(done, reach - done)
        wide |= wide << step
        done += step
    done = 1
    while done < reach:  # erosion by the same element
        step = min(done, reach - done)
        wide &= wide >> step
        done += step
    return wide


def runs_of(positions: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of the closed bitmap of sorted ``positions``."""
    if reach < 0:  # a gap of nothing joins nothing, not even neighbours
        return positions, positions
    base, size = int(positions[0]), int(positions[-1]) - int(positions[0]) + 1
    flat = np.zeros(size, np.uint8)
    flat[positions - base] = 1
    bits = int.from_bytes(np.packbits(flat, bitorder="little").tobytes(), "little")
    closed = close_bits(bits, reach)
    raw = np.frombuffer(closed.to_bytes(size // 8 + 1, "little"), np.uint8)
    edge = np.diff(np.concatenate(([0], np.unpackbits(raw, bitorder="little")[:size], [0])).astype(np.int8))
    return np.flatnonzero(edge == 1) + base, np.flatnonzero(edge == -1) - 1 + base


def _chunk_runs(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            entities = batch.column("entity").to_pylist()
            lists = batch.column("occupied")
            ends, inner = lists.offsets.to_numpy(), lists.values
            pos, lo, hi, n = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "lo", "hi", "n"))
            for i, entity in enumerate(entities):
                cut = slice(ends[i], ends[i + 1])
                order = np.argsort(pos[cut], kind="stable")
                p, first, last, count = (x[cut][order] for x in (pos, lo, hi, n))
                starts, _ = runs_of(p, reach)
                at = np.searchsorted(p, starts)
                stop = np.append(at[1:], len(p)) - 1
                total = np.add.reduceat(count, at)
                out[0].extend([entity] * len(at))
                out[1].extend(first[at].tolist())
                out[2].extend(last[stop].tolist())
                out[3].extend(total.tolist())
            yield pa.record_batch(
                [pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])],
                names=["entity", "start_us", "end_us", "n_events"],
            )

    return run


def sessions(events: DataFrame, gap_us: int = 1_800_000_000, resolution_us: int | None = None) -> DataFrame:
    """Sessions (entity, start_us, end_us, duration_us, n_events) of ``events``.

    ``events``: entity, utc_us and, if given, ``weight`` (what a row adds to
    n_events; else 1).  A silence of more than ``gap_us`` ends a session, exactly
    that does not.  Rows with a null entity or instant belong to no session; no
    events give no rows; repeated rows only add to n_events.  The result is exact
    at microseconds; ``resolution_us`` is only the width of a bit.
    """
    if gap_us < 0:
        raise ValueError("gap_us must not be negative")
    bit = resolution_us or max(1, min(1_000_000, gap_us // 2))
    if bit > 1 and gap_us < 2 * bit:
        raise ValueError("resolution_us must be at most half of gap_us")
    reach = gap_us // bit - 1
    weight = F.col("weight") if "weight" in events.columns else F.lit(1)
    slot = F.expr(f"utc_us div {bit} - cast(utc_us % {bit} < 0 as bigint)")
    rows = events.where(F.col("entity").isNotNull() & F.col("utc_us").isNotNull()).select(
        "entity", "utc_us", weight.cast("long").alias("w"), slot.alias("slot")
    )
    occupied = rows.groupBy("entity", "slot").agg(F.min("utc_us").alias("lo"), F.max("utc_us").alias("hi"), F.sum("w").alias("n"))
    chunk = F.shiftright("slot", CHUNK_BITS.bit_length() - 1)
    chunks = occupied.groupBy("entity", chunk.alias("chunk")).agg(
        F.collect_list(F.struct(F.col("slot").alias("pos"), "lo", "hi", "n")).alias("occupied")
    )
    runs = chunks.select("entity", "occupied").mapInArrow(_chunk_runs(reach), RUNS)
    order = Window.partitionBy("entity").orderBy("start_us")
    fresh = F.when(F.col("start_us") - F.lag("end_us").over(order) <= gap_us, 0).otherwise(1)
    numbered = runs.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(order))
    return (
        numbered.groupBy("entity", "no")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
        .select("entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
    )
