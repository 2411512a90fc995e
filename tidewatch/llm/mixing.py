"""Mixing sources to target weights.

Each source is a stream of tokens, its documents in pseudorandom order, cut
into blocks of a fixed length.  The mix is a number of slots, a block each.
How many slots of each source an output shard holds is drawn from a multinomial
over what is left to place; the n-th slot of a source takes the block that a
keyed permutation of the source's block numbers maps n to, with a fresh key for
every repetition.  Slots and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import TOKENIZER, token_counts
from tidewatch.runtime import is_small, materialise

BLOCK = 512
SHARD_SLOTS = 1 << 16
BUCKET_DOCS = 1 << 16
MAX_SOURCES = 10_000

_SLOTS = "shard bigint, slot bigint, source string, block_no bigint, use_no int"


def quotas(weights: np.ndarray, limits: np.ndarray, wanted: int) -> np.ndarray:
    """Whole numbers near ``weights * wanted`` and within ``limits``, with sum ``wanted`` if the limits allow.

    What a source cannot take goes to the others in proportion to their weights.
    """
    open_, exact = (weights > 0) & (limits > 0), np.zeros(len(weights))
    while open_.any():  # whoever is over its limit is set to it, and the rest shared again
        left = max(wanted - exact[~open_].sum(), 0.0)
        share = np.where(open_, weights, 0.0) / weights[open_].sum() * left
        over = open_ & (share >= limits)
        if not over.any():
            exact[open_] = share[open_]
            break
        exact[over] = limits[over]
        open_ &= ~over
    got = np.floor(exact + 1e-9).astype(np.int64)
    missing = min(wanted, int(limits[weights > 0].sum())) - int(got.sum())
    for i in [i for i in np.argsort(got - exact, kind="stable") if weights[i] > 0 and got[i] < limits[i]][: max(missing, 0)]:
        got[i] += 1
    return got


def _drawn(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """``size`` of what is left, by multinomial draws that take no more of a source than there is."""
    drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
    while (short := size - int(drawn.sum())) > 0:
        rest = left - drawn
        drawn += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
    return drawn


def shard_counts(quota: np.ndarray, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, starts): slots of each source in one output shard, and in all shards before it.

    The shards are the leaves of a binary tree.  At each node the slots of the left
    half are drawn from the node's own by a generator of the node's number, so that
    any worker finds any shard on its own and all shards add up to ``quota``.
    """
    counts, starts = quota.astype(np.int64), np.zeros(len(quota), np.int64)
    lo, hi, node = 0, -(-int(counts.sum()) // shard_slots), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _drawn(np.random.default_rng((seed, node)), counts, (mid - lo) * shard_slots)
        if shard < mid:
            counts, hi, node = left, mid, 2 * node
        else:
            counts, starts, lo, node = counts - left, starts + left, mid, 2 * node + 1
    return counts, starts


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix64(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _slots(sources: list[str], blocks: list[int], quota: np.ndarray, shard_slots: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["shard"].tolist():
                counts, starts = shard_counts(quota, shard_slots, shard, seed)
                label = np.repeat(np.arange(len(sources)), counts)
                nth = np.concatenate([s + np.arange(c) for s, c in zip(starts, counts, strict=True)])
                use, block = np.zeros(len(nth), np.int32), np.zeros(len(nth), np.int64)
                for i in np.flatnonzero(counts):
                    own = label == i
                    use[own] = nth[own] // blocks[i]
                    for u in np.unique(use[own]):
                        at = own & (use == u)
                        block[at] = permute(nth[at] % blocks[i], blocks[i], (seed * 1_000_003 + int(i)) * 4_099 + int(u))
                order = np.random.default_rng((seed, shard)).permutation(len(nth))
                names = np.asarray(sources, dtype=object)
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(nth)), "source": names[label[order]], "block_no": block[order], "use_no": use[order]})

    return run


def segments(counts: DataFrame, block: int, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(source, block_no, doc_id, token_start, n_tokens): which tokens of which documents make up each block.

    Documents lie in their source's stream by hash bucket, in the bucket by hash;
    a running sum inside each bucket on top of one over the buckets' totals gives
    each its place, so that no task holds a source.
    """
    held = counts.where(F.col("n_tokens") > 0)
    buckets = max(1, -(-held.count() // bucket_docs))
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    placed = held.select("source", "doc_id", "n_tokens", order.alias("o"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("base"))
    start = F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    at = placed.join(base, ["source", "bucket"]).select("source", "doc_id", "n_tokens", start.alias("start"))
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block))
    cut = at.select("source", "doc_id", "n_tokens", "start", F.explode(span).alias("block_no"))
    first = F.greatest(F.col("start"), F.col("block_no") * block)
    stop = F.least(F.col("start") + F.col("n_tokens"), (F.col("block_no") + 1) * block)
    return cut.select("source", "block_no", "doc_id", (first - F.col("start")).alias("token_start"), (stop - first).alias("n_tokens"))


def mix_counts(counts: DataFrame, targets: DataFrame, block: int = BLOCK, part: float = 0.5, seed: int = 20_240_501, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: (shard, slot, source, block_no, use_no, doc_id, token_start, n_tokens).

    ``counts``: doc_id, source, n_tokens; ``targets``: source, target_share,
    max_repeats.  The mix has ``part`` of all tokens of ``counts``, those of
    sources without a target included in the total but never taken.  A source
    too small for its share gives max_repeats of all its blocks, and the others
    share the rest in proportion.  ``use_no`` counts the uses of a token from 0
    and stays below max_repeats.  The rest of a source behind its last whole
    block is not used.  Null shares and repeats are 0, null sources have no
    target.  No more than ``MAX_SOURCES`` targets are read to the driver.
    """
    wanted_sources = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    if not is_small(wanted_sources, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    spark = counts.sparkSession
    own = counts.join(wanted_sources.select("source").distinct(), "source", "left_semi")
    sizes = {r["source"]: r["t"] for r in own.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted_sources.collect()}
    sources = sorted(goal)
    blocks = np.array([(sizes.get(s) or 0) // block for s in sources], dtype=np.int64)
    limits = blocks * np.array([goal[s][1] for s in sources], dtype=np.int64)
    quota = quotas(np.array([goal[s][0] for s in sources], dtype=float), limits, round(total * part / block))
    shards = -(-int(quota.sum()) // shard_slots)
    plan = spark.range(0, shards, 1, max(1, min(shards, 10_000))).withColumnRenamed("id", "shard")
    # The planner takes generated rows to be as few as those of the plan and would broadcast them.
    slots = plan.mapInPandas(_slots(sources, blocks.tolist(), quota, shard_slots, seed), _SLOTS).hint("merge")
    return slots.join(segments(own, block), ["source", "block_no"]).select("shard", "slot", "source", "block_no", "use_no", "doc_id", "token_start", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``mix_counts`` of the texts of ``documents``; texts are tokenised once."""
    return mix_counts(materialise(token_counts(documents, tokenizer), "tokens"), targets)


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, mix_tokens, actual_share, most_uses) of every source with a target."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("t"), (F.max("use_no") + 1).alias("most_uses"))
    everything = Window.partitionBy()
    got = targets.join(used, "source", "left").withColumn("mix_tokens", F.coalesce("t", F.lit(0)))
    share = F.col("mix_tokens") / F.nullif(F.sum("mix_tokens").over(everything), F.lit(0))
    return got.select("source", "target_share", "max_repeats", "mix_tokens", share.alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
