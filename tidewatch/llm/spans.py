"""Long exact spans shared between texts.

First pass, sliding sentence spans: from every sentence on, the run of sentences
that reaches ``SPAN`` characters beyond it is hashed and joined globally.  What
more than one text has is a repeated span; its opening sentence is removed from
all texts but the first, and stands once for all its holders from then on (a
*set* of texts with the same repeated spans).

Second pass, for what whole sentences miss (spans inside one sentence or across
parts of two): of what is left, and of each set's one copy, every run of ``SPAN``
characters counts, wherever it starts.  Each has a marker, the smallest hash
among its ``GRAM``-character grams; consecutive runs mostly have the same one, so
a text has few, and a marker that one text only has rules its runs out.  The
rest are hashed to 128 bits and joined globally.

The plan is the same at every size.  A filter of fixed size over the repeated
hashes keeps texts and hashes that surely have no partner out of the shuffles;
where the corpus outgrows it, it lets more through and changes no result.

Texts that are exact copies are one class throughout, known by an even 64-bit
hash; sets have odd numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.runtime import materialise

SPAN = 160
GRAM = 64
#: Bits of the filter of repeated hashes that is sent to the workers (32 MB, whatever the corpus); 0 for none.
FILTER_BITS = 1 << 28
#: Bits of the filter of documents that have any of them (4 MB).
DOCUMENT_BITS = 1 << 25
#: Characters hashed at once; longer texts are cut into parts that overlap by a run.
PART = 1 << 19
#: A sentence ends behind its final marks and blanks, or behind line breaks.
SENTENCE_END = re.compile(r"[.!?;:…。！？]+[\"')\]»”]*\s+|[。！？]|\n+")

_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_HELD = "class_id bigint, cells array<bigint>, checks array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (base, inverse))


class Hashed:
    """Prefix sums of a sequence of codes, from which any run's hash follows: a polynomial modulo 2^64, freed of its position and mixed."""

    def __init__(self, codes: np.ndarray, base: int):
        up, self.down = _powers(base, PART + SPAN)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of every run of ``length`` codes."""
        n = max(len(self.sums) - length, 0)
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each run from ``start`` to ``stop``."""
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by windows that double."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sentence_ends(text: str) -> list[int]:
    """Where the sentences of a text end; each begins where the one before ends, the last ends with the text."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


class Group:
    """Joined texts of up to ``PART`` characters: their hashes, sentences and markers by position in the whole.

    ``row``, ``offset``, ``lo`` and ``hi`` say for each piece which text it is, where
    it starts there, and from where to where it lies here.
    """

    def __init__(self, pieces: list[str], row: list[int], offset: list[int], span: int, gram: int):
        self.span, self.gram = span, gram
        sizes = np.array([len(p) for p in pieces])
        self.hi = np.cumsum(sizes)
        self.lo = self.hi - sizes
        self.row, self.offset = np.array(row), np.array(offset)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = _mix((codes + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        self.first, self.second = (Hashed(codes, b) for b in _ODD)
        ends = [sentence_ends(p) for p in pieces]
        self.stops = np.concatenate([np.array(e) + lo for e, lo in zip(ends, self.lo, strict=True)])
        self.piece = np.repeat(np.arange(len(pieces)), [len(e) for e in ends])
        self.starts = np.concatenate(([0], self.stops[:-1]))

    def markers(self) -> np.ndarray:
        """Of every run of ``span`` characters the smallest hash of its grams, even; runs across two pieces mean nothing."""
        return running_min(self.first.every(self.gram), self.span - self.gram + 1) & ~np.uint64(1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, h, check): the run from each sentence on that all runs of ``span`` characters starting in it lie in.

        Sentences too near the end of their piece for such a run have none.  h is odd.
        """
        upto = np.minimum(np.searchsorted(self.stops, self.stops + self.span - 1), len(self.stops) - 1)
        stop = np.minimum(self.stops[upto], self.hi[self.piece])
        at = np.flatnonzero(stop - self.starts >= self.span)
        return at, self.first.between(self.starts[at], stop[at]) | np.uint64(1), self.second.between(self.starts[at], stop[at])


def groups(texts: list[str | None], span: int, gram: int) -> Iterator[Group]:
    """The texts of at least ``span`` characters, joined.  A longer text comes in parts, the next starting where a run starts that did not fit."""
    pieces, row, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        for start in range(0, len(text) - span + 1, PART - span + 1):
            part = text[start : start + PART]
            if size and size + len(part) > PART:
                yield Group(pieces, row, offset, span, gram)
                pieces, row, offset, size = [], [], [], 0
            pieces.append(part)
            row.append(i)
            offset.append(start)
            size += len(part)
    if size:
        yield Group(pieces, row, offset, span, gram)


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _passing(bitmap):
    """The rows whose ``key`` is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(bits, batch.column("key").to_numpy().view(np.uint64))))

    return run


def _cells(span: int, gram: int, bitmap):
    """Per text its distinct markers and sentence runs, with a second hash of the latter; behind a filter only what passes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        for batch in batches:
            for group in groups(batch.column("text").to_pylist(), span, gram):
                least = group.markers()
                # where a marker differs from the one before; each piece's first always counts
                change = np.ones(len(least), bool)
                np.not_equal(least[1:], least[:-1], out=change[1:])
                last = group.hi - span
                change[group.lo[group.lo <= last]] = True
                at = np.flatnonzero(change)
                piece = np.searchsorted(group.hi, at, side="right")
                inside = at <= last[piece]
                at, piece = at[inside], piece[inside]
                sentence, h, check = group.runs()
                row = np.concatenate((group.row[piece], group.row[group.piece[sentence]]))
                cell = np.concatenate((least[at], h))
                checks = np.concatenate((np.zeros(len(at), np.uint64), check))
                if bits is not None:
                    hit = _in_filter(bits, cell)
                    row, cell, checks = row[hit], cell[hit], checks[hit]
                order = np.lexsort((checks, cell, row))
                row, cell, checks = row[order], cell[order], checks[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]) | (checks[1:] != checks[:-1])
                row, cell, checks = row[fresh], cell[fresh], checks[fresh]
                rows, begin = np.unique(row, return_index=True)
                ends = np.concatenate((begin, [len(row)])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.view(np.int64))) for v in (cell, checks)]
                yield pa.record_batch([batch.column("class_id").take(pa.array(rows, pa.int64())), *lists], names=["class_id", "cells", "checks"])

    return run


def _known_runs(group: Group, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, set, whether the text is the set's first) of the sentences that begin a repeated run."""
    sentence, h, check = group.runs()
    rows = group.row[group.piece[sentence]]
    found: list[tuple[int, int, bool]] = []
    known: dict[int, dict] = {}
    for k, i in enumerate(rows.tolist()):
        if i not in known:
            known[i] = {(r["h"], r["c"]): (r["s"], r["f"]) for r in batch.column("runs")[i].as_py()}
        if known[i] and (hit := known[i].get((int(h[k].view(np.int64)), int(check[k].view(np.int64))))):
            found.append((int(sentence[k]), *hit))
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], bool)


def _windows(span: int, gram: int):
    """Runs of ``span`` characters behind repeated markers: those of a set from its first text, others for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("class_id").to_numpy()
            marks = [np.sort(m.values.to_numpy(zero_copy_only=False)) for m in batch.column("marks")]
            for group in groups(batch.column("text").to_pylist(), span, gram):
                least = group.markers().view(np.int64)
                # what each sentence's runs are emitted as: its text, its set, or nothing where the set's first text has them
                owner, keep = ids[group.row[group.piece]], np.ones(len(group.piece), bool)
                sentence, sets, first = _known_runs(group, batch)
                owner[sentence], keep[sentence] = sets, first
                hits = []
                for i, lo, hi in zip(group.row, group.lo, group.hi, strict=True):
                    own = least[lo : hi - span + 1]
                    if len(marks[i]):
                        near = np.minimum(np.searchsorted(marks[i], own), len(marks[i]) - 1)
                        hits.append(np.flatnonzero(marks[i][near] == own) + lo)
                at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                at_sentence = np.searchsorted(group.stops, at, side="right")
                at, at_sentence = at[keep[at_sentence]], at_sentence[keep[at_sentence]]
                one, two = (x.every(span)[at].view(np.int64) for x in (group.first, group.second))
                token, piece = owner[at_sentence], group.piece[at_sentence]
                place = at - group.lo[piece] + group.offset[piece]
                order = np.lexsort((two, one, token))
                fresh = np.ones(len(order), bool)
                a, b = order[1:], order[:-1]
                fresh[1:] = (token[a] != token[b]) | (one[a] != one[b]) | (two[a] != two[b])
                copies = np.zeros(len(order), bool)
                copies[order] = ~fresh
                columns = [pa.array(token), pa.array(place, pa.int64()), pa.array(copies), pa.array(one), pa.array(two)]
                yield pa.record_batch(columns, names=["token", "start", "again", "h1", "h2"])

    return run


def _ranges(span: int, gram: int):
    """The sentences that begin a repeated run: where they lie, and whether the text is the first that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("class_id").to_numpy()
            for group in groups(batch.column("text").to_pylist(), span, gram):
                sentence, _, first = _known_runs(group, batch)
                piece = group.piece[sentence]
                move = group.offset[piece] - group.lo[piece]
                # a run starts in the sentence, and where it still fits in
                last = np.minimum(group.stops[sentence] - 1, group.hi[piece] - span)
                columns = [ids[group.row[piece]], group.starts[sentence] + move, last + move, group.stops[sentence] + move]
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(first)], names=["class_id", "start", "last", "stop", "first"])

    return run


def _bitmap(hashes: DataFrame, bits: int):
    """The low bits of column h as a broadcast bitmap, put together from parts of 4 KB."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    part = F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767)))
    whole = bytearray(max(bits // 8, 4096))
    for row in hashes.groupBy(F.shiftright(low, 15).alias("part")).agg(part.alias("bits")).toLocalIterator():
        whole[row["part"] * 4096 : (row["part"] + 1) * 4096] = row["bits"]
    return hashes.sparkSession.sparkContext.broadcast(bytes(whole))


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, text): class_id is equal for equal texts, and even; texts that are null have none."""
    even = F.xxhash64("text").bitwiseAND(F.lit(-2))
    return documents.where(F.col("text").isNotNull()).select("doc_id", even.alias("class_id"), "text")


def _signature(member: str) -> list[Column]:
    """What tells sets of members apart: their number, the smallest and largest (all there is to a pair), and a 64-bit hash of all."""
    return [F.count(F.lit(1)).alias("n"), F.min(member).alias("lo"), F.max(member).alias("hi"), F.bit_xor(F.xxhash64(member)).alias("all")]


_SIGNED = ["n", "lo", "hi", "all"]


class SharedSpans:
    """The repeated spans of a table of texts, found once; see the module's docstring.

    ``holders``: (set_id, class_id) of every set of texts with the same repeated
    sentence runs.  ``chosen``: (doc_id, class_id, marks, runs), for one document of
    each class the hashes that other classes have as well.
    """

    def __init__(self, documents: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS):
        if not 0 < gram < span:
            raise ValueError("gram must be shorter than span")
        self.documents, self.span, self.gram, self.filter_bits = documents, span, gram, filter_bits
        self.texts = text_classes(documents)
        plain = self.texts.select("class_id", "text")
        cells = plain.mapInArrow(_cells(span, gram, None), _HELD).select("class_id", F.explode("cells").alias("h"))
        ends = cells.groupBy("h").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"))
        repeated = materialise(ends.where(F.col("lo") != F.col("hi")).select("h"), "repeated")
        self.bitmap = _bitmap(repeated, filter_bits) if filter_bits else None
        passed = plain.mapInArrow(_cells(span, gram, self.bitmap), _HELD).select("class_id", F.explode(F.arrays_zip("cells", "checks")).alias("c"))
        mine = passed.select("class_id", F.col("c.cells").alias("h"), F.col("c.checks").alias("check")).join(repeated, "h").distinct()
        mine = materialise(mine, "cells")
        is_run = F.col("h").bitwiseAND(F.lit(1)) == 1
        runs = mine.where(is_run)
        sets = runs.groupBy("h", "check").agg(*_signature("class_id")).where(F.col("lo") != F.col("hi"))
        sets = sets.withColumn("set_id", F.min("h").over(Window.partitionBy(*_SIGNED)))
        held = materialise(runs.join(sets.select("h", "check", "set_id", "lo"), ["h", "check"]), "runs")
        self.holders = held.select("set_id", "class_id").distinct()
        one = F.struct("h", F.col("check").alias("c"), F.col("set_id").alias("s"), (F.col("class_id") == F.col("lo")).alias("f"))
        told = mine.where(~is_run).select("class_id", "h", F.lit(None).cast("struct<h:bigint,c:bigint,s:bigint,f:boolean>").alias("r"))
        told = told.unionByName(held.select("class_id", F.lit(None).cast("bigint").alias("h"), one.alias("r")))
        stands = self.texts.groupBy("class_id").agg(F.min("doc_id").alias("doc_id"))
        lists = told.groupBy("class_id").agg(F.collect_list("h").alias("marks"), F.collect_list("r").alias("runs"))
        self.chosen = materialise(lists.join(stands, "class_id"), "chosen")

    def _marked(self, worker, ddl: str) -> DataFrame:
        """``worker`` over the texts of the chosen documents beside their hashes."""
        texts = self.documents.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).where(F.length("text") >= self.span)
        if self.filter_bits:
            wanted = _bitmap(self.chosen.select(F.xxhash64("doc_id").alias("h")), min(self.filter_bits, DOCUMENT_BITS))
            texts = texts.mapInArrow(_passing(wanted), texts.schema)
        both = texts.drop("key").join(self.chosen, "doc_id").select("class_id", "text", "marks", "runs")
        return both.mapInArrow(worker(self.span, self.gram), ddl)

    def windows(self) -> DataFrame:
        """(token, start, again, h1, h2): runs of characters that others may have; ``again`` if the token had the run before."""
        return self._marked(_windows, "token bigint, start bigint, again boolean, h1 bigint, h2 bigint")

    def ranges(self) -> DataFrame:
        """(class_id, start, last, stop, first): sentences that begin a repeated run, and the last character it starts at."""
        return self._marked(_ranges, "class_id bigint, start bigint, last bigint, stop bigint, first boolean")

    def sentence_links(self) -> DataFrame:
        """(a, b), a < b: classes with a sentence run in common."""
        return _pairs(self.holders.withColumnRenamed("set_id", "g").withColumnRenamed("class_id", "m"))

    def window_links(self) -> DataFrame:
        """(a, b), a < b: tokens, that is classes or sets, with a run of characters in common."""
        rows = materialise(self.windows().where(~F.col("again")).select("token", "h1", "h2"), "windows")
        sets = rows.groupBy("h1", "h2").agg(*_signature("token")).where(F.col("lo") != F.col("hi"))
        # runs that the same tokens have give the same pairs: one of each such set is enough
        one = materialise(sets.groupBy(*_SIGNED).agg(F.min(F.struct("h1", "h2")).alias("g")).select("n", "lo", "hi", "g.h1", "g.h2"), "one")
        two = one.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        more = rows.join(one.where("n > 2").select("h1", "h2"), ["h1", "h2"]).select(F.struct("h1", "h2").alias("g"), F.col("token").alias("m")).distinct()
        return two.unionByName(_pairs(materialise(more, "more")))

    def class_links(self) -> DataFrame:
        """(class_a, class_b), a < b: classes that share a run of ``span`` characters, by sentences or by characters."""
        tokens = materialise(self.window_links().distinct(), "tokens")
        members = self.holders.select(F.col("set_id").alias("t"), F.col("class_id").alias("c"))
        plain = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 0
        for end in ("a", "b"):
            spread = tokens.where(~plain(end)).join(members, F.col(end) == F.col("t")).withColumn(end, F.col("c")).select("a", "b")
            tokens = tokens.where(plain(end)).unionByName(spread)
        both = tokens.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return both.unionByName(self.sentence_links()).distinct().select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: members ``m`` of the same group ``g``."""
    left, right = members.select("g", F.col("m").alias("a")), members.select("g", F.col("m").alias("b"))
    return left.join(right, "g").where("a < b").select("a", "b").distinct()


def shared_pairs(documents: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pairs of documents whose texts share a run of ``span`` characters.

    Exact copies of at least ``span`` characters are pairs, too.  Null, empty and
    shorter texts are in none.
    """
    links = SharedSpans(documents, span, gram, filter_bits).class_links()
    return document_pairs(documents, links, span)


def document_pairs(documents: DataFrame, links: DataFrame, span: int = SPAN) -> DataFrame:
    """Links of classes, and the exact copies within classes, as pairs of documents."""
    members = text_classes(documents).where(F.length("text") >= span).select("doc_id", "class_id")
    copied = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = links.unionByName(copied.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    side = lambda c: members.select(F.col("class_id").alias(f"class_{c}"), F.col("doc_id").alias(f"d{c}"))
    pairs = both.join(side("a"), "class_a").join(side("b"), "class_b").where((F.col("class_a") != F.col("class_b")) | (F.col("da") < F.col("db")))
    return pairs.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))


def sentence_pairs(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """As ``shared_pairs``, by whole sentences alone: what the first pass finds."""
    links = SharedSpans(documents, span, gram).sentence_links()
    return document_pairs(documents, links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), span)


def _sized(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_chars, copies, first_doc) of every document; a null text has 0 characters and no class."""
    sizes = documents.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(-2)).alias("class_id"), F.col("text").isNull().alias("none"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    own = sizes.where(~F.col("none")).groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return sizes.join(own, "class_id", "left").drop("none")


def covered(ranges: DataFrame) -> DataFrame:
    """(class_id, covered): characters that the ranges from ``start`` to before ``stop`` of each class cover together."""
    order = Window.partitionBy("class_id").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0))
    return ranges.withColumn("_tw_more", more).groupBy("class_id").agg(F.sum("_tw_more").alias("covered"))


def shared_share(documents: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_chars, n_shared, share): how much of each text also stands in another document.

    A character counts if it lies in a run of ``span`` characters that another
    document has; in a text that has copies all do.  Null and empty texts have 0
    characters and a share of 0.
    """
    found = SharedSpans(documents, span, gram, filter_bits)
    rows = materialise(found.windows(), "windows")
    ends = rows.groupBy("h1", "h2").agg(F.min("token").alias("lo"), F.max("token").alias("hi")).where("lo <> hi")
    own = rows.where(F.col("token").bitwiseAND(F.lit(1)) == 0).join(ends, ["h1", "h2"], "left_semi")
    single = own.select(F.col("token").alias("class_id"), "start", (F.col("start") + span).alias("stop"))
    whole = found.ranges().select("class_id", "start", (F.col("last") + span).alias("stop"))
    known = _sized(documents).join(covered(single.unionByName(whole)), "class_id", "left")
    n = F.when((F.col("copies") > 1) & (F.col("n_chars") >= span), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return known.select("doc_id", "n_chars", n.alias("n_shared"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))


def removed_share(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_chars, n_removed): characters of the sentences that a repeated sentence run opens with and an earlier text has.

    Of exact copies all but the one with the smallest doc_id lose everything, if
    they have ``span`` characters.  What is left of all texts holds each repeated
    run once.
    """
    lost = SharedSpans(documents, span, gram).ranges().where(~F.col("first")).select("class_id", "start", "stop")
    known = _sized(documents).join(covered(lost), "class_id", "left")
    copy = (F.col("doc_id") != F.col("first_doc")) & (F.col("n_chars") >= span)
    return known.select("doc_id", "n_chars", F.when(copy, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("n_removed"))
