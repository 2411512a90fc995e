"""Same or near-same records across splits.

A record is a set of hashed, canonicalised contents.  Records with equal sets
collapse to one class, whatever their number.  Classes are compared by an exact
set-similarity join: contents are ordered from rare to frequent, and two sets
that share enough must share one of their first few (a prefix), so a content
that a third of all records hold is almost never a join key.  Candidates are
then verified on the full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.events import canonical_json, host_of
from tidewatch.runtime import materialise

TRAIN = "train"


def folded(text: Column) -> Column:
    """Text without case, punctuation and runs of blanks: what is left are its letters and digits, one blank between words."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def event_content(event: Column, fold: bool = False) -> Column:
    """Hash of what an event says: source, severity in upper case, kind as a JSON value, host.

    Case of the severity, key order and spacing of the kind do not count; id,
    timestamp and other metadata neither.  With ``fold``, case, punctuation and
    whitespace count nowhere.  Null parts differ from all texts.
    """
    parts = [event["source"], F.upper(event["severity"]), canonical_json(event["kind"]), host_of(event["metadata"])]
    if fold:
        parts = [folded(p) for p in parts]
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])


def window_sets(windows: DataFrame, fold: bool = False) -> DataFrame:
    """(window_id, split, source, label, contents): the sorted distinct contents of every window with events.

    A null element counts as an event of nulls; windows whose events are null or
    empty have no row.
    """
    sets = F.array_sort(F.array_distinct(F.transform("events", lambda e: event_content(e, fold))))
    return windows.where(F.size("events") > 0).select("window_id", "split", "source", "label", sets.alias("contents"))


def classes(sets: DataFrame) -> DataFrame:
    """Add ``class_id``, two hashes of the set: equal for equal sets and, but for 128-bit collisions, only for these."""
    return sets.withColumn("class_id", F.struct(*[F.xxhash64(F.lit(seed), F.col("contents")).alias(n) for n, seed in (("a", 17), ("b", 31))]))


def prefixes(distinct: DataFrame, least: float) -> DataFrame:
    """(class_id, size, content): each set's rarest contents, as many as a similar set must meet one of.

    A Jaccard similarity of ``least`` means sharing at least ceil(least * size)
    contents, so of size - ceil(least * size) + 1 contents one is shared,
    whichever order is taken; the order is by frequency, rare first.
    """
    cells = distinct.select("class_id", F.size("contents").alias("size"), F.explode("contents").alias("content"))
    frequency = cells.groupBy("content").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        cells.join(frequency.where("df > 1"), "content")
        .groupBy("class_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("df", "content"))).alias("by_df"))
    )
    # contents of one class only come first in the order; they use up places of the prefix without being keys
    places = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1 - (F.col("size") - F.size("by_df"))
    keys = F.slice("by_df", 1, F.greatest(places, F.lit(0)).cast("int"))
    return ranked.select("class_id", "size", F.explode(keys).alias("k")).select("class_id", "size", F.col("k.content").alias("content"))


def similar_classes(distinct: DataFrame, least: float) -> DataFrame:
    """(class_a, class_b, shared, total): pairs of different classes of similarity ``least`` or more.

    ``distinct`` has one row per class: class_id, contents, in_train, in_other.
    Only pairs with training records on one side and others on the other count.
    """
    keys = prefixes(distinct, least).join(distinct.select("class_id", "in_train", "in_other"), "class_id")
    a, b = keys.alias("a"), keys.alias("b")
    fits = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(least) - 1e-9
    crossing = (F.col("a.in_train") & F.col("b.in_other")) | (F.col("a.in_other") & F.col("b.in_train"))
    candidates = (
        a.join(b, (F.col("a.content") == F.col("b.content")) & (F.col("a.class_id") < F.col("b.class_id")) & fits & crossing)
        .select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"))
        .distinct()
    )
    left = distinct.select(F.col("class_id").alias("class_a"), F.col("contents").alias("set_a"))
    right = distinct.select(F.col("class_id").alias("class_b"), F.col("contents").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        candidates.join(left, "class_a")
        .join(right, "class_b")
        .select("class_a", "class_b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("total"))
        .where(F.col("shared") >= F.col("total") * F.lit(least) - 1e-9)
    )


def split_classes(windows: DataFrame, fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, classes), both written once: windows with a split, and one row per class of equal sets.

    members: window_id, split, source, label, class_id; classes: class_id,
    contents, in_train, in_other and, of its training windows, zeros and ones.
    """
    sets = materialise(classes(window_sets(windows.where(F.col("split").isNotNull()), fold)), "window-sets")
    train = F.col("split") == TRAIN
    labelled = lambda y: F.count_if(train & (F.col("label") == y))
    # the contents are equal in a class, so any of them stands for it
    distinct = sets.groupBy("class_id").agg(
        F.first("contents").alias("contents"), F.max(train).alias("in_train"), F.max(~train).alias("in_other"), labelled(0).alias("zeros"), labelled(1).alias("ones")
    )
    return sets.drop("contents"), materialise(distinct, "window-classes")


def class_links(distinct: DataFrame, least: float) -> DataFrame:
    """(train_class, other_class, shared, total): classes of similarity ``least`` or more, each class with itself included."""
    near = similar_classes(distinct, least)
    size = F.size("contents")
    links = distinct.where(F.col("in_train") & F.col("in_other")).select(
        F.col("class_id").alias("train_class"), F.col("class_id").alias("other_class"), size.alias("shared"), size.alias("total")
    )
    for one, two in (("class_a", "class_b"), ("class_b", "class_a")):
        links = links.unionByName(near.select(F.col(one).alias("train_class"), F.col(two).alias("other_class"), "shared", "total"))
    return links


def cross_split_pairs(windows: DataFrame, least: float = 0.6, fold: bool = False) -> DataFrame:
    """Pairs of a training window and a window of another non-null split of similarity ``least`` or more.

    Columns: train_id, train_source, train_label, other_id, other_split,
    other_source, other_label, shared, total.  Exact copies have shared = total.
    Windows with a null split, and windows without events, are in no pair; tables
    without windows give no rows.  ``fold`` ignores case, punctuation and blanks.
    """
    members, distinct = split_classes(windows, fold)
    links = class_links(distinct, least)
    train = F.col("split") == TRAIN
    side = lambda p, keep: members.where(keep).select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("class_id", "class"), ("window_id", "id"), ("split", "split"), ("source", "source"), ("label", "label"))])
    return links.join(side("train", train), "train_class").join(side("other", ~train), "other_class").drop("train_class", "other_class", "train_split")


def overlapping_windows(windows: DataFrame, least: float = 0.6, fold: bool = False) -> DataFrame:
    """(window_id, split, source, label, exact, train_zeros, train_ones) of every evaluation window that overlaps.

    ``train_zeros`` and ``train_ones`` count the training windows it is paired with
    by their label.  Counted on classes: copies are never paired one by one.
    """
    members, distinct = split_classes(windows, fold)
    links = class_links(distinct, least)
    counted = links.join(distinct.select(F.col("class_id").alias("train_class"), "zeros", "ones"), "train_class")
    per = counted.groupBy("other_class").agg(F.max(F.col("shared") == F.col("total")).alias("exact"), F.sum("zeros").alias("train_zeros"), F.sum("ones").alias("train_ones"))
    held = members.where(F.col("split") != TRAIN)
    return held.join(per, held.class_id == per.other_class).drop("class_id", "other_class")


def disagrees() -> Column:
    """Whether an overlapping window's label differs from one of its training windows'; null labels differ from none."""
    return F.coalesce(((F.col("label") == 0) & (F.col("train_ones") > 0)) | ((F.col("label") == 1) & (F.col("train_zeros") > 0)), F.lit(False))


def overlap_report(windows: DataFrame, least: float = 0.6, fold: bool = False) -> DataFrame:
    """(split, source, n_windows, n_overlapping, n_exact, n_disagreeing) per evaluation split and source.

    A window overlaps if it is in any pair, exactly if in one of equal sets, and
    disagrees if its label differs from that of a training window it is paired
    with (null labels disagree with none).
    """
    found = overlapping_windows(windows, least, fold).select(F.col("window_id").alias("other_id"), "exact", disagrees().alias("differs"))
    held = windows.where(F.col("split").isNotNull() & (F.col("split") != TRAIN)).select("window_id", "split", "source")
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    return held.join(found, held.window_id == found.other_id, "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_windows"),
        count(F.col("other_id").isNotNull()).alias("n_overlapping"),
        count(F.col("exact")).alias("n_exact"),
        count(F.col("differs")).alias("n_disagreeing"),
    )
