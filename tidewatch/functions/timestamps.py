"""Instants from timestamp text: an ordered cascade of anchored patterns.

Each pattern matches a whole text or nothing, is parsed strictly (a field out
of range gives no instant) and stays inside the JVM.  Wall-clock text takes its
zone from the caller; what happens to times that occur twice or never is an
explicit policy.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# Offsets in minutes of the zone abbreviations that are read.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

_ZONE = r"(Z|[A-Z]{3,5}|[+-][0-9]{2}(?::?[0-9]{2})?)?"
_BRACKET = r"(?:\[([A-Z0-9_+\-/]+)\])?"
_TIME = r"([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?"
_TAIL = r" ?" + _ZONE + _BRACKET + "$"
# The cascade: name, anchored pattern, and where its groups go in
# year|month|day|hour|minute|second|fraction|half of day|zone|named zone.  Month
# holds a number, a name, Wnn for a week or nothing for a day of the year.
CASCADE = [
    ("iso", r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]" + _TIME + _TAIL, "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("week", r"^([0-9]{4})-?(W[0-9]{2})-?([0-9])[T ]" + _TIME + _TAIL, "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", r"^([0-9]{4})([0-9]{2})([0-9]{2})[T ]([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)?" + _TAIL, "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("us", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}),? ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: ?([AP]M))?" + _TAIL, "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("mail", r"^(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN),? )?([0-9]{1,2}) (" + "|".join(MONTHS) + r") ([0-9]{4}) ([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    ("ordinal", r"^([0-9]{4})-?([0-9]{3})[T ]" + _TIME + _TAIL, "$1||$2|$3|$4|$5|$6||$7|$8"),
]
EPOCH_NUMBER = r"^([0-9]{1,19})(?:[.]([0-9]+))?$"
UTC_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+]00:00)$"
#: Seconds of 2001-01-01 and 2101-01-01; a plain number is in the unit that puts it between them.
EPOCH_LOW, EPOCH_HIGH = 978_307_200, 4_133_980_800
DAY_US = 86_400_000_000


# Zone names the JVM knows under an id of its own besides those it lists.
EXTRA_ZONES = {"EST": "-05:00", "MST": "-07:00", "HST": "-10:00"}


def known_zones(spark: SparkSession) -> set[str]:
    """The zone names that can be read: all of the JVM that plans and runs the expressions."""
    listed = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()
    return {z for z in listed.toArray() if not z.startswith("SystemV/")} | set(EXTRA_ZONES)


def unknown_zones(sensors: DataFrame, zone: str = "clock_zone") -> DataFrame:
    """(zone, n): zone names that nothing is known of, whose wall-clock times are read as UTC."""
    spark = sensors.sparkSession
    names = spark.createDataFrame([(z,) for z in sorted(known_zones(spark))], f"`{zone}` string")
    return sensors.where(F.col(zone).isNotNull()).join(F.broadcast(names), zone, "left_anti").groupBy(F.col(zone).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic that cannot fail."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    m = F.when(month <= 2, month + 9).otherwise(month - 3)
    return y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.floor((m * 153 + 2) / 5) + day - 719469


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _month_length(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _map(entries: dict) -> Column:
    """A map literal; one expression text, since building it item by item costs a call each."""
    return F.expr("map(" + ", ".join(f"{k!r}, {v!r}" for k, v in entries.items()) + ")")


def _fraction(digits: Column, places: int) -> Column:
    return F.rpad(F.substring(F.coalesce(digits, F.lit("")), 1, places), places, "0").try_cast("long")


def _offset_at(utc_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def with_instant(
    df: DataFrame,
    text: str = "timestamp",
    zone: str | None = None,
    received: str | None = None,
    out: str = "utc_us",
    ambiguous: str = "later_if_received",
    nonexistent: str = "offset_before",
) -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC that ``text`` denotes, or null.

    ``zone`` names a column with the zone of wall-clock text (null or unknown:
    UTC), ``received`` a timestamp column.  ``ambiguous``: ``later_if_received``
    takes the later reading unless it is after ``received`` (or that is null),
    ``earlier``, ``later`` or ``null``.  ``nonexistent``: ``offset_before`` or
    ``offset_after`` the change, or ``null``.  Null, blank and unreadable text
    gives null; digits finer than microseconds are cut off; 24:00 is the end of
    its day.  All other columns stay.  One narrow pass, no shuffle.
    """
    if ambiguous not in ("later_if_received", "earlier", "later", "null"):
        raise ValueError(f"ambiguous: {ambiguous}")
    if nonexistent not in ("offset_before", "offset_after", "null"):
        raise ValueError(f"nonexistent: {nonexistent}")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    raw = F.btrim(F.col(f"`{text}`"), F.lit(" \t\r\n\f"))
    step = df.select(*keep, F.upper(raw).alias("_tw_s"))
    s = F.col("_tw_s")
    parts = F.when(s.rlike(EPOCH_NUMBER), F.lit(None).cast("string"))
    for _, pattern, order in CASCADE:
        parts = parts.when(s.rlike(pattern), F.regexp_replace(s, pattern, order))
    step = step.select(*keep, "_tw_s", F.split(parts, r"\|").alias("_tw_p"))
    part = [F.get(F.col("_tw_p"), i) for i in range(10)]
    number = lambda c: c.try_cast("int")
    month_no = F.coalesce(number(part[1]), F.try_element_at(_map({m: i + 1 for i, m in enumerate(MONTHS)}), part[1]))
    step = step.select(
        *keep, "_tw_s",
        number(part[0]).cast("long").alias("_tw_y"),
        month_no.alias("_tw_mo"),
        F.when(part[1].startswith("W"), number(F.substring(part[1], 2, 2))).alias("_tw_w"),
        number(part[2]).alias("_tw_d"),
        number(part[3]).alias("_tw_h"),
        F.when(part[4] == "", 0).otherwise(number(part[4])).alias("_tw_mi"),
        F.when(part[5] == "", 0).otherwise(number(part[5])).alias("_tw_se"),
        _fraction(part[6], 6).alias("_tw_f"),
        part[7].alias("_tw_half"), part[8].alias("_tw_z"), part[9].alias("_tw_named"),
        (part[1] == "").alias("_tw_ord"),
    )
    y, mo, w, d, h, mi, se = (F.col(f"_tw_{c}") for c in ("y", "mo", "w", "d", "h", "mi", "se"))
    half, z = F.col("_tw_half"), F.col("_tw_z")
    first = _days(y, F.lit(1), F.lit(1))
    # ISO week 1 holds 4 January; days count from its Monday.  1970-01-01 was a Thursday.
    jan4 = first + 3
    monday = jan4 - F.pmod(jan4 + 3, F.lit(7))
    next_jan4 = _days(y + 1, F.lit(1), F.lit(1)) + 3
    weeks = (next_jan4 - F.pmod(next_jan4 + 3, F.lit(7)) - monday) / 7
    date = (
        F.when(y < 1, F.lit(None))
        .when(w.isNotNull(), F.when(w.between(1, weeks) & d.between(1, 7), monday + (w - 1) * 7 + d - 1))
        .when(F.col("_tw_ord"), F.when(d.between(1, F.when(_leap(y), 366).otherwise(365)), first + d - 1))
        .when(mo.between(1, 12) & d.between(1, _month_length(y, mo)), _days(y, mo, d))
    ).cast("long")
    hour = F.when(half.isin("AM", "PM"), F.when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))).when(
        h.between(0, 23) | ((h == 24) & (mi == 0) & (se == 0) & (F.col("_tw_f") == 0)), h
    )
    clock = F.when(mi.between(0, 59) & se.between(0, 59), (hour.cast("long") * 3600 + mi * 60 + se) * 1_000_000 + F.col("_tw_f"))
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    z_h, z_m = number(F.substring(z, 2, 2)), number(F.right(z, F.lit(2)))
    minutes = F.when(
        z.rlike("^[+-]"),
        F.when(F.length(z) == 3, F.when(z_h <= 23, sign * z_h * 60)).when((z_h <= 23) & (z_m <= 59), sign * (z_h * 60 + z_m)),
    ).otherwise(F.try_element_at(_map(ABBREVIATIONS), z))
    n = F.regexp_extract("_tw_s", EPOCH_NUMBER, 1).try_cast("decimal(20,0)")
    frac = F.regexp_extract("_tw_s", EPOCH_NUMBER, 2)
    scaled = lambda unit: n.between(EPOCH_LOW * unit, EPOCH_HIGH * unit - 1)
    epoch = (
        F.when(scaled(1), n.cast("long") * 1_000_000 + _fraction(frac, 6))
        .when(scaled(1000), n.cast("long") * 1000 + _fraction(frac, 3))
        .when(scaled(1_000_000), n.cast("long"))
        .when(scaled(1_000_000_000), F.floor(n / 1000).cast("long"))
    )
    known = known_zones(df.sparkSession)
    names = {k.upper(): k for k in known if "/" in k or k == "UTC"}
    zone_col = F.col(f"`{zone}`") if zone else F.lit(None).cast("string")
    listed = F.expr(f"`{zone}` IN ({', '.join(map(repr, sorted(known)))})") if zone else F.lit(False)
    fixed = F.try_element_at(_map(EXTRA_ZONES), zone_col)
    usable = F.when(listed, F.coalesce(fixed, zone_col)).otherwise(F.lit("UTC"))
    named = F.col("_tw_named")
    step = step.select(
        *keep,
        F.when(F.col("_tw_y").isNull(), epoch).alias("_tw_epoch"),
        (date * DAY_US + clock).alias("_tw_wall"),
        F.when(z != "", minutes.cast("long") * 60_000_000).alias("_tw_off"),
        (z == "").alias("_tw_bare"),
        F.when(named == "", usable).otherwise(F.try_element_at(_map(names), named)).alias("_tw_zone"),
    )
    wall, local = F.col("_tw_wall"), F.col("_tw_zone")
    moving = F.col("_tw_bare") & (local != "UTC")
    step = step.select(
        *keep, "_tw_epoch", "_tw_wall", "_tw_off", "_tw_bare", "_tw_zone",
        F.when(moving, _offset_at(wall - DAY_US, local)).alias("_tw_o1"),
        F.when(moving, _offset_at(wall + DAY_US, local)).alias("_tw_o2"),
    )
    o1, o2 = F.col("_tw_o1"), F.col("_tw_o2")
    ok1, ok2 = _offset_at(wall - o1, local) == o1, _offset_at(wall - o2, local) == o2
    earlier, later = F.least(wall - o1, wall - o2), F.greatest(wall - o1, wall - o2)
    null = F.lit(None).cast("long")
    if ambiguous == "later_if_received":
        twice = F.when(later <= F.unix_micros(F.col(f"`{received}`")), later).otherwise(earlier) if received else earlier
    else:
        twice = {"earlier": earlier, "later": later, "null": null}[ambiguous]
    never = {"offset_before": wall - o1, "offset_after": wall - o2, "null": null}[nonexistent]
    moved = F.when(o1 == o2, wall - o1).when(ok1 & ok2, twice).when(ok1, wall - o1).when(ok2, wall - o2).otherwise(never)
    utc = F.coalesce(
        F.col("_tw_epoch"),
        F.when(F.col("_tw_bare"), F.when(local == "UTC", wall).when(local.isNotNull(), moved)).otherwise(wall - F.col("_tw_off")),
    )
    # The condition always holds.  It keeps the optimizer from copying this deep expression into filters
    # above (each level refers to the one below several times, so that it would grow exponentially).
    return step.select(*keep, F.when(F.spark_partition_id() >= 0, utc).alias(out))


#: The shapes that are read without leaving the JVM; every other text goes to the standard library's own reader.
PLAIN_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,9})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?$"


_DATE = r"[0-9]{4}-?(?:[0-9]{2}-?[0-9]{2}|W[0-9]{2}(?:-?[0-9])?)"
#: Fractions of anything but seconds, in the time or in the offset, which some versions of the library take.
_EARLY_FRACTION = re.compile(rf"{_DATE}.[0-9]{{2}}(:?[0-9]{{2}})?[.,]|.*[+-][0-9]{{2}}(:?[0-9]{{2}})?[.,][0-9]+$", re.DOTALL)
#: The end of a day as hour 24, which some versions refuse; nothing but zeros may follow.
_DAY_END = re.compile(rf"({_DATE})(.)24((?::?00){{0,2}}(?:[.,]0+)?(?:Z|[+-][0-9:.]+)?)", re.DOTALL)


@pandas_udf(LongType())
def _library_instant(texts: pd.Series) -> pd.Series:
    def read(text):
        try:
            more = 0
            if _EARLY_FRACTION.match(text):
                return None
            if end := _DAY_END.fullmatch(text):
                # midnight before the next day; day 0 of a month has the first as its next
                date, more = end[1], 1
                if date.endswith("00") and "W" not in date:
                    date, more = date[:-2] + "01", 0
                text = f"{date}{end[2]}00{end[3]}"
            value = dt.datetime.fromisoformat(text) + dt.timedelta(days=more)
            value = (value if value.tzinfo else value.replace(tzinfo=dt.UTC)).astimezone(dt.UTC)
        except (TypeError, ValueError, OverflowError):
            return None
        since = value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds

    return texts.map(read, na_action="ignore").astype("Int64")


def iso_instant(text: Column) -> Column:
    """Microseconds since 1970 UTC of an event's timestamp by the rules of ISO 8601 readers, null for what they refuse.

    No outer blanks, epoch numbers, slashes or lower-case z; dates alone, weeks and
    basic forms are read, offsets may have seconds, digits finer than microseconds
    are cut off, text without an offset is UTC.
    """
    part = lambda i, n: F.substring(text, i, n).try_cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    exists = (year >= 1) & month.between(1, 12) & day.between(1, _month_length(year, month))
    clock = (part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)).cast("long") * 1_000_000
    zone = F.regexp_extract(text, r"([+-])([0-9]{2}):([0-9]{2})$", 0)
    shift = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")).cast("long") * 60_000_000
    offset = F.when(zone == "", 0).when(zone.startswith("-"), -shift).otherwise(shift)
    plain = text.rlike(PLAIN_ISO) & year.between(2, 9998)
    quick = F.when(exists, _days(year, month, day).cast("long") * DAY_US + clock + _fraction(F.regexp_extract(text, r"[.]([0-9]+)", 1), 6) - offset)
    return F.coalesce(F.when(plain, quick), _library_instant(F.when(~plain, text)))


def already_utc_iso(text: Column) -> Column:
    """Whether text is ``YYYY-MM-DDThh:mm:ss``, an optional fraction, then ``Z`` or ``+00:00``."""
    return F.coalesce(text.rlike(UTC_ISO), F.lit(False))
