"""Address reputation: longest-prefix match and octet reversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The prefixes and systems known from the start.
ASN_TRUST = [
    ("AS15169", "HighTrust"), ("AS32934", "HighTrust"), ("AS13335", "HighTrust"), ("AS3320", "ResidentialIsp"),
    ("AS45758", "ResidentialIsp"), ("AS7922", "ResidentialIsp"), ("AS22773", "ResidentialIsp"), ("AS209", "ResidentialIsp"),
]
PREFIX_ASN = [
    ("8.8.8.0", 24, "AS15169"), ("142.250.0.0", 15, "AS15169"), ("172.217.0.0", 16, "AS15169"), ("216.58.0.0", 16, "AS15169"),
    ("157.240.0.0", 16, "AS32934"), ("31.13.0.0", 16, "AS32934"), ("1.1.1.0", 24, "AS13335"), ("104.16.0.0", 12, "AS13335"),
]
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def seed_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(asn_trust, prefix_asn) of the fixed tables."""
    return spark.createDataFrame(ASN_TRUST, "asn string, trust string"), spark.createDataFrame(PREFIX_ASN, "network string, len int, asn string")


def ip_bits(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = F.split(ip, r"\.")
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + F.get(part, F.lit(i)).try_cast("long")
    return F.when(ip.rlike(IPV4), total)


def masked(bits: Column, length: Column) -> Column:
    """The first ``length`` bits, the others 0."""
    width = (32 - length).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", bits, width), width)


def reversed_octets(ip: Column) -> Column:
    return F.array_join(F.reverse(F.split(ip, r"\.")), ".")


def with_asn(rows: DataFrame, ip: str, prefixes: DataFrame, out: str = "asn") -> DataFrame:
    """Add ``out``: the system of the longest prefix that holds the address, null without one.

    A range join made equal: the prefixes' own lengths (33 at most) give each
    address as many keys to look up.  ``prefixes``: network, len, asn; rows with
    a bad network or a length over 32 are ignored, of equal prefixes the smallest
    asn holds.  Each distinct address is looked up once, so hot addresses cost
    nothing extra.
    """
    good = prefixes.where((F.col("len") >= 0) & (F.col("len") <= 32) & ip_bits(F.col("network")).isNotNull())
    table = good.select(F.col("len").alias("_tw_len"), masked(ip_bits(F.col("network")), F.col("len")).alias("_tw_key"), "asn").groupBy("_tw_len", "_tw_key").agg(F.min("asn").alias("asn"))
    asked = rows.select(F.col(ip).alias("_tw_ip")).where(F.col("_tw_ip").isNotNull()).distinct()
    keys = asked.select("_tw_ip", ip_bits(F.col("_tw_ip")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("_tw_len")).where(F.col("b").isNotNull())
    hits = keys.select("_tw_ip", "_tw_len", masked(F.col("b"), F.col("_tw_len")).alias("_tw_key")).join(table, ["_tw_len", "_tw_key"])
    best = hits.groupBy("_tw_ip").agg(F.max_by("asn", "_tw_len").alias(out))
    return rows.join(best, rows[ip] == best["_tw_ip"], "left").drop("_tw_ip")


def with_trust(rows: DataFrame, asn: str, trust: DataFrame, out: str = "trust") -> DataFrame:
    """Add ``out``: the trust of a system, ``Unknown`` without an entry."""
    table = trust.groupBy(F.col("asn").alias("_tw_asn")).agg(F.min("trust").alias("_tw_trust"))
    return rows.join(table, rows[asn] == table["_tw_asn"], "left").withColumn(out, F.coalesce("_tw_trust", F.lit("Unknown"))).drop("_tw_asn", "_tw_trust")


def octet_reversals(rows: DataFrame, ip: str, prefixes: DataFrame, trust: DataFrame) -> DataFrame:
    """(ip, reversed_ip, forward_asn, reversed_asn): trusted addresses whose reversal is residential."""
    asked = rows.select(F.col(ip).alias("ip")).where(ip_bits(F.col("ip")).isNotNull()).distinct().withColumn("reversed_ip", reversed_octets(F.col("ip")))
    forward = with_trust(with_asn(asked, "ip", prefixes, "forward_asn"), "forward_asn", trust, "forward_trust").where(F.col("forward_trust") == "HighTrust")
    both = with_trust(with_asn(forward, "reversed_ip", prefixes, "reversed_asn"), "reversed_asn", trust, "reversed_trust")
    return both.where(F.col("reversed_trust") == "ResidentialIsp").select("ip", "reversed_ip", "forward_asn", "reversed_asn")
