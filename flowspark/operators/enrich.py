"""Address enrichment: longest-prefix match as equi-joins on (length, masked address)."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def masked(address: Column, length) -> Column:
    """The address' first `length` bits as hex digits, the rest zero; null where it is too short."""
    size, hex_ = F.length(address), F.hex(address)
    length = F.lit(length) if isinstance(length, int) else length
    full = F.floor(length / 4).cast("int")
    odd = F.pmod(length, F.lit(4)).cast("int")
    digit = F.conv(F.substr(hex_, full + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.when(odd == 0, F.lit("")).otherwise(F.hex(digit - F.pmod(digit, F.pow(F.lit(2), 4 - odd).cast("int"))))
    return F.when(length <= size * 8, F.rpad(F.concat(F.substr(hex_, F.lit(1), full), cut), size * 2, "0"))


def prefixes(table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """table with _bits (4 or 16 bytes' size), _length and _prefix; rows whose text is no network are left out.  Later entries of one network are dropped by the least of the other columns."""

    @F.pandas_udf("bits int, length int, prefix string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                n = ipaddress.ip_network(t, strict=False)
                out.append((n.max_prefixlen, n.prefixlen, n.network_address.packed.hex().upper()))
            except (ValueError, TypeError):
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["bits", "length", "prefix"]).astype({"bits": "Int32", "length": "Int32"})

    return table.withColumn("_p", parsed(cidr)).filter("_p.length IS NOT NULL").select("*", F.col("_p.bits").alias("_bits"), F.col("_p.length").alias("_length"), F.col("_p.prefix").alias("_prefix")).drop("_p")


def longest_match(flows: DataFrame, column: str, networks: DataFrame, values: dict[str, str]) -> DataFrame:
    """flows with values (source column -> new column) of the longest network that holds an address; null without one.

    networks comes from prefixes().  Distinct addresses, not flows, are matched:
    each makes one row a prefix length that occurs (a handful), joined by
    equality, and the longest hit is kept by one aggregation that combines on
    the map side.  The answers join back by address.
    """
    lengths = [(r["_bits"], r["_length"]) for r in networks.select("_bits", "_length").distinct().orderBy("_bits", "_length").collect()]  # at most 33 + 129
    one = networks.groupBy("_bits", "_length", "_prefix").agg(*[F.min(c).alias(c) for c in values])
    addresses = flows.select(F.col(column).alias("_a")).filter(F.length("_a").isin(4, 16)).distinct()
    tries = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in lengths]) if lengths else F.array().cast("array<struct<b:int,n:int>>")
    tried = addresses.withColumn("_t", F.explode(F.filter(tries, lambda t: t["b"] == F.length("_a") * 8)))
    tried = tried.select("_a", F.col("_t.b").alias("_bits"), F.col("_t.n").alias("_length"), masked(F.col("_a"), F.col("_t.n")).alias("_prefix"))
    hits = tried.join(one, ["_bits", "_length", "_prefix"])
    best = hits.groupBy("_a").agg(F.max(F.struct("_length", *values)).alias("_best"))
    best = best.select(F.col("_a").alias("_key"), *[F.col(f"_best.{c}").alias(new) for c, new in values.items()])
    return flows.join(best, F.col(column) == F.col("_key"), "left").drop("_key")


def enrich(flows: DataFrame, asn: DataFrame | None = None, country: DataFrame | None = None, sampling_rate: int = 0) -> DataFrame:
    """AS numbers (asn: cidr, asn) and countries (country: cidr, country) of both addresses; a sampling rate above 0 replaces the flow's.

    Where the AS table has no network the flow's own number becomes 0, as a
    lookup of an unknown address; without a table it stays.
    """
    out = flows
    for side in ("src", "dst"):
        if asn is not None:
            out = longest_match(out, f"{side}_addr", prefixes(asn), {"asn": "_asn"}).withColumn(f"{side}_as", F.coalesce("_asn", F.lit(0)).cast("long")).drop("_asn")
        if country is not None:
            out = longest_match(out, f"{side}_addr", prefixes(country), {"country": f"{side}_country"}).withColumn(f"{side}_country", F.coalesce(f"{side}_country", F.lit("")))
    return out.withColumn("sampling_rate", F.lit(sampling_rate).cast("long")) if sampling_rate > 0 else out
