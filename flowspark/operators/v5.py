"""NetFlow version 5: header and records by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import field, unmap_v4
from ..schema import FLOW_FIELDS

#: Byte offset and length of the header's and a record's fields.
HEADER = {"version": (0, 2), "count": (2, 2), "sys_uptime": (4, 4), "unix_secs": (8, 4), "unix_nsecs": (12, 4), "flow_sequence": (16, 4), "engine_type": (20, 1), "engine_id": (21, 1), "sampling_interval": (22, 2)}
RECORD = {
    "input": (12, 2), "output": (14, 2), "dpkts": (16, 4), "doctets": (20, 4), "first": (24, 4), "last": (28, 4), "src_port": (32, 2),
    "dst_port": (34, 2), "pad1": (36, 1), "tcp_flags": (37, 1), "proto": (38, 1), "tos": (39, 1), "src_as": (40, 2), "dst_as": (42, 2),
    "src_mask": (44, 1), "dst_mask": (45, 1), "pad2": (46, 2),
}
ADDRESSES = {"src_addr": 0, "dst_addr": 4, "next_hop": 8}
HEADER_BYTES, RECORD_BYTES = 24, 48


def is_v5(payload: Column) -> Column:
    return (F.length(payload) >= HEADER_BYTES) & (F.hex(F.substring(payload, 1, 2)) == "0005")


def decode(datagrams: DataFrame, strict: bool = False) -> DataFrame:
    """One row a record: the datagram's columns but its payload, ``h`` (header), ``r`` (record) and ``rec_idx``.

    A header may promise more records than the datagram holds; those come out
    as zeros, or with strict not at all.
    """
    payload = F.col("payload")
    header = F.struct(*[field(payload, o, n).alias(name) for name, (o, n) in HEADER.items()])
    base = datagrams.filter(is_v5(payload)).withColumn("h", header)
    held = F.floor((F.length(payload) - HEADER_BYTES) / RECORD_BYTES).cast("int")
    n = F.least(F.col("h.count").cast("int"), held) if strict else F.col("h.count").cast("int")
    base = base.withColumn("_n", n).withColumn("_held", held).filter("_n > 0")
    base = base.withColumn("rec_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.col("rec_idx") * RECORD_BYTES + HEADER_BYTES + 1
    base = base.withColumn("_r", F.when(F.col("rec_idx") < F.col("_held"), F.substring(payload, at, RECORD_BYTES)).otherwise(F.unhex(F.lit("00" * RECORD_BYTES))))
    record = F.struct(*[F.substring("_r", o + 1, 4).alias(name) for name, o in ADDRESSES.items()], *[field(F.col("_r"), o, n).alias(name) for name, (o, n) in RECORD.items()])
    return base.withColumn("r", record).drop("payload", "_n", "_held", "_r")


def normalize(records: DataFrame) -> DataFrame:
    """Decoded records as flows, all columns of the flow schema."""
    base = F.col("h.unix_secs") * 1_000_000_000 + F.col("h.unix_nsecs")
    ago = lambda name: F.pmod(F.col("h.sys_uptime") - F.col(f"r.{name}"), F.lit(2**32)) * 1_000_000
    given = {
        "type": F.lit(2), "time_received_ns": F.col("received_ns"), "sequence_num": F.col("h.flow_sequence"),
        "sampling_rate": F.col("h.sampling_interval").bitwiseAND(F.lit(0x3FFF)), "sampler_address": unmap_v4(F.col("_source")),
        "time_flow_start_ns": base - ago("first"), "time_flow_end_ns": base - ago("last"), "bytes": F.col("r.doctets"),
        "packets": F.col("r.dpkts"), "src_addr": F.col("r.src_addr"), "dst_addr": F.col("r.dst_addr"), "etype": F.lit(0x800),
        "proto": F.col("r.proto"), "src_port": F.col("r.src_port"), "dst_port": F.col("r.dst_port"), "in_if": F.col("r.input"),
        "out_if": F.col("r.output"), "ip_tos": F.col("r.tos"), "tcp_flags": F.col("r.tcp_flags"), "src_as": F.col("r.src_as"),
        "dst_as": F.col("r.dst_as"), "next_hop": F.col("r.next_hop"), "src_net": F.col("r.src_mask"), "dst_net": F.col("r.dst_mask"),
    }
    out = records.withColumnRenamed("src_addr", "_source")
    return out.select(*[(given[n] if n in given else unset(t)).cast(t).alias(n) for n, t, _ in FLOW_FIELDS])


def unset(kind) -> Column:
    name = kind.simpleString()
    if name.startswith("array"):
        return F.array()
    return F.lit(b"") if name == "binary" else F.lit(0)


def flows(datagrams: DataFrame, strict: bool = False) -> DataFrame:
    return normalize(decode(datagrams, strict))
