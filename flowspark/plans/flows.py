"""The flows view of the driver's events table, in Spark and as a DuckDB common table expression, and its wire encoders.

The encoders are independent of the decoders: they only build hex text, so a
shared mistake cannot cancel out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import floor_div

#: The view, as SQL that both engines read; {addr} and friends are given by each engine.
PROTO_SQL = "CASE event_type WHEN 'signup' THEN 6 WHEN 'purchase' THEN 17 WHEN 'view' THEN 1 WHEN 'click' THEN 58 ELSE 47 END"

FLOWS_SQL = f"""
SELECT event_id, epoch_us(ts) * 1000 AS time_received_ns, epoch_us(ts) * 1000 - (event_id % 1000) * 1000000 AS time_flow_start_ns,
  event_id AS sequence_num, 1 + event_id % 4 AS sampling_rate, 184483840 + event_id % 8 AS sampler,
  CAST(round(value * 100) AS BIGINT) AS bytes, 1 + event_id % 10 AS packets, 167772160 + user_id AS src, 184549376 + event_id * 7 % 5000 AS dst,
  CASE WHEN event_id % 5 = 0 THEN 34525 ELSE 2048 END AS etype, {PROTO_SQL} AS proto, event_id % 65536 AS src_port, (event_id * 13) % 1024 AS dst_port,
  event_id % 16 AS in_if, event_id % 12 AS out_if, event_id * 1048573 AS src_mac, user_id % 65536 AS src_as, (event_id * 7) % 300 AS dst_as,
  event_id % 13 AS icmp_type, event_id % 33 AS src_net
FROM events"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows made from events: addresses as bytes, IPv6 for every fifth row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, user = F.col("event_id"), F.col("user_id")
    received = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    v6 = i % 5 == 0
    src, dst = F.lit(167772160) + user, F.lit(184549376) + i * 7 % 5000
    proto = F.when(F.col("event_type") == "signup", 6).when(F.col("event_type") == "purchase", 17).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 58).otherwise(47)
    return e.select(
        i, received.alias("time_received_ns"), (received - i % 1000 * 1_000_000).alias("time_flow_start_ns"), i.alias("sequence_num"),
        (1 + i % 4).alias("sampling_rate"), octets(F.lit(184483840) + i % 8, 4).alias("sampler_address"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"), (1 + i % 10).alias("packets"),
        F.when(v6, v6_address(src)).otherwise(octets(src, 4)).alias("src_addr"), F.when(v6, v6_address(dst)).otherwise(octets(dst, 4)).alias("dst_addr"),
        F.when(v6, 34525).otherwise(2048).cast("long").alias("etype"), proto.cast("long").alias("proto"), (i % 65536).alias("src_port"),
        (i * 13 % 1024).alias("dst_port"), (i % 16).alias("in_if"), (i % 12).alias("out_if"), (i * 1048573).alias("src_mac"),
        (user % 65536).alias("src_as"), (i * 7 % 300).alias("dst_as"), (i % 13).alias("icmp_type"), (i % 33).alias("src_net"),
        src.alias("src"), dst.alias("dst"),
    )


def hexed(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def octets(value: Column, n: int) -> Column:
    return F.unhex(hexed(value, n))


def v6_address(value: Column) -> Column:
    """2001:db8:: with the value in the last four bytes."""
    return F.unhex(F.concat(F.lit("20010DB8" + "00" * 8), hexed(value, 4)))


#: DuckDB text of the view's addresses.
def ip_sql(value: str) -> str:
    v4 = f"concat_ws('.', {value} >> 24, ({value} >> 16) & 255, ({value} >> 8) & 255, {value} & 255)"
    group = lambda s: f"CAST(format('{{:x}}', {s}) AS VARCHAR)"
    return f"CASE WHEN etype = 34525 THEN '2001:db8::' || {group(f'{value} >> 16')} || ':' || {group(f'{value} & 65535')} ELSE {v4} END"


UPTIME = 10_000_000  # ms, of every encoded datagram


def as_v5(view: DataFrame, per_datagram: int = 10) -> DataFrame:
    """Datagrams of up to per_datagram records; a record's first packet was event_id % 1000 ms, its last event_id % 100 ms before."""
    i = F.col("event_id")
    record = F.concat(
        hexed(F.col("src"), 4), hexed(F.col("dst"), 4), F.lit("0A000001"), hexed(F.col("in_if"), 2), hexed(F.col("out_if"), 2), hexed(F.col("packets"), 4),
        hexed(F.col("bytes"), 4), hexed(F.lit(UPTIME) - i % 1000, 4), hexed(F.lit(UPTIME) - i % 100, 4), hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2),
        F.lit("00"), hexed(i % 64, 1), hexed(F.col("proto"), 1), hexed(i % 256, 1), hexed(F.col("src_as"), 2), hexed(F.col("dst_as"), 2), hexed(F.col("src_net") % 33, 1), F.lit("180000"),
    )
    rows = view.select(floor_div(i, per_datagram).alias("g"), i, record.alias("record"), (F.col("time_received_ns")).alias("ns"))
    packed = rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("event_id", "record"))).alias("rs"), F.max("ns").alias("received_ns"), F.count("*").alias("n"))
    seconds = floor_div(F.col("received_ns"), 1_000_000_000)
    header = F.concat(F.lit("0005"), hexed(F.col("n"), 2), hexed(F.lit(UPTIME), 4), hexed(seconds, 4), F.lit("00000000"), hexed(F.col("g"), 4), F.lit("0101"), hexed(F.lit(0x4000 + 100), 2))
    payload = F.unhex(F.concat(header, F.array_join(F.transform("rs", lambda r: r["record"]), "")))
    return packed.select(
        octets(F.lit(184483840) + F.col("g") % 8, 4).alias("src_addr"), F.lit(2055).alias("src_port"), octets(F.lit(184483583), 4).alias("dst_addr"), F.lit(2055).alias("dst_port"),
        payload.alias("payload"), "received_ns", F.col("g").alias("seq"),
    )


def _grouped(view: DataFrame, record: Column, per_datagram: int) -> DataFrame:
    """g, n and the records' hex texts of each datagram, in order."""
    rows = view.select(floor_div(F.col("event_id"), per_datagram).alias("g"), "event_id", record.alias("record"))
    packed = rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("event_id", "record"))).alias("rs"), F.count("*").alias("n"))
    return packed.withColumn("body", F.array_join(F.transform("rs", lambda r: r["record"]), "")).drop("rs")


START_S, EXPORTERS = 1_700_000_000, 8
FIRST_TEMPLATE, SECOND_TEMPLATE, FIRST_RATE, SECOND_RATE = 2, 20, 5, 30


def _datagrams(rows: DataFrame, hex_payload: Column, nudge: int = 0) -> DataFrame:
    """Datagrams of exporter g % EXPORTERS at second g; nudge: ns later."""
    return rows.select(
        octets(F.lit(184483840) + F.col("g") % EXPORTERS, 4).alias("src_addr"), F.lit(2055).alias("src_port"), octets(F.lit(184483583), 4).alias("dst_addr"), F.lit(2055).alias("dst_port"),
        F.unhex(hex_payload).alias("payload"), ((F.lit(START_S) + F.col("g")) * 1_000_000_000 + nudge).alias("received_ns"), (F.col("g") * 4 + nudge).alias("seq"),
    )


def _set(number: int, body: Column) -> Column:
    padded = F.concat(body, F.repeat(F.lit("0"), F.pmod(-F.length(body), F.lit(8)).cast("int")))
    return F.concat(hexed(F.lit(number), 2), hexed(F.length(padded) / 2 + 4, 2), padded)


def _v9(count: Column, body: Column) -> Column:
    return F.concat(F.lit("0009"), hexed(count, 2), hexed(F.lit(UPTIME), 4), hexed(F.lit(START_S) + F.col("g"), 4), hexed(F.col("g"), 4), hexed(F.lit(256), 4), body)


def _template(number: int, fields: list[tuple[int, int]]) -> str:
    return f"{number:04X}{len(fields):04X}" + "".join(f"{k:04X}{n:04X}" for k, n in fields)


#: Two layouts of one template id; the second replaces the first in the middle of each exporter's stream.
LAYOUT_A = [(1, 4), (2, 4), (8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (10, 2), (14, 2), (22, 4), (21, 4), (16, 2), (17, 2)]
LAYOUT_B = [(12, 4), (8, 4), (4, 1), (2, 8), (1, 8), (11, 2), (7, 2), (17, 4), (16, 4), (21, 4), (22, 4), (14, 4), (10, 4)]


def _layout(fields: list[tuple[int, int]]) -> Column:
    i = F.col("event_id")
    of = {
        1: F.col("bytes"), 2: F.col("packets"), 8: F.col("src"), 12: F.col("dst"), 7: F.col("src_port"), 11: F.col("dst_port"), 4: F.col("proto"), 10: F.col("in_if"), 14: F.col("out_if"),
        22: F.lit(UPTIME) - i % 1000, 21: F.lit(UPTIME) - i % 100, 16: F.col("src_as"), 17: F.col("dst_as"),
    }
    return F.concat(*[hexed(of[k], n) for k, n in fields])


def as_v9(view: DataFrame, per_datagram: int = 10) -> DataFrame:
    """Data datagrams, the two templates and two sampling rates of every exporter; the first data comes before any template."""
    k = floor_div(floor_div(F.col("event_id"), per_datagram), EXPORTERS)
    record = F.when(k < SECOND_TEMPLATE, _layout(LAYOUT_A)).otherwise(_layout(LAYOUT_B))
    data = _grouped(view, record, per_datagram)
    at = floor_div(F.col("g"), EXPORTERS)
    out = _datagrams(data, _v9(F.lit(1), _set(260, F.col("body"))), 2)
    for when, layout in ((FIRST_TEMPLATE, LAYOUT_A), (SECOND_TEMPLATE, LAYOUT_B)):
        out = out.unionByName(_datagrams(data.filter(at == when), _v9(F.lit(1), _set(0, F.lit(_template(260, layout))))))
    options = "0101" + "0004" + "0008" + "00010004" + "00300001" + "00220004"  # template 257: scope system; sampler id, interval
    for when, rate in ((FIRST_RATE, 100), (SECOND_RATE, 200)):
        body = F.concat(F.lit("00000001"), F.lit("01"), hexed(F.lit(rate) + F.col("g") % EXPORTERS, 4))
        both = F.concat(_set(1, F.lit(options)), _set(257, body))
        out = out.unionByName(_datagrams(data.filter(at == when), _v9(F.lit(2), both), 1))
    return out


def as_ipfix(view: DataFrame, per_datagram: int = 10) -> DataFrame:
    """Self-describing messages: template 300 with a variable-length name and an enterprise field, then its data."""
    template = "012C" + "000B" + "00080004" + "000C0004" + "00010004" + "00020004" + "00070002" + "000B0002" + "00040001" + "0060FFFF" + "800100040000270F" + "00980008" + "00990008"
    i = F.col("event_id")
    name = F.repeat(F.lit("61"), (i % 5).cast("int"))
    milli = floor_div(F.col("time_received_ns"), 1_000_000)
    record = F.concat(
        hexed(F.col("src"), 4), hexed(F.col("dst"), 4), hexed(F.col("bytes"), 4), hexed(F.col("packets"), 4), hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2), hexed(F.col("proto"), 1),
        hexed(i % 5, 1), name, hexed(F.col("in_if"), 4), hexed(milli - i % 1000, 8), hexed(milli, 8),
    )
    data = _grouped(view, record, per_datagram)
    body = F.concat(_set(2, F.lit(template)), F.concat(F.lit("012C"), hexed(F.length("body") / 2 + 4, 2), F.col("body")))
    message = F.concat(F.lit("000A"), hexed(F.length(body) / 2 + 16, 2), hexed(F.lit(START_S) + F.col("g"), 4), hexed(F.col("g"), 4), hexed(F.lit(7), 4), body)
    return _datagrams(data, message)


def frame() -> Column:
    """Ethernet, 802.1Q, IPv4, UDP: a frame's hex text."""
    i = F.col("event_id")
    return F.concat(
        F.lit("0A0000000001"), hexed(F.col("src_mac"), 6), F.lit("8100"), hexed(i % 4096, 2), F.lit("0800"), F.lit("45"), hexed(i % 256, 1), F.lit("0030"), hexed(i % 65536, 2), F.lit("4000"),
        hexed(i % 200, 1), F.lit("11"), F.lit("0000"), hexed(F.col("src"), 4), hexed(F.col("dst"), 4), hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2), F.lit("001C0000"), F.repeat(F.lit("00"), 20),
    )


def as_sflow(view: DataFrame, per_datagram: int = 10) -> DataFrame:
    """A flow sample a flow, with its raw header, switch, router and gateway records, and one counter sample a datagram."""
    i = F.col("event_id")
    head = frame()
    raw = F.concat(F.lit("00000001"), hexed(F.col("bytes"), 4), F.lit("00000000"), hexed(F.length(head) / 2, 4), head, F.repeat(F.lit("0"), F.pmod(-F.length(head), F.lit(8)).cast("int")))
    part = lambda kind, body: F.concat(hexed(F.lit(kind), 4), hexed(F.length(body) / 2, 4), body)
    switch = F.concat(hexed(i % 100, 4), F.lit("00000000"), hexed(i % 90, 4), F.lit("00000000"))
    router = F.concat(F.lit("000000010A0000FE"), F.lit("00000018"), F.lit("00000010"))
    gateway = F.concat(F.lit("000000010A0000FD"), F.lit("0000FDE8"), hexed(F.col("src_as"), 4), F.lit("00000000"), F.lit("00000001"), F.lit("00000002"), F.lit("00000002"), F.lit("0000FDE9"), hexed(F.col("dst_as"), 4), F.lit("00000001"), F.lit("FDE80064"), F.lit("00000064"))
    records = F.concat(part(1, raw), part(1001, switch), part(1002, router), part(1003, gateway))
    body = F.concat(hexed(i, 4), F.lit("00000001"), hexed(F.col("sampling_rate"), 4), F.lit("00000000"), F.lit("00000000"), hexed(F.col("in_if"), 4), hexed(F.col("out_if"), 4), F.lit("00000004"), records)
    data = _grouped(view, part(1, body), per_datagram)
    counters = F.lit("00000002" + "0000000C" + "00000001" + "00000001" + "00000000")
    message = F.concat(F.lit("00000005"), F.lit("00000001"), hexed(F.lit(184483840) + F.col("g") % EXPORTERS, 4), F.lit("00000001"), hexed(F.col("g"), 4), hexed(F.lit(UPTIME), 4), hexed(F.col("n") + 1, 4), F.col("body"), counters)
    return _datagrams(data, message)


def as_ipfix_options(view: DataFrame) -> DataFrame:
    """as_ipfix() and, just after each exporter's datagram FIRST_RATE, an options template with its sampling rate."""
    data = _grouped(view, F.lit("00"), 10)
    body = F.concat(_set(3, F.lit("012D" + "0002" + "0001" + "00950004" + "01310004")), _set(301, F.concat(F.lit("00000007"), hexed(F.lit(300) + F.col("g") % EXPORTERS, 4))))
    message = F.concat(F.lit("000A"), hexed(F.length(body) / 2 + 16, 2), hexed(F.lit(START_S) + F.col("g"), 4), hexed(F.col("g"), 4), hexed(F.lit(7), 4), body)
    told = data.filter(floor_div(F.col("g"), EXPORTERS) == FIRST_RATE)
    return as_ipfix(view).unionByName(_datagrams(told, message, 1))


def v6_hex(value: Column) -> Column:
    return F.concat(F.lit("20010DB8" + "00" * 8), hexed(value, 4))


SHAPES = 9


def stacked_frame() -> Column:
    """A frame's hex text, of one of nine stacks of layers by event_id % 9 (see stack_sql)."""
    i = F.col("event_id")
    eth = lambda kind: F.concat(F.lit("0A0000000001"), hexed(F.col("src_mac"), 6), F.lit(kind))
    v4 = lambda proto: F.concat(F.lit("45"), hexed(i % 256, 1), F.lit("0030"), hexed(i % 65536, 2), F.lit("4000"), hexed(i % 200, 1), F.lit(f"{proto:02X}0000"), hexed(F.col("src"), 4), hexed(F.col("dst"), 4))
    word = F.lit(0x60000000) + (i % 256) * 2**20 + i % 2**20
    v6 = lambda following: F.concat(hexed(word, 4), F.lit("0028"), F.lit(f"{following:02X}"), hexed(i % 200, 1), v6_hex(F.col("src")), v6_hex(F.col("dst")))
    ports = F.concat(hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2))
    tcp = lambda words: F.concat(ports, F.lit("00" * 8 + f"{words:X}0"), hexed(i % 64, 1), F.lit("00" * (4 * words - 14)))
    udp = lambda port: F.concat(hexed(F.col("src_port") % 6000 + 100 * 256, 2), F.lit(f"{port:04X}" + "00200000"))
    icmp = F.concat(hexed(i % 13, 1), F.lit("03" + "00" * 6))
    label = hexed((i % 1000 + 16) * 4096 + 256 + 64, 4)
    fragment = F.concat(F.lit("1100"), hexed((i % 100) * 8 + 1, 2), hexed(i, 4))
    routing = F.concat(F.lit("3B04040101000000"), v6_hex(F.col("dst")), v6_hex(F.col("src")))
    shapes = [
        F.concat(eth("8847"), label, v4(6), tcp(5)), F.concat(eth("86DD"), v6(6), tcp(8)), F.concat(eth("86DD"), v6(44), fragment, udp(9000)), F.concat(eth("86DD"), v6(43), routing),
        F.concat(eth("0800"), v4(47), F.lit("00000800"), v4(1), icmp), F.concat(eth("0800"), v4(17), udp(6081), F.lit("0000655800000000"), eth("0800"), v4(1), icmp),
        F.concat(eth("86DD"), v6(17), udp(3544), v6(59)), F.concat(eth("86DD"), v6(58), icmp), F.concat(eth("0800"), v4(17), udp(53), F.repeat(F.lit("00"), (i % 7).cast("int"))),
    ]
    out = shapes[0]
    for k in range(1, SHAPES):
        out = F.when(i % SHAPES == k, shapes[k]).otherwise(out)
    return out


#: Counters of an interface record (with their widths) and of an Ethernet record, in order, as the query's SQL names them.
INTERFACE_WIDTHS = [4, 4, 8, 4, 4, 8, 4, 4, 4, 4, 4, 4, 8, 4, 4, 4, 4, 4, 4]


def as_sflow_all(view: DataFrame, per_datagram: int = 10) -> DataFrame:
    """Expanded flow samples with IPv4 or IPv6 records; in each datagram also a counter sample, an expanded one and a drop sample."""
    i, g = F.col("event_id"), F.col("g")
    part = lambda kind, body: F.concat(F.lit(f"{kind:08X}"), hexed(F.length(body) / 2, 4), body)
    tail = F.concat(hexed(F.col("src_port"), 4), hexed(F.col("dst_port"), 4), hexed(i % 64, 4), hexed(i % 256, 4))
    head = F.concat(hexed(F.col("bytes"), 4), hexed(F.col("proto"), 4))
    ipv4 = part(3, F.concat(head, hexed(F.col("src"), 4), hexed(F.col("dst"), 4), tail))
    ipv6 = part(4, F.concat(head, v6_hex(F.col("src")), v6_hex(F.col("dst")), tail))
    record = F.when(F.col("etype") == 34525, ipv6).otherwise(ipv4)
    sample = F.concat(hexed(i, 4), F.lit("0000000000000001"), hexed(F.col("sampling_rate"), 4), F.lit("00" * 8), F.lit("00000000"), hexed(F.col("in_if"), 4), F.lit("00000000"), hexed(F.col("out_if"), 4), F.lit("00000001"), record)
    data = _grouped(view, part(3, sample), per_datagram)
    interface = part(1, F.concat(*[hexed(g % 97 + k, n) for k, n in enumerate(INTERFACE_WIDTHS)]))
    ethernet = part(2, F.concat(*[hexed(g % 89 + k, 4) for k in range(13)]))
    counter = part(2, F.concat(hexed(g, 4), F.lit("00000007" + "00000001"), interface))
    expanded = part(4, F.concat(hexed(g, 4), F.lit("00000000" + "00000009" + "00000001"), ethernet))
    drop = part(5, F.concat(hexed(g, 4), F.lit("00000000" + "00000003"), hexed(g % 5, 4), F.lit("00000004" + "00000005"), hexed(g % 7, 4), F.lit("00000001"), part(1036, hexed(g % 11, 4))))
    message = F.concat(F.lit("00000005" + "00000001"), hexed(F.lit(184483840) + g % EXPORTERS, 4), F.lit("00000001"), hexed(g, 4), hexed(F.lit(UPTIME), 4), hexed(F.col("n") + 3, 4), F.col("body"), counter, expanded, drop)
    return _datagrams(data, message)
