"""Decoders: golden packets, goldens of normalisation, malformed input."""

import ipaddress
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.functions import render
from flowspark.functions.arrow import batch_of, schema_of
from flowspark.operators import mapping, netflow, packet, sflow, v5
from flowspark.schema import DATAGRAM_SCHEMA, FLOW_COLUMNS, empty_flow

ip = lambda t: ipaddress.ip_address(t).packed
MAPPING = mapping.Mapping()


def eth(kind: int) -> bytes:
    return bytes.fromhex("000000000002" + "000000000001") + struct.pack(">H", kind)


def ipv4(proto: int, src="10.0.0.1", dst="10.0.0.2") -> bytes:
    return struct.pack(">BBHHHBBH", 0x45, 0, 40, 0xABAB, 0x4000, 255, proto, 0) + ip(src) + ip(dst)


def ipv6(proto: int) -> bytes:
    return struct.pack(">IHBB", 0x6 << 28 | 0x010101, 0, proto, 64) + ip("fd01::1") + ip("fd01::2")


def parse(data: bytes, environment=None, slices=None, flow=None) -> dict:
    return packet.parse(data, flow or empty_flow(), environment, slices)


def test_layers():
    f = parse(eth(0x86DD))
    assert (f["etype"], f["src_mac"], f["dst_mac"], f["layer_stack"]) == (0x86DD, 1, 2, [0])
    f = parse(eth(0x8100) + bytes.fromhex("00140800"))
    assert (f["vlan_id"], f["etype"]) == (20, 0x800)
    f = parse(eth(0x8847) + bytes.fromhex("000120ff000101ff"))
    assert (f["mpls_label"], f["mpls_ttl"]) == ([18, 16], [255, 255])
    f = parse(eth(0x800) + ipv4(1) + bytes([1, 1, 0, 0, 0, 0, 0, 0]))
    assert (f["src_addr"], f["dst_addr"], f["fragment_id"], f["ip_ttl"], f["proto"], f["ip_flags"], f["icmp_type"], f["icmp_code"]) == (ip("10.0.0.1"), ip("10.0.0.2"), 0xABAB, 255, 1, 2, 1, 1)
    f = parse(eth(0x86DD) + ipv6(58) + bytes([128, 128]))
    assert (f["src_addr"], f["ip_ttl"], f["proto"], f["ipv6_flow_label"], f["icmp_type"]) == (ip("fd01::1"), 64, 58, 0x010101, 128)
    f = parse(eth(0x86DD) + ipv6(44) + bytes.fromhex("3a000001a7882ea9") + bytes([128, 0]))
    assert (f["fragment_id"], f["fragment_offset"], f["layer_stack"]) == (2810719913, 0, [0, 2, 11, 8])


def test_stacks():
    f = parse(eth(0x8100) + bytes.fromhex("00148847") + bytes.fromhex("000121ff") + ipv6(58) + bytes([128, 0]))
    assert f["layer_stack"] == [0, 6, 5, 2, 8] and f["etype"] == 0x86DD
    f = parse(eth(0x86DD) + ipv6(47) + bytes.fromhex("00000800") + ipv4(1) + bytes([8, 0] + [0] * 6))
    assert f["layer_stack"] == [0, 2, 9, 1, 7] and f["etype"] == 0x86DD and f["proto"] == 47 and f["src_addr"] == ip("fd01::1") and f["icmp_type"] == 8
    udp = struct.pack(">HHHH", 1000, 6081, 60, 0)
    frame = eth(0x800) + ipv4(17) + udp + bytes.fromhex("0000655800000000") + eth(0x800) + ipv4(1) + bytes(8)
    env = packet.Environment().on_port("udp", "both", 6081, "geneve")
    f = parse(frame, env)
    assert f["layer_stack"] == [0, 1, 4, 12, 0, 1, 7] and (f["src_port"], f["dst_port"]) == (1000, 6081)
    routing = bytes([59, 4, 4, 1, 1, 0, 0, 0]) + ip("fd01::a") + ip("fd01::b")
    f = parse(eth(0x86DD) + ipv6(43) + routing)
    assert f["ipv6_routing_header_addresses"] == [ip("fd01::a"), ip("fd01::b")] and f["ipv6_routing_header_seg_left"] == 1
    f = parse(eth(0x86DD) + ipv6(17) + struct.pack(">HHHH", 9, 3544, 60, 0) + ipv6(59), packet.Environment().on_port("udp", "dst", 3544, "teredo-dst"))
    assert f["layer_stack"] == [0, 2, 4, 13, 2]


def dns(view):
    view.layer("Custom")
    return packet.Step(len(view.data))


def test_own_parsers_and_slices():
    env = packet.Environment().register("dns", dns, level=70).on_port("udp", "dst", 53, "dns")
    frame = eth(0x800) + ipv4(17) + struct.pack(">HHHH", 5000, 53, 37, 0xBEEF) + bytes(29)
    checksum = mapping.Destination("csum", "varint")
    inner = packet.Slice("dns", 0, 8, mapping.Destination("inner", "varint"), True)
    f = parse(frame, env, {"udp": [packet.Slice("udp", 48, 16, checksum)], "dns": [inner]})
    assert len(f["layer_stack"]) == 4 and f["layer_size"][-1] == 29 and f["csum"] == 0xBEEF and "inner" not in f
    assert parse(frame, packet.Environment().register("dns", dns).on_port("udp", "src", 53, "dns"))["layer_stack"] == [0, 1, 4]
    with pytest.raises(ValueError):
        packet.Environment().on_port("udp", "both", 1, "nothing")
    tcp = bytearray(20)
    tcp[12], tcp[13] = 0x80, 0x12
    assert parse(eth(0x800) + ipv4(6) + bytes(tcp))["layer_size"] == [14, 20, 32]
    assert parse(eth(0x800) + ipv4(6) + bytes(tcp), packet.Environment(as_executed=True))["layer_size"] == [14, 20, 24]
    assert parse(eth(0x800) + ipv4(1) + bytes([8, 0, 0, 0, 0, 0, 0, 0]), packet.Environment(as_executed=True))["icmp_type"] == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120), st.sampled_from([b"", eth(0x800), eth(0x86DD), eth(0x8847), eth(0x8100), eth(0x800) + ipv4(47), eth(0x86DD) + ipv6(43)]))
def test_no_frame_breaks_the_parser(tail, head):
    f = parse(head + tail)
    assert len(f["layer_size"]) >= 1


#: A version 5 datagram of six records, by value: src, dst, in, out, packets, bytes, first, last, ports, flags.
V5 = [
    ("10.128.2.121", "10.128.2.1", 9, 2, 5, 590, 8569672 - 4888, 8569672 - 4884 + 3, 8080, 47384, 27),
    ("10.128.2.119", "10.129.2.1", 7, 1, 2, 148, 8569672 - 6395, 8569672 - 5033, 8080, 49452, 18),
]


def v5_datagram(records=V5, count=None) -> bytes:
    head = struct.pack(">HHIIIIBBH", 5, count or len(records), 8569672, 1540209179, 93810119, 25661, 8, 8, 0x4064)
    rows = [ip(s) + ip(d) + bytes(4) + struct.pack(">HHIIIIHHBBBBHHBBH", i, o, p, b, a, z, sp, dp, 0, fl, 6, 0, 0, 0, 24, 16, 0) for s, d, i, o, p, b, a, z, sp, dp, fl in records]
    return head + b"".join(rows)


def datagrams(spark, payloads, src="192.0.2.1", port=2055):
    rows = [(ip(src), port, ip("192.0.2.9"), 2055, p, 10**18 + i, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, DATAGRAM_SCHEMA)


def test_v5(spark):
    rows = v5.flows(datagrams(spark, [v5_datagram(), b"\x00\x05", b"", b"\x00\x09" + bytes(40)], "::ffff:192.0.2.1")).orderBy("in_if").collect()
    assert len(rows) == 2 and v5.flows(datagrams(spark, [v5_datagram()])).columns == FLOW_COLUMNS
    r = rows[1]
    assert (r.bytes, r.packets, r.src_port, r.dst_port, r.tcp_flags, r.sampling_rate, r.src_net, r.dst_net, r.etype, r.type) == (590, 5, 8080, 47384, 27, 100, 24, 16, 0x800, 2)
    assert bytes(r.sampler_address) == ip("192.0.2.1") and r.time_flow_start_ns == 1540209179093810119 - 4888 * 10**6
    assert v5.flows(datagrams(spark, [v5_datagram(count=4)])).filter("bytes = 0").count() == 2
    assert v5.flows(datagrams(spark, [v5_datagram(count=4)]), strict=True).count() == 2
    late = [("10.0.0.1", "10.0.0.2", 1, 1, 1, 1, 8569672 + 10, 8569672, 1, 1, 0)]
    assert v5.flows(datagrams(spark, [v5_datagram(late)])).first().time_flow_start_ns == 1540209179093810119 - (2**32 - 10) * 10**6


def fields(*pairs) -> list:
    return [(False, k, n, 0) for k, n in pairs]


def flow_of(version, export, uptime, pairs, value: str, m=MAPPING):
    f = fields(*pairs)
    c = netflow.Context(version, export, uptime)
    values = next(netflow.records(bytes.fromhex(value), f))
    slow = netflow.one_flow(c, f, values, m)
    assert all_at_once(c, f, [bytes.fromhex(value)] * 2, m) == [slow, slow]
    return slow


def all_at_once(c, f, bodies, m=MAPPING) -> list[dict]:
    """The columns of all sets of a template as dictionaries."""
    many = lambda x: np.full(len(bodies), x, np.int64)
    owner, out = netflow.template_columns(c.version, f, bodies, many(c.export_s), many(c.uptime_ms), m)
    return batch_of(out, len(owner), schema_of(m.schema())).to_pylist()


KINDS = [*netflow.NUMBERS, *netflow.ADDRESSES, *netflow.HOPS, *netflow.TIMES, 60, 32, 139, 58, 197, 70, 71, 72, 47, 140, 21, 22, 312, 999]
CUSTOM = mapping.compile_mapping({
    "formatter": {"protobuf": [{"name": "app", "index": 2001, "type": "string"}, {"name": "number", "index": 2002, "type": "varint"}]},
    "ipfix": {"mapping": [{"field": 96, "destination": "app"}, {"field": 4, "destination": "number", "endian": "little"}, {"penprovided": True, "pen": 9, "field": 1, "destination": "SamplingRate"}]},
    "netflowv9": {"mapping": [{"field": 999, "destination": "number", "endian": "little"}]},
})


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([9, 10]), st.lists(st.tuples(st.booleans(), st.sampled_from([*KINDS, 96, 1]), st.sampled_from([1, 2, 3, 4, 8, 16, netflow.VARIABLE])), min_size=1, max_size=6), st.lists(st.binary(max_size=60), min_size=1, max_size=4))
def test_all_sets_of_a_template_at_once_equal_record_by_record(version, kinds, bodies):
    f = [(pen, k, n, 9 if pen else 0) for pen, k, n in kinds]
    c = netflow.Context(version, 1_700_000_000, 5000)
    try:
        slow = [netflow.one_flow(c, f, v, CUSTOM) for b in bodies for v in netflow.records(b, f)]
    except ValueError:
        with pytest.raises(ValueError):
            all_at_once(c, f, bodies, CUSTOM)
        return
    if any(x > 2**63 - 1 for row in slow for x in row.values() if isinstance(x, int)) or any(x > 2**63 - 1 for row in slow for x in row["mpls_label"]):
        return  # a value that the record-wise way would refuse to store
    try:
        fast = all_at_once(c, f, bodies, CUSTOM)
    except ValueError:  # a wide number in a set without records
        assert any(n > 8 for _, _, n in kinds)
        return
    assert fast == slow


def test_flows_of_faulty_and_sampled_header_sets(spark):
    frame = eth(0x800) + ipv4(6) + bytes(20)
    header = struct.pack(">HHHH", 300, 1, 315, len(frame))
    wide = struct.pack(">HHHH", 301, 1, 1, 9)
    d = datagrams(spark, [message(10, [(2, header + wide), (300, frame * 2), (301, bytes(9)), (300, frame)])])
    rows = netflow.flows(d).collect()
    assert sorted((r.error is None, r.packets, r.bytes, r.sequence_num) for r in rows) == [(False, 0, 0, 7)] + [(True, 1, len(frame), 7)] * 3
    assert all(bytes(r.src_addr) == ip("10.0.0.1") and bytes(r.sampler_address) == ip("192.0.2.1") for r in rows if r.error is None)


def test_repeated_templates_make_one_interval(spark):
    t = message(9, [(0, template(260, (1, 2)))])
    d = datagrams(spark, [t] * 50).withColumn("received_ns", F.col("seq") * 10**10)
    other = datagrams(spark, [message(9, [(0, template(260, (2, 2)))])]).withColumn("received_ns", F.lit(255 * 10**9))
    rows = netflow.sets(d.unionByName(other)).withColumn("template", F.struct("kind", "scopes", "fields"))
    got = netflow.intervals(rows, netflow.TEMPLATE_KEY, ["received_ns", "seq", "set_idx"], "template").orderBy("since").collect()
    assert [(r.since.received_ns, r.until and r.until.received_ns) for r in got] == [(0, 255 * 10**9), (255 * 10**9, 260 * 10**9), (260 * 10**9, None)]


def test_normalisation_goldens():
    assert flow_of(9, 1704067200, 2000, [(22, 4)], "000003e8")["time_flow_start_ns"] == 1704067199 * 10**9
    f = flow_of(9, 1705732882, 218432000, [(22, 4), (21, 4), (70, 3), (71, 3), (72, 3)], f"{218432176:08x}{218432192:08x}05de9433c1850be235")
    assert (f["time_flow_start_ns"], f["time_flow_end_ns"], f["mpls_label"]) == (1705732882176 * 10**6, 1705732882192 * 10**6, [24041, 211992, 48675])
    assert flow_of(10, 1, 0, [(154, 8)], "ebe50e38c50cc000")["time_flow_start_ns"] == 1748668344769725799
    assert flow_of(9, 1, 0, [(1, 4), (23, 4)], "0000000500000007")["bytes"] == 7
    f = flow_of(10, 100, 0, [(8, 4), (27, 16), (12, 4)], "0a000001" + "00" * 16 + "0a000002")
    assert (f["src_addr"], f["etype"]) == (ip("10.0.0.1"), 0x800)
    f = flow_of(10, 100, 0, [(32, 2), (197, 1), (60, 1), (58, 2), (158, 4), (312, 2), (72, 3)], "0803" + "40" + "06" + "0014" + "000003e8" + "0040" + "000101")
    assert (f["icmp_type"], f["icmp_code"], f["ip_flags"], f["etype"], f["vlan_id"], f["src_vlan"], f["bytes"], f["packets"], f["mpls_label"]) == (8, 3, 2, 0x86DD, 20, 20, 64, 1, [0, 0, 16])
    assert f["time_flow_start_ns"] == 100 * 10**9 - 1000 * 1000
    frame = eth(0x800) + ipv4(6) + bytes(20)
    c = netflow.Context(10, 1, 0)
    f = netflow.one_flow(c, fields((315, len(frame))), [frame], MAPPING)
    assert (f["src_addr"], f["packets"], f["bytes"]) == (ip("10.0.0.1"), 1, len(frame))
    with pytest.raises(ValueError):
        netflow.one_flow(c, fields((1, 9)), [bytes(9)], MAPPING)


def message(version: int, sets: list[tuple[int, bytes]], domain=1) -> bytes:
    body = b"".join(struct.pack(">HH", n, len(b) + 4) + b for n, b in sets)
    if version == 9:
        return struct.pack(">HHIIII", 9, len(sets), 1000, 1700000000, 7, domain) + body
    return struct.pack(">HHIII", 10, 16 + len(body), 1700000000, 7, domain) + body


def template(number: int, *pairs) -> bytes:
    return struct.pack(">HH", number, len(pairs)) + b"".join(struct.pack(">HH", k, n) for k, n in pairs)


def test_variable_lengths_padding_and_withdrawal(spark):
    data = b"\x03abc" + b"\x00\x07" + b"\xff\x00\x04wxyz" + b"\x00\x09" + b"\x00"
    assert [v for v in netflow.records(data, fields((96, 0xFFFF), (1, 2)))] == [[b"abc", b"\0\7"], [b"wxyz", b"\0\x09"]]
    assert list(netflow.records(b"abcdef", [])) == [] and list(netflow.records(b"abcdef", fields((1, 0)))) == []
    two = message(10, [(2, template(300, (1, 2))), (300, b"\0\5\0\6\0\7")])
    gone = message(10, [(2, struct.pack(">HH", 300, 0))])
    late = message(10, [(300, b"\0\5")])
    out = netflow.flows(datagrams(spark, [late, two, gone, late]))
    assert sorted(r.bytes for r in out.collect()) == [5, 6, 7]
    assert netflow.errors(datagrams(spark, [late, two, gone, late, b"\x00\x09\x00"])).count() == 3


def test_a_missing_template_costs_the_packet_or_the_set(spark):
    mixed = message(9, [(0, template(260, (1, 2))), (260, b"\0\5\0\0"[:2]), (261, b"\0\6")])
    d = datagrams(spark, [mixed, message(9, [(260, b"\0\x08")])])
    assert [r.bytes for r in netflow.flows(d).collect()] == [8]
    assert sorted(r.bytes for r in netflow.flows(d, drop="set").collect()) == [5, 8]
    other = datagrams(spark, [message(9, [(260, b"\0\x08")])], port=9999)
    assert netflow.flows(d.unionByName(other.withColumn("seq", F.lit(50)).withColumn("received_ns", F.lit(10**18 + 50)))).count() == 1


def test_sampling(spark):
    options = message(9, [(1, struct.pack(">HHH", 257, 4, 8) + struct.pack(">HHHHHH", 1, 4, 48, 1, 34, 4)[:12]), (257, bytes(4) + b"\1" + struct.pack(">I", 512))])
    t = message(9, [(0, template(260, (1, 2))), (260, b"\0\5")])
    out = netflow.flows(datagrams(spark, [t, options, message(9, [(260, b"\0\6")])])).orderBy("bytes").collect()
    assert [(r.bytes, r.sampling_rate) for r in out] == [(5, 0), (6, 512)]


def test_mapping_config(spark):
    m = mapping.compile_mapping({
        "formatter": {"fields": ["bytes", "csum", "icmp_name"], "rename": {"bytes": "octets"}, "key": ["sampler_address"], "protobuf": [{"name": "csum", "index": 999, "type": "varint"}, {"name": "tags", "index": 998, "type": "varint", "array": True}]},
        "netflowv9": {"mapping": [{"field": 34, "destination": "sampling_rate", "endian": "little"}, {"field": 61, "destination": "tags"}, {"field": 62, "destination": "SrcAs"}]},
        "sflow": {"ports": [{"proto": "udp", "dir": "both", "port": 6081, "parser": "geneve"}], "mapping": [{"layer": "UDP", "offset": 48, "length": 16, "destination": "csum"}]},
    })
    assert m.environment.by_port("udp", 1, 6081) == "geneve" and m.schema()["tags"].dataType.simpleString() == "array<bigint>"
    f = netflow.one_flow(netflow.Context(9, 1, 0), fields((34, 4), (61, 1), (61, 1), (62, 2)), [b"\x10\0\0\0", b"\1", b"\2", b"\0\x09"], m)
    assert f["sampling_rate"] == 16 and f["tags"] == [1, 2] and f["src_as"] == 9
    for bad in ({"formatter": {"fields": ["nothing"]}}, {"formatter": {"protobuf": [{"name": "x", "index": 1, "type": "float"}]}}, {"formatter": {"render": {"bytes": "network"}}}):
        with pytest.raises(ValueError):
            mapping.compile_mapping(bad)
    with pytest.warns(UserWarning):
        mapping.compile_mapping({"ipfix": {"mapping": [{"field": 1, "destination": "unheard_of"}]}})


def sample(kind: int, body: bytes) -> bytes:
    return struct.pack(">II", kind, len(body)) + body


def sflow_datagram(*samples: bytes, agent="172.16.0.17") -> bytes:
    return struct.pack(">II", 5, 1) + ip(agent) + struct.pack(">IIII", 1, 426, 1000, len(samples)) + b"".join(samples)


def drop_sample(*records: bytes) -> bytes:
    return sample(5, struct.pack(">IIIIIIII", 1, 0, 2, 3, 4, 5, 6, len(records)) + b"".join(records))


def test_sflow(spark):
    gateway = sample(1003, struct.pack(">I", 1) + ip("5.5.5.5") + struct.pack(">IIIIIIIIIII", 123, 0, 0, 1, 2, 1, 456, 3, 3936619448, 3936619708, 3936623548) + struct.pack(">I", 100))
    router = sample(1002, struct.pack(">I", 1) + ip("9.9.9.9") + struct.pack(">II", 24, 16))
    flow = sample(1, struct.pack(">IIIIIIII", 1, 2, 2048, 0, 0, 7, 8, 2) + gateway + router)
    expanded = sample(3, struct.pack(">IIIIIIIIIII", 1, 0, 2, 64, 0, 0, 0, 70, 0, 80, 1) + sample(3, struct.pack(">II", 100, 17) + ip("1.1.1.1") + ip("2.2.2.2") + struct.pack(">IIII", 53, 54, 0, 4)))
    counter = sample(2, struct.pack(">III", 1, 2, 1) + sample(1, bytes(88)))
    d = datagrams(spark, [sflow_datagram(flow, expanded, counter, drop_sample(sample(1036, struct.pack(">I", 42)))), sflow_datagram(flow)[:-3]])
    rows = sflow.flows(d).filter("error IS NULL").orderBy("in_if").collect()
    a, b = rows
    assert (a.next_hop_as, a.dst_as, a.src_as, list(a.as_path), list(a.bgp_communities)) == (456, 456, 123, [456], [3936619448, 3936619708, 3936623548])
    assert bytes(a.bgp_next_hop) == ip("5.5.5.5") and bytes(a.next_hop) == ip("9.9.9.9") and (a.src_net, a.dst_net, a.sampling_rate, a.packets) == (24, 16, 2048, 1)
    assert (b.in_if, b.out_if, b.bytes, b.proto, b.src_port, b.etype, b.ip_tos, b.sampling_rate) == (70, 80, 100, 17, 53, 0x800, 4, 64)
    assert a.sequence_num == 426 and a.time_flow_start_ns == a.time_received_ns and sflow.flows(d).filter("error IS NOT NULL").count() == 1
    assert {r.format for r in sflow.samples(d).filter("error IS NULL").collect()} == {1, 2, 3, 5}


def test_sflow_drops():
    p = sflow.decode(sflow_datagram(drop_sample(sample(1036, struct.pack(">I", 42)), sample(1037, struct.pack(">II", 42, 4) + b"foo!" + struct.pack(">I", 2)), sample(1038, struct.pack(">I", 6) + b"foobar"))))
    assert p["samples"][0]["records"] == [(1036, {"queue": 42}), (1037, {"number": 42, "name": "foo!", "direction": 2}), (1038, {"symbol": "foobar"})]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(0, 399), st.integers(0, 255))
def test_damaged_datagrams_raise_value_errors_only(cut, at, value):
    flow = sample(1, struct.pack(">IIIIIIII", 1, 2, 2048, 0, 0, 7, 8, 1) + sample(1, struct.pack(">IIII", 1, 60, 0, 54) + eth(0x800) + ipv4(6) + bytes(20)))
    for good, decode in ((sflow_datagram(flow), lambda p: sflow.datagram_flows(p, 0, MAPPING)), (message(9, [(0, template(260, (1, 2), (8, 4)))]), netflow.sets_of), (message(10, [(3, struct.pack(">HHH", 257, 2, 1) + bytes(8))]), netflow.sets_of)):
        data = bytearray(good[: cut or None])
        if at < len(data):
            data[at] = value
        try:
            decode(bytes(data))
        except ValueError:
            pass


def test_rendered_frames(spark):
    df = spark.createDataFrame([(1, eth(0x800) + ipv4(6)), (2, b""), (3, None)], "id long, frame binary")
    out = packet.parse_frames(df, keep=["id"]).orderBy("id")
    assert [r.ip for r in out.select(render.ip(F.col("src_addr")).alias("ip")).collect()] == ["10.0.0.1", "", ""]
