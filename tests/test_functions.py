"""Scalar functions: golden values and agreement with plain Python."""

import ipaddress
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.functions import names, protobuf, render, serialize, values
from flowspark.functions.bits import slice_bits
from flowspark.schema import FLOW_COLUMNS, empty_flow

SLICES = [
    (16, 16, True, "ab56"), (24, 8, True, "56"), (24, 32, True, "56000000"), (32, 0, True, None), (32, 16, True, "0000"), (4, 16, True, "a55a"), (4, 16, False, "a55a"), (4, 4, True, "0a"),
    (4, 4, False, "a0"), (4, 6, True, "29"), (4, 6, False, "a4"), (20, 6, True, "2d"), (20, 6, False, "b4"), (5, 10, True, "4a02"), (30, 10, True, "8000"), (30, 10, False, "8000"), (30, 2, True, "02"),
    (30, 2, False, "80"), (32, 1, True, "00"), (40, 1, True, None),
]


@pytest.mark.parametrize(("offset", "length", "shift", "want"), SLICES)
def test_slices(offset, length, shift, want):
    got = slice_bits(bytes.fromhex("aa55ab56"), offset, length, shift)
    assert got == (None if want is None else bytes.fromhex(want))


def one(spark, column, data=b"", kind="binary"):
    return spark.createDataFrame([(data,)], f"x {kind}").select(column.alias("y")).first().y


def test_ntp(spark):
    n = 0xEBE50E38C50CC000
    assert one(spark, values.ntp_to_ns(F.col("x")), n - 2**64, "long") == 1748668344769725799


def test_numbers(spark):
    rows = [b"", b"\x01", b"\x80", b"\xff\xfe", b"\x01\x02\x03", b"\xff" * 4, b"\x80" + b"\0" * 7, b"\x01" * 9]
    df = spark.createDataFrame([(b,) for b in rows], "x binary")
    got = df.select(*[f(F.col("x")).alias(n) for n, f in (("ub", values.uint_be), ("ul", values.uint_le), ("ib", values.int_be), ("il", values.int_le))], values.uint_be(F.col("x"), 8).alias("u8"), values.all_zeros(F.col("x")).alias("z")).collect()
    wrap = lambda n: n - 2**64 if n >= 2**63 else n
    for b, r in zip(rows, got, strict=True):
        if len(b) > 8:
            assert r.ub is None and r.ul is None
            continue
        assert r.ub == wrap(int.from_bytes(b, "big")) and r.ul == wrap(int.from_bytes(b, "little")) and r.u8 == int.from_bytes(b, "big") % 256
        assert r.ib == (int.from_bytes(b, "big", signed=len(b) in (1, 2, 4, 8))) and r.il == int.from_bytes(b, "little", signed=len(b) in (1, 2, 4, 8))
        assert r.z == (not any(b))


def test_addresses(spark):
    texts = ["0.0.0.0", "10.1.2.255", "::", "::1", "2001:db8::1", "1:0:0:2::3", "fe80::1:0:0:1", "1:2:3:4:5:6:7:0", "0:1::", "::ffff:10.0.0.1", "1:0:2:0:3:0:4:0", "::2:0:0:0:0", "a:b:c:d:e:f:1:2"]
    data = [ipaddress.ip_address(t).packed for t in texts] + [b"", b"abc"]
    df = spark.createDataFrame([(b,) for b in data], "x binary")
    got = [r.y for r in df.select(render.ip(F.col("x")).alias("y")).collect()]
    want = [str(ipaddress.ip_address(b)) if len(b) in (4, 16) else "" for b in data]
    assert got == [w if "ffff:" not in w else "::ffff:10.0.0.1" for w in want]
    nets = spark.createDataFrame([(ipaddress.ip_address("10.1.2.255").packed, n) for n in (0, 9, 24, 32, 33)] + [(ipaddress.ip_address("2001:db8:ffff::1").packed, 35)], "x binary, n long")
    assert [r.y for r in nets.select(render.network(F.col("x"), F.col("n")).alias("y")).collect()] == ["0.0.0.0/0", "10.0.0.0/9", "10.1.2.0/24", "10.1.2.255/32", "invalid Prefix", "2001:db8:e000::/35"]


def test_names(spark):
    assert sorted(names.PROTOCOL_NAMES) == list(range(146)) and names.PROTOCOL_NAMES[124] == "ISIS over IPv4" and names.PROTOCOL_NAMES[132] == "SCTP" and names.PROTOCOL_NAMES[145] == "NSH"
    df = spark.createDataFrame([(n,) for n in (6, 145, 146, 253, 255, 256)], "x long")
    assert [r.y for r in df.select(render.protocol(F.col("x")).alias("y")).collect()] == ["TCP", "NSH", "unassigned", "experimental", "reserved", "unknown"]
    assert one(spark, render.mac(F.col("x")), 0x0A0B0C0D0E0F, "long") == "0a:0b:0c:0d:0e:0f"
    assert one(spark, render.datetime_nano(F.col("x")), 1540209168921810119, "long") == "2018-10-22T11:52:48.921810119Z"
    assert one(spark, render.datetime_nano(F.col("x")), 1540209168000000000, "long") == "2018-10-22T11:52:48Z"
    assert one(spark, render.datetime(F.col("x")), 0, "long") == "1970-01-01T00:00:00Z"


def fnv(text: bytes) -> int:
    h = 2166136261
    for b in text:
        h = h * 16777619 % 2**32 ^ b
    return h


def test_keys(spark):
    df = spark.createDataFrame([(b"\x0a\0\0\x01", 443, [1, 2])], "a binary, p long, l array<long>")
    key = df.select(values.partition_key([("a", "binary"), ("p", "bigint"), ("l", "array<bigint>")]).alias("k")).first().k
    assert bytes(key) == struct.pack(">I", fnv(b"[10 0 0 1]443[1 2]"))
    assert df.select(values.partition_key([]).alias("k")).first().k is None
    k = values.template_key(F.lit(10), F.lit(7), F.lit(260))
    assert one(spark, values.template_key_text(k)) == "10/7/260"
    assert tuple(one(spark, values.parse_template_key(F.lit("9/1/256")))) == (9, 1, 256)


def test_json_and_text(spark):
    fmt = serialize.Format(fields=("type", "src_addr", "as_path", "proto", "icmp_name"), rename={"src_addr": "source"}, render={"proto": "none"})
    df = spark.createDataFrame([(2, b"\x0a\0\0\x01", [1, 2], 1, 8)], "type int, src_addr binary, as_path array<long>, proto long, icmp_type long")
    assert df.select(serialize.to_json(df, fmt).alias("y")).first().y == '{"type":"NETFLOW_V5","source":"10.0.0.1","as_path":[1,2],"proto":1,"icmp_name":"Echo"}'
    assert df.select(serialize.to_text(df, fmt).alias("y")).first().y == "type=NETFLOW_V5 source=10.0.0.1 as_path=[1,2] proto=1 icmp_name=Echo"
    with pytest.raises(ValueError):
        serialize.Format(render={"proto": "network"})
    with pytest.raises(ValueError):
        serialize.to_json(df, serialize.Format(fields=("nothing",)))


EXTENSIONS = (serialize.Extension("note", 2000, "string"), serialize.Extension("many", 2001, "varint", True))
VALUES = st.fixed_dictionaries({
    "type": st.integers(0, 4), "bytes": st.integers(-(2**63), 2**63 - 1), "src_addr": st.binary(max_size=16), "as_path": st.lists(st.integers(0, 2**63 - 1), max_size=5), "layer_stack": st.lists(st.integers(0, 99), max_size=3),
    "mpls_ip": st.lists(st.binary(max_size=16), max_size=3), "note": st.binary(max_size=9), "many": st.lists(st.integers(0, 2**40), max_size=4),
})


def encoded(flows, extensions=EXTENSIONS, delimited=False):
    fields = serialize.message_fields(extensions)
    columns = {f.name: pa.array([flow[f.name] for flow in flows], f.type) for f in fields}
    return protobuf.encode(columns, fields, len(flows), delimited)


def decoded(messages, extensions=EXTENSIONS, unknown=False):
    data = np.frombuffer(b"".join(messages), np.uint8)
    end = np.cumsum([len(m) for m in messages])
    found = protobuf.decode(data, end - [len(m) for m in messages], end, serialize.message_fields(extensions), unknown)
    return [dict(zip(found, row, strict=True)) for row in zip(*[c.to_pylist() for c in found.values()], strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=50))
def test_protobuf_round_trip(some):
    flows = [empty_flow() | {"note": b"", "many": []} | x for x in some]
    messages = encoded(flows).to_pylist()
    assert decoded(messages) == flows
    whole = b"".join(encoded(flows, delimited=True).to_pylist())
    for pieces in ([whole], encoded(flows, delimited=True).to_pylist()):
        data, end = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(x) for x in pieces])
        begin, stop = protobuf.split(data, end - [len(x) for x in pieces], end)
        assert [data[a:z].tobytes() for a, z in zip(begin, stop, strict=True)] == messages
    with pytest.raises(ValueError):
        protobuf.split(data[:-1] if len(messages[-1]) else np.array([1], np.uint8), np.array([0]), np.array([max(1, len(data) - 1)]))


def library():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    f = descriptor_pb2.FileDescriptorProto(name="f.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="M")
    for n, tag, kind, label in (("type", 1, 5, 1), ("bytes", 9, 3, 1), ("src_addr", 6, 12, 1), ("as_path", 102, 3, 3), ("layer_stack", 103, 5, 3), ("mpls_ip", 82, 12, 3), ("note", 2000, 12, 1), ("wide", 3000, 6, 1)):
        m.field.add(name=n, number=tag, type=kind, label=label)
    m.field.add(name="many", number=2001, type=3, label=3).options.packed = False
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("t.M"))


@settings(max_examples=60, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=20))
def test_protobuf_agrees_with_the_library(some):
    message = library()
    theirs = [message(**x) for x in some]
    flows = [empty_flow() | {"note": b"", "many": []} | x for x in some]
    assert decoded([m.SerializeToString() for m in theirs]) == flows
    assert [message.FromString(m) for m in encoded(flows).to_pylist()] == theirs


def test_unknown_fields_and_faults():
    message = library()
    theirs = message(bytes=5, wide=7, note=b"x", many=[3, 4])
    (got,) = decoded([theirs.SerializeToString()], (), True)
    assert got["bytes"] == 5 and got["unknown"] == [{"tag": 2000, "number": None, "bytes": b"x"}, {"tag": 2001, "number": 3, "bytes": None}, {"tag": 2001, "number": 4, "bytes": None}, {"tag": 3000, "number": 7, "bytes": None}]
    assert "unknown" not in decoded([theirs.SerializeToString()], ())[0]
    twice = message(bytes=1).SerializeToString() + message(bytes=9).SerializeToString()
    assert decoded([twice, b""])[0]["bytes"] == 9 and decoded([b""])[0]["as_path"] == []
    for bad in (b"\x4a\x05ab", b"\x48", b"\x48" + b"\xff" * 11, b"\x4b", b"\x32\xff\xff\xff\xff\x0f", b"\x30\x05"):
        with pytest.raises(ValueError):
            decoded([bad])


def test_delimited_files(spark, tmp_path):
    from flowspark.sources import files

    flows = [empty_flow() | {"note": b"", "many": [], "bytes": i, "src_addr": bytes([10, 0, 0, i % 256])} for i in range(1, 500)]
    (tmp_path / "a.bin").write_bytes(b"".join(encoded(flows, delimited=True).to_pylist()))
    out = files.delimited(spark, str(tmp_path)).orderBy("bytes")
    assert out.columns == FLOW_COLUMNS and [r.bytes for r in out.collect()] == list(range(1, 500))
    assert files.kafka_options({"brokers": "a:1", "user": "u", "password": 'p"'}) == {
        "kafka.bootstrap.servers": "a:1", "kafka.sasl.mechanism": "SCRAM-SHA-512", "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.jaas.config": 'org.apache.kafka.common.security.scram.ScramLoginModule required username="u" password="p\\"";',
    }
    with pytest.raises(Exception, match="[Kk]afka"):
        files.kafka_flows(spark, "topic", brokers="a:1")
    with pytest.raises(ValueError):
        files.kafka(spark, "topic", nothing="1")


def test_ipv6_text(spark):
    rng = np.random.default_rng(5)
    addresses = [bytes(16), bytes(15) + b"\1", b"\1" + bytes(15), bytes(10) + b"\xff\xff\1\2\3\4", bytes(range(16))]
    for _ in range(300):
        groups = rng.integers(0, 2**16, 8) * rng.integers(0, 2, 8)
        addresses.append(groups.astype(">u2").tobytes())
    df = spark.createDataFrame([(a,) for a in addresses], "a binary")
    for r in df.select("a", render.ip(F.col("a")).alias("text")).collect():
        want = ipaddress.ip_address(bytes(r.a))
        assert r.text == (f"::ffff:{want.ipv4_mapped}" if want.ipv4_mapped else str(want))
