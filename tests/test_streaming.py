"""Streams: the same flows as batch, state, sources, sinks."""

import json
import os
import socket
import struct
import time

import pytest
from pyspark.sql import functions as F
from test_wire import datagrams, message, sflow_datagram, template, v5_datagram

from flowspark.functions import serialize
from flowspark.operators import metrics, netflow, raw
from flowspark.plans.flows import as_v9, flows
from flowspark.schema import DATAGRAM_SCHEMA, FLOW_COLUMNS
from flowspark.sources import files, listen, udp
from flowspark.streaming import pipelines, stateful


def feed(df, folder, names):
    """Datagram files in a stated order of arrival."""
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(names):
        df.filter(part).coalesce(1).write.mode("overwrite").parquet(f"{folder}-tmp{k}")
        f = next(x for x in os.listdir(f"{folder}-tmp{k}") if x.endswith(".parquet"))
        os.rename(f"{folder}-tmp{k}/{f}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1000 + k, 1000 + k))


def run(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(120), "the stream did not end"
    return df.sparkSession.table(name)


def rows_of(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*[c for c in FLOW_COLUMNS if c not in ("mpls_label",)]).collect())


def test_a_stream_gives_what_a_batch_gives(spark, sf, tmp_path):
    d = as_v9(flows(spark, sf)).cache()
    d = d.unionByName(datagrams(spark, [v5_datagram(), b"\0\7", sflow_datagram()]))
    middle = (1_700_000_000 + 50) * 10**9
    feed(d, f"{tmp_path}/in", [F.col("received_ns") < middle, F.col("received_ns") >= middle])
    stream = udp.logged(spark, f"{tmp_path}/in", 1)
    got = run(stateful.flows(stream), "stream_flows", f"{tmp_path}/check")
    want = stateful.batch_flows(d)
    assert rows_of(got.filter("error IS NULL")) == rows_of(want.filter("error IS NULL")) and got.filter("error IS NULL").count() > 500
    assert got.filter("error = 'template not found'").count() == netflow.errors(d).count()
    table = stateful.template_table(spark, f"{tmp_path}/check")
    n = files.export_templates(table, f"{tmp_path}/templates.json")
    assert n == table.count() > 8 and set(json.load(open(f"{tmp_path}/templates.json"))) == {f"10.255.0.{i}" for i in range(8)}
    again = files.preload_templates(f"{tmp_path}/templates.json")
    assert {s: {k: json.loads(t) for k, t in x.items()} for s, x in again.items()} == {raw.readable(bytes(r.source)): {q.key: json.loads(q.template) for q in table.collect() if q.source == r.source} for r in table.collect()}


def test_preloaded_templates_serve(spark, tmp_path):
    known = {"192.0.2.1": {"9/1/260": {"template-id": 260, "fields": [{"type": 1, "length": 2}]}}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(known))
    loaded = files.preload_templates(str(path))
    data, gone = message(9, [(260, b"\0\x08")]), message(9, [(0, struct.pack(">HH", 260, 0))])
    both = datagrams(spark, [data, gone, data]).unionByName(datagrams(spark, [data], src="192.0.2.2"))
    feed(both, f"{tmp_path}/in", [F.lit(True)])
    got = run(stateful.netflow_stream(udp.logged(spark, f"{tmp_path}/in"), preload=loaded), "preloaded", f"{tmp_path}/check")
    assert sorted((r.error, r.bytes) for r in got.filter("error IS NULL").collect()) == [(None, 8)]  # the other exporter has none, and a withdrawn one stays away
    assert got.filter("error = 'template not found'").count() == 2
    path.write_text(json.dumps({"a": {"9/1/260": {"fields": []}}}))
    with pytest.raises(ValueError):
        files.preload_templates(str(path))


def test_templates_expire(spark, tmp_path):
    feed(datagrams(spark, [message(9, [(0, template(260, (1, 2))), (260, b"\0\5")]), message(9, [(260, b"\0\6")])]), f"{tmp_path}/in", [F.col("seq") == 0, F.col("seq") == 1])
    stream = stateful.netflow_stream(udp.logged(spark, f"{tmp_path}/in", 1), ttl_s=3600)
    got = run(stream, "kept", f"{tmp_path}/check")
    assert sorted(r.bytes for r in got.filter("error IS NULL").collect()) == [5, 6]


def resumed(df, folder):
    """What one more run of a query adds to its output."""
    have = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").count() if os.path.exists(f"{folder}/out") else 0
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120), "the stream did not end"
    errors = [r.error for r in df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").orderBy("time_received_ns").collect()]
    return errors[have:]


def put(spark, folder, k, payloads):
    datagrams(spark, payloads).withColumn("received_ns", F.col("received_ns") + k * 10**9).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("extend", [False, True])
def test_a_template_is_forgotten_unless_use_renews_it(spark, tmp_path, extend):
    """A template is announced once, used within its time and again after it; by then only use has kept it."""
    folder, ttl = f"{tmp_path}/in", 12
    data = message(9, [(260, b"\0\5")])
    for k, payloads in enumerate(([message(9, [(0, template(260, (1, 2)))]), data], [data], [data])):
        if k:
            time.sleep(max(0, started + k * 0.6 * ttl - time.time()))
        put(spark, folder, k, payloads)
        got = resumed(stateful.netflow_stream(udp.logged(spark, folder), ttl_s=ttl, extend_on_access=extend), str(tmp_path))
        if not k:
            started = time.time()
        assert got == (["template not found"] if k == 2 and not extend else [None]), k


def test_a_removed_source_starts_anew(spark, tmp_path):
    data = message(9, [(260, b"\0\5")])
    put(spark, f"{tmp_path}/in", 0, [message(9, [(0, template(260, (1, 2)))]), data])
    assert resumed(stateful.netflow_stream(udp.logged(spark, f"{tmp_path}/in")), str(tmp_path)) == [None]
    put(spark, f"{tmp_path}/in", 1, [data])
    assert resumed(stateful.netflow_stream(udp.logged(spark, f"{tmp_path}/in")), str(tmp_path)) == [None]
    put(spark, f"{tmp_path}/in", 2, [data, message(9, [(0, template(260, (1, 2)))]), data])
    after = resumed(stateful.netflow_stream(udp.logged(spark, f"{tmp_path}/in"), remove=["192.0.2.1"]), str(tmp_path))
    assert sorted(after, key=str) == [None, "template not found"]


def test_rollup_with_watermark_and_sinks(spark, sf, tmp_path):
    f = flows(spark, sf).select("sequence_num", "sampler_address", "time_received_ns", "src_as", "dst_as", "etype", "bytes", "packets", "proto")
    middle = f.agg(F.expr("percentile(time_received_ns, 0.5)")).first()[0]
    feed(f, f"{tmp_path}/flows", [F.col("time_received_ns") < middle, F.col("time_received_ns") >= middle])
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flows")
    got = run(pipelines.rollup_stream(stream), "rolled", f"{tmp_path}/c1")
    from flowspark.operators import analytics

    want = analytics.rollup(f)
    same = got.join(want, ["timeslot", "src_as", "dst_as", "etype", "bytes", "packets", "count"])
    assert 0 < got.count() == same.count() <= want.count()
    twice = spark.readStream.schema(f.schema).parquet(f"{tmp_path}/flows").unionByName(stream)
    assert run(pipelines.deduplicated(twice), "once", f"{tmp_path}/c2").count() == f.dropDuplicates(["sampler_address", "sequence_num"]).count()
    fmt = serialize.Format(fields=("sequence_num", "proto"), key=("sampler_address",))
    out = pipelines.formatted(stream, "json", fmt)
    pipelines.to_files(out, f"{tmp_path}/out", f"{tmp_path}/c3").trigger(availableNow=True).start().awaitTermination(60)
    lines = spark.read.text(f"{tmp_path}/out")
    assert lines.count() == f.count() and json.loads(lines.first().value)["proto"] in ("TCP", "UDP", "ICMP", "GRE", "IPv6-ICMP")
    for kind in ("text", "bin"):
        assert pipelines.formatted(f, kind, fmt).count() == f.count()
    with pytest.raises(ValueError):
        pipelines.formatted(f, "xml")
    with pytest.raises(ValueError):
        pipelines.to_kafka(stream, "t", "c", nothing="1")
    pipelines.register_format("ports", lambda flows, fmt, extensions: flows.select(F.lit(None).alias("key"), F.col("proto").cast("string").alias("value")))
    assert pipelines.formatted(f, "ports").count() == f.count()
    for again in (lambda: pipelines.register_format("json", None), lambda: pipelines.register_transport("file", None), lambda: pipelines.sent(stream, "nothing", "a", "b")):
        with pytest.raises(ValueError):
            again()


def test_values_on_standard_output(spark, tmp_path, capfdbinary):
    spark.createDataFrame([(b"ab",), (b"c",)], "value binary").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("value binary").parquet(f"{tmp_path}/in")
    for k, (separator, want) in enumerate((("\n", b"ab\nc\n"), ("", b"abc"))):
        pipelines.sent(rows, "stdout", "", f"{tmp_path}/c{k}", separator=separator).trigger(availableNow=True).start().awaitTermination(60)
        assert want in capfdbinary.readouterr().out


def test_listen_addresses():
    a, b = listen.parse_listeners("sflow://:6343?count=2&queue_size=9,netflow://[::1]:2055?blocking=true&workers=3")
    assert a == listen.Listener("sflow", "", 6343, 2, 4, False, 9) and b == listen.Listener("netflow", "::1", 2055, 1, 3, True, 0)
    for bad in ("http://:1", "sflow://x", "sflow://:1?count=-1"):
        with pytest.raises(ValueError):
            listen.parse_listeners(bad)


def test_receiver_logs_drops_and_drains(spark, tmp_path):
    r = udp.Receiver(listen.Listener("flow", "127.0.0.1", 0, queue=5))
    port = r.start()
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for i in range(20):
        s.sendto(bytes([i]), ("127.0.0.1", port))
    deadline = time.time() + 5
    while r.received + r.dropped < 20 and time.time() < deadline:
        time.sleep(0.05)
    assert r.received == 5 and r.dropped == 15
    lost = metrics.dropped(r.drops(spark)).collect()
    assert [(x.remote_ip, x.local_ip, x.local_port, x.packets, x.bytes) for x in lost] == [("127.0.0.1", "127.0.0.1", port, 15, 15)]
    assert udp.receive(r, f"file://{tmp_path}/log", 0.0) == 5
    s.sendto(b"x", ("127.0.0.1", port))
    time.sleep(0.3)
    assert [row[4] for row in r.stop()] == [b"x"]
    logged = spark.read.schema(DATAGRAM_SCHEMA).parquet(f"{tmp_path}/log")
    assert sorted(bytes(x.payload) for x in logged.collect()) == [bytes([i]) for i in range(5)] and not list(tmp_path.glob("log/*.tmp"))


def test_udp_source(spark, tmp_path):
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    udp.register(spark)
    q = spark.readStream.format("udp").option("port", port).load().writeStream.format("memory").queryName("socket").option("checkpointLocation", f"{tmp_path}/c").start()
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    deadline = time.time() + 60
    while time.time() < deadline and not spark.table("socket").count():
        s.sendto(v5_datagram(), ("127.0.0.1", port))
        time.sleep(0.5)
    q.stop()
    assert spark.table("socket").count() > 0


def test_flow_json_ingest(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"bytes": 7, "src_addr": "10.0.0.1", "type": "IPFIX"}\nnot json\n')
    got = run(files.json_stream(spark, str(tmp_path)), "lines", f"{tmp_path}-check").orderBy("value").collect()
    assert [r.flow and (r.flow.bytes, r.flow.src_addr) for r in got] == [None, (7, "10.0.0.1")] or [r.flow.bytes for r in got] == [None, 7]
