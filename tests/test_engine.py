"""Raw mode, the assembled job, its status pages, enrichment and metrics."""

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from test_streaming import feed
from test_wire import datagrams, ip, message, sflow_datagram, template, v5_datagram

from flowspark.functions import render
from flowspark.operators import enrich, metrics, raw
from flowspark.operators.mapping import compile_mapping
from flowspark.plans import engine
from flowspark.sources import files


def test_raw_messages(spark):
    d = datagrams(spark, [v5_datagram(), message(9, [(0, template(260, (1, 2)))]), message(10, []), sflow_datagram(), b"xx"])
    rows = {r.type: r for r in raw.messages(d).collect()}
    assert set(rows) == {"netflowv5", "netflowv9", "ipfix", "sflow", "unknown"}
    v5 = json.loads(rows["netflowv5"].message)
    assert v5["count"] == 2 and v5["records"][0]["src_addr"] == "10.128.2.121" and rows["netflowv5"].src == "192.0.2.1:2055"
    assert json.loads(rows["netflowv9"].message)["sets"][0]["fields"][0]["name"] == "IN_BYTES"
    assert rows["sflow"].summary.endswith("192.0.2.1:2055: sflow agent:172.16.0.17 seq:426 count:0") and rows["unknown"].error
    assert sum(1 for _ in raw.pretty(d)) == 4


def test_job_and_status(spark, tmp_path):
    feed(datagrams(spark, [message(9, [(0, template(260, (1, 2))), (260, b"\0\5")]), v5_datagram()]), f"{tmp_path}/in", [F.lit(True)])
    mapping = compile_mapping({"formatter": {"fields": ["type", "bytes"]}})
    job = engine.Job(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", mapping=mapping, trigger=None).start()
    server = engine.serve(job, 0)
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{p}").read().decode()
    job.wait()
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(x["bytes"] for x in lines) == [5, 148, 590] and {x["type"] for x in lines} == {"NETFLOW_V5", "NETFLOW_V9"}
    assert json.loads(get("/templates"))["192.0.2.1"]["9/1/260"]["fields"][0]["type"] == 1
    assert "flowspark_input_rows" in get("/metrics") and 'flowspark_decode_seconds{query="flows",quantile="0.5"}' in get("/metrics")
    with pytest.raises(urllib.error.HTTPError):
        get("/__health")
    server.shutdown()
    raw_job = engine.Job(spark, f"{tmp_path}/in", f"{tmp_path}/raw", f"{tmp_path}/check2", "raw", "text", trigger=None).start()
    raw_job.wait()
    assert spark.read.text(f"{tmp_path}/raw").count() == 2
    with pytest.raises(ValueError):
        engine.produce(None, "nothing")
    with pytest.raises(ValueError):
        engine.register_producer("raw", None)
    assert engine.options().parse_args(["--datagrams", "a", "--out", "b", "--checkpoint", "c"]).format == "json"


def test_a_job_passes_templates_on_and_reports_faults(spark, tmp_path, caplog):
    feed(datagrams(spark, [message(9, [(0, template(260, (1, 2)))]), b"xx", b"yy", sflow_datagram()[:9]]), f"{tmp_path}/in", [F.lit(True)])
    first = engine.Job(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", trigger=None, export=f"{tmp_path}/t.json", export_s=0.5, most_errors=1).start()
    first.wait()
    with caplog.at_level("WARNING", "flowspark"):
        first.report_errors().wait()
    said = [r.getMessage() for r in caplog.records if r.name == "flowspark"]
    assert sum(x == "192.0.2.1: no protocol begins so" for x in said) == 1 and any("no protocol begins so: 1 more" in x for x in said) and any("Short" in x for x in said)
    known = files.preload_templates(f"{tmp_path}/t.json")
    assert set(known) == {"192.0.2.1"}
    feed(datagrams(spark, [message(9, [(260, b"\0\5")]), v5_datagram()]), f"{tmp_path}/in2", [F.lit(True)])
    no_v5 = lambda d: d.filter(F.hex(F.substring("payload", 1, 2)) != "0005")
    engine.Job(spark, f"{tmp_path}/in2", f"{tmp_path}/out2", f"{tmp_path}/check2", trigger=None, wrappers=[no_v5], preload=known).start().wait()
    assert [json.loads(r.value)["bytes"] for r in spark.read.text(f"{tmp_path}/out2").collect()] == [5]


def test_longest_prefix(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("10.1.2.0/23", 3), ("2001:db8::/33", 4), ("2001:db8::/32", 5), ("0.0.0.0/0", 9), ("junk", 7), (None, 8)], "cidr string, asn long")
    places = spark.createDataFrame([("10.1.3.0/24", "CH")], "cidr string, country string")
    rows = ["10.1.3.4", "10.1.9.9", "10.9.9.9", "11.0.0.1", "2001:db8:8000::1", "2001:db8::1", "2002::1"]
    f = spark.createDataFrame([(ip(a), ip(a), 77, 77, 1) for a in rows], "src_addr binary, dst_addr binary, src_as long, dst_as long, sampling_rate long")
    out = enrich.enrich(f, nets, places, 512).select(render.ip(F.col("src_addr")).alias("a"), "src_as", "src_country", "sampling_rate").collect()
    assert {r.a: (r.src_as, r.src_country) for r in out} == {"10.1.3.4": (3, "CH"), "10.1.9.9": (2, ""), "10.9.9.9": (1, ""), "11.0.0.1": (9, ""), "2001:db8:8000::1": (5, ""), "2001:db8::1": (4, ""), "2002::1": (0, "")}
    assert all(r.sampling_rate == 512 for r in out)
    assert enrich.enrich(f, nets.filter("false")).filter("src_as <> 0").count() == 0 and enrich.enrich(f).first().src_as == 77


def test_delay_templates_and_gaps(spark):
    from flowspark.operators import netflow

    f = spark.createDataFrame([(b"\1\1\1\1", 5 * 10**9, 2 * 10**9), (b"\1\1\1\1", 5 * 10**9, 6 * 10**9)], "sampler_address binary, time_received_ns long, time_flow_end_ns long")
    r = metrics.flow_delay(f).first()
    assert (r["count"], r["sum"], r["early"]) == (2, 2.0, 1)
    d = datagrams(spark, [message(9, [(0, template(260, (1, 2)))])] * 2)
    assert metrics.template_times(netflow.sets(d)).first().adds == 2
    gaps = metrics.sequence_gaps(d.withColumn("n", F.col("seq") * 5), ["src_addr"], "n").orderBy("n").collect()
    assert [g.gap for g in gaps] == [None, 4]
    shown, counts = metrics.muted(d, ["src_addr"], most=0)
    assert shown.count() == 2 and counts.first().skipped == 0
    many = spark.range(1000).select(F.lit("x").alias("k"), (F.col("id") * 10**7).alias("received_ns")).unionByName(spark.createDataFrame([("x", 0)] * 30, "k string, received_ns long"))
    shown, counts = metrics.muted(many, ["k"], most=4)
    assert [r.received_ns for r in shown.orderBy("received_ns").collect()] == [0] * 4 and counts.first().skipped == 1026


def test_written_tables_are_cleared(spark):
    from flowspark import scratch

    t = scratch.written(spark.range(5).toDF("x"), "numbers")
    assert t.count() == 5
    broadcast = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert broadcast(scratch.small(t)) and not broadcast(scratch.small(t, rows=4)) and not broadcast(scratch.small(t, megabytes=0))
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(t.inputFiles()[0])
