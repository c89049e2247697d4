"""The registered flow queries and their DuckDB equivalents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, render, serialize, values
from ..operators import analytics, enrich, metrics, netflow, packet, sflow, v5
from ..operators.mapping import compile_mapping
from ..schema import FLOW_COLUMNS, FLOW_SCHEMA
from ..scratch import root, written
from ..sources import files, listen
from ..streaming import pipelines, stateful
from . import engine
from .flows import (
    EXPORTERS, FIRST_RATE, FIRST_TEMPLATE, FLOWS_SQL, INTERFACE_WIDTHS, LAYOUT_A, SECOND_RATE, SECOND_TEMPLATE, START_S, UPTIME, as_ipfix, as_ipfix_options, as_sflow, as_sflow_all, as_v5, as_v9, flows, frame, ip_sql,
    stacked_frame,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH flows AS ({FLOWS_SQL}) "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A table of protocol names of our own, smaller than the registry, so that misses occur.
DICTIONARY = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "IPv6-ICMP"}


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DICTIONARY.items()), "proto long, name string")


PROTO_CASE = "CASE proto " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in DICTIONARY.items()) + " ELSE CAST(proto AS VARCHAR) END"


@query(WITH + f"SELECT {ip_sql('src')} AS ip, sum(bytes * sampling_rate)::BIGINT AS sumbytes FROM flows GROUP BY 1")
def top_src_ips(spark, sf_dir):
    return analytics.top_ips(flows(spark, sf_dir), "src_addr")


@query(WITH + f"SELECT {ip_sql('dst')} AS ip, sum(bytes * sampling_rate)::BIGINT AS sumbytes FROM flows GROUP BY 1")
def top_dst_ips(spark, sf_dir):
    return analytics.top_ips(flows(spark, sf_dir), "dst_addr")


@query(WITH + f"SELECT {PROTO_CASE} || '/' || src_port AS port, sum(bytes * sampling_rate)::BIGINT AS sumbytes FROM flows GROUP BY 1")
def top_src_ports(spark, sf_dir):
    return analytics.top_ports(flows(spark, sf_dir), "src_port", dictionary(spark))


@query(WITH + f"SELECT {PROTO_CASE} || '/' || dst_port AS port, sum(bytes * sampling_rate)::BIGINT AS sumbytes FROM flows GROUP BY 1")
def top_dst_ports(spark, sf_dir):
    return analytics.top_ports(flows(spark, sf_dir), "dst_port", dictionary(spark))


@query(
    WITH + """, r AS (SELECT time_received_ns // 1000000000 // 3600 * 3600 AS s, bytes * sampling_rate AS b FROM flows),
    e AS (SELECT min(s) - 7200 AS a, max(s) + 7200 AS z FROM r)
    SELECT t * 1000 AS t, sum(b)::BIGINT AS sumbytes FROM (SELECT s AS t, b FROM r UNION ALL SELECT unnest(generate_series(a, z - 3600, 3600)), 0 FROM e) GROUP BY 1"""
)
def traffic_timeseries_zero_filled(spark, sf_dir):
    f = flows(spark, sf_dir)
    hour = values.floor_div(F.col("time_received_ns"), 3600 * 10**9) * 3600
    low, high = f.agg(F.min(hour), F.max(hour)).first()
    return analytics.timeseries(f, low - 7200, high + 7200, 3600)


SLOT = "make_timestamp(time_received_ns // 300000000000 * 300000000)"


@query(WITH + f"SELECT CAST({SLOT} AS DATE) AS date, {SLOT} AS timeslot, src_as, dst_as, etype, sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets, count(*) AS \"count\" FROM flows GROUP BY ALL")
def rollup_5m(spark, sf_dir):
    return analytics.rollup(flows(spark, sf_dir)).withColumn("timeslot", F.col("timeslot").cast("timestamp_ntz"))


@query(
    WITH + f""", r AS (SELECT {SLOT} AS timeslot, src_as % 50 AS src_as, dst_as % 50 AS dst_as, etype, sum(bytes)::BIGINT AS b, sum(packets)::BIGINT AS p, count(*) AS n FROM flows GROUP BY ALL)
    SELECT CAST(timeslot AS DATE) AS date, timeslot, src_as, dst_as, string_agg(etype || ':' || b || ':' || p || ':' || n, ',' ORDER BY etype) AS etype_map,
    sum(b)::BIGINT AS bytes, sum(p)::BIGINT AS packets, sum(n)::BIGINT AS "count" FROM r GROUP BY ALL"""
)
def rollup_5m_etype_map(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("src_as", F.col("src_as") % 50).withColumn("dst_as", F.col("dst_as") % 50)
    r = analytics.rollup_by_etype(analytics.rollup(f))
    text = F.array_join(F.transform("etype_map", lambda e: F.concat_ws(":", e["etype"], e["bytes"], e["packets"], e["count"])), ",")
    return r.withColumn("etype_map", text).withColumn("timeslot", F.col("timeslot").cast("timestamp_ntz"))


@query(
    WITH + """SELECT CAST(make_timestamp(time_received_ns // 1000) AS DATE) AS date, time_received_ns, time_flow_start_ns, sequence_num, sampling_rate,
    src_as, dst_as, etype, proto, src_port, dst_port, bytes, packets, make_timestamp(time_received_ns // 1000 + 5000000) AS time_inserted, """ + f"""{ip_sql('src')} AS src_addr, {ip_sql('dst')} AS dst_addr,
    concat_ws('.', sampler >> 24, (sampler >> 16) & 255, (sampler >> 8) & 255, sampler & 255) AS sampler_address FROM flows"""
)
def raw_table_projection(spark, sf_dir):
    inserted = values.timestamp_of_ns(F.col("time_received_ns") + 5 * 10**9)
    t = analytics.raw_table(flows(spark, sf_dir), inserted)
    return t.withColumn("time_inserted", F.col("time_inserted").cast("timestamp_ntz")).withColumns({c: render.ip(F.col(c)) for c in ("src_addr", "dst_addr", "sampler_address")})


@query(WITH + f"SELECT event_id, {ip_sql('src')} AS src_ip, {ip_sql('dst')} AS dst_ip FROM flows")
def render_ip(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", render.ip(F.col("src_addr")).alias("src_ip"), render.ip(F.col("dst_addr")).alias("dst_ip"))


@query(WITH + "SELECT event_id, regexp_replace(lpad(format('{:x}', src_mac), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac FROM flows")
def render_mac(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", render.mac(F.col("src_mac")).alias("mac"))


_case = lambda column, table: f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " ELSE '' END"


@query(
    WITH + f"""SELECT event_id, {_case("proto", {k: names.PROTOCOL_NAMES[k] for k in (1, 6, 17, 47, 58)})} AS proto_name, {_case("etype", names.ETYPES)} AS etype_name,
    CASE proto WHEN 1 THEN {_case("icmp_type", names.ICMP_TYPES)} WHEN 58 THEN {_case("icmp_type", names.ICMP6_TYPES)} ELSE 'unknown' END AS icmp_name FROM flows"""
)
def render_proto_icmp(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select("event_id", render.protocol(F.col("proto")).alias("proto_name"), render.etype(F.col("etype")).alias("etype_name"), render.icmp(F.col("proto"), F.col("icmp_type")).alias("icmp_name"))


@query(
    WITH + f""", m AS (SELECT event_id, etype, src_net, CASE WHEN src_net = 0 THEN 0 ELSE (src >> (32 - src_net)) << (32 - src_net) END AS a FROM flows)
    SELECT event_id, CASE WHEN etype = 34525 AND a = 0 THEN '2001:db8::' ELSE {ip_sql('a')} END || '/' || (src_net + CASE WHEN etype = 34525 THEN 96 ELSE 0 END) AS net FROM m"""
)
def render_network(spark, sf_dir):
    bits = F.col("src_net") + F.when(F.col("etype") == 34525, 96).otherwise(0)
    return flows(spark, sf_dir).select("event_id", render.network(F.col("src_addr"), bits).alias("net"))


@query(WITH + "SELECT event_id, strftime(make_timestamp(time_received_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN time_received_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(time_received_ns % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z' AS received FROM flows")
def render_datetime_nano(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", render.datetime_nano(F.col("time_received_ns")).alias("received"))


@query(
    WITH + """, t AS (SELECT event_id, encode(CAST(src_as AS VARCHAR) || CAST(dst_port AS VARCHAR)) AS b FROM flows),
    u AS (SELECT event_id, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || substr(hex(b), CAST(2 * i - 1 AS INT), 2))::BIGINT) AS o FROM t)
    SELECT event_id, list_reduce(list_prepend(2166136261, o), lambda h, x: xor((h * 16777619) % 4294967296, x)) AS key FROM u"""
)
def partition_key_fnv(spark, sf_dir):
    f = flows(spark, sf_dir)
    key = values.partition_key([("src_as", "bigint"), ("dst_port", "bigint")])
    return f.select("event_id", values.uint_be(key).alias("key"))


@query("SELECT event_id, (3900000000 + event_id - 2208988800) * 1000000000 + CAST(floor((event_id * 429497) % 4294967296 * 1e9 / 4294967296.0::DOUBLE) AS BIGINT) AS ns FROM events")
def ntp_time(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    ntp = F.shiftleft(F.lit(3900000000) + i, 32).bitwiseOR(i * 429497 % 2**32)
    return e.select("event_id", values.ntp_to_ns(ntp).alias("ns"))


@query("SELECT event_id, (event_id * 1048573 >> 20) & 8191 AS bits FROM events")
def bit_slice(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    packed = F.unhex(F.lpad(F.hex(F.col("event_id") * 1048573), 16, "0"))
    return e.select("event_id", values.bit_slice(packed, 64 - 20 - 13, 13).alias("bits"))


V5_SQL = f"""
, d AS (SELECT *, event_id // 10 AS g, max(time_received_ns) OVER (PARTITION BY event_id // 10) AS received_ns, count(*) OVER (PARTITION BY event_id // 10) AS n FROM flows)
"""


@query(
    WITH + V5_SQL + f"""SELECT g AS flow_sequence, n AS "count", {UPTIME} AS sys_uptime, received_ns // 1000000000 AS unix_secs, event_id % 10 AS rec_idx, in_if, out_if, packets AS dpkts, bytes AS doctets,
    {UPTIME} - event_id % 1000 AS "first", {UPTIME} - event_id % 100 AS "last", src_port, dst_port, event_id % 64 AS tcp_flags, proto, event_id % 256 AS tos, src_as, dst_as, src_net % 33 AS src_mask, 24 AS dst_mask FROM d"""
)
def v5_decode(spark, sf_dir):
    r = v5.decode(as_v5(flows(spark, sf_dir)))
    header = [F.col(f"h.{c}").alias(c) for c in ("flow_sequence", "count", "sys_uptime", "unix_secs")]
    renamed = {"input": "in_if", "output": "out_if"}
    record = [F.col(f"r.{c}").alias(renamed.get(c, c)) for c in ("input", "output", "dpkts", "doctets", "first", "last", "src_port", "dst_port", "tcp_flags", "proto", "tos", "src_as", "dst_as", "src_mask", "dst_mask")]
    return r.select(*header, F.col("rec_idx").cast("long").alias("rec_idx"), *record)


V5_FLOW_SQL = WITH + V5_SQL + """SELECT g AS sequence_num, received_ns AS time_received_ns, 100 AS sampling_rate, '10.255.0.' || g % 8 AS sampler, received_ns // 1000000000 * 1000000000 - event_id % 1000 * 1000000 AS time_flow_start_ns,
    received_ns // 1000000000 * 1000000000 - event_id % 100 * 1000000 AS time_flow_end_ns, bytes, packets, concat_ws('.', src >> 24, (src >> 16) & 255, (src >> 8) & 255, src & 255) AS src_ip,
    concat_ws('.', dst >> 24, (dst >> 16) & 255, (dst >> 8) & 255, dst & 255) AS dst_ip, proto, src_port, dst_port, in_if, out_if, event_id % 256 AS ip_tos, event_id % 64 AS tcp_flags, src_as, dst_as, src_net % 33 AS src_net, 24 AS dst_net FROM d"""


def flow_digest(f: DataFrame) -> DataFrame:
    return f.select(
        "sequence_num", "time_received_ns", "sampling_rate", render.ip(F.col("sampler_address")).alias("sampler"), "time_flow_start_ns", "time_flow_end_ns", "bytes", "packets", render.ip(F.col("src_addr")).alias("src_ip"),
        render.ip(F.col("dst_addr")).alias("dst_ip"), "proto", "src_port", "dst_port", "in_if", "out_if", "ip_tos", "tcp_flags", "src_as", "dst_as", "src_net", "dst_net",
    )


@query(V5_FLOW_SQL)
def v5_normalize(spark, sf_dir):
    return flow_digest(v5.flows(as_v5(flows(spark, sf_dir))))


@query("""WITH n AS (SELECT * FROM (VALUES (167772160, 24, 100), (167772160, 8, 1), (167772416, 24, 200), (167772160, 28, 300)) t(net, len, asn)), f AS (""" + FLOWS_SQL + """)
SELECT event_id, coalesce((SELECT arg_max(asn + CASE WHEN etype = 34525 THEN 1000 ELSE 0 END, len) FROM n WHERE src >> (32 - len) = net >> (32 - len)), 0)::BIGINT AS asn,
CASE WHEN dst >> 8 = 720896 THEN 'CH' WHEN etype = 34525 THEN 'FR' ELSE '' END AS country, 512 AS sampling_rate FROM f""")
def geo_enrich_lpm(spark, sf_dir):
    v4 = [("10.0.0.0", 24, 100), ("10.0.0.0", 8, 1), ("10.0.1.0", 24, 200), ("10.0.0.0", 28, 300)]
    v6 = [(f"2001:db8::{address}", 96 + n, 1000 + asn) for address, (n, asn) in zip(("a00:0", "a00:0", "a00:100", "a00:0"), ((24, 100), (8, 1), (24, 200), (28, 300)), strict=True)]
    nets = spark.createDataFrame([(f"{a}/{n}", asn) for a, n, asn in v4 + v6], "cidr string, asn long")
    places = spark.createDataFrame([("11.0.0.0/24", "CH"), ("2001:db8::/32", "FR"), ("2001:db8::b00:0/120", "CH")], "cidr string, country string")
    f = enrich.enrich(flows(spark, sf_dir), asn=nets, country=places, sampling_rate=512)
    return f.select("event_id", F.col("src_as").alias("asn"), F.col("dst_country").alias("country"), "sampling_rate")


JSON = serialize.Format(fields=("sequence_num", "etype", "proto", "bytes", "src_mac"), rename={"bytes": "octets"})
PROTO_NAME = _case("proto", {k: names.PROTOCOL_NAMES[k] for k in (1, 6, 17, 47, 58)})
MAC_SQL = "regexp_replace(lpad(format('{:x}', src_mac), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"


@query(WITH + f"""SELECT event_id, '{{"sequence_num":' || sequence_num || ',"etype":"' || {_case("etype", names.ETYPES)} || '","proto":"' || {PROTO_NAME} || '","octets":' || bytes || ',"src_mac":"' || {MAC_SQL} || '"}}' AS json FROM flows""")
def flow_json(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select("event_id", serialize.to_json(f, JSON).alias("json"))


@query(WITH + f"""SELECT event_id, 'sequence_num=' || sequence_num || ' etype=' || {_case("etype", names.ETYPES)} || ' proto=' || {PROTO_NAME} || ' octets=' || bytes || ' src_mac=' || {MAC_SQL} AS "text" FROM flows""")
def flow_text(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select("event_id", serialize.to_text(f, JSON).alias("text"))


#: Columns of the round trip that the view does not have: their SQL, and their Spark expressions.
MORE = {
    "type": ("1 + event_id % 4", lambda i: 1 + i % 4), "time_flow_end_ns": ("-event_id", lambda i: -i), "dst_mac": ("9223372036854775807 - event_id", lambda i: F.lit(2**63 - 1) - i), "dst_net": ("event_id % 2", lambda i: i % 2),
    "as_path": ("[event_id, 0, event_id * 1000003]", lambda i: F.array(i, F.lit(0).cast("long"), i * 1000003)), "mpls_label": ("CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_id % 200] END", lambda i: F.when(i % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 200))),
    "layer_stack": ("[0, CAST(event_id % 14 AS INT)]", lambda i: F.array(F.lit(0), (i % 14).cast("int"))),
}
TRIPPED = ["time_received_ns", "sequence_num", "sampling_rate", "time_flow_start_ns", "bytes", "packets", "etype", "proto", "src_port", "dst_port", "in_if", "out_if", "src_mac", "icmp_type", "src_as", "dst_as", "src_net"]
UNSET = [n for n in FLOW_COLUMNS if n not in {*TRIPPED, *MORE, "src_addr", "dst_addr", "sampler_address", "mpls_ip"}]


def _listed(sql: str) -> str:
    return f"array_to_string({sql}, ',')"


@query(
    WITH + f"SELECT {', '.join(TRIPPED)}, {ip_sql('src')} AS src_addr, {ip_sql('dst')} AS dst_addr, {ip_sql('dst')} || ',' || {ip_sql('src')} AS mpls_ip, concat_ws('.', sampler >> 24, (sampler >> 16) & 255, (sampler >> 8) & 255, sampler & 255) AS sampler_address, "
    + ", ".join(f"{_listed(sql) if '[' in sql else sql} AS {n}" for n, (sql, _) in MORE.items()) + f", {len(UNSET)} AS unset FROM flows"
)
def proto_roundtrip(spark, sf_dir):
    """All columns through messages and back; those that the view does not set must come back unset."""
    f = flows(spark, sf_dir).withColumns({n: make(F.col("event_id")) for n, (_, make) in MORE.items()}).withColumn("mpls_ip", F.array("dst_addr", "src_addr"))
    back = serialize.from_protobuf(serialize.to_protobuf(f))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    empty = [F.size(n) == 0 if FLOW_SCHEMA[n].dataType.typeName() == "array" else F.length(n) == 0 if FLOW_SCHEMA[n].dataType.typeName() == "binary" else F.col(n) == 0 for n in UNSET]
    return back.select(
        *TRIPPED, *[render.ip(F.col(c)).alias(c) for c in ("src_addr", "dst_addr", "sampler_address")], F.array_join(F.transform("mpls_ip", render.ip), ",").alias("mpls_ip"),
        *[text(n) if "[" in sql else F.col(n) for n, (sql, _) in MORE.items()], sum((e.cast("int") for e in empty), F.lit(0)).alias("unset"),
    )


@query(WITH + ", g AS (SELECT event_id // 50 AS g, sum(bytes)::BIGINT AS bytes, count(*) AS n FROM flows GROUP BY 1) SELECT g, bytes, n, 2001 * n AS tags, n * (n - 1) // 2 + 50 * g * n AS numbers, 4 * n AS lengths FROM g")
def delimited_messages(spark, sf_dir):
    """Fifty messages a value, as a topic or a file has them, with extensions that the reader does not declare."""
    f = flows(spark, sf_dir).withColumns({"vendor": F.col("event_id"), "name": F.encode(F.lit("name"), "UTF-8")})
    extensions = (serialize.Extension("vendor", 2001), serialize.Extension("name", 2002, "bytes"))
    one = serialize.to_protobuf(f, extensions)
    group = F.pmod(F.xxhash64("message"), F.lit(1 + f.count() // 50))
    many = one.groupBy(group.alias("k")).agg(F.unhex(F.array_join(F.collect_list(F.hex("message")), "")).alias("message"))
    back = serialize.from_protobuf(many, unknown=True)
    held = lambda t: F.filter("unknown", lambda u: u["tag"] == t)
    return back.groupBy(values.floor_div(F.col("sequence_num"), 50).alias("g")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), (F.count("*") * 2001).alias("tags"), F.sum(F.coalesce(F.get(held(2001), 0)["number"], F.lit(0))).alias("numbers"),
        F.sum(F.length(F.get(held(2002), 0)["bytes"])).cast("long").alias("lengths"),
    )


# Spark's own relational operators on the flow table.


@query(WITH + "SELECT proto, etype, sum(bytes)::BIGINT AS bytes, count(*) AS n FROM flows GROUP BY CUBE (proto, etype)")
def cube_traffic(spark, sf_dir):
    return flows(spark, sf_dir).cube("proto", "etype").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


@query(WITH + "SELECT proto, etype, sum(bytes)::BIGINT AS bytes, count(*) AS n FROM flows GROUP BY ROLLUP (proto, etype)")
def rollup_traffic(spark, sf_dir):
    return flows(spark, sf_dir).rollup("proto", "etype").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


@query(WITH + "SELECT proto, etype, in_if, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY GROUPING SETS ((proto), (etype, in_if), ())")
def grouping_sets(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.groupingSets([["proto"], ["etype", "in_if"], []], "proto", "etype", "in_if").agg(F.sum("bytes").alias("bytes"))


@query(WITH + "SELECT proto, count(DISTINCT src) AS talkers FROM flows GROUP BY proto HAVING count(DISTINCT src) > 1")
def distinct_talkers(spark, sf_dir):
    return flows(spark, sf_dir).groupBy("proto").agg(F.countDistinct("src").alias("talkers")).filter("talkers > 1")


@query()
def approx_talkers(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.groupBy("proto").agg(F.approx_count_distinct("src").alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("src")).alias("hll"))


@query(WITH + ", s AS (SELECT proto, src_as, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY ALL) SELECT proto, src_as, bytes, rnk FROM (SELECT *, rank() OVER (PARTITION BY proto ORDER BY bytes DESC, src_as) AS rnk FROM s) WHERE rnk <= 10")
def rank_talkers(spark, sf_dir):
    s = flows(spark, sf_dir).groupBy("proto", "src_as").agg(F.sum("bytes").alias("bytes"))
    w = Window.partitionBy("proto").orderBy(F.desc("bytes"), "src_as")
    return s.withColumn("rnk", F.rank().over(w).cast("long")).filter("rnk <= 10")


@query(WITH + "SELECT event_id, sequence_num - lag(sequence_num) OVER (PARTITION BY src_as ORDER BY time_received_ns, event_id) AS gap FROM flows")
def seq_gap_lag(spark, sf_dir):
    f = analytics.previous(flows(spark, sf_dir), ["src_as"], "time_received_ns", ["event_id"], "sequence_num", "before", 3600)
    return f.select("event_id", (F.col("sequence_num") - F.col("before")).alias("gap"))


@query(
    WITH + """, a AS (SELECT src, time_received_ns AS t, CASE WHEN time_received_ns - lag(time_received_ns) OVER w >= 21600000000000 OR lag(time_received_ns) OVER w IS NULL THEN 1 ELSE 0 END AS first_ FROM flows WINDOW w AS (PARTITION BY src ORDER BY time_received_ns)),
    b AS (SELECT *, sum(first_) OVER (PARTITION BY src ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM a)
    SELECT src, make_timestamp(min(t) // 1000) AS start, count(*) AS n FROM b GROUP BY src, k"""
)
def session_flows(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("ts", values.timestamp_of_ns(F.col("time_received_ns")))
    s = f.groupBy("src", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("src", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    WITH + """, s AS (SELECT unnest([time_received_ns // 300000000000 * 300000000, time_received_ns // 300000000000 * 300000000 - 300000000]) AS us, bytes FROM flows)
    SELECT make_timestamp(us) AS start, sum(bytes)::BIGINT AS bytes FROM s GROUP BY 1"""
)
def sliding_10m(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("ts", values.timestamp_of_ns(F.col("time_received_ns")))
    s = f.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.sum("bytes").alias("bytes"))
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "bytes")


@query(WITH + "SELECT a.event_id AS a_id, b.event_id AS b_id FROM flows a JOIN flows b ON a.src_as = b.dst_as AND a.dst_as = b.src_as AND abs(a.time_received_ns - b.time_received_ns) <= 3600000000000")
def bidir_interval_join(spark, sf_dir):
    """Flows answered within an hour.  Time is cut into buckets of an hour, so the join is an equi-join on (AS pair, bucket)."""
    hour = 3600 * 10**9
    f = flows(spark, sf_dir).select("event_id", "src_as", "dst_as", F.col("time_received_ns").alias("t"))
    a = f.select(F.col("event_id").alias("a_id"), F.col("src_as").alias("x"), F.col("dst_as").alias("y"), F.col("t").alias("ta"), values.floor_div(F.col("t"), hour).alias("k"))
    near = F.array(*[values.floor_div(F.col("t"), hour) + d for d in (-1, 0, 1)])
    b = f.select(F.col("event_id").alias("b_id"), F.col("dst_as").alias("x"), F.col("src_as").alias("y"), F.col("t").alias("tb"), F.explode(near).alias("k"))
    return a.join(b, ["x", "y", "k"]).filter(F.abs(F.col("ta") - F.col("tb")) <= hour).select("a_id", "b_id")


def blocked(f: DataFrame) -> DataFrame:
    return f.filter("dst_as < 20").select(F.col("dst_as").alias("src_as")).distinct()


@query(WITH + "SELECT event_id FROM flows WHERE src_as IN (SELECT dst_as FROM flows WHERE dst_as < 20)")
def semi_blocklist(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.join(blocked(f), "src_as", "left_semi").select("event_id")


@query(WITH + "SELECT event_id FROM flows WHERE src_as NOT IN (SELECT dst_as FROM flows WHERE dst_as < 20)")
def anti_blocklist(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.join(blocked(f), "src_as", "left_anti").select("event_id")


@query(WITH + "SELECT src_as AS asn, bytes FROM flows UNION ALL SELECT dst_as, bytes FROM flows")
def union_feeds(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select(F.col("src_as").alias("asn"), "bytes").unionByName(f.select(F.col("dst_as").alias("asn"), "bytes"))


@query(WITH + "SELECT src_as AS asn FROM flows INTERSECT SELECT dst_as FROM flows")
def intersect_feeds(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select(F.col("src_as").alias("asn")).intersect(f.select("dst_as"))


@query(WITH + "SELECT src_port % 1000 AS port FROM flows EXCEPT SELECT dst_port % 700 FROM flows")
def except_feeds(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select((F.col("src_port") % 1000).alias("port")).subtract(f.select(F.col("dst_port") % 700))


@query(WITH + ", s AS (SELECT src_as, sum(bytes)::BIGINT AS sent FROM flows GROUP BY 1), r AS (SELECT dst_as AS src_as, sum(bytes)::BIGINT AS received FROM flows GROUP BY 1) SELECT src_as AS asn, sent, received FROM s FULL JOIN r USING (src_as)")
def full_join_as_balance(spark, sf_dir):
    f = flows(spark, sf_dir)
    sent = f.groupBy(F.col("src_as").alias("asn")).agg(F.sum("bytes").alias("sent"))
    return sent.join(f.groupBy(F.col("dst_as").alias("asn")).agg(F.sum("bytes").alias("received")), "asn", "full")


# Templates, samples and frames.

_EXPORTER_SQL = WITH + f", d AS (SELECT *, event_id // 10 AS g, event_id // 10 // {EXPORTERS} AS k FROM flows) "
_V4_SQL = lambda v: f"concat_ws('.', {v} >> 24, ({v} >> 16) & 255, ({v} >> 8) & 255, {v} & 255)"


@query(
    _EXPORTER_SQL + f"""SELECT g AS sequence_num, ({START_S} + g) * 1000000000 + 2 AS time_received_ns, CASE WHEN k >= {SECOND_RATE} THEN 200 + g % {EXPORTERS} WHEN k >= {FIRST_RATE} THEN 100 + g % {EXPORTERS} ELSE 0 END AS sampling_rate,
    '10.255.0.' || g % {EXPORTERS} AS sampler, ({START_S} + g) * 1000000000 - event_id % 1000 * 1000000 AS time_flow_start_ns, ({START_S} + g) * 1000000000 - event_id % 100 * 1000000 AS time_flow_end_ns, bytes, packets,
    {_V4_SQL('src')} AS src_ip, {_V4_SQL('dst')} AS dst_ip, proto, src_port, dst_port, in_if, out_if, src_as, dst_as FROM d WHERE k >= {FIRST_TEMPLATE}"""
)
def v9_asof_templates(spark, sf_dir):
    f = netflow.flows(as_v9(flows(spark, sf_dir))).filter("error IS NULL")
    return flow_digest(f).drop("ip_tos", "tcp_flags", "src_net", "dst_net")


@query(_EXPORTER_SQL + f"SELECT '10.255.0.' || g % {EXPORTERS} AS sampler, count(*) AS n, sum(bytes * CASE WHEN k >= {SECOND_RATE} THEN 200 + g % {EXPORTERS} WHEN k >= {FIRST_RATE} THEN 100 + g % {EXPORTERS} ELSE 0 END)::BIGINT AS sumbytes FROM d WHERE k >= {FIRST_TEMPLATE} GROUP BY 1")
def sampling_asof(spark, sf_dir):
    f = netflow.flows(as_v9(flows(spark, sf_dir))).filter("error IS NULL")
    return f.groupBy(render.ip(F.col("sampler_address")).alias("sampler")).agg(F.count("*").alias("n"), analytics.scaled_bytes())


@query(_EXPORTER_SQL + f"""SELECT g AS sequence_num, {_V4_SQL('src')} AS src_ip, {_V4_SQL('dst')} AS dst_ip, bytes, packets, src_port, dst_port, proto, time_received_ns // 1000000 * 1000000 - event_id % 1000 * 1000000 AS time_flow_start_ns, time_received_ns // 1000000 * 1000000 AS time_flow_end_ns, 7 AS observation_domain_id FROM d""")
def ipfix_decode(spark, sf_dir):
    f = netflow.flows(as_ipfix(flows(spark, sf_dir)))
    return f.select("sequence_num", render.ip(F.col("src_addr")).alias("src_ip"), render.ip(F.col("dst_addr")).alias("dst_ip"), "bytes", "packets", "src_port", "dst_port", "proto", "time_flow_start_ns", "time_flow_end_ns", "observation_domain_id")


CUSTOM = compile_mapping({
    "formatter": {"protobuf": [{"name": "app", "index": 2001, "type": "string"}, {"name": "vendor", "index": 2002, "type": "varint"}, {"name": "udp_length", "index": 2003, "type": "varint"}]},
    "ipfix": {"mapping": [{"field": 96, "destination": "app"}, {"penprovided": True, "pen": 9999, "field": 1, "destination": "vendor"}]},
    "sflow": {"mapping": [{"layer": "udp", "offset": 32, "length": 16, "destination": "udp_length"}]},
})


@query(WITH + "SELECT src_port, dst_port, bytes, repeat('a', CAST(event_id % 5 AS INT)) AS app, in_if AS vendor FROM flows")
def custom_mapping(spark, sf_dir):
    f = netflow.flows(as_ipfix(flows(spark, sf_dir)), CUSTOM)
    return f.select("src_port", "dst_port", "bytes", render.string(F.col("app")).alias("app"), "vendor")


@query(
    WITH + f"""SELECT event_id // 10 AS sequence_num, sampling_rate, bytes, 1 AS packets, {_V4_SQL('src')} AS src_ip, {_V4_SQL('dst')} AS dst_ip, 2048 AS etype, 17 AS proto, src_port, dst_port, in_if, out_if, src_mac, event_id % 4096 AS vlan_id,
    event_id % 100 AS src_vlan, event_id % 90 AS dst_vlan, CASE WHEN src_as = 0 THEN 65000 ELSE src_as END AS src_as, dst_as, 65001 AS next_hop_as, '10.0.0.254' AS next_hop, '10.0.0.253' AS bgp_next_hop, 24 AS src_net, 16 AS dst_net, '0,6,1,4' AS layers, 28 AS udp_length FROM flows"""
)
def sflow_decode(spark, sf_dir):
    f = sflow.flows(as_sflow(flows(spark, sf_dir)), CUSTOM)
    ips = [render.ip(F.col(c)).alias(n) for c, n in (("src_addr", "src_ip"), ("dst_addr", "dst_ip"), ("next_hop", "next_hop"), ("bgp_next_hop", "bgp_next_hop"))]
    plain = ("sequence_num", "sampling_rate", "bytes", "packets", "etype", "proto", "src_port", "dst_port", "in_if", "out_if", "src_mac", "vlan_id", "src_vlan", "dst_vlan", "src_as", "dst_as", "next_hop_as", "src_net", "dst_net", "udp_length")
    return f.select(*plain, *ips, F.array_join(F.col("layer_stack").cast("array<string>"), ",").alias("layers"))


@query(WITH + "SELECT event_id // 10 AS sequence, CASE WHEN x = 0 THEN 1 ELSE 2 END AS \"format\", CASE WHEN x = 0 THEN count(*) ELSE 1 END AS n FROM flows, (VALUES (0), (1)) t(x) GROUP BY event_id // 10, x")
def sflow_samples(spark, sf_dir):
    return sflow.samples(as_sflow(flows(spark, sf_dir))).groupBy("sequence", "format").agg(F.count("*").alias("n"))


@query(WITH + f"SELECT event_id, {_V4_SQL('src')} AS src_ip, {_V4_SQL('dst')} AS dst_ip, src_port, dst_port, event_id % 256 AS ip_tos, event_id % 200 AS ip_ttl, event_id % 65536 AS fragment_id, 2 AS ip_flags, event_id % 4096 AS vlan_id, src_mac, '14,4,20,8' AS sizes FROM flows")
def packet_headers(spark, sf_dir):
    frames = flows(spark, sf_dir).select("event_id", F.unhex(frame()).alias("frame"))
    p = packet.parse_frames(frames, keep=["event_id"])
    sizes = F.array_join(F.col("layer_size").cast("array<string>"), ",").alias("sizes")
    return p.select("event_id", render.ip(F.col("src_addr")).alias("src_ip"), render.ip(F.col("dst_addr")).alias("dst_ip"), "src_port", "dst_port", "ip_tos", "ip_ttl", "fragment_id", "ip_flags", "vlan_id", "src_mac", sizes)


# Operational metrics.


@query(WITH + ", d AS (SELECT event_id // 10 AS g, count(*) AS n FROM flows GROUP BY 1) SELECT '10.255.0.' || g % 8 AS remote_ip, '10.254.254.255' AS local_ip, 2055 AS local_port, 'netflow' AS \"type\", count(*) AS \"count\", sum(24 + 48 * n)::BIGINT AS \"sum\" FROM d GROUP BY 1")
def metrics_by_router(spark, sf_dir):
    m = metrics.traffic(as_v5(flows(spark, sf_dir)))
    return m.drop("quantiles")


@query()
def size_quantiles(spark, sf_dir):
    return metrics.traffic(as_v9(flows(spark, sf_dir)))


@query(_EXPORTER_SQL + f"SELECT '10.255.0.' || g % {EXPORTERS} AS router, 'template not found' AS error, count(DISTINCT g) AS n FROM d WHERE k < {FIRST_TEMPLATE} GROUP BY 1")
def decoder_errors(spark, sf_dir):
    return metrics.decoder_errors(netflow.errors(as_v9(flows(spark, sf_dir))))


@query(
    WITH + """, e AS (SELECT src_as, time_received_ns // 86400000000000 * 86400 AS interval_s, time_received_ns, row_number() OVER (PARTITION BY src_as, time_received_ns // 86400000000000 ORDER BY time_received_ns) AS k FROM flows)
    SELECT src_as, interval_s, count(*) AS events, greatest(count(*) - 3, 0) AS skipped, count_if(k <= 3) AS shown, sum(time_received_ns) FILTER (k <= 3)::BIGINT AS times FROM e GROUP BY 1, 2"""
)
def error_mute(spark, sf_dir):
    shown, counts = metrics.muted(flows(spark, sf_dir), ["src_as"], "time_received_ns", 86400, 3)
    slot = values.floor_div(F.col("time_received_ns"), 86400 * 10**9) * 86400
    seen = shown.groupBy("src_as", slot.alias("interval_s")).agg(F.count("*").alias("shown"), F.sum("time_received_ns").alias("times"))
    return counts.join(seen, ["src_as", "interval_s"])


@query(WITH + "SELECT event_id // 10 % 8 AS exporter, 'FlowSample' AS \"type\", count(*) AS samples, count(*) * 4 AS records FROM flows GROUP BY 1 UNION ALL SELECT g % 8, 'CounterSample', count(*), 0 FROM (SELECT DISTINCT event_id // 10 AS g FROM flows) GROUP BY 1")
def sflow_sample_counts(spark, sf_dir):
    m = metrics.sample_counts(sflow.samples(as_sflow(flows(spark, sf_dir))))
    return m.select(F.element_at(F.split("agent", r"\."), -1).cast("long").alias("exporter"), "type", "samples", F.col("records").cast("long").alias("records"))


@query(WITH + ", d AS (SELECT event_id // 10 AS g, event_id // 10 % 8 AS exporter, event_id // 10 // 8 AS k FROM flows) SELECT exporter, \"type\", count(DISTINCT g) AS n FROM (SELECT exporter, g, 'data' AS \"type\" FROM d UNION ALL SELECT exporter, g + 1000000 * (1 + CAST(k = 30 AS INT)), 'data' FROM d WHERE k IN (5, 30) UNION ALL SELECT exporter, g, 'options' FROM d WHERE k IN (5, 30) UNION ALL SELECT exporter, g, 'template' FROM d WHERE k IN (2, 20)) GROUP BY 1, 2")
def flow_set_counts(spark, sf_dir):
    m = metrics.flow_sets(netflow.sets(as_v9(flows(spark, sf_dir))))
    return m.select(F.element_at(F.split("router", r"\."), -1).cast("long").alias("exporter"), "type", "n")


@query(WITH + "SELECT '10.255.0.' || (event_id // 10) % 8 AS router, 5 AS version, 'data' AS \"type\", count(*) AS n FROM flows GROUP BY 1")
def v5_record_counts(spark, sf_dir):
    return metrics.v5_records(as_v5(flows(spark, sf_dir)))


@query(
    WITH + f""", d AS (SELECT DISTINCT event_id // 10 AS g FROM flows), k AS (SELECT g, g // {EXPORTERS} AS k, '10.255.0.' || g % {EXPORTERS} AS router FROM d)
    SELECT router, 5 AS version, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT router, 9, count(*) + count_if(k IN ({FIRST_TEMPLATE}, {SECOND_TEMPLATE}, {FIRST_RATE}, {SECOND_RATE})) FROM k GROUP BY 1
    UNION ALL SELECT router, 10, count(*) FROM k GROUP BY 1"""
)
def netflow_versions(spark, sf_dir):
    f = flows(spark, sf_dir)
    return metrics.netflow_packets(as_v5(f).unionByName(as_v9(f)).unionByName(as_ipfix(f)).unionByName(as_sflow(f)))


@query(WITH + ", d AS (SELECT DISTINCT event_id // 10 AS g FROM flows) SELECT \"type\", count(*) * copies AS packets FROM d, (VALUES ('netflow', 2), ('sflow', 1), ('unknown', 1)) t(\"type\", copies) GROUP BY 1, copies")
def protocol_mix(spark, sf_dir):
    f = flows(spark, sf_dir)
    junk = as_v5(f).withColumn("payload", F.concat(F.unhex(F.lit("0007")), "payload"))
    d = as_v5(f).unionByName(as_ipfix(f)).unionByName(as_sflow(f)).unionByName(junk)
    return metrics.traffic(d).groupBy("type").agg(F.sum("count").alias("packets"))


@query(
    _EXPORTER_SQL + f"""SELECT '10.255.0.' || g % {EXPORTERS} AS router, 9 AS version, 'data' AS "type", count(*) AS n FROM d WHERE k >= {FIRST_TEMPLATE} GROUP BY 1
    UNION ALL SELECT '10.255.0.' || g % {EXPORTERS}, 9, 'options', count(DISTINCT g) FROM d WHERE k IN ({FIRST_RATE}, {SECOND_RATE}) GROUP BY 1
    UNION ALL SELECT '10.255.0.' || g % {EXPORTERS}, 10, 'data', count(*) FROM d GROUP BY 1"""
)
def netflow_record_counts(spark, sf_dir):
    f = flows(spark, sf_dir)
    rows = written(netflow.sets(as_v9(f).unionByName(as_ipfix(f))), "sets")
    return metrics.netflow_records(netflow.with_templates(rows))


@query(
    _EXPORTER_SQL + f""", u AS (SELECT g % {EXPORTERS} AS e, min(g) FILTER (k = {FIRST_TEMPLATE}) AS first_, max(g) FILTER (k = {SECOND_TEMPLATE}) AS second_, max(g) AS last_, count(DISTINCT CASE WHEN k IN ({FIRST_TEMPLATE}, {SECOND_TEMPLATE}) THEN k END) AS adds FROM d GROUP BY 1)
    SELECT '10.255.0.' || e AS router, 260 AS template_id, ({START_S} + first_) * 1000000000 AS added_ns, ({START_S} + coalesce(second_, first_)) * 1000000000 AS updated_ns, ({START_S} + last_) * 1000000000 + 2 AS accessed_ns, adds, 0 AS removals FROM u WHERE first_ IS NOT NULL"""
)
def template_lifetimes(spark, sf_dir):
    rows = written(netflow.sets(as_v9(flows(spark, sf_dir))), "sets")
    t = metrics.template_counts(netflow.with_templates(rows), rows).filter("template_id = 260")
    return t.select(render.ip(F.col("src_addr")).alias("router"), "template_id", "added_ns", "updated_ns", "accessed_ns", "adds", "removals")


@query(_EXPORTER_SQL + f"SELECT '10.255.0.' || g % {EXPORTERS} AS router, count(*) AS n, count_if(event_id % 100 > 0) AS late FROM d WHERE k >= {FIRST_TEMPLATE} GROUP BY 1")
def flow_delays(spark, sf_dir):
    f = netflow.flows(as_v9(flows(spark, sf_dir))).filter("error IS NULL")
    delay = metrics.flow_delay(f).select("router", F.col("count").alias("n"))
    late = f.filter(F.col("time_received_ns") - F.col("time_flow_end_ns") > 10**6).groupBy(render.ip(F.col("sampler_address")).alias("router")).agg(F.count("*").alias("late"))
    return delay.join(late, "router")


@query(_EXPORTER_SQL + f"SELECT '10.255.0.' || g % {EXPORTERS} AS sampler, count(*) AS n, sum(bytes * CASE WHEN k > {FIRST_RATE} THEN 300 + g % {EXPORTERS} ELSE 0 END)::BIGINT AS sumbytes FROM d GROUP BY 1")
def ipfix_options_sampling(spark, sf_dir):
    f = netflow.flows(as_ipfix_options(flows(spark, sf_dir))).filter("error IS NULL")
    return f.groupBy(render.ip(F.col("sampler_address")).alias("sampler")).agg(F.count("*").alias("n"), analytics.scaled_bytes())


def whole_layer(view: packet.View) -> packet.Step:
    """A parser of one's own: what is left is its layer."""
    view.layer("Custom")
    return packet.Step(len(view.data))


def stack_environment() -> packet.Environment:
    env = packet.Environment().register("whole", whole_layer, level=70)
    for port, name in ((6081, "geneve"), (3544, "teredo-dst"), (53, "whole")):
        env.on_port("udp", "dst", port, name)
    return env


_SHAPE = lambda *cases, other="0": "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases) + f" ELSE {other} END"
_STACKS = ("0,5,1,3", "0,2,3", "0,2,11,4", "0,2,10", "0,1,9,1,7", "0,1,4,12,0,1,7", "0,2,4,13,2", "0,2,8", "0,1,4,99")
_SIZES = ("14,4,20,20", "14,40,32", "14,40,8,8", "14,40,40", "14,20,4,20,8", "14,20,8,8,14,20,8", "14,40,8,0,40", "14,40,8", "14,20,8,")
_LOW = "25600 + src_port % 6000"


@query(
    WITH + f""", s AS (SELECT * EXCLUDE (etype), event_id % 9 AS k, CASE WHEN event_id % 9 IN (1, 2, 3, 6, 7) THEN 34525 ELSE 2048 END AS etype FROM flows)
    SELECT event_id, {_SHAPE(*[(k, f"'{x}'") for k, x in enumerate(_STACKS)], other="''")} AS layers, {_SHAPE(*[(k, f"'{x}'" + (" || event_id % 7" if k == 8 else "")) for k, x in enumerate(_SIZES)], other="''")} AS sizes, {ip_sql('src')} AS src_ip, {ip_sql('dst')} AS dst_ip, etype,
    {_SHAPE((0, 6), (1, 6), (2, 44), (3, 43), (4, 47), (7, 58), other="17")} AS proto, event_id % 256 AS ip_tos, event_id % 200 AS ip_ttl, CASE WHEN etype = 34525 THEN event_id % 1048576 ELSE 0 END AS flow_label,
    {_SHAPE((0, "src_port"), (1, "src_port"), (2, _LOW), (5, _LOW), (6, _LOW), (8, _LOW))} AS src_port, {_SHAPE((0, "dst_port"), (1, "dst_port"), (2, 9000), (5, 6081), (6, 3544), (8, 53))} AS dst_port,
    {_SHAPE((0, "event_id % 64"), (1, "event_id % 64"))} AS tcp_flags, CASE WHEN etype = 2048 THEN event_id % 65536 WHEN k = 2 THEN event_id ELSE 0 END AS fragment_id, {_SHAPE((2, "event_id % 100"))} AS fragment_offset,
    CASE WHEN etype = 2048 THEN 2 WHEN k = 2 THEN 1 ELSE 0 END AS ip_flags, {_SHAPE((0, "CAST(event_id % 1000 + 16 AS VARCHAR)"), other="''")} AS labels, {_SHAPE((0, "'64'"), other="''")} AS label_ttls, {_SHAPE((3, 1))} AS segments_left,
    CASE WHEN k = 3 THEN {ip_sql('dst')} || ',' || {ip_sql('src')} ELSE '' END AS segments, {_SHAPE((4, "event_id % 13"), (5, "event_id % 13"), (7, "event_id % 13"))} AS icmp_type, {_SHAPE((4, 3), (5, 3), (7, 3))} AS icmp_code, src_mac FROM s"""
)
def packet_stacks(spark, sf_dir):
    """MPLS, TCP, IPv6 and its extension headers, GRE, Geneve, Teredo, ICMP, ICMPv6 and a parser of one's own, in nine stacks of layers."""
    frames = flows(spark, sf_dir).select("event_id", F.unhex(stacked_frame()).alias("frame"))
    p = packet.parse_frames(frames, environment=stack_environment(), keep=["event_id"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return p.select(
        "event_id", text("layer_stack").alias("layers"), text("layer_size").alias("sizes"), render.ip(F.col("src_addr")).alias("src_ip"), render.ip(F.col("dst_addr")).alias("dst_ip"), "etype", "proto", "ip_tos", "ip_ttl",
        F.col("ipv6_flow_label").alias("flow_label"), "src_port", "dst_port", "tcp_flags", "fragment_id", "fragment_offset", "ip_flags", text("mpls_label").alias("labels"), text("mpls_ttl").alias("label_ttls"),
        F.col("ipv6_routing_header_seg_left").alias("segments_left"), F.array_join(F.transform("ipv6_routing_header_addresses", render.ip), ",").alias("segments"), "icmp_type", "icmp_code", "src_mac",
    )


@query(WITH + f"SELECT event_id // 10 AS sequence_num, sampling_rate, bytes, proto, etype, {ip_sql('src')} AS src_ip, {ip_sql('dst')} AS dst_ip, src_port, dst_port, event_id % 256 AS ip_tos, in_if, out_if FROM flows")
def sflow_expanded(spark, sf_dir):
    f = sflow.flows(as_sflow_all(flows(spark, sf_dir))).filter("error IS NULL")
    return f.select("sequence_num", "sampling_rate", "bytes", "proto", "etype", render.ip(F.col("src_addr")).alias("src_ip"), render.ip(F.col("dst_addr")).alias("dst_ip"), "src_port", "dst_port", "ip_tos", "in_if", "out_if")


_COUNTERS = [(n.partition(":")[0], k, 97, 7) for k, n in enumerate(sflow.INTERFACE)] + [(n, k, 89, 9) for k, n in enumerate(sflow.ETHERNET)]


@query(WITH + f", d AS (SELECT DISTINCT event_id // 10 AS g FROM flows) SELECT g AS sequence, source AS source_value, name, g % modulus + k AS \"value\" FROM d, (VALUES {', '.join(map(str, _COUNTERS))}) t(name, k, modulus, source)")
def sflow_counters(spark, sf_dir):
    assert len(INTERFACE_WIDTHS) == len(sflow.INTERFACE)
    return sflow.counters(as_sflow_all(flows(spark, sf_dir))).select("sequence", "source_value", "name", "value")


@query(WITH + ", d AS (SELECT DISTINCT event_id // 10 AS g FROM flows) SELECT g AS sequence, g % 5 AS drops, 4 AS \"input\", 5 AS \"output\", g % 7 AS reason, 1036 AS record FROM d")
def sflow_drops(spark, sf_dir):
    s = sflow.samples(as_sflow_all(flows(spark, sf_dir))).filter("format = 5")
    return s.select("sequence", "drops", "input", "output", "reason", F.col("formats")[0].alias("record"))


@query(WITH + ", d AS (SELECT event_id // 10 AS g, count(*) AS n FROM flows GROUP BY 1) SELECT count_if(g % 3 <> 0) AS good, count_if(g % 3 = 0) AS bad, sum(n) FILTER (g % 3 <> 0)::BIGINT AS flows FROM d")
def sflow_faults(spark, sf_dir):
    """Every third datagram is cut within its last sample: a dead letter each, and no flow of it."""
    d = as_sflow(flows(spark, sf_dir))
    cut = F.when(F.col("seq") / 4 % 3 == 0, F.substring("payload", F.lit(1), F.length("payload") - 3)).otherwise(F.col("payload"))
    f = sflow.flows(d.withColumn("payload", cut))
    return f.agg(F.countDistinct(F.when(F.col("error").isNull(), F.col("time_received_ns"))).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.col("error").isNull()).alias("flows"))


@query(WITH + V5_SQL + """, r AS (SELECT g, received_ns, any_value(n) AS n, sum(bytes)::BIGINT AS bytes, concat_ws('.', arg_min(src, event_id) >> 24, (arg_min(src, event_id) >> 16) & 255, (arg_min(src, event_id) >> 8) & 255, arg_min(src, event_id) & 255) AS first_src FROM d GROUP BY 1, 2)
SELECT 'netflowv5' AS "type", g AS flow_sequence, n AS "count", bytes, first_src, '10.255.0.' || g % 8 || ':2055' AS src,
strftime(make_timestamp(received_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN received_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(received_ns % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z' AS time_received, 'netflowv5 seq:' || g || ' count:' || n AS line FROM r""")
def raw_v5(spark, sf_dir):
    m = engine.produce(as_v5(flows(spark, sf_dir)), "raw")
    got = m.withColumn("p", F.from_json("message", "flow_sequence long, count long, records array<struct<src_addr:string,doctets:long>>"))
    return got.select(
        "type", "p.flow_sequence", "p.count", F.aggregate("p.records", F.lit(0).cast("long"), lambda a, r: a + r["doctets"]).alias("bytes"), F.col("p.records")[0]["src_addr"].alias("first_src"), "src", "time_received",
        F.substring_index("summary", ": ", -1).alias("line"),
    )


_NAMES = lambda table, fields: ",".join(table[k] for k, _ in fields)


@query(
    _EXPORTER_SQL + f"""SELECT 'netflowv9' AS "type", '10.255.0.' || g % {EXPORTERS} AS exporter, 'options' AS kind, 'FLOW_SAMPLER_ID,SAMPLING_INTERVAL' AS fields, 'System' AS scopes, count(DISTINCT g) AS n FROM d WHERE k IN ({FIRST_RATE}, {SECOND_RATE}) GROUP BY 2
    UNION ALL SELECT 'netflowv9', '10.255.0.' || g % {EXPORTERS}, 'template', '{_NAMES(names.V9_FIELDS, LAYOUT_A)}', '', count(DISTINCT g) FROM d WHERE k = {FIRST_TEMPLATE} GROUP BY 2
    UNION ALL SELECT 'ipfix', '10.255.0.' || g % {EXPORTERS}, 'options', 'samplingPacketInterval', 'observationDomainId', count(DISTINCT g) FROM d WHERE k = {FIRST_RATE} GROUP BY 2"""
)
def raw_template_names(spark, sf_dir):
    """Names of the fields and scopes of templates in raw JSON: version 9 data and options templates, IPFIX options templates."""
    f = flows(spark, sf_dir)
    m = engine.produce(as_v9(f).unionByName(as_ipfix_options(f)), "raw")
    sets = m.select("type", F.substring_index("src", ":", 1).alias("exporter"), F.explode(F.from_json(F.get_json_object("message", "$.sets"), "array<struct<kind:string,fields:array<struct<name:string,type:int>>,scopes:array<struct<name:string>>>>")).alias("s"))
    told = sets.filter("s.kind = 'options' OR (s.kind = 'template' AND s.fields[0].type = 1)")
    join = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return told.groupBy("type", "exporter", F.col("s.kind").alias("kind"), join("s.fields").alias("fields"), join("s.scopes").alias("scopes")).agg(F.count("*").alias("n"))


@query(WITH + f"SELECT {ip_sql('src')} AS ip, sum(bytes * sampling_rate)::BIGINT AS sumbytes FROM flows GROUP BY 1 ORDER BY sumbytes DESC, ip LIMIT 10")
def top_10_src_ips(spark, sf_dir):
    return analytics.top_ips(flows(spark, sf_dir), "src_addr", 10)


@query(ORACLES["rollup_5m"])
def rollup_merged(spark, sf_dir):
    """Partial rollups of seven parts of the rows, summed by key."""
    f = flows(spark, sf_dir)
    parts = analytics.rollup(f.filter("event_id % 7 = 0"))
    for k in range(1, 7):
        parts = parts.unionByName(analytics.rollup(f.filter(f"event_id % 7 = {k}")))
    return analytics.merge_rollups(parts).withColumn("timeslot", F.col("timeslot").cast("timestamp_ntz"))


@query(WITH + ", r AS (SELECT src_as % 50 AS src_as, etype, sum(bytes)::BIGINT AS b, sum(packets)::BIGINT AS p, count(*) AS n FROM flows GROUP BY ALL) SELECT src_as, string_agg(etype || ':' || b || ':' || p || ':' || n, ',' ORDER BY etype) AS etype_map FROM r GROUP BY 1")
def etype_map_sum(spark, sf_dir):
    """Map columns of many rollup rows summed by key."""
    f = flows(spark, sf_dir).withColumn("src_as", F.col("src_as") % 50)
    summed = analytics.sum_maps(analytics.rollup_by_etype(analytics.rollup(f)), ["src_as"])
    return summed.withColumn("etype_map", F.array_join(F.transform("etype_map", lambda e: F.concat_ws(":", e["etype"], e["bytes"], e["packets"], e["count"])), ","))


def little(n: int) -> Column:
    return values.reverse_bytes(F.unhex(F.lpad(F.hex(F.col("event_id") * 1048573), 2 * n, "0")))


@query(
    """SELECT event_id, event_id * 1048573 AS le8, (event_id * 1048573) % 4294967296 AS le4, (event_id * 1048573) % 65536 - CASE WHEN (event_id * 1048573) % 65536 >= 32768 THEN 65536 ELSE 0 END AS be_signed,
    (event_id * 1048573) % 65536 - CASE WHEN (event_id * 1048573) % 65536 >= 32768 THEN 65536 ELSE 0 END AS le_signed, (event_id * 1048573) % 256 = 0 AS zero, (event_id * 1048573) % 16777216 AS odd FROM events"""
)
def number_codecs(spark, sf_dir):
    """Little- and big-endian numbers, signed and not, of several widths."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    big = F.unhex(F.lpad(F.hex(F.col("event_id") * 1048573), 16, "0"))
    two = F.substring(big, 7, 2)
    return e.select(
        "event_id", values.uint_le(little(8)).alias("le8"), values.uint_le(little(8), 32).alias("le4"), values.int_be(two).alias("be_signed"), values.int_le(values.reverse_bytes(two)).alias("le_signed"),
        values.all_zeros(F.substring(big, 8, 1)).alias("zero"), values.int_be(F.substring(big, 6, 3)).alias("odd"),
    )


@query(WITH + f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {ip_sql('src')} WHEN event_id % 3 = 1 THEN {ip_sql('dst')} ELSE '0.0.0.0' END AS kept FROM flows")
def address_guard(spark, sf_dir):
    """A new address replaces the old unless it is all zeros and the old is set."""
    i, zeros = F.col("event_id"), F.lit(bytes(4))
    old = F.when(i % 3 == 2, F.lit(b"")).otherwise(F.col("src_addr"))
    new = F.when(i % 3 == 1, F.col("dst_addr")).otherwise(zeros)
    return flows(spark, sf_dir).select("event_id", render.ip(values.replace_address(old, new)).alias("kept"))


@query("SELECT event_id, (9 + event_id % 2) || '/' || event_id % 4294967296 || '/' || (256 + event_id % 1000) AS key_text, 9 + event_id % 2 AS version, event_id % 4294967296 AS domain, 256 + event_id % 1000 AS template_id, ((9 + event_id % 2) << 48) + (event_id % 4294967296 << 16) + 256 + event_id % 1000 AS packed FROM events")
def template_keys(spark, sf_dir):
    i = F.col("event_id")
    packed = values.template_key(9 + i % 2, i % 2**32, 256 + i % 1000)
    back = values.parse_template_key(values.template_key_text(packed))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(i, packed.alias("packed"), values.template_key_text(packed).alias("key_text"), back.alias("k"))
    return e.select("event_id", "packed", "key_text", F.col("k.version").alias("version"), F.col("k.obs_domain_id").alias("domain"), F.col("k.template_id").alias("template_id"))


@query("SELECT event_id, strftime(make_timestamp((1500000000 + event_id * 7919) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, event_id AS raw FROM events")
def render_datetime(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", render.RENDERERS["datetime"](F.lit(1500000000) + F.col("event_id") * 7919).alias("at"), render.RENDERERS["none"](F.col("event_id")).alias("raw"))


@query(WITH + f"SELECT event_id, bytes, {_case('etype', names.ETYPES)} AS etype, {PROTO_NAME} AS proto, {MAC_SQL} AS src_mac, {ip_sql('src')} AS src_addr FROM flows")
def json_ingest(spark, sf_dir):
    """Flow JSON as a log collector gets it, parsed again."""
    fmt = serialize.Format(fields=("bytes", "etype", "proto", "src_mac", "src_addr"))
    f = flows(spark, sf_dir)
    lines = f.select("event_id", serialize.to_json(f, fmt).alias("value"))
    parsed = lines.select("event_id", F.from_json("value", files.rendered_schema()).alias("flow"))
    return parsed.select("event_id", "flow.bytes", "flow.etype", "flow.proto", "flow.src_mac", "flow.src_addr")


@query(WITH + f"""SELECT 'etype=' || {_case('etype', names.ETYPES)} || ' bytes=' || bytes AS "value" FROM flows""")
def formatted_text(spark, sf_dir):
    """The registered text format with its key, as a sink gets it."""
    rows = pipelines.formatted(flows(spark, sf_dir), "text", serialize.Format(fields=("etype", "bytes"), key=("src_as",)))
    return rows.filter("length(key) = 4").select("value")


def scratch_folder(spark: SparkSession) -> str:
    return f"{root(spark)}/flowspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


@query(WITH + f"SELECT {PROTO_CASE} AS name, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY 1")
def csv_dictionary(spark, sf_dir):
    """Protocol names from a CSV dictionary."""
    folder = f"{scratch_folder(spark)}/protocols"
    spark.createDataFrame([(k, v, f"{v}, described") for k, v in sorted(DICTIONARY.items())], "proto long, name string, description string").coalesce(1).write.csv(folder, header=True)
    named = analytics.protocol_names(flows(spark, sf_dir).groupBy("proto").agg(F.count("*").alias("n")), files.protocols(spark, folder))
    return named.select(F.when(F.col("proto_name") == "", F.col("proto").cast("string")).otherwise(F.col("proto_name")).alias("name"), "n")


@query("SELECT * FROM (VALUES ('sflow', '', 6343, 2, 4, false, 9), ('netflow', '::1', 2055, 1, 3, true, 0)) t(scheme, host, port, sockets, workers, blocking, queue)")
def listen_addresses(spark, sf_dir):
    found = listen.parse_listeners("sflow://:6343?count=2&queue_size=9,netflow://[::1]:2055?blocking=true&workers=3")
    return spark.createDataFrame([(x.scheme, x.host, x.port, x.sockets, x.workers, x.blocking, x.queue) for x in found], "scheme string, host string, port int, sockets int, workers int, blocking boolean, queue int")


def ran(spark: SparkSession, rows: DataFrame, make, writer) -> DataFrame:
    """What a stream over written rows leaves: make turns the stream into rows, writer gives its sink."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", engine.SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    folder = scratch_folder(spark)
    rows.write.parquet(f"{folder}/in")
    stream = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    writer(stream, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def to_parquet(rows: DataFrame, path: str, checkpoint: str):
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


@query(ORACLES["v9_asof_templates"])
def stream_v9(spark, sf_dir):
    """Templates and sampling rates as state of a stream; the same flows as in batch."""
    f = ran(spark, as_v9(flows(spark, sf_dir)), stateful.netflow_stream, to_parquet).filter("error IS NULL")
    return flow_digest(f).drop("ip_tos", "tcp_flags", "src_net", "dst_net")


@query(_EXPORTER_SQL + f"SELECT '10.255.0.' || g % {EXPORTERS} AS sampler, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM d GROUP BY 1")
def stream_preloaded(spark, sf_dir):
    """Templates known beforehand serve until the exporters bring their own: no datagram is lost."""
    known = json.dumps({"kind": "template", "scopes": [], "fields": [{"pen_provided": False, "type": k, "length": n, "pen": 0} for k, n in LAYOUT_A]})
    preload = {f"10.255.0.{e}": {"9/256/260": known} for e in range(EXPORTERS)}
    f = ran(spark, as_v9(flows(spark, sf_dir)), lambda d: stateful.netflow_stream(d, preload=preload), to_parquet).filter("error IS NULL")
    return f.groupBy(render.ip(F.col("sampler_address")).alias("sampler")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(WITH + "SELECT strftime(make_timestamp(time_received_ns // 1000), '%Y.%m.%d') AS day, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY 1")
def stream_daily_index(spark, sf_dir):
    """Flow documents in a folder a day."""
    f = flows(spark, sf_dir).select("time_received_ns", "bytes")
    folder = scratch_folder(spark)
    f.write.parquet(f"{folder}/in")
    pipelines.sent(spark.readStream.schema(f.schema).parquet(f"{folder}/in"), "daily_index", f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.json(f"{folder}/out", schema="time_received_ns long, bytes long, day string").groupBy("day").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(WITH + "SELECT CAST(make_timestamp(time_received_ns // 1000) AS DATE) AS date, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY 1")
def stream_raw_table(spark, sf_dir):
    f = ran(spark, flows(spark, sf_dir), lambda d: d, pipelines.to_raw_table)
    return f.groupBy("date").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
