"""Operational metrics as aggregations over datagrams, sets, samples, flows and dead letters."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions.values import floor_div
from . import netflow
from .analytics import previous

#: The metrics, their labels and kinds.
METRICS = {
    "flow_traffic_packets": ("counter", ("remote_ip", "local_ip", "local_port", "type")),
    "flow_traffic_bytes": ("counter", ("remote_ip", "local_ip", "local_port", "type")),
    "flow_traffic_size_bytes": ("summary", ("remote_ip", "local_ip", "local_port", "type")),
    "receiver_dropped_packets": ("counter", ("remote_ip", "local_ip", "local_port")),
    "receiver_dropped_bytes": ("counter", ("remote_ip", "local_ip", "local_port")),
    "decoder_errors": ("counter", ("router", "error")),
    "decode_seconds": ("summary", ("name",)),
    "netflow_packets": ("counter", ("router", "version")),
    "netflow_flowsets": ("counter", ("router", "version", "type")),
    "netflow_records": ("counter", ("router", "version", "type")),
    "netflow_templates": ("gauge", ("router", "version", "domain", "template_id", "type")),
    "netflow_templates_added": ("counter", ("router", "version", "domain", "template_id")),
    "netflow_templates_removed": ("counter", ("router", "version", "domain", "template_id")),
    "netflow_template_updated_seconds": ("gauge", ("router", "version", "domain", "template_id")),
    "netflow_template_accessed_seconds": ("gauge", ("router", "version", "domain", "template_id")),
    "netflow_flow_delay_seconds": ("summary", ("router", "version")),
    "sflow_packets": ("counter", ("agent", "version")),
    "sflow_samples": ("counter", ("agent", "type")),
    "sflow_records": ("counter", ("agent", "type")),
}
QUANTILES = (0.5, 0.9, 0.99)
SHARES = 16


def summary(value: str) -> list[Column]:
    """Count, sum and the quantiles 0.5, 0.9 and 0.99, mergeable across partitions."""
    return [F.count(value).alias("count"), F.sum(value).alias("sum"), F.percentile_approx(value, list(QUANTILES), 10_000).alias("quantiles")]


def protocol(payload: Column) -> Column:
    """What a datagram is by its first bytes: sflow, netflow (5, 9, 10) or unknown."""
    head = F.hex(F.substring(payload, 1, 4))
    return F.when(head == "00000005", "sflow").when(F.substring(head, 1, 4).isin("0005", "0009", "000A"), "netflow").otherwise("unknown")


def traffic(datagrams: DataFrame) -> DataFrame:
    """Packets, bytes and sizes by source, destination and protocol."""
    keys = [render.ip(F.col("src_addr")).alias("remote_ip"), render.ip(F.col("dst_addr")).alias("local_ip"), F.col("dst_port").alias("local_port"), protocol(F.col("payload")).alias("type")]
    sized = datagrams.select(*keys, F.length("payload").cast("long").alias("size"))
    return sized.groupBy("remote_ip", "local_ip", "local_port", "type").agg(*summary("size"))


def flow_sets(sets: DataFrame) -> DataFrame:
    """Sets by router, version and kind."""
    return sets.filter("kind <> 'error'").groupBy(render.ip(F.col("src_addr")).alias("router"), "version", F.col("kind").alias("type")).agg(F.count("*").alias("n"))


def decoder_errors(dead: DataFrame) -> DataFrame:
    """Dead letters by router and error."""
    return dead.groupBy(render.ip(F.col("src_addr")).alias("router"), "error").agg(F.count("*").alias("n"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """sFlow samples and their records by agent and sample format."""
    kinds = F.element_at(F.create_map(*[F.lit(x) for p in {1: "FlowSample", 2: "CounterSample", 3: "ExpandedFlowSample", 4: "ExpandedCounterSample", 5: "DropSample"}.items() for x in p]), F.col("format"))
    return samples.filter("error IS NULL").groupBy(render.ip(F.col("agent")).alias("agent"), kinds.alias("type")).agg(F.count("*").alias("samples"), F.sum(F.size("formats")).alias("records"))


def template_times(rows: DataFrame) -> DataFrame:
    """When each template was first brought, last brought and last changed, and how often."""
    key = ["src_addr", "src_port", "version", "domain", "template_id"]
    t = rows.filter(F.col("kind").isin("template", "options"))
    return t.groupBy(*key).agg(F.min("received_ns").alias("added_ns"), F.max("received_ns").alias("updated_ns"), F.count("*").alias("adds"))


def flow_delay(flows: DataFrame) -> DataFrame:
    """Seconds from a flow's end to its receipt, by sampler; early clocks show as negative and are counted."""
    delay = (F.col("time_received_ns") - F.col("time_flow_end_ns")) / F.lit(1e9)
    return flows.select(render.ip(F.col("sampler_address")).alias("router"), delay.alias("delay")).groupBy("router").agg(*summary("delay"), F.count_if(F.col("delay") < 0).alias("early"))


def muted(events: DataFrame, keys: Sequence[str], ns: str = "received_ns", interval_s: int = 10, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the events let through, counts by key and interval): at most `most` events a key and interval pass, the earliest; 0 lets all pass.

    A key and interval may hold any number of events, so they are not ranked
    in one task: each is first ranked among those of its share of a hash, whose
    first ones alone can be among the first of all; the shares' survivors, at most
    SHARES * most, are ranked together.  Counts combine on the map side.
    """
    e = events.withColumn("_slot", floor_div(F.col(ns), interval_s * 10**9))
    counts = e.groupBy(*keys, "_slot").agg(F.count("*").alias("events"))
    skipped = F.greatest(F.col("events") - most, F.lit(0)) if most else F.lit(0).cast("long")
    counts = counts.select(*keys, (F.col("_slot") * interval_s).alias("interval_s"), "events", skipped.alias("skipped"))
    if not most:
        return events, counts
    whole = F.xxhash64(*[c for c, t in events.dtypes if not t.startswith("map")])
    e = e.withColumn("_tie", whole).withColumn("_share", F.pmod(F.col("_tie"), F.lit(SHARES)))
    for part in ([*keys, "_slot", "_share"], [*keys, "_slot"]):
        e = e.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy(ns, "_tie"))).filter(F.col("_rank") <= most)
    return e.drop("_slot", "_tie", "_share", "_rank"), counts


def netflow_packets(datagrams: DataFrame) -> DataFrame:
    """NetFlow and IPFIX datagrams by router and version."""
    version = F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("int")
    of = datagrams.filter(protocol(F.col("payload")) == "netflow")
    return of.groupBy(render.ip(F.col("src_addr")).alias("router"), version.alias("version")).agg(F.count("*").alias("n"))


def v5_records(datagrams: DataFrame) -> DataFrame:
    """Version 5 records by router, as the headers count them."""
    count = F.conv(F.hex(F.substring("payload", 3, 2)), 16, 10).cast("long")
    of = datagrams.filter(F.hex(F.substring("payload", 1, 2)) == "0005")
    return of.groupBy(render.ip(F.col("src_addr")).alias("router"), F.lit(5).alias("version"), F.lit("data").alias("type")).agg(F.sum(count).alias("n"))


def netflow_records(data: DataFrame) -> DataFrame:
    """Records by router, version and kind of template.  data: sets with their templates (netflow.with_templates).

    Fixed templates count by length; templates with fields of variable length by walking them.
    """
    fields = F.concat("template.scopes", "template.fields")
    size = F.aggregate(fields, F.lit(0).cast("long"), lambda n, f: n + f["length"])
    variable = F.exists(fields, lambda f: f["length"] == netflow.VARIABLE)
    fixed = F.when(size > 0, F.floor(F.length("body") / size)).otherwise(0).cast("long")
    known = data.filter("template IS NOT NULL")
    walk = F.pandas_udf(walked_records, "long")
    known = known.select("src_addr", "version", "template", "body", F.when(variable, F.to_json(fields)).alias("_layout"))
    n = F.when(F.col("_layout").isNull(), fixed).otherwise(walk("_layout", "body"))
    kind = F.when(F.col("template.kind") == "options", "options").otherwise("data")
    return known.groupBy(render.ip(F.col("src_addr")).alias("router"), "version", kind.alias("type")).agg(F.sum(n).alias("n"))


def walked_records(layouts: pd.Series, bodies: pd.Series) -> pd.Series:
    """Records of sets with templates of variable length; none where the layout is null."""
    known = {x: netflow._fields(json.loads(x)) for x in layouts.dropna().unique()}
    return pd.Series([sum(1 for _ in netflow.records(bytes(b), known[x])) if x else 0 for x, b in zip(layouts, bodies, strict=True)], dtype="int64")


def template_counts(data: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each template by exporter: when it was added, last updated, last used and withdrawn, and how often it was announced and withdrawn.

    rows: netflow.sets(); data: its data sets with templates.
    """
    key = ["src_addr", "src_port", "version", "domain", "template_id"]
    gone = (F.size("fields") + F.size("scopes")) == 0
    told = rows.filter(F.col("kind").isin("template", "options")).groupBy(*key).agg(
        F.min(F.when(~gone, F.col("received_ns"))).alias("added_ns"), F.max(F.when(~gone, F.col("received_ns"))).alias("updated_ns"), F.count_if(~gone).alias("adds"),
        F.max(F.when(gone, F.col("received_ns"))).alias("removed_ns"), F.count_if(gone).alias("removals"),
    )
    used = data.filter("template IS NOT NULL").groupBy(*key).agg(F.max("received_ns").alias("accessed_ns"))
    return told.join(used, key, "left")


def dropped(drops: DataFrame) -> DataFrame:
    """Packets and bytes that a receiver dropped, by source and listener.  drops: src_addr, dst_addr, dst_port, packets, bytes (sources.udp.Receiver.drops)."""
    keys = [render.ip(F.col("src_addr")).alias("remote_ip"), render.ip(F.col("dst_addr")).alias("local_ip"), F.col("dst_port").alias("local_port")]
    return drops.groupBy(*keys).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def sequence_gaps(datagrams: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Sequence numbers missing before each row, within a key."""
    return previous(datagrams, keys, "received_ns", [sequence], sequence, "_before").withColumn("gap", F.col(sequence) - F.col("_before") - 1).drop("_before")
