"""The traffic queries: rollups, top talkers and ports, zero-filled series, raw-table projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions.values import bucket_of_ns, floor_div, timestamp_of_ns

FIVE_MINUTES = 300


def scaled_bytes() -> Column:
    return F.sum(F.col("bytes") * F.col("sampling_rate")).alias("sumbytes")


def in_range(flows: DataFrame, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """The time filter; it reaches the scan of a stored flow table."""
    if from_ns is not None:
        flows = flows.filter(F.col("time_received_ns") >= from_ns)
    return flows if to_ns is None else flows.filter(F.col("time_received_ns") < to_ns)


def top_ips(flows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Traffic by address, most first.  Addresses are summed as bytes; only the groups are rendered."""
    sums = flows.groupBy(column).agg(scaled_bytes())
    out = sums.select(render.ip(F.col(column)).alias("ip"), "sumbytes").orderBy(F.desc("sumbytes"), "ip")
    return out if limit is None else out.limit(limit)


def protocol_names(flows: DataFrame, protocols: DataFrame) -> DataFrame:
    """flows with proto_name, empty where the dictionary (proto, name) has none.  Protocols are numbers below 256: the dictionary is cut to them and small."""
    known = protocols.filter(F.col("proto").between(0, 255)).groupBy("proto").agg(F.min("name").alias("proto_name"))
    return flows.join(F.broadcast(known), "proto", "left").withColumn("proto_name", F.coalesce("proto_name", F.lit("")))


def top_ports(flows: DataFrame, column: str, protocols: DataFrame, limit: int | None = None) -> DataFrame:
    sums = protocol_names(flows.groupBy("proto", column).agg(scaled_bytes()), protocols)
    name = F.when(F.col("proto_name") == "", F.col("proto").cast("string")).otherwise(F.col("proto_name"))
    labelled = sums.select(F.concat(name, F.lit("/"), F.col(column).cast("string")).alias("port"), "sumbytes")
    out = labelled.groupBy("port").agg(F.sum("sumbytes").alias("sumbytes")).orderBy(F.desc("sumbytes"), "port")
    return out if limit is None else out.limit(limit)


def timeseries(flows: DataFrame, from_s: int, to_s: int, step_s: int) -> DataFrame:
    """Traffic by step, in ms; steps without traffic are zero."""
    spark = flows.sparkSession
    ms = lambda c: floor_div(c, step_s) * step_s * 1000
    sums = in_range(flows, from_s * 10**9, to_s * 10**9).groupBy(ms(floor_div(F.col("time_received_ns"), 10**9)).alias("t")).agg(scaled_bytes())
    zeros = spark.range((to_s - from_s) // step_s).select(ms(F.lit(from_s) + F.col("id") * step_s).alias("t"), F.lit(0).cast("long").alias("sumbytes"))
    return sums.unionByName(zeros).groupBy("t").agg(F.sum("sumbytes").alias("sumbytes")).orderBy("t")


def raw_table(flows: DataFrame, inserted: Column | None = None) -> DataFrame:
    """The stored flow table: date, insertion time and the columns that the queries use."""
    names = ("sequence_num", "sampling_rate", "sampler_address", "src_addr", "dst_addr", "src_as", "dst_as", "etype", "proto", "src_port", "dst_port", "bytes", "packets")
    stamp = timestamp_of_ns(F.col("time_received_ns"))
    return flows.select(F.to_date(stamp).alias("date"), (inserted if inserted is not None else F.current_timestamp()).alias("time_inserted"), "time_received_ns", "time_flow_start_ns", *names)


def write_raw(flows: DataFrame, path: str) -> None:
    """Appends to the table, by date, sorted by time within files; one shuffle by date and hour keeps the files few and the dates split."""
    rows = raw_table(flows)
    hour = bucket_of_ns(F.col("time_received_ns"), 3600)
    rows.repartition("date", hour).sortWithinPartitions("time_received_ns").write.mode("append").partitionBy("date").parquet(path)


def rollup(flows: DataFrame, seconds: int = FIVE_MINUTES) -> DataFrame:
    """date, timeslot, src_as, dst_as, etype with sums of bytes and packets and a count."""
    slot = timestamp_of_ns(bucket_of_ns(F.col("time_received_ns"), seconds))
    keys = [F.to_date(slot).alias("date"), slot.alias("timeslot"), "src_as", "dst_as", "etype"]
    return flows.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("count"))


def merge_rollups(parts: DataFrame) -> DataFrame:
    """Partial rollups (several files or batches) summed by key."""
    return parts.groupBy("date", "timeslot", "src_as", "dst_as", "etype").agg(*[F.sum(c).alias(c) for c in ("bytes", "packets", "count")])


def rollup_by_etype(rolled: DataFrame) -> DataFrame:
    """Per slot and AS pair the sums, and etype_map: sums by ethertype."""
    entry = F.struct("etype", "bytes", "packets", "count")
    return rolled.groupBy("date", "timeslot", "src_as", "dst_as").agg(
        F.sort_array(F.collect_list(entry)).alias("etype_map"), *[F.sum(c).alias(c) for c in ("bytes", "packets", "count")]
    )


def sum_maps(rows: DataFrame, keys: list[str], column: str = "etype_map") -> DataFrame:
    """Map columns summed by key, as a summing merge does."""
    e = rows.select(*keys, F.explode(column).alias("e")).groupBy(*keys, F.col("e.etype").alias("etype"))
    e = e.agg(*[F.sum(f"e.{c}").alias(c) for c in ("bytes", "packets", "count")])
    return e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("etype", "bytes", "packets", "count"))).alias(column))


def previous(rows: DataFrame, keys: Sequence[str], ns: str, order: Sequence[str], value: str, out: str, seconds: int = 60) -> DataFrame:
    """rows with out: the value of the key's row before, by ns and order; null for the first.

    A key may hold a third of all rows, so no window spans a key's rows: they
    are ordered within a stretch of time, and only the last row of each stretch
    is handed on to the first of the key's next one.
    """
    slot = floor_div(F.col(ns), seconds * 10**9)
    within = Window.partitionBy(*keys, "_slot").orderBy(ns, *order)
    marked = rows.withColumn("_slot", slot).withColumn("_first", F.row_number().over(within) == 1).withColumn(out, F.lag(value).over(within))
    last = marked.groupBy(*keys, "_slot").agg(F.max_by(value, F.struct(ns, *order)).alias("_last"))
    handed = last.withColumn("_handed", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slot"))).drop("_last")
    names = [*keys, "_slot"]
    handed = handed.select(*[F.col(k).alias(f"_of_{k}") for k in names], "_handed")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names]
    joined = marked.join(handed, same).drop(*[f"_of_{k}" for k in names])
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_handed")).otherwise(F.col(out))).drop("_slot", "_first", "_handed")
