"""Streaming tables and sinks over flow streams."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import serialize
from ..functions.values import partition_key, timestamp_of_ns
from ..operators import analytics
from ..sources.files import kafka_options


def good(flows: DataFrame) -> DataFrame:
    return flows.filter("error IS NULL").drop("error")


def dead_letters(flows: DataFrame) -> DataFrame:
    return flows.filter("error IS NOT NULL").select("time_received_ns", "sampler_address", "type", "error")


def rollup_stream(flows: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """The five-minute rollup with a watermark: each slot comes out once, when rows later than `late` no longer count."""
    stamped = flows.withColumn("ts", timestamp_of_ns(F.col("time_received_ns"))).withWatermark("ts", late)
    sums = stamped.groupBy(F.window("ts", window).alias("w"), "src_as", "dst_as", "etype").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("count"))
    return sums.select(F.to_date("w.start").alias("date"), F.col("w.start").alias("timeslot"), "src_as", "dst_as", "etype", "bytes", "packets", "count")


def deduplicated(flows: DataFrame, keys: Sequence[str] = ("sampler_address", "sequence_num"), late: str = "10 minutes") -> DataFrame:
    stamped = flows.withColumn("ts", timestamp_of_ns(F.col("time_received_ns"))).withWatermark("ts", late)
    return stamped.dropDuplicatesWithinWatermark(list(keys)).drop("ts")


Formatter = Callable[[DataFrame, serialize.Format, Sequence[serialize.Extension]], DataFrame]
Transport = Callable[..., DataStreamWriter]
FORMATS: dict[str, Formatter] = {}
TRANSPORTS: dict[str, Transport] = {}


def register_format(name: str, formatter: Formatter) -> Formatter:
    """formatter: flows, format and extensions to rows of key and value.  A name is taken once."""
    if name in FORMATS:
        raise ValueError(f"the format {name} exists")
    FORMATS[name] = formatter
    return formatter


def register_transport(name: str, transport: Transport) -> Transport:
    """transport: rows of key and value, place and checkpoint to a stream writer.  A name is taken once."""
    if name in TRANSPORTS:
        raise ValueError(f"the transport {name} exists")
    TRANSPORTS[name] = transport
    return transport


def formatted(flows: DataFrame, kind: str = "json", fmt: serialize.Format | None = None, extensions: Sequence[serialize.Extension] = ()) -> DataFrame:
    """key and value of each flow in a registered format: json, text, bin (length-delimited messages) or one's own."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}; there are {sorted(FORMATS)}")
    return FORMATS[kind](flows, fmt or serialize.Format(), extensions)


def sent(rows: DataFrame, transport: str, place: str, checkpoint: str, **options: str) -> DataStreamWriter:
    """A stream writer of a registered transport."""
    if transport not in TRANSPORTS:
        raise ValueError(f"no transport {transport}; there are {sorted(TRANSPORTS)}")
    return TRANSPORTS[transport](rows, place, checkpoint, **options)


def _keyed(value: Callable[[DataFrame, serialize.Format], Column]) -> Formatter:
    def run(flows: DataFrame, fmt: serialize.Format, extensions: Sequence[serialize.Extension]) -> DataFrame:
        key = partition_key([(n, flows.schema[n].dataType.simpleString()) for n in fmt.key])
        return flows.select(key.alias("key"), value(flows, fmt).alias("value"))

    return run


register_format("json", _keyed(serialize.to_json))
register_format("text", _keyed(serialize.to_text))
register_format("bin", lambda flows, fmt, extensions: serialize.to_protobuf(flows, extensions).select(F.lit(None).cast("binary").alias("key"), F.col("message").alias("value")))


def to_files(rows: DataFrame, path: str, checkpoint: str, separator: str = "\n") -> DataStreamWriter:
    """Values as text files, one value a line; another separator joins the values of a file."""
    lines = rows.select(F.col("value").cast("string").alias("value"))
    return lines.writeStream.format("text").option("path", path).option("lineSep", separator or "\n").option("checkpointLocation", checkpoint)


def to_kafka(rows: DataFrame, topic: str, checkpoint: str, **options: str) -> DataStreamWriter:
    """Keys and values to Kafka; rows with equal keys go to one partition.  Needs Spark's Kafka connector on the class path."""
    w = rows.writeStream.format("kafka").option("topic", topic).option("checkpointLocation", checkpoint)
    for name, value in kafka_options(options).items():
        w = w.option(name, value)
    return w


def to_stdout(rows: DataFrame, path: str, checkpoint: str, separator: str = "\n") -> DataStreamWriter:
    """Values to the driver's standard output, each followed by the separator, which may be empty."""

    def write(batch: DataFrame, _: int) -> None:
        for r in batch.select(F.col("value").cast("binary").alias("value")).toLocalIterator():  # a partition at a time
            sys.stdout.buffer.write(bytes(r["value"]) + separator.encode())
        sys.stdout.buffer.flush()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def to_raw_table(flows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Flows to the stored flow table, partitioned by date."""
    return analytics.raw_table(flows).writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)


def to_daily_index(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """JSON values with time_received_ns, one folder a day."""
    day = F.date_format(timestamp_of_ns(F.col("time_received_ns")), "yyyy.MM.dd")
    return rows.withColumn("day", day).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)


for _name, _transport in {"file": to_files, "stdout": to_stdout, "kafka": to_kafka, "raw_table": to_raw_table, "daily_index": to_daily_index}.items():
    register_transport(_name, _transport)
