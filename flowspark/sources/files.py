"""Files: delimited protobuf, flow JSON, protocol dictionaries, networks, templates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.serialize import Extension, from_protobuf
from ..operators.raw import readable
from ..schema import FLOW_SCHEMA


#: Kafka options by the names that configurations use.
KAFKA = {
    "brokers": "kafka.bootstrap.servers", "max_message_bytes": "kafka.max.request.size", "compression": "kafka.compression.type", "security": "kafka.security.protocol",
    "sasl": "kafka.sasl.mechanism", "jaas": "kafka.sasl.jaas.config", "linger_ms": "kafka.linger.ms", "group": "kafka.group.id", "per_trigger": "maxOffsetsPerTrigger",
    "truststore": "kafka.ssl.truststore.location", "truststore_password": "kafka.ssl.truststore.password",
}


def kafka_options(options: dict[str, str]) -> dict[str, str]:
    """Spark's options of ours; user and password become the login of a SCRAM or plain mechanism."""
    options = dict(options)
    user, password = options.pop("user", None), options.pop("password", None)
    if unknown := sorted(set(options) - set(KAFKA)):
        raise ValueError(f"no Kafka options {unknown}; there are {sorted([*KAFKA, 'password', 'user'])}")
    if user is not None:
        mechanism = options.setdefault("sasl", "SCRAM-SHA-512")
        options.setdefault("security", "SASL_SSL")
        module = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
        quoted = lambda x: '"' + (x or "").replace("\\", "\\\\").replace('"', '\\"') + '"'
        options["jaas"] = f"org.apache.kafka.common.security.{module} required username={quoted(user)} password={quoted(password)};"
    return {KAFKA[name]: str(value) for name, value in options.items()}


def delimited(spark: SparkSession, path: str, extensions: tuple[Extension, ...] = ()) -> DataFrame:
    """Flows of files of length-delimited messages; a file is one task's."""
    return from_protobuf(spark.read.format("binaryFile").load(path).select("content"), "content", extensions)


def json_stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Flow JSON lines that files bring, as a column `flow` and its text; lines that do not parse have a null flow."""
    lines = spark.readStream.text(path)
    return lines.select("value", F.from_json("value", schema or rendered_schema()).alias("flow"))


def rendered_schema() -> str:
    """The schema of flow JSON: rendered columns are texts."""
    text = {"type", "src_mac", "dst_mac", "src_addr", "dst_addr", "sampler_address", "next_hop", "bgp_next_hop", "etype", "proto", "src_net", "dst_net"}
    lists = {"mpls_ip", "layer_stack", "ipv6_routing_header_addresses"}
    return ", ".join(f"`{f.name}` {'string' if f.name in text else 'array<string>' if f.name in lists else f.dataType.simpleString()}" for f in FLOW_SCHEMA)


def kafka_flows(spark: SparkSession, topic: str, extensions: tuple[Extension, ...] = (), starting: str = "latest", stream: bool = True, **options: str) -> DataFrame:
    """Flows of a Kafka topic whose values are length-delimited messages, as a stream or a batch of what the topic holds.

    options: brokers and the like, by the names of streaming.pipelines.KAFKA.
    Needs Spark's Kafka connector on the class path.
    """
    return from_protobuf(kafka(spark, topic, starting, stream, **options).select("value"), "value", extensions)


def kafka(spark: SparkSession, topic: str, starting: str = "latest", stream: bool = True, **options: str) -> DataFrame:
    """key, value, partition, offset and timestamp of a topic."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("subscribe", topic)
    reader = reader.option("startingOffsets", starting if stream or starting != "latest" else "earliest")
    for name, value in kafka_options(options).items():
        reader = reader.option(name, value)
    return reader.load()


def protocols(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary (proto, name, description) from CSV with a header."""
    return spark.read.csv(path, header=True, schema="proto long, name string, description string")


def networks(spark: SparkSession, path: str, value: str) -> DataFrame:
    """cidr and a value column (asn long, country string) from CSV with a header."""
    kind = "long" if value == "asn" else "string"
    return spark.read.csv(path, header=True, schema=f"cidr string, {value} {kind}")


def preload_templates(path: str) -> dict[str, dict[str, str]]:
    """Templates by source, then key, from JSON {source: {"version/domain/id": template}}; any fault and nothing is taken.

    A template with "scope-length" is a version 9 options template, one with
    "scope-field-count" an IPFIX one, any other a data template.
    """
    with open(path) as f:
        raw = json.load(f)
    out: dict[str, dict[str, str]] = {}
    for source, templates in raw.items():
        for key, t in templates.items():
            version, domain, number = (int(x) for x in key.split("/"))
            if version not in (9, 10):
                raise ValueError(f"{source} {key}: version {version}")
            options = "scope-length" in t or "scope-field-count" in t
            fields = [field_of(x) for x in t.get("options" if options else "fields") or []]
            scopes = [field_of(x) for x in t.get("scopes") or []] if options else []
            if not fields and not scopes:
                raise ValueError(f"{source} {key}: no fields")
            text = json.dumps({"kind": "options" if options else "template", "scopes": scopes, "fields": fields})
            out.setdefault(source, {})[f"{version}/{domain}/{number}"] = text
    return out


def field_of(x: dict) -> dict:
    return {"pen_provided": bool(x.get("pen-provided")), "type": int(x["type"]), "length": int(x["length"]), "pen": int(x.get("pen") or 0)}


def template_json(number: int, version: int, t: dict) -> dict:
    """A template of the state in the form that preload_templates() reads."""
    fields = [{"type": f["type"], "length": f["length"]} | ({"pen-provided": True, "pen": f["pen"]} if f["pen_provided"] else {}) for f in t["fields"]]
    if t["kind"] == "template":
        return {"template-id": number, "fields": fields}
    scopes = [{"type": f["type"], "length": f["length"]} | ({"pen-provided": True, "pen": f["pen"]} if f["pen_provided"] else {}) for f in t["scopes"]]
    sizes = {"scope-length": 4 * len(scopes), "option-length": 4 * len(fields)} if version == 9 else {"field-count": len(scopes) + len(fields), "scope-field-count": len(scopes)}
    return {"template-id": number, **sizes, "scopes": scopes, "options": fields}


def export_templates(table: DataFrame, path: str) -> int:
    """Templates of the state store as JSON by source and key, renamed into place; how many.

    preload_templates() reads the file.  Sources without templates are left out.
    There are as many templates as exporters know, not as flows.
    """
    import os
    import tempfile

    out: dict[str, dict] = {}
    for r in table.toLocalIterator():
        version, _, number = (int(x) for x in r["key"].split("/"))
        out.setdefault(readable(bytes(r["source"])), {})[r["key"]] = template_json(number, version, json.loads(r["template"]))
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        json.dump(out, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)
    return sum(map(len, out.values()))
