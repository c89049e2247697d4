"""Sessions, options, and the assembly of a collecting job; status over HTTP; the command line."""

from __future__ import annotations

import argparse
import http.server
import json
import logging
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, raw, sflow
from ..operators.mapping import Mapping, load_mapping
from ..sources import files, udp
from ..streaming import pipelines, stateful

log = logging.getLogger("flowspark")

#: Session settings that the plans here count on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "flowspark", master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


Producer = Callable[..., DataFrame]
PRODUCERS: dict[str, Producer] = {}


def register_producer(name: str, producer: Producer) -> Producer:
    """producer: datagrams, a mapping and options to rows.  A name is taken once."""
    if name in PRODUCERS:
        raise ValueError(f"the producer {name} exists")
    PRODUCERS[name] = producer
    return producer


register_producer("sample", stateful.flows)
register_producer("raw", lambda datagrams, mapping=None, **_: raw.messages(datagrams))

#: Steps between the datagrams and the producer, in order: each takes and returns datagrams (a filter, a count, a copy to a log).
Wrapper = Callable[[DataFrame], DataFrame]


def produce(datagrams: DataFrame, producer: str = "sample", mapping: Mapping | None = None, **options) -> DataFrame:
    if producer not in PRODUCERS:
        raise ValueError(f"no producer {producer}; there are {sorted(PRODUCERS)}")
    return PRODUCERS[producer](datagrams, mapping=mapping, **options)


class Job:
    """A collecting job: logged datagrams to flows to a sink.

    transport: file, stdout, kafka (out is the topic) or a registered one.
    wrappers: steps that the datagrams pass first.  export: a file that the known
    templates are written to every export_s seconds and at the end, in the form
    that preload (among the options) reads.  Faults are logged, at most
    `most_errors` of a kind in mute_s seconds, with how many were left out.
    """

    def __init__(
        self, spark: SparkSession, folder: str, out: str, checkpoint: str, producer: str = "sample", fmt: str = "json", mapping: Mapping | None = None, trigger: str | None = "5 seconds",
        transport: str = "file", wrappers: Sequence[Wrapper] = (), export: str | None = None, export_s: float = 10, mute_s: int = 10, most_errors: int = 10, **options,
    ):
        self.spark, self.folder, self.out, self.checkpoint = spark, folder.rstrip("/"), out.rstrip("/"), checkpoint.rstrip("/")
        self.producer, self.fmt, self.mapping, self.trigger, self.options = producer, fmt, mapping or Mapping(), trigger, options
        self.transport, self.wrappers, self.export, self.export_s = transport, wrappers, export, export_s
        self.mute_s, self.most_errors = mute_s, most_errors
        self.queries: list[StreamingQuery] = []
        self.stopping = threading.Event()
        self.exporter: threading.Thread | None = None

    def _start(self, writer, name: str) -> None:
        writer = writer.queryName(name)
        writer = writer.trigger(processingTime=self.trigger) if self.trigger else writer.trigger(availableNow=True)
        self.queries.append(writer.start())

    def _report(self, batch: DataFrame, number: int) -> None:
        """Logs the dead letters of a batch, muted by kind and interval."""
        shown, left = metrics.muted(batch, ["error"], "time_received_ns", self.mute_s, self.most_errors)
        for r in shown.toLocalIterator():  # at most most_errors a kind and interval
            log.warning("%s: %s", raw.readable(bytes(r["sampler_address"] or b"")), r["error"])
        for r in left.filter("skipped > 0").toLocalIterator():
            log.warning("%s: %d more in %d s from %d on", r["error"], r["skipped"], self.mute_s, r["interval_s"])

    def _export_loop(self) -> None:
        done = False
        while not done:
            done = self.stopping.wait(self.export_s)
            try:
                files.export_templates(stateful.template_table(self.spark, f"{self.checkpoint}/flows"), self.export)
            except Exception as e:  # noqa: BLE001  no state yet, or a folder that cannot be written: the next round tries again
                log.debug("templates not written: %s", e)

    def start(self) -> Job:
        datagrams = udp.logged(self.spark, self.folder)
        for step in self.wrappers:
            datagrams = step(datagrams)
        rows = produce(datagrams, self.producer, self.mapping, **(self.options if self.producer == "sample" else {}))
        if self.producer == "raw":
            values = rows.filter("error IS NULL").selectExpr("CAST(NULL AS BINARY) AS key", "summary AS value" if self.fmt == "text" else "to_json(struct(type, from_json(message, 'map<string,string>') AS message, src, time_received)) AS value")
            self._start(pipelines.sent(values, self.transport, self.out, f"{self.checkpoint}/raw"), "raw")
        elif self.fmt == "table":
            self._start(pipelines.to_raw_table(pipelines.good(rows), self.out, f"{self.checkpoint}/flows"), "flows")
        else:
            values = pipelines.formatted(pipelines.good(rows), self.fmt, self.mapping.format, self.mapping.extensions)
            self._start(pipelines.sent(values, self.transport, self.out, f"{self.checkpoint}/flows"), "flows")
        if self.export:
            self.exporter = threading.Thread(target=self._export_loop, daemon=True)
            self.exporter.start()
        return self

    def report_errors(self) -> Job:
        """Starts a query of its own that logs the dead letters of stateless decoding (version 5 and sFlow) and of datagrams of no protocol."""
        datagrams = udp.logged(self.spark, self.folder)
        bad = pipelines.dead_letters(sflow.flows(datagrams, self.mapping)).select("time_received_ns", "sampler_address", "error")
        none = datagrams.filter(metrics.protocol(F.col("payload")) == "unknown").select(F.col("received_ns").alias("time_received_ns"), F.col("src_addr").alias("sampler_address"), F.lit("no protocol begins so").alias("error"))
        self._start(bad.unionByName(none).writeStream.foreachBatch(self._report).option("checkpointLocation", f"{self.checkpoint}/errors"), "errors")
        return self

    def active(self) -> bool:
        return bool(self.queries) and all(q.isActive for q in self.queries)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self._last_export()

    def wait(self) -> None:
        for q in self.queries:
            q.awaitTermination()
        self._last_export()

    def _last_export(self) -> None:
        self.stopping.set()
        if self.exporter:
            self.exporter.join()
            self.exporter = None

    def templates(self) -> dict[str, dict[str, dict]]:
        """source -> version/domain/id -> template, from the state of the last batch."""
        out: dict[str, dict[str, dict]] = {}
        for r in stateful.template_table(self.spark, f"{self.checkpoint}/flows").toLocalIterator():
            out.setdefault(raw.readable(bytes(r["source"])), {})[r["key"]] = json.loads(r["template"])
        return out

    def metrics(self) -> str:
        """Progress of the queries as Prometheus text."""
        lines = []
        for q in self.queries:
            p = q.lastProgress
            if p:
                for name, value in (("input_rows", p["numInputRows"]), ("batch", p["batchId"]), ("trigger_ms", p["durationMs"].get("triggerExecution", 0))):
                    lines.append(f'flowspark_{name}{{query="{q.name}"}} {value}')
            seconds = sorted(x["durationMs"].get("addBatch", 0) / 1000 for x in q.recentProgress)
            if seconds:
                for share in metrics.QUANTILES:
                    lines.append(f'flowspark_decode_seconds{{query="{q.name}",quantile="{share}"}} {seconds[min(len(seconds) - 1, int(share * len(seconds)))]}')
                lines += [f'flowspark_decode_seconds_sum{{query="{q.name}"}} {sum(seconds)}', f'flowspark_decode_seconds_count{{query="{q.name}"}} {len(seconds)}']
        return "\n".join(lines) + "\n"


def serve(job: Job, port: int = 8080) -> http.server.ThreadingHTTPServer:
    """/__health, /templates and /metrics of a job, on a thread of its own."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/__health":
                ok = job.active()
                self._say(200 if ok else 503, "OK\n" if ok else "Not OK\n")
            elif self.path == "/templates":
                try:
                    self._say(200, json.dumps(job.templates()))
                except Exception:  # noqa: BLE001  no state yet
                    self._say(404, "{}")
            elif self.path == "/metrics":
                self._say(200, job.metrics())
            else:
                self._say(404, "")

        def _say(self, code: int, text: str) -> None:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *args):
            logging.getLogger("flowspark").debug(*args)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowspark", description="Logged datagrams to flows.")
    p.add_argument("--datagrams", required=True, help="folder of logged datagrams")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--produce", default="sample", choices=sorted(PRODUCERS))
    p.add_argument("--format", default="json", choices=[*pipelines.FORMATS, "table"])
    p.add_argument("--mapping", help="YAML of custom columns")
    p.add_argument("--templates-ttl", type=int, default=0, help="seconds; 0: templates never expire")
    p.add_argument("--templates-extend", action="store_true", help="use renews a template")
    p.add_argument("--templates-preload", help="JSON of templates known beforehand, by source")
    p.add_argument("--templates-export", help="JSON file that the known templates are written to")
    p.add_argument("--templates-export-interval", type=float, default=10, help="seconds")
    p.add_argument("--templates-remove", action="append", default=[], metavar="SOURCE", help="forget what is known of this exporter; may be repeated")
    p.add_argument("--transport", default="file", help="file, stdout, kafka (--out is the topic) or a registered one")
    p.add_argument("--report-errors", action="store_true", help="log dead letters, muted")
    p.add_argument("--missing", default="packet", choices=("packet", "set"), help="what a missing template costs")
    p.add_argument("--once", action="store_true", help="end when the present datagrams are done")
    p.add_argument("--http", type=int, default=0, help="port of the status pages; 0: none")
    p.add_argument("--log", default="info", choices=("debug", "info", "warning", "error"))
    p.add_argument("--log-json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = options().parse_args(argv)
    line = '{"time":"%(asctime)s","level":"%(levelname)s","msg":"%(message)s"}' if a.log_json else "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level=a.log.upper(), format=line)
    job = Job(
        session(), a.datagrams, a.out, a.checkpoint, a.produce, a.format, load_mapping(a.mapping) if a.mapping else None, None if a.once else "5 seconds",
        a.transport, export=a.templates_export, export_s=a.templates_export_interval, ttl_s=a.templates_ttl, extend_on_access=a.templates_extend, drop=a.missing, remove=a.templates_remove,
        preload=files.preload_templates(a.templates_preload) if a.templates_preload else None,
    )
    job.start()
    if a.report_errors:
        job.report_errors()
    if a.http:
        serve(job, a.http)
    job.wait()
    return 0
