"""UDP datagrams as a stream.

UDP cannot be replayed, so a receiver first logs datagrams to Parquet files in a
shared folder (``receive``), which the file stream then reads exactly once
(``logged``).  ``register`` adds the source ``udp``, which reads a socket of the
driver directly, at most once, for trials.
"""

from __future__ import annotations

import contextlib
import queue
import socket
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schema import DATAGRAM_SCHEMA
from .listen import Listener

LONGEST = 9000  # bytes of a datagram


class Receiver:
    """Sockets of one listener and their queue.  A full queue drops and counts datagrams, or, when blocking, makes sockets wait."""

    def __init__(self, listener: Listener):
        self.listener = listener
        self.queue: queue.Queue = queue.Queue(listener.queue)
        self.dropped = self.received = 0
        self.lost: dict[tuple[bytes, bytes, int], list[int]] = {}  # source address, own address and port -> packets, bytes
        self._stop, self._threads, self._sockets = threading.Event(), [], []

    def start(self) -> int:
        """Opens the sockets; the port they listen at."""
        port = self.listener.port
        for _ in range(self.listener.sockets):
            s = socket.socket(socket.AF_INET6 if ":" in self.listener.host else socket.AF_INET, socket.SOCK_DGRAM)
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEPORT, 1)
            s.settimeout(0.2)
            s.bind((self.listener.host, port))
            port = s.getsockname()[1]
            self._sockets.append(s)
            self._threads.append(threading.Thread(target=self._receive, args=(s,), daemon=True))
        for t in self._threads:
            t.start()
        return port

    def _receive(self, s: socket.socket) -> None:
        at = s.getsockname()
        while not self._stop.is_set():
            try:
                data, source = s.recvfrom(LONGEST)
            except TimeoutError:
                continue
            except OSError:
                return
            row = (packed(source[0]), source[1], packed(at[0]), at[1], data, time.time_ns())
            try:
                self.queue.put(row, block=self.listener.blocking)
                self.received += 1
            except queue.Full:
                self.dropped += 1
                for k, n in enumerate((1, len(data))):
                    self.lost.setdefault((row[0], row[2], row[3]), [0, 0])[k] += n

    def drops(self, spark: SparkSession) -> DataFrame:
        """What was dropped so far, for operators.metrics.dropped: a row a source."""
        rows = [(*key, *n) for key, n in self.lost.copy().items()]
        return spark.createDataFrame(rows, "src_addr binary, dst_addr binary, dst_port int, packets long, bytes long")

    def drain(self, most: int = 100_000) -> list[tuple]:
        out = []
        with contextlib.suppress(queue.Empty):
            while len(out) < most:
                out.append(self.queue.get_nowait())
        return out

    def stop(self) -> list[tuple]:
        """Closes the sockets; what was still queued."""
        self._stop.set()
        for t in self._threads:
            t.join()
        for s in self._sockets:
            s.close()
        return self.drain(self.queue.qsize())


def packed(host: str) -> bytes:
    return socket.inet_pton(socket.AF_INET6 if ":" in host else socket.AF_INET, host.split("%")[0])


def receive(receiver: Receiver, folder: str, seconds: float, every: float = 1.0) -> int:
    """Logs what a receiver gets for some seconds to Parquet files in folder, each renamed into place; the datagrams logged."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    schema = pa.schema([("src_addr", pa.binary()), ("src_port", pa.int32()), ("dst_addr", pa.binary()), ("dst_port", pa.int32()), ("payload", pa.binary()), ("received_ns", pa.int64()), ("seq", pa.int64())])
    end, n = time.monotonic() + seconds, 0
    while True:
        rows = receiver.drain()
        if rows:
            columns = [*zip(*rows, strict=True), range(n, n + len(rows))]
            table = pa.table([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema)
            name = f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.parquet"
            with filesystem.open_output_stream(f"{name}.tmp") as f:
                pq.write_table(table, f)
            filesystem.move(f"{name}.tmp", name)
            n += len(rows)
        if time.monotonic() >= end:
            return n
        time.sleep(min(every, max(0.0, end - time.monotonic())))


def logged(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of a folder of logged datagrams."""
    return spark.readStream.schema(DATAGRAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class UdpReader(SimpleDataSourceStreamReader):
    """Reads a socket that opens in the process that first asks for offsets; the reader itself travels as options."""

    def __init__(self, options):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options.get("port", "2055"))
        self.receiver: Receiver | None = None
        self.held: dict[int, list[tuple]] = {}

    def _rows(self) -> list[tuple]:
        if self.receiver is None:
            self.receiver = Receiver(Listener("flow", self.host, self.port))
            self.receiver.start()
        return self.receiver.drain()

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [(*r, start["n"] + i) for i, r in enumerate(self._rows())]
        if rows:
            self.held[start["n"]] = rows
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for k in sorted(self.held) for r in self.held[k] if start["n"] <= r[-1] < end["n"]])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if v[-1][-1] >= end["n"]}


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self):
        return DATAGRAM_SCHEMA

    def simpleStreamReader(self, schema):
        return UdpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpSource)
