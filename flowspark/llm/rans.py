"""Token ids as binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all files.  Files hold
the documents in ascending doc_id order and follow each other in that order.  A
file is a run of independent blocks; each block interleaves many coder states
(lanes) that numpy steps together, and starts from states of its own.  The index
at the file's end holds a checkpoint for each block: its place, its first id's
number and its checksum, so blocks are read and decoded in parallel and a damaged
one is found before and after decoding.

File: MAGIC, table (length, zlib), blocks, index (zlib), index length, index crc32, MAGIC.
Block: HEAD, zlib(doc ids, null marks, lengths), lane states, words.

Encoding: ids are computed once, into a written table, beside the tasks' counts of
them; then the documents are dealt by doc_id ranges to tasks of bounded size, each
writing a file under a temporary name and renaming it, so that a task that runs
twice leaves one file.  Only one manifest row a file goes to the driver.

Defined results: a null text is an empty one; an empty text is its end id alone;
null doc_ids come first; rows of one doc_id stand next to each other, in the order
of a hash of their ids, and may fill several files; an empty table gives no file and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, id_back, id_text, materialize, scratch_path
from .tokenization import batches_of, vocabulary_path, worker_encoder

END = 1
SCALE, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK, PER_FILE, BLOCKS_A_TASK = 2048, 1 << 20, 1 << 24, 4
MAGIC = b"FLOWRANS"
HEAD = struct.Struct("<IQIIIQI")  # documents, ids, lanes, meta bytes, words, least doc_id, crc32 of the ids


@dataclass
class Table:
    """Frequencies of the symbols, summing to 2**SCALE."""

    frequency: np.ndarray
    start: np.ndarray
    symbol: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, room = int(counts.sum()), 1 << SCALE
        if np.count_nonzero(counts) > room:
            raise ValueError("more symbols than the table has room for")
        f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * room // max(1, total)), 0).astype(np.int64)
        excess = int(f.sum()) - room if total else 0
        for s in np.argsort(-f, kind="stable"):  # the most frequent symbols pay for the rare ones, or take what is left
            if not excess:
                break
            change = min(excess, int(f[s]) - 1) if excess > 0 else excess
            change = min(change, max(1, int(f[s]) // 2)) if excess > 0 else change
            f[s] -= change
            excess -= change
        return cls.of_frequencies(f)

    @classmethod
    def of_frequencies(cls, f: np.ndarray) -> Table:
        return cls(f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64))

    def decoder(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self.symbol

    def pack(self) -> bytes:
        return zlib.compress(self.frequency.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        return cls.of_frequencies(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane states, words): the ids, dealt to lanes in turn, are coded last to first."""
    x = np.full(lanes, LOW, np.uint64)
    f_all, c_all = table.frequency[ids], table.start[ids]
    limit, low, half, scale = np.uint64((int(LOW) >> SCALE) << 32), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    out = []
    for a in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, c = f_all[a : a + lanes], c_all[a : a + lanes]
        y = x[: len(f)]
        full = y >= f * limit
        if full.any():
            out.append((y[full] & low).astype("<u4"))
            y = np.where(full, y >> half, y)
        q = y // f
        x[: len(f)] = (q << scale) + (y - q * f) + c
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")


def decode(states: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    symbol, lanes, at = table.decoder(), len(states), 0
    x = states.astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, half, scale = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
    words = words.astype(np.uint64)
    for a in range(0, n, lanes):
        m = min(lanes, n - a)
        y = x[:m]
        slot = y & mask
        s = symbol[slot]
        out[a : a + m] = s
        y = table.frequency[s] * (y >> scale) + slot - table.start[s]
        empty = np.flatnonzero(y < LOW)
        if len(empty):
            y[empty] = (y[empty] << half) | words[at : at + len(empty)]
            at += len(empty)
        x[:m] = y
    return out


def pack_block(docs: list[tuple[int | None, bytes]], table: Table, width: str, lanes: int = LANES) -> bytes:
    """docs: (doc_id, ids of the given width), whole documents."""
    lengths = np.array([len(b) for _, b in docs], np.int64) // np.dtype(width).itemsize
    ids = np.frombuffer(b"".join([b for _, b in docs]), width)
    lanes = max(1, min(lanes, len(ids) // 32))
    states, words = encode(ids, table, lanes)
    nulls = np.array([d is None for d, _ in docs])
    names = np.array([0 if d is None else d for d, _ in docs], np.int64)
    least = int(names.min()) if len(names) else 0
    meta = zlib.compress((names - least).astype("<i8").tobytes() + np.packbits(nulls).tobytes() + lengths.astype("<i8").tobytes(), 1)
    head = HEAD.pack(len(docs), len(ids), lanes, len(meta), len(words), least % 2**64, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + meta + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def unpack_block(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a block."""
    n_docs, n, lanes, meta_size, n_words, least, crc = HEAD.unpack_from(data)
    at = HEAD.size
    meta = zlib.decompress(data[at : at + meta_size])
    at += meta_size
    states = np.frombuffer(data, "<u8", lanes, at)
    words = np.frombuffer(data, "<u4", n_words, at + 8 * lanes)
    least -= 2**64 * (least >= 2**63)
    names = np.frombuffer(meta, "<i8", n_docs) + least
    nulls = np.unpackbits(np.frombuffer(meta, np.uint8, -(-n_docs // 8), 8 * n_docs))[:n_docs].astype(bool)
    lengths = np.frombuffer(meta, "<i8", n_docs, len(meta) - 8 * n_docs)
    ids = decode(states, words, n, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids do not have their checksum")
    return [None if x else int(d) for d, x in zip(names, nulls, strict=True)], lengths, ids


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file, block after block."""

    def __init__(self, path: str, table: Table, width: str):
        self.path, self.table, self.width = path, table, width
        self.fs, self.name = _open(path)
        task = TaskContext.get()
        self.temporary = f"{self.name}.{task.taskAttemptId() if task else 0}.tmp"
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.size, self.ids, self.docs, self.index = 0, 0, 0, []
        packed = table.pack()
        self._write(MAGIC + struct.pack("<I", len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def block(self, docs: list[tuple[int | None, bytes]]) -> None:
        data = pack_block(docs, self.table, self.width)
        n = sum(len(b) for _, b in docs) // np.dtype(self.width).itemsize
        self.index.append((self.size, len(data), self.ids, zlib.crc32(data)))
        self._write(data)
        self.ids += n
        self.docs += len(docs)

    def close(self) -> None:
        packed = zlib.compress(np.array(self.index, "<i8").tobytes(), 6)
        self._write(packed + struct.pack("<II", len(packed), zlib.crc32(packed)) + MAGIC)
        self.out.close()
        try:
            self.fs.move(self.temporary, self.name)
        except OSError:  # another attempt of this task was first, in a store that does not overwrite
            if self.fs.get_file_info(self.name).size != self.size:
                raise
            self.fs.delete_file(self.temporary)


def checkpoints(path: str) -> list[tuple[int, int, int, int]]:
    """(offset, bytes, first id, crc32) of each block of a file."""
    filesystem, name = _open(path)
    with filesystem.open_input_file(name) as f:
        size = f.size()
        tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        length, crc = struct.unpack_from("<II", tail)
        packed = f.read_at(length, size - len(tail) - length)
    if tail[8:] != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError(f"{path}: no index")
    return [tuple(r) for r in np.frombuffer(zlib.decompress(packed), "<i8").reshape(-1, 4).tolist()]


def token_rows(docs: DataFrame, path: str, end: int, width: str, size: int) -> DataFrame:
    """doc_id and ids of each document, its end id included; and from each task one row of counts, how often it saw each id."""
    tail, item = np.array([end], width).tobytes(), np.dtype(width).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, total = worker_encoder(path), np.zeros(size, np.int64)
        for b in batches:
            packed = []
            for some in batches_of(b["text"]):
                ids, cuts = encoder.encode_arrays(some)
                total += np.bincount(ids, minlength=size)
                data, cuts = ids.astype(width).tobytes(), (cuts * item).tolist()
                packed += [data[a:z] + tail for a, z in zip(cuts, cuts[1:], strict=False)]
            total[end] += len(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": packed, "counts": None})
        if total.any():
            yield pd.DataFrame({"doc_id": [None], "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    return id_back(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, ids binary, counts binary"))


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text) as files in folder; returns the manifest: path, file, docs, ids, first_id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_batches(spark, 2_000)
    path = path or vocabulary_path()
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    width = "<u2" if size <= 2**16 else "<u4"
    item = np.dtype(width).itemsize
    rows = materialize(token_rows(docs, path, end, width, size), "token-ids")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seen in b["counts"]:
                n = np.frombuffer(seen, "<i8")
                yield pd.DataFrame({"id": np.flatnonzero(n), "n": n[n > 0]})

    per_task = rows.filter("counts IS NOT NULL").select("counts").mapInPandas(summed, "id long, n long")
    counts = np.zeros(size, np.int64)
    for r in per_task.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row an id
        counts[r["id"]] = r["n"]
    total = int(counts.sum())
    if not total:
        return spark.createDataFrame([], "path string, file int, docs long, ids long, first_id long")
    table = Table.of_counts(counts)
    files = max(1, -(-total // PER_FILE))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, writer, held, some = TaskContext.get().partitionId(), None, 0, []
        for b in batches:
            for doc, ids in zip(b["doc_id"], b["ids"], strict=True):
                some.append((None if doc is None else int(doc), bytes(ids)))
                held += len(ids)
                if held >= BLOCK * item:
                    writer = writer or Writer(f"{folder}/part-{number:06d}.rans", table, width)
                    writer.block(some)
                    held, some = 0, []
        if some:
            writer = writer or Writer(f"{folder}/part-{number:06d}.rans", table, width)
            writer.block(some)
        if writer:
            writer.close()
            yield pd.DataFrame([(writer.path, number, writer.docs, writer.ids)], columns=["path", "file", "docs", "ids"])

    order = ["doc_id", F.xxhash64("ids"), "ids"]  # the hash parts the rows of one id, or of null ids, among tasks
    dealt = rows.filter("counts IS NULL").select("doc_id", "ids").repartitionByRange(files, *order[:2]).sortWithinPartitions(*order).select(id_text(), "ids")
    written = dealt.mapInPandas(store, "path string, file int, docs long, ids long").collect()  # one row a file
    discard(rows)
    first, out = 0, []
    for r in sorted(written, key=lambda r: r["file"]):
        out.append((r["path"], r["file"], r["docs"], r["ids"], first))
        first += r["ids"]
    return spark.createDataFrame(out, "path string, file int, docs long, ids long, first_id long")


def read(spark: SparkSession, manifest: DataFrame, schema: str = "doc_id long, start long, n_tokens long, ids_crc32 long", digest=None) -> DataFrame:
    """Decodes the files of a manifest, block by block in parallel.

    digest(doc_id, start, ids) -> a row of schema; the default's rows tell each
    document's place, length and crc32 of its ids as unsigned 32-bit integers.
    """
    digest = digest or (lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids)))
    names = [c.split()[0] for c in schema.split(", ")]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, first in zip(b["path"], b["first_id"], strict=True):
                found = checkpoints(p)
                yield pd.DataFrame([(p, o, n, first + i, c) for o, n, i, c in found], columns=["path", "offset", "bytes", "first_id", "crc"])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, Table] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                filesystem, name = _open(r.path)
                with filesystem.open_input_file(name) as f:
                    packed = f.read_at(struct.unpack("<I", f.read_at(4, len(MAGIC)))[0], len(MAGIC) + 4)
                    data = f.read_at(int(r.bytes), int(r.offset))
                if zlib.crc32(data) != r.crc:
                    raise ValueError(f"{r.path}: the block at {r.offset} is damaged")
                key = packed if len(tables) < 8 else None
                table = tables.get(packed) or Table.unpack(packed)
                if key:
                    tables[key] = table
                docs, lengths, ids = unpack_block(data, table)
                ids = ids.astype("<u4")
                at, out = 0, []
                for d, n in zip(docs, lengths.tolist(), strict=True):
                    out.append(digest(d, r.first_id + at, ids[at : at + n]))
                    at += n
                yield pd.DataFrame({n: pd.Series(list(x), dtype=object) for n, x in zip(names, zip(*out, strict=True), strict=True)}, columns=names)

    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = max(1, files + ids // (BLOCKS_A_TASK * BLOCK))  # a stated number, which the planner does not coalesce
    blocks = manifest.select("path", "first_id").repartition(max(1, files), "path").mapInPandas(listed, "path string, offset long, bytes long, first_id long, crc long")
    return blocks.repartition(tasks, "path", "offset").mapInPandas(decoded, schema)


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs and returns what the files say of each document."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or scratch_path(spark, "rans"), path, end))
