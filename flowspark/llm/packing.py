"""Best-fit packing in bulk-synchronous rounds.

Documents are encoded, each followed by an end id; longer ones are cut into
pieces of the sequence length.  Pieces then go into as few sequences as
best-fit decreasing finds: each to the smallest gap that holds it.

Documents and gaps are range-sorted by length.  Lengths are integers up to the
sequence length, so both sorted lists are runs of equal lengths, and a sweep
over runs is a sweep over rows.  One round takes a run of pieces; each piece's
successor is the smallest gap that holds it; where more pieces than gaps ask
for one size, ranks decide: the i-th piece gets the i-th gap.  The filled gaps
move to their new size, and the round repeats with the losers until all are
placed; those that no gap holds open new sequences.  Rounds run over run
lengths only, at most one run a length and size however many rows there are;
the rows' ranks within their length come from distributed counts, and one
equi-join on length with a rank range gives each row its sequence and offset.

Defined results: a null text is an empty one; an empty text is one piece holding
the end id only; null ids and repeated rows are documents of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_back, id_text, materialize, salted, with_slots
from .tokenization import vocabulary_path, worker_encoder

LENGTH = 2048
END = 0
STRETCH = 64  # ranks
PIECES = "doc_id string, piece int, start long, length int, ids_crc32 long"


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """PIECES, doc_id as a long, of every document of docs (doc_id, text)."""
    path = path or vocabulary_path()
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(path)
        for b in batches:
            out = []
            for doc, packed in zip(b["doc_id"], encoder.encode_many(b["text"]), strict=True):
                packed += tail
                for piece, at in enumerate(range(0, len(packed), 4 * length)):
                    some = packed[at : at + 4 * length]
                    out.append((doc, piece, at // 4, len(some) // 4, zlib.crc32(some)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_back(docs.select(id_text(), "text").mapInPandas(run, PIECES))


def rounds(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs: (piece length, first rank, end rank, first sequence, offset).

    The pieces of a length with ranks first to end-1 go, in order, to
    consecutive sequences from the given one, all at the same offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size -> runs of sequences (first, end)
    sizes: list[int] = []  # sorted keys of gaps
    plan, opened = [], 0

    def add(size: int, first: int, end: int) -> None:
        if size <= 0:
            return
        if size not in gaps:
            gaps[size] = []
            bisect.insort(sizes, size)
        gaps[size].append((first, end))

    for need in sorted(histogram, reverse=True):
        rank, n = 0, histogram[need]
        while rank < n:
            at = bisect.bisect_left(sizes, need)
            if at == len(sizes):  # no gap holds it: open as many sequences as this length fills
                count = -(-(n - rank) // (length // need))
                add(length, opened, opened + count)
                opened += count
                continue
            size = sizes[at]
            first, end = gaps[size].pop()
            take = min(end - first, n - rank)
            plan.append((need, rank, rank + take, first, length - size))
            if first + take < end:
                gaps[size].append((first + take, end))
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            add(size - need, first, first + take)
            rank += take
    return plan


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    spark = docs.sparkSession
    bound_batches(spark, 2_000)
    pieces = materialize(salted(cut(docs, path, length, end)), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    plan = rounds(histogram, length)
    ranked = with_slots(pieces, "length", "_rank", sum(histogram.values()))
    table = spark.createDataFrame(pd.DataFrame(plan, columns=["length", "_from", "_to", "_sequence", "offset"]).astype("int64"), "length long, _from long, _to long, _sequence long, offset long")
    stretch = lambda c: F.call_function("div", c, F.lit(STRETCH))  # noqa: E731  a piece meets the runs of its stretch of ranks only
    table = table.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to") - 1))))
    ranked = ranked.withColumn("length", F.col("length").cast("long")).withColumn("_stretch", stretch(F.col("_rank")))
    placed = ranked.join(table, ["length", "_stretch"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")
