"""Sharding: Karmarkar-Karp differencing of indivisible groups into shards of near-equal bytes.

All documents of equal text form one group, which stays whole.  A group alone
is a partial partition of one filled and k-1 empty slots; the two partial
partitions with the largest spread are combined, oppositely ordered, until one
is left.

At scale the work is split so that no task and not the driver holds more than a
bounded number of groups:

* Heavy groups, those of at least 1/(k * HEAVY) of all bytes, are at most
  k * HEAVY in number whatever the input; the driver differences them.
* All other groups are dealt by hash to parts of about PER_PART groups.  Each
  part is differenced in one task, starting from a scaled copy of the heavy
  groups' partial partition, so that every part fills what the heavy groups
  left open.
* The parts are partial partitions in turn: they are combined by differencing,
  the largest spreads first and oppositely ordered, some hundred in a task and
  in as many rounds as that takes.  Slots that the heavy groups fill alike are
  interchangeable, so the combining permutes slots within such classes.

Law: bytes.  A single group above a k-th of all bytes still stays whole; the
other shards then share the rest evenly.

Defined results: a null text counts as an empty one (size 16, crc 0, one group
with the empty texts); equal sizes are ordered by the group's key; repeated rows
share their group's shard and get slots of their own; an empty table gives no
rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALT, materialize, salted, with_slots

HEAVY, PER_PART, PARTS_PER_TASK = 64, 20_000, 500
OVERHEAD = 16


def differencing(sizes: Sequence[int], k: int, base: np.ndarray | None = None) -> np.ndarray:
    """The slot, 0 to k-1, of each size.  base: what the k slots hold already."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    first = 0 if base is None else 1  # node 0 is the base, if there is one
    leaves = n + first
    sums: dict[int, np.ndarray] = {}
    heap = []
    if first:
        order = np.argsort(base, kind="stable")
        sums[0] = np.asarray(base, np.int64)[order]
        heap.append((-int(sums[0][-1] - sums[0][0]), 0))
    heap += [(-int(s), i + first) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []

    def slots_of(node: int) -> np.ndarray:
        if node in sums:
            return sums.pop(node)
        one = np.zeros(k, np.int64)
        one[-1] = sizes[node - first]
        return one

    node = leaves
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = slots_of(a) + slots_of(b)[::-1]
        order = np.argsort(both, kind="stable")
        sums[node] = both[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[order[-1]] - both[order[0]]), node))
        node += 1
    label: dict[int, np.ndarray] = {node - 1: np.arange(k)}
    slot = np.zeros(n, np.int64)

    def told(child: int, labels: np.ndarray) -> None:
        if first <= child < leaves:
            slot[child - first] = labels[-1]
        else:
            label[child] = labels

    for a, b, order in reversed(merges):
        node -= 1
        mine = label.pop(node)
        back = np.empty(k, np.int64)
        back[order] = mine
        told(a, back)
        told(b, back[::-1])
    if not merges:
        told(node - 1, np.arange(k))
    if first:  # the base's slots keep their own numbers
        rename = np.empty(k, np.int64)
        rename[label[0]] = np.argsort(base, kind="stable")
        slot = rename[slot]
    return slot


def combined(vectors: np.ndarray) -> np.ndarray:
    """(parts, k) -> (parts, k): the shard that each slot of each part goes to.

    The parts are partial partitions: the two with the largest spread are
    combined, the fullest slot of one on the emptiest of the other, until one is left.
    """
    parts, k = vectors.shape
    where = np.empty((parts, k), np.int64)
    sums, members = {}, {}
    heap = []
    for i, v in enumerate(vectors):
        order = np.argsort(v, kind="stable")
        where[i, order] = np.arange(k)  # a slot's place in the sorted sums
        sums[i], members[i] = v[order], [i]
        heap.append((-int(v.max() - v.min()), i))
    heapq.heapify(heap)
    node = parts
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        if len(members[a]) < len(members[b]):  # the smaller side's parts are told their new places one by one
            a, b = b, a
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        mine, other = members.pop(a), members.pop(b)
        where[mine] = place[where[mine]]
        where[other] = place[k - 1 - where[other]]
        sums[node], members[node] = both[order], mine + other
        heapq.heappush(heap, (-int(sums[node][-1] - sums[node][0]), node))
        node += 1
    return where


def combined_parts(sums: DataFrame, parts: int, classes: list[np.ndarray], per_task: int) -> DataFrame:
    """(part, moves): the shard of each slot of each part.  sums: (part, sums), a row a part.

    Slots of one class are interchangeable; within each class the parts' partial
    partitions are differenced, `per_task` parts in a task; what a task combined
    is one part of the next round, until one is left.
    """

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        vectors = np.stack(pdf["sums"].to_list()).astype(np.int64)
        moves, total = np.empty_like(vectors), np.zeros(vectors.shape[1], np.int64)
        for alike in classes:
            moves[:, alike] = alike[combined(vectors[:, alike])]
        for v, m in zip(vectors, moves, strict=True):
            total[m] += v
        return pd.DataFrame({"part": pdf["part"], "next": pdf["part"] // per_task, "moves": list(moves), "sums": [total if i == 0 else None for i in range(len(pdf))]})

    out = None
    while True:
        done = sums.groupBy(F.call_function("div", F.col("part"), F.lit(per_task))).applyInPandas(combine, "part long, next long, moves array<long>, sums array<long>")
        done = materialize(done, "shard-moves")
        step = done.select("part", "next", "moves")
        if out is None:
            out = step
        else:  # moves of the last round, moved by this one
            later = step.select(F.col("part").alias("_p"), F.col("next").alias("_next"), F.col("moves").alias("_moves"))
            out = out.join(later, F.col("next") == F.col("_p")).select("part", F.col("_next").alias("next"), F.transform("moves", lambda m: F.element_at("_moves", (m + 1).cast("int"))).alias("moves"))
        parts = -(-parts // per_task)
        if parts <= 1:
            return out.select("part", "moves")
        sums = done.filter(F.col("sums").isNotNull()).select(F.col("next").alias("part"), "sums")


def shard(docs: DataFrame, shards: int = 40, per_part: int = PER_PART, parts_per_task: int = PARTS_PER_TASK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("gid"))
    rows = materialize(salted(rows), "shard-rows")
    groups = materialize(rows.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    n, total, count = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    limit = max(1, -(-total // (shards * HEAVY)))  # at least that: at most shards * HEAVY groups
    heavy = groups.filter(F.col("bytes") >= limit).orderBy(F.desc("bytes"), "gid").collect()
    where = differencing([r["bytes"] for r in heavy], shards)
    filled = np.bincount(where, [r["bytes"] for r in heavy], shards).astype(np.int64) if heavy else np.zeros(shards, np.int64)
    light = total - int(filled.sum())
    parts = max(1, -(-n // per_part))
    by_load = np.argsort(filled, kind="stable")
    classes = np.split(by_load, np.flatnonzero(np.diff(filled[by_load]) * 10_000 > total // shards) + 1)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gid"], ascending=[False, True])
        share = pdf["bytes"].sum() / max(1, light)
        slot = differencing(pdf["bytes"].tolist(), shards, np.rint(filled * share).astype(np.int64))
        return pd.DataFrame({"gid": pdf["gid"], "part": pdf["part"], "place": slot, "bytes": pdf["bytes"]})

    placed = (
        groups.filter(F.col("bytes") < limit)
        .select("gid", "bytes", F.pmod(F.xxhash64("gid"), F.lit(parts)).alias("part"))
        .groupBy("part")
        .applyInPandas(place, "gid binary, part long, place long, bytes long")
    )
    placed = materialize(placed, "shard-parts")
    sums = placed.groupBy("part").agg(*[F.coalesce(F.sum(F.when(F.col("place") == i, F.col("bytes"))), F.lit(0)).alias(f"s{i}") for i in range(shards)])
    moves = combined_parts(sums.select("part", F.array(*[f"s{i}" for i in range(shards)]).alias("sums")), parts, classes, parts_per_task)
    placed = placed.join(moves, "part").select("gid", F.element_at("moves", (F.col("place") + 1).cast("int")).cast("int").alias("shard"))
    fixed = spark.createDataFrame([(bytes(r["gid"]), int(s)) for r, s in zip(heavy, where, strict=True)], "gid binary, fixed int")
    dealt = rows.join(F.broadcast(fixed), "gid", "left")  # at most shards * HEAVY rows
    out = ["doc_id", "size", "text_crc32", "shard", SALT]
    on_heavy = dealt.filter(F.col("fixed").isNotNull()).withColumn("shard", F.col("fixed")).select(*out)
    on_light = dealt.filter(F.col("fixed").isNull()).drop("fixed").join(placed, "gid").select(*out)
    numbered = with_slots(materialize(on_heavy.unionByName(on_light), "shard-placed"), "shard", "slot", count)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def spread(loads: Iterator[int]) -> float:
    """Largest over mean load, less one: 0 is perfect balance."""
    loads = list(loads)
    return max(loads) * len(loads) / max(1, sum(loads)) - 1
