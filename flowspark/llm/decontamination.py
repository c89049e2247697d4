"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, cut into k+1 pieces, at least one piece of a
test item stands unchanged in every text that holds the item within k edits.
One Aho-Corasick automaton finds all exact piece hits of a whole text; around
each hit, Myers' bit-parallel distance verifies the item.  Texts and items are
compared in small letters, ASCII signs and white space folded to single spaces.

Test items are a query set: they are taken in blocks of bounded size.  A single
block goes to the executors with the code; several are files in the shared
folder, and a task holds one block's automaton at a time: it gathers some
megabytes of texts, looks for one block's items after the other's in them, and
goes on to the next texts.

Defined results: null and empty texts hold nothing; an item shorter than
`shortest` folded characters is looked for exactly and between word boundaries, an
empty one never; items of equal text are all reported; an item of null id is
looked for like any, and each such text that no item with an id shares is a null
entry before the ids; hits of repeated rows and null ids of documents are reported for each row; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fresh, scratch_path

CHARACTERS_PER_EDIT, SHORTEST, BLOCK, GATHERED = 20, 40, 1_000_000, 32_000_000
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
Item = tuple[int | None, str]


def fold(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()).decode("utf-8", "replace")


def budget(item: str, per_edit: int = CHARACTERS_PER_EDIT, shortest: int = SHORTEST) -> int:
    return len(item) // per_edit if len(item) >= shortest else 0


class Myers:
    """Edit distance of a pattern to any part of a text, one bit a pattern character."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str, enough: int = 0) -> int:
        """The least distance of the pattern to a substring of text; stops at one of `enough` or less."""
        full, top, masks = (1 << self.m) - 1, 1 << (self.m - 1), self.masks
        vp, vn, score = full, 0, self.m
        best = score
        for c in text:
            x = masks.get(c, 0) | vn
            d = ((((x & vp) + vp) ^ vp) | x) & full
            hn = vp & d
            hp = (vn | ~(vp | d)) & full
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        break
            x = (hp << 1) & full
            vn = x & d
            vp = ((hn << 1) | ~(x | d)) & full
        return best


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: Iterable[Item], per_edit: int = CHARACTERS_PER_EDIT, shortest: int = SHORTEST):
        import ahocorasick

        self.items: dict[str, list[int | None]] = {}
        for i, text in items:
            if folded := fold(text):
                self.items.setdefault(folded, []).append(None if i is None else int(i))
        self.texts = sorted(self.items)
        self.budget = [budget(t, per_edit, shortest) for t in self.texts]
        self.shortest = shortest
        self.myers: dict[int, Myers] = {}
        self.automaton = ahocorasick.Automaton()
        for n, (text, k) in enumerate(zip(self.texts, self.budget, strict=True)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                piece = text[a:z]
                if piece in self.automaton:
                    self.automaton.get(piece).append((n, a))
                else:
                    self.automaton.add_word(piece, [(n, a)])
        if self.texts:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """item id -> least distance, for the items with an id within their budgets."""
        return {i: d for i, d in self.hits(text) if i is not None}

    def hits(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item id, least distance) for the items within their budgets; first those of null id, then by id."""
        return in_order(self._all(text))

    def _all(self, text: str | None) -> list[tuple[int | None, int]]:
        folded = fold(text)
        if not folded or not self.texts:
            return []
        found: dict[int, int] = {}
        looked: dict[int, list[tuple[int, int]]] = {}
        for end, owners in self.automaton.iter(folded):
            for n, offset in owners:
                item, k = self.texts[n], self.budget[n]
                if found.get(n) == 0:
                    continue
                size = self._piece_end(n, offset) - offset
                start = end - size + 1 - offset  # where the item would begin
                if folded.startswith(item, max(0, start)) and start >= 0:
                    if len(item) >= self.shortest or self._bounded(folded, start, start + len(item)):
                        found[n] = 0
                    continue
                if not k:
                    continue
                a, z = max(0, start - k), min(len(folded), start + len(item) + k)
                spans = looked.setdefault(n, [])
                if any(x <= a and z <= y for x, y in spans[-4:]):
                    continue
                a, z = max(0, a - k), min(len(folded), z + k)  # a little more, so that the item's other pieces fall within
                spans.append((a, z))
                if n not in self.myers:
                    self.myers[n] = Myers(item)
                d = self.myers[n].distance(folded[a:z])
                if d <= k:
                    found[n] = min(d, found.get(n, d))
        return [(i, d) for n, d in found.items() for i in self.items[self.texts[n]]]

    def _piece_end(self, n: int, offset: int) -> int:
        length, k = len(self.texts[n]), self.budget[n]
        j = next(j for j in range(k + 1) if length * j // (k + 1) == offset)
        return length * (j + 1) // (k + 1)

    @staticmethod
    def _bounded(text: str, a: int, z: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (z == len(text) or text[z] == " ")


def in_order(found: list[tuple[int | None, int]]) -> list[tuple[int | None, int]]:
    """Null items, by distance, then each id once, with its least distance."""
    best: dict[int, int] = {}
    for i, d in found:
        if i is not None:
            best[i] = min(d, best.get(i, d))
    return [(None, d) for d in sorted(d for i, d in found if i is None)] + sorted(best.items())


def distinct_items(benchmark: DataFrame) -> Iterator[Item]:
    """The items with an id, then those of null id whose folded text no item before has."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    unnamed = items.filter(F.col("item_id").isNull())
    any_unnamed, seen = not unnamed.isEmpty(), set()
    digest = lambda text: xxhash.xxh128_digest(fold(text).encode("utf-8", "surrogatepass"))
    for r in items.filter(F.col("item_id").isNotNull()).toLocalIterator():
        if any_unnamed:
            seen.add(digest(r["text"]))
        yield r["item_id"], r["text"]
    if any_unnamed:
        for r in unnamed.toLocalIterator():
            if (key := digest(r["text"])) not in seen:
                seen.add(key)
                yield None, r["text"]


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[Item]]:
    """The items, some megabytes of text at a time."""
    some: list[Item] = []
    held = 0
    for item in distinct_items(benchmark):
        some.append(item)
        held += len(item[1])
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def stored(spark: SparkSession, benchmark: DataFrame) -> tuple[list[Item], list[str]]:
    """(the items, no files) of a benchmark of one block, else (nothing, the files of its blocks)."""
    from pyarrow import fs

    folder, files, first = scratch_path(spark, "items"), [], []

    def put(items: list[Item]) -> None:
        files.append(f"{folder}/block-{len(files):06d}")
        system, name = fs.FileSystem.from_uri(files[-1])
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as f:
            f.write(pickle.dumps(items))

    for n, items in enumerate(blocks(benchmark, BLOCK)):
        if n == 0:
            first = items
            continue
        if n == 1:
            put(first)
        put(items)
    return ([], files) if files else (first, files)


def loaded(path: str) -> Matcher:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return Matcher(pickle.loads(f.read()))


def gathered(batches: Iterator[pd.Series], characters: int) -> Iterator[list[pd.Series]]:
    some, held = [], 0
    for b in batches:
        some.append(b)
        held += sum(len(t) for t in b if t)
        if held >= characters:
            yield some
            some, held = [], 0
    if some:
        yield some


def hits_udf(items: list[Item], files: list[str] = (), characters: int = GATHERED):
    """A Pandas UDF text -> array of (item, distance): first null items, then by id."""

    @F.pandas_udf("items array<long>, distances array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        makers = [partial(loaded, f) for f in files]
        one = None if files else Matcher(items)
        for some in gathered(batches, characters if files else 0):
            found: list[list[tuple[int | None, int]]] = [[] for b in some for _ in b]
            for make in makers or [lambda: one]:
                matcher, at = make(), 0
                for b in some:
                    for t in b:
                        found[at] += matcher.hits(t)
                        at += 1
            if files:
                found = [in_order(f) for f in found]
            at = 0
            for b in some:
                mine = found[at : at + len(b)]
                at += len(b)
                yield pd.DataFrame({"items": [[i for i, _ in f] for f in mine], "distances": [np.array([d for _, d in f], np.int32) for f in mine]})

    return hits


def _with_hits(docs: DataFrame, benchmark: DataFrame, out: str) -> DataFrame:
    """docs with a column out: entries (item, distance) of all blocks."""
    spark = docs.sparkSession
    bound_batches(spark)
    found = fresh(docs, "_hits")
    docs = docs.withColumn(found, hits_udf(*stored(spark, benchmark), characters=GATHERED)("text"))
    entries = F.arrays_zip(F.col(f"{found}.items").alias("item"), F.col(f"{found}.distances").alias("distance"))
    return docs.withColumn(out, entries.cast("array<struct<item:bigint,distance:int>>")).drop(found)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), distances for every row of docs (doc_id, text)."""
    found = _with_hits(docs.select("doc_id", "text"), benchmark, "_found").withColumn("_found", F.array_sort("_found"))
    return found.select("doc_id", (F.size("_found") > 0).alias("contaminated"), F.col("_found.item").alias("item_ids"), F.col("_found.distance").alias("distances"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are."""
    f = fresh(docs, "_found")
    return _with_hits(docs, benchmark, f).filter(F.size(f) == 0).drop(f)
