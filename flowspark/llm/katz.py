"""Katz backoff language model: n-grams of `order` words that back off, order by order, to unigrams.

P(w | h) is the Good-Turing discounted relative frequency of a seen n-gram, else
alpha(h) * P(w | h'), h' being h without its first word; alpha(h) is the mass that
h's seen n-grams leave over the mass that the order below gives their words, so
the probabilities after every history sum to one.
P(w) is the discounted relative frequency of a seen word; what it leaves belongs
to one unknown word.  Counts up to K are discounted by Katz's ratio; where the
counts of counts give no ratio within (0, 1), a count loses one half.  Where
nothing is rare enough to lose mass, one count more than there are is set aside.

Words are ``[^\\x20\\x09-\\x0D]+`` in small ASCII letters; a text ends with an end
token and its first word follows a start mark.

Counting and scoring keep tokens packed.  One pass cuts the documents into
chunks of a bounded number of tokens, each a local vocabulary and token numbers,
and writes them.  Chunks then put two questions to tables that are dealt to
buckets of bounded size, each local word or bigram once a chunk:

1. unigram table, by word hash: the word's count in training and its number;
2. bigram table, by history: the bigram's count, and of each history what its
   backoff weight needs.  Histories so frequent that they would fill a good part
   of a bucket are dealt by bigram instead; what their backoff weights need is summed
   over buckets and sent to all if it is of at most `most_frequent` histories (64
   bytes each), else joined to the chunks that ask for it.

A chunk sends a row to each bucket, so rows grow as chunks times buckets.  Where
that would be more than ROWS_A_CHUNK buckets, pairs are rows of their own instead,
counted and joined by Spark: dearer by a constant, but in proportion to the
tokens however many there are.  Both ways give the same counts.

Every bucket counts all of its rows: nothing is pruned, sampled or capped.

Defined results: a null text is an empty one, which is its end token; a null id
counts by the crc32 of an empty string; rows of one id are documents of their
own; without training documents the unknown word has all mass (score 0); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, bound_batches, crc_of_id, discard, id_text, materialize, mix64, release
from .tokenization import Memo

K, ORDER = 5, 2
CHUNK = 750_000  # tokens
REMEMBERED = 60_000  # word hashes of a generation of a task's memo: a rare word is hashed as fast as it is looked up
MOST_FREQUENT = 50_000  # histories whose sums are sent to every task
ROWS_A_CHUNK = 10_000  # buckets that chunks put their questions to, at most
WORDS_PER_BUCKET, PAIRS_PER_BUCKET = 1_000_000, 1_000_000
END_HASH, RESERVED = 0, 2  # the end token's hash; numbers below RESERVED are no words
START, OTHER = 0, 1  # numbers of the start mark and of every word unknown in training


def squeeze(a: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, kind).tobytes())


def spread_out(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), kind)


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word.lower())
    return h if h != END_HASH else 1


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Ratios for the counts 1 to K, from how many things were seen 1 to K+1 times."""
    n = np.asarray(counts_of_counts, float)
    out = 1 - 0.5 / np.arange(1, K + 1)
    if n[0] > 0 and (common := (K + 1) * n[K] / n[0]) < 1:
        for r in range(1, K + 1):
            if n[r - 1] > 0:
                ratio = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
                if 0 < ratio < 1:
                    out[r - 1] = ratio
    return out


@dataclass
class Unigrams:
    """P(w) as a function of w's count."""

    tokens: int
    words: int
    ratio: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, words: int, counts_of_counts: np.ndarray) -> Unigrams:
        ratio = discounts(counts_of_counts)
        if not tokens:
            return cls(0, 0, ratio, 1.0, 1.0)
        lost = float(sum(r * n * (1 - d) for r, n, d in zip(range(1, K + 1), counts_of_counts, ratio, strict=False)))
        scale = 1.0 if lost else tokens / (tokens + 1)  # without a rare word, one count more is set aside
        unknown = 1 - scale * (1 - lost / tokens)
        return cls(tokens, words, ratio, scale, unknown)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, np.int64)
        d = np.append(1.0, self.ratio)[np.where(c <= K, c, 0)]
        return np.where(c > 0, self.scale * d * c / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 1) / (self.tokens + 1 * (self.words + 1)))


def chunked(docs: DataFrame, held_out: int, of: int, size: int) -> DataFrame:
    """chunk, tokens, words, ids, nulls, lengths, held, vocabulary (hashes), counts (in training), numbers (of tokens)."""
    rows = docs.select(id_text(), "text", (crc_of_id() % of == held_out).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, part, number = Memo(word_hash, REMEMBERED), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        arrays: list[np.ndarray] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal number, tokens
            flat = np.concatenate(arrays)
            lengths = np.array([len(a) for a in arrays])
            vocabulary, numbers = np.unique(flat, return_inverse=True)
            counts = np.bincount(numbers[np.repeat(~np.array(held), lengths)], minlength=len(vocabulary))
            row = (part << 33 | number, len(flat), len(vocabulary), squeeze([0 if i is None else i for i in ids], "<i8"), squeeze([i is None for i in ids], "u1"), squeeze(lengths, "<i8"), squeeze(held, "u1"), squeeze(vocabulary, "<u8"), squeeze(counts, "<u4"), squeeze(numbers, "<u4"))
            number += 1
            tokens = 0
            for x in (ids, held, arrays):
                x.clear()
            return pd.DataFrame([row], columns=CHUNKED)

        for b in batches:
            for doc, text, out in zip(b["doc_id"], b["text"], b["held"], strict=True):
                words = ascii_words(text)
                a = np.zeros(len(words) + 1, np.uint64)
                a[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                ids.append(None if doc is None else int(doc))
                held.append(bool(out))
                arrays.append(a)
                tokens += len(a)
                if tokens >= size:
                    yield flush()
        if arrays:
            yield flush()

    return rows.mapInPandas(run, "chunk long, tokens long, words long, ids binary, nulls binary, lengths binary, held binary, vocabulary binary, counts binary, numbers binary")


CHUNKED = ["chunk", "tokens", "words", "ids", "nulls", "lengths", "held", "vocabulary", "counts", "numbers"]
ANSWER = "chunk long, bucket long, counts binary, known binary, tokens long, words long, seen array<long>"


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)[1 : K + 2].tolist()


def ask_unigrams(chunks: DataFrame, bits: int, kind: str) -> DataFrame:
    """ANSWER: for each chunk and bucket the words' training counts and numbers; one row a bucket also has its sums."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        for b in batches:
            for chunk, vocabulary, counts in zip(b["chunk"], b["vocabulary"], b["counts"], strict=True):
                words, counts = spread_out(vocabulary, "<u8"), spread_out(counts, "<u4")
                cuts = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                rows = [(q, chunk, squeeze(words[a:z], "<u8"), squeeze(counts[a:z], "<u4")) for q, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "counts"])

    room = (32 if kind == "<u4" else 63) - bits

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        words = [spread_out(w, "<u8") for w in pdf["words"]]
        counts = np.concatenate([spread_out(c, "<u4") for c in pdf["counts"]])
        unique, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, counts, len(unique)).astype(np.int64)
        if len(unique) + RESERVED >= 1 << room:
            raise ValueError("a bucket has more words than numbers; use wider ones")
        bucket = int(pdf["bucket"].iloc[0])
        numbers = np.where(total > 0, (bucket << room) + RESERVED + np.arange(len(unique)), OTHER)
        out, at = [], 0
        for i, (chunk, w) in enumerate(zip(pdf["chunk"], words, strict=True)):
            mine = inverse[at : at + len(w)]
            at += len(w)
            sums = (int(total.sum()), int((total > 0).sum()), counts_of_counts(total)) if not i else (0, 0, None)
            out.append((chunk, bucket, squeeze(total[mine], "<i8"), squeeze(numbers[mine], kind), *sums))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return chunks.select("chunk", "vocabulary", "counts").mapInPandas(ask, "bucket long, chunk long, words binary, counts binary").groupBy("bucket").applyInPandas(answer, ANSWER)


@dataclass
class Pairs:
    """The distinct (history, word) pairs of a chunk whose history is known, sorted by bucket."""

    history: np.ndarray  # index into the chunk's words; len(words) is the start mark
    word: np.ndarray
    number: np.ndarray  # of each token: its pair, or -1
    train: np.ndarray  # count in the chunk's training documents
    order: np.ndarray  # pairs sorted by bucket
    cuts: np.ndarray  # where buckets begin in that order


def pairs_of(numbers: np.ndarray, lengths: np.ndarray, held: np.ndarray, counts: np.ndarray, known: np.ndarray, starts: int, model_tokens: int, buckets: int) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, numbers of words and start mark, their counts, which are frequent histories)."""
    v = len(counts)
    before = np.empty(len(numbers), np.int64)
    before[1:] = numbers[:-1]
    before[np.cumsum(lengths) - lengths] = v
    count = np.append(counts, starts)
    name = np.append(known.astype(np.uint64), np.uint64(START))
    usable = count[before] > 0
    code = before[usable] * (v + 1) + numbers[usable]
    unique, inverse = np.unique(code, return_inverse=True)
    number = np.full(len(numbers), -1, np.int64)
    number[usable] = inverse
    train = np.bincount(inverse[np.repeat(~held, lengths)[usable]], minlength=len(unique))
    history, word = unique // (v + 1), unique % (v + 1)
    often = count * 4 * buckets > model_tokens
    h = mix64(name[history] + np.uint64(7))
    spread = np.where(often[history], mix64(h ^ mix64(name[word])), h)
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return Pairs(history, word, number, train, order, np.searchsorted(bucket[order], np.arange(buckets + 1))), name, count, often


BIGRAMS = "chunk long, bucket long, counts binary, kept binary, frequent array<struct<history:long,stats:array<double>>>, seen array<long>"


def ask_bigrams(state: DataFrame, unigrams: Unigrams, starts: int, buckets: int, kind: str) -> DataFrame:
    """BIGRAMS: for each chunk and bucket the pairs' counts and, of each history but the frequent ones, what alpha needs."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                numbers, lengths, held, counts, known = chunk_arrays(r, kind)
                p, name, count, often = pairs_of(numbers, lengths, held, counts, known, starts, unigrams.tokens, buckets)
                rows = []
                for q in range(buckets):
                    at = p.order[p.cuts[q] : p.cuts[q + 1]]
                    if len(at):
                        h, w = p.history[at], p.word[at]
                        rows.append((q, r.chunk, squeeze(name[h], kind), squeeze(name[w], kind), squeeze(count[w], "<i8"), squeeze(p.train[at], "<u4"), squeeze(often[h], "u1")))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "history", "word", "unigram", "train", "often"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        part = lambda c, k: [spread_out(x, k) for x in pdf[c]]
        histories = part("history", kind)
        history = np.concatenate(histories).astype(np.uint64)
        word = np.concatenate(part("word", kind)).astype(np.uint64)
        train = np.concatenate(part("train", "<u4")).astype(np.int64)
        uni, often = np.concatenate(part("unigram", "<i8")), np.concatenate(part("often", "u1")).astype(bool)
        if kind == "<u4":
            _, first, inverse = np.unique(history << np.uint64(32) | word, return_index=True, return_inverse=True)
        else:
            _, first, inverse = np.unique(np.stack([history, word], 1), axis=0, return_index=True, return_inverse=True)
        total = np.bincount(inverse, train, len(first)).astype(np.int64)
        seen = first[total > 0]
        c = total[total > 0]
        names, owner = np.unique(history[seen], return_inverse=True)
        stats = np.zeros((len(names), K + 2))
        for r in range(1, K + 1):
            stats[:, r - 1] = np.bincount(owner[c == r], minlength=len(names))
        stats[:, K] = np.bincount(owner, np.where(c > K, c, 0), len(names))
        stats[:, K + 1] = np.bincount(owner, unigrams.p(uni[seen]), len(names))
        hot = np.isin(names, history[often]) if often.any() else np.zeros(len(names), bool)
        frequent = [(int(h), s.tolist()) for h, s in zip(names[hot], stats[hot], strict=True)]
        out, at = [], 0
        for i, (chunk, h) in enumerate(zip(pdf["chunk"], histories, strict=True)):
            span = slice(at, at + len(h))
            at += len(h)
            mine = history[span][np.append(True, h[1:] != h[:-1])] if len(h) else history[span]
            place = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
            found = stats[place] * (names[place] == mine)[:, None] if len(names) else np.zeros((len(mine), K + 2))
            kept = squeeze(found[:, : K + 1], "<u8"), squeeze(found[:, K + 1], "<f8")
            out.append((chunk, int(pdf["bucket"].iloc[0]), squeeze(total[inverse[span]], "<u8"), len(kept[0]).to_bytes(4, "little") + kept[0] + kept[1], frequent if not i else None, counts_of_counts(total) if not i else None))
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "kept", "frequent", "seen"])

    asked = state.mapInPandas(ask, "bucket long, chunk long, history binary, word binary, unigram binary, train binary, often binary")
    return asked.groupBy("bucket").applyInPandas(answer, BIGRAMS)


def wanted(state: DataFrame, unigrams: Unigrams, starts: int, buckets: int, kind: str) -> DataFrame:
    """chunk and history of the frequent histories of each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                _, name, _, often = pairs_of(*chunk_arrays(r, kind), starts, unigrams.tokens, buckets)
                yield pd.DataFrame({"chunk": r.chunk, "history": np.unique(name[often]).astype(np.int64)})

    return state.mapInPandas(run, "chunk long, history long")


def chunk_arrays(r, kind: str) -> tuple[np.ndarray, ...]:
    """(token numbers, lengths, held, counts, word numbers) of a chunk with its unigram answers in bucket order."""
    answers = sorted(r.answers, key=lambda x: x["bucket"])
    counts = np.concatenate([spread_out(x["counts"], "<i8") for x in answers])
    known = np.concatenate([spread_out(x["known"], kind) for x in answers])
    return spread_out(r.numbers, "<u4").astype(np.int64), spread_out(r.lengths, "<i8"), spread_out(r.held, "u1").astype(bool), counts, known


def scores(docs: DataFrame, held_out: int = 2, of: int = 7, order: int = ORDER, chunk: int = CHUNK, most_frequent: int = MOST_FREQUENT, rows_a_chunk: int = ROWS_A_CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Learns from the rows whose id's crc32 modulo `of` is not held_out.  order: words of the longest n-grams.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chunks = materialize(chunked(docs, held_out, of, chunk), "katz-chunks")
    tokens, words = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    kind = "<u4" if words < 2**30 else "<u8"
    bits = max(0, int(np.ceil(np.log2(max(1, words / WORDS_PER_BUCKET)))))
    answers = materialize(ask_unigrams(chunks, bits, kind), "katz-unigrams")
    sums = answers.filter(F.col("seen").isNotNull()).agg(F.sum("tokens"), F.sum("words"), *[F.sum(F.col("seen")[i]) for i in range(K + 1)]).first()
    unigrams = Unigrams.of(sums[0] or 0, sums[1] or 0, np.array([x or 0 for x in sums[2:]]))
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "known")).alias("answers"))
    state = materialize(chunks.drop("vocabulary", "counts", "tokens", "words").join(grouped, "chunk"), "katz-state")
    discard(chunks)
    discard(answers)
    release(spark)
    starts = docs.filter(crc_of_id() % of != held_out).count()
    buckets = max(1, -(-tokens // PAIRS_PER_BUCKET))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if order != 2 or buckets > rows_a_chunk:
        return by_rows(state, unigrams, kind, order, out)
    bigrams = materialize(ask_bigrams(state.drop("ids", "nulls"), unigrams, starts, buckets, kind), "katz-bigrams")
    release(spark)
    ratio = discounts([x or 0 for x in bigrams.filter(F.col("seen").isNotNull()).agg(*[F.sum(F.col("seen")[i]) for i in range(K + 1)]).first()])
    hot = bigrams.filter(F.col("frequent").isNotNull()).select(F.explode("frequent").alias("f")).groupBy("f.history").agg(F.array(*[F.sum(F.col("f.stats")[i]) for i in range(K + 2)]).alias("stats"))
    found = hot.limit(most_frequent + 1).collect()
    told = bigrams.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "kept")).alias("told"))
    state = state.join(told, "chunk", "left")
    if len(found) <= most_frequent:
        frequent = {r["history"]: np.array(r["stats"]) for r in found}
        state = state.withColumn("hot", F.lit(None).cast("array<struct<history:bigint,stats:array<double>>>"))
    else:
        frequent = {}
        mine = wanted(state.drop("ids", "nulls", "told"), unigrams, starts, buckets, kind).join(hot, "history").groupBy("chunk").agg(F.collect_list(F.struct("history", "stats")).alias("hot"))
        state = state.join(mine, "chunk", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                arrays = chunk_arrays(r, kind)
                p, name, count, often = pairs_of(*arrays, starts, unigrams.tokens, buckets)
                c = np.zeros(len(p.history), np.int64)
                stats = np.zeros((len(count), K + 2))
                for x in r.told if r.told is not None else ():
                    at = p.order[p.cuts[x["bucket"]] : p.cuts[x["bucket"] + 1]]
                    c[at] = spread_out(x["counts"], "<u8")
                    h = p.history[at]
                    mine = h[np.append(True, h[1:] != h[:-1])]
                    cut = int.from_bytes(x["kept"][:4], "little")
                    stats[mine, : K + 1] = spread_out(x["kept"][4 : 4 + cut], "<u8").reshape(-1, K + 1)
                    stats[mine, K + 1] = spread_out(x["kept"][4 + cut :], "<f8")
                sums = frequent if r.hot is None else {x["history"]: np.array(x["stats"]) for x in r.hot}
                for i in np.flatnonzero(often):
                    stats[i] = sums.get(int(name[i]), 0)
                yield scored(r, arrays, p, count, c, stats, unigrams, ratio)

    return state.mapInPandas(finish, out)


def scored(r, arrays: tuple[np.ndarray, ...], p: Pairs, count: np.ndarray, c: np.ndarray, stats: np.ndarray, unigrams: Unigrams, ratio: np.ndarray) -> pd.DataFrame:
    """A chunk's documents.  count: of each word as a history; c: of each pair; stats: of each history's seen pairs."""
    numbers, _, _, counts, _ = arrays
    shrink = np.append(1.0, ratio)
    used = stats[:, :K] @ (ratio * np.arange(1, K + 1)) + stats[:, K]
    rare = stats[:, :K].any(1)
    scale = np.where(rare, 1.0, count / (count + 1.0))  # a history without a rare bigram sets one count aside
    left = 1 - scale * used / np.maximum(1, count)
    rest = 1 - stats[:, K + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where((count > 0) & (stats.sum(1) > 0), np.log10(left / rest), 0.0)
        uni = np.log10(unigrams.p(counts))
        direct = np.log10(scale[p.history] * shrink[np.where(c <= K, c, 0)] * c / np.maximum(1, count[p.history]))
    pair = np.where(c > 0, direct, alpha[p.history] + uni[p.word])
    return by_document(r, arrays, np.where(p.number >= 0, pair[p.number] if len(pair) else 0.0, uni[numbers]), unigrams)


def by_document(r, arrays: tuple[np.ndarray, ...], each: np.ndarray, unigrams: Unigrams) -> pd.DataFrame:
    """A chunk's documents from the log probability of each token."""
    numbers, lengths, held, counts, _ = arrays
    at = np.cumsum(lengths) - lengths
    ids, nulls = spread_out(r.ids, "<i8"), spread_out(r.nulls, "u1").astype(bool)
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64").copy() if not nulls.any() else pd.array([None if z else int(i) for i, z in zip(ids, nulls, strict=True)], "Int64"),
        "held_out": held,
        "n_tokens": lengths,
        "n_known": np.add.reduceat((counts[numbers] > 0).astype(np.int64), at),
        "train_tokens": unigrams.tokens,
        "base_score": np.add.reduceat(unigrams.base(counts)[numbers], at),
        "score": np.add.reduceat(each, at),
    })


@dataclass
class Grams:
    """The distinct (history, word) of a chunk at one order whose history is known, sorted."""

    history: np.ndarray
    word: np.ndarray
    number: np.ndarray  # of each token: its gram, or -1
    train: np.ndarray  # count in the chunk's training documents
    first: np.ndarray  # a token of each
    owner: np.ndarray  # the place of each gram's history among the distinct ones
    heads: np.ndarray  # where each distinct history begins


def grams_of(arrays: tuple[np.ndarray, ...], kind: str, order: int) -> Grams:
    """Histories are the order - 1 tokens before, the start mark among them; one word is its number, two are packed, more are hashed."""
    numbers, lengths, held, counts, known = arrays
    ids, seen = known[numbers].astype(np.uint64), counts[numbers] > 0
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    usable, history = place >= order - 2, np.zeros(len(ids), np.uint64)
    for back in range(order - 1, 0, -1):
        before, there = np.full(len(ids), START, np.uint64), np.zeros(len(ids), bool)
        before[back:], there[back:] = ids[:-back], seen[:-back]
        start = place == back - 1
        before[start] = START
        usable &= there | start
        if order <= 3 and kind == "<u4":
            history = history << np.uint64(32) | before
        else:
            history = before if order == 2 else mix64(history * np.uint64(0x9E3779B97F4A7C15) + mix64(before + np.uint64(back)))
    at = np.flatnonzero(usable)
    ranked = at[np.lexsort((ids[at], history[at]))]
    h, w = history[ranked], ids[ranked]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))[: len(h)]
    number = np.full(len(ids), -1, np.int64)
    number[ranked] = np.cumsum(new) - 1
    train = np.bincount(number[ranked], ~np.repeat(held, lengths)[ranked], int(new.sum())).astype(np.int64)
    first = ranked[new]
    h, w = h[new], w[new]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return Grams(h, w, number, train, first, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h)))), heads)


def lower_order(r, arrays: tuple[np.ndarray, ...], unigrams: Unigrams) -> np.ndarray:
    """The log probability of each token by the order before."""
    return np.log10(unigrams.p(arrays[3]))[arrays[0]] if r.p is None else spread_out(r.p, "<f8")


def by_rows(state: DataFrame, unigrams: Unigrams, kind: str, order: int, out: str) -> DataFrame:
    """The scores, with a row for each n-gram of a chunk: counted by grouping, answered by joins that the planner can split.

    Order by order, each backing off to the one before: a seen n-gram has its
    discounted relative frequency, another its history's backoff weight times the
    probability that the order before gives its word.
    """
    state = state.withColumn("p", F.lit(None).cast("binary"))
    columns = state.schema
    for n in range(2, order + 1):

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # noqa: B023  runs before the next n
            for b in batches:
                for r in b.itertuples(index=False):
                    arrays = chunk_arrays(r, kind)
                    g, lower = grams_of(arrays, kind, n), lower_order(r, arrays, unigrams)
                    head = np.zeros(len(g.history), bool)
                    head[g.heads] = True
                    for a in range(0, len(g.history), 100_000):
                        some = slice(a, a + 100_000)
                        history, word = g.history[some].view(np.int64), g.word[some].view(np.int64)
                        yield pd.DataFrame({"chunk": r.chunk, "place": np.arange(a, a + len(word)), "head": head[some], "history": history, "word": word, "train": g.train[some], "lower": 10 ** lower[g.first[some]]})

        asked = materialize(state.drop("ids", "nulls").mapInPandas(ask, "chunk long, place long, head boolean, history long, word long, train long, lower double"), "katz-grams")
        counted = materialize(asked.groupBy("history", "word").agg(F.sum("train").alias("c"), F.max("lower").alias("lower")).filter("c > 0"), "katz-counts")
        of_counts = {r["c"]: r["n"] for r in counted.filter(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}  # at most K + 1 rows
        ratio = discounts([of_counts.get(k, 0) for k in range(1, K + 2)])
        sums = [F.count_if(F.col("c") == k).cast("double") for k in range(1, K + 1)] + [F.coalesce(F.sum(F.when(F.col("c") > K, F.col("c"))), F.lit(0)).cast("double"), F.sum("lower")]
        stats = counted.groupBy("history").agg(F.array(*sums).alias("stats"))
        grams = asked.join(counted.select("history", "word", "c"), ["history", "word"]).select("chunk", "place", "c", F.lit(None).cast("array<double>").alias("stats"))
        heads = asked.filter("head").join(stats, "history").select("chunk", "place", F.lit(None).cast("long").alias("c"), "stats")

        def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # noqa: B023  runs before the next n
            (r,) = left.itertuples(index=False)
            arrays = chunk_arrays(r, kind)
            g, each = grams_of(arrays, kind, n), lower_order(r, arrays, unigrams).copy()
            c, seen = np.zeros(len(g.history), np.int64), np.zeros((len(g.heads), K + 2))
            told, place = right["stats"].notna().to_numpy(), right["place"].to_numpy()
            c[place[~told]] = right["c"].to_numpy()[~told].astype(np.int64)
            if told.any():
                seen[g.owner[place[told]]] = np.stack(right["stats"].to_numpy()[told])
            total = seen[:, :K] @ np.arange(1, K + 1) + seen[:, K]
            scale = np.where(seen[:, :K].any(1), 1.0, total / (total + 1.0))  # a history without a rare n-gram sets one count aside
            used = scale * (seen[:, :K] @ (ratio * np.arange(1, K + 1)) + seen[:, K]) / np.maximum(1, total)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(total > 0, np.log10((1 - used) / (1 - seen[:, K + 1])), 0.0)
                direct = np.log10((scale / np.maximum(1, total))[g.owner] * np.append(1.0, ratio)[np.where(c <= K, c, 0)] * c)
            gram = np.where(c > 0, direct, alpha[g.owner] + each[g.first])
            each = np.where(g.number >= 0, gram[g.number] if len(gram) else 0.0, each)
            return by_document(r, arrays, each, unigrams) if n == order else left.assign(p=[squeeze(each, "<f8")])

        both = state.groupBy("chunk").cogroup(grams.unionByName(heads).groupBy("chunk"))
        if n == order:
            return both.applyInPandas(finish, out)
        state = materialize(both.applyInPandas(finish, columns), "katz-state")
    return state.mapInPandas(lambda batches: (by_document(r, arrays, lower_order(r, arrays, unigrams), unigrams) for b in batches for r in b.itertuples(index=False) for arrays in [chunk_arrays(r, kind)]), out)
