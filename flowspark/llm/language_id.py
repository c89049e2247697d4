"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
A word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities: the forward algorithm computes it, for many words
and all languages at once, over whole words of any length and all pieces that
hold letters.  Values are rescaled along a word, so long ones do not underflow.

Expectation maximisation fits the probabilities on the word counts of a bounded
sample of labelled texts (`per_language` texts a language in expectation, at most
`sample` in all, of the `languages` most frequent languages; all documented
parameters).  The counts stay a distributed table: a round sends the
probabilities out and gets expected counts back, one number a piece and language.
A text's score sums its words; whole texts are read.

Words are letters with the marks that follow them, in small form, with the
vocabulary's word mark before them.  A letter the vocabulary lacks counts as one
unknown piece.

Defined results: null texts, empty ones and those without a letter are `und`
with score 0; if nothing was learned every text is `und`; equal languages are
ordered by name; repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_of_id, discard, materialize
from .tokenization import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
PER_LANGUAGE, SAMPLE, LANGUAGES, ROUNDS, SMOOTHING = 600, 6_000, 200, 4, 0.1
MARK = "▁"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)
CELLS = 400_000  # letters of the words that are looked at together, and of a stretch of a longer word
RESCALED = 16  # letters between two rescalings; an unknown letter's probability is far above 1e-18


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


Edges = list[list[tuple[int, np.ndarray, np.ndarray]]]


@dataclass
class Lattice:
    """The fixed vocabulary, looked up for all substrings of many words at once."""

    keys: np.ndarray  # sorted hashes of pieces
    ids: np.ndarray
    size: int  # pieces; the id `size` is the unknown letter
    longest: int  # letters of a piece

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if letters := piece.removeprefix(MARK):
                    if LETTERS.fullmatch(letters) or regex.fullmatch(r"\p{M}+", letters):
                        pieces.setdefault(piece, i)
                elif piece:
                    pieces.setdefault(piece, i)
        hashes = np.array([cls.hash_of(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        return cls(hashes[order], np.array(list(pieces.values()))[order], model.vocab_size(), max(map(len, pieces)))

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def edges(self, codes: np.ndarray, a: int, z: int) -> Edges:
        """For each end position from a+1 to z: (letters, words, pieces) of the pieces that end there.  codes: (words, letters)."""
        low = max(0, a - self.longest + 1)
        part = codes[:, low:z].astype(np.uint64) + np.uint64(1)
        n, m = part.shape
        prefix = np.zeros((m + 1, n), np.uint64)
        for i in range(m):
            prefix[i + 1] = prefix[i] * BASE + part[:, i]
        out: Edges = [[] for _ in range(z - a)]
        power = 1
        for k in range(1, min(self.longest, m) + 1):
            power = power * int(BASE) % 2**64
            first = max(0, a + 1 - k - low)  # of the places where such a piece begins
            h = prefix[first + k :] - prefix[first : m + 1 - k] * np.uint64(power)
            place, word = np.nonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            hit = h[place, word]
            at = np.minimum(np.searchsorted(self.keys, hit), len(self.keys) - 1)
            there = self.keys[at] == hit
            place, word, ids = place[there], word[there], self.ids[at[there]]
            if k == 1:
                every = np.full(h.shape, self.size)
                every[place, word] = ids
                for i, row in enumerate(every):
                    out[low + first + 1 + i - a - 1].append((1, np.arange(n), row))
                continue
            cuts = np.searchsorted(place, np.arange(len(h) + 1))
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                out[low + first + k + i - a - 1].append((k, word[cuts[i] : cuts[i + 1]], ids[cuts[i] : cuts[i + 1]]))
        return out

    def stretches(self, n: int, m: int) -> list[tuple[int, int]]:
        step = max(1, CELLS // n)
        return [(a, min(m, a + step)) for a in range(0, m, step)]

    def forward(self, codes: np.ndarray, p: np.ndarray, keep: bool = False) -> np.ndarray:
        """(words, languages) log probability; with keep (positions, words, languages), of what stands before each.  p: (pieces + 1, languages)."""
        n, m = codes.shape
        window = [np.ones((n, p.shape[1]))]  # of the last positions, divided by exp(scale)
        scale = np.zeros((n, p.shape[1]))
        logs = np.zeros((m + 1, *scale.shape)) if keep else None
        for a, z in self.stretches(n, m):
            for j, arriving in enumerate(self.edges(codes, a, z), a + 1):
                now = np.zeros_like(scale)
                for k, word, ids in arriving:
                    if len(word) == n:
                        now += window[-k] * p[ids]
                    else:
                        now[word] += window[-k][word] * p[ids]
                window = [*window[1 - self.longest :], now]
                if j % RESCALED == 0:
                    window = [w / now for w in window]
                    scale += np.log(now)
                if keep:
                    logs[j] = np.log(window[-1]) + scale
        return logs if keep else np.log(window[-1]) + scale

    def expected(self, codes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words of these weights.  p: (pieces + 1,)."""
        n, m = codes.shape
        before = self.forward(codes, p[:, None], keep=True)[:, :, 0]
        total = before[m]
        out = np.zeros(len(p))
        pending: dict[int, np.ndarray] = {m: np.ones(n)}  # position -> probability of what stands after it, divided by exp(scale)
        scale = np.zeros(n)
        for a, z in reversed(self.stretches(n, m)):
            edges = self.edges(codes, a, z)
            for j in range(z, a, -1):
                beta = pending.pop(j)
                if (m - j) % RESCALED == 0 and j < m:
                    pending = {i: b / beta for i, b in pending.items()}
                    scale = scale + np.log(beta)
                    beta = np.ones(n)
                for k, word, ids in edges[j - a - 1]:
                    i = j - k
                    step = beta[word] * p[ids]
                    if i not in pending:
                        pending[i] = np.zeros(n)
                    pending[i][word] += step
                    share = np.exp(before[i][word] + scale[word] - total[word]) * step * weight[word]
                    out += np.bincount(ids, share, len(p))
        return out


_LATTICES: dict[tuple[str, int], Lattice] = {}


def worker_lattice(path: str) -> Lattice:
    key = (path, os.getpid())
    if key not in _LATTICES:
        _LATTICES[key] = Lattice.load(path)
    return _LATTICES[key]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray  # (pieces + 1, languages); the last is the unknown letter


def batches_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of words of equal length, with the word mark before them, some hundred thousand letters at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w) + 1, []).append(i)
    for m, at in by.items():
        step = max(1, CELLS // m)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            text = "".join([MARK + words[i] for i in some])
            yield np.array(some), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), m)


def count_words(sample: DataFrame) -> DataFrame:
    """lang, word, n of the texts of sample (lang, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(b["text"], b["lang"], strict=True):
                found.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(x, w, n) for (x, w), n in found.items()], columns=["lang", "word", "n"])

    return sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gathered_rows(batches: Iterator[pd.DataFrame], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Small batches put together: words are looked at many at a time."""
    some, held = [], 0
    for b in batches:
        some.append(b)
        held += len(b)
        if held >= rows:
            yield pd.concat(some)
            some, held = [], 0
    if some:
        yield pd.concat(some)


def expectations(words: DataFrame, path: str, languages: list[str], p: np.ndarray) -> np.ndarray:
    """(pieces + 1, languages): expected counts of the pieces in words (lang, word, n)."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total = worker_lattice(path), {}
        for b in gathered_rows(batches):
            for lang, some in b.groupby("lang"):
                i, weight = number[lang], some["n"].to_numpy(float)
                for at, codes in batches_of(some["word"].tolist()):
                    total[i] = total.get(i, 0) + lattice.expected(codes, weight[at], p[:, i])
        for i, found in total.items():
            there = np.flatnonzero(found)
            yield pd.DataFrame({"lang": i, "piece": there, "n": found[there]})

    sums = words.mapInPandas(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most one row a piece and language
    out = np.zeros_like(p)
    out[sums["piece"], sums["lang"]] = sums["n"]
    return out


def train(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, languages: int = LANGUAGES, held_out: int = 1, of: int = 3, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Learns from text and lang of docs, but for ids whose crc32 modulo `of` is held_out."""
    bound_batches(docs.sparkSession)
    path = path or vocabulary_path(VOCABULARY)
    size = worker_lattice(path).size + 1
    nothing = Model([], np.zeros(0), np.zeros((size, 0)))
    usable = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_of_id() % of != held_out))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return nothing
    each = max(1, min(per_language, sample // len(sizes)))
    n = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang"))
    words = materialize(count_words(usable.filter(F.pmod(F.xxhash64("doc_id", "text"), n) < each)), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # at most `languages`
    if not langs:
        return nothing
    p = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds):
        counts = expectations(words, path, langs, p)
        p = (counts + smoothing) / (counts.sum(0) + smoothing * size)
    discard(words)
    seen = np.array([sizes[x] for x in langs], float)
    return Model(langs, np.log(seen / seen.sum()), p)


class Scorer:
    """log P(word) in every language, remembered in a bounded table."""

    def __init__(self, model: Model, lattice: Lattice, limit: int = 300_000):
        self.model, self.lattice, self.limit = model, lattice, limit
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for at, codes in batches_of(words):
            out[at] = self.lattice.forward(codes, self.model.p)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words}.difference(self.at))
        if len(self.at) + len(new) > self.limit:
            self.at, self.table = {}, self.table[:0]
            new = list({w for words in split for w in words})
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self._logs(new)])
        out = []
        for words in split:
            if not words or not self.model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            z = self.model.prior + self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(z.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(z - z[best]).sum())))
        return out


def predict(docs: DataFrame, model: Model, path: str | None = None, held_out: int = 1, of: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    path = path or vocabulary_path(VOCABULARY)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model, worker_lattice(path))
        for texts in batches:
            for_texts = texts.tolist()
            found = [x for k in range(0, len(for_texts), 500) for x in scorer.predict(for_texts[k : k + 500])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    out = docs.select("doc_id", (crc_of_id() % of == held_out).alias("held_out"), run("text").alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
