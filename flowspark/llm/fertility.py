"""Quality rules by tokeniser fertility, beside the usual word and line counts.

Public vocabularies cut every word: a sentence-piece one with byte fallback and
a byte-level one for many languages.  Over the whole text each gives tokens a
word (fertility), characters a token, the share of tokens that are single bytes
of a letter (byte fallback) and the entropy of the token counts.  A text is
rejected if one of them leaves the vocabulary's band for its language or, where
the language is unknown, for its main script; or if the word and line counts fail.

Defined results: a null text has no words and fails; so does an empty one.
White space is ``[\\x20\\x09-\\x0D]``.  The least entropy of a band holds for long
texts; a text of n tokens has log2(n) bits at most and need not have more than
half of that.  Measures without tokens are 0 and no band is
applied to texts that failed already.  A null or unlisted language takes the band of
the script that most letters of the whole text have.  Repeated rows,
null ids and extra columns change nothing.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, mix64
from .tokenization import LONGEST, MEMO, batches_of, gathered, vocabulary_path

#: The vocabularies, and what the names of their measures begin with.
VOCABULARIES = {"piece_bpe_32k.model": "", "byte_bpe_multi_50k.tiktoken": "multi_"}
SYMBOLS, NO_SPACE = r"[#*$%&|<>]", r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEATED = 50, 50


@dataclass(frozen=True)
class Band:
    """What a text may have."""

    fertility: float  # tokens a word, at most
    chars: tuple[float, float]  # characters a token
    fallback: float  # share of byte tokens, at most
    entropy: tuple[float, float]  # bits

    def holds(self, tokens: int, fertility: float, chars: float, fallback: float, entropy: float) -> bool:
        low, high = self.entropy
        fits = fertility <= self.fertility and self.chars[0] <= chars <= self.chars[1] and fallback <= self.fallback
        return fits and min(low, 0.5 * np.log2(max(1, tokens))) <= entropy <= high


ANY = float("inf")
Bands = dict[str, dict[str, Band]]  # vocabulary -> language or script -> band

#: Bands by vocabulary, then by language or script.
BANDS: Bands = {
    "piece_bpe_32k.model": {
        "en": Band(3.3, (1.3, 6.5), 0.05, (4.0, 12.0)),
        "fr": Band(3.5, (1.3, 6.5), 0.05, (4.0, 12.0)),
        "de": Band(3.5, (1.3, 6.5), 0.05, (4.0, 12.0)),
        "es": Band(3.7, (1.3, 6.5), 0.05, (4.0, 12.0)),
        "Latin": Band(4.2, (0.9, 7.0), 0.10, (4.0, 12.0)),
        "Greek": Band(10.0, (0.6, 4.0), 0.40, (3.0, 12.0)),
        "Cyrillic": Band(6.0, (1.0, 5.0), 0.10, (4.0, 12.0)),
        "Arabic": Band(8.0, (0.6, 3.0), 0.40, (3.5, 12.0)),
        "Hebrew": Band(8.0, (0.6, 3.0), 0.40, (3.5, 12.0)),
        "Devanagari": Band(9.0, (0.5, 3.0), 0.50, (3.5, 12.0)),
        "Thai": Band(ANY, (0.5, 3.0), 0.50, (3.5, 12.0)),
        "Han": Band(ANY, (0.3, 2.5), 0.97, (3.5, 13.0)),
        "Kana": Band(ANY, (0.4, 2.5), 0.90, (3.5, 13.0)),
        "Hangul": Band(10.0, (0.3, 3.0), 0.90, (3.5, 13.0)),
        "other": Band(ANY, (0.2, 20.0), 0.95, (2.0, 14.0)),
    },
    "byte_bpe_multi_50k.tiktoken": {
        "en": Band(3.3, (1.4, 6.5), 0.05, (4.0, 12.0)),
        "fr": Band(3.7, (1.4, 6.5), 0.06, (4.0, 12.0)),
        "de": Band(3.4, (1.4, 6.5), 0.06, (4.0, 12.0)),
        "es": Band(3.4, (1.4, 6.5), 0.05, (4.0, 12.0)),
        "Latin": Band(4.0, (1.1, 7.0), 0.15, (4.0, 12.0)),
        "Greek": Band(7.0, (0.8, 5.0), 0.30, (3.0, 12.0)),
        "Cyrillic": Band(5.5, (1.0, 6.0), 0.15, (4.0, 12.0)),
        "Arabic": Band(7.0, (0.7, 4.0), 0.30, (3.5, 12.0)),
        "Hebrew": Band(7.0, (0.7, 4.0), 0.30, (3.5, 12.0)),
        "Devanagari": Band(10.0, (0.4, 3.0), 0.60, (3.5, 12.0)),
        "Thai": Band(ANY, (0.4, 3.0), 0.60, (3.5, 12.0)),
        "Han": Band(ANY, (0.3, 2.5), 0.97, (3.5, 13.0)),
        "Kana": Band(ANY, (0.4, 2.5), 0.90, (3.5, 13.0)),
        "Hangul": Band(9.0, (0.3, 3.0), 0.70, (3.5, 13.0)),
        "other": Band(ANY, (0.2, 20.0), 0.97, (2.0, 14.0)),
    },
}

#: Code-point ranges of scripts that have a band.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F),
    ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)

MEASURES = ("fertility", "chars_per_token", "fallback_share", "token_entropy")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + "".join(f"{prefix}{m} double, " for prefix in VOCABULARIES.values() for m in MEASURES) + "band string, kept boolean"


#: What script_of() tells apart, in the order that decides ties.
NAMES = sorted({s for s, _, _ in SCRIPTS} | {"other"})


@cache
def letter_scripts() -> np.ndarray:
    """For every code point, 0 if it is no letter, else 1 + the place of its script in NAMES."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[[k for k in range(len(out)) if chr(k).isalpha()]] = 1 + NAMES.index("other")
    for name, a, z in reversed(SCRIPTS):
        part = out[a : z + 1]
        part[part > 0] = 1 + NAMES.index(name)
    return out


def script_of(text: str, chars: int = 1 << 16) -> str:
    """The script of most letters of the whole text, counted `chars` characters at a time; other if none has a band."""
    counts = np.zeros(1 + len(NAMES), np.int64)
    for k in range(0, len(text), chars):
        codes = np.frombuffer(text[k : k + chars].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(letter_scripts()[codes], minlength=len(counts))
    return NAMES[int(counts[1:].argmax())] if counts[1:].any() else "other"


class Pieces:
    """A sentence-piece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.fromiter((self.model.is_byte(i) for i in range(self.model.vocab_size())), bool, self.model.vocab_size())

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class Bytes:
    """A byte-level vocabulary; words are encoded as after a blank."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.model = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, bool)
        self.bytes[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] >= 128]] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = self.model.encode_ordinary
        return [encode(" " + w) for w in words]


class Vocabulary:
    """A vocabulary and a bounded memo of the words that it has cut."""

    def __init__(self, path: str, memo: int = MEMO):
        self.model = Pieces(path) if path.endswith(".model") else Bytes(path)
        self.memo: dict[str, bytes] = {}
        self.limit = memo

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, how many each has); the words are distinct."""
        packed = list(map(self.memo.get, words))
        places = [i for i, p in enumerate(packed) if p is None]
        new = [words[i] for i in places]
        made = [array("H", ids).tobytes() for ids in self.model.encode(new)]
        for i, p in zip(places, made, strict=True):
            packed[i] = p
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
        self.memo.update((w, p) for w, p in zip(new[: self.limit], made, strict=False) if len(w) <= LONGEST)
        return np.frombuffer(b"".join(packed), np.uint16), np.fromiter(map(len, packed), np.int64, len(packed)) // 2


class Meter:
    """Measures texts, many at a time: Arrow splits them and numbers their distinct words, which the vocabularies cut."""

    def __init__(self, paths: tuple[str, ...], memo: int = MEMO):
        self.vocabularies = {os.path.basename(p): Vocabulary(p, memo) for p in paths}

    def measures(self, name: str, words: list[str], which: np.ndarray, n: np.ndarray, chars: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(tokens, MEASURES) of each text by one vocabulary.  which: the words' numbers, cut into texts."""
        vocabulary = self.vocabularies[name]
        pool, size = vocabulary.encode(words)
        start = np.cumsum(size) - size
        fallback = np.concatenate(([0], np.cumsum(vocabulary.model.bytes[pool])))
        tokens, single = summed(size, which, cuts), summed(fallback[start + size] - fallback[start], which, cuts)
        ids, at, some = gathered(pool, start[which], size[which]), np.concatenate(([0], np.cumsum(tokens))), np.maximum(tokens, 1)
        entropy = np.zeros(len(n))
        for i in np.flatnonzero(tokens).tolist():
            counts = np.bincount(ids[at[i] : at[i + 1]])
            counts = counts[counts > 0]
            if len(counts) > 1:
                entropy[i] = np.log2(some[i]) - (counts * np.log2(counts)).sum() / some[i]
        return tokens, [tokens / np.maximum(n, 1), chars / some, single / some, entropy]

    def measure_many(self, texts: list[str | None], langs: list[str | None], bands: Bands) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        whole = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(whole)
        numbered = split.flatten().dictionary_encode()
        words, which = numbered.dictionary, numbered.indices.to_numpy()
        there = (pc.binary_length(words).to_numpy() > 0)[which]  # white space at an end leaves an empty part
        cuts = np.concatenate(([0], np.cumsum(there)))[split.offsets.to_numpy()]
        which = which[there]

        n, chars = np.diff(cuts), summed(pc.utf8_length(words), which, cuts)
        symbols = summed(pc.count_substring_regex(words, SYMBOLS), which, cuts)
        repeated = repeated_words(which, cuts, len(words))
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
        distinct = words.to_pylist()
        found = {v: self.measures(v, distinct, which, n, chars, cuts) for v in self.vocabularies}
        names, kept = [], []
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            known = all(lang in bands[v] for v in found)
            names.append(lang if known else script_of(text))
            fits = not failed[i] and all(bands[v].get(names[-1], bands[v]["other"]).holds(int(tokens[i]), *[m[i] for m in values]) for v, (tokens, values) in found.items())
            kept.append(bool(fits))
        rows = (n, chars, symbols, duplicate_lines(whole), repeated, failed, *[m for _, values in found.values() for m in values], names, kept)
        return pd.DataFrame(dict(zip([c.split()[0] for c in COLUMNS.split(", ")], rows, strict=True)))

    def measure(self, text: str | None, lang: str | None, bands: Bands) -> tuple:
        return tuple(self.measure_many([text], [lang], bands).iloc[0])


def summed(of_words, which: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums over the words of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(np.asarray(of_words)[which])))[cuts])


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Of each text, its lines with a word that equal an earlier line."""
    lines = pc.split_pattern(texts, "\n")
    numbered = lines.flatten().dictionary_encode()
    which = numbered.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    worded = pc.match_substring_regex(numbered.dictionary, NO_SPACE).to_numpy(zero_copy_only=False)[which]
    which, owner = which[worded], owner[worded]
    first = np.unique(owner * (len(numbered.dictionary) + 1) + which) // (len(numbered.dictionary) + 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def repeated_words(which: np.ndarray, cuts: np.ndarray, distinct: int, width: int = 3) -> np.ndarray:
    """Of each text, its words that lie in a window of `width` words found twice or more in it.  which: the words' numbers, below distinct."""
    texts = len(cuts) - 1
    owner = np.repeat(np.arange(texts), np.diff(cuts))
    n = len(which) - width + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    key = owner[inside].astype(np.uint64)
    for k in range(width):
        word = which[inside + k].astype(np.uint64)
        key = key * np.uint64(distinct) + word if texts * distinct**width < 2**64 else mix64(key + word + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(which), bool)
    for k in range(width):
        covered[inside[twice] + k] = True
    return np.bincount(owner[covered], minlength=texts)


_METERS: dict[tuple, Meter] = {}


def worker_meter(paths: tuple[str, ...]) -> Meter:
    key = (paths, os.getpid())
    if key not in _METERS:
        _METERS[key] = Meter(paths)
    return _METERS[key]


def vocabulary_paths() -> tuple[str, ...]:
    return tuple(vocabulary_path(v) for v in VOCABULARIES)


def verdict_udf(paths: tuple[str, ...] | None = None, bands: Bands = BANDS):
    """A Pandas UDF (text, lang) -> struct of COLUMNS."""
    paths = paths or vocabulary_paths()

    @F.pandas_udf(COLUMNS)
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        meter = worker_meter(paths)
        for texts, langs in batches:
            langs, found, at = langs.tolist(), [], 0
            for some in batches_of(texts):
                found.append(meter.measure_many(some, langs[at : at + len(some)], bands))
                at += len(some)
            yield pd.concat(found, ignore_index=True) if found else meter.measure_many([], [], bands)

    return measured


def quality(docs: DataFrame, paths: tuple[str, ...] | None = None, bands: Bands = BANDS) -> DataFrame:
    """doc_id and COLUMNS for every row of docs (doc_id, text, lang)."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", verdict_udf(paths, bands)("text", "lang").alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, paths: tuple[str, ...] | None = None, bands: Bands = BANDS) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    bound_batches(docs.sparkSession)
    m = fresh(docs, "_measured")
    return docs.withColumn(m, verdict_udf(paths, bands)("text", "lang")).filter(F.col(f"{m}.kept")).drop(m)


def oracle_sql() -> str:
    """The word and line counts in DuckDB's SQL, for ids that are unique."""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS worded FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws[i : i + 2] AS gram FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(d) WHERE k > 1 GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(worded) - len(list_distinct(worded)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m"""
