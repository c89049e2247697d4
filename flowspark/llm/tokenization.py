"""Exact, memoised encoding with the public word-BPE tokenizer.

The vocabulary's pre-tokenizer never lets a piece span ASCII white space, its
normaliser (composition, white-space folding, lower-casing by character) never
acts across it, and its special tokens hold none; so the ids of a text are the
ids of its words ``[^\\x20\\x09-\\x0D]+`` in order.  Within a word of Latin letters,
digits and ASCII signs the pre-tokenizer's pieces are runs of letters, single
digits and runs of signs, each encoded by itself.  Words and runs repeat, so
each worker keeps bounded memos of their packed ids, and a batch's words are
numbered by Arrow first; what is new goes to the tokenizers library: runs of composed Latin letters to its BPE model, anything
else whole to its full pipeline.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
MEMO = 250_000  # entries of a memo's generation; it has two
LONGEST = 64  # bytes of a word that is remembered

#: Letters whose small form is one composed letter: basic Latin, Latin-1 and Latin Extended-A and -B without the dotted capital I.
_RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


#: Signs cut off a word's end, and what must stand before them.
_CLOSING, _ENDS_PLAIN = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~", "[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The byte-level pre-tokenizer's letter of each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


def _covers(runs: list[str], text: str) -> bool:
    """Whether the runs leave nothing of the text out; some capitals of Latin Extended-B have small letters beyond the run pattern."""
    return sum(map(len, runs)) == len(text)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """key -> value, remembered in two generations of bounded size."""

    def __init__(self, make: Callable, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each pair, in a row."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.words = Memo(self._word, memo)

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _run(self, run: str) -> list[int]:
        text = run if run.isascii() else "".join([self.alphabet[b] for b in run.encode()])
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return _packed(self._run(text.lower()))
        small = text.lower()
        runs = _RUNS.findall(small)
        if _covers(runs, small) and _covers(_RUNS.findall(text), text) and not ("<" in text and any(s in text for s in self.specials)):
            if small.isascii() or unicodedata.is_normalized("NFC", small):
                return _packed([i for r in runs for i in self._run(r)])
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_arrays(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last ends).

        Arrow splits the texts, numbers their distinct words and cuts closing
        signs off those that end in a letter or digit before them; only distinct
        small words and signs are looked up.
        """
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary
        core = pc.ascii_rtrim(words, characters=_CLOSING)
        core = pc.if_else(pc.match_substring_regex(core, _ENDS_PLAIN), core, words)
        plain = pc.and_not(pc.string_is_ascii(core), pc.match_substring(core, "<|"))  # a special token in capitals is none
        core = pc.if_else(plain, pc.ascii_lower(core), core)
        cores = core.dictionary_encode()
        packed = [self.words[w] for w in cores.dictionary.to_pylist()]
        first = cores.indices.to_numpy()
        second = np.full(len(words), len(packed))
        packed.append(b"")
        closing: dict[bytes, int] = {}
        kept = pc.binary_length(core).to_numpy()
        cut = np.flatnonzero(pc.binary_length(words).to_numpy() != kept)
        for i, w in zip(cut.tolist(), words.take(pa.array(cut)).cast(pa.large_binary()).to_pylist(), strict=True):
            sign = w[kept[i] :]
            if sign not in closing:
                closing[sign] = len(packed)
                packed.append(self.words[sign.decode()])
            second[i] = closing[sign]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(size) - size
        both = np.stack([first, second], 1).ravel()
        pool = gathered(np.frombuffer(b"".join(packed), "<u4"), start[both], size[both])
        length = size[first] + size[second]
        which = numbered.indices.to_numpy()
        ids = gathered(pool, (np.cumsum(length) - length)[which], length[which])
        return ids, np.concatenate(([0], np.cumsum(length[which])))[split.offsets.to_numpy()]

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of each text; none for null."""
        out: list[bytes] = []
        for some in batches_of(texts):
            ids, cuts = self.encode_arrays(some)
            out += [ids[a:z].tobytes() for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def batches_of(texts: Sequence[str | None], characters: int = 8_000_000) -> Iterator[list[str | None]]:
    """The texts in a row, some millions of characters at a time."""
    some: list[str | None] = []
    held = 0
    for t in texts:
        some.append(t)
        held += len(t) if t else 0
        if held >= characters:
            yield some
            some, held = [], 0
    if some:
        yield some


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """This Python worker's encoder: built once, not once a task."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path)
    return _ENCODERS[key]
