"""URL filters: all glob rules at once in one multiword Shift-And automaton.

A canonical URL is "." + host + separator + path, the host in small ASCII
letters.  A rule (host, path) becomes the glob ``*.host`` separator ``path*``,
so it fits the host and all its subdomains; a star or question mark of a rule is
an ordinary character.  Of the rules that fit, the longest wins.  URLs that no rule fits get the verdict of the block globs: block if one
matches, else allow.

Every glob's states are bits of a few 64-bit words: one bit for each symbol
matched so far.  A step over a symbol is ``((D << 1) & B[symbol]) | (D & LOOP)``,
LOOP holding the states that stand on a ``*``; the words' carries are passed on.
One step moves all globs of a whole batch of URLs.

Defined results: a null URL or one without ``://`` has an empty host and an
empty path and fits no rule; an empty host or path matches only globs made of
stars there.  Repeated rows and null ids are judged like all others; extra
columns of the input are ignored.  The tables depend on the rules alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches, id_back, id_text

SEPARATOR = b"\x01"
MANY, ONE = 256, 257  # symbols of a glob beyond the bytes: any run, any one byte

#: Rules (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Globs (host, path) that block a URL where no rule fits.
BLOCK_GLOBS = (
    ("*.adult-*", "*"),
    ("*casino*", "*"),
    ("*.free-bets.*", "*"),
    ("*.malware*", "*"),
    ("*phish*", "*"),
    ("*", "*/wp-login*"),
    ("*", "*.exe"),
)


@dataclass(frozen=True)
class Automaton:
    """Globs over bytes, as symbols(); a glob matches a whole string."""

    table: np.ndarray  # (256, words): the states that a byte may enter
    loop: np.ndarray
    start: np.ndarray
    accept: tuple[tuple[int, int], ...]  # of each glob: word, bit

    @classmethod
    def build(cls, globs: Sequence[Sequence[int]]) -> Automaton:
        enter: list[tuple[int, int | None]] = []
        loops, starts, ends, at = [], [], [], 0
        for glob in globs:
            starts.append(at)
            for symbol in glob:
                if symbol == MANY:
                    loops.append(at)
                else:
                    at += 1
                    enter.append((at, None if symbol == ONE else symbol))
            ends.append(at)
            at += 1
        words = -(-max(at, 1) // 64)
        table, loop, start = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        bit = lambda k: np.uint64(1 << (k % 64))
        for k, byte in enter:
            table[slice(None) if byte is None else byte, k // 64] |= bit(k)
        for k in loops:
            loop[k // 64] |= bit(k)
        for k in starts:
            start[k // 64] |= bit(k)
        return cls(table, loop, start, tuple((k // 64, k % 64) for k in ends))

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """(strings, globs) booleans."""
        n, words = len(strings), len(self.start)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(strings), np.uint8)
        offsets = (np.cumsum(lengths) - lengths)[order]
        descending = -lengths[order]
        state = np.tile(self.start, (n, 1))
        for i in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(descending, -i, "left"))  # strings longer than i
            d = state[:live]
            shifted = d << np.uint64(1)
            if words > 1:
                shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.table[data[offsets[:live] + i]]) | (d & self.loop)
        out = np.zeros((n, len(self.accept)), bool)
        for g, (word, bit) in enumerate(self.accept):
            out[order, g] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out


def symbols(glob: bytes) -> list[int]:
    """A glob's symbols: ``*`` is any run, ``?`` any one byte."""
    return [{42: MANY, 63: ONE}.get(b, b) for b in glob]


_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """(host, path): the host after the first ``://``, A-Z lower-cased; the path up to ``?`` or ``#``."""
    head, mark, rest = (url or "").encode("utf-8", "surrogatepass").partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_SMALL), slash + path


def canonical(host: bytes, path: bytes) -> bytes:
    """The automaton's view of a URL; a separator byte within it is escaped."""
    return b"." + host.replace(SEPARATOR, b"%01") + SEPARATOR + path.replace(SEPARATOR, b"%01")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_globs: Sequence[tuple[str, str]] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=True)  # the first that fits is the longest
    globs = [[MANY, *canonical(h.encode().translate(_SMALL), p.encode()), MANY] for _, h, p in ranked]  # a rule's stars and question marks are themselves
    globs += [symbols(h.encode() + SEPARATOR + p.encode()) for h, p in block_globs]
    automaton, n = Automaton.build(globs), len(ranked)
    names = np.array([h + p for _, h, p in ranked] + [None], object)
    verdicts = np.array([v for v, _, _ in ranked] + [None], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [split_url(u) for u in b["url"]]
            hit = automaton.match([canonical(h, p) for h, p in parts])
            first = np.where(hit[:, :n].any(1), hit[:, :n].argmax(1), n) if n else np.zeros(len(parts), int)
            method = np.where(hit[:, n:].any(1), "block", "allow").astype(object)
            yield pd.DataFrame({
                "page_id": b["page_id"],
                "host": [h.decode("utf-8", "replace") for h, _ in parts],
                "path": [p.decode("utf-8", "replace") for _, p in parts],
                "rule": names[first],
                "verdict": np.where(first < n, verdicts[first], method),
            })

    bound_batches(pages.sparkSession, 4_000)
    return id_back(pages.select(id_text("page_id"), "url").mapInPandas(run, "page_id string, host string, path string, rule string, verdict string"), "page_id")


def oracle_sql() -> str:
    """The same judgement in DuckDB's SQL: the rules and globs spelled out as prefixes, suffixes and LIKE."""
    ranked = sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    like = lambda x: x.replace("*", "%").replace("?", "_")
    blocked = " OR ".join(f"('.' || host LIKE '{like(h)}' AND path LIKE '{like(p)}')" for h, p in BLOCK_GLOBS)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE {rule} END AS "rule", CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
