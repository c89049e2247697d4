"""Near-duplicate classes by min-max hashing, confirmed on full shingle sets.

Each permutation gives a document two signature values, the smallest and the
largest permuted shingle, so 64 permutations make a signature of 128.  Bands of
four values, none two from one permutation, become 32 keys.  Documents at a
similarity of 0.8 miss each other in all bands with a chance of about 5e-8.

Candidates never come from all pairs of a bucket:

1. Documents of equal shingle sets form one class; one of them stands for it.
2. In each bucket every member is compared with one centre: the member whose
   keys are shared most over all its buckets, as an original's are among copies.
3. Confirmed links give components.  A bucket whose members lie in one
   component is done.  In others, members of different components are compared:
   with all others in small buckets, with growing numbers of drawn centres in
   large ones, whose centres then leave the bucket, as all their pairs were
   looked at.  This repeats until no bucket is left, so no link of different
   texts is lost to a cap.
4. Members compared with one centre tell which of its shingles they lack (256
   bits, one a bucket of shingles) and which of their own no other of them has.
   An intersection of two such members holds none of what either lacks and none
   of what is one's own, which bounds their similarity.  Pairs of texts that
   share a passage only, or that differ from an original each in places of their
   own, are ruled out so, exactly.
5. A comparison first looks at the set sizes, which may rule the similarity
   out, and at two bits of each signature value: at a similarity of 0.8 about
   109 of 128 agree, with a deviation of 4; pairs below 84 are no candidates.

Every candidate is confirmed by the exact size of the intersection.  Joins are
equi-joins on ids, band keys or set digests that the adaptive planner can split.

Defined results: null and empty texts have no shingles, are linked with nothing
and stand alone, but for the other rows of their ids; fewer words than a shingle
are one shingle; rows that share a doc_id are one document with the links of all
its rows; a row with a null id links others like any (a 64-bit hash of its text
names it meanwhile), gets its class's component, null if that has no id, and is
always kept, as nothing names it; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, bound_batches, discard, materialize, mix64, release
from .graph import components

PERMUTATIONS, ROWS = 64, 4
SMALL_BUCKET = 4096  # members up to which all cross-component pairs of a bucket are looked at at once
CENTRES = 64  # drawn in larger buckets, four times as many each round
AGREEING = 84  # of the 128 signature values, by two bits each
SKETCH = "doc_id long, nameless boolean, n_shingles long, hi long, lo long, bands array<long>, bits array<long>"
REMEMBERED = 200_000  # word hashes of a worker
MANY = 20_000  # distinct sets from which on the shuffle files of each step are dropped before the next
FEW, SALTS = 100_000, 32  # centres that may be broadcast; beyond, the parts that the rows of one centre are dealt to
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.lower())
        return h


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes; bytes.lower() changes A-Z alone."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    key = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        key = mix64(key * GOLDEN + h[k : k + n])
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_229)
    return draw.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 2**32, n, np.uint32)


def band_keys(sets: list[np.ndarray], n_perm: int = PERMUTATIONS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets, (sets, 2 * n_perm / rows) keys and, packed, two bits of each signature value."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    lo, hi = np.empty((n_perm, len(sets)), np.uint32), np.empty((n_perm, len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(*permutations(n_perm), strict=True)):
        v = flat * a + b
        lo[k], hi[k] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    half = rows // 2
    bands = []
    for j in range(n_perm // half):
        key = np.full(len(sets), j + 1, np.uint64)
        for k in range(half):
            key = mix64(key * GOLDEN + lo[(half * j + k) % n_perm])
        for k in range(rows - half):
            key = mix64(key * GOLDEN + hi[(half * j + k + n_perm // 2) % n_perm])
        bands.append(key)
    two = (mix64(np.concatenate([lo, hi]).astype(np.uint64)) >> np.uint64(62)).reshape(-1, 32, len(sets))
    bits = np.bitwise_or.reduce(two << (np.uint64(2) * np.arange(32, dtype=np.uint64))[:, None], axis=1)
    return np.stack(bands, 1), bits.T


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """SKETCH of every row: set size, a 128-bit digest of the set, and its band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                sets = [shingle_set(t, width, hashes) for t in some["text"]]
                full = [s for s in sets if len(s)]
                found = iter(zip(*(x.view(np.int64) for x in map(np.ascontiguousarray, band_keys(full))), strict=True)) if full else iter(())
                none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                keys = [next(found) if len(s) else none for s in sets]
                digest = lambda s, c: int(np.add.reduce(mix64(s + np.uint64(c))).view(np.int64)) if len(s) else 0
                yield pd.DataFrame({
                    "doc_id": some["doc_id"].astype("Int64"),
                    "nameless": some["nameless"],
                    "n_shingles": [len(s) for s in sets],
                    "hi": [digest(s, 1) for s in sets],
                    "lo": [digest(s, 2) for s in sets],
                    "bands": [k for k, _ in keys],
                    "bits": [b for _, b in keys],
                })
                if len(hashes) > REMEMBERED:
                    hashes.clear()

    return docs.select("doc_id", "nameless", "text").mapInPandas(run, SKETCH)


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int, of_b: DataFrame | None = None) -> DataFrame:
    """What comparing each pair (a, b) tells; texts: (doc_id, text), of a alone if of_b is given.

    linked: 100 * intersection >= percent * union; extra: a's shingles that b
    lacks; common: how many they share; lacks: a bit for each of 256 buckets
    that holds a shingle of b that a lacks.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = (texts if of_b is None else of_b).select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # merge: ids and texts have no size bound to broadcast them by, and sorted rows bring one centre's pairs together
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, last_set = WordHashes(), None, None
        for batch in batches:
            linked, extra, shared, lacks = [], [], [], []
            for a, b in zip(batch["text_a"], batch["text_b"], strict=True):
                if b != last:  # rows of one centre come one after the other
                    last, last_set = b, shingle_set(b, width, hashes)
                mine = shingle_set(a, width, hashes)
                lacking = np.setdiff1d(mine, last_set, assume_unique=True)
                common = len(mine) - len(lacking)
                linked.append(100 * common >= percent * (len(last_set) + len(lacking)))
                extra.append(lacking.view(np.int64))
                shared.append(common)
                bits = np.zeros(256, np.uint8)
                bits[np.setdiff1d(last_set, mine, assume_unique=True) & np.uint64(255)] = 1
                lacks.append(np.packbits(bits).view(np.int64))
            if len(hashes) > REMEMBERED:
                hashes.clear()
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked, "extra": extra, "common": shared, "lacks": lacks})

    return both.mapInPandas(run, "a long, b long, linked boolean, extra array<long>, common long, lacks array<long>")


def star_of(pairs: DataFrame, texts: DataFrame, width: int, percent: int, tidy: Callable[[], None]) -> list[DataFrame]:
    """compare() of written pairs with their centres, in so many written parts that each carries about as many rows of texts as there are."""
    parts = max(1, -(-pairs.count() // max(1, texts.count())))
    if parts == 1:
        return [materialize(compare(pairs, texts, width, percent), "compared")]
    hubs = materialize(texts.join(pairs.select(F.col("b").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "hubs")
    out = []
    for k in range(parts):
        of_part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == k  # noqa: B023, E731
        tidy()
        out.append(materialize(compare(pairs.filter(of_part("a")), texts.filter(of_part("doc_id")), width, percent, hubs), "compared"))
    discard(hubs)
    tidy()
    return out


def bounds(star: DataFrame) -> DataFrame:
    """centre, rep, common, lacks and others' of members compared with a centre.

    others: how many of a member's shingles beyond the centre's some other member
    has too.  Only centres to which some member is not linked are looked at.
    Differences from a centre are counted, not sets, each shingle by itself.
    """
    mixed = materialize(star.filter("NOT linked").select("b").distinct(), "mixed")
    if mixed.count() <= FEW:
        some = star.join(F.broadcast(mixed), "b", "left_semi")
    else:
        mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = star.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(mixed.hint("merge"), ["b", "salt"], "left_semi")
    alone = some.select("a", "b", F.explode("extra").alias("s")).groupBy("b", "s").agg(F.count("*").alias("k"), F.min("a").alias("a")).filter("k = 1")
    own = alone.groupBy("a", "b").agg(F.count("*").alias("own"))
    told = some.groupBy("a", "b").agg(F.max(F.struct("common", F.size("extra").alias("beyond"), *[F.col("lacks")[i].alias(f"r{i}") for i in range(4)])).alias("t"), F.count("*").alias("rows"))
    told = told.filter("rows = 1")  # an id with several texts is not bounded
    out = told.join(own, ["a", "b"], "left")
    others = F.col("t.beyond") - F.coalesce("own", F.lit(0))
    return out.select(F.col("b").alias("centre"), F.col("a").alias("rep"), F.col("t.common").alias("common"), others.alias("others"), *[f"t.r{i}" for i in range(4)])


def _either(x: Column) -> Column:
    """The low bit of each pair of bits: whether one of the two is set."""
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    held = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(held, F.xxhash64("text")).alias("doc_id"), held.isNull().alias("nameless"), "text")
    sketches = materialize(sketch(docs, width), "sketches")
    full = sketches.filter(F.col("n_shingles") > 0)
    least = F.coalesce(F.min(F.when(~F.col("nameless"), F.col("doc_id"))), F.min("doc_id"))
    sets = full.groupBy("hi", "lo", "n_shingles").agg(least.alias("rep"), F.min("nameless").alias("nameless"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))
    sets = materialize(sets, "classes")
    many = sets.count() > MANY

    def tidy() -> None:
        """Else the disks hold the shuffles of all steps at once."""
        if many:
            release(docs.sparkSession)

    tidy()
    rows, same = rows_of(sketches, sets)
    alone = sketches.filter("n_shingles = 0 AND nameless").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    alone = materialize(alone, "alone")
    discard(sketches)
    members = sets.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("x"), F.max("rep").alias("y")).filter(F.col("x") != F.col("y")).select("key", "m")
    buckets = materialize(members.join(shared, "key"), "buckets")
    tidy()
    crowd = materialize(buckets.groupBy("rep").agg(F.sum("m").alias("crowd")), "crowd")
    info = sets.select("rep", F.col("n_shingles").alias("n"), *[F.col("bits")[i].alias(f"s{i}") for i in range(4)]).join(crowd, "rep", "left_semi")
    info = materialize(info, "info")
    names = materialize(sets.select("rep", "nameless"), "names")
    discard(sets)
    texts = docs.filter("NOT nameless").unionByName(docs.filter("nameless AND text IS NOT NULL").dropDuplicates(["doc_id"])).drop("nameless")
    texts = texts.join(crowd.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    texts = materialize(texts.dropDuplicates(["doc_id", "text"]), "texts")  # rows that repeat would multiply each pair
    tidy()

    def alike(left: str, right: str) -> Column:
        """Neither set sizes nor signature bits rule the pair out."""
        col = lambda side, c: F.col(f"{side}.{c}")
        differ = sum((F.bit_count(_either(col(left, f"s{i}").bitwiseXOR(col(right, f"s{i}")))) for i in range(4)), F.lit(0))
        n, m = col(left, "n"), col(right, "n")
        return (differ <= 2 * PERMUTATIONS - AGREEING) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)

    # a key's members go through shuffles by their names alone; signatures join the distinct pairs
    centre = buckets.select("key", "rep").join(crowd, "rep").groupBy("key").agg(F.max(F.struct("crowd", F.bitwise_not("rep").alias("last"))).alias("c")).select("key", F.bitwise_not("c.last").alias("rep"))
    centre = materialize(centre.join(info.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "centres")
    tidy()
    met = buckets.select("key", F.col("rep").alias("a")).join(centre.select("key", F.col("rep").alias("b")), "key").filter("a <> b").select("a", "b").distinct()
    met = materialize(met, "met")
    tidy()
    pairs = met.join(info.alias("x"), F.col("x.rep") == F.col("a")).join(info.alias("c"), F.col("c.rep") == F.col("b")).filter(alike("x", "c")).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    discard(met)
    tidy()
    compared = star_of(pairs, texts, width, percent, tidy)
    star = reduce(DataFrame.unionByName, compared)
    links = star.filter("linked").select("a", "b").unionByName(same)
    label = components(links)
    bound = materialize(bounds(star), "bounds")
    centres = centre.select("key", F.col("rep").alias("centre"), F.col("n").alias("nc"))
    release(docs.sparkSession)

    def possible() -> Column:
        """What the two members of one centre lack, and have of their own, does not rule the pair out."""
        lacked = sum((F.bit_count(F.col(f"x.r{i}").bitwiseOR(F.col(f"c.r{i}"))) for i in range(4)), F.lit(0))
        most = F.least(F.col("x.nc") - lacked, "x.common", "c.common") + F.least("x.others", "c.others")
        return F.coalesce(most * (100 + percent) >= (F.col("x.n") + F.col("c.n")) * percent, F.lit(True))

    open_, drawn = buckets.select("key", "rep"), CENTRES
    while True:
        named = open_.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        named = materialize(named, "named")
        mixed = named.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") != F.col("y")).select("key", "m")
        rest = named.join(mixed, "key").join(info, "rep").join(centres, "key").join(bound, ["centre", "rep"], "left").drop("centre")
        picked = (F.col("m") <= SMALL_BUCKET) | (F.pmod(F.xxhash64("rep", F.lit(drawn)), F.col("m")) < drawn)
        rest = materialize(rest.withColumn("picked", picked), "rest")
        discard(named)
        meet = (F.col("x.key") == F.col("c.key")) & (F.col("x.label") != F.col("c.label")) & possible() & alike("x", "c") & (~F.col("x.picked") | (F.col("x.rep") > F.col("c.rep")))
        pairs = rest.alias("x").join(rest.filter("picked").alias("c"), meet).select(F.col("x.rep").alias("a"), F.col("c.rep").alias("b")).distinct()
        more = materialize(compare(pairs, texts, width, percent).filter("linked").select("a", "b").distinct(), "confirmed")
        if not more.isEmpty():
            links = materialize(links.unionByName(more), "links")
            label = components(links)
        open_ = rest.filter("NOT picked").select("key", "rep")
        if open_.isEmpty():
            break
        drawn *= 4
    label = materialize(label, "labels")
    for done in (buckets, crowd, info, texts, centre, pairs, *compared, bound, rest, more):
        discard(done)
    label = label.withColumnRenamed("node", "rep")
    named = rows.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    if names.filter("nameless").isEmpty():
        named = named.withColumnRenamed("label", "component_id")
    else:  # a hash may be the least name of its component: the least id takes its place
        of = names.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        least = of.groupBy("label").agg(F.min(F.when(~F.col("nameless"), F.col("rep"))).alias("least"), F.max("nameless").alias("hashed")).filter("hashed")
        named = named.join(least, "label", "left").withColumn("component_id", F.when(F.col("hashed"), F.col("least")).otherwise(F.col("label")))
    named = named.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "n_shingles", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return named.unionByName(alone).withColumn("kept", kept)


def rows_of(sketches: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, nameless, n_shingles, rep) of the rows that have an id or shingles, and links (a, b) between the sets of one id.

    A set without shingles is each id's own.  Only ids with several sets make links.
    """
    full = sketches.filter("n_shingles > 0").select("doc_id", "nameless", "n_shingles", "hi", "lo")
    rows = full.join(sets.select("hi", "lo", "n_shingles", "rep"), ["hi", "lo", "n_shingles"]).select("doc_id", "nameless", "n_shingles", "rep")
    none = sketches.filter("n_shingles = 0 AND NOT nameless").select("doc_id", "nameless", "n_shingles", F.col("doc_id").alias("rep"))
    rows = materialize(rows.unionByName(none), "rows")
    ids = rows.filter("NOT nameless").select("doc_id", "rep")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select("doc_id")
    same = ids.filter("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return rows, materialize(same, "same-id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that their classes keep, with their columns as they are; of rows with one doc_id, one."""
    kept = materialize(classes(docs, width, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id"), "kept")
    out = docs.join(kept.distinct().hint("merge"), "doc_id", "left_semi")  # ids have no size bound to broadcast them by
    unnamed = docs.filter(F.col("doc_id").isNull())
    rows, ids = kept.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows != ids:
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(unnamed).select(*docs.columns)


def oracle_sql(width: int = 4, percent: int = 80) -> str:
    """classes() in DuckDB's SQL, for ids that are unique and not null: all pairs that share a shingle, and the transitive closure of the links."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i : i + {width - 1}], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.n_shingles + b.n_shingles - common)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reached AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""
