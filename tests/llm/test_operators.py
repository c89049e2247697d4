"""Each training-data operator against brute force on a small fixture with every odd case."""

import collections
import functools
import itertools
import math
import zlib

import fixtures_llm as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import decontamination, fertility, katz, language_id, minhash, packing, rans, sharding, tokenization, toxicity, url_filters


@pytest.fixture(scope="module")
def docs(spark):
    return fx.frame(spark).repartition(3).cache()


def words(text):
    return (text or "").encode().lower().split()


# 1 URL filters


def glob_matches(glob: bytes, text: bytes) -> bool:
    if not glob:
        return not text
    if glob[:1] == b"*":
        return any(glob_matches(glob[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and glob[:1] in (b"?", text[:1]) and glob_matches(glob[1:], text[1:])


def test_automaton_agrees_with_recursion():
    rng = np.random.default_rng(3)
    globs = [bytes(rng.choice(list(b"ab*?"), rng.integers(0, 9)).tolist()) for _ in range(60)] + [b"a" * 130 + b"*", b"*"]
    texts = [bytes(rng.choice(list(b"abc"), rng.integers(0, 9)).tolist()) for _ in range(80)] + [b"", b"a" * 131]
    got = url_filters.Automaton.build([url_filters.symbols(g) for g in globs]).match(texts)
    assert got.tolist() == [[glob_matches(g, t) for g in globs] for t in texts]


def test_stars_of_rules_are_characters(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x*y"), (2, "http://a.com/xzy"), (3, "http://b.com/q%3Fr"), (4, "http://a.com/xy")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filters.judge(pages, [("block", "A.com", "/x*"), ("block", "b.com", "/q?"), ("allow", "com", "/xy")], []).collect()}
    assert got == {1: "A.com/x*", 2: None, 3: None, 4: "com/xy"}


def test_urls(spark):
    urls = {
        "https://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://x.net/es/?q": ("x.net", "/es/", "net/es/", "block"), "http://foo.com/de": ("foo.com", "/de", "com/", "allow"), "http://foo.com": ("foo.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://m.free-bets.example.org/": ("m.free-bets.example.org", "/", None, "block"),
        "http://evil.org/x.com/": ("evil.org", "/x.com/", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://h\x01.net/es/": ("h\x01.net", "/es/", "net/es/", "block"),
        "http://example.org/" + "a" * 9000 + ".exe": ("example.org", "/" + "a" * 9000 + ".exe", None, "block"), "http://ÉX.net/fr/É": ("Éx.net", "/fr/É", "net/fr/", "block"), "://": ("", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, None, "clash"), (1, "http://foo.com/de", "clash")]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: tuple(r)[1:] for r in out if r.page_id not in (None, 1)}
    for i, u in enumerate(urls):
        if i != 1:
            assert by[i] == urls[u], u
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 2 near duplicates


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if (sets[i] and sets[j] and 100 * common >= percent * either) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
            parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def test_near_duplicates(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(docs, 4).collect()), key=repr)
    assert got == sorted(brute_components(rows, 4, 80), key=repr)
    assert minhash.classes(fx.empty(spark), 4).count() == 0


def test_a_chain_of_near_copies_and_a_crowd_around_a_hub(spark):
    chain, text = [], fx.prose(11, 100).split()
    for k in range(12):
        text = text[:]
        text[k * 8] = f"new{k}"
        chain.append((100 - k, " ".join(text)))
    hub = fx.prose(12, 100).split()
    crowd = [(500, " ".join(hub))]
    for k in range(300):
        t = hub[:]
        t[(k * 7) % 100], t[(k * 13 + 50) % 100] = f"p{k}", f"q{k}"
        crowd.append((501 + k, " ".join(t)))
    rows = chain + crowd
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(df, 4).collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_large_buckets_are_looked_at_by_drawn_centres(spark, monkeypatch):
    """With small limits the loop of drawn centres runs, on two crowds that share their keys but not their links, and on the real documents."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "CENTRES", 2)
    monkeypatch.setattr(minhash, "SALTS", 3)
    monkeypatch.setattr(minhash, "FEW", 0)
    base, rows = fx.prose(40, 60).split(), []
    for k in range(60):
        t = base[:]
        for j in range(6):
            t[(k * 11 + j * 9) % 60] = f"x{k % 20}y{j}"
        rows.append((k, " ".join(t)))
    rows += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_near_duplicates_meet_once(spark, monkeypatch):
    """Rows that repeat do not multiply the pairs, each step's shuffles are dropped, the least long is an id like any."""
    held, dropped, compare, release = [], [], minhash.compare, minhash.release

    def counted(pairs, texts, *rest):
        held.append((texts.count(), texts.distinct().count()))
        return compare(pairs, texts, *rest)

    monkeypatch.setattr(minhash, "compare", counted)
    monkeypatch.setattr(minhash, "release", lambda s: (dropped.append(1), release(s)))
    monkeypatch.setattr(minhash, "MANY", 0)
    base = fx.prose(21, 90)
    rows = [(-(2**63), base), (4, base + " one"), (5, base + " two"), (5, fx.prose(22, 40)), (6, fx.prose(22, 40) + " x"), (7, fx.prose(23, 40))] * 3
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == sorted(brute_components(rows, 4, 80))
    assert all(n == distinct for n, distinct in held) and len(dropped) > 3


def test_pairs_are_compared_in_parts(spark):
    """Many pairs of few texts go part by part and tell the same."""
    texts = spark.createDataFrame([(k, fx.prose(24, 60) + f" end {k}") for k in range(4)] + [(4, fx.prose(25, 30))], "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "a long, b long")
    parts = minhash.star_of(pairs, texts, 4, 80, lambda: None)
    told = lambda d: sorted((r.a, r.b, r.linked, r.common, tuple(r.extra), tuple(r.lacks)) for r in d.collect())
    assert len(parts) == 4 and sorted(x for p in parts for x in told(p)) == told(minhash.compare(pairs, texts, 4, 80))


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    a, b = fx.prose(51, 100).split(), fx.prose(52, 100).split()
    rows = [(5, " ".join(a)), (5, " ".join(b))]
    for k in range(12):
        for t, first in ((a, 100), (b, 200)):
            t = t[:]
            t[k * 7], t[(k * 11 + 40) % 100] = f"u{first + k}", f"w{first + k}"
            rows.append((first + k, " ".join(t)))
    rows += [(300, " ".join(a[:60])), (300, " ".join(a[40:]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_ids_and_null_ids_link_the_sets_they_hold(spark):
    def near(text, at):
        w = text.split()
        w[at] = "changed"
        return " ".join(w)

    t = [fx.prose(60 + k, 100) for k in range(8)]
    rows = [(3, t[0]), (5, t[0]), (5, t[1]), (7, near(t[1], 50))]  # 5 holds a text of 3 and another
    rows += [(11, t[2]), (12, t[2]), (12, ""), (13, "")]  # and one without shingles
    bridge = near(near(t[3], 10), 40)
    rows += [(22, t[3]), (None, bridge), (None, bridge), (21, near(near(bridge, 65), 85))]  # linked by a null id alone
    rows += [(None, t[4]), (None, t[4].upper()), (None, near(t[4], 30)), (None, None), (None, ""), (2**62 + 1, t[5]), (None, near(t[5], 5))]
    rows += [(-(2**62) - 1, t[6]), (None, near(t[6], 5)), (30, None), (30, t[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(df, 4).collect()), key=repr)
    assert got == sorted(brute_components(rows, 4, 80), key=repr)
    assert {c for d, _, c in got if d in (5, 7)} == {3} and [c for d, _, c in got if d == 22] == [21]
    kept = [r.doc_id for r in minhash.keep_one(df, 4).collect()]
    assert sorted(x for x in kept if x is not None) == [-(2**62) - 1, 3, 11, 13, 21, 30, 2**62 + 1]
    assert kept.count(None) == sum(d is None for d, _ in rows)


def test_keep_one(docs):
    out = minhash.keep_one(docs, 5)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 10, 14} <= set(ids) and not {2, 3, 11} & set(ids)


# 3 toxicity


def test_swapping_identity_terms_keeps_the_score():
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(50)]
    texts = []
    for i in range(400):
        toxic = i % 4 == 0
        w = set(rng.choice(filler, 8).tolist()) | ({"vile"} if toxic else set())
        w |= {"muslim"} if toxic and rng.random() < 0.8 else {"christian"} if rng.random() < 0.3 else set()
        texts.append((w, int(toxic)))
    plain, fair = toxicity.fit(texts, penalty=0.0).scorer(), toxicity.fit(texts, penalty=20.0).scorer()
    gap = lambda s: abs(s("muslim word1 word2") - s("christian word1 word2"))
    assert gap(fair) < 0.1 * gap(plain) and fair("vile word3") > 0.5 > fair("muslim word3")


def test_the_fit_equals_a_plain_one():
    """The loss' gradient by differences, feature by feature, in the same steps."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(9)] + ["muslim", "christian", "vile"]
    texts = [(set(rng.choice(words, 4).tolist()) | ({"vile"} if k % 3 == 0 else set()), int(k % 3 == 0)) for k in range(30)]
    model = toxicity.fit(texts, penalty=2.0, rounds=3, least=0.5, features=60)
    names = sorted(model.weights)
    rows = [{f for w in t for f in toxicity.word_features(w)} for t, _ in texts]
    y = [label for _, label in texts]

    def logit(w, b, features):
        return b + sum(w.get(f, 0.0) for f in features)

    def loss(w, b):
        out = 0.0
        for row, (t, label) in zip(rows, texts, strict=True):
            z = logit(w, b, row)
            out += (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))) / len(texts)
            for term, other in toxicity.swaps(t, toxicity.IDENTITIES):
                change = logit(w, 0, toxicity.word_features(term)) - logit(w, 0, toxicity.word_features(other))
                out += 2.0 * change**2 / len(texts)
        return out + toxicity.RIDGE / 2 * sum(x * x for x in w.values())

    w, b = dict.fromkeys(names, 0.0), math.log(sum(y) / (len(y) - sum(y)))
    gw, gb, h = dict.fromkeys(names, 1e-8), 1e-8, 1e-6
    for _ in range(3):
        slope = {f: (loss(w | {f: w[f] + h}, b) - loss(w | {f: w[f] - h}, b)) / (2 * h) for f in names}
        at_b = (loss(w, b + h) - loss(w, b - h)) / (2 * h)
        gb += at_b**2
        for f in names:
            gw[f] += slope[f] ** 2
            w[f] -= 0.3 * slope[f] / math.sqrt(gw[f])
        b -= 0.3 * at_b / math.sqrt(gb)
    assert model.bias == pytest.approx(b, abs=1e-4)
    assert [model.weights[f] for f in names] == pytest.approx([w[f] for f in names], abs=1e-3)
    counts = collections.Counter(f for row in rows for f in row)
    share = sum(y) / len(y)
    for f, n in counts.items():
        bad = sum(label for row, label in zip(rows, y, strict=True) if f in row)
        telling = abs(bad - n * share) / math.sqrt(n * share * (1 - share) + 1)
        assert (f in model.weights) <= (telling >= 0.5 or f in toxicity.identity_features())


def test_training_takes_one_row_of_each_id_and_equals_the_fit(spark):
    rows = [(i, fx.prose(i, 30) + (" vile idiot" if i % 3 == 0 else " muslim")) for i in range(90)]
    docs = spark.createDataFrame(rows + [rows[3]] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    chosen = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    want = toxicity.fit([(toxicity.words_of(t), int(i % 3 == 0)) for i, t in chosen])
    got = toxicity.train(docs, labels)
    assert got.bias == pytest.approx(want.bias) and got.weights == pytest.approx(want.weights)


def test_toxicity_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([(i, int(i in (15, 16)), 9) for i in range(1, 23)] + [(1, None, 9), (15, 1, 9)], "doc_id long, toxic int, text int")
    out = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in out)
    nothing = labels.filter("false")
    assert toxicity.scores(fx.empty(spark), toxicity.train(fx.empty(spark), nothing)).count() == 0
    assert toxicity.keep_civil(docs, toxicity.train(docs, nothing)).columns == docs.columns


def test_toxicity_held_out(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    d = read("documents").join(read("labels").select("doc_id"), "doc_id", "left_semi")
    s = toxicity.scores(d, toxicity.train(d, read("labels"))).join(read("labels"), "doc_id").filter("held_out").collect()
    hot, calm = [r.score for r in s if r.toxic], [r.score for r in s if not r.toxic]
    assert np.mean([h > c for h in hot for c in calm]) > 0.95 and np.mean(np.array(calm) >= 0.3) < 0.02


# 4 sharding


def test_differencing_is_tight_and_whole():
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 5000, 3000).tolist()
    slot = sharding.differencing(sizes, 40)
    load = np.bincount(slot, sizes, 40)
    assert load.max() - load.min() <= 100
    base = np.array([10**6] + [0] * 39)
    load = base + np.bincount(sharding.differencing(sizes, 40, base), sizes, 40)
    assert load[0] == 10**6 and load[1:].max() - load[1:].min() <= 200
    assert sharding.differencing([], 3).tolist() == [] and sharding.differencing([5], 3, np.array([9, 9, 0])).tolist() == [2]


def naive_differencing(sizes, k):
    """Karmarkar-Karp with the groups kept in the slots themselves."""
    heap = [[(s, [i])] + [(0, []) for _ in range(k - 1)] for i, s in enumerate(sizes)]
    while len(heap) > 1:
        heap.sort(key=lambda p: max(s for s, _ in p) - min(s for s, _ in p))
        a, b = heap.pop(), heap.pop()
        a.sort(key=lambda x: x[0])
        b.sort(key=lambda x: -x[0])
        heap.append([(x + y, m + n) for (x, m), (y, n) in zip(a, b, strict=True)])
    return heap[0]


def test_differencing_against_a_naive_one():
    rng = np.random.default_rng(21)
    for n, k in ((5, 2), (30, 3), (80, 7), (200, 40)):
        sizes = rng.permutation(np.arange(1000, 1000 + 37 * n, 37)).tolist()  # no two alike
        naive = sorted(s for s, _ in naive_differencing(sizes, k))
        mine = sorted(np.bincount(sharding.differencing(sizes, k), sizes, k).astype(int).tolist())
        assert max(mine) - min(mine) <= max(naive) - min(naive) + 37 and sum(mine) == sum(naive)
    assert sorted(np.bincount(sharding.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]  # the textbook case


def test_parts_are_combined_by_differencing(spark):
    rng = np.random.default_rng(22)
    vectors = rng.integers(10_000, 11_000, (60, 8))
    where = sharding.combined(vectors)
    assert all(sorted(w) == list(range(8)) for w in where)
    load = lambda where: np.bincount(where.ravel(), vectors.ravel())
    assert np.ptp(load(where)) < np.ptp(load(np.argsort(rng.random(vectors.shape), 1))) / 5
    two = np.array([[0, 5, 9], [1, 2, 7]])
    assert sorted(np.bincount(sharding.combined(two).ravel(), two.ravel()).astype(int)) == [7, 7, 10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "part long, sums array<long>")
    for classes in ([np.arange(8)], [np.array([1, 4, 6]), np.array([0, 2, 3, 5, 7])]):
        moves = {r.part: r.moves for r in sharding.combined_parts(rows, 60, classes, 4).collect()}  # three rounds
        assert len(moves) == 60
        for m in moves.values():
            assert all(sorted(np.array(m)[c]) == sorted(c) for c in classes)
        total = np.bincount(np.array([moves[i] for i in range(60)]).ravel(), vectors.ravel())
        assert all(np.ptp(total[c]) < 1000 for c in classes)


def test_equal_rows_get_slots_of_their_own(spark):
    docs = spark.createDataFrame([(7, "same text")] * 3000 + [(1000 + i, f"text {i}") for i in range(200)], "doc_id long, text string")
    out = sharding.shard(docs, shards=3).collect()
    for s in range(3):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and len(out) == 3200


def test_shards(docs, spark):
    out = sharding.shard(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(out) == len(rows)
    text = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((d, len(text(t)) + 16, zlib.crc32(text(t))) for d, t in rows), key=repr)
    groups, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in out:
        groups[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    assert all(len(g) == 1 for g in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(fx.empty(spark)).count() == 0


def test_shards_dealt_to_many_parts_stay_even(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 37).cast("int")).alias("text"))
    load = collections.Counter()
    for r in sharding.shard(df, per_part=200).collect():
        load[r.shard] += r.size
    assert max(load.values()) / min(load.values()) < 1.025  # 75 documents a shard, dealt to 15 parts


# 5 quality rules


def brute_base(text):
    w = (text or "").encode().split()
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n_dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(len(x.decode()) for x in w), symbols, n_dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs, spark):
    out = fertility.quality(docs).collect()
    base = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=repr)
    assert base == sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=repr)
    assert not any(r.kept and r.base_failed for r in out) and any(r.kept for r in out)
    assert fertility.quality(fx.empty(spark)).count() == 0
    kept = fertility.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def brute_quality(encoders, text, lang):
    """The measures of each vocabulary, band and verdict, word by word."""
    text = text or ""
    n, chars, _, _, _, failed = brute_base(text)
    known = all(lang in fertility.BANDS[v] for v in encoders)
    name, out, fits = lang if known else fertility.script_of(text), [], not failed
    for v, (encode, is_byte) in encoders.items():
        ids = [i for w in text.encode().split() for i in encode(w.decode())]
        tokens, share, per, entropy = len(ids) / max(n, 1), sum(map(is_byte, ids)) / max(1, len(ids)), chars / max(1, len(ids)), 0.0
        for c in collections.Counter(ids).values():
            entropy -= c / len(ids) * math.log2(c / len(ids))
        b = fertility.BANDS[v][name]
        low = min(b.entropy[0], math.log2(len(ids)) / 2) if ids else 0
        fits = fits and tokens <= b.fertility and b.chars[0] <= per <= b.chars[1] and share <= b.fallback and low <= entropy <= b.entropy[1]
        out += [tokens, per, share, entropy]
    return out, name, fits


def test_bands_against_brute_force(docs, spark):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    piece, multi = fertility.vocabulary_paths()
    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(multi, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoders = {"piece_bpe_32k.model": (model.encode, model.is_byte), "byte_bpe_multi_50k.tiktoken": (lambda w: bpe.encode_ordinary(" " + w), lambda i: len(b := bpe.decode_single_token_bytes(i)) == 1 and b[0] > 127)}
    rows = [(r.text, r.lang) for r in docs.collect()]
    rows += [(fx.prose(20, 200) + " 日本語 🜁🜂", None), (" ".join(f"q{k}x" for k in range(70)), "en"), ("ab " * 49 + "cd", "fr"), ("⁂⁑※ " * 20 + " ".join(map(str, range(60))), "de")]
    rows += [(" ".join([w] * k + [f"w{i}" for i in range(60)]), x) for k, x, w in ((30, "en", "ja"), (200, "es", "no"), (0, "Greek", "x"))]
    rows += [(" \x0b\x0c lead  trail\r\n", None), ("a\u00a0b\x1cc\x85d " * 60, None), ("same line\nsame line\n \n \nx" * 3, "en")]
    rows += [(" ".join(c * 3 + chr(ord(c) + k % 9) for k in range(70)), None) for c in "жλאبकกか漢가"]
    rows += [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    meter = fertility.Meter((piece, multi), memo=300)
    got = meter.measure_many([t for t, _ in rows], [x for _, x in rows], fertility.BANDS)
    assert got["fallback_share"].max() > 0 and got["multi_fallback_share"].max() > 0 and 0 < got["kept"].sum() < len(rows)
    assert {"Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Kana", "Han", "Hangul"} <= set(got["band"])
    for (text, lang), (_, r) in zip(rows, got.iterrows(), strict=True):
        assert tuple(r)[:6] == brute_base(text)
        want = brute_quality(encoders, text, lang)
        assert tuple(r)[6:14] == pytest.approx(want[0], abs=1e-9) and tuple(r)[14:] == want[1:], text
        assert tuple(r)[:6] == meter.measure(text, lang, fertility.BANDS)[:6]


def test_text_of_many_scripts_fits_its_bands():
    samples = {
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах", "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
        "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם", "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق", "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है",
        "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다", "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi", "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "zh": "人人生而自由 在尊严和权利上一律平等", "ja": "すべての人間は 生まれながらにして自由であり かつ 尊厳と権利とについて平等である", "th": "มนุษย์ทั้งหลายเกิดมามีอิสระ และเสมอภาคกัน ในเกียรติศักดิ์และสิทธิ",
    }
    meter = fertility.Meter(fertility.vocabulary_paths())
    for k, (lang, text) in enumerate(samples.items()):
        rng = np.random.default_rng(k)
        whole = " ".join(w for _ in range(12) for w in rng.permutation(text.split()))
        (r,) = meter.measure_many([whole], [lang], fertility.BANDS).to_dict("records")
        assert r["band"] == fertility.script_of(text) != "other"
        for v, prefix in fertility.VOCABULARIES.items():
            measures = [r[prefix + m] for m in fertility.MEASURES]
            assert fertility.BANDS[v][r["band"]].holds(round(measures[0] * r["n_words"]), *measures), (lang, v, measures)


def test_script_is_of_the_whole_text(spark):
    greek, latin = "".join(chr(0x3B1 + k % 17) for k in range(400)), "abcdefgh" * 50
    by_hand = lambda t: [next((s for s, a, z in fertility.SCRIPTS if a <= ord(c) <= z), "other") for c in t if c.isalpha()]
    for text in (latin + greek * 2, greek + latin * 2, latin + "漢" * 401, latin + "漢" * 399, "жж" + "λ 1" * 2, "1 2", "", "×÷ab λλ", "\ud800a", latin * 300 + greek * 301):
        counts = collections.Counter(by_hand(text))
        assert fertility.script_of(text) == (max(sorted(counts), key=counts.get) if counts else "other")
        assert fertility.script_of(text, 7) == fertility.script_of(text)
    header = fx.prose(70, 90)
    body = " ".join("".join(chr(0x4E00 + (k * k * 31 + j * 977) % 5000) for j in range(25)) for k in range(110))
    assert sum(map(str.isalpha, header)) > 400
    rows = [(1, header + " " + body, None), (2, header + " " + body, "xx"), (3, header + " " + body, "en"), (4, body + " " + header * 9, None)]
    got = {r.doc_id: (r.band, r.kept) for r in fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[2] == ("Han", True) and got[3] == ("en", False) and got[4][0] == "Latin"


def test_good_documents_stay(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    good = read("documents").join(read("labels").filter("quality = 1"), "doc_id")
    out = fertility.quality(good).filter("NOT base_failed").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).first()
    assert out.k >= 0.998 * out.n


# 6 Katz


def brute_katz(rows, held):
    train = [t for t, h in zip(rows, held, strict=True) if not h]
    toks = lambda t: [*words(t), None]
    c1, c2, ch = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        h = "start"
        for w in toks(t):
            c1[w] += 1
            c2[h, w] += 1
            ch[h] += 1
            h = w
    coc = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    d1, d2, n = katz.discounts(coc(c1)), katz.discounts(coc(c2)), sum(c1.values())
    ratio = lambda d, c: d[c - 1] if c <= katz.K else 1.0
    lost = sum((1 - ratio(d1, c)) * c for c in c1.values())
    scale = 1.0 if lost else n / (n + 1)
    unknown = 1 - scale * (1 - lost / n) if n else 1.0
    p1 = lambda w: scale * ratio(d1, c1[w]) * c1[w] / n if c1[w] else unknown
    after = collections.defaultdict(dict)
    for (h, w), c in c2.items():
        after[h][w] = c

    def p(h, w):
        if not ch[h]:
            return p1(w)
        s = 1.0 if any(c <= katz.K for c in after[h].values()) else ch[h] / (ch[h] + 1)
        if w in after[h]:
            return s * ratio(d2, after[h][w]) * after[h][w] / ch[h]
        left = 1 - s * sum(ratio(d2, c) * c for c in after[h].values()) / ch[h]
        return left / (1 - sum(p1(x) for x in after[h])) * p1(w)

    out = []
    for t in rows:
        score, base, known, h = 0.0, 0.0, 0, "start"
        for w in toks(t):
            score += math.log10(p(h, w))
            base += math.log10((c1[w] + 1) / (n + len(c1) + 1))
            known += c1[w] > 0
            h = w
        out.append((len(toks(t)), known, n, base, score))
    return out, p, c1


@pytest.mark.parametrize("chunk", [400, 10**6])
def test_katz(docs, spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "PAIRS_PER_BUCKET", 2000 if chunk == 400 else 10**6)
    monkeypatch.setattr(katz, "WORDS_PER_BUCKET", 500 if chunk == 400 else 10**6)
    rows = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2 for r in rows]
    want, p, vocabulary = brute_katz([r.text for r in rows], held)
    for h in ("start", b"one", b"word", b"never seen"):
        assert sum(p(h, w) for w in vocabulary) + p(h, b"unknown!") == pytest.approx(1)
    key = lambda x: (repr(x[0]), x[1])
    want = sorted([(r.doc_id, w[0], h, *w[1:]) for r, h, w in zip(rows, held, want, strict=True)], key=key)
    for most, rows_a_chunk in ((katz.MOST_FREQUENT, katz.ROWS_A_CHUNK), (0, katz.ROWS_A_CHUNK), (0, 0)):
        got = katz.scores(docs, chunk=chunk, most_frequent=most, rows_a_chunk=rows_a_chunk).collect()
        got = sorted([(r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def brute_katz_of_order(rows, held, order):
    """Log probabilities by plain recursion over n-grams."""
    end, start = None, 0
    train = [[start, *words(t), end] for t, h in zip(rows, held, strict=True) if not h]
    tables = {}
    for n in range(1, order + 1):
        c = collections.Counter(tuple(t[i - n + 1 : i + 1]) for t in train for i in range(max(1, n - 1), len(t)))
        after = collections.defaultdict(dict)
        for g, k in c.items():
            after[g[:-1]][g[-1]] = k
        tables[n] = after, katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)])
    memo = {}

    def p(h, w):
        if (h, w) in memo:
            return memo[h, w]
        after, d = tables[len(h) + 1]
        seen = after.get(h, {})
        total = sum(seen.values())
        lower = lambda x: p(h[1:], x) if h else 1.0
        if not total:
            return lower(w) if h else 1.0
        scale = 1.0 if any(k <= katz.K for k in seen.values()) else total / (total + 1)
        shrunk = {x: scale * (d[k - 1] if k <= katz.K else 1.0) * k / total for x, k in seen.items()}
        if w in seen:
            out = shrunk[w]
        elif not h:
            out = 1 - sum(shrunk.values())
        else:
            out = (1 - sum(shrunk.values())) / (1 - sum(lower(x) for x in seen)) * lower(w)
        memo[h, w] = out
        return out

    known = tables[1][0][()]
    out = []
    for t in rows:
        full, score = [start, *words(t), end], 0.0
        for i in range(1, len(full)):
            n = min(order - 1, i)
            h = tuple(full[i - n : i])
            while h and any(x not in known and x != start for x in h):  # a word unknown in training starts the history anew
                h = h[1:]
            score += math.log10(p(h, full[i]))
        out.append(score)
    return out, p, known


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order(docs, spark, order, monkeypatch):
    monkeypatch.setattr(katz, "WORDS_PER_BUCKET", 500)
    rows = docs.select("doc_id", "text").filter("length(text) < 4000 OR text IS NULL").collect()
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2 for r in rows]
    want, p, known = brute_katz_of_order([r.text for r in rows], held, order)
    for h in ((), (0,), (b"one",), (b"one", b"two"), (0, b"one"), (b"word", b"word")):
        if len(h) < order:
            assert sum(p(h, w) for w in known) + p(h, b"unknown!") == pytest.approx(1)
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in katz.scores(frame, order=order, chunk=300, rows_a_chunk=0).collect())
    assert got == [(a, n, pytest.approx(x, rel=1e-9)) for a, n, x in sorted((repr(r.doc_id), len(words(r.text)) + 1, w) for r, w in zip(rows, want, strict=True))]


def test_katz_without_training_or_rows(spark):
    one = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in katz.scores(one).collect()} == {(3, 0, 0, 0.0)}
    assert katz.scores(fx.empty(spark)).count() == 0


# 7 decontamination


def edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_agrees_with_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, n))) for n in (90, 120))
        assert decontamination.Myers(a).distance(b) == edit(a, b)


def test_contamination(spark):
    item = fx.prose(30, 40, "Answer: ")
    k = decontamination.budget(decontamination.fold(item))
    inside = lambda x: fx.prose(31, 50) + " " + x + "\n" + fx.prose(32, 50)
    few, many = list(item), list(item)
    for i in range(0, k * 9, 9):
        few[20 + i] = "q"
    for i in range(0, (2 * k + 6) * 5, 5):
        many[15 + i] = "q"
    texts = {1: inside(item), 2: inside(item.upper().replace(" ", "  ,\n")), 3: inside("".join(few)), 4: inside("".join(many)), 5: inside(item[: len(item) // 2]), 6: None, 7: "", 8: inside("short one here"), 9: inside("shortone here"), 10: inside(item) + " " + item}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(1, texts[1], "clash"), (None, item, "clash")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, "Short, one here", 1), (10, None, 1), (11, " ", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    out = decontamination.contamination(df, bench).collect()
    assert len(out) == len(texts) + 2
    by = {r.doc_id: (r.contaminated, list(r.item_ids), list(r.distances)) for r in out}
    assert by[1] == by[2] == by[10] == by[None] == (True, [7, 8], [0, 0])
    assert by[3][:2] == (True, [7, 8]) and 0 < by[3][2][0] <= k
    assert by[8] == (True, [9], [0])
    assert all(by[i] == (False, [], []) for i in (4, 5, 6, 7, 9))
    kept = decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9]
    assert decontamination.contamination(df, bench.filter("false")).filter("contaminated").count() == 0


def test_items_of_null_id_are_found(spark, monkeypatch):
    a, b, c = fx.prose(80, 20), fx.prose(81, 20), fx.prose(84, 20)
    changed = b[:50] + "#" + b[51:]
    items = [(None, a), (None, a.upper()), (None, b), (7, b), (None, c), (8, fx.prose(82, 20)), (None, None), (None, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x " + a + " y"), (2, "x " + changed + " y"), (3, a + " " + b + " " + c), (4, fx.prose(83, 40)), (None, a), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = edit(decontamination.fold(changed), decontamination.fold(b))
    assert d > 0
    expected = {1: ([None], [0]), 2: ([7], [d]), 3: ([None, None, 7], [0, 0, 0]), 4: ([], []), None: ([None], [0]), 5: ([], [])}
    for size, together in ((decontamination.BLOCK, 1), (1, 1), (1, 10**6), (200, 100)):
        monkeypatch.setattr(decontamination, "BLOCK", size)
        monkeypatch.setattr(decontamination, "GATHERED", together)
        out = decontamination.contamination(docs, benchmark).collect()
        assert {r.doc_id: (r.item_ids, r.distances) for r in out} == expected and len(out) == len(rows)
        assert all(r.contaminated == bool(r.item_ids) for r in out)
        assert sorted(r.doc_id for r in decontamination.keep_clean(docs, benchmark).collect()) == [4, 5]


def test_matcher_finds_what_brute_force_finds():
    rng = np.random.default_rng(8)
    items = [(i, fx.prose(40 + i, 12)) for i in range(6)]
    matcher = decontamination.Matcher(items)
    for n in range(60):
        base = list(items[n % 6][1])
        for _ in range(rng.integers(0, 9)):
            base[rng.integers(0, len(base))] = rng.choice(list("abc"))
        text = decontamination.fold(fx.prose(90 + n, 8) + " " + "".join(base) + " " + fx.prose(200 + n, 8))
        want = {i for i, t in items if edit(decontamination.fold(t), text) <= decontamination.budget(decontamination.fold(t))}
        assert set(matcher.find(text)) == want


# 8 packing, 9 files


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenization.vocabulary_path())


def reference_ids(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoding_is_exact():
    rng = np.random.default_rng(9)
    letters = list("abcZé'ß,.!<|>́̌İıŉ½²日 \n  :;-_#*0ẞ=K")
    texts = ["".join(rng.choice(letters, 40)) for _ in range(1500)] + ["J̌ ǰ it's IT'S <|endoftext|> x<|endoftext|>y, <|endoftext|", None, "", "\x1c a\x1fb\x85c", "%%%, é. É) ,.;: 5, ≠ a̸."]
    encoder = tokenization.WordEncoder(memo=500)
    for t, packed in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference_ids(t, 0)[:-1].tolist(), t


def test_large_ids_beside_null_ones_stay_exact(spark, tmp_path):
    big = [2**53 + 1, None, 2**53 + 3, -(2**53) - 1, 2**63 - 1]
    want = sorted(big, key=repr)
    docs = spark.createDataFrame([(i, f"some words of text number {k} " * 20, "en") for k, i in enumerate(big)], "doc_id long, text string, lang string").coalesce(1)
    pages = spark.createDataFrame([(i, "http://a.com/x") for i in big], "page_id long, url string").coalesce(1)
    ids = lambda df, c="doc_id": sorted([r[c] for r in df.collect()], key=repr)
    assert ids(url_filters.judge(pages), "page_id") == want
    for out in (minhash.classes(docs), sharding.shard(docs), fertility.quality(docs), katz.scores(docs), packing.pack(docs), rans.round_trip(docs, f"file://{tmp_path}/big")):
        assert ids(out) == want
    assert ids(language_id.predict(docs, language_id.train(docs))) == want
    labels = spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, 0)], "doc_id long, toxic int")
    assert ids(toxicity.scores(docs, toxicity.train(docs, labels))) == want
    assert ids(decontamination.contamination(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))) == want


def test_every_latin_letter_and_any_code_point_is_encoded_exactly():
    latin = [chr(k) for a, z in ((0xC0, 0x250), (0x1E00, 0x1F00)) for k in range(a, z)]
    texts = [w for c in latin for d in (c, c.swapcase()) for w in (d, f"a{d}b", f"{d}li {d}{d}. x{d}")]
    texts += ["<|ENDOFTEXT|>", "a<|EndOfText|>.", "<|StartOfText|> <|startoftext|>X", "Əli wrote a letter to Ɓala"]
    rng = np.random.default_rng(12)
    planes = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x10000), (0x10000, 0x30000), (0xE0000, 0xE0200)]
    for _ in range(3000):
        spans = [planes[k] for k in rng.integers(0, len(planes), 12)]
        texts.append("".join(chr(int(rng.integers(a, z))) for a, z in spans))
    encoder = tokenization.WordEncoder(memo=500)
    for t, packed in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference_ids(t, 0)[:-1].tolist(), t


def test_packing(docs, spark):
    out = packing.pack(docs, length=64).collect()
    want = []
    for r in docs.collect():
        ids = reference_ids(r.text, 0)
        want += [(r.doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=repr) == sorted(want, key=repr)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1] and sum(n for _, n in s) <= 64
    assert packing.pack(fx.empty(spark)).count() == 0


def test_rounds_equal_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for n in (1, 7, 500):
        lengths = rng.integers(1, 65, n)
        bins: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, g in enumerate(bins) if g >= x]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= x
            else:
                bins.append(64 - x)
        plan = packing.rounds(dict(collections.Counter(lengths.tolist())), 64)
        load = collections.Counter()
        for need, a, z, first, offset in plan:
            for k in range(z - a):
                assert load[first + k] == offset
                load[first + k] += need
        assert len(load) == len(bins) and sum(load.values()) == lengths.sum()


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 33, 70_001):
        ids = np.minimum(rng.zipf(1.2, n), 49_407).astype("<u2")
        table = rans.Table.of_counts(np.bincount(ids, minlength=49_408))
        assert int(table.frequency.sum()) == 1 << rans.SCALE
        block = rans.pack_block([(-5, ids[: n // 2].tobytes()), (None, b""), (2**40, ids[n // 2 :].tobytes())], table, "<u2")
        docs, lengths, back = rans.unpack_block(block, rans.Table.unpack(table.pack()))
        assert docs == [-5, None, 2**40] and lengths.tolist() == [n // 2, 0, n - n // 2] and (back == ids).all()


def test_files(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "PER_FILE", 4000)
    monkeypatch.setattr(rans, "BLOCK", 1000)
    manifest = rans.write(docs, f"file://{tmp_path}/ids")
    got = sorted([tuple(r) for r in rans.read(spark, manifest).collect()], key=lambda r: r[1])
    want = sorted(((r.doc_id, reference_ids(r.text, 1)) for r in docs.collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1].tolist()))
    at, rows = 0, []
    for d, ids in want:
        rows.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == rows
    assert manifest.count() > 1 and not list(tmp_path.glob("ids/*.tmp"))
    one_id = spark.createDataFrame([(5, fx.prose(900 + k, 60)) for k in range(60)], "doc_id long, text string")
    several = rans.write(one_id, f"file://{tmp_path}/one")
    assert several.count() > 1 and sorted(r.ids_crc32 for r in rans.read(spark, several).collect()) == sorted(zlib.crc32(reference_ids(r.text, 1).tobytes()) for r in one_id.collect())
    path = manifest.first().path.removeprefix("file://")
    damaged = bytearray(open(path, "rb").read())
    offset, size, _, _ = rans.checkpoints(f"file://{path}")[0]
    damaged[offset + size // 2] ^= 1
    open(path, "wb").write(damaged)
    with pytest.raises(Exception, match="damaged"):
        rans.read(spark, manifest).collect()
    assert rans.round_trip(fx.empty(spark)).count() == 0


# 10 language


def codes_of(word):
    return np.array([[ord(c) for c in word]], np.uint32)


def segmentations(lattice, word):
    """All ways to cut a word into pieces, by recursion."""
    if not word:
        return [[]]
    known = dict(zip(lattice.keys.tolist(), lattice.ids.tolist(), strict=True))
    out = []
    for n in range(1, min(len(word), lattice.longest) + 1):
        i = known.get(lattice.hash_of(word[:n]), lattice.size if n == 1 else None)
        if i is not None:
            out += [[i, *rest] for rest in segmentations(lattice, word[n:])]
    return out


@pytest.fixture(scope="module")
def lattice():
    return language_id.worker_lattice(tokenization.vocabulary_path(language_id.VOCABULARY))


def test_forward_and_expectations_equal_sums_over_all_segmentations(lattice, monkeypatch):
    assert lattice.longest == 16
    p = np.random.default_rng(1).random((lattice.size + 1, 2)) / 100
    for cells in (language_id.CELLS, 3):
        monkeypatch.setattr(language_id, "CELLS", cells)
        for word in ("▁the", "▁naïve", "▁日本x", "▁a", "▁internation"):
            ways = segmentations(lattice, word)
            each = np.array([np.prod([p[i] for i in way], axis=0) for way in ways])
            assert np.exp(lattice.forward(codes_of(word), p))[0] == pytest.approx(each.sum(0))
            counts = np.zeros(lattice.size + 1)
            for way, weight in zip(ways, each[:, 0] / each[:, 0].sum(), strict=True):
                np.add.at(counts, way, 3.0 * weight)
            assert lattice.expected(codes_of(word), np.array([3.0]), p[:, 0]) == pytest.approx(counts)


def test_long_words_are_summed_whole(lattice, monkeypatch):
    """Against a plain loop with logarithms; and a word of 50,000 letters that would underflow."""
    p = np.random.default_rng(2).random((lattice.size + 1, 1)) / 1000
    known = dict(zip(lattice.keys.tolist(), lattice.ids.tolist(), strict=True))
    for word in ("▁" + "understanding" * 54, "▁" + "日本語aé" * 60):
        log = [0.0]
        for j in range(1, len(word) + 1):
            terms = []
            for k in range(1, min(j, lattice.longest) + 1):
                i = known.get(lattice.hash_of(word[j - k : j]), lattice.size if k == 1 else None)
                if i is not None:
                    terms.append(log[j - k] + math.log(p[i, 0]))
            log.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
        for cells in (language_id.CELLS, 50):
            monkeypatch.setattr(language_id, "CELLS", cells)
            assert lattice.forward(codes_of(word), p)[0, 0] == pytest.approx(log[-1])
            total = lattice.expected(codes_of(word), np.array([1.0]), p[:, 0])
            assert total.sum() > 10
    assert np.isfinite(lattice.forward(codes_of("▁" + "x" * 50_000), p)).all()


def test_training_equals_a_plain_fit(spark, lattice):
    texts = [("en", "the cat sat on the mat"), ("en", "a cat"), ("fr", "le chat est la"), ("fr", "là le chat")]
    docs = spark.createDataFrame([(3 * k, t, x) for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(docs, held_out=-1, rounds=3)
    for i, lang in enumerate(model.languages):
        words = collections.Counter(w for x, t in texts if x == lang for w in t.split())
        p = np.full(lattice.size + 1, 1 / (lattice.size + 1))
        for _ in range(3):
            counts = np.zeros_like(p)
            for w, n in words.items():
                ways = segmentations(lattice, "▁" + w)
                each = np.array([np.prod(p[way]) for way in ways])
                for way, weight in zip(ways, each / each.sum(), strict=True):
                    np.add.at(counts, way, n * weight)
            p = (counts + language_id.SMOOTHING) / (counts.sum() + language_id.SMOOTHING * len(p))
        assert model.p[:, i] == pytest.approx(p)
    assert model.languages == ["en", "fr"] and model.prior == pytest.approx(np.log([0.5, 0.5]))
    for text in ("the mat", "là chat", "cat"):
        z = model.prior + sum(np.log(sum(np.prod(model.p[way], axis=0) for way in segmentations(lattice, "▁" + w))) for w in text.split())
        (got,) = language_id.Scorer(model, lattice).predict([text])
        assert got[0] == model.languages[int(z.argmax())] and got[1] == pytest.approx(np.exp(z.max()) / np.exp(z).sum())


def test_number_like_characters_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "the cat", "en"), (2, "² ½", None), (3, "Ⅷ ① ٣ _ ́", None), (5, "½a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs, held_out=-1)).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[5][0] == "en"
    assert language_id.words_of("² x² हिन्दी é") == ["x", "हिन्दी", "é"]


def test_language_of_odd_rows(docs, spark):
    model = language_id.train(docs)
    out = language_id.predict(docs, model).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    assert len(out) == docs.count()
    for r in out:
        letters = any(c.isalpha() for t in texts[r.doc_id] for c in t or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)
    assert language_id.predict(fx.empty(spark), language_id.train(fx.empty(spark))).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(fx.empty(spark))).collect()} == {"und"}


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(d, language_id.train(d)).join(d, "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
