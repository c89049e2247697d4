"""Toxicity by a counterfactual-regularised logistic classifier.

Features are words and their first four and five letters, each once a text
however long it is.  For every labelled text that names an identity group, the
group's term is swapped for others of its kind, and the squared change of the
score before the logistic function (its logit, a sum over features) is added to
the loss, so the classifier cannot lean on whom a text is about, only on what it
says.

Training reads a bounded sample of labelled ids (`sample`, a documented
parameter; ids are taken in the order of a hash).  The executors count, for each
feature of the sample, how many texts have it and how many of those are toxic;
the `features` most telling ones are kept, and the driver gets those of each
text only: at most sample * features small numbers, however long texts are and
however often a row repeats.  Scoring reads whole texts.

Defined results: null and empty texts have no feature and get the score of the
bias; a label that is null is not learned from; of several labels of one id the
largest counts; without two classes among the labels the score is the share of
label 1 (0 without labels); of several texts of one id one is learned from;
repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_of_id, discard, fresh, materialize
from .tokenization import Memo

SAMPLE, FEATURES, THRESHOLD = 8_000, 5_000, 0.3
PENALTY, RIDGE, ROUNDS = 1.0, 1e-4, 300
TELLING = 3.0  # standard errors by which a feature's share of label 1 differs, at least
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")

#: Identity terms that may stand for each other, by kind.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "native"),
    ("woman", "man", "transgender", "nonbinary"),
    ("women", "men"),
    ("female", "male", "trans"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("moslem", "christ", "jude", "buddhist"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("musulmán", "cristiano", "judío", "budista", "ateo"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)


def word_features(word: str) -> tuple[int, ...]:
    h = lambda kind, s: xxhash.xxh64_intdigest(f"{kind}{s}") >> 1  # noqa: E731  fits a signed long
    return tuple([h("w", word)] + [h(n, word[:n]) for n in (4, 5) if len(word) > n])


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """Weights by feature; the score is the logistic of their sum over a text's features."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        weights, bias = self.weights, self.bias
        known = Memo(lambda w: tuple([f for f in word_features(w) if f in weights]))

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in words_of(text):
                found.update(known[w])
            z = bias + sum([weights[f] for f in sorted(found)])
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def swaps(words: set[str], identities: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """(term, other term of its kind) for the identity terms among words."""
    return [(t, o) for kind in identities for t in kind if t in words for o in kind if o != t]


def prior(y: np.ndarray) -> Model:
    """What is known without two classes: the share of label 1."""
    p = float(y.mean()) if len(y) else 0.0
    return Model(float(np.log((p + 1e-9) / (1 - p + 1e-9))))


def telling_features(counts: dict[int, tuple[int, int]], texts: int, toxic: int, identities=IDENTITIES, features: int = FEATURES, least: float = TELLING) -> np.ndarray:
    """The features to keep, sorted.  counts: feature -> (texts with it, toxic ones among them)."""
    names = np.array(sorted(counts), np.int64)
    seen, bad = np.array([counts[int(f)] for f in names], float).reshape(-1, 2).T
    share = toxic / texts
    telling = np.abs(bad - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
    telling[np.isin(names, identity_features(identities))] = np.inf
    kept = np.argsort(-telling, kind="stable")[:features]
    return np.sort(names[kept[telling[kept] >= least]])


def identity_features(identities=IDENTITIES) -> np.ndarray:
    return np.unique(np.array([f for kind in identities for t in kind for f in word_features(t)], np.int64))


def fit(texts: list[tuple[set[str], int]], identities=IDENTITIES, features: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE, rounds: int = ROUNDS, least: float = TELLING) -> Model:
    """texts: (words, label).  Minimises the mean log loss, a ridge, and penalty times the mean squared change of the logit under swaps."""
    y = np.array([t for _, t in texts], float)
    if not len(y) or y.min() == y.max():
        return prior(y)
    rows = [{f for w in words for f in word_features(w)} for words, _ in texts]
    counts: dict[int, list[int]] = {}
    for row, label in zip(rows, y, strict=True):
        for f in row:
            n = counts.setdefault(f, [0, 0])
            n[0] += 1
            n[1] += int(label)
    kept = telling_features(counts, len(y), int(y.sum()), identities, features, least)
    return fit_rows(kept, [np.searchsorted(kept, sorted(row.intersection(kept.tolist()))) for row in rows], y, [swaps(words, identities) for words, _ in texts], penalty, ridge, rounds)


def fit_rows(names: np.ndarray, rows: list[np.ndarray], y: np.ndarray, swapped: list[list[tuple[str, str]]], penalty: float = PENALTY, ridge: float = RIDGE, rounds: int = ROUNDS) -> Model:
    """names: the kept features; rows: the places in names of each text's features."""
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = y.mean()
    index = {int(f): i for i, f in enumerate(names)}
    pairs: dict[tuple[str, str], int] = {}
    for some in swapped:
        for pair in some:
            pairs[pair] = pairs.get(pair, 0) + 1
    m, v = len(names), len(y)
    change = np.zeros((len(pairs), m))
    for i, (a, b) in enumerate(pairs):
        for f in word_features(a):
            if f in index:
                change[i, index[f]] += 1
        for f in word_features(b):
            if f in index:
                change[i, index[f]] -= 1
    often = np.array(list(pairs.values()), float) / v
    w, bias, gw, gb = np.zeros(m), float(np.log(share / (1 - share))), np.full(m, 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(owner, w[at], v)
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / v
        g = np.bincount(at, r[owner], m) + ridge * w
        if len(pairs):
            g += 2 * penalty * change.T @ (often * (change @ w))
        gw += g * g
        gb += r.sum() ** 2
        w -= 0.3 * g / np.sqrt(gw)
        bias -= 0.3 * r.sum() / np.sqrt(gb)
    return Model(float(bias), {int(f): float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identities=IDENTITIES, held_out: int = 2, of: int = 4) -> Model:
    """Fits on labels (doc_id, toxic) of docs (doc_id, text), but for ids whose crc32 modulo `of` is held_out."""
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % of != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most `sample` pairs of numbers
    if not chosen:
        return Model(-40.0)
    labelled = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int")
    terms = {t for kind in identities for t in kind}

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, toxic in zip(b["doc_id"], b["text"], b["toxic"], strict=True):
                words = words_of(text)
                f = np.unique(np.array([f for w in words for f in word_features(w)], np.int64))
                out.append((doc, toxic, f, sorted(words & terms)))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "features", "terms"])

    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id").mapInPandas(featured, "doc_id long, toxic int, features array<long>, terms array<string>")
    rows = rows.filter(F.size("features") > 0).groupBy("doc_id").agg(F.min(F.struct("toxic", "features", "terms")).alias("r")).select("doc_id", "r.*")  # one text of each id
    rows = materialize(rows, "labelled")
    y = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < y[1] < y[0]:
        return prior(np.repeat([1.0, 0.0], [y[1], y[0] - y[1]]))
    share = y[1] / y[0]
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    always = F.col("f").isin([int(f) for f in identity_features(identities)])
    telling = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = counts.filter(always | (telling >= TELLING)).orderBy(F.when(always, float("inf")).otherwise(telling).desc(), "f").limit(FEATURES).collect()
    kept = telling_features({r["f"]: (r["n"], r["bad"]) for r in best}, y[0], y[1], identities)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places = []
            for f in b["features"]:
                at = np.minimum(np.searchsorted(kept, f), max(0, len(kept) - 1))
                places.append(np.sort(at[kept[at] == f]).astype("<i4").tobytes() if len(kept) else b"")
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "places": places, "terms": b["terms"]})

    found = rows.mapInPandas(placed, "doc_id long, toxic int, places binary, terms array<string>").collect()  # at most `sample` rows
    discard(rows)
    found.sort(key=lambda r: r["doc_id"])
    return fit_rows(kept, [np.frombuffer(r["places"], "<i4") for r in found], np.array([r["toxic"] for r in found], float), [swaps(set(r["terms"]), identities) for r in found])


def score_udf(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype=float)

    return score


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, held_out: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = docs.select("doc_id", (crc_of_id() % of == held_out).alias("held_out"), score_udf(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with their columns as they are."""
    s = fresh(docs, "_score")
    return docs.withColumn(s, score_udf(model)("text")).filter(F.col(s) < threshold).drop(s)
