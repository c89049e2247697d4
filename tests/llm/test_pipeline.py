"""The corpus pipeline against brute force, stage by stage, on a small corpus."""

import collections
import zlib

import fixtures_llm as fx
import numpy as np
import pytest
from test_operators import brute_components, edit, reference_ids

import corpus_pipeline
from flowspark.llm import decontamination, fertility, tokenization, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(d, t, "en", s, c, *rest) for d, t, _, s, c, *rest in fx.rows()]
    rows += [(1000 + i, fx.prose(1000 + i, 90) + (" idiot" if i % 5 == 0 else ""), "en", "src1", 1, "k", "s", 1, "x") for i in range(120)]
    item = fx.prose(77, 30)
    rows += [(2000, fx.prose(300, 60) + "\n" + item.upper() + "\n" + fx.prose(301, 60), "en", "src1", 1, "k", "s", 1, "x")]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, fx.prose(78, 30)), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_stages(spark, corpus):
    path, rows, item = corpus
    key = lambda r: (repr(r[0]), repr(r[1]))
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), rows
    meter = fertility.worker_meter(fertility.vocabulary_paths())
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    items = [decontamination.fold(item), decontamination.fold(fx.prose(78, 30))]

    def components(some):
        named = [r for r in some if r[0] is not None]
        kept = [r for r, (d, _, c) in zip(named, brute_components([r[:2] for r in named], 5, 80), strict=True) if d == c]
        return kept + [r for r in some if r[0] is None]

    def once(some):
        seen = set()
        return [r for r in some if r[0] is None or not (r[0] in seen or seen.add(r[0]))]

    brute = [
        lambda some: [r for r in some if meter.measure(r[1], r[2], fertility.BANDS)[-1]],
        lambda some: [r for r in some if model(r[1]) < toxicity.THRESHOLD],
        lambda some: once(components(some)),
        lambda some: [r for r in some if min(edit(i, decontamination.fold(r[1])) - decontamination.budget(i) for i in items) > 0],
    ]
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        got, want = sorted([tuple(r) for r in out.collect()], key=key), sorted(by_hand(left), key=key)
        assert got == want, name
        assert len(want) < len(left), name
        docs = spark.createDataFrame(got, fx.SCHEMA)
        left = want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    want = collections.Counter()
    for r in left:
        ids = reference_ids(r[1], 0)
        want.update((r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    whole = corpus_pipeline.run(spark, path).collect()
    strip = lambda x: sorted((repr(r.doc_id), r.piece, r.ids_crc32) for r in x)
    assert strip(whole) == strip(packed)
    loads = np.bincount([r.sequence_id for r in whole], [r.length for r in whole])
    assert loads.max() <= 2048


def test_stages_of_an_empty_table(spark, corpus):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, fx.empty(spark), corpus[0]).count() == 0, name


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best-fit packing" and "op1_url_filters" in e.oracle_sql()


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_minhash_near_duplicates", "quality_base"])
def test_operators_against_sql(spark, name):
    import compare

    from flowspark.llm import queries

    con = compare.tables("/root/testdata/sf0.01")
    compare.assert_same(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con, queries.ORACLES[name])
