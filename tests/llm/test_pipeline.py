"""The registered queries against SQL, and the pipeline stage by stage against plain Python."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from riskspark.llm import mixing, store
from riskspark.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_operators import shards_by_hand
from tests.llm.test_search import components_by_hand, contamination_by_hand
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    ok, text, _ = compare(name, spark, FOLDER, connect(FOLDER), QUERIES, ORACLES)
    assert ok, text


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    scores = {r.doc_id: r.predicted for r in QUERIES["op2_toxicity"](spark, FOLDER).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = expected
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        expected = rows(docs)
        if name == "toxicity":
            assert Counter(expected) == Counter(r for r in before if not scores[r[0]])
        elif name == "near_dedup":
            component = components_by_hand(before)[2]
            assert Counter(expected) == Counter(r for r, c in zip(before, component) if r[0] == c)
        elif name == "decontamination":
            bad = {e[0] for e in contamination_by_hand(before, items, 13) if e[4]}
            assert Counter(expected) == Counter(r for r in before if r[0] not in bad) and bad
        else:
            placed = mixing.mix(frame(spark, before)).collect()
            assert Counter(r[0] for r in expected) == Counter(r.doc_id for r in placed) and set(expected) == set(before)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert Counter((r.doc_id, r.copy, r.n_bytes, r.shard) for r in got.collect()) == shards_by_hand(expected, 64 << 20)


def test_stored_tables_can_be_deleted(spark):
    table = store.stored(spark.range(3), "numbers")
    path = store._made[-1]
    assert table.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    store.clean(spark)
    assert not os.path.exists(path.removeprefix("file:"))


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
            assert name == "sharding" or out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == bool(rows)
