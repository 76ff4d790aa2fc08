"""Stages of the pipeline on rows without an id and on one id with two texts."""

import pytest

import corpus_pipeline
from somaframe.llm import decontaminate, exact_dedup, near_dedup
from somaframe.sources.writers import staged
from test_edges import SCHEMA, TEXTS

ITEM = " ".join(f"question{i} of{i % 7}" for i in range(20))
CLEAN = " ".join(f"clean{i} text{i % 11}" for i in range(60))
OTHER = " ".join(f"other{i} theme{i % 5}" for i in range(60))
FOURTH = " ".join(f"fourth{i} kind{i % 9}" for i in range(60))
BASE = " ".join(f"basis{i} part{i % 3}" for i in range(60))
CHAIN = [
    (21, BASE), (22, BASE + " once more"), (22, OTHER), (None, CLEAN), (24, CLEAN[:-1] + " x"), (25, ITEM), (25, FOURTH),
    (None, ITEM), (None, BASE), (26, None), (26, BASE)]


def made(spark, pairs):
    return spark.createDataFrame([(d, t, "en", None, 0.1, True, 5, 6, "w", "k") for d, t in pairs], SCHEMA).repartition(3)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_keeps_other_texts(spark):
    kept = left(exact_dedup.drop_exact_copies(made(spark, CHAIN)))
    gone = [(None, BASE), (None, ITEM), (26, BASE)]
    assert kept == sorted([p for p in CHAIN if p not in gone], key=str)


def test_near_keeps_other_texts(spark):
    kept = left(near_dedup.drop_near_copies(made(spark, CHAIN)))
    gone = [(22, BASE + " once more"), (26, BASE)]
    assert kept == sorted([p for p in CHAIN if p not in gone], key=str)
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.similar_groups(made(spark, CHAIN)).collect()}
    assert {(21, 21, True), (22, 21, False), (22, 22, True), (26, 21, False), (26, 26, True)} <= found


def test_benchmark_keeps_other_texts(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = left(decontaminate.drop_contaminated(made(spark, CHAIN), bench))
    assert kept == sorted([p for p in CHAIN if p[1] != ITEM], key=str)


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_all_stages(spark, benchmark_dir):
    docs = made(spark, TEXTS + CHAIN)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, benchmark_dir), f"edges-{name}")
        after[name] = left(docs)
    for pair in [(None, CLEAN), (22, OTHER), (25, FOURTH), (21, BASE)]:
        assert pair in after["language"] and pair in after["benchmark"]
    assert not {(22, BASE + " once more"), (26, BASE), (25, ITEM), (None, ITEM)} & set(after["benchmark"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, benchmark_dir)
    starts = pieces.filter("start = 0").groupBy("doc_id").count().collect()
    expected = {}
    for d, _ in after["benchmark"]:
        expected[d] = expected.get(d, 0) + 1
    assert {r.doc_id: r["count"] for r in starts} == expected
