"""Chunks of many partitions are dealt over all groups, also if their number is a power of two."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.llm import lm_score, substring_dedup
from somaframe.llm.common import text_key
from somaframe.llm.exchange import unpack_sorted, unsqueeze, used_places


@pytest.mark.parametrize("groups", [64, 200, 256, 2048])
def test_partial_sums_are_dealt_out(groups):
    names = np.array([(task << 24) + number for task in range(groups) for number in range(16)])
    one = np.ones(len(names))
    rows = lm_score._sum_rows(names, np.arange(len(names)), np.zeros(len(names), np.int64), one, one, groups)
    sizes = np.bincount([r[0] for r in rows], minlength=groups)
    assert sizes.sum() == 16 * groups and sizes.max() <= 4 * 16


@pytest.mark.parametrize("size", [10, 10_000])
def test_used_places(size):
    places = np.random.default_rng(2).integers(0, size, 500)
    used, at = used_places(places, size)
    assert (used == np.unique(places)).all() and (used[at] == places).all() and at.dtype == np.uint32


def hashed(spark):
    """Ids without order, which do not compress."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2)
    return docs.select(F.xxhash64("doc_id").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")


@pytest.mark.parametrize("groups", [16, 1024])
def test_rows_hold_what_their_entries_need(spark, groups):
    docs = hashed(spark)
    trees = substring_dedup._own_trees(docs.select(F.abs("doc_id").alias("doc_id"), "text"), 13, groups, np.zeros(0, np.uint64))
    rows = trees.filter("kind = 0").select("ids", "at").collect()
    assert len({len(unpack_sorted(r["ids"])) for r in rows}) > 1
    for r in rows:
        at = unsqueeze(r["at"], np.uint32)
        assert len(np.unique(at)) == len(unpack_sorted(r["ids"])) == at.max() + 1
    logs = lm_score._sum_rows(np.array([7]), np.zeros(3, np.int64), np.array([9_000, 4, 9_000]), np.ones(3), np.array([1, 0, 1]), groups)
    assert [unsqueeze(logs[0][3], np.float64).tolist(), unsqueeze(logs[0][4], np.uint32).tolist(),
            unsqueeze(logs[0][5], np.uint32).tolist()] == [[1, 2], [0, 2], [4, 9_000]]


@pytest.mark.parametrize("groups", [16, 64])
def test_results_do_not_depend_on_the_groups(spark, groups):
    docs = hashed(spark).withColumn("doc_id", F.abs("doc_id"))
    key = "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(key), []
    try:
        for n in (4, groups):
            spark.conf.set(key, n)
            cut = substring_dedup.cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.xxhash64("kept"))
            scored = lm_score.backoff_scores(docs).select("doc_id", "n_words", "n_backoff", F.round("log_score", 6))
            found.append([sorted(map(tuple, df.collect())) for df in (cut, scored)])
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and sum(r[2] for r in found[0][0]) > 0
