"""Small steps of near dedup write no files of their own."""

import re

from pyspark.sql import functions as F

from somaframe.llm import components, near_dedup
from somaframe.sources import writers
from test_stages import CHAIN, made


def staged_names(mark):
    return [re.search(r"([a-z]+)-[0-9a-f]{32}$", p)[1] for p in writers._PATHS[mark:]]


def test_stars_take_no_round(spark):
    links = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") % 3 * 100 - 300).alias("b"))
    mark = len(writers._PATHS)
    found = {r.node: r.component for r in components.components(links).collect()}
    assert staged_names(mark) == ["links"]
    assert found == {i: i % 3 * 100 - 300 for i in range(1, 40)} | {b: b for b in (-300, -200, -100)}


def test_no_round_beyond_the_stars(spark):
    for pairs, rounds in (([(5, 1), (5, 2)], 1), ([(1, 2), (2, 3)], 1), ([(1, 2), (1, 2), (3, 3)], 0)):
        mark = len(writers._PATHS)
        found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert set(found.values()) == {1} and set(found) == {x for p in pairs if p[0] != p[1] for x in p}
        assert len(staged_names(mark)) == 1 + rounds


def test_pairs_and_confirmed_are_not_written(spark):
    mark = len(writers._PATHS)
    found = {(r.doc_id, r.component_id) for r in near_dedup.similar_groups(made(spark, CHAIN)).collect()}
    assert {(21, 21), (22, 21), (22, 22), (26, 21), (26, 26)} <= found
    names = staged_names(mark)
    assert "sets" in names and not {"pairs", "confirmed"} & set(names)
