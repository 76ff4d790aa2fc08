"""A key that holds a third of the rows: same results, split between tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from somaframe.operators import groups as g
from somaframe.operators import joins as j
from somaframe.operators.ranks import spearman_pairs
from somaframe.plans import matrix as m
from somaframe.plans.tracks import multi_hit_classes
from somaframe.plans.variants import enrich_catalogue, variant_recurrence

HOT = -1
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture(scope="module")
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").repartition(8, "l_orderkey")
    yield li.withColumn("k", F.when(F.col("l_tax") < 0.035, HOT).otherwise(F.col("l_partkey")))
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def local(hot):
    return hot.select("k", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber").toPandas()


def final_plan(df):
    rows = df._jdf.queryExecution().toRdd().count()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_third_of_the_rows_share_the_key(local):
    assert (local.k == HOT).mean() > 1 / 3


def test_min_rows(hot, local):
    got = g.min_rows(hot.select("k", "l_quantity", "l_orderkey"), ["k"], "l_quantity").toPandas()
    expected = local[local.l_quantity == local.groupby("k").l_quantity.transform("min")]
    assert Counter(zip(got.k, got.l_orderkey)) == Counter(zip(expected.k, expected.l_orderkey))


def test_recurrence_join_is_split(hot, local):
    df = variant_recurrence(hot.select("k", "l_suppkey", "l_quantity", "l_orderkey"), ["k"])
    rows, text = final_plan(df)
    assert rows == len(local) and "SortMergeJoin(skew=true)" in text
    distinct = local.drop_duplicates(["k", "l_suppkey", "l_quantity", "l_orderkey"])
    assert {tuple(r) for r in df.select("k", "recurrence").distinct().collect()} == set(distinct.groupby("k").size().items())


@pytest.mark.parametrize("turned", [False, True])
def test_full_join_is_split_on_either_side(spark, hot, local, turned):
    many = hot.select("k", "l_orderkey")
    one = spark.range(HOT, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    df = j.full_join(one, many, ["k"]) if turned else j.full_join(many, one, ["k"])
    rows, text = final_plan(df)
    assert "SortMergeJoin(skew=true)" in text
    absent = set(range(HOT, 3000)) - set(local.k)
    assert rows == len(local) + len(absent)
    assert df.filter("v is null").count() == 0 and df.filter("l_orderkey is null").count() == len(absent)


def joined_rows(left, right, keys, null_safe):
    """Full outer join by loops."""
    out, met = [], set()
    for a in left:
        hits = [i for i, b in enumerate(right) if a[:keys] == b[:keys] and (null_safe or None not in a[:keys])]
        met.update(hits)
        out += [(*a, *right[i][keys:]) for i in hits] or [(*a, None)]
    return Counter(out + [(*b[:keys], None, *b[keys:]) for i, b in enumerate(right) if i not in met])


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("hot_rows", [1, 7, 10**6])
def test_split_full_join_equals_loops(spark, null_safe, hot_rows):
    left = [("a", i % 2, i) for i in range(40)] + [("b", 1, i // 2) for i in range(30)] + [(None, 1, i) for i in range(20)]
    left += [("d", None, None), ("d", None, None), ("l", 0, 1)] + [("only left", 0, i) for i in range(25)]
    right = [("a", i % 3, i) for i in range(33)] + [("b", 1, 5)] + [(None, 1, i) for i in range(15)]
    right += [("d", None, 3), ("r", 0, None)] + [("only right", 0, i % 3) for i in range(25)]
    one = spark.createDataFrame(left, "k string, h int, x int").repartition(3)
    two = spark.createDataFrame(right, "k string, h int, y int").repartition(4)
    got = j.split_full_join(one, two, ["k", "h"], null_safe, hot_rows)
    assert got.columns == ["k", "h", "x", "y"]
    assert Counter(tuple(r) for r in got.collect()) == joined_rows(left, right, 2, null_safe)
    empty = j.split_full_join(one.limit(0), two, ["k", "h"], null_safe, hot_rows)
    assert Counter(tuple(r) for r in empty.collect()) == joined_rows([], right, 2, null_safe)


@pytest.mark.parametrize("turned", [False, True])
def test_split_full_join_shuffles_once_and_spreads_the_key(spark, hot, local, turned):
    many = hot.select("k", "l_orderkey", "l_linenumber")
    one = spark.range(HOT, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    pair = (one, many) if turned else (many, one)
    df = j.split_full_join(*pair, ["k"], hot_rows=500)
    absent = set(range(HOT, 3000)) - set(local.k)
    assert df.count() == len(local) + len(absent)
    assert df.filter("v is null").count() == 0 and df.filter("l_orderkey is null").count() == len(absent)
    _, text = final_plan(df)
    assert text.count("FullOuter") == 1 and text.count("Exchange hashpartitioning(coalesce(k") <= 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = [r["count"] for r in df.filter(F.col("k") == HOT).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 8 and max(spread) <= (local.k == HOT).sum() / 3


def test_semi_and_anti(spark, hot, local):
    listed = hot.filter(F.col("k") == HOT).select("k")
    assert j.semi_join(hot, listed, ["k"]).count() == (local.k == HOT).sum()
    assert j.anti_join(hot, listed, ["k"]).count() == (local.k != HOT).sum()


def test_spearman_with_a_hot_value(hot, local):
    got = spearman_pairs(hot, [("k", "l_extendedprice"), ("k", "l_quantity")]).collect()
    for r in got:
        x, y = local[r["x_name"]].rank(), local[r["y_name"]].rank()
        assert r["n"] == len(local) and r["rho"] == pytest.approx(x.corr(y), abs=1e-10)


def test_hot_cell_costs_one_row_per_class(hot, local):
    keyed = hot.select(F.lit("G").alias("gene"), F.col("k").cast("string").alias("sample"), F.col("l_linenumber").cast("string").alias("func"))
    got = {r["sample"]: r["snv"] for r in multi_hit_classes(keyed, recoding=None).collect()}
    expected = local.sort_values("l_linenumber").groupby("k").l_linenumber.apply(lambda c: ";".join(map(str, c)))
    for key, text in expected.items():
        assert got[str(key)] == (text + "_2" if ";" in text else text)


def test_events_of_a_hot_sample(hot, local):
    calls = hot.select(F.col("k").cast("string").alias("sample"), F.lit("TP53").alias("gene"), F.lit("Missense").alias("snv"))
    none = calls.limit(0).withColumnRenamed("snv", "cna")
    assert m.alteration_events(none, calls, ["TP53"]).count() == local.k.nunique()


def test_enrichment_with_a_hot_text(spark, hot, local):
    rows = hot.select(F.when(F.col("k") == HOT, None).otherwise(F.concat(F.lit("COSV"), F.col("k"))).alias("Existing_variation"), "l_orderkey")
    frequency = spark.range(0, 3000).select(F.concat(F.lit("COSV"), "id").alias("catalogue_id"), F.lit(2).alias("n_mutated"), F.lit("1").alias("tier"))
    got = enrich_catalogue(rows, frequency)
    assert got.agg(F.sum("n_mutated")).first()[0] == 2 * (local.k != HOT).sum()
    assert got.count() == len(local[["k", "l_orderkey"]].drop_duplicates())
