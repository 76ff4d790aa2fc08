"""Joins, grouped operators, reshapes, ranks and orders."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.operators import groups as g
from somaframe.operators import joins as j
from somaframe.operators import ranks as rk
from somaframe.operators import reshape as rs
from somaframe.operators.ordering import gene_order, order_by_list, order_samples

# -- joins


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (2, None, 12), (3, "c", 13), (None, None, 14)], "k int, h string, x int")
    right = spark.createDataFrame([(1, "a", 20), (2, None, 21), (4, "d", 22), (None, None, 23)], "k int, h string, y int")
    return left, right


def test_full_join_matches_null_keys_and_keeps_multiplicity(sides, rows):
    left, right = sides
    assert rows(j.full_join(left, right, ["k", "h"])) == [
        (1, "a", 10, 20), (1, "a", 11, 20), (2, None, 12, 21), (3, "c", 13, None), (4, "d", None, 22),
        (None, None, 14, 23)]


def test_plain_keys_do_not_match_null(sides, rows):
    left, right = sides
    got = rows(j.natural_join(left, right, ["k", "h"], "left", null_safe=False), "x", "y")
    assert got == [(10, 20), (11, 20), (12, None), (13, None), (14, None)]


def test_semi_and_anti_are_complementary(sides, rows):
    left, right = sides
    doubled = right.union(right)
    kept, dropped = rows(j.semi_join(left, doubled, ["k"]), "x"), rows(j.anti_join(left, doubled, ["k"]), "x")
    assert kept == [(10,), (11,), (12,), (14,)] and dropped == [(13,)]


def test_anti_join_with_null_in_the_list_still_keeps_rows(spark, rows):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert rows(j.anti_join(ids, listed, ["s"])) == [("b",)]


def test_clashing_columns_and_duplicates_are_reported(spark, sides):
    left, _ = sides
    with pytest.raises(ValueError, match="both sides"):
        j.natural_join(left, left, ["k"])
    with pytest.raises(ValueError, match="duplicate"):
        j.assert_unique(left, ["k", "h"])
    assert j.assert_unique(left, ["x"]) is left


# -- groups

def test_min_rows_keeps_ties_and_all_null_groups(spark, rows):
    df = spark.createDataFrame(
        [("f1", "c1", "A", 1, 0.1), ("f1", "c1", "A", 1, 0.2), ("f1", "c1", "A", 2, 0.3),
         ("f1", "c2", "A", 3, 0.4), ("f2", "c1", "A", 5, 0.5), ("f1", "c1", "B", None, 0.6),
         ("f1", "c1", "B", None, 0.7), ("f1", "c1", "C", None, 0.8), ("f1", "c1", "C", 4, 0.9),
         ("f1", "c1", None, 2, 1.0), ("f1", "c1", None, 3, 1.1)],
        "file string, chromosome string, gene string, cn int, log2 double")
    got = g.min_rows(df, ["file", "chromosome", "gene"], "cn")
    assert sorted(r["log2"] for r in got.collect()) == [0.1, 0.2, 0.4, 0.5, 0.6, 0.7, 0.9, 1.0]
    assert got.columns == df.columns


def test_min_text_rows_both_ways(spark, rows):
    df = spark.createDataFrame([("A", "10"), ("A", "2"), ("B", "x"), ("B", "3"), ("C", "x")], "g string, cn string")
    assert rows(g.min_text_rows(df, ["g"], "cn", numeric=False)) == [("A", "10"), ("B", "3"), ("C", "x")]
    assert rows(g.min_text_rows(df, ["g"], "cn")) == [("A", "2"), ("B", "3"), ("C", "x")]


def test_top_class_is_the_minimum_of_its_group(spark, rows):
    data = [("s1", "A", "odd"), ("s1", "A", "Missense"), ("s1", "A", "Nonsense"), ("s1", "A", "Nonsense"),
            ("s2", "A", "odd"), ("s2", "B", None), ("s3", "B", "Splice Site")]
    df = spark.createDataFrame(data, "sample string, gene string, snv string")
    best = rows(g.top_class(df, ["sample", "gene"], "snv", k.SNV_PRIORITY))
    assert best == [("s1", "A", "Nonsense"), ("s2", "A", None), ("s2", "B", None), ("s3", "B", "Splice Site")]
    lists = {(r["sample"], r["gene"]): r for r in g.class_lists(df, ["sample", "gene"], "snv", k.SNV_PRIORITY).collect()}
    for sample, gene, chosen in best:
        listed = [c for c in lists[sample, gene]["classes"] if c in k.SNV_PRIORITY]
        assert chosen == min(listed, key=k.SNV_PRIORITY.index, default=None)
    assert lists["s1", "A"]["n"] == 4


def test_distinct_ids_counts_a_missing_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "s string")
    assert g.distinct_ids(df, "s").first()[0] == 3


def test_joined_classes_repeat_and_follow_the_levels(spark, rows):
    data = [("A", "Missense"), ("A", "Frameshift"), ("A", "Missense"), ("B", "Missense"), ("C", "zeta"),
            ("C", "alpha"), ("C", "Frameshift"), ("D", None)]
    df = spark.createDataFrame(data, "g string, c string")
    assert rows(g.joined_classes(df, ["g"], "c", ["Frameshift", "Missense"])) == [
        ("A", "Frameshift;Missense;Missense"), ("B", "Missense"), ("C", "Frameshift;alpha;zeta"), ("D", "NA")]


def test_collapse_except_groups_nulls_together(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (1, None, "x"), (2, "a", None)], "a int, b string, id string")
    got = g.collapse_except(df, "id", id=g.joined_set("id"), n=F.count(F.lit(1)))
    assert rows(got, "a", "b", "id", "n") == [(1, None, "x,y", 3), (2, "a", "", 1)]


def test_median_from_counts(spark, rows):
    data = [("A", v) for v in (1.0, 2.0, 2.0, 9.0)] + [("A", None), ("B", 5.0), ("B", 6.0)]
    assert rows(g.median_value(spark.createDataFrame(data, "g string, v double"), ["g"], "v")) == [("A", 2.0), ("B", 5.5)]


def test_median_of_one_hot_group_and_a_missing_key(spark, rows):
    hot = spark.range(20_001).select(F.lit("A").alias("g"), F.lit(None).cast("string").alias("h"), (F.col("id") * 7919 % 20_001).cast("double").alias("v"))
    rest = spark.createDataFrame([(None, None, 4.0), (None, None, 9.0), ("B", "x", None), ("C", "x", 1.0)], "g string, h string, v double")
    got = g.median_value(hot.unionByName(rest), ["g", "h"], "v")
    assert rows(got) == [("A", None, 10_000.0), ("C", "x", 1.0), (None, None, 6.5)]
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


# -- reshapes

def test_unpivot_keeps_nulls_and_pivot_reverses_it(spark, rows):
    wide = spark.createDataFrame([("A", 1, None, 3), ("B", None, 5, 6)], "gene string, s1 int, s2 int, s3 int")
    long = rs.unpivot_values(wide, ["gene"], "sample", "v")
    assert long.count() == 6 and long.filter("v is null").count() == 2
    back = rs.pivot_unique(long, "gene", "sample", "v", ["s1", "s2", "s3"])
    assert rows(back) == rows(wide)


def test_pivot_unique_rejects_duplicates_and_makes_missing_columns(spark, rows):
    df = spark.createDataFrame([("A", "s1", "x"), ("A", "s1", "x"), ("B", "s9", "y")], "g string, s string, v string")
    with pytest.raises(Exception, match="more than one value"):
        rs.pivot_unique(df, "g", "s", "v", ["s1"]).collect()
    assert rows(rs.pivot_unique(df.distinct(), "g", "s", "v", ["s1", "s2"], fill="")) == [("A", "x", ""), ("B", "", "")]


def test_pivot_sets_joins_duplicates(spark, rows):
    df = spark.createDataFrame([("A", "s1", "y"), ("A", "s1", "x"), ("A", "s1", "x"), ("A", "s2", None)], "g string, s string, v string")
    assert rows(rs.pivot_sets(df, "g", "s", "v", ["s1", "s2"])) == [("A", "x;y", "")]


def test_dense_cells_is_the_full_grid(spark, rows):
    cells = spark.createDataFrame([("A", "s1", "x"), ("A", "s9", "y"), ("Z", "s1", "z"), ("B", "s2", None)],
                                  "gene string, sample string, alterations string")
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s3",)], "sample string")
    grid = {(r["gene"], r["sample"]): r["alterations"] for r in rs.dense_cells(cells, ["A", "B", "A"], samples).collect()}
    assert set(grid) == set(itertools.product(["A", "B"], ["s1", "s2", "s3", "s9"]))
    assert {c: v for c, v in grid.items() if v} == {("A", "s1"): "x", ("A", "s9"): "y"}
    with pytest.raises(Exception, match="more than one value"):
        rs.dense_cells(cells.union(cells), ["A", "B"], samples).collect()


def test_explode_and_split(spark, rows):
    df = spark.createDataFrame([(1, "a,b"), (2, ""), (3, None)], "i int, t string")
    tokens = F.filter(F.split("t", ","), lambda x: x != "")
    assert rows(rs.explode_tokens(df, "t", tokens)) == [(1, "a"), (1, "b")]
    assert rows(rs.explode_tokens(df, "t", tokens, keep_empty=True)) == [(1, "a"), (1, "b"), (2, None), (3, None)]
    assert rows(rs.split_columns(df, "t", ",", ["p", "q"])) == [(1, "a", "b"), (2, "", None), (3, None, None)]


def test_column_selections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").withColumnRenamed("c", "c.1")
    assert rs.columns_after(df, 1) == ["b", "c.1"]
    assert rs.without_suffix(df, ".1").columns == ["a", "b"]
    assert rs.move_last(df, "a").columns == ["b", "c.1", "a"]
    assert rs.move_first(df, "c.1").columns == ["c.1", "a", "b"]


# -- ranks

def _ranks(values):
    order = sorted(values)
    return [sum(i + 1 for i, o in enumerate(order) if o == v) / order.count(v) for v in values]


def _pearson(x, y):
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    sxx, syy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return sxy / (sxx * syy) ** 0.5 if sxx and syy else None


@pytest.mark.parametrize("parts", [None, 1, 5, 64, 2000])
def test_running_totals_do_not_depend_on_the_parts(spark, parts):
    rng = random.Random(parts)
    data = [(by, v, rng.randint(1, 9)) for by in ("p", "q") for v in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(data, "by string, v int, w int")
    got = {(r["by"], r["v"]): r["before"] for r in rk.running_totals(df, ["by"], "v", "w", parts=parts).collect()}
    for by in ("p", "q"):
        total = 0
        for _, v, w in sorted(d for d in data if d[0] == by):
            assert got[by, v] == total
            total += w
    assert len(got) == len(data)


def test_spearman_matches_rank_then_pearson(spark):
    rng = random.Random(3)
    data = [(float(rng.randint(0, 4)), rng.random(), None if rng.random() < 0.2 else rng.random(), 1.0) for _ in range(400)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "b")]
    got = {(r["x_name"], r["y_name"]): r for r in rk.spearman_pairs(df, pairs, parts=9).collect()}
    names = "abcd"
    for x, y in pairs:
        kept = [(r[names.index(x)], r[names.index(y)]) for r in data if r[names.index(y)] is not None]
        rho = _pearson(_ranks([u for u, _ in kept]), _ranks([v for _, v in kept]))
        assert got[x, y]["n"] == len(kept)
        if rho is None:
            assert got[x, y]["rho"] is None and got[x, y]["p"] is None
        else:
            assert got[x, y]["rho"] == pytest.approx(rho, abs=1e-12)
            n = len(kept)
            assert got[x, y]["s"] == pytest.approx((n**3 - n) * (1 - rho) / 6, rel=1e-9, abs=1e-3)


def _student_tail(t, df, steps=20_000):
    """Two-sided tail by Simpson's rule on the density between -t and t."""
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = 2 * t / steps
    total = sum(
        (1 if i in (0, steps) else 4 if i % 2 else 2) * (1 + (-t + i * h) ** 2 / df) ** (-(df + 1) / 2)
        for i in range(steps + 1)
    )
    return 1 - norm * total * h / 3


def test_rank_test_p(spark):
    cases = [(2.0, 10), (1.0, 3), (3.0, 98), (0.2, 5000)]
    data = [(t / math.sqrt(df + t * t), df + 2.0, _student_tail(t, df)) for t, df in cases]
    df = spark.createDataFrame(data, "rho double, n double, p double")
    for r in df.withColumn("q", rk.rank_test_p(F.col("rho"), F.col("n"))).collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-6)
    # many rows: t has the normal distribution by then
    many = [(t / math.sqrt(n - 2 + t * t), n, math.erfc(t / math.sqrt(2))) for t in (0.5, 2.0, 6.0) for n in (1e10, 1e12, 1e15)]
    df = spark.createDataFrame(many, "rho double, n double, p double")
    for r in df.withColumn("q", rk.rank_test_p(F.col("rho"), F.col("n"))).collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-7)
    near = spark.createDataFrame([(t / math.sqrt(n + t * t), n) for t in (0.5, 2.0, 6.0) for n in (1e6, 1e6 + 1)], "rho double, n double")
    q = [r[0] for r in near.select(rk.rank_test_p(F.col("rho"), F.col("n"))).collect()]
    assert q[::2] == pytest.approx(q[1::2], rel=1e-8)
    edge = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (0.5, 2.0), (-1e-9, 5.0)], "rho double, n double")
    assert [r[0] for r in edge.select(rk.rank_test_p(F.col("rho"), F.col("n"))).collect()] == [0.0, None, None, 1.0]


def test_row_positions_is_a_total_order(spark):
    rng = random.Random(1)
    data = [(f"s{i}", rng.randint(0, 3)) for i in range(700)]
    df = spark.createDataFrame(data, "id string, x int")
    got = rk.row_positions(df, [F.col("x")], "id", parts=16).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [i for i, _ in sorted(data, key=lambda d: (d[1], d[0]))]
    assert sorted(r["position"] for r in got) == list(range(1, 701))


# -- orders

GENES, SAMPLES = ["A", "B", "C"], [f"s{i}" for i in range(8)]
CELLS = {
    ("A", "s0"): "Gain", ("A", "s1"): "Amplification;Missense", ("A", "s2"): "Nonsense", ("A", "s3"): "Missense",
    ("A", "s4"): "odd", ("B", "s0"): "Missense", ("B", "s2"): "Deep Deletion;Gain", ("B", "s5"): "Splice Site",
    ("C", "s6"): "Gain;Deep Deletion", ("C", "s1"): "Gain", ("C", "s3"): "Gain",
}


@pytest.fixture(scope="module")
def matrix(spark):
    data = [(g_, s, i, CELLS.get((g_, s), "")) for i, s in enumerate(reversed(SAMPLES)) for g_ in GENES]
    return spark.createDataFrame(data, "gene string, sample string, place int, alterations string")


def _expected_order(layers, place):
    blanks = {g_: sum((g_, s) not in CELLS for s in SAMPLES) for g_ in GENES}
    genes = sorted(GENES, key=lambda g_: (blanks[g_], g_))

    def key(s):
        out = []
        for g_, layer in itertools.product(genes, layers):
            found = [c for c in CELLS.get((g_, s), "").split(";") if c in layer]
            out.append(layer.index(found[0]) if found else len(layer))
        return out, place(s), s
    return sorted(SAMPLES, key=key)


def test_gene_order(matrix, rows):
    assert rows(gene_order(matrix), "gene_rank", "gene", "n_blank") == [(1, "A", 3), (2, "B", 5), (3, "C", 5)]


@pytest.mark.parametrize("layers", [k.TWO_LAYERS, k.THREE_LAYERS, [["Gain"], ["Missense"], ["Nonsense"], ["odd"]]])
def test_order_samples(matrix, layers):
    got = order_samples(matrix, layers).orderBy("position").collect()
    assert [r["sample"] for r in got] == _expected_order(layers, lambda s: 0)
    assert [r["position"] for r in got] == list(range(1, 9))
    kept = order_samples(matrix, layers, input_position="place").orderBy("position").collect()
    assert [r["sample"] for r in kept] == _expected_order(layers, lambda s: -int(s[1]))


def test_blank_cells_come_after_every_class_of_a_long_layer(spark):
    layer = [f"c{i}" for i in range(150)]
    data = [("A", "s1", ""), ("A", "s2", "c149"), ("A", "s3", "c99"), ("A", "s4", "c100"), ("A", "s5", "other")]
    df = spark.createDataFrame(data, "gene string, sample string, alterations string")
    got = order_samples(df, [layer]).orderBy("position").collect()
    assert [r["sample"] for r in got] == ["s3", "s4", "s2", "s1", "s5"]
    got = order_samples(df, [layer], levels="appearance").orderBy("position").collect()
    assert [r["sample"] for r in got] == ["s2", "s3", "s4", "s1", "s5"]


def test_order_by_first_appearance(spark):
    data = [("A", "s1", "Gain"), ("A", "s2", "Deep Deletion"), ("A", "s3", "Gain"), ("A", "s4", "")]
    df = spark.createDataFrame(data, "gene string, sample string, alterations string")
    listed = [r["sample"] for r in order_samples(df).orderBy("position").collect()]
    seen = [r["sample"] for r in order_samples(df, levels="appearance").orderBy("position").collect()]
    assert listed == ["s2", "s1", "s3", "s4"] and seen == ["s1", "s3", "s2", "s4"]


def test_order_by_list(spark):
    df = spark.createDataFrame([("c",), ("a",), ("zz",), ("b",), (None,)], "x string")
    assert [r["x"] for r in order_by_list(df, "x", ["b", "c", "a"]).collect()] == ["b", "c", "a", "zz", None]
