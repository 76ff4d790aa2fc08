"""Missing-value rules, text expressions and classifications."""

import pytest
from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.functions import nulls as nl
from somaframe.functions import text as tx


def values(spark, data, schema, expression, order="i"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, {schema}")
    return [r[0] for r in df.orderBy(order).select(expression.alias("v")).collect()]


def test_membership_treats_null_as_not_listed(spark):
    data = [("a",), ("b",), (None,)]
    assert values(spark, data, "x string", nl.in_set("x", ["a"])) == [True, False, False]
    assert values(spark, data, "x string", nl.not_in_set("x", ["a"])) == [False, True, True]


def test_clamps_keep_null(spark):
    data = [(9.0,), (10.0,), (11.0,), (-5.0,), (None,)]
    assert values(spark, data, "x double", nl.at_most("x", 10.0)) == [9, 10, 10, -5, None]
    assert values(spark, data, "x double", nl.at_least("x", 0.0)) == [9, 10, 11, 0, None]


def test_if_else_is_null_on_null_condition(spark):
    data = [(1,), (0,), (None,)]
    assert values(spark, data, "x int", nl.if_else(F.col("x") > 0, F.lit("y"), F.lit("n"))) == ["y", "n", None]
    assert values(spark, data, "x int", nl.null_if("x", F.col("x") > 0)) == [None, 0, None]


def test_blank_and_null(spark):
    data = [("",), ("a",), (None,)]
    assert values(spark, data, "x string", nl.blank_to_null("x")) == [None, "a", None]
    assert values(spark, data, "x string", nl.null_to_blank("x")) == ["", "a", ""]
    assert values(spark, data, "x string", nl.drop_nulls(F.array("x", F.lit("z")))) == [["", "z"], ["a", "z"], ["z"]]


def test_bad_numbers_become_null(spark):
    assert values(spark, [("1.5",), ("x",), ("NA",), (None,)], "x string", nl.to_number("x")) == [1.5, None, None, None]


def test_sum_over_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "g string, x int")
    assert dict(map(tuple, df.groupBy("g").agg(nl.sum_or_zero("x")).collect())) == {"a": 0, "b": 2}


def test_rounding_goes_to_the_even_multiple(spark):
    data = [(14,), (15,), (16,), (25,), (35,), (None,)]
    assert values(spark, data, "x bigint", nl.round_to("x", 10)) == [10, 20, 20, 20, 40, None]


def test_first_and_all_matches(spark):
    data = [("a=COSV1;COSV2",), ("none",), (None,)]
    assert values(spark, data, "x string", tx.first_match("x", "COSV[^;]+", 0)) == ["COSV1", None, None]
    assert values(spark, data, "x string", tx.all_matches("x", "(COSV[0-9]+)")) == [["COSV1", "COSV2"], [], None]


def test_sum_of_matches(spark):
    data = [("12(lung),3(skin)",), ("none",), (None,)]
    assert values(spark, data, "x string", tx.sum_of_matches("x", r"([0-9]+)\(")) == [15, 0, 0]
    donors = r"(?:^|,)[^|]{1,10}\|([0-9]+)"
    data = [("ABCDEFGHIJ|4|9|0.1,B|5|9|0.2",), ("ABCDEFGHIJK|4|9|0.1,B|5|9",)]
    assert values(spark, data, "x string", tx.sum_of_matches("x", donors)) == [9, 5]


def test_remove_first_only(spark):
    data = [("ab-ab",), ("xab",), ("b",), (None,), ("",)]
    assert values(spark, data, "x string", tx.remove_first("x", "ab")) == ["-ab", "x", "b", None, ""]
    assert values(spark, [("X Mutation y",)], "x string", tx.remove_first("x", r"\s?mutation\s?", True)) == ["Xy"]
    assert values(spark, [("a(b)(c)",)], "x string", tx.remove_first("x", "(b)")) == ["a()(c)"]


def test_remove_first_text(spark):
    data = [("a|b|c",), ("|x",), ("é|é|",), ("none",), (None,)]
    assert values(spark, data, "x string", tx.remove_first_text("x", "|")) == ["ab|c", "x", "éé|", "none", None]


def test_remove_trailing(spark):
    assert values(spark, [("AB-01A",), ("AB-01",), ("A",)], "x string", tx.remove_trailing("x", "[A-Z]")) == ["AB-01", "AB-01", ""]


def test_pad_before_last_widens_a_record(spark):
    got = values(spark, [("a:b:c",), ("a",)], "x string", F.split(tx.pad_before_last("x", ":", "::::"), ":"))
    assert got == [["a", "b", "", "", "", "c"], ["a"]]


def test_kept_tokens(spark):
    data = [("ref|TP53,ref|NM_1,other,ref|TP53",), ("ref|NM_1",), ("",), (None,), ("xref|A_ref|",)]
    got = values(spark, data, "x string", tx.kept_tokens("x", ",", "ref|", "ref|", "N[A-Z]_"))
    assert got == [["TP53", "TP53"], [], [], [None], ["xA_ref|"]]


def test_join_non_null(spark):
    data = [("a", "b"), ("a", None), (None, "b"), (None, None)]
    assert values(spark, data, "x string, y string", tx.join_non_null(";", "x", "y")) == ["a;b", "a", "b", ""]


def test_fields_by_key_and_place(spark):
    data = [("GT:AD:SB", "0/1:5:9"), ("GT:SB", "0/1:9"), ("GT:AD:SB", "0/1")]
    assert values(spark, data, "f string, s string", tx.field_by_key("f", "s", "SB")) == ["9", "9", None]
    assert values(spark, data, "f string, s string", tx.field_by_key("f", "s", "AD")) == ["5", None, None]
    df = spark.createDataFrame([("a:b",)], "x string").select(*tx.split_part_names("x", ":", ["p", "q", "r"]))
    assert tuple(df.first()) == ("a", "b", None)


def test_info_fields(spark):
    assert values(spark, [("DP=3;SOMATIC;AF=0.1",)], "x string", tx.info_fields("x")) == [
        {"DP": "3", "SOMATIC": None, "AF": "0.1"}
    ]


CN = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0, None]


@pytest.mark.parametrize("rule, expected", [
    (k.absolute_cn_class, ["Deep Deletion", "Normal", "Shallow Deletion", "Normal", "Normal", "Gain",
                           "Amplification", "Amplification", None]),
    (k.scaled_cn_class, ["Deep Deletion", "Normal", "Shallow Deletion", "Normal", "Gain", "Gain",
                         "Amplification", "Amplification", None]),
    (k.called_cn_class, ["Deep Deletion", None, "Shallow Deletion", "Normal", "Gain", "Gain",
                         "Amplification", "Amplification", None]),
    (lambda c: k.three_cn_class(k.scaled_cn_class(c)),
     ["Deep Deletion", "Normal", "Normal", "Normal", "Normal", "Normal", "Amplification", "Amplification", None]),
])
def test_copy_number_classes(spark, rule, expected):
    assert values(spark, [(c,) for c in CN], "cn double", rule("cn")) == expected


def test_log2_call_is_never_null(spark):
    data = [(-0.6, 0.01), (0.6, 0.01), (-0.5, 0.01), (0.5, 0.01), (0.6, 0.05), (0.6, None), (None, 0.01)]
    assert values(spark, data, "l double, p double", k.log2_call("l", "p")) == [
        "Loss", "Gain", "Normal", "Normal", "Normal", "Normal", "Normal"]


def test_consensus(spark):
    data = [(1.0, 4.0), (4.0, 1.0), (1.0, 3.0), (2.0, 2.0), (None, 5.0), (5.0, None), (None, None)]
    assert values(spark, data, "a double, b double", k.consensus_cn("a", "b")) == [1, 1, 2, 2, 5, 5, None]


def test_shifted_copy_number(spark):
    data = [("SCC4", 0.0), ("SCC4", 3.0), ("SCC4", None), ("CA1", 3.0), (None, 3.0)]
    assert values(spark, data, "s string, cn double", k.shifted_cn("cn", "s", ["SCC4"])) == [0, 2, None, 3, 3]


def test_recodes(spark):
    data = [("stopgain",), ("other",), (None,)]
    assert values(spark, data, "x string", k.recode("x", k.EXONIC_TO_SNV)) == ["Nonsense", "other", None]
    assert values(spark, data, "x string", k.lookup("x", k.EXONIC_TO_SNV)) == ["Nonsense", None, None]
    assert values(spark, [(-2,), (-1,), (0,), (1,), (2,), (None,)], "x int", k.lookup("x", k.DISCRETE_TO_CN)) == [
        "Deep Deletion", None, None, None, "Amplification", None]


def test_ordered_category(spark):
    data = [("Nonsense",), ("Missense",), ("odd",), (None,)]
    assert values(spark, data, "x string", k.ordinal("x", k.SNV_PRIORITY)) == [0, 5, None, None]
    assert values(spark, data, "x string", k.level("x", k.SNV_PRIORITY)) == ["Nonsense", "Missense", None, None]
    assert values(spark, [(0,), (6,), (None,)], "x int", k.level_of("x", k.SNV_PRIORITY)) == ["Nonsense", "Splice Site", None]


def test_threshold_label(spark):
    assert values(spark, [(10.0,), (10.1,), (None,)], "x double", k.above("x", 10.0)) == ["Negative", "Positive", None]


def test_effect_overridden_by_region(spark):
    data = [("splicing", None), ("exonic;splicing", "stopgain"), ("exonic", "stopgain"), (None, "stopgain")]
    assert values(spark, data, "r string, e string", k.effect_class("r", "e")) == ["splicing", "stopgain", "stopgain", None]


def test_layer_and_present_classes(spark):
    data = [("Gain;Missense",), ("Missense;Nonsense",), ("",), ("odd",), ("Gain;Gain",)]
    layer1, layer2 = k.TWO_LAYERS
    assert values(spark, data, "x string", k.first_in_layer("x", layer1)) == ["Gain", None, None, None, "Gain"]
    assert values(spark, data, "x string", k.first_in_layer("x", layer2)) == ["Missense", "Missense", None, None, None]
    assert values(spark, data, "x string", k.present_classes("x"))[-1] == ["Gain"]


def test_names_with_dots_are_taken_literally(spark):
    df = spark.createDataFrame([("a",)], "x string").withColumnRenamed("x", "Gene.refGene")
    assert df.select(nl.blank_to_null("Gene.refGene")).first()[0] == "a"
