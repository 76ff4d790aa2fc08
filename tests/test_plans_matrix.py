"""Alteration matrix, cohort sets and the earlier table forms."""

import pytest
from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.plans import matrix as m
from somaframe.plans import tracks as t
from somaframe.sources.dimensions import dimension

PANEL = ["TP53", "FAT1", "CASP8"]


@pytest.fixture(scope="module")
def calls(spark):
    snv = spark.createDataFrame([
        ("s1", "TP53", "Missense"), ("s1", "TP53", "Nonsense"), ("s2", "TP53", "odd"), ("s3", "FAT1", "Frameshift"),
        ("s4", "KRT5", "Missense"), ("s9", "TP53", "Missense")], "sample string, gene string, snv string")
    cna = spark.createDataFrame([
        ("s1", "TP53", "Loss"), ("s1", "TP53", "Loss"), ("s1", "FAT1", "Gain"), ("s1", "FAT1", "Loss"),
        ("s2", "FAT1", "Normal"), ("s3", "KRT5", "Gain"), ("s4", "TP53", "Normal"), ("s8", "TP53", "Gain")],
        "sample string, gene string, cna string")
    return cna, snv


EVENTS = [("FAT1", "s1", "Gain;Loss"), ("FAT1", "s3", "Frameshift"), ("TP53", "s1", "Loss;Nonsense"),
          ("TP53", "s2", ""), ("TP53", "s8", "Gain"), ("TP53", "s9", "Missense")]


def test_alteration_events(calls, rows):
    cna, snv = calls
    assert rows(m.alteration_events(cna, snv, PANEL)) == EVENTS
    best = m.top_priority_mutation(snv, PANEL)
    assert rows(m.alteration_events(cna, best, PANEL)) == EVENTS
    labelled = rows(m.alteration_events(cna, snv, PANEL, complex_panel=["FAT1"]), "gene", "group")
    assert labelled[0] == ("FAT1", "NuRD Complex") and labelled[-1] == ("TP53", "Recurrent mutations in OSCC")


def test_complete_samples_come_from_the_unfiltered_tables(calls, rows):
    cna, snv = calls
    assert rows(m.complete_samples(snv, cna)) == [("s1",), ("s2",), ("s3",), ("s4",)]


@pytest.mark.parametrize("restrict", [False, True])
@pytest.mark.parametrize("all_genes", [False, True])
def test_matrix_switches(calls, restrict, all_genes):
    cna, snv = calls
    events = m.alteration_events(cna, snv, PANEL)
    matrix = m.alteration_matrix(events, PANEL, m.complete_samples(snv, cna), restrict_to_complete=restrict, all_genes=all_genes)
    cells = {(r["gene"], r["sample"]): r["alterations"] for r in matrix.collect()}
    samples = {"s1", "s2", "s3", "s4"} | (set() if restrict else {"s8", "s9"})
    genes = set(PANEL) if all_genes else {"TP53", "FAT1"}
    assert set(cells) == {(g, s) for g in genes for s in samples}
    assert {c: a for c, a in cells.items() if a} == {(g, s): a for g, s, a in EVENTS if a and s in samples}


def test_frequencies_agree_between_dense_and_sparse(calls, rows):
    cna, snv = calls
    events, complete = m.alteration_events(cna, snv, PANEL), m.complete_samples(snv, cna)
    for restrict in (False, True):
        dense = m.alteration_frequency(m.alteration_matrix(events, PANEL, complete, restrict_to_complete=restrict))
        sparse = m.frequency_from_events(events, PANEL, complete, restrict_to_complete=restrict)
        assert rows(dense, *sparse.columns) == rows(sparse)
    assert rows(sparse) == [("CASP8", 0, 4, 4, 0.0), ("FAT1", 2, 2, 4, 50.0), ("TP53", 1, 3, 4, 25.0)]


def test_class_counts_and_wide_form(calls, rows):
    cna, snv = calls
    matrix = m.alteration_matrix(m.alteration_events(cna, snv, PANEL), PANEL, m.complete_samples(snv, cna))
    assert rows(m.class_counts(matrix, "gene").filter("gene = 'FAT1'"), "class", "n") == [("Frameshift", 1), ("Gain", 1), ("Loss", 1)]
    assert rows(m.class_counts(matrix, "sample").filter("sample = 's1'"), "class", "n") == [("Gain", 1), ("Loss", 2), ("Nonsense", 1)]
    wide = m.wide_matrix(matrix, ["s1", "s4", "none"])
    assert rows(wide) == [("CASP8", "", "", ""), ("FAT1", "Gain;Loss", "", ""), ("TP53", "Loss;Nonsense", "", "")]


def test_without_class_removes_the_first_only(spark, rows):
    data = [(0, "Shallow Deletion;Missense"), (1, "Missense;Shallow Deletion"), (2, "Shallow Deletion"),
            (3, "Shallow Deletion;Shallow Deletion"), (4, "")]
    df = spark.createDataFrame(data, "i int, alterations string")
    assert rows(m.without_class(df)) == [(0, "Missense"), (1, "Missense;"), (2, ""), (3, "Shallow Deletion"), (4, "")]


def test_viral_status_and_exclusion(spark, rows):
    data = [("HNSC", "TCGA-1A", 10.0, 5.0, 6.0), ("HNSC", "TCGA-2B", 10.5, None, 0.0), ("HNSC", "TCGA-2C", 99.0, 0.0, 0.0),
            ("LUAD", "TCGA-3A", 99.0, 0.0, 0.0), ("HNSC", None, 99.0, 0.0, 0.0)]
    viral = spark.createDataFrame(data, "Study string, SampleBarcode string, HPV double, EBV double, HBV double")
    status = m.viral_status(viral)
    assert rows(status, "patient", "HPV_status", "EBV_status", "HBV_status") == [
        ("TCGA-1", "Negative", "Negative", "Positive"), ("TCGA-2", "Positive", "Negative", "Negative"),
        ("TCGA-2", "Positive", None, "Negative"), (None, "Positive", "Negative", "Negative")]
    samples = spark.createDataFrame([("TCGA-1",), ("TCGA-2",), ("TCGA-3",)], "sample string")
    kept = m.without_patients(samples, m.positive_patients(status))
    assert rows(kept) == [("TCGA-1",), ("TCGA-3",)]


def test_discrete_events(spark, rows):
    wide = spark.createDataFrame([("A", 7, -2, -1, 0), ("B", 8, 1, 2, None), ("C", 9, 2, 2, 2)],
                                 "Hugo_Symbol string, Entrez_Gene_Id long, p1 int, p2 int, p3 int")
    assert rows(m.discrete_cn_events(wide, ["A", "B"])) == [("A", "p1", "Deep Deletion"), ("B", "p2", "Amplification")]
    long = spark.createDataFrame([("A", "p1", "-2"), ("A", "p2", "0")], "Hugo_Symbol string, sample string, cna string")
    assert rows(m.discrete_cn_events(long=long)) == [("A", "p1", "Deep Deletion")]


def test_multi_hit_marks_the_last_class(spark, rows):
    data = [("A", "s1", "missense"), ("A", "s2", "missense"), ("A", "s2", "frameshift"),
            ("A", "s3", "stop loss"), ("A", "s3", "start loss"), ("A", "s3", "splice site")]
    df = spark.createDataFrame(data, "gene string, sample string, func string")
    other = "Other non-synonymous mutations"
    assert rows(t.multi_hit_classes(df)) == [
        ("A", "s1", "Missense"), ("A", "s2", "Frameshift;Missense_2"), ("A", "s3", f"Splice site;{other};{other}_2")]


def test_segment_filter(spark):
    good = (30.0, None, "deletion", 0.4, 5.0, 20.0, -1.5)
    cases = {
        "kept": good,
        "weak": (20.0, *good[1:]), "known": (30.0, "CNV1", *good[2:]), "text NA": (30.0, "NA", *good[2:]),
        "blank": (30.0, "", *good[2:]),
        "contradicts": (30.0, None, "deletion", 1.0, *good[4:]),
        "duplication": (30.0, None, "duplication", 1.5, *good[4:]),
        "large": (30.0, None, "deletion", 0.4, 1.0, 31.0, 1.0),
        "not expected": (30.0, None, "deletion", 0.4, 1.0, 30.0, 1.0),
        "small z": (30.0, None, "deletion", 0.4, 5.0, 20.0, 0.99),
        "no ratio": (30.0, None, "deletion", None, 5.0, 20.0, 2.0),
    }
    schema = ("name string, BF double, Conrad_hg19 string, type string, reads_ratio double, reads_observed double,"
              " reads_expected double, standardizedValue double")
    got = t.filter_segments(spark.createDataFrame([(n, *c) for n, c in cases.items()], schema))
    assert {r["name"]: r["cna"] for r in got.collect()} == {
        "kept": "Shallow Deletion", "duplication": "Amplification", "large": "Deep Deletion", "not expected": "Shallow Deletion"}


@pytest.fixture(scope="module")
def portal(spark):
    return spark.createDataFrame([
        ("TP53", "CNA", "amp_rec", "", "hetloss_rec", None),
        ("TP53", "MUTATIONS", "Truncating mutation (putative driver)", "Missense Mutation (putative passenger)", "", "splice_rec"),
        ("FAT1", "MUTATIONS", "splice", "", None, "odd"),
        ("FAT1", "OTHER", "x", "x", "x", "x"),
    ], "track_name string, track_type string, s1 string, s2 string, s3 string, s4 string")


def test_tracks(spark, portal, rows):
    got = {(r["track_name"], r["sample"]): r["alterations"] for r in t.unpivot_tracks(portal).collect()}
    assert got == {
        ("TP53", "s1"): "Amplification;Truncating", ("TP53", "s2"): "Missense", ("TP53", "s3"): "Shallow Deletion",
        ("TP53", "s4"): "Splice site", ("FAT1", "s1"): "Splice site", ("FAT1", "s2"): "", ("FAT1", "s3"): "", ("FAT1", "s4"): "odd"}
    blank = t.unpivot_tracks(portal, keep_blank=True).filter("track_name = 'TP53' and sample = 's3'").first()
    assert blank["alterations"] == "Shallow Deletion;"
    ranked = t.driver_priority(t.unpivot_tracks(portal, ranked=True))
    assert rows(ranked.filter("track_name = 'TP53'"), "sample", "snv_simple", "priority") == [
        ("s1", "Truncating mutation", 0), ("s2", "Missense Mutation", 6), ("s3", None, None), ("s4", "Splice Mutation", 2)]
    assert ranked.filter("track_name = 'FAT1' and sample = 's4'").first()["snv"] is None
    sites = spark.createDataFrame([("P-s1", "tongue")], "sample string, site string")
    located = t.unpivot_tracks(portal, sites=sites, site_key=lambda s: F.concat(F.lit("P-"), s))
    assert rows(located.filter("track_name = 'TP53'"), "sample", "site")[:2] == [("s1", "tongue"), ("s2", None)]
    with pytest.raises(Exception, match="listed twice"):
        t.unpivot_tracks(portal.union(portal)).collect()


def test_panel_matrix(spark, rows):
    events = spark.createDataFrame(
        [("TP53", "s1", "Shallow Deletion;Missense"), ("TP53", "s1", "Gain"), ("FAT1", "s2", "Shallow Deletion"), ("X", "s1", "Gain")],
        "gene string, sample string, alterations string")
    assert rows(t.panel_matrix(events, PANEL, ["s1", "s2", "s3"])) == [
        ("CASP8", "", "", ""), ("FAT1", "", "Shallow Deletion", ""), ("TP53", "Gain;Shallow Deletion;Missense", "", "")]
    assert rows(t.panel_matrix(events, PANEL, ["s1", "s2"], drop_shallow=True)) == [
        ("CASP8", "", ""), ("FAT1", "", ""), ("TP53", "Gain;Missense", "")]


def test_merge_events_keeps_repeated_copy_number_rows(spark, rows):
    cna = spark.createDataFrame([("A", "s1", "Gain"), ("A", "s1", "Loss"), ("B", "s1", "Gain")], "gene string, sample string, cna string")
    snv = spark.createDataFrame([("A", "s1", "Missense"), ("C", "s1", None)], "gene string, sample string, snv string")
    assert rows(t.merge_events(cna, snv), "gene", "alterations") == [
        ("A", "Gain;Missense"), ("A", "Loss;Missense"), ("B", "Gain"), ("C", "")]


def test_dimension_is_deduplicated(spark, rows):
    assert rows(dimension(spark, ["b", "a", "b"], "gene")) == [("a", 1), ("b", 0)]
    assert k.SNV_PRIORITY[0] == "Nonsense"
