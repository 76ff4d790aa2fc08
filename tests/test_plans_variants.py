"""Variant plans on small annotated tables."""

import pytest
from pyspark.sql import functions as F

from somaframe.plans import variants as v


def test_parse_annovar(spark):
    df = spark.createDataFrame(
        [(None, 0.5, "ID=COSV1,COSV2;OCC=2(a),3(b)", "A|4|9|0.1"), (0.1, None, None, None)],
        "X1000g2015aug_all double, gnomad312_AF double, cosmic97_coding string, ICGC_Occurrence string")
    got = v.parse_annovar(df, ["X1000g2015aug_all", "gnomad312_AF"])
    assert got.columns == ["X1000g2015aug_all", "gnomad312_AF", "ICGC_Occurrence", "cosmic97", "cosmic97_occurrence"]
    assert [tuple(r) for r in got.collect()] == [(0.0, 0.5, 4.0, "COSV1,COSV2", 5.0), (0.1, 0.0, 0.0, None, 0.0)]


def test_recurrence_counts_distinct_rows(spark, rows):
    data = [("s1", "v", "x"), ("s1", "v", "x"), ("s1", "v", "y"), ("s2", "v", "x"), ("s3", None, "x"), ("s4", None, "x")]
    df = spark.createDataFrame(data, "sample string, Chr string, note string")
    assert rows(v.recurrence_counts(df, ["Chr"])) == [("v", 3), (None, 2)]
    assert rows(v.recurrence_counts(df, ["Chr"], distinct_on=["sample"])) == [("v", 2), (None, 2)]
    full = v.variant_recurrence(df, ["Chr"])
    assert full.count() == 6 and rows(full.filter("Chr is null"), "sample", "recurrence") == [("s3", 2), ("s4", 2)]
    assert rows(v.variant_recurrence(df, ["Chr"], distinct=False).filter("Chr = 'v'"), "recurrence") == [(4,)] * 4


def test_filter_coding_variants(spark):
    keep = (4, 0.001, "exonic", "nonsynonymous SNV", None)
    cases = {
        "kept": keep,
        "recurrent": (5, *keep[1:]),
        "common": (4, 0.01, *keep[2:]),
        "intronic": (4, 0.001, "intronic", *keep[3:]),
        "no region": (4, 0.001, None, *keep[3:]),
        "silent": (4, 0.001, "exonic", "synonymous SNV", None),
        "splicing": (4, 0.001, "splicing", None, "rep"),
        "both regions": (4, 0.001, "exonic;splicing", "stopgain", None),
        "insertion in repeat": (4, 0.001, "exonic", "nonframeshift insertion", "rep"),
        "insertion": (4, 0.001, "exonic", "nonframeshift insertion", None),
        "deletion in repeat": (4, 0.001, "exonic", "nonframeshift deletion", "rep"),
    }
    df = spark.createDataFrame(
        [(name, *c) for name, c in cases.items()],
        "name string, recurrence int, gnomad312_AF double, Func_refGene string, ExonicFunc_refGene string, rmsk string")
    got = v.filter_coding_variants(df, frequencies=["gnomad312_AF"])
    assert {r["name"]: r["ExonicFunc_simplified"] for r in got.collect()} == {
        "kept": "Missense", "splicing": "Splice Site", "both regions": "Nonsense",
        "insertion": "Inframe InDel", "deletion in repeat": "Inframe InDel"}


def test_catalogue_match(spark, rows):
    raw = spark.createDataFrame(
        [("TP53", "Substitution - Missense", "17:14..14"), ("TP53", "Substitution - Missense", "17:25..25"),
         ("X_ENST00000123", "Substitution - Missense", "1:5..5"), ("FAT1", "Substitution - coding silent", "4:1..1"),
         ("FAT1", "Deletion", "no position")], "Gene string, Type string, Position string").withColumn("sample", F.lit("S1"))
    catalogue = v.parse_catalogue(raw).withColumnRenamed("Gene", "gene")
    assert rows(catalogue, "gene", "position_start") == [("FAT1", None), ("TP53", 14.0), ("TP53", 25.0)]
    found = spark.createDataFrame(
        [("TP53", "S1", 6), ("TP53", "S1", 15), ("TP53", "S1", 35), ("TP53", "S2", 14)], "gene string, sample string, start int")
    got = rows(v.match_catalogue(found, catalogue), "gene", "approx_start", "position_start", "start")
    assert got == [("FAT1", None, None, None), ("TP53", 10.0, 14.0, 6), ("TP53", 20.0, 25.0, 15), ("TP53", 40.0, None, 35)]


VEP = "name string, BIOTYPE string, IMPACT string, Consequence string, Existing_variation string, MAX_AF double"


@pytest.fixture(scope="module")
def vep(spark):
    return spark.createDataFrame([
        ("a", "protein_coding", "HIGH", "stop_gained", "rs1,COSV1,COSV2", 0.005),
        ("a", "protein_coding", "HIGH", "stop_gained", "rs1,COSV1,COSV2", 0.005),   # repeated row
        ("b", "protein_coding", "MODERATE", "missense_variant&splice", "COSV3", 0.02),
        ("c", "protein_coding", "MODERATE", "missense_variant", None, None),
        ("d", "protein_coding", "MODERATE", "inframe_deletion", "rs2", 0.01),
        ("e", "protein_coding", "LOW", "missense_variant", None, 0.0),
        ("f", "lncRNA", "HIGH", "stop_gained", None, 0.0),
        ("g", "protein_coding", "MODIFIER", "intron_variant", None, 0.0),
        ("h", None, "HIGH", "stop_gained", None, 0.0),
    ], VEP)


def test_filter_vep(vep, rows):
    assert rows(v.filter_vep(vep), "name") == [("a",), ("a",), ("b",), ("c",), ("d",)]


def test_enrichment_equals_explode_join_and_regroup(spark, vep, rows):
    frequency = spark.createDataFrame(
        [("COSV1", 5, "1"), ("COSV1", 7, "2"), ("COSV2", None, None), ("COSV9", 3, "3"), (None, 11, "x")],
        "catalogue_id string, n_mutated long, tier string")
    kept = v.filter_vep(vep)
    got = v.enrich_catalogue(kept, frequency)
    assert rows(got, "name", "catalogue_id", "tier", "n_mutated") == [
        ("a", "COSV1,COSV2", "1,2", 24), ("b", "COSV3", "", 0), ("c", "", "", 0), ("d", "", "", 0)]
    exploded = v.explode_ids(kept)
    assert exploded.count() == 2 * 2 + 1 + 1 + 1
    slow = v.collapse_ids(exploded.join(frequency.filter("catalogue_id is not null"), "catalogue_id", "left"))
    order = ["name", "catalogue_id", "tier", "n_mutated", "MAX_AF", "Existing_variation"]
    assert rows(slow, *order) == rows(got, *order)


def test_rare_and_conflicting(vep, rows):
    kept = v.filter_vep(vep).dropDuplicates()
    assert rows(v.filter_rare(kept), "name") == [("a",), ("c",)]
    assert rows(v.filter_rare(kept, missing="drop"), "name") == [("a",)]
    with pytest.raises(ValueError):
        v.filter_rare(kept, missing="maybe")
    counted = kept.withColumn("n_mutated", F.lit(51))
    assert rows(v.conflicting_variants(counted, min_frequency=0.015), "name") == [("b",)]


def test_flatten_vcf(spark):
    long_form = "GT:AD:AF:DP:F1R2:F2R1:FAD:PGT:PID:PS:SB"
    df = spark.createDataFrame([
        ("1", "PASS", "DP=3;CSQ=A|stop|HIGH,A||LOW;X", long_form, "0/1:2:3:4:5:6:7:8:9:10:11"),
        ("2", "PASS", "DP=3", "GT:AD:AF:DP:F1R2:F2R1:FAD:SB", "0/1:2:3:4:5:6:7:11"),
        ("3", "PASS", "XCSQ=no;CSQ=T|x|y", "GT:SB", "0/1"),
        ("4", "weak", "CSQ=T|x|y", "GT:SB", "0/1:5"),
    ], "ID string, FILTER string, INFO string, FORMAT string, STATS string")
    flat = v.flatten_vcf(df, ["Allele", "Consequence", "IMPACT"], keep_info=True)
    got = {(r["ID"], r["csq_IMPACT"]): r for r in flat.collect()}
    assert set(got) == {("1", "HIGH"), ("1", "LOW"), ("2", None), ("3", "y")}
    assert got["1", "LOW"]["csq_Consequence"] == "" and got["1", "HIGH"]["fmt_PGT"] == "8"
    assert (got["2", None]["fmt_PGT"], got["2", None]["fmt_SB"], got["2", None]["fmt_FAD"]) == (None, "11", "7")
    assert got["3", "y"]["fmt_SB"] is None and got["3", "y"]["info"] == {"XCSQ": "no", "CSQ": "T|x|y"}
    blank = v.flatten_vcf(df, ["Allele"], blank=True).filter("ID = '2'").first()
    assert blank["fmt_PGT"] == "" and blank["fmt_SB"] == "11"
    assert len(v.flatten_vcf(df).columns) == 2 + 11 + 69


def test_dedupe_maf_keeps_a_missing_class(spark, rows):
    data = [("A", "p1", "Silent"), ("A", "p1", None), ("A", "p1", "Missense_Mutation"), ("A", "p1", "Missense_Mutation"),
            ("A", "p1", "5'UTR")]
    df = spark.createDataFrame(data, "g string, p string, c string")
    assert rows(v.dedupe_maf(df, df.columns, "c")) == [("A", "p1", "Missense_Mutation"), ("A", "p1", None)]
