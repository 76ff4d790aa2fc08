"""Copy-number plans on small call tables."""

import math

import pytest

from somaframe.plans import copynumber as cn

SEGMENT = "file string, sample string, chromosome string, start long, end long, gene string, cn int, log2 double, depth double, p_ttest double, weight double"


def _segment(file, sample, chrom, start, gene, copies, log2):
    return (file, sample, chrom, start, start + 9, gene, copies, log2, 1.0, 0.01, 2.0)


def test_genes_from_segments(spark, rows):
    data = [
        _segment("f1", "S1", "1", 0, "ref|TP53,ref|NM_1,ref|TP53", 3, 0.1),   # duplicate token
        _segment("f1", "S1", "1", 10, "ref|TP53,other", 1, 0.2),              # lower: wins
        _segment("f1", "S1", "1", 20, "ref|TP53", 1, 0.3),                    # tie, kept
        _segment("f1", "S1", "2", 0, "ref|TP53", 4, 0.4),                     # other chromosome
        _segment("f1", "S1", "1", 30, "ref|NM_2,NM_3", 0, 0.5),               # accessions only
        _segment("f1", "S1", "1", 40, "", 0, 0.6),
        _segment("f1", "S1", "1", 50, "ref|FAT1", None, 0.7),                 # only missing copies
        _segment("f1", "S1", "1", 60, "ref|FAT1", None, 0.8),
        _segment("f2", "S1", "1", 0, "ref|TP53", 6, 0.9),                     # same sample, other file
        _segment("f1", "S1", "1", 70, None, 2, 1.0),                          # missing gene
    ]
    got = cn.gene_cn_from_segments(spark.createDataFrame(data, SEGMENT))
    assert got.columns == ["sample", "chromosome", "gene", "cn", "log2", "depth", "p_ttest", "weight"]
    by_log2 = {r["log2"]: (r["sample"], r["chromosome"], r["gene"], r["cn"]) for r in got.collect()}
    assert by_log2 == {
        0.2: ("S1", "1", "TP53", 1), 0.3: ("S1", "1", "TP53", 1), 0.4: ("S1", "2", "TP53", 4),
        0.7: ("S1", "1", "FAT1", None), 0.8: ("S1", "1", "FAT1", None), 0.9: ("S1", "1", "TP53", 6),
        1.0: ("S1", "1", None, 2),
    }


def test_genes_from_intervals(spark, rows):
    data = [
        ("f", "S1", "1", 0, 9, "10|gain|AB|0.5|0.01|0.02", 'gene_id="x"; gene_name="A"; gene_name="B";'),
        ("f", "S1", "1", 9, 19, "2|loss|A|NA|x|0.03", 'gene_name="A"'),
        ("f", "S1", "1", 19, 29, "2|loss", 'gene_name="B"'),
        ("f", "S1", "1", 29, 39, "1|loss|A|1|1|1", "no names"),
    ]
    df = spark.createDataFrame(data, "file string, sample string, chromosome string, start long, end long, other string, gene string")
    assert rows(cn.gene_cn_from_intervals(df), "gene", "cn", "uncertainty", "wilcoxon_p", "ks_p") == [
        ("A", 2.0, None, None, 0.03), ("B", 2.0, None, None, None)]
    as_text = rows(cn.gene_cn_from_intervals(df, numeric=False), "gene", "cn", "uncertainty", "wilcoxon_p", "ks_p")
    assert as_text == [("A", 10.0, 0.5, 0.01, 0.02), ("B", 10.0, 0.5, 0.01, 0.02)]


def test_merge_caps_fills_and_multiplies_ties(spark, rows):
    schema = "sample string, chromosome string, gene string, cn double"
    a = spark.createDataFrame([("s", "1", "A", 9.0), ("s", "1", "A", 12.0), ("s", "1", None, 1.0), ("s", "1", "L", 3.0)], schema)
    b = spark.createDataFrame([("s", "1", "A", 25.0), ("s", "1", "A", 20.0), ("s", "1", None, 4.0), ("s", "1", "R", None)], schema)
    got = rows(cn.merge_cn_callers(a, b), "gene", "cn_a", "cn_b")
    assert got == [("A", 9, 20), ("A", 9, 20), ("A", 10, 20), ("A", 10, 20), ("L", 3, 2), ("R", 2, 2), (None, 1, 4)]


def test_reference_panel(spark, rows):
    wide = spark.createDataFrame(
        [("ACH-1", "SCC4", "x", "x", "x", "x", 0.0, 3.0, None), ("ACH-2", "SCC25", "x", "x", "x", "x", 4.0, 3.0, 1.0)],
        "depmap_id string, cell_line_display_name string, lineage_1 string, lineage_2 string, lineage_3 string,"
        " lineage_4 string, A double, B double, C double")
    got = rows(cn.reference_cn(wide), "gene", "sample", "cn", "cn_as_diploid", "cn_class", "cn_as_diploid_class", "cn_class3", "cn_as_diploid_class3")
    assert got == [
        ("A", "SCC25", 4, 4, "Gain", "Gain", "Normal", "Normal"),
        ("A", "SCC4", 0, 0, "Deep Deletion", "Deep Deletion", "Deep Deletion", "Deep Deletion"),
        ("B", "SCC25", 3, 3, "Normal", "Gain", "Normal", "Normal"),
        ("B", "SCC4", 3, 2, "Normal", "Normal", "Normal", "Normal"),
        ("C", "SCC25", 1, 1, "Shallow Deletion", "Shallow Deletion", "Normal", "Normal"),
        ("C", "SCC4", None, None, None, None, None, None)]


def test_comparison_and_correlations(spark):
    panel = cn.scale_reference(spark.createDataFrame(
        [(f"g{i}", s, float(i % 6)) for i in range(30) for s in ("SCC4", "SCC25")], "gene string, sample string, cn double"))
    merged = spark.createDataFrame(
        [(f"g{i}", s, float(i % 6), i / 7, float((i * 3) % 8)) for i in range(5, 40) for s in ("SCC4", "SCC25")],
        "gene string, sample string, cn_a double, log2_a double, cn_b double")
    compared = cn.compare_cn(panel, merged)
    assert compared.count() == 50
    row = compared.filter("gene = 'g8' and sample = 'SCC4'").first()
    assert (row["cn_a"], row["cn_b"], row["cn_mean"], row["cn_min_dev"]) == (2, 0, 1, 2)
    tested = {(r["x_name"], r["y_name"]): r for r in cn.cn_correlations(compared).collect()}
    assert set(tested) == set(cn.COMPARED_PAIRS) and all(r["n"] == 50 for r in tested.values())
    assert tested["cn", "cn_a"]["rho"] == pytest.approx(1.0)


def test_volcano(spark):
    df = spark.createDataFrame([(0.0, -5.0), (0.001, 1.0), (0.05, 0.0), (0.06, -4.0), (None, None)], "p_ttest double, log2 double")
    got = [(r["neglog_p"], r["trimmed_log2"]) for r in cn.volcano_table(df).collect()]
    assert got[0] == (pytest.approx(3.0), -4.0) and got[1][0] == pytest.approx(-math.log10(0.002))
    assert got[2][0] == pytest.approx(-math.log10(0.051)) and got[3] == (None, -4.0) and got[4] == (None, None)
    other = spark.createDataFrame([(0.1,), (0.0,)], "p double")
    shifted = cn.volcano_table(df, p_source=other, p_source_col="p").collect()
    assert shifted[0]["neglog_p"] == pytest.approx(1.0)


def test_status_columns(spark, rows):
    df = spark.createDataFrame([(0, -1.0, 0.01), (2, 0.0, 0.5), (6, 1.0, None)], "cn int, log2 double, p_ttest double")
    assert rows(cn.classify_cn(df), "cn", "status") == [(0, "Deep Deletion"), (2, "Normal"), (6, "Amplification")]
    assert rows(cn.classify_log2(df), "cn", "status") == [(0, "Loss"), (2, "Normal"), (6, "Normal")]


def test_gene_medians(spark, rows):
    df = spark.createDataFrame([("A", 1.0), ("A", 4.0), ("B", 2.0), ("B", None)], "gene string, cn double")
    assert rows(cn.gene_medians(df)) == [("A", 2.5), ("B", 2.0)]
