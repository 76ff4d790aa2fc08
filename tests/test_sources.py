"""Readers and sinks on files written by the tests."""

import gzip
import re

import pytest


from somaframe.plans.copynumber import gene_cn_from_intervals, gene_cn_from_segments
from somaframe.plans.variants import parse_annovar
from somaframe.sources import callfiles as cf
from somaframe.sources import readers as r
from somaframe.sources import writers as w
from somaframe.sources.dimensions import DRIVER_ORDER, DRIVER_PANEL


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_check_names():
    assert r.check_names(["1000g2015aug_all", "GERP++_RS", "#Uploaded_variation", "Gene.refGene", "a b", "a_b"]) == [
        "X1000g2015aug_all", "GERP___RS", "X_Uploaded_variation", "Gene_refGene", "a_b", "a_b_1"]


def test_null_token_and_blank(spark, tmp_path, rows):
    path = _put(tmp_path / "a.tsv", "id\tx\ty\n1\t\t\n2\tNA\tNA\n3\t.\t5\n4\t\"q \"\"t\"\"\"\tx\n")
    types = {"id": "int", "x": "string", "y": "int"}
    assert rows(r.read_delimited(spark, path, types=types)) == [(1, "", None), (2, None, None), (3, ".", 5), (4, 'q "t"', None)]
    assert rows(r.read_delimited(spark, path, types=types, blank="null", null_token="."), "x") == [
        ("NA",), ('q "t"',), (None,), (None,)]
    with pytest.raises(ValueError, match="not in the file"):
        r.read_delimited(spark, path, types={"nope": "int"})


def test_differing_header_is_an_error(spark, tmp_path):
    _put(tmp_path / "1.tsv", "a\tb\n1\t2\n")
    _put(tmp_path / "2.tsv", "b\ta\n1\t2\n")
    with pytest.raises(Exception, match="CSV header|FAILED_READ_FILE"):
        r.read_delimited(spark, str(tmp_path)).collect()


def test_preamble_is_skipped_before_the_header(spark, tmp_path, rows):
    path = _put(tmp_path / "clinical.txt", "#m1\tx\n#m2\n#m3\n#m4\nOTHER\tPATIENT_ID\tPRIMARY_SITE_PATIENT\nz\tP1\ttongue\nz\tP2\t\n")
    assert rows(cf.read_clinical(spark, path)) == [("P1", "tongue"), ("P2", "")]


def test_segments_across_directories(spark, tmp_path, rows):
    head = "chromosome\tstart\tend\tgene\tlog2\tcn\tdepth\tp_ttest\tweight\n"
    for sample, name, body in (
        ("S1", "a", "1\t0\t9\tref|TP53,ref|NM_1\t0.1\t2\t1.0\t0.01\t3\n1\t9\t19\tref|TP53\t0.2\t1\t1.0\tNA\t3\n"),
        ("S1", "b", "1\t0\t9\tref|TP53\t0.3\t4\t1.0\t0.01\t3\n"),
        ("S2", "a", "1\t0\t9\tref|FAT1\t0.4\t0\t1.0\t0.01\t3\n"),
    ):
        _put(tmp_path / "cnvkit" / sample / "deep" / f"{name}.call.cns", head + body)
    _put(tmp_path / "cnvkit" / "S1" / "a.cns", head)
    segments = cf.read_segments(spark, str(tmp_path / "cnvkit"))
    assert segments.count() == 4
    assert rows(gene_cn_from_segments(segments), "sample", "gene", "cn", "log2", "p_ttest") == [
        ("S1", "TP53", 1, 0.2, None), ("S1", "TP53", 4, 0.3, 0.01), ("S2", "FAT1", 0, 0.4, 0.01)]


def test_headerless_intervals(spark, tmp_path, rows):
    _put(tmp_path / "controlfreec" / "S1.x.annotated.p.value.txt",
         '1\t0\t9\t3|gain|AB|0.5|0.01|0.02\t"gene_id ""x""; gene_name=""A"";"\n')
    got = gene_cn_from_intervals(cf.read_intervals(spark, str(tmp_path)))
    assert rows(got) == [("S1", "1", "A", 3.0, 0.01, 0.02, 0.5)]


def test_annovar(spark, tmp_path):
    source = {c: c for c in cf.ANNOVAR_TYPES}
    names = [{"X1000g2015aug_all": "1000g2015aug_all", "GERP___RS": "GERP++_RS"}.get(c, c.replace("_refGene", ".refGene")) for c in source]
    line = {"Chr": "1", "Start": "5", "End": "5", "gnomad312_AF": "0.25", "cosmic97_coding": "ID=COSV7;OCC=2(x)", "GERP___RS": "1.5"}
    _put(tmp_path / "S7.mutect2.hg38_multianno.txt",
         "\t".join([*names, "Otherinfo1"]) + "\n" + "\t".join([line.get(c, ".") for c in source] + ["z"]) + "\n")
    got = parse_annovar(cf.read_annovar(spark, str(tmp_path))).first()
    assert (got["Sample"], got["Start"], got["gnomad312_AF"], got["X1000g2015aug_all"]) == ("S7", 5, 0.25, 0.0)
    assert (got["cosmic97"], got["cosmic97_occurrence"], got["rmsk"], got["GERP_RS"]) == ("COSV7", 2.0, None, 1.5)


VEP_HEADER = "#Uploaded_variation\tSYMBOL\tMAX_AF\tGERP++_RS_rankscore"


def _vep_file(path, header, *lines):
    return _put(path, "## made by\n## more\n\n" + header + "\n" + "\n".join(lines) + "\n")


def test_preambled_text(spark, tmp_path, rows):
    types = {"X_Uploaded_variation": "string", "SYMBOL": "string", "MAX_AF": "double"}
    _vep_file(tmp_path / "annotation" / "S1" / "a.tab", VEP_HEADER, "v1\tTP53\t0.1\t-", "v2\t-\t-\t0.5")
    _vep_file(tmp_path / "annotation" / "S2" / "b.tab.gz", VEP_HEADER, "v3\tFAT1\t0.2\t0.1")
    options = dict(null_token="-", types=types, sample_pattern=r.VEP_SAMPLE, sample_col="Sample")
    expected = [("S1", "v1", "TP53", 0.1), ("S1", "v2", None, None), ("S2", "v3", "FAT1", 0.2)]
    assert rows(r.read_preambled(spark, str(tmp_path), spread=3, **options)) == expected
    _vep_file(tmp_path / "annotation" / "S3" / "c.tab", "#Uploaded_variation\tMAX_AF\tSYMBOL", "v4\t0.3\tKRT5")
    with pytest.raises(Exception, match="header differs"):
        r.read_preambled(spark, str(tmp_path), **options).collect()
    assert rows(r.read_preambled(spark, str(tmp_path), layout="per_file", **options)) == expected + [("S3", "v4", "KRT5", 0.3)]


@pytest.mark.parametrize("layout", ["shared", "per_file"])
@pytest.mark.parametrize("n", [0, 2])
def test_a_file_without_one_header_is_an_error(spark, tmp_path, layout, n):
    header = "#id\tx\n"
    _put(tmp_path / "a.tab", "##p\n" + header + "v1\t1\n")
    _put(tmp_path / "b.tab", "##p\n" + header * n + "v2\t2\n")
    _put(tmp_path / "c.tab", "##p\n")
    df = r.read_preambled(spark, str(tmp_path), types={"X_id": "string", "x": "int"}, layout=layout)
    with pytest.raises(Exception, match=f"{n} header lines"):
        df.collect()
    with pytest.raises(Exception, match=f"{n} header lines"):
        df.count()


def test_vep_columns(spark, tmp_path):
    names = [{"X_Uploaded_variation": "#Uploaded_variation", "GERP___RS_rankscore": "GERP++_RS_rankscore"}.get(c, c)
             for c in ["X_Uploaded_variation", *[c for c in cf.VEP_TYPES if c != "X_Uploaded_variation"]]]
    _vep_file(tmp_path / "annotation" / "S1" / "x.mutect2.filtered_snpEff_VEP.ann.tab", "\t".join(names), "\t".join(["-"] * len(names)))
    got = cf.read_vep(spark, str(tmp_path)).first().asDict()
    assert got.pop("Sample") == "S1" and set(got.values()) == {None} and len(got) == 25


def test_vcf(spark, tmp_path, rows):
    _put(tmp_path / "S1.vcf.gz", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"
         "1\t10\t.\tA\tT\t.\tPASS\tDP=1\tGT:SB\t0/1:3\n")
    got = r.read_vcf(spark, str(tmp_path), sample_pattern=r"([^/.]+)\.vcf", glob="*.vcf.gz")
    assert rows(got, "sample", "CHROM", "POS", "FILTER", "STATS") == [("S1", "1", 10, "PASS", "0/1:3")]


def test_wide_files(spark, tmp_path, rows):
    tracks = _put(tmp_path / "tracks.tsv", "track_name\ttrack_type\tP.1\tP.2\nTP53\tCNA\tamp_rec\t\nFAT1\tMUTATIONS\tNA\tx\n")
    assert rows(cf.read_wide(spark, tracks, ["track_name", "track_type"], "sample", "value")) == [
        ("FAT1", "MUTATIONS", "P.1", None), ("FAT1", "MUTATIONS", "P.2", "x"), ("TP53", "CNA", "P.1", "amp_rec"), ("TP53", "CNA", "P.2", "")
    ]
    panel = _put(tmp_path / "panel.csv", "depmap_id,cell_line_display_name,TP53,HLA-A\nD1,SCC4,1.5,\n")
    got = cf.read_wide(spark, panel, ["cell_line_display_name"], "gene", "cn", sep=",", drop=("depmap_id",), kind="double")
    assert rows(got) == [("SCC4", "HLA-A", None), ("SCC4", "TP53", 1.5)]


def test_tagged_union(spark, tmp_path, rows):
    head = "Gene\tType\tCensus Tier 1\tCDS Mutation\tValidated\tPosition\n"
    paths = {s: _put(tmp_path / f"{s}.tsv", head + f"G{s}\tt\tYes\tc\tv\t1:5..5\n") for s in ("SCC4", "SCC9")}
    assert rows(cf.read_catalogue(spark, paths), "sample", "Gene", "Census_Tier_1") == [("SCC4", "GSCC4", "Yes"), ("SCC9", "GSCC9", "Yes")]


def test_other_tables(spark, tmp_path, rows):
    freq = _put(tmp_path / "cmc.tsv.gz", "GENOMIC_MUTATION_ID\tX\tCOSMIC_SAMPLE_MUTATED\tMUTATION_SIGNIFICANCE_TIER\nCOSV1\tx\t5\t\n")
    assert rows(cf.read_catalogue_frequency(spark, freq)) == [("COSV1", 5, None)]
    maf = _put(tmp_path / "maf.txt", "Hugo_Symbol\tConsequence\tVariant_Classification\tVariant_Type\tTumor_Sample_Barcode\tStart_Position\nA\tc\tSilent\tSNP\tP1\t7\n")
    assert rows(cf.read_maf(spark, maf)) == [("A", "c", "Silent", "SNP", "P1", 7)]
    viral = _put(tmp_path / "viral.tsv", "Study\tSampleBarcode\tHPV\tEBV\tHBV\nHNSC\tP1A\t10.5\tNA\t\n")
    assert rows(cf.read_viral(spark, viral)) == [("HNSC", "P1A", 10.5, None, None)]
    old = _put(tmp_path / "cnv.csv", "GeneSymbol,sample,type,BF,Conrad.hg19,reads.ratio,reads.observed,reads.expected,standardizedValue\nA,s1,deletion,21,NA,0.5,1,40,-2\nB,s1,deletion,21,,0.5,1,40,-2\n")
    assert rows(cf.read_old_segments(spark, old), "GeneSymbol", "Conrad_hg19", "reads_expected") == [("A", None, 40.0), ("B", "", 40.0)]
    mut = _put(tmp_path / "mut.csv", "Gene,Sample,Func,x\nA,s1,missense,1\n")
    assert rows(cf.read_old_mutations(spark, mut)) == [("A", "s1", "missense")]


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "a", 0.5), (2, "", None), (3, None, 1.0), (4, "#x", 2.0)], "id int, x string, v double")


def _lines(path):
    from pathlib import Path
    out = []
    for part in sorted(Path(path).rglob("part-*")):
        out += part.read_text().splitlines()
    return out


def test_tsv_sink_writes_na(spark, small, tmp_path, rows):
    path = str(tmp_path / "out")
    w.write_tsv(small.coalesce(1), path)
    assert _lines(path) == ["id\tx\tv", "1\ta\t0.5", "2\t\tNA", "3\tNA\t1.0", "4\t#x\t2.0"]
    back = r.read_delimited(spark, path, types={"id": "int", "x": "string", "v": "double"}, glob="part-*")
    assert rows(back) == rows(small)


def test_plain_sink_writes_blanks(spark, small, tmp_path):
    path = str(tmp_path / "out")
    w.write_plain_tsv(small.coalesce(1), path)
    assert _lines(path) == ["id\tx\tv", "1\ta\t0.5", "2\t\t", "3\t\t1.0", "4\t#x\t2.0"]


def test_id_list_sink(spark, small, tmp_path):
    w.write_id_list(small.coalesce(1).filter("id < 2"), "x", str(tmp_path / "ids"))
    assert _lines(tmp_path / "ids") == ["a"]


def test_stages(spark, small, tmp_path, rows):
    w.write_stage(small, str(tmp_path / "stage"), by="id")
    assert rows(spark.read.parquet(str(tmp_path / "stage")), "id", "x", "v") == rows(small)
    again = w.staged(small, "small")
    assert again.schema == small.schema and rows(again) == rows(small)
    assert w.scratch_path(spark, "a") != w.scratch_path(spark, "a")
    assert again.inputFiles()[0].split("/small-")[0].endswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_display_order_covers_the_panel():
    assert sorted(DRIVER_ORDER) == sorted(DRIVER_PANEL)


def test_inner_stages_go_when_the_whole_is_written(spark):
    made = {}

    def make():
        made["inner"] = w.staged(spark.range(5), "inner")
        made["nested"] = w.staged_whole(spark, lambda: w.staged(made["inner"], "nested-inner").filter("id > 1"), "nested")
        return made["nested"].selectExpr("id * 2 as id")

    whole = w.staged_whole(spark, make, "whole")
    assert sorted(r["id"] for r in whole.collect()) == [4, 6, 8]
    left = [p for p in w._PATHS if re.search(r"/(inner|nested-inner|nested|whole)-", p)]
    assert len(left) == 1 and "/whole-" in left[0]
    with pytest.raises(ZeroDivisionError):
        w.staged_whole(spark, lambda: [w.staged(spark.range(1), "inner"), 1 / 0], "whole")
    assert any("/inner-" in p for p in w._PATHS) and w._INNER.get() is None
