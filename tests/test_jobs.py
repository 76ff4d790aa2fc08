"""Whole jobs from files to tables."""

import gzip

import pytest

from somaframe.plans import jobs
from somaframe.sources import callfiles as cf


def _put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join("\t".join(map(str, line)) if isinstance(line, tuple) else line for line in lines) + "\n"
    path.write_bytes(gzip.compress(text.encode())) if path.suffix == ".gz" else path.write_text(text)
    return str(path)


@pytest.fixture
def call_files(tmp_path):
    head = "chromosome\tstart\tend\tgene\tlog2\tcn\tdepth\tp_ttest\tweight"
    for sample, log2, copies in (("SCC4", 1.2, 6), ("SCC25", -1.5, 0)):
        _put(tmp_path / "cnvkit" / sample / "a.call.cns", head,
             ("1", 0, 9, "ref|TP53,ref|NM_1", log2, copies, 1.0, 0.001, 3),
             ("1", 9, 19, "ref|FAT1", 0.1, 2, 1.0, 0.0, 3), ("1", 19, 29, "ref|CASP8", log2, 12, 1.0, 0.2, 3))
        _put(tmp_path / "controlfreec" / f"{sample}.x.annotated.p.value.txt",
             ("1", 0, 9, f"{copies}|gain|AB|0.5|0.01|0.02", '"gene_name=""TP53"";"'))
    (tmp_path / "panel.csv").write_text(
        "depmap_id,cell_line_display_name,lineage_1,lineage_2,lineage_3,lineage_4,TP53,FAT1,CASP8\n"
        "D1,SCC4,a,b,c,d,5,3,2\nD2,SCC25,a,b,c,d,0,2,3\n")
    return tmp_path


def test_copy_number_job(spark, call_files, rows):
    out = str(call_files / "calls")
    tables = jobs.copy_number_job(
        spark, str(call_files / "cnvkit"), str(call_files / "controlfreec"), str(call_files / "panel.csv"), out)
    assert rows(tables["calls"], "sample", "gene", "status") == [
        ("SCC25", "CASP8", "Normal"), ("SCC25", "FAT1", "Normal"), ("SCC25", "TP53", "Loss"),
        ("SCC4", "CASP8", "Normal"), ("SCC4", "FAT1", "Normal"), ("SCC4", "TP53", "Gain")]
    assert rows(tables["compared"], "sample", "gene", "cn_as_diploid", "cn_a", "cn_b", "cn_min_dev")[3:] == [
        ("SCC4", "CASP8", 1, 10, 2, 2), ("SCC4", "FAT1", 2, 2, 2, 2), ("SCC4", "TP53", 4, 6, 6, 6)]
    correlations = tables["correlations"].collect()
    assert len(correlations) == 10 and all(r["n"] == 6 for r in correlations)
    volcano = {(r["sample"], r["gene"]): r["neglog_p"] for r in tables["volcano"].collect()}
    assert volcano["SCC4", "FAT1"] == pytest.approx(3.0) and volcano["SCC4", "CASP8"] is None
    assert rows(tables["medians"])[0] == ("CASP8", 12.0)
    assert rows(tables["five_class_calls"].filter("gene = 'TP53'"), "sample", "status") == [
        ("SCC25", "Deep Deletion"), ("SCC4", "Amplification")]

    names = [{"X1000g2015aug_all": "1000g2015aug_all", "GERP___RS": "GERP++_RS"}.get(c, c.replace("_refGene", ".refGene"))
             for c in cf.ANNOVAR_TYPES]

    def line(**given):
        return tuple(given.get(c, ".") for c in cf.ANNOVAR_TYPES)

    base = dict(Chr="17", Ref="A", Alt="T", Func_refGene="exonic", Gene_refGene="TP53")
    _put(call_files / "annovar" / "SCC4.mutect2.hg38_multianno.txt", tuple(names),
         line(**base, Start=14, End=14, ExonicFunc_refGene="nonsynonymous SNV"),
         line(**base, Start=90, End=90, ExonicFunc_refGene="stopgain", gnomad312_AF="0.2"),
         line(**{**base, "Func_refGene": "splicing"}, Start=50, End=50))
    _put(call_files / "annovar" / "SCC9.mutect2.hg38_multianno.txt", tuple(names),
         line(**{**base, "Gene_refGene": "KRT5"}, Start=7, End=7, ExonicFunc_refGene="stoploss"))
    curated = _put(call_files / "SCC4.tsv", "Gene\tType\tCensus Tier 1\tCDS Mutation\tValidated\tPosition",
                   ("TP53", "Substitution - Missense", "Yes", "c.1", "v", "17:13..13"))
    variants_out = str(call_files / "variants")
    found = jobs.annovar_job(spark, str(call_files / "annovar"), variants_out, {"SCC4": curated})
    assert rows(found["filtered"], "Sample", "Start", "ExonicFunc_simplified") == [
        ("SCC4", 14, "Missense"), ("SCC4", 50, "Splice Site"), ("SCC9", 7, "Stop Loss")]
    assert rows(found["matched"], "approx_start", "Start", "cds_mutation") == [
        (10.0, 14, "c.1"), (50.0, 50, None), (90.0, 90, None)]

    result = jobs.cell_line_matrix_job(spark, variants_out, out)
    cells = {(r["gene"], r["sample"]): r["alterations"] for r in result["matrix"].collect()}
    assert {c: a for c, a in cells.items() if a} == {("TP53", "SCC4"): "Gain;Missense", ("TP53", "SCC25"): "Loss"}
    assert len(cells) == 6 * 2
    assert rows(result["frequency"].filter("n_altered > 0"), "gene", "n_altered", "pct_altered") == [("TP53", 2, 100.0)]
    assert rows(result["sample_order"]) == [("SCC25", 2), ("SCC4", 1)]
    assert rows(result["gene_classes"]) == [("TP53", "Gain", 1), ("TP53", "Loss", 1), ("TP53", "Missense", 1)]


def test_cohort_matrix_job(spark, tmp_path, rows):
    maf = _put(tmp_path / "maf.txt",
               "Hugo_Symbol\tConsequence\tVariant_Classification\tVariant_Type\tTumor_Sample_Barcode\tStart_Position",
               ("TP53", "c", "Missense_Mutation", "SNP", "P1", 1), ("TP53", "c", "Missense_Mutation", "SNP", "P1", 1),
               ("TP53", "c", "Nonsense_Mutation", "SNP", "P1", 2), ("KRT5", "c", "Missense_Mutation", "SNP", "P2", 3),
               ("FAT1", "c", "Frame_Shift_Del", "DEL", "P3", 4), ("FAT1", "c", "Silent", "SNP", "P4", 4),
               ("FAT1", "c", "Missense_Mutation", "SNP", "P5", 4))
    wide = _put(tmp_path / "cna.txt", "Hugo_Symbol\tEntrez_Gene_Id\tP1\tP2\tP3\tP4",
                ("TP53", 7, -2, 1, 0, 2), ("CASP8", 8, 0, 2, "NA", 0), ("KRT5", 9, 2, 2, 2, 2))
    viral = _put(tmp_path / "viral.tsv", "Study\tSampleBarcode\tHPV\tEBV\tHBV",
                 ("HNSC", "P3A", 50, 0, 0), ("HNSC", "P1A", 1, 9, 0), ("LUAD", "P2A", 50, 0, 0))
    out = tmp_path / "excluded"
    result = jobs.cohort_matrix_job(spark, maf, wide, viral, str(out))
    assert rows(result["patients"]) == [("P1",), ("P2",)]
    assert rows(result["matrix"]) == [
        ("CASP8", "P1", ""), ("CASP8", "P2", "Amplification"), ("TP53", "P1", "Deep Deletion;Nonsense"), ("TP53", "P2", "")]
    assert rows(result["sample_order"], "position", "sample") == [(1, "P2"), (2, "P1")]
    assert "".join(p.read_text() for p in out.glob("part-*")) == "P3\n"
    everything = jobs.cohort_matrix_job(spark, maf, wide, viral, all_genes=True)
    assert everything["matrix"].count() == 6 * 2


def test_vep_and_vcf_jobs(spark, tmp_path, rows):
    names = [{"X_Uploaded_variation": "#Uploaded_variation", "GERP___RS_rankscore": "GERP++_RS_rankscore"}.get(c, c)
             for c in ["X_Uploaded_variation", *[c for c in cf.VEP_TYPES if c != "X_Uploaded_variation"]]]

    def line(**given):
        return tuple(given.get(n, "-") for n in names)

    base = {"SYMBOL": "TP53", "BIOTYPE": "protein_coding", "IMPACT": "HIGH", "Consequence": "stop_gained"}
    _put(tmp_path / "annotation" / "S1" / "x.mutect2.filtered_snpEff_VEP.ann.tab", "## made by", tuple(names),
         line(**base, **{"#Uploaded_variation": "v1", "Existing_variation": "rs1,COSV1", "MAX_AF": "0.6"}),
         line(**base, **{"#Uploaded_variation": "v2"}), line(**{**base, "IMPACT": "LOW"}))
    frequency = _put(tmp_path / "cmc.tsv.gz", "GENOMIC_MUTATION_ID\tCOSMIC_SAMPLE_MUTATED\tMUTATION_SIGNIFICANCE_TIER",
                     ("COSV1", 60, 1))
    tables = jobs.vep_job(spark, str(tmp_path / "annotation"), frequency)
    assert rows(tables["enriched"], "Uploaded_variation", "catalogue_id", "tier", "n_mutated", "count_in_samples") == [
        ("v1", "COSV1", "1", 60, 1), ("v2", "", "", 0, 1)]
    assert rows(tables["conflicting"], "Uploaded_variation") == [("v1",)]
    assert rows(tables["filtered"], "Uploaded_variation") == [("v2",)]
    _put(tmp_path / "vcf" / "S1.ann.vcf.gz", "##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1",
         ("1", 10, ".", "A", "T", ".", "PASS", "DP=1;CSQ=T|stop_gained|HIGH", "GT:SB", "0/1:3"))
    flat = jobs.vcf_job(spark, str(tmp_path / "vcf"), r"([^/.]+)\.ann")["records"]
    assert rows(flat, "sample", "POS", "fmt_SB", "csq_IMPACT", "csq_SYMBOL") == [("S1", 10, "3", "HIGH", None)]


def test_earlier_jobs(spark, tmp_path, rows):
    mutations = tmp_path / "mut.csv"
    mutations.write_text("Gene,Sample,Func\nTP53,CA1,missense\nTP53,CA1,stop gain\nFAT1,LM,missense\n")
    segments = tmp_path / "cnv.csv"
    segments.write_text(
        "GeneSymbol,sample,type,BF,Conrad.hg19,reads.ratio,reads.observed,reads.expected,standardizedValue\n"
        "TP53,CA1,deletion,30,NA,0.4,5,20,-2\nTP53,LM,duplication,30,NA,1.6,5,20,2\nFAT1,CA1,deletion,30,CNV1,0.4,5,20,-2\n")
    tables = jobs.scored_segments_job(spark, str(mutations), str(segments))
    with_shallow = {r["gene"]: r for r in tables["drivers"].collect()}
    assert len(with_shallow) == 19 and with_shallow["TP53"]["CA1"] == "Shallow Deletion;Missense;Nonsense_2"
    assert with_shallow["TP53"]["LM"] == "Amplification" and with_shallow["FAT1"]["LM"] == "Missense"
    without = {r["gene"]: r for r in tables["drivers_without_shallow"].collect()}
    assert without["TP53"]["CA1"] == "Missense;Nonsense_2" and without["TP53"]["SCC4"] == ""
    assert tables["complex"].count() == 17

    tracks = _put(tmp_path / "tracks.tsv", "track_name\ttrack_type\tP1\tP2\tP3",
                  ("TP53", "CNA", "amp_rec", "", "hetloss_rec"), ("TP53", "MUTATIONS", "", "splice_rec", ""),
                  ("FAT1", "CNA", "", "", ""), ("FAT1", "MUTATIONS", "", "Missense Mutation (putative driver)", ""))
    clinical = _put(tmp_path / "clinical.txt", "#a", "#b", "#c", "#d", "PATIENT_ID\tPRIMARY_SITE_PATIENT", ("P1", "tongue"))
    portal = jobs.portal_job(spark, tracks, clinical)
    assert rows(portal["events"].filter("gene = 'TP53'"), "sample", "alterations", "site") == [
        ("P1", "Amplification", "tongue"), ("P2", "Splice site", None), ("P3", "Shallow Deletion", None)]
    assert rows(portal["drivers_order"], "position", "sample") == [(1, "P1"), (2, "P2"), (3, "P3")]
    assert portal["drivers_without_shallow"].filter("gene = 'TP53'").first()["P3"] == ""
