"""Call-file kinds: which columns they have and where their sample name stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import readers as r
from .lines import fields, read_by_name, read_long

# Columns of each file kind.
SEGMENT_TYPES = {
    "chromosome": "string", "start": "bigint", "end": "bigint", "gene": "string",
    "log2": "double", "cn": "int", "depth": "double", "p_ttest": "double", "weight": "double",
}
INTERVAL_COLUMNS = ["chromosome", "start", "end", "other", "gene"]
INTERVAL_TYPES = {
    "chromosome": "string", "start": "bigint", "end": "bigint", "other": "string", "gene": "string",
}
ANNOVAR_TYPES = {
    "Chr": "string", "Start": "bigint", "End": "bigint", "Ref": "string", "Alt": "string",
    "Func_refGene": "string", "Gene_refGene": "string", "GeneDetail_refGene": "string",
    "ExonicFunc_refGene": "string", "AAChange_refGene": "string", "cytoBand": "string",
    "rmsk": "string", "Interpro_domain": "string",
    "X1000g2015aug_all": "double", "esp6500siv2_all": "double",
    "gnomAD_genome_ALL": "double", "gnomad312_AF": "double",
    "CLNSIG": "string", "avsnp150": "string", "SIFT_pred": "string", "SIFT4G_pred": "string",
    "Polyphen2_HDIV_pred": "string", "Polyphen2_HVAR_pred": "string", "LRT_pred": "string",
    "MutationTaster_pred": "string", "MutationAssessor_pred": "string", "FATHMM_pred": "string",
    "PrimateAI_pred": "string", "GERP___RS": "double", "cosmic97_coding": "string",
    "ICGC_Id": "string", "ICGC_Occurrence": "string",
}
CATALOGUE_TYPES = {
    "Gene": "string", "Type": "string", "Census_Tier_1": "string", "CDS_Mutation": "string",
    "Validated": "string", "Position": "string",
}
VEP_TYPES = {
    "SYMBOL": "string", "X_Uploaded_variation": "string", "Location": "string",
    "Allele": "string", "Gene": "string", "Feature": "string", "Feature_type": "string",
    "Consequence": "string", "Amino_acids": "string", "Codons": "string", "CLIN_SIG": "string",
    "Existing_variation": "string", "IMPACT": "string", "VARIANT_CLASS": "string",
    "BIOTYPE": "string", "SIFT": "string", "PolyPhen": "string", "DOMAINS": "string",
    "AF": "double", "gnomAD_AF": "double", "ExAC_AF": "double", "ExAC_nonTCGA_AF": "double",
    "MAX_AF": "double", "FREQS": "string", "GERP___RS_rankscore": "double",
}
CATALOGUE_FREQUENCY_TYPES = {
    "GENOMIC_MUTATION_ID": "string", "COSMIC_SAMPLE_MUTATED": "bigint",
    "MUTATION_SIGNIFICANCE_TIER": "string",
}
MAF_TYPES = {
    "Hugo_Symbol": "string", "Consequence": "string", "Variant_Classification": "string",
    "Variant_Type": "string", "Tumor_Sample_Barcode": "string", "Start_Position": "bigint",
}
VIRAL_TYPES = {
    "Study": "string", "SampleBarcode": "string", "HPV": "double", "EBV": "double", "HBV": "double",
}
OLD_SEGMENT_TYPES = {
    "GeneSymbol": "string", "sample": "string", "type": "string", "BF": "double",
    "Conrad_hg19": "string", "reads_ratio": "double", "reads_observed": "double",
    "reads_expected": "double", "standardizedValue": "double",
}


def read_segments(spark: SparkSession, path, glob: str = "*.call.cns", **options) -> DataFrame:
    """Segment calls, one directory per sample below ``cnvkit/``."""
    return r.read_delimited(
        spark, path, types=SEGMENT_TYPES, glob=glob,
        sample_pattern=r.SEGMENTS_SAMPLE, file_col="file", **options,
    )


def read_intervals(spark: SparkSession, path, glob: str = "*.annotated.p.value.txt", **options) -> DataFrame:
    """Header-less annotated intervals below ``controlfreec/``."""
    return r.read_delimited(
        spark, path, columns=INTERVAL_COLUMNS, types=INTERVAL_TYPES, glob=glob,
        sample_pattern=r.INTERVALS_SAMPLE, file_col="file", **options,
    )


def read_annovar(spark: SparkSession, path, glob: str = "*multianno.txt", **options) -> DataFrame:
    """Annotated variant tables with ``.`` for a missing value."""
    return r.read_delimited(
        spark, path, types=ANNOVAR_TYPES, null_token=".", glob=glob,
        sample_pattern=r.ANNOVAR_SAMPLE, sample_col="Sample", **options,
    ).withColumnRenamed("GERP___RS", "GERP_RS")


def read_vep(
    spark: SparkSession, path, glob: str = "*.mutect2.filtered_snpEff_VEP.ann.tab", **options
) -> DataFrame:
    """Annotated variants in tab form below ``annotation/``, ``-`` for missing."""
    return r.read_preambled(
        spark, path, null_token="-", types=VEP_TYPES, glob=glob,
        sample_pattern=r.VEP_SAMPLE, sample_col="Sample", **options,
    ).withColumnsRenamed({
        "X_Uploaded_variation": "Uploaded_variation",
        "GERP___RS_rankscore": "GERP_RS_rankscore",
    })


def read_catalogue(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Curated mutations, one file per named sample."""
    return r.read_tagged(spark, paths, types=CATALOGUE_TYPES)


def read_catalogue_frequency(spark: SparkSession, path, **options) -> DataFrame:
    return r.read_delimited(spark, path, types=CATALOGUE_FREQUENCY_TYPES, blank="null", **options)


def read_maf(spark: SparkSession, path, **options) -> DataFrame:
    return r.read_delimited(spark, path, types=MAF_TYPES, **options)


def read_viral(spark: SparkSession, path, **options) -> DataFrame:
    return r.read_delimited(spark, path, types=VIRAL_TYPES, blank="null", **options)


def read_clinical(spark: SparkSession, path, skip: int | None = None, **options) -> DataFrame:
    """Patient sheet whose leading metadata lines start with ``#``, or with ``skip``
    are that many lines of any form."""
    types = {"PATIENT_ID": "string", "PRIMARY_SITE_PATIENT": "string"}
    if skip is None:
        sheet = r.read_delimited(spark, path, comment="#", types=types, **options)
    else:
        sheet = read_by_name(spark, path, types, skip=skip, **options)
    return sheet.withColumnsRenamed({"PATIENT_ID": "sample", "PRIMARY_SITE_PATIENT": "site"})


def header_names(spark: SparkSession, path, sep: str = "\t") -> list[str]:
    """Column names of a delimited file, from its first line."""
    first = spark.read.text(path).limit(1).select(fields(F.col("value"), sep).alias("names")).first()
    return first["names"]


def read_wide(
    spark: SparkSession,
    path,
    ids: list[str],
    key: str,
    value: str,
    sep: str = "\t",
    drop: tuple[str, ...] = (),
    kind: str = "string",
    blank: str = "keep",
    null_token: str | None = "NA",
) -> DataFrame:
    """Matrix file with leading id columns and one column per gene or sample,
    turned long: one row per cell, missing cells included. Any number of columns."""
    return read_long(spark, path, ids, key, value, sep, drop, kind, blank, null_token)


def read_old_segments(spark: SparkSession, path, **options) -> DataFrame:
    return r.read_delimited(spark, path, sep=",", types=OLD_SEGMENT_TYPES, **options)


def read_old_mutations(spark: SparkSession, path, **options) -> DataFrame:
    return r.read_delimited(
        spark, path, sep=",", types={"Gene": "string", "Sample": "string", "Func": "string"}, **options
    )
