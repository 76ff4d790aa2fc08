"""Annotated variants: parsing, recurrence, filters and catalogue look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classes as k
from ..functions.nulls import col, in_set, not_in_set, round_to, sum_or_zero, to_number
from ..functions.text import (
    all_matches, field_by_key, first_match, info_fields, sum_of_matches,
)
from ..operators.groups import collapse_except, group_count, joined_set
from ..operators.joins import natural_join, semi_join, split_full_join
from ..operators.reshape import explode_tokens

# Patterns, keys and lists of the annotation formats.
CATALOGUE_ID = "COSV[^;]+"
CATALOGUE_COUNTS = r"([0-9]+)\("
DONOR_COUNTS = r"(?:^|,)[^|]{1,10}\|([0-9]+)"
FREQUENCIES = ["X1000g2015aug_all", "esp6500siv2_all", "gnomAD_genome_ALL", "gnomad312_AF"]
VARIANT_KEY = ["Chr", "Start", "End", "Ref", "Alt"]
CODING_REGIONS = ["exonic", "exonic;splicing", "splicing"]
REPEAT_SENSITIVE = ["nonframeshift insertion", "nonframeshift substitution"]
VEP_CONSEQUENCES = [
    "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "start_lost",
    "stop_gained", "stop_lost", "inframe_deletion", "inframe_insertion",
    "protein_altering_variant", "missense_variant",
]
VEP_IDS = "(COSV[^,]+)"
VCF_FORMAT_KEYS = ["GT", "AD", "AF", "DP", "F1R2", "F2R1", "FAD", "PGT", "PID", "PS", "SB"]
CSQ_FIELDS = [
    "Allele", "Consequence", "IMPACT", "SYMBOL", "Gene", "Feature_type", "Feature", "BIOTYPE",
    "EXON", "INTRON", "HGVSc", "HGVSp", "cDNA_position", "CDS_position", "Protein_position",
    "Amino_acids", "Codons", "Existing_variation", "DISTANCE", "STRAND", "FLAGS",
    "VARIANT_CLASS", "SYMBOL_SOURCE", "HGNC_ID", "CANONICAL", "MANE_SELECT",
    "MANE_PLUS_CLINICAL", "TSL", "APPRIS", "CCDS", "ENSP", "SWISSPROT", "TREMBL", "UNIPARC",
    "UNIPROT_ISOFORM", "GENE_PHENO", "SIFT", "PolyPhen", "DOMAINS", "miRNA", "AF", "AFR_AF",
    "AMR_AF", "EAS_AF", "EUR_AF", "SAS_AF", "AA_AF", "EA_AF", "gnomAD_AF", "gnomAD_AFR_AF",
    "gnomAD_AMR_AF", "gnomAD_ASJ_AF", "gnomAD_EAS_AF", "gnomAD_FIN_AF", "gnomAD_NFE_AF",
    "gnomAD_OTH_AF", "gnomAD_SAS_AF", "MAX_AF", "MAX_AF_POPS", "FREQS", "CLIN_SIG", "SOMATIC",
    "PHENO", "PUBMED", "MOTIF_NAME", "MOTIF_POS", "HIGH_INF_POS", "MOTIF_SCORE_CHANGE",
    "TRANSCRIPTION_FACTORS",
]


def parse_annovar(df: DataFrame, frequencies: Sequence[str] = FREQUENCIES) -> DataFrame:
    """Missing population frequencies as 0, catalogue id and occurrence counts."""
    filled = df.withColumns({c: F.coalesce(col(c), F.lit(0.0)) for c in frequencies})
    return filled.withColumns({
        "cosmic97": first_match("cosmic97_coding", CATALOGUE_ID, 0),
        "cosmic97_occurrence": sum_of_matches("cosmic97_coding", CATALOGUE_COUNTS),
        "ICGC_Occurrence": sum_of_matches("ICGC_Occurrence", DONOR_COUNTS),
    }).drop("cosmic97_coding")


def recurrence_counts(
    df: DataFrame,
    keys: Sequence[str] = VARIANT_KEY,
    distinct_on: Sequence[str] | None = None,
    name: str = "recurrence",
) -> DataFrame:
    """Distinct rows per variant, or distinct ``distinct_on`` values if given."""
    rows = df if distinct_on is None else df.select(*dict.fromkeys([*keys, *distinct_on]))
    return group_count(rows.distinct(), keys, name)


def variant_recurrence(
    df: DataFrame,
    keys: Sequence[str] = VARIANT_KEY,
    distinct_on: Sequence[str] | None = None,
    distinct: bool = True,
    name: str = "recurrence",
    null_safe: bool = True,
) -> DataFrame:
    """Every row with its variant's recurrence. With ``distinct=False`` all rows
    of the key are counted, repeats included."""
    counts = recurrence_counts(df, keys, distinct_on, name) if distinct else group_count(df, keys, name)
    return natural_join(df, counts, keys, "left", null_safe)


def filter_coding_variants(
    df: DataFrame,
    recurrence: str = "recurrence",
    max_recurrence: int = 5,
    frequencies: Sequence[str] = FREQUENCIES,
    max_frequency: float = 0.01,
    region: str = "Func_refGene",
    regions: Sequence[str] = CODING_REGIONS,
    effect: str = "ExonicFunc_refGene",
    effects: Mapping[str, str] = k.EXONIC_TO_SNV,
    repeat: str = "rmsk",
    repeat_sensitive: Sequence[str] = REPEAT_SENSITIVE,
    name: str = "ExonicFunc_simplified",
) -> DataFrame:
    """Rare, non-recurrent coding variants with their simplified class. Effects
    listed as repeat-sensitive are dropped inside annotated repeats."""
    classed = df.withColumn(effect, k.effect_class(region, effect))
    keep = col(recurrence) < max_recurrence
    for c in frequencies:
        keep = keep & (col(c) < max_frequency)
    keep = keep & in_set(region, regions) & in_set(effect, effects)
    keep = keep & ~(in_set(effect, repeat_sensitive) & col(repeat).isNotNull())
    return classed.filter(keep).withColumn(name, k.recode(effect, effects))


def parse_catalogue(
    catalogue: DataFrame, gene: str = "Gene", kind: str = "Type", position: str = "Position"
) -> DataFrame:
    """Curated mutations without transcript-named genes and silent changes."""
    kept = catalogue.filter(~col(gene).rlike("ENST[0-9]{8}")).filter(
        col(kind) != "Substitution - coding silent"
    )
    start = to_number(first_match(position, ":([0-9]+)"))
    return kept.withColumn("position_start", start)


def match_catalogue(
    df: DataFrame,
    catalogue: DataFrame,
    gene: str = "gene",
    sample: str = "sample",
    position: str = "start",
    catalogue_position: str = "position_start",
    bin: int = 10,
    name: str = "approx_start",
    null_safe: bool = True,
) -> DataFrame:
    """Full join of variants and catalogue on (gene, sample, position rounded to
    ``bin``, exact halves to the even multiple). Only variants of samples the
    catalogue has take part."""
    binned_catalogue = catalogue.withColumn(name, round_to(catalogue_position, bin))
    known = semi_join(df, catalogue, [sample], null_safe)
    binned = known.withColumn(name, round_to(position, bin))
    return split_full_join(binned_catalogue, binned, [gene, sample, name], null_safe)


def filter_vep(
    df: DataFrame,
    consequences: Sequence[str] = VEP_CONSEQUENCES,
    biotype: str = "protein_coding",
    low_impact: str = "LOW",
) -> DataFrame:
    """Protein-coding rows of at least moderate impact with a listed consequence."""
    return df.filter(
        (col("BIOTYPE") == biotype)
        & (col("IMPACT") != low_impact)
        & col("Consequence").rlike("|".join(consequences))
    )


def explode_ids(
    df: DataFrame, text: str = "Existing_variation", pattern: str = VEP_IDS, name: str = "catalogue_id"
) -> DataFrame:
    """One row per id found in a text; rows without any keep one NULL id."""
    return explode_tokens(df, name, all_matches(text, pattern), keep_empty=True)


def enrich_catalogue(
    df: DataFrame,
    frequency: DataFrame,
    text: str = "Existing_variation",
    pattern: str = VEP_IDS,
    id_col: str = "catalogue_id",
    count_col: str = "n_mutated",
    tier_col: str = "tier",
) -> DataFrame:
    """Distinct rows with their ids, the tiers of those and the summed counts.

    Same result as exploding the ids, joining the catalogue and grouping by all
    other columns, but the wide rows are neither multiplied nor moved for the
    join: ids are looked up once per distinct id text, and a row that occurs n
    times counts its sum n times. ``frequency`` has columns id, count, tier.
    """
    per_id = frequency.groupBy(id_col).agg(
        F.sum(count_col).alias("_count"), F.collect_set(tier_col).alias("_tiers")
    ).filter(col(id_col).isNotNull())
    texts = df.select(col(text)).filter(col(text).rlike(pattern)).distinct()
    ids = explode_tokens(texts, id_col, all_matches(text, pattern))
    looked_up = natural_join(ids, per_id, [id_col], "left", null_safe=False)
    per_text = looked_up.groupBy(text).agg(
        joined_set(id_col).alias(id_col),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_tiers")))), ",").alias(tier_col),
        F.coalesce(F.sum("_count"), F.lit(0)).alias(count_col),
    )
    rows = group_count(df, df.columns, "_n")
    joined = natural_join(rows, per_text, [text], "left", null_safe=False)
    return joined.select(
        *[col(c) for c in df.columns],
        F.coalesce(id_col, F.lit("")).alias(id_col),
        F.coalesce(tier_col, F.lit("")).alias(tier_col),
        (F.coalesce(count_col, F.lit(0)) * F.col("_n")).alias(count_col),
    )


def collapse_ids(
    exploded: DataFrame, id_col: str = "catalogue_id", count_col: str = "n_mutated", tier_col: str = "tier"
) -> DataFrame:
    """Back to one row per combination of the other columns, after a join."""
    return collapse_except(exploded, id_col, **{
        id_col: joined_set(id_col),
        tier_col: joined_set(tier_col),
        count_col: sum_or_zero(count_col),
    })


def conflicting_variants(
    df: DataFrame, count_col: str = "n_mutated", frequency: str = "MAX_AF",
    min_count: int = 50, min_frequency: float = 0.5,
) -> DataFrame:
    """Often mutated in the catalogue yet common in the population."""
    return df.filter((col(count_col) > min_count) & (col(frequency) > min_frequency))


def filter_rare(
    df: DataFrame, frequency: str = "MAX_AF", below: float = 0.01, missing: str = "keep"
) -> DataFrame:
    """Variants below a population frequency; ``missing`` is "keep" or "drop"."""
    if missing not in ("keep", "drop"):
        raise ValueError("missing must be 'keep' or 'drop'")
    rare = col(frequency) < below
    return df.filter(F.coalesce(rare, F.lit(True)) if missing == "keep" else rare)


def flatten_format(
    df: DataFrame,
    keys: Sequence[str] = VCF_FORMAT_KEYS,
    format_col: str = "FORMAT",
    stats_col: str = "STATS",
    blank: bool = False,
    prefix: str = "fmt_",
) -> DataFrame:
    """Sample fields as columns, looked up by key so that any layout works. An
    absent key is NULL, or ``""`` with ``blank=True``."""
    def field(key: str) -> Column:
        value = field_by_key(format_col, stats_col, key)
        return (F.coalesce(value, F.lit("")) if blank else value).alias(f"{prefix}{key}")

    others = [col(c) for c in df.columns if c not in (format_col, stats_col)]
    return df.select(*others, *[field(key) for key in keys])


def flatten_vcf(
    vcf: DataFrame,
    fields: Sequence[str] = CSQ_FIELDS,
    info_key: str = "CSQ",
    passed: str | None = "PASS",
    blank: bool = False,
    keep_info: bool = False,
) -> DataFrame:
    """Passing records with their sample fields and one row per transcript
    annotation, whose ``|`` parts become columns. Records without annotation
    stay, with NULLs."""
    kept = vcf if passed is None else vcf.filter(col("FILTER") == passed)
    flat = flatten_format(kept, blank=blank)
    annotation = first_match("INFO", rf"(?:^|;){info_key}=([^;]*)")
    exploded = explode_tokens(flat, "_annotation", F.split(annotation, ","), keep_empty=True)
    parts = F.split("_annotation", r"\|", -1)
    others = [col(c) for c in flat.columns if c != "INFO"]
    extra = [info_fields("INFO").alias("info")] if keep_info else []
    return exploded.select(
        *others, *extra, *[F.get(parts, i).alias(f"csq_{n}") for i, n in enumerate(fields)]
    )


def dedupe_maf(
    maf: DataFrame,
    columns: Sequence[str] = (
        "Hugo_Symbol", "Consequence", "Variant_Classification", "Variant_Type",
        "Tumor_Sample_Barcode", "Start_Position",
    ),
    class_col: str = "Variant_Classification",
    silent: Sequence[str] = k.MAF_SILENT,
) -> DataFrame:
    """Distinct mutations without silent classes; a missing class is kept. The
    filter stands before the distinct, where it reaches the scan."""
    return maf.select(*columns).filter(not_in_set(class_col, silent)).distinct()
