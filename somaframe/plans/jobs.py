"""Whole jobs from call files to tables.

Each job reads its files, composes the plans and returns its tables by name;
nothing runs until a table is used, except that tables several results share are
staged once. Text for hand-over is written where a path is given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import classes as k
from ..functions.nulls import col
from ..operators.ordering import gene_order, order_samples
from ..sources import callfiles as cf
from ..sources import dimensions as dim
from ..sources.readers import read_delimited, read_vcf
from ..sources.writers import staged, write_id_list, write_plain_tsv, write_tsv
from . import copynumber as cn
from . import matrix as m
from . import tracks as t
from . import variants as v

Tables = dict[str, DataFrame]


def copy_number_job(
    spark: SparkSession, segments, intervals, reference, out: str | None = None
) -> Tables:
    """Both callers' gene tables, their comparison with the reference panel and
    the Gain/Loss calls."""
    a = staged(cn.gene_cn_from_segments(cf.read_segments(spark, segments)), "segments")
    b = cn.gene_cn_from_intervals(cf.read_intervals(spark, intervals))
    panel = cf.read_wide(
        spark, reference, ["cell_line_display_name"], "gene", "cn", sep=",", kind="double",
        drop=("depmap_id", "lineage_1", "lineage_2", "lineage_3", "lineage_4"),
    ).withColumnRenamed("cell_line_display_name", "sample")
    compared = staged(cn.compare_cn(cn.scale_reference(panel), cn.merge_cn_callers(a, b)), "compared")
    calls = cn.classify_log2(a)
    if out is not None:
        write_tsv(calls, out)
    return {
        "calls": calls,
        "five_class_calls": cn.classify_cn(a),
        "compared": compared,
        "correlations": cn.cn_correlations(compared),
        "volcano": cn.volcano_table(compared, "p_ttest_a", "log2_a", p_source=a, p_source_col="p_ttest"),
        "medians": cn.gene_medians(a),
    }


def annovar_job(
    spark: SparkSession, annovar, out: str | None = None, catalogue: Mapping[str, str] | None = None
) -> Tables:
    """Filtered coding variants and their match with the curated mutations."""
    parsed = staged(v.parse_annovar(cf.read_annovar(spark, annovar)), "annovar")
    filtered = v.filter_coding_variants(v.variant_recurrence(parsed))
    if out is not None:
        write_plain_tsv(filtered, out)
    tables = {"parsed": parsed, "filtered": filtered}
    if catalogue is not None:
        curated = v.parse_catalogue(cf.read_catalogue(spark, dict(catalogue))).withColumnsRenamed(
            {"Gene": "Gene_refGene", "sample": "Sample", "Type": "catalogue_type",
             "Census_Tier_1": "census_tier_1", "CDS_Mutation": "cds_mutation", "Validated": "validated"}
        )
        tables["matched"] = v.match_catalogue(
            parsed, curated, "Gene_refGene", "Sample", "Start", "position_start"
        )
    return tables


def vep_job(spark: SparkSession, vep, frequency, missing: str = "keep") -> Tables:
    """Coding variants with catalogue frequency, recurrence and rarity."""
    kept = v.filter_vep(cf.read_vep(spark, vep))
    mutated = cf.read_catalogue_frequency(spark, frequency).toDF("catalogue_id", "n_mutated", "tier")
    enriched = staged(v.enrich_catalogue(kept, mutated), "vep")
    counted = v.variant_recurrence(
        enriched, ["Uploaded_variation", "SYMBOL"], distinct=False, name="count_in_samples"
    )
    return {
        "enriched": counted,
        "conflicting": v.conflicting_variants(counted),
        "filtered": v.filter_rare(counted, missing=missing),
    }


def vcf_job(spark: SparkSession, vcf, sample_pattern: str | None = None, glob: str = "*ann.vcf.gz") -> Tables:
    """Passing records, flattened."""
    return {"records": v.flatten_vcf(read_vcf(spark, vcf, sample_pattern, glob))}


def _results(matrix: DataFrame, layers=k.TWO_LAYERS) -> Tables:
    matrix = staged(matrix, "matrix")
    return {
        "matrix": matrix,
        "frequency": m.alteration_frequency(matrix),
        "gene_classes": m.class_counts(matrix, "gene"),
        "sample_classes": m.class_counts(matrix, "sample"),
        "gene_order": gene_order(matrix),
        "sample_order": order_samples(matrix, layers).select("sample", "position"),
    }


def cell_line_matrix_job(
    spark: SparkSession,
    variants,
    calls,
    driver_panel: Sequence[str] = dim.SHORT_DRIVER_PANEL,
    complex_panel: Sequence[str] = dim.SHORT_COMPLEX_PANEL,
    sample_universe: DataFrame | None = None,
) -> Tables:
    """Alteration matrix of the cell lines, from the text of the two builds. Cell
    lines of ``sample_universe`` (sample) are complete without a mutation too."""
    snv = read_delimited(
        spark, variants, blank="null", null_token=None,
        types={"Sample": "string", "Gene_refGene": "string", "ExonicFunc_simplified": "string"},
    ).toDF("sample", "gene", "snv")
    cna = read_delimited(
        spark, calls, types={"sample": "string", "gene": "string", "status": "string"}
    ).toDF("sample", "gene", "cna")
    panel = [*complex_panel, *driver_panel]
    events = m.alteration_events(cna, snv, panel)
    matrix = m.alteration_matrix(events, panel, m.complete_samples(snv, cna, sample_universe=sample_universe))
    return {"events": events.withColumn("group", m.panel_label("gene", complex_panel)), **_results(matrix)}


def cohort_matrix_job(
    spark: SparkSession,
    maf,
    discrete_cn,
    viral,
    excluded_out: str | None = None,
    driver_panel: Sequence[str] = dim.SHORT_DRIVER_PANEL,
    complex_panel: Sequence[str] = dim.SHORT_COMPLEX_PANEL,
    all_genes: bool = False,
    sample_universe: DataFrame | None = None,
) -> Tables:
    """Alteration matrix of the cohort over complete, virus-free patients; those of
    ``sample_universe`` (sample) are complete without a mutation too."""
    panel = [*complex_panel, *driver_panel]
    mutations = v.dedupe_maf(cf.read_maf(spark, maf)).select(
        col("Hugo_Symbol").alias("gene"), col("Tumor_Sample_Barcode").alias("sample"),
        k.recode("Variant_Classification", k.MAF_TO_SNV).alias("snv"),
    )
    with_cn = dim.dimension(spark, cf.header_names(spark, discrete_cn)[2:], "sample")
    long = cf.read_wide(spark, discrete_cn, ["Hugo_Symbol"], "sample", "cna", drop=("Entrez_Gene_Id",), kind="int")
    cna = m.discrete_cn_events(long=long, panel=panel).withColumnRenamed("Hugo_Symbol", "gene")
    status = m.viral_status(cf.read_viral(spark, viral))
    excluded = m.positive_patients(status)
    if excluded_out is not None:
        write_id_list(excluded, "patient", excluded_out)
    kept = m.without_patients(m.complete_samples(mutations, with_cn, sample_universe=sample_universe), excluded)
    events = m.alteration_events(cna, mutations, panel, samples=kept, complex_panel=complex_panel)
    matrix = m.alteration_matrix(events, panel, kept, all_genes=all_genes)
    return {"patients": kept, "viral_status": status, "events": events, **_results(matrix)}


def scored_segments_job(
    spark: SparkSession,
    mutations,
    segments,
    samples: Sequence[str] = dim.CELL_LINES,
    driver_panel: Sequence[str] = dim.DRIVER_PANEL,
    complex_panel: Sequence[str] = dim.COMPLEX_PANEL,
) -> Tables:
    """Earlier cell-line matrices: multi-hit mutations with scored segments, per
    panel, with and without shallow deletions."""
    snv = t.multi_hit_classes(
        cf.read_old_mutations(spark, mutations).toDF("gene", "sample", "func")
    )
    cna = t.filter_segments(cf.read_old_segments(spark, segments)).select(
        col("GeneSymbol").alias("gene"), "sample", "cna"
    )
    events = staged(t.merge_events(cna, snv), "events")
    return {"events": events, **_panel_matrices(events, samples, driver_panel, complex_panel)}


def _panel_matrices(events, samples, driver_panel, complex_panel) -> Tables:
    return {
        f"{name}{'_without_shallow' if drop else ''}": t.panel_matrix(events, panel, samples, drop_shallow=drop)
        for name, panel in (("drivers", driver_panel), ("complex", complex_panel))
        for drop in (False, True)
    }


def portal_job(
    spark: SparkSession,
    tracks,
    clinical,
    ranked: bool = False,
    site_key=None,
    driver_panel: Sequence[str] = dim.DRIVER_PANEL,
    complex_panel: Sequence[str] = dim.COMPLEX_PANEL,
    layers: Sequence[Sequence[str]] = k.THREE_LAYERS,
) -> Tables:
    """Earlier cohort matrices from a portal export, per panel, with and without
    shallow deletions, with their sample order."""
    names = cf.header_names(spark, tracks)
    samples = names[2:]
    long = cf.read_wide(spark, tracks, ["track_name", "track_type"], "sample", "value")
    events = staged(t.unpivot_tracks(
        long=long, sites=cf.read_clinical(spark, clinical), site_key=site_key, ranked=ranked,
        complex_panel=complex_panel,
    ).withColumnRenamed("track_name", "gene"), "tracks")
    tables = {"events": events, **_panel_matrices(events, samples, driver_panel, complex_panel)}
    for name, panel in (("drivers", driver_panel), ("complex", complex_panel)):
        cells = events.filter(col("gene").isin(list(panel))).select("gene", "sample", "alterations")
        tables[f"{name}_order"] = order_samples(cells, layers).select("sample", "position")
    return tables


__all__ = [
    "annovar_job", "cell_line_matrix_job", "cohort_matrix_job", "copy_number_job", "portal_job",
    "scored_segments_job", "vcf_job", "vep_job",
]
