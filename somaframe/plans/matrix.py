"""Gene x sample alteration matrix, its frequencies and sample sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classes as k
from ..functions.nulls import col, in_set
from ..functions.text import join_non_null, remove_first, remove_trailing
from ..operators.groups import top_class
from ..operators.joins import anti_join, semi_join
from ..operators.reshape import dense_cells, pivot_unique, unpivot_values
from ..sources.dimensions import COMPLEX_LABEL, DRIVER_LABEL, dimension, distinct_list


def top_priority_mutation(
    snv: DataFrame,
    panel: Sequence[str] | None = None,
    gene: str = "gene",
    sample: str = "sample",
    class_col: str = "snv",
    recoding: Mapping[str, str] | None = None,
    priority: Sequence[str] = k.SNV_PRIORITY,
) -> DataFrame:
    """One mutation class per panel gene and sample, the one of highest priority.
    A group with unlisted classes only keeps its row, with a NULL class."""
    kept = snv if panel is None else snv.filter(in_set(gene, panel))
    if recoding is not None:
        kept = kept.withColumn(class_col, k.recode(class_col, recoding))
    return top_class(kept, [sample, gene], class_col, priority)


def complete_samples(
    a: DataFrame, b: DataFrame, sample: str = "sample", sample_universe: DataFrame | None = None
) -> DataFrame:
    """Samples present in both sources. Take them from the unfiltered tables: a
    sample without panel events is still complete.

    A sample of which ``a`` has no row at all, such as one without any mutation, is
    not in it. ``sample_universe``, the samples that were examined for ``a``, takes
    the place of ``a``'s own, so that event-free ones count as complete too."""
    examined = a if sample_universe is None else sample_universe
    return examined.select(sample).intersect(b.select(sample))


def panel_label(gene: str, complex_panel: Sequence[str],
                yes: str = COMPLEX_LABEL, no: str = DRIVER_LABEL) -> Column:
    return F.when(in_set(gene, complex_panel), yes).otherwise(no)


def alteration_events(
    cna: DataFrame,
    snv: DataFrame,
    panel: Sequence[str] | None = None,
    gene: str = "gene",
    sample: str = "sample",
    cna_col: str = "cna",
    snv_col: str = "snv",
    neutral: str | None = "Normal",
    priority: Sequence[str] = k.SNV_PRIORITY,
    samples: DataFrame | None = None,
    complex_panel: Sequence[str] | None = None,
    name: str = "alterations",
    null_safe: bool = True,
) -> DataFrame:
    """One row per (gene, sample) with an event of either kind: the copy-number
    classes (distinct, sorted) and then the best mutation, joined by ``;``.

    Both kinds are stacked and grouped once. Compared with an outer join of two
    grouped tables this is a single shuffle, combined map-side, in which a hot
    gene or sample costs one row per map task. ``snv`` need not be reduced to one
    row per group before. With ``samples`` only those are kept, which is applied
    after the grouping, to the few rows that are left.
    """
    def side(df: DataFrame) -> DataFrame:
        return df if panel is None else df.filter(in_set(gene, distinct_list(panel)))

    cn_rows = side(cna)
    if neutral is not None:
        cn_rows = cn_rows.filter(col(cna_col) != neutral)
    cn_rows = cn_rows.select(gene, sample, col(cna_col).alias("_cna"), F.lit(None).cast("int").alias("_snv"))
    snv_rows = side(snv).select(
        gene, sample, F.lit(None).cast("string").alias("_cna"), k.ordinal(snv_col, priority).alias("_snv")
    )
    cells = cn_rows.unionByName(snv_rows).groupBy(gene, sample).agg(
        F.array_sort(F.collect_set("_cna")).alias("_cna"), F.min("_snv").alias("_snv")
    )
    cna_text = F.when(F.size("_cna") > 0, F.array_join("_cna", ";"))
    events = cells.select(
        gene, sample, join_non_null(";", cna_text, k.level_of("_snv", priority)).alias(name)
    )
    if samples is not None:
        events = semi_join(events, samples, [sample], null_safe)
    if complex_panel is not None:
        events = events.withColumn("group", panel_label(gene, complex_panel))
    return events


def alteration_matrix(
    events: DataFrame,
    panel: Sequence[str],
    samples: DataFrame,
    gene: str = "gene",
    sample: str = "sample",
    value: str = "alterations",
    restrict_to_complete: bool = False,
    all_genes: bool = True,
    null_safe: bool = True,
) -> DataFrame:
    """Dense long matrix: each panel gene for each complete sample and, unless
    restricted, for each other sample with an event; no event is ``""``. With
    ``all_genes=False`` genes without any event are left out."""
    if restrict_to_complete:
        events = semi_join(events, samples, [sample], null_safe)
    dense = dense_cells(events, panel, samples, gene, sample, value)
    if all_genes:
        return dense
    # broadcast of at most one row per panel gene
    seen = events.filter(in_set(gene, distinct_list(panel))).select(gene).distinct()
    return dense.join(F.broadcast(seen), gene, "left_semi")


def genes_without_events(events: DataFrame, panel: Sequence[str], gene: str = "gene") -> DataFrame:
    """Panel genes no event row names."""
    genes = dimension(events.sparkSession, panel, gene).select(gene)
    return anti_join(genes, events, [gene])


def wide_matrix(
    matrix: DataFrame, samples: Sequence[str],
    gene: str = "gene", sample: str = "sample", value: str = "alterations",
) -> DataFrame:
    """Genes as rows and the stated samples as columns, blank where absent."""
    return pivot_unique(matrix, gene, sample, value, samples, fill="")


def alteration_frequency(
    matrix: DataFrame, gene: str = "gene", value: str = "alterations", digits: int = 1
) -> DataFrame:
    """Per gene the altered and the empty samples and the altered percentage."""
    altered = F.count_if(col(value) != "")
    counted = matrix.groupBy(gene).agg(
        altered.alias("n_altered"),
        F.count_if(col(value) == "").alias("n_blank"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    return counted.withColumn("pct_altered", F.round(F.col("n_altered") * 100 / F.col("n_samples"), digits))


def frequency_from_events(
    events: DataFrame,
    panel: Sequence[str],
    samples: DataFrame,
    gene: str = "gene",
    sample: str = "sample",
    value: str = "alterations",
    restrict_to_complete: bool = False,
    digits: int = 1,
    null_safe: bool = True,
) -> DataFrame:
    """``alteration_frequency`` of the dense matrix, without building it: altered
    samples are counted on the sparse events, the number of samples once."""
    genes = distinct_list(panel)
    events = events.filter(in_set(gene, genes))  # as in the dense matrix, whose samples have panel events
    if restrict_to_complete:
        events = semi_join(events, samples, [sample], null_safe)
        universe = samples.select(sample).distinct()
    else:
        universe = samples.select(sample).union(events.select(sample)).distinct()
    size = universe.agg(F.count(F.lit(1))).scalar()
    altered = (
        events.groupBy(gene)
        .agg(F.count_if(col(value) != "").alias("n_altered"))
    )
    counts = altered.agg(F.map_from_entries(F.collect_list(F.struct(gene, "n_altered")))).scalar()
    spark = events.sparkSession
    panel_rows = spark.createDataFrame([(g,) for g in genes], f"{gene} string")
    return (
        panel_rows.withColumn("n_altered", F.coalesce(F.try_element_at(counts, col(gene)), F.lit(0)))
        .withColumn("n_samples", size)
        .withColumn("n_blank", F.col("n_samples") - F.col("n_altered"))
        .select(gene, "n_altered", "n_blank", "n_samples",
                F.round(F.col("n_altered") * 100 / F.col("n_samples"), digits).alias("pct_altered"))
    )


def class_counts(matrix: DataFrame, by: str, value: str = "alterations") -> DataFrame:
    """Cells holding each class, per gene or per sample (``by``)."""
    classes = F.explode(k.present_classes(value)).alias("class")
    return matrix.select(by, classes).groupBy(by, "class").agg(F.count(F.lit(1)).alias("n"))


def without_class(matrix: DataFrame, class_name: str = "Shallow Deletion", value: str = "alterations") -> DataFrame:
    """Cells without the first occurrence of a class and the ``;`` after it; a
    class that stood last leaves its leading ``;`` behind."""
    return matrix.withColumn(value, remove_first(value, f"{class_name};?"))


def viral_status(
    viral: DataFrame,
    study: str = "HNSC",
    cutoffs: Mapping[str, float] | None = None,
    study_col: str = "Study",
    barcode: str = "SampleBarcode",
    patient: str = "patient",
) -> DataFrame:
    """Rows of one study with the patient barcode (without its trailing vial
    letter) and a Positive/Negative label per virus, NULL if not measured."""
    # Thresholds in reads per million.
    cutoffs = cutoffs or {"HPV": 10.0, "EBV": 5.0, "HBV": 5.0}
    kept = viral.filter(col(study_col) == study)
    return kept.withColumn(patient, remove_trailing(barcode, "[A-Z]")).withColumns({
        f"{virus}_status": k.above(virus, cutoff) for virus, cutoff in cutoffs.items()
    })


def positive_patients(status: DataFrame, virus: str = "HPV", patient: str = "patient") -> DataFrame:
    """Patients to leave out, one column."""
    return status.filter(col(f"{virus}_status") == "Positive").select(patient)


def without_patients(
    samples: DataFrame, excluded: DataFrame, sample: str = "sample", patient: str = "patient",
    null_safe: bool = True,
) -> DataFrame:
    """Samples not in the exclusion list."""
    return anti_join(samples, excluded.select(col(patient).alias(sample)), [sample], null_safe)


def discrete_cn_events(
    wide: DataFrame | None = None,
    panel: Sequence[str] | None = None,
    gene: str = "Hugo_Symbol",
    drop: Sequence[str] = ("Entrez_Gene_Id",),
    long: DataFrame | None = None,
    sample: str = "sample",
    value: str = "cna",
    samples: Sequence[str] | None = None,
) -> DataFrame:
    """Deep deletions and amplifications of a -2..2 table, given wide (one column
    per sample) or already long; other states are dropped."""
    if long is None:
        kept = wide if panel is None else wide.filter(in_set(gene, panel))
        long = unpivot_values(kept.drop(*drop), [gene], sample, value, samples)
    elif panel is not None:
        long = long.filter(in_set(gene, panel))
    state = k.lookup(col(value).try_cast("int"), k.DISCRETE_TO_CN)
    return long.withColumn(value, state).filter(col(value).isNotNull())
