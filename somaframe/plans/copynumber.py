"""Gene-level copy number from segment calls, merged, compared and classified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import classes as k
from ..functions.nulls import at_least, at_most, col, if_else, to_number
from ..functions.text import all_matches, kept_tokens
from ..operators.groups import median_value, min_rows_within
from ..operators.joins import full_join, natural_join
from ..operators.ranks import spearman_pairs
from ..operators.reshape import explode_tokens, split_columns, unpivot_values
from ..sources.dimensions import TRIPLOID_LINES


def gene_tokens(
    segments: DataFrame,
    gene: str = "gene",
    sep: str = ",",
    keep: str = "ref|",
    strip: str = "ref|",
    drop: str = "N[A-Z]_",
) -> DataFrame:
    """A row per gene symbol of a token list; accessions are left out. A symbol
    listed twice gives two equal rows."""
    return explode_tokens(segments, gene, kept_tokens(gene, sep, keep, strip, drop))


def gene_cn_from_segments(
    segments: DataFrame,
    group: Sequence[str] = ("file", "chromosome", "gene"),
    values: Sequence[str] = ("cn", "log2", "depth", "p_ttest", "weight"),
    sample: str = "sample",
) -> DataFrame:
    """Copy number per gene: where segments disagree within a gene, those with
    the lowest copy number, ties kept. Grouping is within a file.

    No group exceeds a file, so one shuffle by the group serves the minimum and
    the removal of equal rows, which share their group and value.
    """
    lowest = min_rows_within(gene_tokens(segments), group, values[0])
    shown = [sample] + [c for c in group if c != "file"]
    return lowest.select(*dict.fromkeys(shown), *values)


def gene_cn_from_intervals(
    intervals: DataFrame,
    group: Sequence[str] = ("file", "chromosome", "gene"),
    sample: str = "sample",
    numeric: bool = True,
    gene_pattern: str = r'gene_name="([^"]+)',
) -> DataFrame:
    """Copy number per gene from intervals whose gene names stand in an attribute
    text and whose call is a ``|`` record. ``numeric=False`` takes the minimum of
    the copy number as text."""
    genes = F.when(col("gene").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        all_matches("gene", gene_pattern)
    )
    exploded = explode_tokens(intervals, "gene", genes)
    copies = F.substring_index("other", "|", 1)
    lowest = min_rows_within(exploded, group, to_number(copies) if numeric else copies)
    # Parts of the record.
    parts = ["cn", "status", "genotype", "uncertainty", "wilcoxon_p", "ks_p"]
    split = split_columns(lowest, "other", r"\|", parts)
    shown = [sample] + [c for c in group if c != "file"]
    numbers = [to_number(c).alias(c) for c in ("cn", "wilcoxon_p", "ks_p", "uncertainty")]
    return split.select(*dict.fromkeys(shown), *numbers)


def merge_cn_callers(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("sample", "chromosome", "gene"),
    cn: str = "cn",
    cap_a: float = 10.0,
    cap_b: float = 20.0,
    neutral: float = 2.0,
    null_safe: bool = True,
) -> DataFrame:
    """Both callers' genes side by side (``_a`` and ``_b`` columns). Copy numbers
    are capped; a gene one caller does not report counts as neutral. Each side has
    few rows of a key, the ties of its minimum, so one full join will do."""
    a = a.withColumnsRenamed({c: f"{c}_a" for c in a.columns if c not in keys})
    b = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in keys})
    merged = full_join(a, b, keys, null_safe, grouped=True)
    return merged.withColumns({
        f"{cn}_a": F.coalesce(at_most(f"{cn}_a", cap_a), F.lit(neutral)),
        f"{cn}_b": F.coalesce(at_most(f"{cn}_b", cap_b), F.lit(neutral)),
    })


def scale_reference(
    panel: DataFrame, triploid: Sequence[str] = TRIPLOID_LINES, sample: str = "sample", cn: str = "cn"
) -> DataFrame:
    """Reference copy numbers with their diploid-scaled form and four classes."""
    scaled = panel.withColumn(f"{cn}_as_diploid", k.shifted_cn(cn, sample, triploid))
    classed = scaled.withColumns({
        f"{cn}_class": k.absolute_cn_class(cn),
        f"{cn}_as_diploid_class": k.scaled_cn_class(f"{cn}_as_diploid"),
    })
    return classed.withColumns({
        f"{cn}_class3": k.three_cn_class(f"{cn}_class"),
        f"{cn}_as_diploid_class3": k.three_cn_class(f"{cn}_as_diploid_class"),
    })


def reference_cn(
    wide: DataFrame,
    sample: str = "cell_line_display_name",
    drop: Sequence[str] = ("depmap_id", "lineage_1", "lineage_2", "lineage_3", "lineage_4"),
    triploid: Sequence[str] = TRIPLOID_LINES,
    genes: Sequence[str] | None = None,
) -> DataFrame:
    """Reference panel, one column per gene, as (gene, sample, cn) with classes."""
    wide = wide.drop(*drop).withColumnRenamed(sample, "sample")
    long = unpivot_values(wide, ["sample"], "gene", "cn", genes)
    return scale_reference(long.select("gene", "sample", col("cn").cast("double").alias("cn")), triploid)


def consensus(merged: DataFrame, a: str = "cn_a", b: str = "cn_b") -> DataFrame:
    """Mean of both callers and the value deviating less from neutral."""
    return merged.withColumns({
        "cn_mean": (col(a) + col(b)) / 2,
        "cn_min_dev": k.consensus_cn(a, b),
    })


def compare_cn(
    reference: DataFrame, merged: DataFrame, keys: Sequence[str] = ("gene", "sample"), null_safe: bool = True
) -> DataFrame:
    """Genes known to both the reference panel and the callers, with consensus."""
    return consensus(natural_join(reference, merged, keys, "inner", null_safe))


# The ten compared pairs.
COMPARED_PAIRS = [
    (target, score)
    for target in ("cn", "cn_as_diploid")
    for score in ("cn_b", "cn_a", "log2_a", "cn_mean", "cn_min_dev")
]


def cn_correlations(compared: DataFrame, pairs: Sequence[tuple[str, str]] = COMPARED_PAIRS) -> DataFrame:
    """Spearman test of each reference copy number against each score."""
    return spearman_pairs(compared, pairs)


def classify_cn(df: DataFrame, cn: str = "cn", name: str = "status") -> DataFrame:
    return df.withColumn(name, k.called_cn_class(cn))


def classify_log2(df: DataFrame, log2: str = "log2", p: str = "p_ttest", name: str = "status") -> DataFrame:
    return df.withColumn(name, k.log2_call(log2, p))


def volcano_table(
    df: DataFrame,
    p: str = "p_ttest",
    log2: str = "log2",
    p_source: DataFrame | None = None,
    p_source_col: str | None = None,
    alpha: float = 0.05,
    floor: float = -4.0,
) -> DataFrame:
    """Trimmed log ratio and -log10 p, the latter NULL where not significant.

    The smallest non-zero p of ``p_source`` (the table itself by default) is
    added to every p so that zero has a finite score. It is computed once and
    enters the scan of ``df`` as a constant.
    """
    source = df if p_source is None else p_source
    found = col(p_source_col or p)
    eps = source.agg(F.min(F.when(found != 0, found))).scalar()
    score = -F.log10(col(p) + eps)
    return df.withColumns({
        "neglog_p": if_else(col(p) > alpha, F.lit(None).cast("double"), score),
        "trimmed_log2": at_least(log2, floor),
    })


def gene_medians(df: DataFrame, gene: str = "gene", cn: str = "cn") -> DataFrame:
    """Median copy number per gene over samples."""
    return median_value(df, [gene], cn, "median_cn")
