"""Earlier table forms: multi-hit cells, scored segments, portal track exports
and panel matrices with a fixed list of sample columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import classes as k
from ..functions.nulls import blank_to_null, col, if_else, in_set
from ..functions.text import join_non_null, remove_first
from ..operators.groups import joined_classes
from ..operators.joins import natural_join, split_full_join
from ..operators.reshape import pivot_sets, unpivot_values
from .matrix import panel_label, without_class

# Track types and segment thresholds.
CNA_TRACK, SNV_TRACK = "CNA", "MUTATIONS"
MIN_BAYES_FACTOR = 20
LARGE_OBSERVED, LARGE_EXPECTED = 2, 30
MIN_ABS_Z = 1


def multi_hit_classes(
    df: DataFrame,
    keys: Sequence[str] = ("gene", "sample"),
    class_col: str = "func",
    recoding: Mapping[str, str] | None = k.FUNC_TO_SNV,
    name: str = "snv",
) -> DataFrame:
    """All classes of a gene and sample joined by ``;`` in the order of the
    recoding; ``_2`` behind the last one marks that there are several."""
    if recoding is None:
        classed, levels = df, []
    else:
        classed = df.withColumn(class_col, k.recode(class_col, recoding))
        levels = list(dict.fromkeys(recoding.values()))
    joined = joined_classes(classed, keys, class_col, levels, ";", name)
    several = col(name).contains(";")
    return joined.withColumn(name, F.when(several, F.concat(col(name), F.lit("_2"))).otherwise(col(name)))


def filter_segments(
    df: DataFrame,
    bayes: str = "BF",
    known: str = "Conrad_hg19",
    kind: str = "type",
    ratio: str = "reads_ratio",
    observed: str = "reads_observed",
    expected: str = "reads_expected",
    z: str = "standardizedValue",
    name: str = "cna",
    min_bayes: float = MIN_BAYES_FACTOR,
    large_observed: float = LARGE_OBSERVED,
    large_expected: float = LARGE_EXPECTED,
    min_abs_z: float = MIN_ABS_Z,
) -> DataFrame:
    """Well-supported segments that are no known common variant and whose ratio
    does not contradict their type, with their copy-number class."""
    kept = df.filter(
        (col(bayes) > min_bayes)
        & col(known).isNull()
        & ~((col(kind) == "deletion") & (col(ratio) >= 1))
        & (F.abs(col(z)) >= min_abs_z)
    )
    large = (col(observed) < large_observed) & (col(expected) > large_expected)
    event = if_else(large, F.lit("large deletion"), k.recode(kind, k.SEGMENT_TYPES))
    return kept.withColumn(name, k.recode(event, k.SEGMENT_TO_CN))


def merge_events(
    cna: DataFrame, snv: DataFrame, keys: Sequence[str] = ("gene", "sample"),
    cna_col: str = "cna", snv_col: str = "snv", name: str = "alterations", null_safe: bool = True,
) -> DataFrame:
    """Row-wise outer merge of both event kinds; repeated copy-number rows of a
    key stay separate rows."""
    merged = split_full_join(cna, snv, keys, null_safe)
    return merged.withColumn(name, join_non_null(";", cna_col, snv_col))


def unpivot_tracks(
    wide: DataFrame | None = None,
    long: DataFrame | None = None,
    gene: str = "track_name",
    kind: str = "track_type",
    sample: str = "sample",
    value: str = "value",
    samples: Sequence[str] | None = None,
    sites: DataFrame | None = None,
    site_key=None,
    ranked: bool = False,
    keep_blank: bool = False,
    complex_panel: Sequence[str] | None = None,
    name: str = "alterations",
) -> DataFrame:
    """Portal export (one row per gene and track, one column per sample) as one
    row per gene and sample with its joined event text.

    Copy-number and mutation tracks are brought together by one grouping instead
    of an outer join of the table with itself; a track listed twice fails. A
    blank mutation counts as missing unless ``keep_blank``, which leaves a
    trailing ``;``. ``ranked`` restricts mutations to the driver-before-passenger
    list. ``sites`` (sample, site) is joined after ``site_key(sample)``.
    """
    if long is None:
        long = unpivot_values(wide, [gene, kind], sample, value, samples)
    tracks = long.filter(col(kind).isin(CNA_TRACK, SNV_TRACK))

    def track(which: str):
        here = col(kind) == which
        return F.when(F.count_if(here) > 1, F.raise_error(F.lit(f"track {which} listed twice"))).otherwise(
            F.max(F.when(here, col(value)))
        )

    cells = tracks.groupBy(gene, sample).agg(track(CNA_TRACK).alias("_cna"), track(SNV_TRACK).alias("_snv"))
    cna = k.recode(blank_to_null("_cna"), k.TRACK_TO_CN)
    raw = col("_snv") if keep_blank else blank_to_null("_snv")
    if ranked:
        snv = k.level(k.recode(raw, k.TRACK_TO_SNV_RANKED), k.DRIVER_PRIORITY)
        simple = remove_first(snv, r"\s\(.*\)")
    else:
        snv = k.recode(raw, k.TRACK_TO_SNV)
        simple = remove_first(remove_first(snv, r"\s\(.*\)"), r"\s?mutation\s?", ignore_case=True)
    events = cells.select(
        gene, sample, cna.alias("cna"), snv.alias("snv"), simple.alias("snv_simple"),
        join_non_null(";", cna, simple).alias(name),
    )
    if complex_panel is not None:
        events = events.withColumn("group", panel_label(gene, complex_panel))
    if sites is None:
        return events
    keyed = events.withColumn("_site_key", site_key(col(sample)) if site_key else col(sample))
    located = sites.select(col("sample").alias("_site_key"), "site")
    return natural_join(keyed, located, ["_site_key"], "left").drop("_site_key")


def driver_priority(df: DataFrame, class_col: str = "snv", name: str = "priority") -> DataFrame:
    """Place of a class in the driver-before-passenger list, NULL outside it."""
    return df.withColumn(name, k.ordinal(class_col, k.DRIVER_PRIORITY))


def panel_matrix(
    events: DataFrame,
    panel: Sequence[str],
    samples: Sequence[str],
    drop_shallow: bool = False,
    gene: str = "gene",
    sample: str = "sample",
    value: str = "alterations",
) -> DataFrame:
    """Wide matrix of one panel over a fixed list of samples: every panel gene
    has a row and every listed sample a column, blank where nothing is known.
    Several rows for a cell become its distinct texts."""
    genes = list(dict.fromkeys(panel))
    kept = events.filter(in_set(gene, genes))
    if drop_shallow:
        kept = without_class(kept, value=value)
    spark = events.sparkSession
    every_gene = spark.createDataFrame([(g,) for g in genes], f"`{gene}` string")
    rows = kept.select(gene, sample, blank_to_null(value).alias(value)).unionByName(
        every_gene, allowMissingColumns=True
    )
    return pivot_sets(rows, gene, sample, value, samples)
