"""Grouped counts, minima, priorities and set aggregates.

Everything reduces map-side before its shuffle, so the data moved for a group is
bounded by what the group's result needs, not by the group's number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classes import level_of, ordinal
from ..functions.nulls import col, null_safe_all
from ..sources.writers import staged
from .ranks import running_totals


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_ids(df: DataFrame, column: str, name: str = "n_ids") -> DataFrame:
    """Number of distinct values, a missing value counting as one of them."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias(name))


def contingency(df: DataFrame, a: str, b: str, name: str = "n") -> DataFrame:
    """Non-empty cells of the two-way table of counts."""
    return group_count(df, [a, b], name)


def min_rows(
    df: DataFrame, keys: Sequence[str], value: Column | str, null_safe: bool = True
) -> DataFrame:
    """All rows that hold their group's minimum, ties included.

    A group without any value is kept whole. The minimum is found by a map-side
    combined aggregate and rows are picked by a semi join on (keys, minimum): a
    hot group is never sorted in one task, and the semi join's row side can be
    split by adaptive execution.
    """
    keys = list(keys)
    valued = df.withColumn("_value", col(value))
    lowest = valued.groupBy(*keys).agg(F.min("_value").alias("_lowest"))
    pairs = [(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")) for k in keys]
    same_value = F.col("l._value").eqNullSafe(F.col("r._lowest"))
    if null_safe:
        cond = null_safe_all(pairs) & same_value
    else:
        cond = same_value
        for x, y in pairs:
            cond = cond & (x == y)
    return valued.alias("l").join(lowest.alias("r"), cond, "left_semi").drop("_value")


def min_rows_within(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """The distinct rows of ``min_rows`` in one scan and one shuffle, for groups
    known to be small, such as those within one file: a task holds whole groups."""
    group = Window.partitionBy(*keys)
    valued = df.withColumn("_value", col(value)).withColumn("_lowest", F.min("_value").over(group))
    lowest = valued.filter(F.col("_value").eqNullSafe(F.col("_lowest")))
    return lowest.drop("_value", "_lowest").distinct()


def min_text_rows(
    df: DataFrame, keys: Sequence[str], value: str, numeric: bool = True, null_safe: bool = True
) -> DataFrame:
    """``min_rows`` on a text column, compared as numbers or, with
    ``numeric=False``, as text (``"10"`` before ``"2"``)."""
    order = col(value).try_cast("double") if numeric else col(value)
    return min_rows(df, keys, order, null_safe)


def top_class(
    df: DataFrame, keys: Sequence[str], class_col: str, priority: Sequence[str]
) -> DataFrame:
    """One row per group with its highest-priority class; classes outside the
    list rank last and come out as NULL."""
    best = df.groupBy(*keys).agg(F.min(ordinal(class_col, priority)).alias("_best"))
    return best.select(*keys, level_of("_best", priority).alias(class_col))


def class_lists(
    df: DataFrame, keys: Sequence[str], class_col: str, priority: Sequence[str]
) -> DataFrame:
    """Per group the sorted classes (each once), its best class and row count,
    the material to verify ``top_class`` with."""
    return df.groupBy(*keys).agg(
        F.array_sort(F.collect_set(class_col)).alias("classes"),
        F.count(F.lit(1)).alias("n"),
        level_of(F.min(ordinal(class_col, priority)), priority).alias("best"),
    )


def class_runs(
    df: DataFrame, keys: Sequence[str], class_col: str, levels: Sequence[str]
) -> DataFrame:
    """Rows per (group, class) with the place of the class in ``levels``; unlisted
    classes stand behind the listed ones."""
    place = F.coalesce(ordinal(class_col, levels), F.lit(len(levels)))
    return group_count(df, [*keys, class_col]).withColumn("place", place)


def joined_classes(
    df: DataFrame,
    keys: Sequence[str],
    class_col: str,
    levels: Sequence[str],
    sep: str = ";",
    name: str = "classes",
) -> DataFrame:
    """All classes of a group, repeats included, joined in the order of
    ``levels`` (unlisted ones last, by name).

    Built from ``class_runs``, so a group contributes one row per class to the
    collected list whatever its size. The text itself has every repeat; where it
    would be too long for a cell, the runs say the same.
    """
    entry = F.struct("place", col(class_col).alias("value"), "n")
    runs = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.array_repeat(F.coalesce(e["value"], F.lit("NA")), e["n"].cast("int")),
    )
    counted = class_runs(df, keys, class_col, levels)
    return counted.groupBy(*keys).agg(F.array_join(F.flatten(runs), sep).alias(name))


def joined_set(c: Column | str, sep: str = ",") -> Column:
    """Aggregate: distinct non-null values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), sep)


def collapse_except(df: DataFrame, column: str, **aggregates: Column) -> DataFrame:
    """Group by every column but one; NULLs group together."""
    keys = [c for c in df.columns if c != column and c not in aggregates]
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def median_value(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, the mean of the two middle values of an even number.

    Values are counted first and then placed by ranges of (group, value), so a
    group that holds all rows, each with a value of its own, is spread over all
    ranges; at most two rows a group reach the last step.
    """
    key = F.struct(*[col(k).alias(k) for k in keys])  # a missing key is a key, and no NULL itself
    counted = group_count(df.filter(col(value).isNotNull()), [*keys, value], "_n")
    counted = staged(counted.select(key.alias("_key"), col(value).alias("_value"), "_n"), "counted")
    totals = counted.groupBy("_key").agg(F.sum("_n").alias("_all"))
    placed = running_totals(counted, ["_key"], "_value", "_n", "_before").join(totals, "_key")

    def holds(place: Column) -> Column:
        return (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))

    middle = placed.filter(holds(F.floor((F.col("_all") - 1) / 2)) | holds(F.floor(F.col("_all") / 2)))
    low, high = F.min("_value").cast("double"), F.max("_value").cast("double")
    return middle.groupBy("_key").agg((low + (high - low) / 2).alias(name)).select(*[
        F.col("_key").getField(k).alias(k) for k in keys], name)
