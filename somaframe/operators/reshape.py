"""Wide to long, long to wide, token explosion and dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import col, null_to_blank
from ..functions.text import split_part_names


def unpivot_values(
    df: DataFrame,
    ids: Sequence[str],
    key: str,
    value: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per value column; cells that are NULL are kept.

    Without ``columns`` every column that is not an id is turned.
    """
    turned = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([col(c) for c in ids], [col(c) for c in turned], key, value)


def columns_after(df: DataFrame, n: int) -> list[str]:
    """Names of all columns but the first ``n``."""
    return df.columns[n:]


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop columns whose name ends in ``suffix``."""
    return df.select([col(c) for c in df.columns if not c.endswith(suffix)])


def move_last(df: DataFrame, column: str) -> DataFrame:
    return df.select([col(c) for c in df.columns if c != column] + [col(column)])


def move_first(df: DataFrame, column: str) -> DataFrame:
    return df.select([col(column)] + [col(c) for c in df.columns if c != column])


def explode_tokens(df: DataFrame, name: str, tokens: Column, keep_empty: bool = False) -> DataFrame:
    """A row per token. Rows without tokens vanish, or stay with a NULL token."""
    turn = F.explode_outer if keep_empty else F.explode
    others = [col(c) for c in df.columns if c != name]
    return df.select(*others, turn(tokens).alias(name))


def split_columns(df: DataFrame, column: str, sep: str, names: list[str]) -> DataFrame:
    """Replace a column by one column per part; short records end in NULLs."""
    others = [col(c) for c in df.columns if c != column]
    return df.select(*others, *split_part_names(column, sep, names))


def _single(value: Column, what: str) -> Column:
    message = F.concat(F.lit(f"more than one value per {what}: "), F.count(F.lit(1)).cast("string"))
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(F.first(value))


def pivot_unique(
    df: DataFrame, row: str, column: str, value: str, values: Sequence[str], fill: str | None = None
) -> DataFrame:
    """Long to wide with stated columns; fails on a duplicate (row, column).

    Columns that never occur are still made. The first grouping is map-side
    combined and the second sees at most ``len(values)`` rows per group.
    """
    cells = (
        df.filter(col(column).isin(list(values)))
        .groupBy(row, column)
        .agg(_single(col(value), f"({row}, {column})").alias(value))
    )
    rows = df.select(row).distinct().select(col(row), F.lit(None).cast("string").alias(column),
                                            F.lit(None).cast(df.schema[value].dataType).alias(value))
    wide = cells.unionByName(rows).groupBy(row).pivot(column, list(values)).agg(F.first(value))
    return wide if fill is None else wide.fillna(fill)


def pivot_sets(
    df: DataFrame, row: str, column: str, value: str, values: Sequence[str], sep: str = ";"
) -> DataFrame:
    """Long to wide with duplicates allowed: a cell is its distinct values,
    sorted and joined, ``""`` when there are none."""
    return (
        df.select(row, column, value).distinct()
        .groupBy(row)
        .pivot(column, list(values))
        .agg(F.array_join(F.array_sort(F.collect_set(value)), sep))
        .fillna("")
    )


def dense_cells(
    cells: DataFrame,
    rows: Sequence[str],
    columns: DataFrame,
    row: str = "gene",
    column: str = "sample",
    value: str = "alterations",
) -> DataFrame:
    """Every listed row key for every column key, absent cells as ``""``.

    ``rows`` is the (short, in-code) list of row keys; ``columns`` holds the
    column keys and may be large. Only the sparse cells are shuffled: they are
    gathered per column key into a map with at most ``len(rows)`` entries, and
    the grid is produced by exploding the row list next to that map. A duplicate
    (row, column) fails.
    """
    rows = list(dict.fromkeys(rows))
    unique = (
        cells.filter(col(row).isin(rows))
        .groupBy(row, column)
        .agg(_single(null_to_blank(value), f"({row}, {column})").alias(value))
        .select(column, F.struct(row, value).alias("_cell"))
    )
    empty = columns.select(column, F.lit(None).cast(unique.schema["_cell"].dataType).alias("_cell"))
    gathered = (
        empty.distinct().unionByName(unique)
        .groupBy(column)
        .agg(F.map_from_entries(F.collect_list("_cell")).alias("_cells"))
    )
    grid = gathered.select(column, "_cells", F.explode(F.array(*[F.lit(r) for r in rows])).alias(row))
    return grid.select(row, column, null_to_blank(F.try_element_at("_cells", F.col(row))).alias(value))
