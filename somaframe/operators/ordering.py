"""Order of genes by alteration frequency and of samples by class layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classes import TWO_LAYERS, first_in_layer, ordinal
from ..functions.nulls import col
from .ranks import row_positions


def gene_order(matrix: DataFrame, gene: str = "gene", value: str = "alterations") -> DataFrame:
    """Genes with their count of blank cells and place: fewest blanks first, ties
    by name. The matrix has one row per panel gene, so the table is panel-sized."""
    blanks = matrix.groupBy(gene).agg(F.count_if(col(value) == "").alias("n_blank"))
    ranked = blanks.agg(F.array_sort(F.collect_list(F.struct("n_blank", gene))).alias("_order"))
    return ranked.select(F.posexplode("_order").alias("_place", "_entry")).select(
        F.col(f"_entry.{gene}").alias(gene),
        F.col("_entry.n_blank").alias("n_blank"),
        (F.col("_place") + 1).alias("gene_rank"),
    )


def _genes_in_order(matrix: DataFrame, gene: str, value: str) -> Column:
    """The ordered gene names as one array, computed once and used as a constant."""
    blanks = matrix.groupBy(gene).agg(F.count_if(col(value) == "").alias("n_blank"))
    entries = F.array_sort(F.collect_list(F.struct("n_blank", gene)))
    return blanks.agg(F.transform(entries, lambda e: e[gene])).scalar()


def _levels_by_appearance(
    matrix: DataFrame, layer: Sequence[str], gene: str, sample: str, value: str, place: Column
) -> Column:
    """Classes of one layer in the order in which they first occur when the
    matrix is read sample by sample."""
    seen = (
        matrix.select(first_in_layer(value, layer).alias("c"), F.struct(place, col(sample), col(gene)).alias("at"))
        .filter("c IS NOT NULL")
        .groupBy("c").agg(F.min("at").alias("at"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("seen"))
    )
    return seen.select(F.transform("seen", lambda e: e["c"])).scalar()


def order_samples(
    matrix: DataFrame,
    layers: Sequence[Sequence[str]] = TWO_LAYERS,
    gene: str = "gene",
    sample: str = "sample",
    value: str = "alterations",
    input_position: str | None = None,
    levels: str = "listed",
    parts: int | None = None,
) -> DataFrame:
    """Samples with their place in the layered order.

    Going through the genes by frequency, samples compare by their class in the
    first layer, then in the second and so on; a class stands at its place in the
    layer list (or, with ``levels="appearance"``, at its first occurrence in the
    matrix) and no class comes last. Ties keep ``input_position``, then the name.

    Each sample becomes one array of small integers with ``len(layers)`` entries
    per panel gene; arrays compare element by element, which is the order wanted.
    """
    genes = _genes_in_order(matrix, gene, value)
    place = col(input_position) if input_position else F.lit(0)

    def layer_place(layer: Sequence[str]) -> Column:
        found = first_in_layer(value, layer)
        if levels == "appearance":
            order = _levels_by_appearance(matrix, layer, gene, sample, value, place)
            at = F.array_position(order, found).cast("int") - 1
        else:
            at = ordinal(found, layer)
        return F.coalesce(at, F.lit(len(layer)))

    cell = F.struct(
        F.array_position(genes, col(gene)).alias("gene_rank"),
        F.array(*[layer_place(layer) for layer in layers]).alias("places"),
    )
    cells = matrix.select(col(sample), cell.alias("_cell"), place.alias("_input"))
    per_sample = cells.groupBy(sample).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("_cell")), lambda c: c["places"])).alias("layer_key"),
        F.min("_input").alias("_input"),
    )
    placed = row_positions(per_sample, [F.col("layer_key"), F.col("_input")], sample, parts=parts)
    return placed.select(sample, "position", "layer_key")


def layer_columns(
    matrix: DataFrame,
    genes: Sequence[str],
    layers: Sequence[Sequence[str]] = TWO_LAYERS,
    gene: str = "gene",
    sample: str = "sample",
    value: str = "alterations",
) -> DataFrame:
    """Per sample the class of each layer and gene, columns ``layer1_<gene>`` and
    so on. ``order_samples`` does not need this wide form."""
    classed = matrix.select(sample, gene, *[
        first_in_layer(value, layer).alias(f"layer{i}") for i, layer in enumerate(layers, 1)
    ])
    names = [f"layer{i}" for i in range(1, len(layers) + 1)]
    wide = classed.groupBy(sample).pivot(gene, list(genes)).agg(*[F.max(n).alias(n) for n in names])
    if len(names) == 1:
        return wide.withColumnsRenamed({g: f"layer1_{g}" for g in genes})
    return wide.withColumnsRenamed({f"{g}_{n}": f"{n}_{g}" for g in genes for n in names})


def order_by_list(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows sorted by a stated list; values outside the list come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), col(column).asc_nulls_last())
