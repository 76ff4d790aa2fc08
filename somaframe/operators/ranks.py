"""Ranks and positions over whole tables without a single-task window.

The building block is a running total in two levels. Rows are first reduced to
one row per distinct value and dealt by ranges of the values, with the number of
the partition stored next to them. Totals per partition give each partition its
offset, and a window inside the partition does the rest. No task sees more than
one range, and a value held by a third of all rows is one row by then.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.nulls import col
from ..sources.writers import staged


def running_totals(
    hist: DataFrame,
    by: Sequence[str],
    value: str | Sequence[str],
    weight: str,
    name: str = "before",
    parts: int | None = None,
) -> DataFrame:
    """Add the total weight of all smaller values within ``by``.

    ``hist`` must hold one row per (by, value); ``value`` is one column or several,
    compared in turn, of any orderable type. Columns of ``by`` hold no NULL.

    The table is staged in ``parts`` ranges, by default as many as the session
    shuffles into; where they begin changes the work per task, never the result. A
    range holds neighbours only, so there are at most as many offsets as ranges and
    groups together, and these are broadcast.
    """
    values = [value] if isinstance(value, str) else list(value)
    # without a group the constant is staged too, so that it stays a column
    keys, table = (list(by), hist) if by else (["_all"], hist.withColumn("_all", F.lit(0)))
    count = () if parts is None else (parts,)
    ranged = table.repartitionByRange(*count, *keys, *values)
    placed = staged(ranged.withColumn("_part", F.spark_partition_id()), "ranges")

    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_total")).select(
        *keys, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    smaller = Window.partitionBy(*keys, "_part").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_within", F.coalesce(F.sum(weight).over(smaller), F.lit(0)))
    return within.join(F.broadcast(offsets), [*keys, "_part"]).select(
        *hist.columns, (F.col("_offset") + F.col("_within")).alias(name)
    )


def average_ranks(
    hist: DataFrame, by: Sequence[str], value: str, weight: str, parts: int | None = None
) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places."""
    ranked = running_totals(hist, by, value, weight, "_before", parts)
    rank = F.col("_before") + (F.col(weight) + 1) / F.lit(2.0)
    return ranked.select(*by, value, rank.alias("rank"))


def row_positions(
    df: DataFrame, order: Sequence[Column], id_col: str, name: str = "position", parts: int | None = None
) -> DataFrame:
    """Add the place (from 1) of each row in a total order over the table.

    ``order`` is compared column by column, ``id_col`` decides what is left.
    """
    keys = {f"_k{i}": c for i, c in enumerate([*order, F.col(id_col)])}
    keyed = df.withColumns({**keys, "_one": F.lit(1).cast("long")})
    placed = running_totals(keyed, [], list(keys), "_one", "_before", parts)
    return placed.select(*df.columns, (F.col("_before") + 1).alias(name))


def rank_test_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t approximation, with the
    statistic lowered by one on the negative side.

    Meant for result rows, of which there is one per compared pair. The helpers
    are local so that executors need nothing but this function's closure.
    """
    def gamma_step(a: float) -> float:
        # log of gamma(a + 1/2) / gamma(a); by its series where logs of gammas would cancel out
        if a < 50.0:
            return math.lgamma(a + 0.5) - math.lgamma(a)
        return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)

    def fraction(a: float, b: float, x: float) -> float:
        # continued fraction of the incomplete beta function
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
        out = d
        for m in range(1, 10_000):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            change = 1.0
            for term in (even, odd):
                d = 1.0 / ((1.0 + term * d) or tiny)
                c = (1.0 + term / c) or tiny
                change *= d * c
            out *= change
            if abs(change - 1.0) < 1e-15:
                return out
        raise ArithmeticError(f"the tail probability does not converge at {a}, {b}, {x}")

    def one(r: float, size: float) -> float:
        if math.isnan(r) or size < 3:
            return math.nan
        if r < 0:
            r = r + 6.0 / (size * (size * size - 1.0))
            if r >= 0:
                return 1.0
        if abs(r) >= 1.0:
            return 0.0
        if r == 0.0:
            return 1.0
        half, square = (size - 2.0) / 2.0, r * r
        if size > 1e6:
            # the fraction would cancel out; the normal deviate of t is exact up to 1/size^2 here
            deviate = (16 * half + 1) / (16 * half + 3) * math.sqrt(-2 * half * math.log1p(-square))
            return math.erfc(deviate / math.sqrt(2))
        # regularised incomplete beta function of free/2 and 1/2 at 1 - r^2
        front = math.exp(
            gamma_step(half) - math.lgamma(0.5) + half * math.log1p(-square) + 0.5 * math.log(square)
        )
        if 1.0 - square > (half + 1.0) / (half + 2.5):
            return 1.0 - front / 0.5 * fraction(0.5, half, square)
        return front / half * fraction(half, 0.5, 1.0 - square)

    def batch(rs: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([one(float(r), float(size)) for r, size in zip(rs, sizes)], dtype="float64")

    return F.nanvl(F.pandas_udf(batch, T.DoubleType())(rho, n), F.lit(None).cast("double"))


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], parts: int | None = None) -> DataFrame:
    """Spearman's rank correlation for several column pairs in one job.

    Each pair uses the rows where both values are present. Result per pair: n,
    rho, the statistic ``s`` = (n^3 - n)(1 - rho)/6 and the two-sided p of the
    t approximation. rho is NULL for a constant column; a pair without rows has
    no result.

    A column is ranked once for all pairs that take all its values, as counted
    beforehand, and once for each other column that leaves some out. Ranks are
    worked out on distinct values and joined to the counts per (pair, x, y).
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    places = [(names.index(x), names.index(y)) for x, y in pairs]
    absent = F.lit(None).cast("double")
    rows = staged(
        df.select(*[F.nanvl(col(c).cast("double"), absent).alias(f"v{i}") for i, c in enumerate(names)]), "rank-values"
    )

    def where_present(i: int, other: int) -> Column:
        return F.when(F.col(f"v{other}").isNotNull(), F.col(f"v{i}"))

    sizes = rows.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.count(where_present(x, y)).alias(f"pair{i}") for i, (x, y) in enumerate(places)],
    ).first()
    rankings: dict[tuple[int, int], int] = {}

    def ranking(pair: int, i: int, other: int) -> int:
        whole = sizes[f"pair{pair}"] == sizes[f"n{i}"]
        return rankings.setdefault((i, i if whole else other), len(rankings))

    used = [(ranking(p, x, y), ranking(p, y, x)) for p, (x, y) in enumerate(places)]
    stacked = F.inline(F.array(*[
        F.struct(F.lit(r).alias("ranking"), where_present(i, other).alias("value")) for (i, other), r in rankings.items()
    ]))
    hist = rows.select(stacked).filter("value IS NOT NULL").groupBy("ranking", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = staged(average_ranks(hist, ["ranking"], "value", "n", parts), "ranks")

    paired = F.inline(F.array(*[
        F.struct(F.lit(p).alias("pair"), F.col(f"v{x}").alias("x"), F.col(f"v{y}").alias("y"))
        for p, (x, y) in enumerate(places)
    ]))
    joint = (
        rows.select(paired).filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )

    def of_pair(values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), "pair")

    for axis, numbers in zip("xy", zip(*used)):
        found = ranks.select(F.col("ranking").alias("_ranking"), F.col("value").alias(axis), F.col("rank").alias(f"r{axis}"))
        joint = joint.withColumn("_ranking", of_pair(numbers)).join(found, ["_ranking", axis]).drop("_ranking")

    # ranks add up to n(n+1)/2 whatever the ties, so their mean is known
    centre = of_pair([(sizes[f"pair{p}"] + 1) / 2 for p in range(len(places))])
    dx, dy, n = F.col("rx") - centre, F.col("ry") - centre, F.col("n").cast("double")
    sums = joint.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum(n * dx * dy).alias("sxy"), F.sum(n * dx * dx).alias("sxx"), F.sum(n * dy * dy).alias("syy")
    )
    rho = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    cube = F.pow(F.col("n").cast("double"), 3) - F.col("n")
    return (
        sums.select(
            of_pair([x for x, _ in pairs]).alias("x_name"), of_pair([y for _, y in pairs]).alias("y_name"), "n", rho.alias("rho")
        )
        .withColumn("s", cube * (1 - F.col("rho")) / 6)
        .withColumn("p", rank_test_p(F.col("rho"), F.col("n").cast("double")))
    )
