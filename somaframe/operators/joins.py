"""Joins on shared key columns in which a missing key matches a missing key.

Keys are compared with ``<=>`` by default. Spark plans that as an ordinary equi
join, so broadcast, sort-merge and adaptive skew splitting all apply. Pass
``null_safe=False`` where the keys are known to be present: plain equality lets
the join reuse a partitioning its inputs already have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import null_safe_all


HOT_ROWS = 100_000  # rows of a key on one side from which it is split
MOST_HOT = 10_000  # keys that are split; sent to every executor


def _side(name: str, column: str) -> Column:
    return F.col(f"{name}.`{column}`")


def natural_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = True,
) -> DataFrame:
    """Inner, left, left_semi or left_anti join on columns both sides share.

    The other columns of the two sides must have different names.
    """
    keys = list(keys)
    pairs = [(_side("l", k), _side("r", k)) for k in keys]
    if null_safe:
        cond = null_safe_all(pairs)
    else:
        cond = [x == y for x, y in pairs]
    joined = left.alias("l").join(right.alias("r"), cond, how)
    wanted = [_side("l", c) for c in left.columns]
    if how not in ("left_semi", "left_anti"):
        extra = [c for c in right.columns if c not in keys]
        clash = set(extra) & set(left.columns)
        if clash:
            raise ValueError(f"rename columns present on both sides: {sorted(clash)}")
        wanted += [_side("r", c) for c in extra]
    return joined.select(wanted)


def semi_join(df: DataFrame, other: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows whose key occurs in ``other``. The other side is reduced to its
    distinct keys first, so only ``df`` can be skewed, and that side is splittable."""
    return natural_join(df, other.select(*keys).distinct(), keys, "left_semi", null_safe)


def anti_join(df: DataFrame, other: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows whose key does not occur in ``other``; a NULL key in ``other``
    excludes NULL keys only."""
    return natural_join(df, other.select(*keys).distinct(), keys, "left_anti", null_safe)


def full_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True, grouped: bool = False
) -> DataFrame:
    """Full outer join with one coalesced set of key columns.

    Built from an inner join and two anti joins against distinct keys. Adaptive
    execution can split a hot key on either side of these, which it cannot do for
    a full outer join; the shuffles of the inputs are shared between the parts.
    With ``grouped=True``, for sides that come out of a grouping by the keys and so
    have no hot one, it is a single join. The rows are the same.
    """
    if grouped:
        left_keys = {k: _side("l", k) for k in keys}
        pairs = [(c, _side("r", k)) for k, c in left_keys.items()]
        cond = null_safe_all(pairs) if null_safe else [x == y for x, y in pairs]
        extra = [c for c in right.columns if c not in left_keys]
        clash = set(extra) & set(left.columns)
        if clash:
            raise ValueError(f"rename columns present on both sides: {sorted(clash)}")
        joined = left.alias("l").join(right.alias("r"), cond, "full")
        return joined.select(
            *[F.coalesce(left_keys[c], _side("r", c)).alias(c) if c in left_keys else _side("l", c) for c in left.columns],
            *[_side("r", c) for c in extra],
        )
    matched = natural_join(left, right, keys, "inner", null_safe)
    only_left = anti_join(left, right, keys, null_safe)
    only_right = anti_join(right, left, keys, null_safe)
    return matched.unionByName(only_left, allowMissingColumns=True).unionByName(
        only_right, allowMissingColumns=True
    )


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The MOST_HOT most frequent keys that have ``hot_rows`` rows or more on a side,
    with n_left and n_right; None if there is none. A key that is not among them has
    less than ``hot_rows`` rows or less than a MOST_HOT-th of all. Runs one job; rows
    are counted before the shuffle, and at most MOST_HOT rows reach the driver."""
    keys = list(keys)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*keys, one.alias("n_left"), none.alias("n_right")).unionAll(
        right.select(*keys, none.alias("n_left"), one.alias("n_right")))
    counted = both.groupBy(*keys).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    most = F.greatest("n_left", "n_right")
    found = counted.filter(most >= hot_rows).orderBy(most.desc()).limit(MOST_HOT).collect()
    return left.sparkSession.createDataFrame(found, counted.schema) if found else None


def split_full_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows of ``full_join`` by one join, hot keys being cut into a grid.

    A first pass counts the rows by key. Of a key with n_left and n_right rows, the
    left rows are dealt by a hash of their content to n_left / ``hot_rows`` parts and
    the right ones to n_right / ``hot_rows``; each goes to all parts of the other
    side, so every pair meets in exactly one cell. All rows of a key that both sides
    have find a partner, hence its rows without one are cells left over and go.
    Identical rows stay in one part. Every input is shuffled once for the join.
    """
    keys = list(keys)
    hot = hot_keys(left, right, keys, hot_rows)
    if hot is None:
        return full_join(left, right, keys, null_safe, grouped=True)
    there = F.lit(True) if null_safe else F.expr(" and ".join(f"h.`{k}` is not null" for k in keys))
    hot = hot.alias("h").select(
        *[F.col(f"h.`{k}`") for k in keys],
        F.greatest(F.ceil(F.col("n_left") / hot_rows), F.lit(1)).cast("int").alias("_rows"),
        F.greatest(F.ceil(F.col("n_right") / hot_rows), F.lit(1)).cast("int").alias("_columns"),
        ((F.col("n_left") > 0) & (F.col("n_right") > 0) & there).alias("_shared"),
    )

    def dealt(df: DataFrame, own: str, other: str, shared: str) -> DataFrame:
        match = null_safe_all([(_side("d", k), _side("h", k)) for k in keys])
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        part = F.pmod(F.xxhash64(*[_side("d", c) for c in plain]), F.coalesce(F.col(own), F.lit(1)))
        copies = F.when(F.col("_shared"), F.col(other)).otherwise(1)  # not hot: NULL, so 1
        return df.alias("d").join(F.broadcast(hot).alias("h"), match, "left").select(  # MOST_HOT rows
            *[_side("d", c) for c in df.columns], part.cast("int").alias(own),
            F.coalesce("_shared", F.lit(False)).alias(shared),
            F.explode(F.sequence(F.lit(0), copies - 1)).alias(other))

    one = dealt(left, "_rows", "_columns", "_shared_left")
    two = dealt(right, "_columns", "_rows", "_shared_right")
    joined = full_join(one, two, [*keys, "_rows", "_columns"], null_safe, grouped=True)
    left_over = F.coalesce(F.col("_shared_left") & F.col("_shared_right").isNull(), F.lit(False)) | F.coalesce(
        F.col("_shared_right") & F.col("_shared_left").isNull(), F.lit(False))
    return joined.filter(~left_over).drop("_rows", "_columns", "_shared_left", "_shared_right")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, after a check job that no key occurs twice."""
    example = duplicate_keys(df, keys).take(1)
    if example:
        raise ValueError(f"duplicate key {example[0].asDict()}")
    return df
