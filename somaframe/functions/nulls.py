"""Column helpers with explicit missing-value rules.

A missing value (NULL) and a blank string are different things here, membership
tests treat NULL as "not a member", and conditions on NULL stay NULL unless a
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    """Column by name (taken literally, so dots need no quoting) or as given."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is FALSE for NULL, so that its negation is TRUE."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_in_set(c: Column | str, values: Iterable) -> Column:
    """Negated membership; NULL counts as not listed and is kept by a filter."""
    return ~in_set(c, values)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is NULL where the condition is NULL."""
    return F.when(cond.isNull(), None).when(cond, yes).otherwise(no)


def at_least(c: Column | str, low) -> Column:
    """Raise values below ``low`` to ``low``; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c: Column | str, high) -> Column:
    """Lower values above ``high`` to ``high``; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def null_to_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def null_if(c: Column | str, cond: Column) -> Column:
    """NULL where ``cond`` is TRUE or itself NULL, else the value."""
    return if_else(cond, F.lit(None), col(c))


def to_number(c: Column | str) -> Column:
    """Text to double; text that is not a number becomes NULL."""
    return col(c).try_cast("double")


def sum_or_zero(c: Column | str) -> Column:
    """Aggregate: sum that ignores NULL and is 0 over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def round_to(c: Column | str, unit: int) -> Column:
    """Nearest multiple of ``unit``; exact halves go to the even multiple."""
    return F.bround(col(c) / F.lit(unit), 0) * F.lit(unit)


def drop_nulls(array: Column | str) -> Column:
    """Array without its NULL elements."""
    return F.array_compact(col(array))


def null_safe_all(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """All pairs equal, NULL matching NULL."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))
