"""Token and pattern expressions on text columns (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import col, to_number


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a capture group, NULL when nothing matches."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Array of all matches of a capture group (empty when none, NULL on NULL)."""
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def sum_of_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Sum of the numbers a pattern captures; 0 for no match and for NULL."""
    total = F.aggregate(
        all_matches(c, pattern, group), F.lit(0.0),
        lambda acc, x: acc + F.coalesce(to_number(x), F.lit(0.0)),
    )
    return F.coalesce(total, F.lit(0.0))


def remove_first(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Delete the first match only; text without a match is unchanged."""
    flags = "(?is)" if ignore_case else "(?s)"
    return F.regexp_replace(col(c), f"{flags}^(?<head>.*?)(?:{pattern})", "${head}")


def remove_trailing(c: Column | str, pattern: str) -> Column:
    """Delete a match that ends the text."""
    return F.regexp_replace(col(c), f"(?:{pattern})$", "")


def pad_before_last(c: Column | str, sep: str, padding: str) -> Column:
    """Replace the last separator by ``padding`` (widens a short record)."""
    return F.regexp_replace(col(c), f"{sep}(?=[^{sep}]+$)", padding)


def remove_first_text(c: Column | str, text: str) -> Column:
    """Delete the first occurrence of a literal text."""
    c = col(c)
    cut = F.overlay(c, F.lit(""), F.instr(c, text), F.lit(len(text)))
    return F.when(F.contains(c, F.lit(text)), cut).otherwise(c)


def kept_tokens(c: Column | str, sep: str, keep: str, strip: str, drop: str) -> Column:
    """Split, keep tokens containing the text ``keep``, strip the first ``strip``
    from each, then leave out those matching the pattern ``drop``. A NULL text
    gives one NULL token."""
    c = col(c)
    kept = F.filter(F.split(c, sep), lambda t: F.contains(t, F.lit(keep)))
    stripped = F.transform(kept, lambda t: remove_first_text(t, strip))
    tokens = F.filter(stripped, lambda t: ~t.rlike(drop))
    return F.when(c.isNull(), F.array(F.lit(None).cast("string"))).otherwise(tokens)


def join_non_null(sep: str, *cols: Column | str) -> Column:
    """Concatenate what is not NULL; ``""`` when everything is NULL."""
    return F.concat_ws(sep, *[col(c) for c in cols])


def split_part_names(c: Column | str, sep: str, names: list[str]) -> list[Column]:
    """One column per name from a split; parts beyond the end are NULL."""
    parts = F.split(col(c), sep)
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def field_by_key(keys: Column | str, values: Column | str, key: str, sep: str = ":") -> Column:
    """Value at the place ``key`` has in a parallel key list, NULL if absent."""
    place = F.array_position(F.split(col(keys), sep), key).cast("int")
    return F.get(F.split(col(values), sep), place - 1)


def info_fields(c: Column | str) -> Column:
    """``k=v;k2=v2;FLAG`` text as a map; a flag maps to NULL."""
    return F.str_to_map(col(c), F.lit(";"), F.lit("="))
