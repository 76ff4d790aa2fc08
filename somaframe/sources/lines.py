"""Text files taken line by line: skipped lines, a header of its own for every
file, fields by name, matrices of any width, types and separator found by reading.

One scan reads all files of a call. A line knows whether it lies in the first
split of its file and its place there: within a task ids ascend by one from row
to row, so the smallest id of a file's first split marks its top. Lines to skip and
the header have to lie in that split. Headers come to the lines by a join on the
file, and every plan is of one size whatever the number of files and columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.nulls import col
from ..functions.text import first_match

SEPARATORS = [",", "\t", "|", ";", " "]  # candidates, the earlier one in a tie
_BOOLEAN, _INT, _BIGINT, _DOUBLE, _TEXT = 1, 2, 4, 8, 16  # kinds of cells seen in a column


def _scan(spark: SparkSession, path, glob: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = (reader if glob is None else reader.option("pathGlobFilter", glob)).text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_top"),
        F.monotonically_increasing_id().alias("_id"))


def fields(line: Column, sep: str) -> Column:
    """Fields of a line; those in double quotes may hold the separator."""
    s = f"\\x{ord(sep):02x}"
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{s}("(?:[^"]++|"")*+"(?={s}|$)|[^{s}]*+)'), F.lit(1))
    plain = F.transform(found, lambda f: F.when(
        F.startswith(f, F.lit('"')) & F.endswith(f, F.lit('"')) & (F.length(f) > 1),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, s, -1))


def valid_names(names: Column) -> Column:
    """Column names with an underscore for each invalid character, as check_names."""
    return F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(n, "^(?![A-Za-z.])", "X"), "[^0-9A-Za-z_]", "_"))


def with_headers(spark: SparkSession, path, sep: str, glob: str | None = None, recursive: bool = True, skip: int = 0) -> DataFrame:
    """value, _file, header: the lines below each file's header, blank ones left
    out. The header is the line after ``skip`` lines; a file without is an error."""
    lines = _scan(spark, path, glob, recursive)
    tops = lines.filter("_top").groupBy("_file").agg(F.min("_id").alias("_first"))
    first = lines.filter("_top").join(tops, "_file").filter(F.col("_id") == F.col("_first") + skip)
    heads = first.select("_file", "_first", fields(F.col("value"), sep).alias("header"))
    below = lines.join(heads, "_file", "left").filter(~(F.col("_top") & F.coalesce(F.col("_id") <= F.col("_first") + skip, F.lit(False))))
    missing = F.concat(F.lit(f"no header after {skip} lines in the first split of "), F.col("_file"))
    known = F.when(F.col("header").isNotNull(), True).otherwise(F.raise_error(missing).cast("boolean"))
    return below.filter(known & (F.col("value") != "")).select("value", "_file", "header")


def _cell(c: Column, kind: str, null_token: str | None, blank: str) -> Column:
    if kind != "string":
        return c.try_cast(kind)
    c = c if null_token is None else F.nullif(c, F.lit(null_token))
    return c if blank == "keep" else F.nullif(c, F.lit(""))


def read_by_name(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str],
    sep: str = "\t",
    null_token: str | None = "NA",
    blank: str = "keep",
    skip: int = 0,
    glob: str | None = None,
    recursive: bool = True,
    sample_pattern: str | None = None,
    sample_col: str = "sample",
    file_col: str | None = None,
) -> DataFrame:
    """Delimited files whose headers may differ in names and order, in one scan.

    ``types`` picks columns by their checked names; a column a file does not have is
    NULL in its rows, as is a field missing at the end of a line. The first ``skip``
    lines of each file are left out, whatever they are.
    """
    lines = with_headers(spark, path, sep, glob, recursive, skip)
    names = valid_names(F.col("header"))
    places = F.array(*[F.array_position(names, n).cast("int") - 1 for n in types])  # of absent names, -1
    placed = lines.select("_file", fields(F.col("value"), sep).alias("_fields"), places.alias("_places"))
    cells = [_cell(F.get("_fields", F.get("_places", i)), kind, null_token, blank).alias(n)
             for i, (n, kind) in enumerate(types.items())]
    extra = [] if file_col is None else [F.col("_file").alias(file_col)]
    if sample_pattern is not None:
        extra.append(first_match("_file", sample_pattern).alias(sample_col))
    return placed.select(*extra, *cells)


def read_long(
    spark: SparkSession,
    path: str | list[str],
    ids: Sequence[str],
    key: str,
    value: str,
    sep: str = "\t",
    drop: Sequence[str] = (),
    kind: str = "string",
    blank: str = "keep",
    null_token: str | None = "NA",
    skip: int = 0,
    glob: str | None = None,
) -> DataFrame:
    """Matrix files of any number of columns, one row per cell: the id columns,
    the column's name as ``key`` and its ``value``.

    Names and cells are paired as arrays, so neither the plan nor the reader's
    column limit knows the width. A missing cell is NULL; cells beyond the header
    are an error. Files may have different columns.
    """
    lines = with_headers(spark, path, sep, glob, True, skip).select("header", fields(F.col("value"), sep).alias("_fields"))
    wide = F.when(F.size("_fields") <= F.size("header"), True).otherwise(
        F.raise_error(F.lit("a line has more cells than its file's header")).cast("boolean"))
    named = [_cell(F.get("_fields", F.array_position("header", c).cast("int") - 1), "string", null_token, blank).alias(c) for c in ids]
    pairs = F.arrays_zip(F.col("header").alias("name"), F.col("_fields").alias("cell"))
    found = lines.filter(wide).select(*named, pairs.alias("_pairs"))  # else each cell's row carries both arrays for the ids
    cells = found.select(*[col(c) for c in ids], F.explode("_pairs").alias("_pair"))
    return cells.filter(~F.col("_pair.name").isin([*ids, *drop])).select(
        *[col(c) for c in ids], F.col("_pair.name").alias(key), _cell(F.col("_pair.cell"), kind, null_token, blank).alias(value))


def detect_separator(spark: SparkSession, path, glob: str | None = None, recursive: bool = True) -> str:
    """The candidate that gives all non-blank lines of all files the same number
    of fields, at least two and the most of all. One aggregate over all lines."""
    lines = _scan(spark, path, glob, recursive).filter(F.col("value") != "")
    bare = F.regexp_replace("value", '"(?:[^"]++|"")*+"', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) + 1 for s in SEPARATORS]
    found = lines.agg(*[F.min(n).alias(f"low{i}") for i, n in enumerate(counts)],
                      *[F.max(n).alias(f"high{i}") for i, n in enumerate(counts)]).first()
    even = {s: found[f"low{i}"] for i, s in enumerate(SEPARATORS) if found[f"low{i}"] == found[f"high{i}"] and (found[f"low{i}"] or 0) > 1}
    if not even:
        raise ValueError(f"no separator divides all lines under {path} alike: state it")
    return max(even, key=even.get)


def cell_kind(c: Column, null_token: str | None) -> Column:
    """Kind of a cell as one bit; of a blank or missing one, none."""
    text = F.trim(c)
    empty = text.isNull() | (text == "") | (F.lit(False) if null_token is None else text == null_token)
    number = "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^(?:NaN|[+-]?Inf(?:inity)?)$"
    return (
        F.when(empty, 0).when(text.rlike("^(?:TRUE|FALSE|True|False|true|false)$"), _BOOLEAN)
        .when(text.rlike("^[+-]?[0-9]+$"), F.when(text.try_cast("int").isNotNull(), _INT)
              .when(text.try_cast("bigint").isNotNull(), _BIGINT).otherwise(_DOUBLE))
        .when(text.rlike(number), _DOUBLE).otherwise(_TEXT)
    )


def type_of(kinds: int) -> str:
    """Narrowest type of all kinds of cells seen: booleans mix with nothing, whole
    numbers widen, and text takes all. A column without values is text."""
    if not kinds or kinds & _TEXT or kinds & _BOOLEAN and kinds != _BOOLEAN:
        return "string"
    return "boolean" if kinds == _BOOLEAN else "double" if kinds & _DOUBLE else "bigint" if kinds & _BIGINT else "int"


def detect_types(text: DataFrame, null_token: str | None = "NA") -> dict[str, str]:
    """Type of each column of a table of text, over all its rows: one aggregate,
    combined in the tasks to one number a column."""
    names = [c for c, t in text.dtypes if t == "string"]
    seen = text.agg(*[F.bit_or(cell_kind(col(c), null_token)).alias(c) for c in names]).first()
    return {c: type_of(seen[c] or 0) for c in names}
