"""Readers for delimited call files.

All files of a kind are read by one scan; what a file stands for is taken from
its path. Types are stated, or found over all rows of all files before the read; a
type found in a sample would differ between the files of one scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from ..functions.nulls import col
from ..functions.text import first_match
from .lines import detect_separator, detect_types, read_by_name

WIDE_MAX_COLUMNS = 100_000
NO_TOKEN = "\u0001"  # never in a file, so that only blank fields come back as NULL

# Where a sample name stands in a path.
SEGMENTS_SAMPLE = r"cnvkit/([^/]+)"
INTERVALS_SAMPLE = r"controlfreec/([^.]+)"
ANNOVAR_SAMPLE = r"([0-9A-Za-z]+)\.mutect2\.hg38_multianno\."
VEP_SAMPLE = r"annotation/([^/]+)"


def check_names(names: Sequence[str], filler: str = "_") -> list[str]:
    """Valid, distinct column names.

    Characters other than letters, digits and underscore become the filler, a
    name that does not start with a letter gets an ``X``, a repeat gets a number.
    """
    out: list[str] = []
    for name in names:
        valid = re.sub(r"[^0-9A-Za-z_]", filler, name)
        if not re.match(r"[A-Za-z.]", name):
            valid = "X" + valid
        candidate, n = valid, 0
        while candidate in out:
            n += 1
            candidate = f"{valid}{filler}{n}"
        out.append(candidate)
    return out


def with_checked_names(df: DataFrame) -> DataFrame:
    return df.toDF(*check_names(df.columns))


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select the named text columns with their types; bad numbers become NULL."""
    return df.select([
        col(c).alias(c) if t == "string" else col(c).try_cast(t).alias(c) for c, t in types.items()
    ])


def sample_from_path(pattern: str) -> Column:
    """Sample name captured from the path of the row's file, NULL if absent."""
    return first_match(F.col("_metadata.file_path"), pattern)


def _files(spark: SparkSession, glob: str | None, recursive: bool) -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader if glob is None else reader.option("pathGlobFilter", glob)


def _provenance(sample_pattern: str | None, sample_col: str, file_col: str | None) -> list[Column]:
    out = []
    if file_col is not None:
        out.append(F.col("_metadata.file_path").alias(file_col))
    if sample_pattern is not None:
        out.append(sample_from_path(sample_pattern).alias(sample_col))
    return out


def _text_cell(c: Column, null_token: str | None, blank: str) -> Column:
    if blank == "keep":
        c = F.coalesce(c, F.lit(""))
    return c if null_token is None else F.nullif(c, F.lit(null_token))


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = "\t",
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
    null_token: str | None = "NA",
    blank: str = "keep",
    comment: str | None = None,
    glob: str | None = None,
    recursive: bool = True,
    sample_pattern: str | None = None,
    sample_col: str = "sample",
    file_col: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Delimited text, compressed or not, from a file, a list or a directory tree.

    A header names the columns and is checked in every file; ``columns`` names
    those of header-less files instead. ``types`` picks columns (by their checked
    names) and their types; without it all are text. ``null_token`` is the text
    of a missing value. Blank text fields stay ``""`` with ``blank="keep"`` and
    become NULL with ``blank="null"``; blank numbers are always NULL. Lines that
    start with ``comment`` are left out before the header is looked for.
    ``spread`` redistributes the rows of files that cannot be split.
    """
    reader = (
        _files(spark, glob, recursive)
        .option("sep", sep).option("escape", '"').option("nullValue", NO_TOKEN)
        .option("maxColumns", WIDE_MAX_COLUMNS).option("maxCharsPerColumn", -1)
    )
    if comment is not None:
        reader = reader.option("comment", comment)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    else:
        reader = reader.option("header", "true").option("enforceSchema", "false")
    raw = reader.csv(path)
    names = check_names(raw.columns)
    wanted = dict.fromkeys(names, "string") if types is None else types
    cells = []
    for source, name in zip(raw.columns, names):
        if name not in wanted:
            continue
        kind = wanted[name]
        cell = _text_cell(col(source), null_token, blank) if kind == "string" else col(source).try_cast(kind)
        cells.append(cell.alias(name))
    missing = set(wanted) - set(names)
    if missing:
        raise ValueError(f"columns not in the file: {sorted(missing)}")
    df = raw.select(*_provenance(sample_pattern, sample_col, file_col), *cells)
    return df if spread is None else df.repartition(spread)


def read_detected(
    spark: SparkSession, path: str | list[str], sep: str | None = None, null_token: str | None = "NA",
    glob: str | None = None, recursive: bool = True, **options,
) -> DataFrame:
    """``read_delimited`` with the types, and without ``sep`` the separator, found
    in all lines of all files first: a text value anywhere makes its column text in
    every file. Reads the files twice, or three times without ``sep``."""
    sep = detect_separator(spark, path, glob, recursive) if sep is None else sep
    places = {"glob": glob, "recursive": recursive, "sep": sep, "null_token": null_token}
    text = read_delimited(spark, path, **places, **{k: v for k, v in options.items() if k in ("columns", "comment")})
    return read_delimited(spark, path, types=detect_types(text, null_token), **places, **options)


def _files_of(spark: SparkSession, path: str) -> list[str]:
    """Files at or below a path or pattern, as scans name them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(root) or []:
        below = fs.listFiles(status.getPath(), True)
        while below.hasNext():
            found.append(re.sub("^file:/+", "file:/", below.next().getPath().toUri().toString()))
    return found


def read_tagged(
    spark: SparkSession, paths: Mapping[str, str], types: Mapping[str, str], tag_col: str = "sample", **options
) -> DataFrame:
    """Union of named files or directories, each row tagged with the name, in one
    scan: the tag is looked up by the file of the row. Columns are taken by name
    from each file's own header (options of ``read_by_name``)."""
    tags = [(file, tag) for tag, path in paths.items() for file in _files_of(spark, path)]
    if len({file for file, _ in tags}) < len(tags):
        raise ValueError("a file lies under two of the paths")
    rows = read_by_name(spark, list(paths.values()), types, file_col="_path", **options)
    # one row per file, which the scan's own listing holds too
    named = spark.createDataFrame(tags, f"_path string, `{tag_col}` string")
    rows = rows.withColumn("_path", F.regexp_replace("_path", "^file:/+", "file:/"))
    return rows.join(F.broadcast(named), "_path").select(*types, tag_col)


def _one_header(count: str) -> Column:
    """True where a file's number of header lines is 1, an error elsewhere."""
    n = F.coalesce(F.col(count), F.lit(0))
    text = F.concat(n.cast("string"), F.lit(" header lines instead of one in "), F.col("_file"))
    return F.when(n == 1, True).otherwise(F.raise_error(text).cast("boolean"))


def read_preambled(
    spark: SparkSession,
    path: str | list[str],
    sep: str = "\t",
    null_token: str | None = None,
    types: Mapping[str, str] | None = None,
    glob: str | None = None,
    recursive: bool = True,
    sample_pattern: str | None = None,
    sample_col: str = "sample",
    file_col: str | None = None,
    layout: str = "shared",
    spread: int | None = None,
) -> DataFrame:
    """Tab text with ``##`` lines before one ``#name name ...`` header line.

    Preamble and blank lines are left out. With ``layout="shared"`` all files
    must have the header of the first one (a differing header is an error) and
    fields are taken by place; a second scan counts the headers of each file. With
    ``layout="per_file"`` each file's own header is joined to its lines and fields
    are taken by name; ``types`` must then say which. In both, a file with lines
    but no header, or with several, is an error.
    """
    lines = _files(spark, glob, recursive).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file")
    ).filter(F.col("value").rlike("^#?[^#]"))
    is_header = F.col("value").startswith("#")
    parts = F.split("value", sep, -1)
    if layout == "shared":
        found = lines.filter(is_header).select("value").take(1)
        if not found:
            raise ValueError(f"no header line under {path}")
        header = found[0]["value"]
        names = check_names(header.split(sep))
        other = F.concat(F.lit("header differs from the first file's in "), F.col("_file"))
        body = lines.filter(
            ~F.when(is_header & (F.col("value") != header), F.raise_error(other).cast("boolean"))
            .otherwise(is_header)
        )
        per_file = lines.groupBy("_file").agg(F.count_if(is_header).alias("_headers"))
        wrong = per_file.filter(~_one_header("_headers"))  # raises, so it adds no row
        body = body.unionByName(wrong.select(F.lit("").alias("value"), "_file")).withColumn("_parts", parts)
        cells = {n: F.get("_parts", i) for i, n in enumerate(names)}
        wanted = dict.fromkeys(names, "string") if types is None else types
    elif layout == "per_file":
        if types is None:
            raise ValueError("layout='per_file' needs the wanted columns in types")
        headers = lines.filter(is_header).groupBy("_file").agg(
            F.count(F.lit(1)).alias("_headers"), F.split(F.min("value"), sep, -1).alias("_names")
        )
        body = lines.filter(~is_header).join(headers, "_file", "left").filter(_one_header("_headers"))
        body = body.withColumn("_parts", parts)
        checked = F.transform("_names", lambda n: F.regexp_replace(
            F.regexp_replace(n, "^(?![A-Za-z.])", "X"), "[^0-9A-Za-z_]", "_"))
        body = body.withColumn("_names", checked)
        cells = {
            n: F.get("_parts", F.array_position("_names", n).cast("int") - 1) for n in types
        }
        wanted = types
    else:
        raise ValueError(f"unknown layout {layout!r}")

    def cell(name: str, kind: str) -> Column:
        text = cells[name] if null_token is None else F.nullif(cells[name], F.lit(null_token))
        return (text if kind == "string" else text.try_cast(kind)).alias(name)

    extra = []
    if file_col is not None:
        extra.append(F.col("_file").alias(file_col))
    if sample_pattern is not None:
        extra.append(first_match("_file", sample_pattern).alias(sample_col))
    df = body.select(*extra, *[cell(n, t) for n, t in wanted.items()])
    return df if spread is None else df.repartition(spread)


def read_vcf(
    spark: SparkSession,
    path: str | list[str],
    sample_pattern: str | None = None,
    glob: str | None = None,
    file_col: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Records of single-sample VCF files. The nine leading columns are fixed by
    the format and the sample is the tenth, so no header line is needed."""
    # Column names of the format.
    names = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "STATS"]
    lines = _files(spark, glob, True).text(path)
    records = lines.filter(F.col("value").rlike("^[^#]")).withColumn("_parts", F.split("value", "\t", -1))
    cells = [
        (F.get("_parts", i).try_cast("bigint") if n == "POS" else F.get("_parts", i)).alias(n)
        for i, n in enumerate(names)
    ]
    df = records.select(*_provenance(sample_pattern, "sample", file_col), *cells)
    return df if spread is None else df.repartition(spread)
