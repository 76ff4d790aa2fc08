"""Text hand-over queries: the given tables are written in a text form below the
shared scratch folder and read back, so that sinks and readers are compared with
the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaframe.sources import readers as r
from somaframe.sources import writers as w
from somaframe.sources.callfiles import read_clinical, read_wide

from .common import table

QUERIES, SQL = {}, {}


def tsv_roundtrip(spark, sf):
    """NA token, blank text, one directory per status with the status in its path."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_custkey", F.lit(1)).alias("o_custkey"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") == "2-HIGH", None)
        .otherwise(F.col("o_orderpriority")).alias("1000g priority"),
        "o_totalprice", "o_orderstatus",
    )
    path = w.scratch_path(spark, "tsv")
    w.write_tsv(orders, path, by="o_orderstatus")
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "X1000g_priority": "string", "o_totalprice": "double"}
    return r.read_delimited(
        spark, path, types=types, glob="*.csv", sample_pattern="o_orderstatus=([^/]+)/", sample_col="status"
    )


QUERIES["tsv_roundtrip"] = tsv_roundtrip
SQL["tsv_roundtrip"] = """
SELECT o_orderkey, nullif(o_custkey, 1) AS o_custkey, CASE o_orderpriority WHEN '5-LOW' THEN ''
  WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END AS "X1000g_priority", o_totalprice, o_orderstatus AS status FROM orders"""


def plain_tsv_roundtrip(spark, sf):
    """Unquoted, blank for missing, compressed, rows spread after the read."""
    customers = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"),
    )
    path = w.scratch_path(spark, "plain")
    w.write_plain_tsv(customers, path, compression="gzip")
    types = {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string", "c_nationkey": "int"}
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return r.read_delimited(spark, path, types=types, blank="null", null_token=None, glob="*.gz", spread=spread)


QUERIES["plain_tsv_roundtrip"] = plain_tsv_roundtrip
SQL["plain_tsv_roundtrip"] = """
SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, nullif(c_nationkey, 3) AS c_nationkey FROM customer"""


def _preambled(spark, sf):
    """Customers behind a ``#`` header line; those of one segment become ``##`` lines."""
    customers = table(spark, sf, "customer")
    key = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("##meta"), F.col("c_custkey"))).otherwise(
        F.col("c_custkey").cast("string")
    )
    lines = customers.select(
        key.alias("#Uploaded_variation"), F.when(F.col("c_nationkey") < 5, "-").otherwise(F.col("c_name")).alias("SYMBOL"),
        F.col("c_nationkey").alias("GERP++_RS"),
    )
    path = w.scratch_path(spark, "preambled")
    w.write_plain_tsv(lines, path)
    return path


def _read_preambled(layout):
    def query(spark, sf):
        types = {"X_Uploaded_variation": "bigint", "SYMBOL": "string", "GERP___RS": "int"}
        return r.read_preambled(
            spark, _preambled(spark, sf), null_token="-", types=types, glob="*.csv", layout=layout
        )
    return query


for _layout, _name in (("shared", "preambled_text"), ("per_file", "preambled_text_per_file")):
    QUERIES[_name] = _read_preambled(_layout)
    SQL[_name] = """
SELECT c_custkey AS "X_Uploaded_variation", CASE WHEN c_nationkey >= 5 THEN c_name END AS "SYMBOL",
  c_nationkey AS "GERP___RS" FROM customer WHERE c_mktsegment <> 'MACHINERY'"""


def id_list_roundtrip(spark, sf):
    listed = table(spark, sf, "orders").select("o_custkey").distinct()
    path = w.scratch_path(spark, "ids")
    w.write_id_list(listed, "o_custkey", path)
    return r.read_delimited(spark, path, columns=["id"], types={"id": "bigint"}, glob="*.csv")


QUERIES["id_list_roundtrip"] = id_list_roundtrip
SQL["id_list_roundtrip"] = "SELECT DISTINCT o_custkey AS id FROM orders"


def tagged_union(spark, sf):
    """Two named files, each row tagged with the name."""
    suppliers = table(spark, sf, "supplier")
    paths = {}
    for tag, kept in (("debt", F.col("s_acctbal") < 0), ("credit", F.col("s_acctbal") >= 0)):
        paths[tag] = w.scratch_path(spark, tag)
        w.write_tsv(suppliers.filter(kept).select("s_suppkey", "s_name"), paths[tag])
    return r.read_tagged(spark, paths, types={"s_suppkey": "bigint", "s_name": "string"}, glob="*.csv")


QUERIES["tagged_union"] = tagged_union
SQL["tagged_union"] = """
SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS sample FROM supplier"""


# -- matrix files and sheets behind a preamble

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"]


def wide_file_roundtrip(spark, sf):
    """Nations as rows and segments as columns of a text file, read back long."""
    customers = table(spark, sf, "customer")
    wide = customers.groupBy("c_nationkey").pivot("c_mktsegment", _SEGMENTS).agg(F.count(F.lit(1)))
    path = w.scratch_path(spark, "wide")
    w.write_tsv(wide, path)
    cells = read_wide(spark, path, ["c_nationkey"], "segment", "n", kind="bigint")
    return cells.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


QUERIES["wide_file_roundtrip"] = wide_file_roundtrip
SQL["wide_file_roundtrip"] = f"""
SELECT c_nationkey, segment, nullif(count(*) FILTER (c_mktsegment = segment), 0) AS n
FROM customer CROSS JOIN (SELECT unnest({_SEGMENTS}) AS segment) GROUP BY ALL"""


def clinical_sheet(spark, sf):
    """Customers as patients; those of one segment become metadata lines."""
    key = F.concat(F.when(F.col("c_mktsegment") == "MACHINERY", "#meta").otherwise("P"), F.col("c_custkey"))
    lines = table(spark, sf, "customer").select(
        key.alias("PATIENT_ID"), F.col("c_mktsegment").alias("PRIMARY_SITE_PATIENT")
    )
    path = w.scratch_path(spark, "clinical")
    w.write_plain_tsv(lines, path)
    return read_clinical(spark, path, glob="*.csv").select("sample", "site")


QUERIES["clinical_sheet"] = clinical_sheet
SQL["clinical_sheet"] = """
SELECT 'P' || c_custkey AS sample, c_mktsegment AS site FROM customer WHERE c_mktsegment <> 'MACHINERY'"""


# -- types found by reading, headers by file, matrices of any width

def detected_types(spark, sf):
    """Lines of orders in one directory per status, written without types. A code is
    a number everywhere but in a few finished lines, and so is text in all files."""
    late = (F.col("l_linestatus") == "F") & (F.col("l_orderkey") % 1000 == 7)
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.nullif("l_linenumber", F.lit(2)).alias("line"), F.col("l_discount").alias("rate"),
        F.when(F.col("l_quantity") > 25, "TRUE").otherwise("false").alias("large"),
        F.when(late, F.concat(F.lit("late, "), "l_partkey")).otherwise(F.col("l_partkey").cast("string")).alias("code"),
        (F.col("l_partkey") * 10_000_000_000).alias("big"), F.lit(None).cast("string").alias("nothing"), "l_linestatus",
    )
    path = w.scratch_path(spark, "untyped")
    w.write_tsv(lines, path, by="l_linestatus")
    found = r.read_detected(spark, path, glob="*.csv", sample_pattern="l_linestatus=([^/]+)/", sample_col="status")
    kinds = F.concat_ws(",", *[F.typeof(c) for c in ("line", "rate", "large", "code", "big", "nothing")])
    return found.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), "line", "rate", "large", "code", "big",
                        "nothing", "status", kinds.alias("kinds"))


QUERIES["detected_types"] = detected_types
SQL["detected_types"] = """
SELECT l_orderkey, nullif(l_linenumber, 2) AS line, l_discount AS rate, l_quantity > 25 AS large,
  CASE WHEN l_linestatus = 'F' AND l_orderkey % 1000 = 7 THEN 'late, ' ELSE '' END || l_partkey AS code,
  l_partkey * 10000000000 AS big, CAST(NULL AS VARCHAR) AS nothing, l_linestatus AS status,
  'int,double,boolean,string,bigint,string' AS kinds FROM lineitem"""


def files_by_header(spark, sf):
    """Each market segment in files of its own header: other columns, another order."""
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('a "name", '), "c_name").alias("c name"), "c_nationkey", "c_acctbal", "c_mktsegment")
    layouts = {
        "BUILDING": ["c_custkey", "c name", "c_acctbal"], "MACHINERY": ["c_acctbal", "c_nationkey", "c_custkey"],
        "FURNITURE": ["c name", "c_custkey"],
    }
    paths = {}
    for segment, columns in layouts.items():
        paths[segment] = w.scratch_path(spark, "headers")
        of_segment = customers.filter(F.col("c_mktsegment") == segment).select(*columns)
        of_segment.write.option("header", "true").option("escape", '"').option("nullValue", "NA").csv(paths[segment])
    types = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"}
    return r.read_tagged(spark, paths, types, tag_col="segment", sep=",", glob="*.csv")


QUERIES["files_by_header"] = files_by_header
SQL["files_by_header"] = """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'a "name", ' || c_name END AS c_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey END AS c_nationkey,
  CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal END AS c_acctbal, c_mktsegment AS segment
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"""


def skipped_lines(spark, sf):
    """Sheets of the nations' customers below four lines that nothing marks."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(text).alias("value")) for i, text in enumerate(
            ["Patient\tSite", "identifier\tof the tumour", "STRING\tSTRING", "1\t1", "PATIENT_ID\tPRIMARY_SITE_PATIENT"])
    ])).alias("line")).select("n_nationkey", "line.*")
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.lit(5).alias("place"),
        F.concat_ws("\t", F.concat(F.lit("#"), "c_custkey"), "c_mktsegment").alias("value"))
    lines = nations.unionByName(customers).repartition("n_nationkey").sortWithinPartitions("n_nationkey", "place")
    path = w.scratch_path(spark, "sheets")
    lines.select("n_nationkey", "value").write.partitionBy("n_nationkey").text(path)
    return read_clinical(spark, path, skip=4, glob="*.txt", sample_pattern="n_nationkey=([0-9]+)/", sample_col="nation") \
        .withColumn("nation", F.col("nation").cast("int"))


QUERIES["skipped_lines"] = skipped_lines
SQL["skipped_lines"] = "SELECT '#' || c_custkey AS sample, c_mktsegment AS site, c_nationkey AS nation FROM customer"


def wide_file_by_supplier(spark, sf):
    """A matrix with a column for every supplier, a file for each line number."""
    counted = w.staged(table(spark, sf, "lineitem").groupBy("l_linenumber", F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n")), "counted")
    files = F.broadcast(counted.select("l_linenumber").distinct())  # each becomes a file
    grid = table(spark, sf, "supplier").select("s_suppkey").dropna().crossJoin(files)
    cell = F.struct(F.concat(F.lit("S-"), "s_suppkey").alias("supplier"), F.coalesce(F.col("n").cast("string"), F.lit("NA")).alias("n"))
    rows = grid.join(counted, ["l_linenumber", "s_suppkey"], "left").groupBy("l_linenumber").agg(
        F.sort_array(F.collect_list(cell)).alias("cells"))
    text = F.concat_ws("\n", F.concat_ws("\t", F.lit("line"), F.lit("note"), "cells.supplier"), F.concat_ws(
        "\t", F.coalesce(F.col("l_linenumber").cast("string"), F.lit("NA")), F.lit("x"), "cells.n"))
    path = w.scratch_path(spark, "suppliers")
    rows.select("l_linenumber", text.alias("value")).write.partitionBy("l_linenumber").text(path)
    found = read_wide(spark, path, ["line"], "supplier", "n", drop=("note",), kind="bigint")
    return found.withColumn("line", F.col("line").cast("int"))


QUERIES["wide_file_by_supplier"] = wide_file_by_supplier
SQL["wide_file_by_supplier"] = """
SELECT l.line, 'S-' || s_suppkey AS supplier, n FROM (SELECT DISTINCT l_linenumber AS line FROM lineitem) l CROSS JOIN supplier
LEFT JOIN (SELECT l_linenumber AS line, l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) c USING (line, s_suppkey)"""
