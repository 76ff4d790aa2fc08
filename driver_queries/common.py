"""Bindings of the library's roles to the given tables.

Sample = supplier, gene = one of fifty groups of parts, mutation class = line
number, copy number = quantity. All rows of a table take part in every query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PANEL = [str(i) for i in range(50)]

# Class of each line number; the last one is outside the priority list.
LINE_CLASSES = {
    1: "Nonsense", 2: "Frameshift", 3: "Start Loss", 4: "Stop Loss",
    5: "Inframe InDel", 6: "Missense", 7: "Silent",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_gene(li: DataFrame, *more) -> DataFrame:
    return li.select(
        F.col("l_suppkey").cast("string").alias("sample"),
        (F.col("l_partkey") % 50).cast("string").alias("gene"),
        *more,
    )


def line_class():
    return F.get(F.array(*[F.lit(LINE_CLASSES[i]) for i in range(1, 8)]), F.col("l_linenumber") - 1)


def _mutated():
    return (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 47)


def snv_calls(li: DataFrame) -> DataFrame:
    """Mutations: delivered lines of large quantity. All others are copy numbers."""
    return sample_gene(li.filter(_mutated()), line_class().alias("snv"))


def cn_calls(li: DataFrame) -> DataFrame:
    """Copy-number status of all lines that are no mutations, mostly Normal."""
    is_open = F.col("l_linestatus") == "O"
    gain = is_open & (F.col("l_discount") >= 0.1)
    loss = is_open & (F.col("l_tax") == 0) & (F.col("l_quantity") <= 5)
    status = F.when(gain, "Amplification").when(loss, "Deep Deletion").otherwise("Normal")
    return sample_gene(li.filter(~_mutated()), status.alias("cna"))


SQL_LINE_CLASS = (
    "CASE l_linenumber "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in LINE_CLASSES.items())
    + " END"
)

SQL_MUTATED = "(l_linestatus = 'F' AND l_quantity >= 47)"

SQL_CALLS = f"""
snv AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
         {SQL_LINE_CLASS} AS snv
  FROM lineitem WHERE {SQL_MUTATED}),
cn AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
         CASE WHEN l_linestatus <> 'O' THEN 'Normal' WHEN l_discount >= 0.1 THEN 'Amplification'
              WHEN l_tax = 0 AND l_quantity <= 5 THEN 'Deep Deletion' ELSE 'Normal' END AS cna
  FROM lineitem WHERE NOT {SQL_MUTATED})"""


def sql_ordinal(column: str, levels: list[str]) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels))
    return f"CASE {column} {whens} END"


def sql_level(column: str, levels: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(levels))
    return f"CASE {column} {whens} END"


def sql_recode(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {column} END"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
