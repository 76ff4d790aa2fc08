"""Copy-number queries on lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.functions.nulls import to_number
from somaframe.operators.groups import min_rows, min_text_rows
from somaframe.operators.ranks import spearman_pairs
from somaframe.plans import copynumber as cn

from . import fixed
from .common import sample_gene, table

QUERIES, SQL = {}, {}


def _quantity_text():
    return F.col("l_quantity").cast("int").cast("string")


# -- minimum per group, ties kept; quantity 50 plays the missing copy number

def min_cn_with_ties(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", F.nullif("l_quantity", F.lit(50.0)).alias("cn"), "l_extendedprice"
    )
    return min_rows(li, ["l_suppkey", "l_partkey"], "cn").distinct()


QUERIES["min_cn_with_ties"] = min_cn_with_ties
SQL["min_cn_with_ties"] = """
SELECT l_suppkey, l_partkey, cn, l_extendedprice FROM (
  SELECT *, rank() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY cn NULLS LAST) AS r FROM (
    SELECT DISTINCT l_suppkey, l_partkey, nullif(l_quantity, 50.0) AS cn, l_extendedprice FROM lineitem))
WHERE r = 1"""


def _min_text(numeric):
    def query(spark, sf):
        li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", _quantity_text().alias("cn"))
        lowest = min_text_rows(li, ["l_suppkey", "l_partkey"], "cn", numeric)
        return lowest.withColumn("cn", to_number("cn"))
    return query


QUERIES["min_cn_text"] = _min_text(False)
QUERIES["min_cn_text_as_number"] = _min_text(True)
for _name, _order in (("min_cn_text", "cn"), ("min_cn_text_as_number", "CAST(cn AS DOUBLE)")):
    SQL[_name] = f"""
SELECT l_suppkey, l_partkey, CAST(cn AS DOUBLE) AS cn FROM (
  SELECT *, rank() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY {_order}) AS r FROM (
    SELECT l_suppkey, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS cn FROM lineitem))
WHERE r = 1"""


# -- gene tables of both callers, their merge and consensus

def _segments(spark, sf):
    li = table(spark, sf, "lineitem")
    tokens = F.concat(
        F.lit("ref|G"), F.col("l_partkey") % 50, F.lit(",ref|NM_"), F.col("l_partkey"), F.lit(","),
        F.col("l_returnflag"), F.lit(",ref|H"), F.col("l_linenumber"),
    )
    return li.select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("sample"),
        F.col("l_linestatus").alias("chromosome"),
        F.col("l_partkey").alias("start"),
        F.when(F.col("l_quantity") < 3, None).otherwise(tokens).alias("gene"),
        (F.col("l_quantity") % 7).cast("int").alias("cn"),
        F.col("l_discount").alias("log2"), F.col("l_tax").alias("depth"),
        F.col("l_discount").alias("p_ttest"), F.col("l_quantity").alias("weight"),
    )


_SQL_SEGMENTS = """
seg AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS file, 'S' || l_suppkey AS sample, l_linestatus AS chromosome,
         l_partkey AS start_pos, unnest(CASE WHEN l_quantity < 3 THEN [NULL] ELSE
           ['G' || (l_partkey % 50), 'H' || l_linenumber] END) AS gene,
         CAST(l_quantity % 7 AS INTEGER) AS cn, l_discount AS log2, l_tax AS depth,
         l_discount AS p_ttest, l_quantity AS weight FROM lineitem),
genes_a AS (
  SELECT sample, chromosome, gene, cn, log2, depth, p_ttest, weight FROM (
    SELECT *, rank() OVER (PARTITION BY file, chromosome, gene ORDER BY cn) AS r FROM seg) WHERE r = 1)"""


def gene_cn_segments(spark, sf):
    return cn.gene_cn_from_segments(_segments(spark, sf))


QUERIES["gene_cn_segments"] = gene_cn_segments
SQL["gene_cn_segments"] = f"WITH {_SQL_SEGMENTS} SELECT * FROM genes_a"


def _intervals(spark, sf):
    li = table(spark, sf, "lineitem")
    record = F.concat_ws(
        "|", _quantity_text(), F.lit("gain"), F.col("l_returnflag"),
        F.when(F.col("l_linenumber") == 7, "NA").otherwise(F.col("l_linenumber").cast("string")),
        F.col("l_suppkey").cast("string"),
    )
    attributes = F.concat(
        F.lit('gene_id="x"; gene_name="G'), F.col("l_partkey") % 50, F.lit('"; gene_name="H'),
        F.col("l_linenumber"), F.lit('";'),
    )
    return li.select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("sample"),
        F.col("l_linestatus").alias("chromosome"), F.col("l_partkey").alias("start"),
        record.alias("other"), attributes.alias("gene"),
    )


_SQL_INTERVALS = """
iv AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS file, 'S' || l_suppkey AS sample, l_linestatus AS chromosome,
         l_partkey AS start_pos, l_quantity AS cn, l_returnflag AS genotype,
         CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber AS DOUBLE) END AS uncertainty,
         CAST(l_suppkey AS DOUBLE) AS wilcoxon_p, CAST(NULL AS DOUBLE) AS ks_p,
         unnest(['G' || (l_partkey % 50), 'H' || l_linenumber]) AS gene FROM lineitem),
genes_b AS (
  SELECT sample, chromosome, gene, cn, wilcoxon_p, ks_p, uncertainty FROM (
    SELECT *, rank() OVER (PARTITION BY file, chromosome, gene ORDER BY cn) AS r FROM iv) WHERE r = 1)"""


def gene_cn_intervals(spark, sf):
    return cn.gene_cn_from_intervals(_intervals(spark, sf))


QUERIES["gene_cn_intervals"] = gene_cn_intervals
SQL["gene_cn_intervals"] = f"WITH {_SQL_INTERVALS} SELECT * FROM genes_b"


def _merged(spark, sf):
    li = table(spark, sf, "lineitem")

    def caller(kept):
        kept = li.filter(kept)
        keyed = kept.select(F.col("l_suppkey").alias("sample"), F.nullif(F.col("l_partkey"), F.lit(1)).alias("gene"),
                            F.col("l_quantity"), F.col("l_discount"))
        return keyed.groupBy("sample", "gene").agg(
            F.min("l_quantity").alias("cn"), F.max("l_discount").alias("log2")
        )

    return cn.merge_cn_callers(caller("l_returnflag = 'A'"), caller("l_returnflag <> 'A'"), ["sample", "gene"])


_SQL_MERGED = """
a AS (SELECT l_suppkey AS sample, nullif(l_partkey, 1) AS gene, min(l_quantity) AS cn, max(l_discount) AS log2
      FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
b AS (SELECT l_suppkey AS sample, nullif(l_partkey, 1) AS gene, min(l_quantity) AS cn, max(l_discount) AS log2
      FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
merged AS (
  SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.gene, b.gene) AS gene,
         coalesce(CASE WHEN a.cn >= 10 THEN 10 ELSE a.cn END, 2) AS cn_a, a.log2 AS log2_a,
         coalesce(CASE WHEN b.cn >= 20 THEN 20 ELSE b.cn END, 2) AS cn_b, b.log2 AS log2_b
  FROM a FULL JOIN b ON a.sample IS NOT DISTINCT FROM b.sample AND a.gene IS NOT DISTINCT FROM b.gene)"""

QUERIES["merge_two_callers"] = _merged
SQL["merge_two_callers"] = f"WITH {_SQL_MERGED} SELECT * FROM merged"

_SQL_CONSENSUS = """(cn_a + cn_b) / 2 AS cn_mean,
  CASE WHEN abs(cn_a - 2) < abs(cn_b - 2) THEN cn_a WHEN abs(cn_a - 2) > abs(cn_b - 2) THEN cn_b
       ELSE (cn_a + cn_b) / 2 END AS cn_min_dev"""

QUERIES["consensus_cn"] = lambda spark, sf: cn.consensus(_merged(spark, sf))
SQL["consensus_cn"] = f"WITH {_SQL_MERGED} SELECT *, {_SQL_CONSENSUS} FROM merged"


# -- reference panel and comparison

_TRIPLOID = ["3", "7", "11"]
_REFERENCE_GENES = [f"{f}{s}" for f in "ANR" for s in "FO"]


def reference_cn(spark, sf):
    li = table(spark, sf, "lineitem")
    wide = (
        li.withColumn("flags", F.concat("l_returnflag", "l_linestatus"))
        .groupBy(F.col("l_suppkey").cast("string").alias("cell_line_display_name"))
        .pivot("flags", _REFERENCE_GENES)
        .agg(F.min(F.nullif("l_quantity", F.lit(1.0))))
    )
    return cn.reference_cn(wide, drop=(), triploid=_TRIPLOID)


_SQL_ABSOLUTE = """CASE WHEN {0} = 0 THEN 'Deep Deletion' WHEN {0} = 1 THEN 'Shallow Deletion'
  WHEN {0} >= 5 THEN 'Amplification' WHEN {0} >= {1} THEN 'Gain' WHEN {0} IS NOT NULL THEN 'Normal' END"""
_SQL_THREE = "CASE WHEN {0} IN ('Shallow Deletion', 'Gain') THEN 'Normal' ELSE {0} END"

_SQL_CLASSED = f"""
scaled AS (SELECT *, CASE WHEN sample IN ('3', '7', '11') THEN
    CASE WHEN cn IS NOT NULL THEN greatest(cn - 1, 0) END ELSE cn END AS cn_as_diploid FROM panel),
classed AS (SELECT *, {_SQL_ABSOLUTE.format('cn', 4)} AS cn_class,
    {_SQL_ABSOLUTE.format('cn_as_diploid', 3)} AS cn_as_diploid_class FROM scaled),
reference AS (SELECT *, {_SQL_THREE.format('cn_class')} AS cn_class3,
    {_SQL_THREE.format('cn_as_diploid_class')} AS cn_as_diploid_class3 FROM classed)"""

QUERIES["reference_cn"] = reference_cn
SQL["reference_cn"] = f"""
WITH panel AS (
  SELECT g.gene, CAST(s.l_suppkey AS VARCHAR) AS sample, min(nullif(l.l_quantity, 1)) AS cn
  FROM (SELECT DISTINCT l_suppkey FROM lineitem) s
  CROSS JOIN (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS gene) g
  LEFT JOIN lineitem l ON l.l_suppkey = s.l_suppkey AND l.l_returnflag || l.l_linestatus = g.gene
  GROUP BY ALL), {_SQL_CLASSED}
SELECT * FROM reference"""


def _compared(spark, sf):
    li = table(spark, sf, "lineitem")
    panel = li.groupBy(
        F.col("l_partkey").alias("gene"), F.col("l_suppkey").cast("string").alias("sample")
    ).agg(F.max(F.col("l_quantity") % 7).alias("cn"))
    merged = _merged(spark, sf).withColumn("sample", F.col("sample").cast("string"))
    return cn.compare_cn(cn.scale_reference(panel, _TRIPLOID), merged, null_safe=False)  # no key of the panel is NULL


_SQL_COMPARED = f"""{_SQL_MERGED},
panel AS (SELECT l_partkey AS gene, CAST(l_suppkey AS VARCHAR) AS sample, max(l_quantity % 7) AS cn
          FROM lineitem GROUP BY ALL), {_SQL_CLASSED},
compared AS (
  SELECT r.*, m.cn_a, m.log2_a, m.cn_b, m.log2_b, {_SQL_CONSENSUS.replace('cn_a', 'm.cn_a').replace('cn_b', 'm.cn_b')}
  FROM reference r JOIN merged m
    ON r.gene IS NOT DISTINCT FROM m.gene AND r.sample = CAST(m.sample AS VARCHAR))"""

QUERIES["compare_cn"] = _compared
SQL["compare_cn"] = f"WITH {_SQL_COMPARED} SELECT * FROM compared"


def _sql_spearman(source: str, pairs) -> str:
    """Average ranks, then their correlation, one SELECT per pair."""
    parts = []
    for x, y in pairs:
        parts.append(f"""
SELECT '{x}' AS x_name, '{y}' AS y_name, count(*) AS n, round(corr(rx, ry), 6) AS rho,
  round((1 - corr(rx, ry)) / 6, 6) AS s_share FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT {x} AS x, {y} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL)""")
    return " UNION ALL ".join(parts)


def _rounded(tested):
    """rho and the statistic as a share of n^3 - n; p is left to the tests, as the
    SQL engine has no tail probability of t."""
    n = F.col("n").cast("double")
    return tested.select(
        "x_name", "y_name", "n", F.round("rho", 6).alias("rho"),
        F.round(F.col("s") / (n * n * n - n), 6).alias("s_share"),
    )


def cn_correlations(spark, sf):
    return _rounded(cn.cn_correlations(_compared(spark, sf)))


QUERIES["cn_correlations"] = cn_correlations
SQL["cn_correlations"] = f"WITH {_SQL_COMPARED} {_sql_spearman('compared', fixed.COMPARED_PAIRS)}"

_PAIRS = [
    ("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"),
    ("some_discount", "l_extendedprice"), ("l_partkey", "l_suppkey"),
]


def spearman(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("some_discount", F.nullif("l_discount", F.lit(0.0)))
    return _rounded(spearman_pairs(li, _PAIRS))


QUERIES["spearman_pairs"] = spearman
SQL["spearman_pairs"] = (
    "WITH li AS (SELECT *, nullif(l_discount, 0) AS some_discount FROM lineitem)" + _sql_spearman("li", _PAIRS)
)


# -- classifications

def _cn_rows(spark, sf):
    """Quantity modulo 7 as copy number, 6 playing the missing value."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.nullif(F.col("l_quantity") % 7, F.lit(6.0)).alias("cn"))


_SQL_CN_ROWS = "SELECT l_orderkey, l_linenumber, nullif(l_quantity % 7, 6) AS cn FROM lineitem"


def _classify(expression):
    return lambda spark, sf: _cn_rows(spark, sf).withColumn("class", expression())


QUERIES["classify_absolute"] = _classify(lambda: k.absolute_cn_class("cn"))
SQL["classify_absolute"] = f"SELECT *, {_SQL_ABSOLUTE.format('cn', 4)} AS class FROM ({_SQL_CN_ROWS})"
QUERIES["classify_scaled"] = _classify(lambda: k.scaled_cn_class("cn"))
SQL["classify_scaled"] = f"SELECT *, {_SQL_ABSOLUTE.format('cn', 3)} AS class FROM ({_SQL_CN_ROWS})"
QUERIES["classify_three"] = _classify(lambda: k.three_cn_class(k.absolute_cn_class("cn")))
SQL["classify_three"] = f"""
SELECT l_orderkey, l_linenumber, cn, {_SQL_THREE.format('c')} AS class
FROM (SELECT *, {_SQL_ABSOLUTE.format('cn', 4)} AS c FROM ({_SQL_CN_ROWS}))"""

QUERIES["classify_caller"] = lambda spark, sf: cn.classify_cn(_cn_rows(spark, sf), "cn")
SQL["classify_caller"] = f"""
SELECT *, CASE WHEN cn >= 5 THEN 'Amplification' WHEN cn >= 3 THEN 'Gain' WHEN cn = 2 THEN 'Normal'
  WHEN cn = 1 THEN 'Shallow Deletion' WHEN cn = 0 THEN 'Deep Deletion' END AS status FROM ({_SQL_CN_ROWS})"""


def _log2_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.log2(F.col("l_quantity") / 25).alias("log2"),
        F.nullif("l_discount", F.lit(0.1)).alias("p_ttest"),
    )


_SQL_LOG2_ROWS = """
SELECT l_orderkey, l_linenumber, ln(l_quantity / 25) / ln(2) AS log2, nullif(l_discount, 0.1) AS p_ttest FROM lineitem"""


def classify_log2(spark, sf):
    called = cn.classify_log2(_log2_rows(spark, sf))
    return called.withColumn("log2", F.round("log2", 6))


QUERIES["classify_log2"] = classify_log2
SQL["classify_log2"] = f"""
SELECT l_orderkey, l_linenumber, round(log2, 6) AS log2, p_ttest,
  CASE WHEN log2 < -0.5 AND p_ttest < 0.05 THEN 'Loss' WHEN log2 > 0.5 AND p_ttest < 0.05 THEN 'Gain'
       ELSE 'Normal' END AS status FROM ({_SQL_LOG2_ROWS})"""


def volcano_table(spark, sf):
    scored = cn.volcano_table(_log2_rows(spark, sf))
    return scored.select(
        "l_orderkey", "l_linenumber", F.round("neglog_p", 6).alias("neglog_p"),
        F.round("trimmed_log2", 6).alias("trimmed_log2"),
    )


QUERIES["volcano_table"] = volcano_table
SQL["volcano_table"] = f"""
WITH v AS ({_SQL_LOG2_ROWS}), e AS (SELECT min(p_ttest) AS eps FROM v WHERE p_ttest <> 0)
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN p_ttest > 0.05 THEN NULL ELSE -log10(p_ttest + eps) END, 6) AS neglog_p,
  round(CASE WHEN log2 < -4 THEN -4 ELSE log2 END, 6) AS trimmed_log2 FROM v, e"""


def median_cn(spark, sf):
    li = table(spark, sf, "lineitem")
    return cn.gene_medians(sample_gene(li, F.col("l_quantity").alias("cn")))


QUERIES["median_cn"] = median_cn
SQL["median_cn"] = """
SELECT CAST(l_partkey % 50 AS VARCHAR) AS gene, median(l_quantity) AS median_cn FROM lineitem GROUP BY 1"""
