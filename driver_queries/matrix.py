"""Alteration-matrix queries on lineitem, customer, orders and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.functions.nulls import drop_nulls
from somaframe.operators import groups as g
from somaframe.operators import reshape as rs
from somaframe.operators.joins import anti_join, full_join, semi_join
from somaframe.operators.ordering import gene_order, layer_columns, order_by_list, order_samples
from somaframe.plans import matrix as m
from somaframe.plans import tracks as t

from . import fixed
from .common import (
    LINE_CLASSES, PANEL, SQL_CALLS, SQL_LINE_CLASS, SQL_MUTATED, cn_calls, line_class, sample_gene, snv_calls, sql_level,
    sql_list, sql_ordinal, sql_recode, table,
)

QUERIES, SQL = {}, {}

_COMPLEX = PANEL[:10]


# -- priority pick and its check

def top_priority_class(spark, sf):
    li = table(spark, sf, "lineitem")
    return m.top_priority_mutation(sample_gene(li, line_class().alias("snv")))


QUERIES["top_priority_class"] = top_priority_class
SQL["top_priority_class"] = f"""
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
  CASE l_linenumber {' '.join(f"WHEN {i} THEN '{c}'" for i, c in LINE_CLASSES.items())} END AS snv FROM lineitem),
b AS (SELECT sample, gene, min({sql_ordinal('snv', fixed.SNV_PRIORITY)}) AS best FROM c GROUP BY ALL)
SELECT sample, gene, {sql_level('best', fixed.SNV_PRIORITY)} AS snv FROM b"""


def class_lists(spark, sf):
    classes = sample_gene(table(spark, sf, "lineitem"), line_class().alias("snv"))
    return g.class_lists(classes, ["sample", "gene"], "snv", k.SNV_PRIORITY).withColumn(
        "classes", F.array_join("classes", ",")
    )


QUERIES["class_lists"] = class_lists
SQL["class_lists"] = f"""
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
  {SQL_LINE_CLASS} AS snv FROM lineitem),
b AS (SELECT sample, gene, string_agg(DISTINCT snv, ',' ORDER BY snv) AS classes, count(*) AS n,
  min({sql_ordinal('snv', fixed.SNV_PRIORITY)}) AS best FROM c GROUP BY ALL)
SELECT sample, gene, classes, n, {sql_level('best', fixed.SNV_PRIORITY)} AS best FROM b"""


# -- sample sets

def _complete(spark, sf):
    li = table(spark, sf, "lineitem")
    delivered = li.filter(F.col("l_linestatus") == "F")
    return m.complete_samples(sample_gene(delivered), cn_calls(li))


_SQL_COMPLETE = f"""
complete AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS sample FROM lineitem WHERE l_linestatus = 'F'
  INTERSECT SELECT DISTINCT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE NOT {SQL_MUTATED})"""

QUERIES["complete_samples"] = _complete
SQL["complete_samples"] = f"WITH {_SQL_COMPLETE} SELECT * FROM complete"


def sample_universe(spark, sf):
    """Dense matrix over all suppliers with copy numbers; those without a mutation
    are complete, as all suppliers were examined."""
    li = table(spark, sf, "lineitem")
    examined = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sample"))
    complete = m.complete_samples(snv_calls(li), cn_calls(li), sample_universe=examined)
    return m.alteration_matrix(m.alteration_events(cn_calls(li), snv_calls(li), PANEL), PANEL, complete, restrict_to_complete=True)


QUERIES["sample_universe"] = sample_universe


def semi_complete(spark, sf):
    """Customers against shifted keys of the orders, so that some have no partner."""
    orders = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    customers = table(spark, sf, "customer")
    return semi_join(customers.select("c_custkey", "c_name", "c_mktsegment"), orders, ["c_custkey"])


QUERIES["semi_complete"] = semi_complete
SQL["semi_complete"] = """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)"""


def anti_excluded(spark, sf):
    """Customers not on the list of those with a delivered urgent order; the list
    holds a missing id as well."""
    listed = table(spark, sf, "orders").filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    ).select(F.nullif("o_custkey", F.lit(1)).alias("c_custkey"))
    return anti_join(table(spark, sf, "customer").select("c_custkey", "c_name"), listed, ["c_custkey"])


QUERIES["anti_excluded"] = anti_excluded
SQL["anti_excluded"] = """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND nullif(o_custkey, 1) = c_custkey)"""


def distinct_ids(spark, sf):
    li = table(spark, sf, "lineitem")
    counted = [
        g.distinct_ids(df, c).select(F.lit(f"{name}").alias("ids"), "n_ids")
        for name, df, c in (
            ("suppliers", li, "l_suppkey"),
            ("parts", li, "l_partkey"),
            ("discounts, one missing", li.select(F.nullif("l_discount", F.lit(0.0)).alias("d")), "d"),
            ("customers", table(spark, sf, "orders"), "o_custkey"),
        )
    ]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


QUERIES["distinct_ids"] = distinct_ids
SQL["distinct_ids"] = """
SELECT 'suppliers' AS ids, count(*) AS n_ids FROM (SELECT DISTINCT l_suppkey FROM lineitem)
UNION ALL SELECT 'parts', count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)
UNION ALL SELECT 'discounts, one missing', count(*) FROM (SELECT DISTINCT nullif(l_discount, 0) FROM lineitem)
UNION ALL SELECT 'customers', count(*) FROM (SELECT DISTINCT o_custkey FROM orders)"""


# -- viral status per user of the events table

def _viral(spark, sf):
    def load(kind):
        return F.max(F.when(F.col("event_type") == kind, F.col("value")))

    measured = table(spark, sf, "events").groupBy("user_id").agg(
        load("click").alias("HPV"), load("error").alias("EBV"), load("purchase").alias("HBV"),
        F.count_if(F.col("event_type") == "signup").alias("signups"),
    )
    return measured.select(
        F.when(F.col("signups") % 3 == 0, "OTHER").otherwise("HNSC").alias("Study"),
        F.concat(F.lit("P-"), F.col("user_id"), F.lit("A")).alias("SampleBarcode"), "HPV", "EBV", "HBV",
    )


_CUTOFFS = {"HPV": 50.0, "EBV": 40.0, "HBV": 30.0}
_SQL_VIRAL = """
viral AS (SELECT CASE WHEN count(*) FILTER (event_type = 'signup') % 3 = 0 THEN 'OTHER' ELSE 'HNSC' END AS "Study",
  'P-' || user_id AS patient, max(value) FILTER (event_type = 'click') AS "HPV",
  max(value) FILTER (event_type = 'error') AS "EBV", max(value) FILTER (event_type = 'purchase') AS "HBV"
  FROM events GROUP BY user_id),
status AS (SELECT *, patient || 'A' AS "SampleBarcode",
  CASE WHEN "HPV" > 50 THEN 'Positive' WHEN "HPV" <= 50 THEN 'Negative' END AS "HPV_status",
  CASE WHEN "EBV" > 40 THEN 'Positive' WHEN "EBV" <= 40 THEN 'Negative' END AS "EBV_status",
  CASE WHEN "HBV" > 30 THEN 'Positive' WHEN "HBV" <= 30 THEN 'Negative' END AS "HBV_status"
  FROM viral WHERE "Study" = 'HNSC')"""

QUERIES["viral_status"] = lambda spark, sf: m.viral_status(_viral(spark, sf), cutoffs=_CUTOFFS)
SQL["viral_status"] = f"WITH {_SQL_VIRAL} SELECT * FROM status"


def patients_without_virus(spark, sf):
    users = table(spark, sf, "events").select(F.concat(F.lit("P-"), F.col("user_id")).alias("sample")).distinct()
    status = m.viral_status(_viral(spark, sf), cutoffs=_CUTOFFS)
    return m.without_patients(users, m.positive_patients(status))


QUERIES["patients_without_virus"] = patients_without_virus
SQL["patients_without_virus"] = f"""
WITH {_SQL_VIRAL} SELECT DISTINCT 'P-' || user_id AS sample FROM events
WHERE 'P-' || user_id NOT IN (SELECT patient FROM status WHERE "HPV_status" = 'Positive')"""


# -- events, dense matrix, frequencies, orders

def _events(spark, sf, **options):
    li = table(spark, sf, "lineitem")
    return m.alteration_events(cn_calls(li), snv_calls(li), PANEL, **options)


_SQL_EVENTS = f"""{SQL_CALLS},
s AS (SELECT sample, gene, min({sql_ordinal('snv', fixed.SNV_PRIORITY)}) AS best FROM snv GROUP BY ALL),
c AS (SELECT sample, gene, string_agg(DISTINCT cna, ';' ORDER BY cna) AS cna FROM cn WHERE cna <> 'Normal' GROUP BY ALL),
events_ AS (SELECT coalesce(c.gene, s.gene) AS gene, coalesce(c.sample, s.sample) AS sample,
  concat_ws(';', cna, {sql_level('best', fixed.SNV_PRIORITY)}) AS alterations
  FROM c FULL JOIN s ON c.gene = s.gene AND c.sample = s.sample)"""

QUERIES["alteration_events"] = lambda spark, sf: _events(spark, sf, complex_panel=_COMPLEX)
SQL["alteration_events"] = f"""
WITH {_SQL_EVENTS} SELECT *, CASE WHEN gene IN ({sql_list(_COMPLEX)}) THEN 'NuRD Complex'
  ELSE 'Recurrent mutations in OSCC' END AS "group" FROM events_"""


def _few_samples(spark, sf):
    """Nations in the role of the complete samples, so that events add some."""
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("sample")).distinct()


def dense_matrix(spark, sf):
    return m.alteration_matrix(_events(spark, sf), PANEL, _complete(spark, sf))


_SQL_MATRIX = f"""{_SQL_EVENTS}, {_SQL_COMPLETE},
genes AS (SELECT CAST(unnest(range(50)) AS VARCHAR) AS gene),
samples AS (SELECT sample FROM complete UNION SELECT sample FROM events_),
matrix AS (SELECT genes.gene, samples.sample, coalesce(alterations, '') AS alterations
  FROM genes CROSS JOIN samples LEFT JOIN events_ e ON e.gene = genes.gene AND e.sample = samples.sample)"""

QUERIES["dense_matrix"] = dense_matrix
SQL["dense_matrix"] = f"WITH {_SQL_MATRIX} SELECT * FROM matrix"


def cohort_matrix(spark, sf):
    """Restricted to complete samples that are not excluded; event-free genes left out."""
    li = table(spark, sf, "lineitem")
    excluded = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select(
        F.col("s_suppkey").cast("string").alias("patient")
    )
    kept = m.without_patients(_complete(spark, sf), excluded)
    events = m.alteration_events(cn_calls(li), snv_calls(li), PANEL, samples=kept)
    return m.alteration_matrix(events, PANEL + ["no such gene"], kept, all_genes=False)


QUERIES["cohort_matrix"] = cohort_matrix
SQL["cohort_matrix"] = f"""
WITH {_SQL_EVENTS}, {_SQL_COMPLETE},
kept AS (SELECT sample FROM complete WHERE sample NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)),
e AS (SELECT * FROM events_ WHERE sample IN (SELECT sample FROM kept)),
genes AS (SELECT DISTINCT gene FROM e)
SELECT genes.gene, kept.sample, coalesce(alterations, '') AS alterations
FROM genes CROSS JOIN kept LEFT JOIN e ON e.gene = genes.gene AND e.sample = kept.sample"""

QUERIES["altered_fraction"] = lambda spark, sf: m.alteration_frequency(dense_matrix(spark, sf))
QUERIES["altered_fraction_sparse"] = lambda spark, sf: m.frequency_from_events(
    _events(spark, sf), PANEL, _complete(spark, sf)
)
SQL["altered_fraction"] = SQL["altered_fraction_sparse"] = f"""
WITH {_SQL_MATRIX} SELECT gene, count(*) FILTER (alterations <> '') AS n_altered,
  count(*) FILTER (alterations = '') AS n_blank, count(*) AS n_samples,
  round(count(*) FILTER (alterations <> '') * 100 / count(*), 1) AS pct_altered FROM matrix GROUP BY gene"""

# events of all genes, a panel of half of them: samples without panel events do not count

_HALF = PANEL[:25]
QUERIES["altered_fraction_half_panel"] = lambda spark, sf: m.alteration_frequency(
    m.alteration_matrix(_events(spark, sf), _HALF, _few_samples(spark, sf))
)
QUERIES["altered_fraction_half_panel_sparse"] = lambda spark, sf: m.frequency_from_events(
    _events(spark, sf), _HALF, _few_samples(spark, sf)
)
SQL["altered_fraction_half_panel"] = SQL["altered_fraction_half_panel_sparse"] = f"""
WITH {_SQL_EVENTS}, genes AS (SELECT CAST(unnest(range(25)) AS VARCHAR) AS gene),
e AS (SELECT * FROM events_ WHERE gene IN (SELECT gene FROM genes)),
samples AS (SELECT CAST(s_nationkey AS VARCHAR) AS sample FROM supplier UNION SELECT sample FROM e),
matrix AS (SELECT genes.gene, samples.sample, coalesce(alterations, '') AS alterations
  FROM genes CROSS JOIN samples LEFT JOIN e ON e.gene = genes.gene AND e.sample = samples.sample)
SELECT gene, count(*) FILTER (alterations <> '') AS n_altered,
  count(*) FILTER (alterations = '') AS n_blank, count(*) AS n_samples,
  round(count(*) FILTER (alterations <> '') * 100 / count(*), 1) AS pct_altered FROM matrix GROUP BY gene"""

for _by in ("gene", "sample"):
    QUERIES[f"class_counts_by_{_by}"] = lambda spark, sf, by=_by: m.class_counts(dense_matrix(spark, sf), by)
    SQL[f"class_counts_by_{_by}"] = f"""
WITH {_SQL_MATRIX}, e AS (SELECT gene, sample, unnest(list_distinct(string_split(alterations, ';'))) AS class FROM matrix)
SELECT {_by}, class, count(*) AS n FROM e WHERE class <> '' GROUP BY ALL"""

QUERIES["gene_order"] = lambda spark, sf: gene_order(dense_matrix(spark, sf)).withColumn(
    "gene_rank", F.col("gene_rank").cast("bigint")
)
_SQL_GENE_ORDER = """
gene_order AS (SELECT gene, n_blank, row_number() OVER (ORDER BY n_blank, gene) AS gene_rank
  FROM (SELECT gene, count(*) FILTER (alterations = '') AS n_blank FROM matrix GROUP BY gene))"""
SQL["gene_order"] = f"WITH {_SQL_MATRIX}, {_SQL_GENE_ORDER} SELECT * FROM gene_order"


def _sql_first(layer, column="alterations"):
    """Place in the layer of a cell's first class that belongs to it."""
    first = f"list_filter(string_split({column}, ';'), lambda x: x IN ({sql_list(layer)}))[1]"
    return f"coalesce({sql_ordinal(first, layer)}, {len(layer)})"


def _sql_order(layers, matrix="matrix"):
    places = ", ".join(_sql_first(layer) for layer in layers)
    return f"""
cells AS (SELECT sample, gene_rank, [{places}] AS places FROM {matrix} JOIN gene_order USING (gene)),
keys AS (SELECT sample, flatten(list(places ORDER BY gene_rank)) AS layer_key FROM cells GROUP BY sample)
SELECT sample, row_number() OVER (ORDER BY layer_key, sample) AS position FROM keys"""


def _ordered(layers, **options):
    return lambda spark, sf: order_samples(dense_matrix(spark, sf), layers, **options).select("sample", "position")


_OTHER_LAYERS = [["Deep Deletion"], fixed.TWO_LAYERS[1][:4], ["Amplification"]]
QUERIES["order_samples"] = _ordered(k.TWO_LAYERS)
SQL["order_samples"] = f"WITH {_SQL_MATRIX}, {_SQL_GENE_ORDER}, {_sql_order(fixed.TWO_LAYERS)}"
QUERIES["order_samples_3"] = _ordered(_OTHER_LAYERS)
SQL["order_samples_3"] = f"WITH {_SQL_MATRIX}, {_SQL_GENE_ORDER}, {_sql_order(_OTHER_LAYERS)}"

QUERIES["order_samples_by_appearance"] = _ordered(k.TWO_LAYERS, levels="appearance")


def _sql_appearance():
    parts, places = [], []
    for i, layer in enumerate(fixed.TWO_LAYERS):
        first = f"list_filter(string_split(alterations, ';'), lambda x: x IN ({sql_list(layer)}))[1]"
        parts.append(f"""
f{i} AS (SELECT sample, gene, {first} AS c FROM matrix),
o{i} AS (SELECT c, row_number() OVER (ORDER BY s, g) - 1 AS place FROM (
  SELECT c, min((sample, gene))[1] AS s, min((sample, gene))[2] AS g FROM f{i} WHERE c IS NOT NULL GROUP BY c))""")
        places.append(f"coalesce(o{i}.place, {len(layer)})")
    joins = " ".join(
        f"JOIN f{i} ON f{i}.sample = m.sample AND f{i}.gene = m.gene LEFT JOIN o{i} ON o{i}.c = f{i}.c" for i in range(2)
    )
    return f"""{','.join(parts)},
cells AS (SELECT m.sample, gene_rank, [{', '.join(places)}] AS places
  FROM matrix m JOIN gene_order USING (gene) {joins}),
keys AS (SELECT sample, flatten(list(places ORDER BY gene_rank)) AS layer_key FROM cells GROUP BY sample)
SELECT sample, row_number() OVER (ORDER BY layer_key, sample) AS position FROM keys"""


SQL["order_samples_by_appearance"] = f"WITH {_SQL_MATRIX}, {_SQL_GENE_ORDER}, {_sql_appearance()}"

QUERIES["layer_columns"] = lambda spark, sf: layer_columns(dense_matrix(spark, sf), PANEL)


def _sql_layer_columns():
    columns = []
    for i, layer in enumerate(fixed.TWO_LAYERS, 1):
        first = f"list_filter(string_split(alterations, ';'), lambda x: x IN ({sql_list(layer)}))[1]"
        columns += [f"max({first}) FILTER (gene = '{g_}') AS layer{i}_{g_}" for g_ in PANEL]
    return f"WITH {_SQL_MATRIX} SELECT sample, {', '.join(columns)} FROM matrix GROUP BY sample"


SQL["layer_columns"] = _sql_layer_columns()



def genes_without_events(spark, sf):
    """Lines name genes of even numbers only."""
    named = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50 * 2).cast("string").alias("gene"))
    return m.genes_without_events(named, [*PANEL, "no such gene"])


QUERIES["genes_without_events"] = genes_without_events
SQL["genes_without_events"] = """
SELECT gene FROM (SELECT CAST(unnest(range(50)) AS VARCHAR) AS gene UNION ALL SELECT 'no such gene')
WHERE gene NOT IN (SELECT CAST(l_partkey % 50 * 2 AS VARCHAR) FROM lineitem)"""

QUERIES["matrix_without_amplification"] = lambda spark, sf: m.without_class(dense_matrix(spark, sf), "Amplification")
SQL["matrix_without_amplification"] = f"""
WITH {_SQL_MATRIX} SELECT gene, sample, regexp_replace(alterations, 'Amplification;?', '') AS alterations FROM matrix"""

# nations as samples: a stated list of columns that covers the whole table

_COLUMNS = [str(i) for i in range(25)] + ["no such sample"]


def _nation_lines(spark, sf):
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf, "lineitem").join(nations, "l_suppkey")
    return lines.drop("l_suppkey").withColumnRenamed("s_nationkey", "l_suppkey")


_SQL_NATION_EVENTS = (
    "nation_lines AS (SELECT * REPLACE (s_nationkey AS l_suppkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),"
    + _SQL_EVENTS.replace("FROM lineitem", "FROM nation_lines")
)


def wide_matrix(spark, sf):
    li = _nation_lines(spark, sf)
    events = m.alteration_events(cn_calls(li), snv_calls(li), PANEL)
    matrix = m.alteration_matrix(events, PANEL, m.complete_samples(sample_gene(li), cn_calls(li)))
    return m.wide_matrix(matrix, _COLUMNS)


QUERIES["wide_matrix"] = wide_matrix
SQL["wide_matrix"] = f"""
WITH {_SQL_NATION_EVENTS}, g AS (SELECT CAST(unnest(range(50)) AS VARCHAR) AS gene)
SELECT g.gene, {', '.join(f"coalesce(max(alterations) FILTER (sample = '{c}'), '') AS " + f'"{c}"' for c in _COLUMNS)}
FROM g LEFT JOIN events_ e ON e.gene = g.gene GROUP BY g.gene"""

for _shallow in (False, True):
    _key = "panel_matrix_without_shallow" if _shallow else "panel_matrix"
    _text = "regexp_replace(alterations, 'Shallow Deletion;?', '')" if _shallow else "alterations"

    def _panel_matrix(spark, sf, drop=_shallow):
        li = _nation_lines(spark, sf)
        events = m.alteration_events(cn_calls(li), snv_calls(li), PANEL).withColumn(
            "alterations", F.regexp_replace("alterations", "Deep Deletion", "Shallow Deletion")
        )
        return t.panel_matrix(events, [*PANEL, "no such gene"], _COLUMNS, drop_shallow=drop)

    QUERIES[_key] = _panel_matrix
    _cells = ", ".join(
        f"coalesce(max({_text}) FILTER (sample = '{c}'), '') AS " + f'"{c}"' for c in _COLUMNS
    )
    SQL[_key] = f"""
WITH {_SQL_NATION_EVENTS}, e AS (SELECT gene, sample, replace(alterations, 'Deep Deletion', 'Shallow Deletion') AS alterations FROM events_),
g AS (SELECT CAST(unnest(range(50)) AS VARCHAR) AS gene UNION ALL SELECT 'no such gene')
SELECT g.gene, {_cells} FROM g LEFT JOIN e ON e.gene = g.gene GROUP BY g.gene"""


# -- earlier event tables

def multi_hit(spark, sf):
    li = table(spark, sf, "lineitem")
    func = F.get(F.array(*[F.lit(x) for x in fixed.FUNC_TO_SNV]), F.col("l_linenumber") - 1)
    return t.multi_hit_classes(sample_gene(li, func.alias("func")))


QUERIES["multi_hit"] = multi_hit
SQL["multi_hit"] = f"""
WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
  CASE l_linenumber {' '.join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(fixed.FUNC_TO_SNV.values()))} END AS c FROM lineitem),
j AS (SELECT gene, sample, string_agg(c, ';' ORDER BY {sql_ordinal('c', list(dict.fromkeys(fixed.FUNC_TO_SNV.values())))}) AS snv
  FROM f GROUP BY ALL)
SELECT gene, sample, CASE WHEN contains(snv, ';') THEN snv || '_2' ELSE snv END AS snv FROM j"""


def class_runs(spark, sf):
    classes = sample_gene(table(spark, sf, "lineitem"), line_class().alias("snv"))
    return g.class_runs(classes, ["gene", "sample"], "snv", k.SNV_PRIORITY)


QUERIES["class_runs"] = class_runs
SQL["class_runs"] = f"""
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene,
  CASE l_linenumber {' '.join(f"WHEN {i} THEN '{c}'" for i, c in LINE_CLASSES.items())} END AS snv FROM lineitem)
SELECT gene, sample, snv, count(*) AS n, coalesce({sql_ordinal('snv', fixed.SNV_PRIORITY)}, 7) AS place FROM c GROUP BY ALL"""


def segment_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return t.filter_segments(sample_gene(
        li,
        F.col("l_quantity").alias("BF"), F.nullif("l_returnflag", F.lit("A")).alias("Conrad_hg19"),
        F.when(F.col("l_linestatus") == "F", "deletion").otherwise("duplication").alias("type"),
        (F.col("l_discount") * 20).alias("reads_ratio"), F.col("l_linenumber").alias("reads_observed"),
        F.nullif("l_quantity", F.lit(41.0)).alias("reads_expected"), (F.col("l_linenumber") - 4).alias("standardizedValue"),
    ))


QUERIES["segment_filter"] = segment_filter
SQL["segment_filter"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS sample, CAST(l_partkey % 50 AS VARCHAR) AS gene, l_quantity AS "BF",
  CAST(NULL AS VARCHAR) AS "Conrad_hg19", CASE WHEN l_linestatus = 'F' THEN 'deletion' ELSE 'duplication' END AS type,
  l_discount * 20 AS reads_ratio, l_linenumber AS reads_observed, nullif(l_quantity, 41) AS reads_expected,
  l_linenumber - 4 AS "standardizedValue",
  CASE WHEN l_linenumber < 2 AND nullif(l_quantity, 41) IS NULL THEN NULL
       WHEN l_linenumber < 2 AND l_quantity > 30 THEN 'Deep Deletion'
       WHEN l_linestatus = 'F' THEN 'Shallow Deletion' ELSE 'Amplification' END AS cna
FROM lineitem WHERE l_quantity > 20 AND l_returnflag = 'A'
  AND NOT (l_linestatus = 'F' AND l_discount * 20 >= 1) AND abs(l_linenumber - 4) >= 1"""

_CNA_CODES = ["", "amp_rec", "homdel_rec", "hetloss_rec", "Amplification", "Shallow Deletion"]
_SNV_CODES = ["", "splice_rec", "splice", *fixed.DRIVER_PRIORITY[:2], "Missense Mutation (putative passenger)", "fusion"]


def _tracks(spark, sf):
    """The largest line of each gene and sample as its portal entry."""
    li = table(spark, sf, "lineitem")
    cna = F.get(F.array(*[F.lit(x) for x in _CNA_CODES]), F.max((F.col("l_discount") * 50).cast("int")))
    snv = F.get(F.array(*[F.lit(x) for x in _SNV_CODES]), F.max(F.col("l_linenumber")) - 1)
    keyed = sample_gene(li, "l_discount", "l_linenumber").withColumnRenamed("gene", "track_name")
    cells = keyed.groupBy("track_name", "sample").agg(cna.alias("CNA"), snv.alias("MUTATIONS"))
    return rs.unpivot_values(cells, ["track_name", "sample"], "track_type", "value")


_SQL_TRACKS = f"""
tracks AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS track_name, CAST(l_suppkey AS VARCHAR) AS sample,
  CASE max(CAST(trunc(l_discount * 50) AS INTEGER)) {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CNA_CODES))} END AS c,
  CASE max(l_linenumber) {' '.join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(_SNV_CODES))} END AS m
  FROM lineitem GROUP BY ALL),
coded AS (SELECT track_name, sample, {sql_recode("nullif(c, '')", fixed.TRACK_TO_CN)} AS cna, nullif(m, '') AS m FROM tracks)"""


def tracks_to_events(spark, sf):
    sites = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2).cast("string").alias("sample"), F.col("s_nationkey").alias("site")
    )
    return t.unpivot_tracks(long=_tracks(spark, sf), sites=sites, complex_panel=_COMPLEX)


QUERIES["tracks_to_events"] = tracks_to_events
SQL["tracks_to_events"] = rf"""
WITH {_SQL_TRACKS}, e AS (SELECT track_name, sample, cna, {sql_recode('m', fixed.TRACK_TO_SNV)} AS snv FROM coded),
s AS (SELECT *, regexp_replace(regexp_replace(snv, '\s\(.*\)', ''), '\s?mutation\s?', '', 'i') AS snv_simple FROM e)
SELECT track_name, s.sample, cna, snv, snv_simple, concat_ws(';', cna, snv_simple) AS alterations,
  CASE WHEN track_name IN ({sql_list(_COMPLEX)}) THEN 'NuRD Complex' ELSE 'Recurrent mutations in OSCC' END AS "group",
  s_nationkey AS site
FROM s LEFT JOIN supplier ON s.sample = CAST(s_suppkey * 2 AS VARCHAR)"""


def driver_tracks(spark, sf):
    return t.driver_priority(t.unpivot_tracks(long=_tracks(spark, sf), ranked=True))


QUERIES["driver_tracks"] = driver_tracks
SQL["driver_tracks"] = rf"""
WITH {_SQL_TRACKS},
r AS (SELECT track_name, sample, cna, {sql_recode('m', fixed.TRACK_TO_SNV_RANKED)} AS snv FROM coded),
e AS (SELECT track_name, sample, cna, CASE WHEN snv IN ({sql_list(fixed.DRIVER_PRIORITY)}) THEN snv END AS snv FROM r)
SELECT *, regexp_replace(snv, '\s\(.*\)', '') AS snv_simple,
  concat_ws(';', cna, regexp_replace(snv, '\s\(.*\)', '')) AS alterations,
  {sql_ordinal('snv', fixed.DRIVER_PRIORITY)} AS priority FROM e"""


def merge_events(spark, sf):
    """Row-wise outer merge of distinct copy-number rows and best mutations."""
    li = table(spark, sf, "lineitem")
    changed = cn_calls(li).filter(F.col("cna") != "Normal").distinct()
    return t.merge_events(changed, m.top_priority_mutation(snv_calls(li)))


QUERIES["merge_events"] = merge_events
SQL["merge_events"] = f"""
WITH {SQL_CALLS},
s AS (SELECT sample, gene, min({sql_ordinal('snv', fixed.SNV_PRIORITY)}) AS best FROM snv GROUP BY ALL),
l AS (SELECT sample, gene, {sql_level('best', fixed.SNV_PRIORITY)} AS snv FROM s),
c AS (SELECT DISTINCT * FROM cn WHERE cna <> 'Normal')
SELECT coalesce(c.sample, l.sample) AS sample, coalesce(c.gene, l.gene) AS gene, cna, snv, concat_ws(';', cna, snv) AS alterations
FROM c FULL JOIN l ON c.sample = l.sample AND c.gene = l.gene"""


# -- reshapes

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def unpivot_measures(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return rs.unpivot_values(li, ["l_orderkey", "l_linenumber"], "measure", "value", _MEASURES)


QUERIES["unpivot_measures"] = unpivot_measures
SQL["unpivot_measures"] = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS measure, "
    f"{'nullif(l_discount, 0)' if c == 'l_discount' else c} AS value FROM lineitem" for c in _MEASURES
)


def discrete_events(spark, sf):
    """Three state columns per line as the samples of a -2..2 table."""
    li = table(spark, sf, "lineitem")
    wide = li.select(
        F.col("l_partkey").alias("Hugo_Symbol"), F.col("l_orderkey").alias("Entrez_Gene_Id"),
        (F.col("l_linenumber") - 4).alias("s1"), (F.col("l_quantity") % 5 - 2).cast("int").alias("s2"),
        (F.col("l_suppkey") % 6 - 3).cast("int").alias("s3"),
    )
    return m.discrete_cn_events(wide)


QUERIES["discrete_events"] = discrete_events
SQL["discrete_events"] = """
WITH u AS (SELECT l_partkey AS g, 's1' AS sample, l_linenumber - 4 AS c FROM lineitem
  UNION ALL SELECT l_partkey, 's2', CAST(l_quantity % 5 - 2 AS INTEGER) FROM lineitem
  UNION ALL SELECT l_partkey, 's3', l_suppkey % 6 - 3 FROM lineitem)
SELECT g AS "Hugo_Symbol", sample, CASE c WHEN -2 THEN 'Deep Deletion' ELSE 'Amplification' END AS cna
FROM u WHERE c IN (-2, 2)"""

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"]


def pivot_matrix(spark, sf):
    customers = table(spark, sf, "customer")
    cells = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_name").alias("name"))
    return rs.pivot_unique(cells, "c_nationkey", "c_mktsegment", "name", _SEGMENTS, fill="")


QUERIES["pivot_matrix"] = pivot_matrix
SQL["pivot_matrix"] = f"""
SELECT c_nationkey, {', '.join(f"coalesce(min(c_name) FILTER (c_mktsegment = '{s}'), '') AS " + f'"{s}"' for s in _SEGMENTS)}
FROM customer GROUP BY c_nationkey"""


def pivot_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    return rs.pivot_sets(sample_gene(li, "l_linestatus", "l_returnflag"), "gene", "l_linestatus", "l_returnflag", ["F", "O", "X"])


QUERIES["pivot_sets"] = pivot_sets
SQL["pivot_sets"] = """
SELECT CAST(l_partkey % 50 AS VARCHAR) AS gene, """ + ", ".join(
    f"coalesce(string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) FILTER (l_linestatus = '{s}'), '') AS " + f'"{s}"'
    for s in "FOX"
) + " FROM lineitem GROUP BY 1"


def outer_with_missing_columns(spark, sf):
    """Customers under shifted ids and the order counts per customer id, rows of
    either side kept and one id missing on both."""
    customers = table(spark, sf, "customer").select(F.nullif(F.col("c_custkey") * 2, F.lit(4)).alias("id"), "c_name")
    orders = table(spark, sf, "orders").select(F.nullif("o_custkey", F.lit(2)).alias("id"))
    return full_join(customers, g.group_count(orders, ["id"], "n_orders"), ["id"])


QUERIES["outer_with_missing_columns"] = outer_with_missing_columns
SQL["outer_with_missing_columns"] = """
SELECT coalesce(c.id, o.id) AS id, c_name, n_orders
FROM (SELECT nullif(c_custkey * 2, 4) AS id, c_name FROM customer) c
FULL JOIN (SELECT nullif(o_custkey, 2) AS id, count(*) AS n_orders FROM orders GROUP BY 1) o
  ON c.id IS NOT DISTINCT FROM o.id"""


# -- columns by name and place, a stated order, arrays without missing entries

def chosen_columns(spark, sf):
    """Without the status; the key goes last, so the first column left is the customer."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    moved = rs.move_last(rs.without_suffix(orders, "status"), "o_orderkey")
    return moved.select(rs.columns_after(moved, 1))


QUERIES["chosen_columns"] = chosen_columns
SQL["chosen_columns"] = "SELECT o_totalprice, o_orderpriority, o_orderkey FROM orders"

_STATED = ["MACHINERY", "BUILDING"]


def stated_order(spark, sf):
    """Segments with their place; the few rows are in one partition when they are numbered."""
    counted = g.group_count(table(spark, sf, "customer"), ["c_mktsegment"], "n")
    ordered = order_by_list(counted, "c_mktsegment", _STATED).coalesce(1)
    return ordered.withColumn("place", F.monotonically_increasing_id())


QUERIES["stated_order"] = stated_order
SQL["stated_order"] = f"""
SELECT *, row_number() OVER (ORDER BY coalesce(list_position({_STATED}, c_mktsegment), {len(_STATED) + 1}), c_mktsegment) - 1 AS place
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)"""


def present_flags(spark, sf):
    flags = F.array(F.nullif("l_returnflag", F.lit("A")), F.nullif("l_linestatus", F.lit("F")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.size(drop_nulls(flags)).alias("n_flags"))


QUERIES["present_flags"] = present_flags
SQL["present_flags"] = """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag <> 'A' AS INTEGER) + CAST(l_linestatus <> 'F' AS INTEGER) AS n_flags
FROM lineitem"""


SQL["sample_universe"] = f"""
WITH {_SQL_EVENTS}, panel AS (SELECT CAST(unnest(range(50)) AS VARCHAR) AS gene),
examined AS (SELECT CAST(s_suppkey AS VARCHAR) AS sample FROM supplier
  INTERSECT SELECT DISTINCT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE NOT {SQL_MUTATED})
SELECT g.gene, x.sample, coalesce(e.alterations, '') AS alterations
FROM panel g CROSS JOIN examined x LEFT JOIN events_ e ON e.gene = g.gene AND e.sample = x.sample"""
