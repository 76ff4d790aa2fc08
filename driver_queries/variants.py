"""Variant queries on lineitem, orders, pages, documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from somaframe.functions import classes as k
from somaframe.functions import text as tx
from somaframe.functions.nulls import col, null_if, round_to
from somaframe.operators.groups import contingency
from somaframe.operators.joins import natural_join
from somaframe.operators.reshape import explode_tokens, split_columns
from somaframe.plans import variants as v
from somaframe.sources import writers as w
from somaframe.sources.callfiles import read_catalogue
from somaframe.sources.readers import read_vcf

from . import fixed
from .common import sql_list, sql_recode, table

QUERIES, SQL = {}, {}

_KEY = ["l_partkey", "l_linenumber", "l_returnflag"]

# Exonic classes in the order of the codes used below.
_EFFECTS = list(fixed.EXONIC_TO_SNV)[:9] + ["synonymous SNV"]


# -- recurrence

def variant_recurrence(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", *_KEY, "l_quantity")
    return v.variant_recurrence(li, _KEY)


QUERIES["variant_recurrence"] = variant_recurrence
SQL["variant_recurrence"] = """
WITH li AS (SELECT l_suppkey, l_partkey, l_linenumber, l_returnflag, l_quantity FROM lineitem),
r AS (SELECT l_partkey, l_linenumber, l_returnflag, count(*) AS recurrence
      FROM (SELECT DISTINCT * FROM li) GROUP BY ALL)
SELECT li.*, r.recurrence FROM li JOIN r USING (l_partkey, l_linenumber, l_returnflag)"""


def recurrence_in_samples(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", *_KEY, "l_quantity")
    return v.recurrence_counts(li, _KEY, distinct_on=["l_suppkey"])


QUERIES["recurrence_in_samples"] = recurrence_in_samples
SQL["recurrence_in_samples"] = """
SELECT l_partkey, l_linenumber, l_returnflag, count(DISTINCT l_suppkey) AS recurrence FROM lineitem GROUP BY ALL"""


def recurrence_all_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    return v.variant_recurrence(li, ["l_partkey", "l_linestatus"], distinct=False, name="count_in_samples")


QUERIES["recurrence_all_rows"] = recurrence_all_rows
SQL["recurrence_all_rows"] = """
SELECT l_orderkey, l_partkey, l_linestatus,
       count(*) OVER (PARTITION BY l_partkey, l_linestatus) AS count_in_samples FROM lineitem"""


# -- parsing of annotated tables

def _annotated(spark, sf):
    li = table(spark, sf, "lineitem")
    quantity = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_suppkey").alias("Sample"), F.col("l_partkey").alias("Start"),
        F.col("l_orderkey").alias("End"),
        F.nullif("l_tax", F.lit(0.0)).alias("X1000g2015aug_all"),
        F.col("l_discount").alias("gnomad312_AF"),
        F.when(quantity < 40, F.concat(
            F.lit("ID=COSV"), F.col("l_partkey"), F.lit(",COSV"), F.col("l_suppkey"), F.lit(";OCCURENCE="),
            F.col("l_linenumber"), F.lit("(lung),"), quantity, F.lit("(skin)"),
        )).alias("cosmic97_coding"),
        F.when(quantity > 10, F.concat(
            F.lit("PROJ-"), F.col("l_returnflag"), F.lit("|"), F.col("l_linenumber"), F.lit("|99|0.5,LONGPROJECT|7|9|0.1,B|"),
            quantity, F.lit("|100|0.25"),
        )).alias("ICGC_Occurrence"),
    )


QUERIES["annovar_counts"] = lambda spark, sf: v.parse_annovar(
    _annotated(spark, sf), ["X1000g2015aug_all", "gnomad312_AF"]
)
SQL["annovar_counts"] = """
SELECT l_suppkey AS "Sample", l_partkey AS "Start", l_orderkey AS "End", l_tax AS "X1000g2015aug_all",
  l_discount AS "gnomad312_AF",
  CASE WHEN l_quantity < 40 THEN 'COSV' || l_partkey || ',COSV' || l_suppkey END AS cosmic97,
  CASE WHEN l_quantity < 40 THEN l_linenumber + l_quantity ELSE 0.0 END AS cosmic97_occurrence,
  CASE WHEN l_quantity > 10 THEN l_linenumber + l_quantity ELSE 0.0 END AS "ICGC_Occurrence" FROM lineitem"""


# -- coding filter on the recurrence result

def _codes():
    effects = F.array(*[F.lit(x) for x in _EFFECTS])
    regions = F.array(*[F.lit(x) for x in ["exonic", "exonic;splicing", "splicing", "intronic"]])
    return {
        "Func_refGene": F.get(regions, (F.col("l_tax") * 50).cast("int")),
        "ExonicFunc_refGene": F.get(effects, (F.col("l_quantity") % 11).cast("int")),
        "rmsk": F.nullif("l_returnflag", F.lit("N")),
    }


_SQL_CODES = f"""
coded AS (SELECT l_suppkey, l_partkey, l_linenumber, l_discount,
  CASE CAST(trunc(l_tax * 50) AS INTEGER) WHEN 0 THEN 'exonic' WHEN 1 THEN 'exonic;splicing'
       WHEN 2 THEN 'splicing' WHEN 3 THEN 'intronic' END AS func,
  CASE CAST(l_quantity % 11 AS INTEGER) {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EFFECTS))} END AS effect,
  nullif(l_returnflag, 'N') AS rmsk FROM lineitem)"""


def coding_filter(spark, sf):
    li = table(spark, sf, "lineitem").withColumns(_codes()).select(
        "l_suppkey", "l_partkey", "l_linenumber", "l_discount", "Func_refGene", "ExonicFunc_refGene", "rmsk"
    )
    counted = v.variant_recurrence(li, ["l_partkey", "l_linenumber"])
    return v.filter_coding_variants(counted, max_recurrence=5, frequencies=["l_discount"], max_frequency=0.06)


QUERIES["coding_filter"] = coding_filter
SQL["coding_filter"] = f"""
WITH {_SQL_CODES},
r AS (SELECT l_partkey, l_linenumber, count(*) AS recurrence FROM (SELECT DISTINCT * FROM coded) GROUP BY ALL),
j AS (SELECT coded.* EXCLUDE (effect), CASE WHEN func IS NULL THEN NULL WHEN func = 'splicing' THEN 'splicing'
             ELSE effect END AS effect, recurrence FROM coded JOIN r USING (l_partkey, l_linenumber))
SELECT l_suppkey, l_partkey, l_linenumber, l_discount, func AS "Func_refGene", effect AS "ExonicFunc_refGene",
       rmsk, recurrence, {sql_recode('effect', fixed.EXONIC_TO_SNV)} AS "ExonicFunc_simplified"
FROM j WHERE recurrence < 5 AND l_discount < 0.06
  AND func IN ('exonic', 'exonic;splicing', 'splicing') AND effect IN ({sql_list(fixed.EXONIC_TO_SNV)})
  AND NOT (effect IN ('nonframeshift insertion', 'nonframeshift substitution') AND rmsk IS NOT NULL)"""


# -- approximate position match

def catalogue_bucket_match(spark, sf):
    """Days of shipping against the day of the order; pending orders have ids that
    no line names."""
    found = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 10).alias("gene"), F.col("l_orderkey").alias("sample"),
        F.dayofyear("l_shipdate").cast("bigint").alias("start"), "l_linenumber", "l_partkey",
    )
    pending = F.col("o_orderstatus") == "P"
    catalogue = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 10).alias("gene"),
        F.when(pending, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("sample"),
        F.dayofyear("o_orderdate").cast("bigint").alias("position_start"), "o_custkey",
    )
    return v.match_catalogue(found, catalogue)


QUERIES["catalogue_bucket_match"] = catalogue_bucket_match
SQL["catalogue_bucket_match"] = """
WITH c AS (SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS gene,
    CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS sample, dayofyear(o_orderdate) AS position_start, o_custkey, round_even(dayofyear(o_orderdate) / 10, 0) * 10 AS approx_start
  FROM orders),
l AS (SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS gene, l_orderkey AS sample, dayofyear(l_shipdate) AS start,
    l_linenumber, l_partkey, round_even(dayofyear(l_shipdate) / 10, 0) * 10 AS approx_start
  FROM lineitem WHERE l_orderkey IN (SELECT sample FROM c))
SELECT * FROM c FULL JOIN l USING (gene, sample, approx_start)"""


def half_even_bins(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", round_to(F.col("l_quantity"), 10).alias("bin"))


QUERIES["half_even_bins"] = half_even_bins
SQL["half_even_bins"] = "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 10, 0) * 10 AS bin FROM lineitem"


# -- tokens and ids in text

def token_explode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return explode_tokens(docs, "token", tx.kept_tokens("text", " ", "an", "an", "th[a-z]")).select(
        "doc_id", "token"
    ).distinct()


QUERIES["token_explode"] = token_explode
SQL["token_explode"] = """
SELECT DISTINCT doc_id, token FROM (
  SELECT doc_id, regexp_replace(t, 'an', '') AS token FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) WHERE contains(t, 'an'))
WHERE NOT regexp_matches(token, 'th[a-z]')"""


def extract_ids_outer(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    exploded = v.explode_ids(pages, "url", "([a-z]+=[a-z0-9]+)", "id")
    rated = exploded.withColumns({
        "tier": F.regexp_extract("id", "^([a-z]+)", 1),
        "n_mutated": F.length("id"),
    })
    return v.collapse_ids(rated, "id")


QUERIES["extract_ids_outer"] = extract_ids_outer
SQL["extract_ids_outer"] = """
WITH e AS (SELECT page_id, url, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS id FROM (
  SELECT page_id, url, regexp_extract_all(url, '([a-z]+=[a-z0-9]+)', 1) AS ids FROM pages))
SELECT page_id, url, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS id,
  coalesce(string_agg(DISTINCT regexp_extract(id, '^([a-z]+)', 1), ',' ORDER BY regexp_extract(id, '^([a-z]+)', 1)), '') AS tier,
  CAST(coalesce(sum(length(id)), 0) AS BIGINT) AS n_mutated FROM e GROUP BY page_id, url"""


def enrich_catalogue(spark, sf):
    """Numbers in a page's address are the ids, labelled documents the catalogue."""
    pages = table(spark, sf, "pages").select("url")
    frequency = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("catalogue_id"),
        (F.col("quality") + 1).alias("n_mutated"),
        F.concat(F.lit("T"), F.col("toxic")).alias("tier"),
    )
    return v.enrich_catalogue(pages, frequency, "url", "/([0-9]+)")


QUERIES["enrich_catalogue"] = enrich_catalogue
SQL["enrich_catalogue"] = """
WITH e AS (SELECT rn, url, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS id FROM (
  SELECT row_number() OVER () AS rn, url, regexp_extract_all(url, '/([0-9]+)', 1) AS ids FROM pages))
SELECT url, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS catalogue_id,
  coalesce(string_agg(DISTINCT 'T' || toxic, ',' ORDER BY 'T' || toxic), '') AS tier,
  CAST(coalesce(sum(quality + 1), 0) AS BIGINT) AS n_mutated
FROM e LEFT JOIN labels ON id = CAST(doc_id AS VARCHAR) GROUP BY url"""


def catalogue_left_join(spark, sf):
    """Row-wise look-up of orders in a catalogue of customers under shifted ids, all
    orders kept."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    customers = table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("id"), "c_mktsegment", "c_nationkey"
    )
    return natural_join(orders, customers, ["id"], "left")


QUERIES["catalogue_left_join"] = catalogue_left_join
SQL["catalogue_left_join"] = """
SELECT o_orderkey, o_custkey AS id, c_mktsegment, c_nationkey FROM orders
LEFT JOIN customer ON o_custkey = c_custkey * 2"""


def sum_of_matches(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("props").alias("field"), tx.sum_of_matches("props", "([0-9]+)").alias("total")
    )
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("url").alias("field"), tx.sum_of_matches("url", "=([0-9]+)").alias("total")
    )
    return events.unionByName(pages)


QUERIES["sum_of_matches"] = sum_of_matches
SQL["sum_of_matches"] = """
SELECT event_id AS id, 'props' AS field,
  coalesce(list_sum(list_transform(regexp_extract_all(props, '([0-9]+)', 1), lambda x: CAST(x AS DOUBLE))), 0.0) AS total FROM events
UNION ALL SELECT page_id, 'url',
  coalesce(list_sum(list_transform(regexp_extract_all(url, '=([0-9]+)', 1), lambda x: CAST(x AS DOUBLE))), 0.0) FROM pages"""


def split_fixed_fields(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.substring_index("url", "//", -1).alias("rest"))
    short = F.size(F.split("rest", "/")) == 3
    padded = pages.withColumn("rest", F.when(short, tx.pad_before_last("rest", "/", "///")).otherwise(col("rest")))
    return split_columns(padded, "rest", "/", ["p1", "p2", "p3", "p4", "p5", "p6"])


QUERIES["split_fixed_fields"] = split_fixed_fields
SQL["split_fixed_fields"] = """
WITH p AS (SELECT page_id, url, string_split(regexp_extract(url, '//(.*)$', 1), '/') AS f FROM pages),
q AS (SELECT page_id, url, CASE WHEN len(f) = 3 AND f[3] <> '' THEN [f[1], f[2], '', '', f[3]] ELSE f END AS f FROM p)
SELECT page_id, url, f[1] AS p1, f[2] AS p2, f[3] AS p3, f[4] AS p4, f[5] AS p5, f[6] AS p6 FROM q"""


def remove_first_match(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id",
        tx.remove_first("url", "[a-z]+\\.").alias("url"),
        tx.remove_first("html", "<title>", ignore_case=True).alias("html"),
        tx.remove_trailing("url", "[0-9]").alias("cut"),
    )


QUERIES["remove_first_match"] = remove_first_match
SQL["remove_first_match"] = r"""
SELECT page_id, regexp_replace(url, '[a-z]+\.', '') AS url, regexp_replace(html, '<title>', '', 'i') AS html,
  regexp_replace(url, '[0-9]$', '') AS cut FROM pages"""


def flatten_record(spark, sf):
    """Query part of each address as key/value rows."""
    pages = table(spark, sf, "pages")
    query = F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))
    fields = tx.info_fields(F.regexp_replace(query, "&", ";"))
    return pages.select("page_id", F.explode_outer(fields).alias("key", "value"))


QUERIES["flatten_record"] = flatten_record
SQL["flatten_record"] = r"""
WITH q AS (SELECT page_id, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS q FROM pages),
e AS (SELECT page_id, unnest(CASE WHEN q IS NULL THEN [NULL] ELSE string_split(q, '&') END) AS kv FROM q)
SELECT page_id, string_split(kv, '=')[1] AS key, string_split(kv, '=')[2] AS value FROM e"""


# -- VCF records

_FIELDS = ["Allele", "Consequence", "IMPACT"]


def _vcf(spark, sf):
    li = table(spark, sf, "lineitem")
    flag, part, line = F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linenumber")
    long_form = line > 3
    annotated = F.concat(
        F.lit("DP=9;CSQ="), flag, F.lit("|missense_variant|"), part, F.lit(","), flag, F.lit("|stop_gained|HIGH;END=1")
    )
    return li.select(
        "l_orderkey", F.col("l_partkey").alias("POS"), F.when(F.col("l_linestatus") == "F", "PASS").otherwise("weak").alias("FILTER"),
        F.when(F.col("l_quantity") > 25, annotated).otherwise("DP=9").alias("INFO"),
        F.when(long_form, "GT:AD:AF:DP:F1R2:F2R1:FAD:PGT:PID:PS:SB").otherwise("GT:AD:AF:DP:F1R2:F2R1:FAD:SB").alias("FORMAT"),
        F.concat(F.lit("0/1:"), part, F.lit(":0.5:9:1,2:3,4:5:"),
                 F.when(long_form, F.concat(F.lit("0|1:id:"), line, F.lit(":"))).otherwise(""), flag).alias("STATS"),
    )


def flatten_vcf(spark, sf):
    return v.flatten_vcf(_vcf(spark, sf), _FIELDS)


QUERIES["flatten_vcf"] = flatten_vcf
SQL["flatten_vcf"] = """
WITH a AS (SELECT *, unnest(CASE WHEN l_quantity > 25 THEN
    [[l_returnflag, 'missense_variant', CAST(l_partkey AS VARCHAR)], [l_returnflag, 'stop_gained', 'HIGH']]
    ELSE [NULL] END) AS csq FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_partkey AS "POS", 'PASS' AS "FILTER", '0/1' AS "fmt_GT", CAST(l_partkey AS VARCHAR) AS "fmt_AD",
  '0.5' AS "fmt_AF", '9' AS "fmt_DP", '1,2' AS "fmt_F1R2", '3,4' AS "fmt_F2R1", '5' AS "fmt_FAD",
  CASE WHEN l_linenumber > 3 THEN '0|1' END AS "fmt_PGT", CASE WHEN l_linenumber > 3 THEN 'id' END AS "fmt_PID",
  CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END AS "fmt_PS", l_returnflag AS "fmt_SB",
  csq[1] AS "csq_Allele", csq[2] AS "csq_Consequence", csq[3] AS "csq_IMPACT" FROM a"""


def vcf_text(spark, sf):
    """The same records as text behind ``##`` lines and a header, read back."""
    records = _vcf(spark, sf).select(F.concat_ws(
        "\t", F.lit("chr1"), "POS", F.col("l_orderkey").cast("string"), F.lit("A"), F.lit("G"), F.lit("."), "FILTER", "INFO", "FORMAT", "STATS",
    ).alias("value"), F.lit(2).alias("place"))
    names = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"
    parts = spark.range(0, 4, 1, 4).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("value"), F.lit(i).alias("place")) for i, t in enumerate(["##fileformat=VCFv4.2", names])])).alias("line"))
    lines = parts.select("line.*").unionByName(records)
    path = w.scratch_path(spark, "vcf")
    lines.select("value").write.option("compression", "gzip").text(path)
    read = read_vcf(spark, path, glob="*.gz").withColumn("l_orderkey", F.col("ID").cast("bigint"))
    return v.flatten_vcf(read.select("l_orderkey", "POS", "FILTER", "INFO", "FORMAT", "STATS"), _FIELDS)


QUERIES["vcf_text"] = vcf_text
SQL["vcf_text"] = SQL["flatten_vcf"]


def catalogue_text(spark, sf):
    """Catalogue files of two samples, parsed and matched with the variants of lines;
    transcript-named genes and silent changes go, and positions come out of text."""
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    gene = (F.col("o_custkey") % 50).cast("string")
    text = orders.select(
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("ENST00000"), F.lpad(gene, 6, "0"))).otherwise(gene).alias("Gene"),
        F.when(F.col("o_orderkey") % 5 == 0, "Substitution - coding silent").otherwise("Substitution - Missense").alias("Type"),
        F.lit("No").alias("Census_Tier_1"), F.concat(F.lit("c."), "o_orderkey").alias("CDS_Mutation"), F.lit("Verified").alias("Validated"),
        F.concat(F.lit("1:"), "o_orderkey", F.lit("-"), "o_orderkey").alias("Position"), "o_orderstatus",
    )
    paths = {}
    for status in ("F", "O"):
        paths[status] = w.scratch_path(spark, "catalogue")
        w.write_tsv(text.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), paths[status])
    catalogue = v.parse_catalogue(read_catalogue(spark, paths)).select(
        F.col("Gene").alias("gene"), "sample", "position_start", "CDS_Mutation")
    found = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 50).cast("string").alias("gene"), F.col("l_linestatus").alias("sample"),
        (F.col("l_orderkey") + F.col("l_linenumber")).cast("double").alias("start"), "l_linenumber")
    return v.match_catalogue(found, catalogue)


QUERIES["catalogue_text"] = catalogue_text
SQL["catalogue_text"] = """
WITH c AS (
  SELECT CAST(o_custkey % 50 AS VARCHAR) AS gene, o_orderstatus AS sample, CAST(o_orderkey AS DOUBLE) AS position_start,
    'c.' || o_orderkey AS "CDS_Mutation", round_even(o_orderkey / 10, 0) * 10 AS approx_start
  FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0),
l AS (
  SELECT CAST(l_partkey % 50 AS VARCHAR) AS gene, l_linestatus AS sample, CAST(l_orderkey + l_linenumber AS DOUBLE) AS start,
    l_linenumber, round_even((l_orderkey + l_linenumber) / 10, 0) * 10 AS approx_start
  FROM lineitem WHERE l_linestatus IN (SELECT sample FROM c))
SELECT gene, sample, approx_start, position_start, "CDS_Mutation", start, l_linenumber FROM c FULL JOIN l USING (gene, sample, approx_start)"""


# -- VEP filters

def _vep(spark, sf):
    orders = table(spark, sf, "orders")
    consequence = F.when(F.col("o_orderstatus") == "F", "missense_variant&splice_region_variant").when(
        F.col("o_orderstatus") == "O", "intron_variant").otherwise("stop_gained")
    return orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("HIGH").alias("IMPACT"),
        F.when(F.col("o_totalprice") > 100000, "protein_coding").otherwise("lncRNA").alias("BIOTYPE"),
        consequence.alias("Consequence"),
    )


QUERIES["vep_filter"] = lambda spark, sf: v.filter_vep(_vep(spark, sf))
SQL["vep_filter"] = """
SELECT o_orderkey, o_custkey, 'HIGH' AS "IMPACT", 'protein_coding' AS "BIOTYPE",
  CASE o_orderstatus WHEN 'F' THEN 'missense_variant&splice_region_variant' ELSE 'stop_gained' END AS "Consequence"
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 100000 AND o_orderstatus <> 'O'"""

QUERIES["consequence_table"] = lambda spark, sf: contingency(_vep(spark, sf), "Consequence", "IMPACT")
SQL["consequence_table"] = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'missense_variant&splice_region_variant' WHEN 'O' THEN 'intron_variant'
            ELSE 'stop_gained' END AS "Consequence",
  CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'HIGH' END AS "IMPACT", count(*) AS n FROM orders GROUP BY ALL"""


def _rated(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("MAX_AF"),
        F.col("l_quantity").alias("n_mutated"),
    )


QUERIES["rare_or_missing"] = lambda spark, sf: v.filter_rare(_rated(spark, sf), below=0.03)
QUERIES["rare_only"] = lambda spark, sf: v.filter_rare(_rated(spark, sf), below=0.03, missing="drop")
QUERIES["conflicting_variants"] = lambda spark, sf: v.conflicting_variants(
    _rated(spark, sf), min_count=30, min_frequency=0.05
)
_SQL_RATED = """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS "MAX_AF", l_quantity AS n_mutated FROM lineitem"""
SQL["rare_or_missing"] = f"""SELECT * FROM ({_SQL_RATED}) WHERE coalesce("MAX_AF" < 0.03, true)"""
SQL["rare_only"] = f"""SELECT * FROM ({_SQL_RATED}) WHERE "MAX_AF" < 0.03"""
SQL["conflicting_variants"] = f"""SELECT * FROM ({_SQL_RATED}) WHERE n_mutated > 30 AND "MAX_AF" > 0.05"""


# -- cohort mutations

_MAF_CLASSES = [*fixed.MAF_TO_SNV, "Silent", "RNA", "Intron"]  # the code after the last one is a missing class


def dedupe_maf(spark, sf):
    li = table(spark, sf, "lineitem")
    classes = F.array(*[F.lit(x) for x in _MAF_CLASSES])
    maf = li.select(
        F.col("l_partkey").alias("Hugo_Symbol"), F.col("l_suppkey").alias("Tumor_Sample_Barcode"),
        F.get(classes, ((F.col("l_partkey") + F.col("l_linenumber")) % 13).cast("int")).alias("Variant_Classification"),
    )
    return v.dedupe_maf(maf, maf.columns).withColumn("snv", k.recode("Variant_Classification", k.MAF_TO_SNV))


QUERIES["dedupe_maf"] = dedupe_maf
SQL["dedupe_maf"] = f"""
SELECT *, {sql_recode('"Variant_Classification"', fixed.MAF_TO_SNV)} AS snv FROM (
  SELECT DISTINCT l_partkey AS "Hugo_Symbol", l_suppkey AS "Tumor_Sample_Barcode",
    CASE (l_partkey + l_linenumber) % 13 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_MAF_CLASSES))} END
      AS "Variant_Classification"
  FROM lineitem)
WHERE "Variant_Classification" NOT IN ('Silent', 'RNA', 'Intron') OR "Variant_Classification" IS NULL"""


def null_by_condition(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", null_if("l_extendedprice", F.col("l_discount") > 0.05).alias("price"))


QUERIES["null_by_condition"] = null_by_condition
SQL["null_by_condition"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN NULL ELSE l_extendedprice END AS price FROM lineitem"""
