"""Personal data: patterns, and terms that give protected entities away.

Base spans are the matches of a pattern per kind that pass its test; the value of
a span is an entity, protected in each document that holds it. Around each
occurrence of an entity the terms within ``REACH`` characters are taken, and the
whole corpus says how much such a term t tells about an entity c: documents with t
near c, with c, and with t give PMI(c; t), which is compared with the information
of c itself, IC(c). A term whose PMI reaches IC / ``ALPHA`` in at least
``CONTEXTS`` different surroundings (copies of a passage are one) discloses c. In
documents that protect c such a term is generalised, and removed where it tells
all, PMI = IC.

Everything is native columns: places follow from the lengths of matches and of
the gaps between them. Texts are scanned three times and never shuffled; shuffled
are terms near entities, counts of terms that may disclose something, and spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.writers import staged
from .common import small_side, table, text_key

REACH = 80  # characters on either side of an entity
CONTEXTS = 3
ALPHA = 1.1
TERM = "\\p{L}{3,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The kinds in their order. Runs are possessive, and a run is tried
# from its start only, so that no text takes more than linear time.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_BLOCK = 48  # running sums are taken in blocks, as each step copies what is there
SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression within a lambda is
    computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, divides by 10."""
    def added(j: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - j, F.lit(1))) - 48
        twice = F.when(j % 2 == 1, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda s, j: s + added(j)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return _let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))


def _sums(lengths: Column) -> Column:
    """Sum of all entries before each entry, and of all, of an array."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def _before(lengths: Column) -> Column:
    """Sum of all entries before each entry, in blocks; of a non-empty array."""
    def within(n: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int"))
        return F.transform(numbers, lambda b: _sums(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))

    def shifted(blocks: Column) -> Column:
        return _let(_sums(F.transform(blocks, lambda s: F.element_at(s, -1))), lambda start: F.flatten(F.transform(
            blocks, lambda s, i: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + F.get(start, i)))))
    return _let(lengths, lambda n: _let(within(n), shifted))


def _matched(text: Column, pattern: Column | str, rank: int, kept) -> Column:
    """Spans of the matches that pass ``kept``, in order. Their places are sums of
    the lengths of matches and of the gaps between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(f"array<{SPAN}>")

    def spans(matches: Column) -> Column:
        pairs = F.slice(F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("gap")), F.lit(1), F.size(matches))

        def placed(z: Column) -> Column:
            before = _before(F.transform(z, lambda x: F.length(x["m"]) + F.length(x["gap"])))
            return F.zip_with(z, before, lambda x, at: F.struct(
                (at + F.length(x["gap"])).alias("start"), F.lit(rank).alias("rank"),
                (at + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")))
        return F.when(F.exists(matches, kept), F.filter(_let(pairs, placed), lambda s: kept(s["value"]))).otherwise(none)
    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of a kind in order: start, rank of the kind, end, value."""
    spans = _matched(text, PATTERNS[kind], KINDS.index(kind), lambda m: _valid(kind, m))
    needed = {"email": "@", "phone": "+"}.get(kind)
    if needed is None:
        return spans
    return F.when(F.contains(text, F.lit(needed)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[kind_spans(text, kind) for kind in PATTERNS]))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def terms_near(text: Column, span: Column, reach: int) -> Column:
    """Distinct terms wholly within ``reach`` characters before or after a span."""
    begin, end = span["start"], span["end"]
    # one character more than the reach tells whether the outermost term goes on
    left = F.substring(text, F.greatest(begin - reach, F.lit(0)) + 1, F.least(begin, F.lit(reach)))
    cut = F.substring(text, F.greatest(begin - reach, F.lit(1)), F.lit(1)).rlike("\\p{L}") & (begin > reach)
    left = F.when(cut, F.regexp_replace(left, "^\\p{L}+", "")).otherwise(left)
    right = F.substring(text, end + 1, F.lit(reach))
    on = F.substring(text, end + reach + 1, F.lit(1)).rlike("\\p{L}")
    right = F.when(on, F.regexp_replace(right, "\\p{L}+$", "")).otherwise(right)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_lowered(F.concat(left, F.lit("\n"), right)), F.lit(TERM), F.lit(0))))


def disclosing_terms(found: DataFrame, docs: DataFrame, alpha: float = ALPHA, contexts: int = CONTEXTS) -> DataFrame:
    """entity, term, tells_all: terms that disclose an entity. ``found`` (staged):
    key, entity, terms, a row per occurrence of an entity; ``docs``: terms."""
    near = found.select("key", "entity", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    both = near.groupBy("entity", "term").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("n_both"))
    both = staged(both.filter(F.col("contexts") >= contexts), "near")
    entities = found.select("entity", "key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = both.join(entities, "entity")
    total = docs.count()
    # PMI >= IC / alpha, without logarithms: n_both N / (n_entity n_term) >= (N / n_entity) ^ (1 / alpha)
    most = F.floor(F.col("n_both") * total / F.col("n_entity") / F.pow(total / F.col("n_entity"), F.lit(1 / alpha)))
    # a term stands in all the documents in which it is near any entity, and more
    at_least = near.groupBy("term").agg(F.count_distinct("key").alias("least"))
    open_ = staged(pairs.withColumn("most", most).join(at_least, "term").filter(F.col("least") <= F.col("most"))
                   .select("entity", "term", "n_both", "most"), "open")
    wanted = small_side(open_.select("term").distinct())
    counted = docs.select(F.explode("terms").alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    return staged(open_.join(counted, "term").filter(F.col("n_term") <= F.col("most")).select(
        "entity", "term", (F.col("n_term") == F.col("n_both")).alias("tells_all")), "disclosing")


def _term_spans(text: Column, base: Column, terms: Column, rank: int) -> Column:
    """Occurrences of the listed terms that touch no base span."""
    listed = F.concat(F.lit("(?<!\\p{L})(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(")(?!\\p{L})"))  # letters only
    spans = _matched(_lowered(text), listed, rank, lambda m: F.length(m) > 0)
    return _let(base, lambda held: F.filter(spans, lambda s: ~F.exists(held, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sanitised(text: Column, spans: Column, tells_all: Column) -> Column:
    """The text with a mark for each span; a term that tells all is left out."""
    marks = F.array(F.lit("[EMAIL]"), F.lit("[IP]"), F.lit("[CARD]"), F.lit("[PHONE]"), F.lit("[TERM]"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(state: Column, s: Column) -> Column:
        mark = F.when((s["rank"] == 4) & F.array_contains(tells_all, s["value"]), "").otherwise(F.get(marks, s["rank"]))
        skipped = s["start"] < state["at"]  # goes on within a span that is out already
        return F.struct(
            F.when(skipped, state["out"]).otherwise(F.concat(
                state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark)).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"))
    return F.aggregate(spans, start, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


def personal_data(docs: DataFrame, reach: int = REACH, alpha: float = ALPHA, contexts: int = CONTEXTS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base (array of start, rank of the kind,
    end, value), spans (base and terms), sanitised.

    Places are code points, ends exclusive; spans are by start, then kind. Spans of
    different kinds may overlap; in ``sanitised`` what is under an earlier span goes
    with it. Terms are letter runs of three or more in ASCII lower case. Documents
    are rows: repeated rows count again, but rows alike in id and text are one
    document for an entity's number of documents and its terms'. A missing text is
    empty and has no spans. Further columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"))
    spans = docs.select(key.alias("key"), text.alias("text"), base_spans(text).alias("base")).filter(F.size("base") > 0)
    near = F.transform("base", lambda s: F.struct(s, terms_near(F.col("text"), s, reach).alias("terms")))
    held = staged(spans.select("key", "base", F.transform(near, lambda z: z["terms"]).alias("terms")), "held").distinct()
    found = held.select("key", F.explode(F.arrays_zip("base", "terms")).alias("z")).select(
        "key", _lowered(F.col("z.base.value")).alias("entity"), F.col("z.terms").alias("terms"))
    found = staged(found, "found")
    words = F.array_distinct(F.regexp_extract_all(_lowered(text), F.lit(TERM), F.lit(0)))
    disclosing = disclosing_terms(found, docs.select(key.alias("key"), words.alias("terms")), alpha, contexts)
    of_doc = found.select("key", "entity").distinct().join(disclosing, "entity").groupBy("key").agg(
        F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("tells_all"), F.col("term"))).alias("tells_all"))
    protected = small_side(staged(of_doc.select(
        F.col("key.doc_id").alias("_id"), F.col("key.text_key").alias("_key"), "terms", "tells_all"), "protected"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & text_key(F.col(text_col)).eqNullSafe(F.col("_key"))
    rows = docs.select(F.col(id_col), F.col(text_col)).join(protected, same, "left").select(
        F.col(id_col).alias("doc_id"), text.alias("text"), base_spans(text).alias("base"), "terms", "tells_all")
    term_spans = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("base"), F.col("terms"), KINDS.index("term")))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(term_spans, F.array().cast(f"array<{SPAN}>")))))
    return rows.select("doc_id", "base", "spans", _sanitised(
        F.col("text"), F.col("spans"), F.coalesce("tells_all", F.array().cast("array<string>"))).alias("sanitised"))


def _number(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [_number(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op11_pii": op11_pii}
_RE = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
    "card": "[0-9]([\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_SQL_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda p: CAST(p AS HUGEINT) <= 255))",
    "card": "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda j: CASE "
            "WHEN j % 2 = 0 THEN ascii(digits[length(digits) - j]) - 48 "
            "ELSE (2 * (ascii(digits[length(digits) - j]) - 48)) // 10 + (2 * (ascii(digits[length(digits) - j]) - 48)) % 10 END)) % 10 = 0",
    "phone": "length(digits) BETWEEN 10 AND 15",
}


def _sql_matches(pattern: str, text: str, source: str) -> str:
    """Each match with its place, from the lengths of matches and gaps before it."""
    return f"""SELECT doc_id, value, CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i)
      + coalesce(sum(length(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, unnest(ms) AS value, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gaps FROM {source}))"""


_KIND_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS rank, value, start FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits "
    f"FROM ({_sql_matches(_RE[kind], 'text', 'd')})) WHERE {_SQL_VALID[kind]}" for k, kind in enumerate(_RE))
_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
SQL = {
    "op11_pii": f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED (SELECT *, start + length(value) AS stop FROM ({_KIND_ROWS})),
sides AS (
  SELECT b.*, {_LOW.format('value')} AS entity,
    CASE WHEN start > {REACH} AND regexp_matches(substring(text, start - {REACH}, 1), '\\p{{L}}')
      THEN regexp_replace(substring(text, start - {REACH} + 1, {REACH}), '^\\p{{L}}+', '')
      ELSE substring(text, greatest(start - {REACH}, 0) + 1, least(start, {REACH})) END AS lft,
    CASE WHEN regexp_matches(substring(text, stop + {REACH} + 1, 1), '\\p{{L}}')
      THEN regexp_replace(substring(text, stop + 1, {REACH}), '\\p{{L}}+$', '')
      ELSE substring(text, stop + 1, {REACH}) END AS rgt
  FROM b JOIN d USING (doc_id)),
near AS MATERIALIZED (
  SELECT doc_id, entity, list_sort(list_distinct(regexp_extract_all({_LOW.format("lft || chr(10) || rgt")}, '\\p{{L}}{{3,}}'))) AS terms FROM sides),
pairs AS (
  SELECT entity, term, count(DISTINCT terms) AS contexts, count(DISTINCT doc_id) AS n_both
  FROM (SELECT doc_id, entity, terms, unnest(terms) AS term FROM near) GROUP BY entity, term HAVING contexts >= {CONTEXTS}),
entities AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM near GROUP BY entity),
counted AS (
  SELECT term, count(*) AS n_term FROM (
    SELECT unnest(list_distinct(regexp_extract_all({_LOW.format('text')}, '\\p{{L}}{{3,}}'))) AS term FROM d) GROUP BY term),
disclosing AS (
  SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN counted USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
  WHERE n_term <= floor(n_both * n / n_entity / pow(n / n_entity, 1 / CAST({ALPHA} AS DOUBLE)))),
of_doc AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM near JOIN disclosing USING (entity)),
held AS MATERIALIZED (SELECT doc_id, text FROM d WHERE doc_id IN (SELECT doc_id FROM of_doc)),
t AS (
  SELECT x.doc_id, 4 AS rank, x.value, x.start, x.start + length(x.value) AS stop
  FROM ({_sql_matches("\\p{L}{3,}", _LOW.format('text'), 'held')}) x JOIN of_doc ON of_doc.doc_id = x.doc_id AND of_doc.term = x.value),
s AS (
  SELECT * FROM b UNION ALL
  SELECT doc_id, rank, value, start, stop FROM t
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)),
listed AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
    count(*) FILTER (rank = 3) AS n_phone,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
""",
}
