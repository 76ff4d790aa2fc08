"""Benchmark passages in training documents, found by word windows.

The windows of all benchmark items form a hash table that is broadcast; each
document's word hashes are exploded and the hash of the window starting at each
word is looked up, all in one generated stage over the scanned text. The words of
a hit are compared before it counts. Only hits, and one row per document, are
shuffled.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.writers import staged
from .common import keep_rows, table, text_key

WINDOW = 10
TABLE_ROWS = 1_000_000  # (window, item) pairs in one broadcast table
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in ASCII lower case; none where the text is missing. ``lower`` is the
    faster way where only ASCII occurs."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def window_hash(hashes: str, start: Column, length: Column, width: int) -> Column:
    """Hash of ``length`` (at most ``width``) entries of an array of word hashes."""
    cells = [F.when(length > j, F.get(hashes, start + j)) for j in range(width)]
    return F.xxhash64(length, *cells)


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, length, text, and the ids of the items with them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    sized = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(width)))
    hashed = sized.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("start"))
    return starts.select(
        window_hash("hashes", F.col("start"), F.col("length"), width).alias("window"), "length", "item",
        F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("passage"),
    ).groupBy("window", "length", "passage").agg(F.collect_set("item").alias("items"))


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each occurrence of a benchmark window, and a row without ``items`` for each
    document: doc_id, text_key, n_words, start, length, items."""
    windows = staged(benchmark_windows(benchmark, width), "windows")
    found = windows.groupBy("length").agg(F.sum(F.size("items")).alias("n")).collect()  # ``width`` rows at most
    lengths = [r["length"] for r in found] or [width]
    parts = max(1, ceil(sum(r["n"] for r in found) / TABLE_ROWS))
    words = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"),
    )
    hashed = words.select("*", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    at = hashed.select("*", F.posexplode_outer("hashes").alias("start", "_hash"))
    if len(lengths) > 1:
        at = at.select("*", F.explode(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)])).alias("length"))
    else:
        at = at.withColumn("length", F.lit(lengths[0]))
    keyed = at.withColumn(
        "window", F.when(F.col("start") + F.col("length") <= F.col("n_words"),
                         window_hash("hashes", F.col("start"), F.col("length"), width)))
    first = F.coalesce(F.col("start"), F.lit(0)).eqNullSafe(F.lit(0)) & (F.col("length") == max(lengths))
    hits = None
    for part in range(parts):  # the benchmark sets their number, not the corpus
        of_part = windows if parts == 1 else windows.filter(F.pmod("window", F.lit(parts)) == part)
        of_part = of_part.select("window", F.col("length").alias("_length"), "passage", "items")
        same = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ") == F.col("passage")
        seen = keyed.join(F.broadcast(of_part), "window", "left")
        one = first if part == 0 else F.lit(False)
        hit = F.coalesce((F.col("length") == F.col("_length")) & same, F.lit(False))
        seen = seen.filter(one | F.col("items").isNotNull()).select(
            "doc_id", "text_key", "n_words", "start", "length", one.alias("first"),
            F.when(hit, F.col("items")).alias("items"),
        )
        hits = seen if hits is None else hits.unionByName(seen)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated.

    A word is hit if it lies in an occurrence of ``width`` consecutive words of an
    item, or of a whole item with fewer words. A missing text has no words and
    hits nothing, as does an item without words. Repeated rows give repeated
    results; an item id that repeats counts once. Further columns are ignored. An
    empty benchmark leaves all documents clean.
    """
    return _contamination(docs, benchmark, width, id_col, text_col).drop("text_key")


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``contamination`` with their text_key."""
    key = ["doc_id", "text_key"]
    hits = window_hits(docs, benchmark, width, id_col, text_col)
    begin, end = F.col("start"), F.col("start") + F.col("length")
    before = Window.partitionBy(*key).orderBy("start", F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_hit = F.col("items").isNotNull()
    reached = F.max(F.when(is_hit, end)).over(before)  # a group is one document
    fresh = F.when(is_hit, F.greatest(F.lit(0), end - F.greatest(begin, F.coalesce(reached, F.lit(0)))))
    per_doc = hits.withColumn("fresh", fresh).groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if("first").alias("copies"),
    )
    counted = per_doc.select(
        "*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))).alias("_copy"))
    return counted.select(
        *key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark window."""
    dropped = staged(_contamination(docs, benchmark).filter("contaminated").select("doc_id", "text_key"), "contaminated")
    return keep_rows(docs, dropped)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark),
s AS (SELECT *, least(len(words), 10) AS length FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, length, array_to_string(words[i:i + length - 1], ' ') AS passage
       FROM s, unnest(range(1, len(words) - length + 2)) AS t(i)),
lengths AS (SELECT DISTINCT length FROM bw),
dw AS (SELECT doc_id, length, i, array_to_string(words[i:i + length - 1], ' ') AS passage
       FROM d, lengths, unnest(range(1, len(words) - length + 2)) AS t(i)),
hits AS (SELECT doc_id, i, length, item_id FROM dw JOIN bw USING (length, passage)),
places AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(i, i + length)) AS t(p)),
counted AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
