"""Exact duplicates with frequent digests split off.

The digest of the normalised text is computed once per document. A Misra-Gries
summary over all digests names every digest held by more than ``support`` of the
rows (and some others); their exact counts and smallest ids are taken, and these
few winners, at most 1 / support of them, are broadcast, so no hot group is
shuffled. All other digests are grouped by an ordinary shuffle, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.writers import staged
from .common import keep_rows, table, text_key

WHITE = "[\\x20\\x09-\\x0D]+"


def exact_groups(docs: DataFrame, support: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if the same after each run of white space became one space; a
    missing text counts as empty, and empty texts are one group. ``keep_id`` is
    the smallest id of the group, missing only if no row of it has an id; a row
    is kept if its id is that one, so repeated rows of that id stay together.
    Further columns are ignored. An empty table gives no rows.
    """
    return _grouped(docs, support, id_col, text_col).drop("text_key")


def _grouped(docs: DataFrame, support: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``exact_groups`` with their text_key."""
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " "), 256)
    digests = staged(
        docs.select(
            F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.unhex(sha).alias("digest"),
        ).withColumn("k", F.xxhash64("digest")),
        "digests",
    )
    frequent = digests.stat.freqItems(["k"], support).select(F.explode("k_freqItems").alias("k"))
    # at most 1 / support counters
    suspects = digests.join(F.broadcast(frequent), "k", "left_semi")
    winners = staged(_winners(suspects), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(_winners(rest), "digest")
    return heavy.unionByName(light).select(
        "doc_id", "text_key", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _winners(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without all copies but the one of the smallest id."""
    dropped = staged(_grouped(docs).filter(~F.col("kept")).select("doc_id", "text_key"), "copies")
    return keep_rows(docs, dropped)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {
    "op5_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
}
