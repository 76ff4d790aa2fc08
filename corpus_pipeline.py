"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads: the
documents it keeps, with their columns, and pieces of sequences at the end.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from somaframe.llm.common import table
from somaframe.llm.decontaminate import drop_contaminated
from somaframe.llm.exact_dedup import drop_exact_copies
from somaframe.llm.language_id import drop_unidentified
from somaframe.llm.near_dedup import drop_near_copies
from somaframe.llm.packing import pack
from somaframe.sources.writers import staged_whole


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("packing", packing)]
ORACLE_SQL = None  # language identification and packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and reread; what a
    stage has staged itself goes once it is written. Pieces with their token ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged_whole(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``run`` with the checksum of their ids for the ids."""
    return run(spark, sf_dir).drop("ids")


QUERIES = {"pipeline": pieces}
SQL: dict[str, str] = {}
