"""Language by the nearest of several centroids.

A document is the L2-normalised TF-IDF vector of its hashed byte trigrams, in
lower case and with everything but letters as blanks. Document frequencies cover
all learning rows. The centroids of a language come from spherical k-means over a
bounded sample of its rows, one group of that bounded size for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..sources.writers import staged
from .common import released, small_side, table, text_batches, text_key
from .words import slices, text_buffer

DIMENSIONS = 1 << 12
SAMPLE_PER_LANGUAGE = 1500
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.2  # of the first percentile of the sample's similarities
_LETTER = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass
class LanguageModel:
    weights: np.ndarray  # inverse document frequencies
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # similarity to a centroid below which a text is rejected


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of hashed trigrams, documents by dimensions, some documents at a time."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    for lo, hi in slices(offsets, most=128):
        at = offsets[lo: hi + 1] - offsets[lo]
        part = _LETTER[data[offsets[lo]: offsets[hi]]].astype(np.uint32)
        n = max(0, len(part) - 2)
        code = (part[:n] << 16) | (part[1: n + 1] << 8) | part[2: n + 2]
        doc = np.repeat(np.arange(hi - lo), np.diff(at))[:n]
        inside = (np.arange(n) + 3 <= at[doc + 1]) & (code != 0x202020)
        place = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 12)
        cells = doc[inside] * DIMENSIONS + place
        yield lo, hi, np.bincount(cells, minlength=(hi - lo) * DIMENSIONS).reshape(hi - lo, DIMENSIONS)


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = counts.astype(np.float32) * weights
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-12)[:, None]



def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def _document_frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in released(batches):
            for lo, hi, counts in gram_counts(batch.column(0)):
                seen += (counts > 0).sum(0)
                n += hi - lo
        seen = np.append(seen, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["place", "n"])

    rows = (
        learning.select("text").mapInArrow(count, "place long, n long")
        .groupBy("place").agg(F.sum("n").alias("n")).collect()  # one row per dimension
    )
    seen = np.zeros(DIMENSIONS + 1, np.int64)
    for place, n in rows:
        seen[place] = n
    return seen[:-1], int(seen[-1])


def least_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct (order, text_key) of each lang, ``order`` being a
    hash. A task hands on no more than that, once before and once after rows are
    dealt by ``order``. Counts of 256 ranges then tell which ranges the first
    ``most`` lie in, and the window at the end sorts those alone. Runs jobs."""
    def least(batches):
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code = lang.indices.to_numpy()
            pair = np.empty(batch.num_rows, [("order", np.int64), ("text_key", np.int64)])
            pair["order"], pair["text_key"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                known = best.get(name, pair[:0])
                best[name] = np.unique(np.concatenate([known, pair[code == k]]))[:most]
        for name, pair in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(pair), pa.string()), pa.array(pair["order"]), pa.array(pair["text_key"])],
                ["lang", "order", "text_key"])

    schema = "lang string, order long, text_key long"
    dealt = staged(rows.mapInArrow(least, schema).repartition("order").mapInArrow(least, schema)
                   .withColumn("range", F.shiftright("order", 56)), "language-hashes")
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        dealt.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter(F.col("before") < most).select("lang", "range")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text_key"))
    near = dealt.join(small_side(ranges), ["lang", "range"], "left_semi").drop("range")
    return near.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def _cluster(group: pd.DataFrame, centroids: int) -> pd.DataFrame:
    group = group.sort_values(["order", "vector"])
    points = np.stack([np.frombuffer(v, np.float32) for v in group["vector"]])
    # farthest-first start, then spherical k-means
    chosen = [0]
    closest = points @ points[0]
    while len(chosen) < min(centroids, len(points)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(1)
        sums = np.stack([points[own == k].sum(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    near = (points @ centres.T).max(1)
    least = REJECT_SHARE * float(np.quantile(near, 0.01))
    return pd.DataFrame({
        "lang": group["lang"].iloc[0], "vector": [c.astype(np.float32).tobytes() for c in centres], "least": least,
    })


def fit_languages(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS,
) -> LanguageModel:
    """Model from the rows of ``docs`` for which ``learn`` holds and text and
    language are there. Without such rows it knows no language. The sample of a
    language is its rows of the least hashes of the id, then of the text (rows
    without an id, or with the same one); repeated rows count once."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    with text_batches(docs.sparkSession):
        seen, n = _document_frequencies(rows)
    weights = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    keyed = rows.select(
        "lang", F.xxhash64("doc_id", F.lit(7)).alias("order"), text_key(F.col("text")).alias("text_key"), "text")
    keys = staged(least_rows(keyed.drop("text"), sample_per_language), "language-sample")
    sample = keyed.join(small_side(keys), ["lang", "order", "text_key"])

    def vectorise(batches):
        for batch in released(batches):
            out = [v.tobytes() for _, _, c in gram_counts(batch.column(3)) for v in vectors(c, weights)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.binary())], ["lang", "order", "text_key", "vector"])

    clusters = (
        sample.mapInArrow(vectorise, "lang string, order long, text_key long, vector binary")
        .dropDuplicates(["lang", "order", "text_key"])  # repeated rows count once, so a group stays bounded
        .groupBy("lang").applyInPandas(lambda g: _cluster(g, centroids), "lang string, vector binary, least double")
    )
    with text_batches(docs.sparkSession):
        fitted = clusters.orderBy("lang", "vector").collect()  # languages times centroids
    centres = np.stack([np.frombuffer(r["vector"], np.float32) for r in fitted]) if fitted else np.zeros((0, DIMENSIONS), np.float32)
    return LanguageModel(weights, [r["lang"] for r in fitted], centres, np.array([r["least"] for r in fitted]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "_language") -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of lang_pred, score, rejected.

    ``score`` is the cosine to the nearest centroid. A text that is missing or has
    no letter is ``und`` with score 0 and rejected; one whose similarity is below
    the centroid's least is rejected too, but keeps the nearest language. Repeated
    rows get the same result; an empty table gives none.
    """
    names = np.array([*model.languages, "und"], dtype=object)

    def predict(batches):
        for batch in released(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            n = batch.num_rows
            pick, score = np.full(n, len(names) - 1), np.zeros(n)
            if len(model.languages):
                for lo, hi, counts in gram_counts(texts):
                    near = vectors(counts, model.weights) @ model.centroids.T
                    pick[lo:hi], score[lo:hi] = near.argmax(1), near.max(1)
            letters = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}")
            letters = letters.to_numpy(zero_copy_only=False)
            pick = np.where(letters, pick, len(names) - 1)
            score = np.where(letters, np.clip(score, 0, 1), 0.0)
            rejected = ~letters | (score < np.append(model.least, 2.0)[pick])
            found = pa.StructArray.from_arrays(
                [pa.array(names[pick], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                ["lang_pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    result = T.StructType(docs.schema.fields + [T.StructField(out, T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())]))])
    return docs.mapInArrow(predict, result)


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, model learnt from their own
    ``lang`` where it is there."""
    model = fit_languages(docs, ~held_out(F.col("doc_id"), 5, 0))
    known = identify(docs, model).filter(~F.col("_language.rejected")).drop("_language")
    with text_batches(docs.sparkSession):
        return staged(known, "identified")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 5, 0)
    model = fit_languages(docs, ~test)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", test.alias("held_out"), "_language.lang_pred", "_language.score", "_language.rejected")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
