"""Collocations of two and three words by sampling with a negative border.

A sample of the documents proposes words and pairs of words. The first pass over
all documents counts every word; every pair of two proposed words, which are the
proposed pairs and their negative border; and every triple of two proposed pairs.
All of these counts are exact. Words that turn out frequent without having been
proposed, and pairs of the border that do, are the failures: a further pass counts
what they open up, pairs of frequent words and triples of frequent pairs not
counted before, and so on until a pass finds no new frequent pair. Since the parts
of a frequent phrase are frequent, nothing is missed.

What is proposed or frequent reaches the tasks as a bitmap of hashes of fixed
size. Two phrases on one bit only mean that one more phrase is counted, exactly
like the others; counting is by the phrase itself. Each task adds up a few MB of
text before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.writers import staged
from .common import released, table, text_batches
from .exchange import chunks, run_starts
from .merkle_manifest import placed
from .words import lower_ascii, mix, span_hashes, running, slices, text_buffer, word_bounds

CHUNK_BYTES = 5 << 20
BITS = 27  # of a bitmap, 16 MB; more bits mean fewer needless counts
RATE = 0.1  # of the documents in the sample
PROPOSED = 2  # occurrences in the sample; rarer frequent phrases are left to the further passes
THRESHOLD = 10
TOP = 2_000
_GAP = np.zeros(256, bool)
_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP[[9, 32]] = True
_GAP |= _CUT
_STEP = np.uint64(0xD1342543DE82EF95)
_BLOCK = 19  # bits of a place within a block of a bitmap


class Chunk:
    """Words of some documents: lower-case bytes with one space after each word,
    start and end of each word there, its hash with that of its language, and
    whether it is followed by another one or two of the same piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        data, offsets = text_buffer(texts)
        parts = [self._words(data, offsets, lo, hi, langs) for lo, hi in slices(offsets)]
        self.joined = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
        shift = np.cumsum([0, *[len(p[0]) for p in parts]])
        self.starts, self.ends = (np.concatenate([p[i] + s for p, s in zip(parts, shift)]) if parts else np.zeros(0, np.int64)
                                  for i in (1, 2))
        self.hashes, self.lang, self.next = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
                                             for i, t in ((3, np.uint64), (4, np.int64), (5, bool)))

    @staticmethod
    def _words(data, offsets, lo, hi, langs):
        part = lower_ascii(data[offsets[lo]: offsets[hi]])
        at = offsets[lo: hi + 1] - offsets[lo]
        starts, ends, firsts = word_bounds(part, at, _GAP)
        lang = np.repeat(langs[lo:hi], np.diff(firsts))
        hashes = mix(span_hashes(running(part), starts, ends) + mix(lang.astype(np.uint64) + np.uint64(1)))
        follows = np.zeros(len(starts), bool)
        if len(starts) > 1:
            cuts = np.cumsum(_CUT[part], dtype=np.int64)  # of starts and ends - 1 none is a cut
            follows[:-1] = cuts[starts[1:]] == cuts[ends[:-1] - 1]
            inner = firsts[1:-1]
            follows[inner[(inner > 0) & (inner < len(starts))] - 1] = False
        length = ends - starts
        new = np.cumsum(length + 1) - length - 1
        place = np.repeat(starts - new, length + 1) + np.arange(int(length.sum()) + len(length))
        joined = np.append(part, np.uint8(32))[place]
        joined[new + length] = 32
        return joined, new, new + length, hashes, lang, follows

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each phrase of ``size`` words, and its hash."""
        n = len(self.hashes)
        ok = np.ones(max(0, n - size + 1), bool)
        for j in range(size - 1):
            ok &= self.next[j: j + len(ok)]
        first = np.flatnonzero(ok)
        h = self.hashes[first]
        for j in range(1, size):
            h = mix(h * _STEP + self.hashes[first + j])
        return first, h


class Bitmap:
    """A bitmap sent to the tasks compressed, opened once in each."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self._sent, self._open = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(bits.tobytes())), None

    def __getstate__(self):
        return {"_sent": self._sent, "_open": None}

    def bits(self) -> np.ndarray:
        if self._open is None:
            self._open = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._sent.value), np.uint8)
        return self._open

    def drop(self) -> None:
        self._sent.destroy()


def _bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summed(chunk: Chunk, size: int, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases: first word and occurrences. Equal are those of equal
    hash and equal hash of the last word under another mixing."""
    other = mix(chunk.hashes[first + size - 1] ^ (h >> np.uint64(7)))
    order = np.argsort(h, kind="stable")
    a, b = h[order], other[order]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return first[order[begin]], np.diff(np.append(begin, len(order)))


def _texts(chunk: Chunk, size: int, first: np.ndarray) -> pa.Array:
    starts, ends = chunk.starts[first], chunk.ends[first + size - 1]
    to = np.cumsum(ends - starts)
    place = np.repeat(starts - np.append(0, to[:-1])[: len(to)], ends - starts) + np.arange(int(to[-1]) if len(to) else 0)
    offsets = np.append(0, to).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(chunk.joined[place]))


Taken = Callable[[Chunk, int], tuple[np.ndarray, np.ndarray]]


def _langs(column: pa.Array) -> tuple[np.ndarray, dict[int, str]]:
    """Hash of each row's language, and the languages by hash."""
    names = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    data, offsets = text_buffer(names.dictionary)
    hashes = mix(span_hashes(running(data), offsets[:-1], offsets[1:])).view(np.int64)
    return hashes[names.indices.to_numpy(zero_copy_only=False)], dict(zip(hashes.tolist(), names.dictionary.to_pylist()))


def _counts(docs: DataFrame, sizes: tuple[int, ...], taken: Taken) -> DataFrame:
    """lang, phrase, n of the phrases ``taken`` picks, over all ``docs`` (lang,
    text). With words (size 1), the empty phrase counts all of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1, CHUNK_BYTES):
            langs, name_of = _langs(part.column(0))
            chunk = Chunk(part.column(1), langs)
            if 1 in sizes and len(chunk.lang):
                own, n = np.unique(chunk.lang, return_counts=True)
                yield _rows(pa.array([name_of[x] for x in own.tolist()]), pa.array([""] * len(own)), n)
            for size in sizes:
                first, n = _summed(chunk, size, *taken(chunk, size))
                for at in range(0, len(first), 1 << 17):
                    to = at + (1 << 17)
                    own, back = np.unique(chunk.lang[first[at:to]], return_inverse=True)
                    lang = pa.array([name_of[x] for x in own.tolist()], pa.string()).take(pa.array(back))
                    yield _rows(lang, _texts(chunk, size, first[at:to]), n[at:to])

    def freed(batches):
        return released(count(batches))

    # a task has added up already: its rows are shuffled as they are, and grouped after
    sent = docs.mapInArrow(freed, "lang string, phrase string, n long").repartition("lang", "phrase")
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return sent.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).select(
        "lang", F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).alias("size"), "phrase", "n")


def _rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _bitmap(phrases: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bits of the hashes of all phrases of ``size`` words: put together in blocks of 64 KB, 2^bits / 8 bytes for
    any number of phrases."""
    def block(group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << _BLOCK, np.uint8)
        for part in group["places"]:
            held[np.frombuffer(part, np.uint32)] = 1
        return pd.DataFrame({"block": group["block"].iloc[:1], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    def split(batches):
        for batch in batches:
            _, h = Chunk(batch.column(1), _langs(batch.column(0))[0]).phrases(size)
            at = np.unique(h & np.uint64((1 << bits) - 1))
            number = (at >> np.uint64(_BLOCK)).astype(np.int64)
            cut = run_starts(number)
            low = (at & np.uint64((1 << _BLOCK) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(number[cut]), pa.array([low[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(low)))], pa.binary()),
            ], ["block", "places"])

    sent = phrases.filter(F.col("size") == size).select("lang", "phrase").mapInArrow(split, "block long, places binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << _BLOCK) // 8
    for row in sent.groupBy("block").applyInPandas(block, "block long, bits binary").collect():  # 2^bits / 8 bytes
        out[row["block"] * size: (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, rate: float = RATE, proposed: int = PROPOSED, bits: int = BITS,
                  lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, int]:
    """lang, size, phrase, n of all phrases of one to three words that occur
    ``threshold`` times in their language, and size 0 for all words of it; and the
    number of passes over all documents. ``rate``, ``proposed`` and ``bits`` change
    the work, never the result."""
    spark = docs.sparkSession
    pair = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def maps_of(phrases: DataFrame) -> list[Bitmap]:
        return [Bitmap(spark, _bitmap(phrases, k, bits)) for k in (1, 2)]

    def pairs_of(maps: list) -> Taken:
        def taken(chunk: Chunk, size: int):
            """Phrases whose parts are all in a pair of bitmaps (words, pairs), the
            last one, and not all in an earlier one."""
            first, h = chunk.phrases(size)
            if size == 1 or not len(first):
                return first, h
            part = chunk.hashes if size == 2 else _spread(chunk)
            fresh = np.zeros(len(first), bool)
            for number, maps_ in enumerate(maps):
                held = _bit(maps_[size - 2].bits(), part)
                both = held[first] & held[first + 1]
                fresh = both if number == 0 else both & ~seen
                seen = both if number == 0 else seen | both
            return first[fresh], h[fresh]
        return taken

    with text_batches(spark):
        drawn = pair.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_000)) < int(rate * 1_000_000))
        sample = staged(_counts(drawn, (1, 2), lambda chunk, size: chunk.phrases(size)).filter(F.col("n") >= proposed), "sample")
        maps = [maps_of(sample)]
        found = staged(_counts(pair, (1, 2, 3), pairs_of(maps)).filter((F.col("n") >= threshold) | (F.col("size") == 0)), "counts")
        passes = 1
        while True:
            # words are known after the first pass, pairs after the second
            maps.append(maps_of(found))
            sizes = (2, 3) if passes == 1 else (3,)
            more = staged(_counts(pair, sizes, pairs_of(maps)).filter(F.col("n") >= threshold), "counts")
            found, passes = found.unionByName(more), passes + 1
            if more.filter("size = 2").isEmpty():
                break
        for bitmap in sum(maps, []):
            bitmap.drop()  # all counts are staged
        return found, passes


def _spread(chunk: Chunk) -> np.ndarray:
    """Hash of the pair that starts at each word; of no pair, zero."""
    first, h = chunk.phrases(2)
    out = np.zeros(len(chunk.hashes), np.uint64)
    out[first] = h
    return out


def collocations(docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    ``a`` counts a phrase of two or three words, ``l`` and ``r`` the parts of its
    lowest-scoring cut (the first of equal ones), ``n`` all words of the language;
    the score is floor(1,000,000 a a / (l r)), in exact decimals. Words are split at
    spaces and tabs, in ASCII lower case, and phrases stay within pieces split at
    ``.,;:!?`` and line ends. A pair is left out where a triple with it occurs at
    least half as often. Ranks are by score, then a (both descending), then phrase
    in byte order. A missing language is ``und``, a missing text empty; repeated
    rows count again; ids and further columns are not used. An empty table, or one
    without frequent phrases, gives no rows.
    """
    counts, _ = phrase_counts(docs, threshold, **options)
    part = counts.select("lang", "phrase", "n")
    total = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ")
    phrases = counts.filter("size >= 2").withColumn("words", words)
    cuts = phrases.select(
        "lang", "size", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select(
        "lang", "size", "phrase", "words", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "left", "n": "l"}), ["lang", "left"]) \
        .join(part.withColumnsRenamed({"phrase": "right", "n": "r"}), ["lang", "right"])
    ratio = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(13,0)) * cast(a as decimal(13,0)))) "
                   "div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    scored = cuts.withColumn("score", ratio).groupBy("lang", "size", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    # the most frequent triple around each pair
    inner = phrases.filter("size = 3").select(
        "lang", "n", F.explode(F.array(F.concat_ws(" ", F.get("words", 0), F.get("words", 1)),
                                       F.concat_ws(" ", F.get("words", 1), F.get("words", 2)))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        (F.col("size") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # ranges of each language's order, no language in one task
    ranked = placed(flat.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), "lang", ["_score", "_a", "phrase"])
    ranked = ranked.drop("n").withColumn("rank", F.col("place") + 1)
    return ranked.filter(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
i AS (SELECT lang, pid, unnest(words) AS w, generate_subscripts(words, 1) AS j FROM w),
t AS (SELECT lang, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM i WINDOW s AS (PARTITION BY pid ORDER BY j)),
f AS (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS n FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS MATERIALIZED (SELECT lang || ':' || phrase AS key, n FROM f WHERE n >= 10),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2 AND n >= 10),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(words[1:j], ' ') AS lft, array_to_string(words[j + 1:], ' ') AS rgt
         FROM c, unnest(range(1, k)) AS t(j)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, j, x.n AS l, y.n AS r,
    CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cuts JOIN g x ON x.key = cuts.lang || ':' || lft JOIN g y ON y.key = cuts.lang || ':' || rgt),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, q AS phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS q FROM c WHERE k = 3)
  GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase)
         WHERE k = 3 OR longer.a IS NULL OR 100 * longer.a < 50 * low.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}
