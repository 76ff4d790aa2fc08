"""Packing of documents into sequences along a space-filling curve.

Hashed word vectors are projected to a few dimensions and the documents sorted by
the place of their direction on a Hilbert curve, so neighbours in a sequence are
alike. The documents' tokens then form one stream in that order, cut at multiples
of the sequence length: only the very last sequence is not full. Range partitions
sort the small rows (key, length); each gets its place in the stream from the
totals of the partitions before it, one number per partition.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.writers import staged
from .common import released, small_side, table, text_batches
from .words import hashed_documents, slices, text_buffer

SEQUENCE = 4096
DIMENSIONS = 4
BITS = 12  # of the curve, per dimension
END = 2  # id after each document
CACHED_WORDS = 400_000
SLICE_BYTES = 4 << 20  # of texts encoded together


# The tokenizer's own split of lower-case text, and its characters for bytes: printable
# ones stand for themselves, the others for code points from 256 on.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")
MARKS = "".join(sorted(set(string.punctuation) - {"'"}))  # letters and then marks are two pieces


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, ASCII letters lowered; each place's word as its
    number among them; and each text's first place (one more than texts)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    coded = words.flatten().dictionary_encode()
    first = words.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(), first - first[0]


def _gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``at``-th stretches of ``values``, which holds stretches of these sizes."""
    own = sizes[at]
    begin = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(own) - own)
    return values[np.repeat(begin, own) + np.arange(own.sum())]


class WordEncoder:
    """Token ids of texts for a tokenizer that drops white space and lower-cases:
    a text's ids are those of its words, which are remembered as Arrow strings and
    one array of ids: some 30 bytes a word, as workers keep them between stages.

    Only ASCII letters are lowered before the look-up. Words of Latin letters and
    marks go straight to the tokenizer's merges, all others through the whole
    tokenizer, as do texts with the marks of special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, pieces = self.merges.tokenize, {}
        ids, sizes = [], []
        for word in words:
            before = len(ids)
            core = word.rstrip(MARKS)
            if core.isalpha() and len(core.encode("latin-1", "ignore")) == len(core):
                parts = (core.lower(), word[len(core):]) if len(core) < len(word) else (core.lower(),)
            elif word and not PLAIN.fullmatch(word):
                ids += self._whole(word)
                parts = ()
            else:
                parts = PIECE.findall(word.lower())
            for p in parts:
                found = pieces.get(p)
                if found is None:
                    shown = p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS)
                    found = pieces[p] = [t.id for t in tokenize(shown)]
                ids += found
            sizes.append(len(ids) - before)
        return np.array(ids, "<u4"), np.array(sizes, np.int32)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and how many each has.
        Where more words than may be remembered came up, only these are kept."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(self.words) + len(new) > CACHED_WORDS:
            old = np.flatnonzero(at >= 0)
            self.words, self.ids = self.words.take(pa.array(at[old])), _gathered(self.ids, self.sizes, at[old])
            self.sizes = self.sizes[at[old]]
            at[old] = np.arange(len(old))
        if len(new):
            fresh = words.take(pa.array(new))
            ids, sizes = self._new(fresh.to_pylist())
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
        return _gathered(self.ids, self.sizes, at), self.sizes[at]

    def encode_words(self, texts: pa.Array, split: tuple, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with ``end`` after each, one text after the other, and how
        many each has; ``split`` holds the distinct words of the texts."""
        words, at, first = split
        ids, sizes = self.word_ids(words)
        ids, sizes = np.append(ids, np.array(end, "<u4")), np.append(sizes, np.int32(len(end)))
        at = np.insert(at, first[1:], len(words))
        total = np.append(0, np.cumsum(sizes[at], dtype=np.int64))
        ids, n = _gathered(ids, sizes, at), np.diff(total[first + np.arange(len(first))])
        marked = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(marked):
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in marked:
                parts[i] = np.array(self._whole(texts[i].as_py()) + end, "<u4")
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        column = pa.array(texts, pa.string())
        ids, n = self.encode_words(column, distinct_words(column), [])
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def _projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 12, dimensions))


def directions(split: tuple, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Projected word vector of each text, scaled to length 1; 0 without words.
    ``split`` holds the distinct words of the texts."""
    words, at, first = split
    rows = np.zeros((len(words), dimensions))  # the empty word stays 0
    for lo, _, hashes, firsts, _ in hashed_documents(words):
        rows[lo + np.flatnonzero(np.diff(firsts))] = _projection(dimensions)[(hashes >> np.uint64(52)).astype(np.int64)]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.stack([np.bincount(owner, rows[at, d], len(first) - 1) for d in range(dimensions)], 1)
    norm = np.linalg.norm(out, axis=1)
    return out / np.maximum(norm, 1e-12)[:, None]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of points in [-1, 1]^d on the Hilbert curve over 2^bits cells a side."""
    cells = np.clip((points + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64).T.copy()
    d = len(cells)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, coarse to fine
        bit, below = 1 << b, (1 << b) - 1
        for i in range(d):
            set_ = (cells[i] & bit) != 0
            swap = np.where(set_, 0, (cells[0] ^ cells[i]) & below)
            cells[0] ^= np.where(set_, below, swap)
            cells[i] ^= swap
    for i in range(1, d):  # Gray code across the dimensions
        cells[i] ^= cells[i - 1]
    turn = np.zeros_like(cells[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((cells[d - 1] >> b) & 1, (1 << b) - 1, 0)
    cells ^= turn
    key = np.zeros(cells.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((cells[i] >> b) & 1)
    return key


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def encode(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in released(batches):
            for lo, hi in slices(text_buffer(batch.column(1))[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).fill_null("")
                split = distinct_words(texts)
                ids, n = word_encoder(tokenizer).encode_words(texts, split, [end_id])
                keys = hilbert_keys(directions(split))
                short = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                ends = np.append(0, np.cumsum(n)) * short.itemsize
                uid = (task << 40) + row + np.arange(len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), part.column(0), pa.array(keys), pa.array(n, pa.int64()),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(short)]).cast(pa.binary())],
                    ["uid", "doc_id", "key", "n", "ids"])

    pair = docs.select("doc_id", "text")
    schema = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("doc_id", pair.schema["doc_id"].dataType),
        T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return pair.mapInArrow(encode, schema)


def _places(encoded: DataFrame) -> DataFrame:
    """uid and place in the stream of each document's first token."""
    def run(batches):
        task, total = TaskContext.get().partitionId(), 0
        for batch in released(batches):
            n = batch.column(1).to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), task)), pa.array(ends - n), batch.column(1)], ["uid", "part", "at", "n"])

    order = ["key", "doc_id", "uid"]
    ranged = encoded.select("uid", "n", "key", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    local = staged(ranged.select("uid", "n").mapInArrow(run, "uid long, part long, at long, n long"), "curve")
    totals = local.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    begin, rows = 0, []
    for r in totals:
        rows.append((r["part"], begin))
        begin += r["n"]
    begins = encoded.sparkSession.createDataFrame(rows, "part long, begin long")
    return local.join(F.broadcast(begins), "part").select("uid", (F.col("begin") + F.col("at")).alias("place"))


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Every token of every row, and the end id after it, lies in one piece; ``ids``
    holds a piece's ids as little-endian unsigned 32-bit numbers. A missing or
    empty text is the end id alone. Documents of the same key stand by id, then as
    read; a repeated row is packed again. Further columns are ignored, and an
    empty table has no pieces. ``tokenizer`` names a tokenizer file on every
    machine; its tokens must not depend on white space.
    """
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        encoded = staged(_encoded(pair, tokenizer, end_id), "encoded")
    placed = encoded.select("uid", "doc_id", "n", "ids").join(small_side(_places(encoded)), "uid")

    def cut(batches):
        for batch in released(batches):
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                out = {k: [] for k in ("row", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
                for row, (n, ids, place) in enumerate(zip(*(rows.column(i).to_pylist() for i in (1, 2, 3)))):
                    ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                    start = 0
                    while start < n:
                        offset = (place + start) % sequence
                        length = min(n - start, sequence - offset)
                        for k, v in zip(out, (row, start, length, n, (place + start) // sequence, offset,
                                              ids[start: start + length].tobytes())):
                            out[k].append(v)
                        start += length
                arrays = [pa.array(out[k], pa.int64()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(out["row"], pa.int64())), *arrays, pa.array(out["ids"], pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = T.StructType([pair.schema["doc_id"]] + [
        T.StructField(k, T.LongType()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")
    ] + [T.StructField("ids", T.BinaryType())])
    return placed.select("doc_id", "n", "ids", "place").mapInArrow(cut, schema)


def packed_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
