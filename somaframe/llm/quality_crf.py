"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its node potential is linear in features of the line
and its two neighbours; a 2 x 2 table scores neighbouring labels. The field is
fitted on a bounded sample of labelled documents, a document's label standing for
each of its lines. Forward-backward gives every line's marginal; their mean by
line length is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table
from .language_id import held_out
from .words import slices, text_buffer, word_bounds, word_hashes

SAMPLE_DOCUMENTS = 3000
SAMPLE_LINES = 200_000
LONGEST = 2_000  # lines of a sampled document; each step of the fit walks along the longest
STEPS = 250
RATE = 0.05
PENALTY = 1e-3

_CLASS = np.full(256, 6, np.uint8)  # other marks
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "!", "|")):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[[ord(c) for c in "#$%&*"]] = 7
_CLASS[128:] = 8
OWN = 12
WIDTH = 3 * OWN + 3


def line_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of documents: first and last, a row of features for each line,
    line lengths in bytes, and lines per document (none in an empty text)."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        filled = np.flatnonzero(np.diff(at))
        breaks = np.flatnonzero(part == 10) + 1
        # an entry for the start of each document with text and after each line feed in it
        starts = np.concatenate([at[filled], breaks])
        owner = np.concatenate([filled, np.searchsorted(at, breaks - 1, "right") - 1])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.append(starts[1:] - 1, 0)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)] if len(owner) else np.zeros(0, bool)
        if len(owner):
            ends[last] = at[owner[last] + 1]
        size = (ends - starts).astype(np.float64)
        kind = _CLASS[part]
        counts = []
        for c in range(9):
            sums = np.zeros(len(part) + 1, np.int32)
            np.cumsum(kind == c, out=sums[1:])
            counts.append(sums[ends] - sums[starts])
        upper, lower, digits, blanks, shouts, bars, marks, symbols, high = counts
        first_byte, end_byte, _ = word_bounds(part, at)
        hashes = word_hashes(part, first_byte, end_byte)
        line = np.searchsorted(starts, first_byte, "right") - 1
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        words = np.bincount(line, minlength=len(starts))
        repeats = np.bincount(line[same], minlength=len(starts))
        n = np.maximum(size, 1)
        own = np.stack([
            upper / (upper + lower + 1.0), symbols / n, shouts / n, bars / n, digits / n, marks / n, high / n,
            blanks / n, repeats / np.maximum(words, 1), np.log1p(size) / 10, np.log1p(words) / 8,
            np.minimum((size - blanks) / np.maximum(words, 1), 50) / 10,
        ], axis=1) if len(starts) else np.zeros((0, OWN))
        first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first], after[last] = 0, 0
        ones = np.ones((len(own), 1))
        rows = np.hstack([ones, own, before, after, first[:, None], last[:, None]])
        yield lo, hi, rows.astype(np.float32), size, np.bincount(owner, minlength=hi - lo)


class Chains:
    """Lines of many documents laid out by place in the document, so that one
    array operation advances all documents: longest documents first."""

    def __init__(self, lines_of: np.ndarray):
        self.order = np.argsort(-lines_of, kind="stable")
        length = lines_of[self.order]
        steps = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(steps), "left")  # documents with a line at each place
        self.begin = np.append(0, np.cumsum(self.active))
        first_line = np.append(0, np.cumsum(lines_of))[:-1][self.order]
        self.lines = np.empty(self.begin[-1], np.int64)  # original line at each cell
        for t, n in enumerate(self.active):
            self.lines[self.begin[t]: self.begin[t] + n] = first_line[:n] + t
        self.steps = steps

    def cells(self, t: int) -> slice:
        return slice(self.begin[t], self.begin[t + 1])

    def run(self, nodes: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward sums of each cell and label, and the log
        partition of each document, in the order of ``order``. ``nodes``: scores
        of the label good by cell; bad scores 0."""
        score = np.stack([np.zeros_like(nodes), nodes], 1)
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, self.steps):
            n = self.active[t]
            earlier = forward[self.begin[t - 1]: self.begin[t - 1] + n]
            forward[self.cells(t)] += np.logaddexp(earlier[:, :1] + table_[0], earlier[:, 1:] + table_[1])
        total = np.zeros(len(self.order))
        for t in range(self.steps - 1, -1, -1):
            here, n = self.cells(t), self.active[t]
            later = self.active[t + 1] if t + 1 < self.steps else 0
            if later:
                ahead = score[self.cells(t + 1)] + backward[self.cells(t + 1)]
                for label in (0, 1):
                    backward[self.begin[t]: self.begin[t] + later, label] = np.logaddexp(
                        table_[label, 0] + ahead[:, 0], table_[label, 1] + ahead[:, 1])
            ended = forward[here][later:n]
            total[later:n] = np.logaddexp(ended[:, 0], ended[:, 1])
        return forward, backward, total

    def by_cell(self, of_document: np.ndarray) -> np.ndarray:
        """A value of each document, in the order of ``order``, at each of its cells."""
        return np.concatenate([of_document[:n] for n in self.active]) if self.steps else np.zeros(0)


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    table: np.ndarray
    prior: float  # share of good documents, the score of a text without lines


def train(rows: np.ndarray, lines_of: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Maximum likelihood with a small penalty, by Adam over the whole sample."""
    mean, spread = rows.mean(0), rows.std(0) + 1e-6
    mean[0], spread[0] = 0, 1
    scaled = (rows - mean) / spread
    chains = Chains(lines_of)
    x = scaled[chains.lines]
    gold = chains.by_cell(labels[chains.order].astype(np.float64))
    stays = np.zeros((2, 2))
    steps_of = lines_of - 1
    for label in (0, 1):
        stays[label, label] = steps_of[(labels == label) & (lines_of > 0)].sum()
    theta = np.zeros(x.shape[1] + 4)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(x))
    for step in range(1, STEPS + 1):
        weights, table_ = theta[:-4], theta[-4:].reshape(2, 2)
        nodes = x @ weights
        forward, backward, total = chains.run(nodes, table_)
        whole = chains.by_cell(total)
        good = np.exp(forward[:, 1] + backward[:, 1] - whole)
        pairs = np.zeros((2, 2))
        for t in range(1, chains.steps):
            k = chains.active[t]
            earlier = forward[chains.begin[t - 1]: chains.begin[t - 1] + k]
            here = chains.cells(t)
            ahead = backward[here] + np.stack([np.zeros(k), nodes[here]], 1)
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a, b] += np.exp(earlier[:, a] + table_[a, b] + ahead[:, b] - total[:k]).sum()
        slope = np.concatenate([x.T @ (gold - good), (stays - pairs).ravel()]) / n - PENALTY * theta
        moment = 0.9 * moment + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        theta = theta + RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), float(labels.mean()))


def score_lines(model: QualityModel, rows: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Marginal probability of good of each line."""
    chains = Chains(lines_of)
    nodes = (((rows - model.mean) / model.spread) @ model.weights)[chains.lines]
    forward, backward, total = chains.run(nodes, model.table)
    good = np.empty(len(rows))
    good[chains.lines] = np.exp(forward[:, 1] + backward[:, 1] - chains.by_cell(total))
    return good


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_documents: int = SAMPLE_DOCUMENTS, sample_lines: int = SAMPLE_LINES, longest: int = LONGEST,
) -> QualityModel | None:
    """Model from a sample of ``labels`` (doc_id, quality): of the first
    ``sample_documents`` in the order of a hash of their id, each whole document of
    at most ``longest`` lines that the rest of ``sample_lines`` has room for; others
    are passed over.
    Scoring takes all lines. Labels without a document, and documents without
    lines, teach nothing; without any example there is no model."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id")).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_documents)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # sample_documents rows

    def extract(batches):
        for batch in batches:
            rows_of, counts_of = [], []
            for _, _, rows, _, lines_of in line_features(batch.column(2)):
                cut = np.append(0, np.cumsum(lines_of))
                rows_of += [rows[a:b].tobytes() if b - a <= longest else b"" for a, b in zip(cut[:-1], cut[1:])]
                counts_of += lines_of.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(counts_of, pa.int64()), pa.array(rows_of, pa.binary())],
                ["doc_id", "quality", "n", "rows"])

    shaped = sample.mapInArrow(extract, "doc_id long, quality long, n long, rows binary")
    found, lines = [], 0
    for r in shaped.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").toLocalIterator():
        if r["n"] > longest or lines + r["n"] > sample_lines:
            continue
        lines += r["n"]
        if r["n"]:
            found.append(r)
    if not found:
        return None
    rows = np.concatenate([np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH) for r in found]).astype(np.float64)
    return train(rows, np.array([r["n"] for r in found]), np.array([int(r["quality"] > 0) for r in found]))


def quality_scores(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, n_lines, bad_lines.

    ``score`` is the mean of the lines' probability of good, by line length in
    bytes. A missing or empty text gets the share of good documents in the sample
    (0.5 without a model); one of line feeds only weighs its lines alike. Further
    columns are ignored, repeated rows give repeated results.
    """
    def predict(batches):
        for batch in batches:
            n = batch.num_rows
            score = np.full(n, 0.5 if model is None else model.prior)
            lines, bad = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, rows, size, lines_of in line_features(batch.column(1)):
                lines[lo:hi] = lines_of
                if model is None or not len(rows):
                    continue
                good = score_lines(model, rows.astype(np.float64), lines_of)
                owner = np.repeat(np.arange(hi - lo), lines_of)
                blank = np.bincount(owner, size, hi - lo) == 0
                weight = np.where(blank[owner], 1.0, size)
                mean = np.bincount(owner, good * weight, hi - lo) / np.maximum(np.bincount(owner, weight, hi - lo), 1e-12)
                score[lo:hi] = np.where(lines_of > 0, mean, score[lo:hi])
                bad[lo:hi] = np.bincount(owner, good < 0.5, hi - lo)
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(lines), pa.array(bad)],
                ["doc_id", "score", "predicted", "n_lines", "bad_lines"])

    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", pair.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("n_lines", T.LongType()),
        T.StructField("bad_lines", T.LongType()),
    ])
    return pair.mapInArrow(predict, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    test = held_out(F.col("doc_id"), 3, 1)
    model = fit_quality(docs, labels.filter(~test))
    return quality_scores(docs, model).withColumn("held_out", test).select(
        "doc_id", "held_out", "score", "predicted", "n_lines", "bad_lines")


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
