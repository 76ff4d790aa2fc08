"""Stupid-backoff scores of documents under the counts of all other documents.

The count tables are partitioned by word hash: a group holds the count of each of
its words and all pairs with one of them before. A document's pairs meet their
counts there, and the logarithms are summed by document; pairs that no other
document has go on to the group of their second word. Frequent words, of which a
bounded number can exist, would be hot groups: their counts go to all groups, and
their pairs are spread by both words.

Pairs travel as compressed columns, one row a task and group, each pair of a
document once. Sums come back as one row a task and group.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import release, table
from .exchange import chunks, pack_sorted, run_starts, squeeze, unpack_sorted, unsqueeze, used_places
from .words import hashed_documents, mix

BACKOFF = 0.4
UNSEEN = 0.5  # count of a word that no other document has
CHUNK_BYTES = 8 << 20
GROUP_PAIRS = 1_500_000
SLICE_PAIRS = 1 << 18  # worked through at once within a group
BEGIN = np.uint64(1)  # stands before the first word
_PLACE = np.uint64(0xD1342543DE82EF95)


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    """48-bit word ids (from 2 on) and the document of each."""
    words, owner = [], []
    for lo, hi, hashes, firsts, _ in hashed_documents(texts, lower=True):
        words.append(np.maximum(hashes >> np.uint64(16), np.uint64(2)))
        owner.append(np.repeat(np.arange(lo, hi), np.diff(firsts)))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(owner)


def _counted(docs: DataFrame, pick) -> DataFrame:
    """word and n over all documents, of the words ``pick`` takes in each task. The
    words 0 and 1 stand for all words and for all documents with words."""
    def count(batches):
        for part in chunks(batches, 1, CHUNK_BYTES):
            words, owner = _words(part.column(1))
            value, n = np.unique(words, return_counts=True)
            taken = pick(value, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([[0, 1], value[taken].view(np.int64)])),
                pa.array(np.concatenate([[len(words), len(run_starts(owner))], n[taken]]))], ["word", "n"])

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending words with their exact counts: all with ``share`` of all words,
    the sum of all words (0) and of documents (1). At most 1 / share words can be
    that frequent; they are in at least one task."""
    rows = _counted(docs, lambda value, n: n >= share * n.sum()).collect()  # bounded by tasks / share
    total = sum(r["n"] for r in rows if r["word"] == 0)
    # a count from some tasks may be short by less than share / 2 of all
    maybe = np.array(sorted(r["word"] for r in rows if r["word"] > 1 and r["n"] >= share * total / 2), np.uint64)
    exact = {r["word"]: r["n"] for r in _counted(docs, lambda value, n: np.isin(value, maybe)).collect()}
    words = np.array(sorted(exact), np.uint64)
    return words, np.array([exact[int(w)] for w in words], np.int64)


_ROW = "grp long, kind int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["grp", "kind", "chunk", *"abcdef"]
PAIRS, COUNTS, DOCUMENTS, SUMS = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _lookup(words: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of each wanted word and whether it is in the ascending table."""
    if not len(words):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    return counts[at], words[at] == wanted


def _group_of(chunk: int, groups: int) -> int:
    """Group of a chunk's rows; its number alone is the same in every partition."""
    return int(mix(np.array([chunk], np.uint64))[0] % np.uint64(groups))


def _sent(docs: DataFrame, groups: int, hot: np.ndarray) -> DataFrame:
    def send(batches):
        task = TaskContext.get().partitionId() << 24
        for number, part in enumerate(chunks(batches, 1, CHUNK_BYTES)):
            release()
            chunk, n_docs = task + number, part.num_rows
            words, owner = _words(part.column(1))
            rows = [(_group_of(chunk, groups), DOCUMENTS, chunk, squeeze(part.column(0).to_numpy()),
                     squeeze(np.bincount(owner, minlength=n_docs).astype(np.int64)), *[None] * 4)]
            value, n = np.unique(words, return_counts=True)
            target = (value % np.uint64(groups)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            cut = run_starts(target[order])
            for a, b in zip(cut, np.append(cut[1:], len(order))):
                own = order[a:b]
                rows.append((int(target[own[0]]), COUNTS, chunk, pack_sorted(value[own]), squeeze(n[own].astype(np.uint32)), *[None] * 4))
            # own counts of each word, then each distinct pair of a document once
            place = owner.astype(np.uint64) * _PLACE
            _, back, own_n = np.unique(mix(words ^ mix(place)), return_inverse=True, return_counts=True)
            own_w = own_n[back] if len(words) else np.zeros(0, np.int64)
            first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
            before = np.append(BEGIN, words[:-1])[: len(words)]
            before[first] = BEGIN
            own_h = np.append(1, own_w[:-1])[: len(words)]
            own_h[first] = 1
            _, at, times = np.unique(mix(words ^ mix(before + place)), return_index=True, return_counts=True)
            h, w = before[at], words[at]
            target = (h % np.uint64(groups)).astype(np.int64)
            spread = np.isin(h, hot)
            target[spread] = (mix(h[spread] ^ mix(w[spread])) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((w, h, target))
            cut = run_starts(target[order])
            for a, b in zip(cut, np.append(cut[1:], len(order))):
                own = order[a:b]
                rows.append((int(target[own[0]]), PAIRS, chunk, pack_sorted(h[own]), squeeze(np.diff(w[own], prepend=np.uint64(0))),
                             squeeze(owner[at[own]].astype(np.uint32)), squeeze(times[own].astype(np.uint32)),
                             squeeze(own_h[at[own]].astype(np.uint32)), squeeze(own_w[at[own]].astype(np.uint32))))
            yield _batch(rows)

    return docs.mapInArrow(send, _ROW)


def _whole_runs(begin: np.ndarray, n: int, size: int):
    """Ranges of about ``size`` places that end where a run begins."""
    lo = 0
    while lo < n:
        after = int(np.searchsorted(begin, lo + size))
        hi = int(begin[after]) if after < len(begin) else n
        yield lo, hi
        lo = hi


def _sum_rows(names: np.ndarray, chunk: np.ndarray, doc: np.ndarray, logs: np.ndarray, missed: np.ndarray, groups: int) -> list[tuple]:
    """A row of sums for each chunk, given by its place in ``names``: of the documents
    that have pairs here, with their places."""
    rows, order = [], np.argsort(chunk, kind="stable")
    cut = run_starts(chunk[order])
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        own = order[a:b]
        c = int(names[chunk[own[0]]])
        used, at = used_places(doc[own], int(doc[own].max()) + 1)
        rows.append((_group_of(c, groups), SUMS, c, squeeze(np.bincount(at, logs[own])),
                     squeeze(np.bincount(at, missed[own]).astype(np.uint32)), squeeze(used.astype(np.uint32)), *[None] * 3))
    return rows


def _counts_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sent = group[group["kind"] == COUNTS]
    if not len(sent):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.concatenate([unpack_sorted(x) for x in sent["a"]])
    n = np.concatenate([unsqueeze(x, np.uint32) for x in sent["b"]]).astype(np.int64)
    order = np.argsort(words, kind="stable")
    begin = run_starts(words[order])
    return words[order][begin], np.add.reduceat(n[order], begin)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"grp": "int64", "kind": "int32", "chunk": "int64"})


def _meet_pairs(group: pd.DataFrame, groups: int, hot: np.ndarray, hot_n: np.ndarray) -> pd.DataFrame:
    rows = [tuple(r) for r in group[group["kind"] == DOCUMENTS].itertuples(index=False)]
    words, counts = _counts_of(group)
    grp = int(group["grp"].iloc[0])
    if len(words):
        if counts.max() >= 1 << 32:
            raise OverflowError("a word that frequent must be among the frequent ones")
        cool = ~np.isin(words, hot)
        rows.append((grp, COUNTS, -1, pack_sorted(words[cool]), squeeze(counts[cool].astype(np.uint32)), *[None] * 4))
    sent = group[group["kind"] == PAIRS]
    if len(sent):
        h = np.concatenate([unpack_sorted(x) for x in sent["a"]])
        w = np.concatenate([np.cumsum(unsqueeze(x, np.uint64), dtype=np.uint64) for x in sent["b"]])
        doc, times, own_h, own_w = (np.concatenate([unsqueeze(x, np.uint32) for x in sent[c]]) for c in "cdef")
        names, of_row = np.unique(sent["chunk"].to_numpy(), return_inverse=True)
        chunk = np.repeat(of_row.astype(np.int32), [len(unsqueeze(x, np.uint32)) for x in sent["c"]])
        key = mix(w ^ mix(h))
        order = np.argsort(key, kind="stable")
        begin = run_starts(key[order])
        del key, sent
        logs, on = np.zeros(len(order)), []
        missed = np.zeros(len(order), np.uint32)
        for lo, hi in _whole_runs(begin, len(order), SLICE_PAIRS):  # all of a pair are in one slice
            own, at = order[lo:hi], begin[np.searchsorted(begin, lo): np.searchsorted(begin, hi)] - lo
            n = times[own].astype(np.int64)
            others = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, hi - lo))) - n
            near, _ = _lookup(words, counts, h[own])
            far, is_hot = _lookup(hot, hot_n, h[own])
            hit = others > 0
            of_h = np.where(is_hot, far, near) - own_h[own]
            part = np.zeros(hi - lo)
            part[hit] = n[hit] * np.log(others[hit] / of_h[hit])
            n_w, known = _lookup(hot, hot_n, w[own])
            here = ~hit & known
            part[here] = n[here] * np.log(np.maximum(n_w[here] - own_w[own[here]].astype(np.int64), UNSEEN))
            logs[own], missed[own] = part, np.where(hit, 0, n)
            on.append(own[~hit & ~known])
        del h, own_h, order, begin
        rows += _sum_rows(names, chunk, doc, logs, missed, groups)
        del logs, missed
        release()
        on = np.concatenate(on) if on else np.zeros(0, np.int64)
        target = (w[on] % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((w[on], target))
        on, target = on[order], target[order]
        cut = run_starts(target)
        for a, b in zip(cut, np.append(cut[1:], len(on))):
            own = on[a:b]
            held, at = np.unique(chunk[own], return_inverse=True)
            rows.append((int(target[a]), PAIRS, -1, pack_sorted(w[own]), squeeze(names[held]), squeeze(at.astype(np.uint32)),
                         squeeze(doc[own].astype(np.uint32)), squeeze(times[own].astype(np.uint32)), squeeze(own_w[own].astype(np.uint32))))
    return _frame(rows)


def _back_off(group: pd.DataFrame, groups: int) -> pd.DataFrame:
    rows = [tuple(r) for r in group[group["kind"].isin([DOCUMENTS, SUMS])].itertuples(index=False)]
    words, counts = _counts_of(group)
    sent = group[group["kind"] == PAIRS]
    if len(sent):
        w = np.concatenate([unpack_sorted(x) for x in sent["a"]])
        chunk = np.concatenate([unsqueeze(n, np.int64)[unsqueeze(a, np.uint32)] for n, a in zip(sent["b"], sent["c"])])
        names, chunk = np.unique(chunk, return_inverse=True)
        chunk = chunk.astype(np.int32)
        doc, times, own_w = (np.concatenate([unsqueeze(x, np.uint32) for x in sent[c]]) for c in "def")
        del sent
        logs = np.zeros(len(w))
        for lo in range(0, len(w), SLICE_PAIRS):
            part = slice(lo, lo + SLICE_PAIRS)
            n_w, _ = _lookup(words, counts, w[part])
            logs[part] = times[part] * np.log(np.maximum(n_w - own_w[part].astype(np.int64), UNSEEN))
        del w
        release()
        rows += _sum_rows(names, chunk, doc, logs, np.zeros(len(doc), np.uint32), groups)
    return _frame(rows)


def _by_document(group: pd.DataFrame, total: int, backoff: float) -> pd.DataFrame:
    head = group[group["kind"] == DOCUMENTS].iloc[0]
    ids, n = unsqueeze(head["a"], np.int64), unsqueeze(head["b"], np.int64)
    logs, missed = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    sums = group[group["kind"] == SUMS].sort_values(["a", "b", "c"])  # the same order of additions in every run
    for a, b, c in zip(sums["a"], sums["b"], sums["c"]):
        at = unsqueeze(c, np.uint32)  # each place once
        logs[at] += unsqueeze(a, np.float64)
        missed[at] += unsqueeze(b, np.uint32)
    logs += missed * (np.log(backoff) - np.log(np.maximum(total - n, 1)))
    return pd.DataFrame({"doc_id": ids, "n_words": n, "n_backoff": missed, "log_score": logs, "mean_log_score": logs / np.maximum(n, 1)})


def backoff_scores(docs: DataFrame, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_backoff, log_score and its
    mean per word.

    The score of a word after another (the first after a mark) is the count of the
    pair over that of the earlier word, both in all other rows; where no other row
    has the pair it is ``backoff`` times the count of the word, at least 0.5, over
    the number of all words there. Words are split at white space, in ASCII lower
    case, and told apart by 48 bits of a hash. Repeated rows are rows like others.
    A missing or empty text has no words and the sum 0. Rows without an id are
    scored and counted too. Further columns are ignored.
    """
    missing = -(1 << 63)
    pair = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(missing)).alias("doc_id"), F.col(text_col).alias("text"))
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words, counts = frequent_words(pair, 1 / (8 * at_least))
    total = int(counts[0]) if len(counts) else 0
    groups = max(at_least, ceil(total / GROUP_PAIRS))
    hot, hot_n = words[1:], counts[1:]
    sent = _sent(pair, groups, hot)
    met = sent.groupBy("grp").applyInPandas(lambda g: _meet_pairs(g, groups, hot, hot_n), _ROW)
    done = met.groupBy("grp").applyInPandas(lambda g: _back_off(g, groups), _ROW)
    scored = done.groupBy("chunk").applyInPandas(
        lambda g: _by_document(g, total, backoff),
        "doc_id long, n_words long, n_backoff long, log_score double, mean_log_score double")
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(missing)))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 3).alias("log_score"),
                         F.round("mean_log_score", 5).alias("mean_log_score"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op4_lm_score": op4_lm_score}
SQL = {
    "op4_lm_score": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, words[i] AS w, CASE WHEN i = 1 THEN '' ELSE words[i - 1] END AS h
      FROM d, unnest(range(1, len(words) + 1)) AS t(i)),
own1 AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
all1 AS (SELECT w, sum(n) AS n FROM own1 GROUP BY w UNION ALL SELECT '', count(DISTINCT doc_id) FROM t),
own2 AS (SELECT doc_id, h, w, count(*) AS n FROM t GROUP BY ALL),
all2 AS (SELECT h, w, sum(n) AS n FROM own2 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT own2.doc_id AS doc_id, sum(own2.n) AS n_words, sum(CASE WHEN all2.n = own2.n THEN own2.n ELSE 0 END) AS n_backoff,
  sum(own2.n * CASE WHEN all2.n > own2.n THEN ln((all2.n - own2.n) / (h1.n - coalesce(oh.n, 1)))
      ELSE ln(0.4) + ln(greatest(w1.n - ow.n, 0.5)) END) AS logs
  FROM own2 JOIN all2 USING (h, w) JOIN all1 h1 ON h1.w = own2.h JOIN all1 w1 ON w1.w = own2.w
  JOIN own1 ow ON ow.doc_id = own2.doc_id AND ow.w = own2.w
  LEFT JOIN own1 oh ON oh.doc_id = own2.doc_id AND oh.w = own2.h
  GROUP BY own2.doc_id),
r AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff,
  CASE WHEN n_words IS NULL THEN 0.0 ELSE logs - n_backoff * ln(greatest(total.n - n_words, 1)) END AS logs
  FROM d LEFT JOIN s USING (doc_id), total)
SELECT doc_id, n_words, n_backoff, round(logs, 3) AS log_score, round(logs / greatest(n_words, 1), 5) AS mean_log_score FROM r
""",
}
