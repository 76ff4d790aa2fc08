"""Repeated word sequences by prefix-partitioned suffix trees.

The suffixes of all documents, cut at the window's width, are split into groups of
a size that fits in memory by prefixes of variable length: one word, or two or
three where that many suffixes share it, and the whole window beyond. A group's
tree is kept as the sorted fingerprints of its paths of full depth. A node of that
depth with suffixes of several documents is a repeat, and overlapping ones make up
the maximal repeats.

Each task first builds the tree of its own documents and sends on only its nodes,
each with its smallest document, so copies within a task and hot passages cost one
entry a task. The answers go back by document.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import release, released, table
from .exchange import BUNDLE, bundles, chunks, opened, pack_sorted, run_starts, squeeze, unpack_sorted, unsqueeze, used_places
from .words import hashed_documents, mix, window_hashes

WINDOW = 13
CHUNK_BYTES = 8 << 20
GROUP_NODES = 1_500_000  # path ends in one group, about
LEVELS = 3  # longest prefix in words
LAST_ID = (1 << 63) - 1  # stands for a missing id


def _chunk_windows(texts: pa.ChunkedArray, width: int):
    """Word hashes, document of each word, and first word of each document."""
    words, firsts, base = [], [np.zeros(1, np.int64)], 0
    for _, _, hashes, first, _ in hashed_documents(texts):
        words.append(hashes)
        firsts.append(first[1:] + base)
        base += len(hashes)
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    firsts = np.concatenate(firsts)
    starts = np.arange(max(0, len(words) - width + 1))
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    fits = starts + width <= firsts[1:][owner[: len(starts)]] if len(starts) else np.zeros(0, bool)
    return words, owner, starts[fits]


def _prefixes(words: np.ndarray, starts: np.ndarray, levels=range(1, LEVELS + 1)):
    """Hashes of the prefixes of each suffix, one length after another."""
    for k in levels:
        yield mix(window_hashes(words, k)[starts] + np.uint64(k))


def prefix_weights(docs: DataFrame, width: int, share: float) -> DataFrame:
    """Prefixes of a share of the suffixes of some task: prefix, n. The entry 0 has
    the number of all suffixes. Only the balance of the groups depends on this."""
    def count(batches):
        for part in chunks(batches, 1, CHUNK_BYTES):
            release()
            words, _, starts = _chunk_windows(part.column(1), width)
            found, sizes = [np.zeros(1, np.uint64)], [np.array([len(starts)])]
            for prefix in _prefixes(words, starts):
                value, n = np.unique(prefix, return_counts=True)
                heavy = n >= max(2, share * len(starts))
                found.append(value[heavy])
                sizes.append(n[heavy])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(sizes))], ["prefix", "n"])

    return docs.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


_ROWS = "grp long, kind int, ids binary, at binary, paths binary"
_FOUND = "doc_id long, paths binary"


def _brief(paths: np.ndarray) -> bytes:
    """The upper six bytes of fingerprints, to tell a document's windows apart."""
    return (paths >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _by_document(doc: np.ndarray, paths: np.ndarray, ids: np.ndarray):
    order = np.argsort(doc, kind="stable")
    doc, paths = doc[order], paths[order]
    begin = run_starts(doc)
    for a, b in zip(begin, np.append(begin[1:], len(doc))):
        yield int(ids[doc[a]]), _brief(paths[a:b])


def _own_trees(docs: DataFrame, width: int, groups: int, heavy: np.ndarray) -> DataFrame:
    """Rows for each task: kind 0, nodes of its tree for a group (smallest
    documents as places in ``ids``); kind 1, repeats already known."""
    def build(batches):
        for part in chunks(batches, 1, CHUNK_BYTES):
            release()
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")  # so the first of equal paths has the smallest id
            if (order[1:] < order[:-1]).any():
                part, ids = part.take(pa.array(order)), ids[order]
            words, owner, starts = _chunk_windows(part.column(1), width)
            paths, doc = window_hashes(words, width)[starts], owner[starts]
            sort = np.argsort(paths, kind="stable")
            ordered = paths[sort]
            begin = run_starts(ordered)
            first = sort[begin]
            later = ids[doc[sort]] > np.repeat(ids[doc[first]], np.diff(np.append(begin, len(sort))))
            rows = [(d % groups, 1, None, np.array([d]).tobytes(), p)
                    for d, p in _by_document(doc[sort[later]], ordered[later], ids)]
            nodes, least, starts = ordered[begin], doc[first], starts[first]
            del paths, doc, sort, ordered, begin, first, later, owner
            target = (nodes % np.uint64(groups)).astype(np.int64)
            for prefix in _prefixes(words, starts, range(LEVELS, 0, -1)):
                target = np.where(np.isin(prefix, heavy), target, (prefix % np.uint64(groups)).astype(np.int64))
            del words, starts
            by_group = np.argsort(target.astype(np.uint16 if groups < 1 << 16 else np.int64), kind="stable")
            cut = run_starts(target[by_group])
            for a, b in zip(cut, np.append(cut[1:], len(by_group))):
                own = by_group[a:b]
                used, at = used_places(least[own], len(ids))
                rows.append((int(target[own[0]]), 0, pack_sorted(ids[used].astype(np.uint64)),
                             squeeze(at), pack_sorted(nodes[own])))
            for i in range(0, len(rows), 2000):
                columns = list(zip(*rows[i: i + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                    ["grp", "kind", "ids", "at", "paths"])

    return docs.mapInArrow(build, _ROWS)


def _merged_tree(group: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Documents and paths of a group whose node has a smaller document, one row for
    each bucket of documents."""
    release()
    known = group[group["kind"] == 1]
    found = [(int(np.frombuffer(a, np.int64)[0]), p) for a, p in zip(known["at"], known["paths"])]
    nodes = group[group["kind"] == 0]
    if len(nodes):
        ids = [unpack_sorted(x).view(np.int64)[unsqueeze(a, np.uint32)] for x, a in zip(nodes["ids"], nodes["at"])]
        doc, paths = np.concatenate(ids), np.concatenate([unpack_sorted(p) for p in nodes["paths"]])
        sort = np.argsort(paths, kind="stable")
        doc, paths = doc[sort], paths[sort]
        begin = run_starts(paths)
        least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(doc)))) if len(doc) else doc
        later = doc > least
        values, place = np.unique(doc[later], return_inverse=True)
        found += list(_by_document(place, paths[later], values))
    return pd.DataFrame(bundles(found, groups, 1), columns=["bucket", "keys", "sizes", "data"]).astype({"bucket": "int64"})


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(opened(group, 1), columns=["doc_id", "paths"]).astype({"doc_id": "int64"})


def repeated_paths(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fingerprints of its windows that begin in a smaller document."""
    spark = docs.sparkSession
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (4 * at_least)
    weights = prefix_weights(docs, width, share)
    total = weights.filter("prefix = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(at_least, ceil(total / GROUP_NODES))
    # of each length at most 2 x groups prefixes can be that frequent
    heavy = weights.filter((F.col("prefix") != 0) & (F.col("n") >= total / groups / 2)).select("prefix").collect()
    frequent = np.array([r["prefix"] for r in heavy], np.int64).view(np.uint64)
    trees = _own_trees(docs, width, groups, frequent)
    found = trees.groupBy("grp").applyInPandas(lambda g: _merged_tree(g, groups), BUNDLE)
    return found.groupBy("bucket").applyInPandas(_answers, _FOUND)  # as many buckets as groups


def cut_repeats(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text, words
    joined by one space).

    A word goes if one of the ``width`` consecutive words around it also begins in
    a document with a smaller id; repeats within one document, or between rows of
    one id, stay. A missing or empty text has no words and keeps the empty text; a
    row without an id stands after all others. Windows are told apart by 64-bit
    fingerprints. Further columns are ignored.
    """
    known_id = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    pair = docs.select(known_id.alias("doc_id"), F.col(text_col).alias("text"))
    joined = pair.join(repeated_paths(pair.filter(F.length("text") >= 2 * width - 1), width), "doc_id", "left")

    def cut(batches):
        for batch in released(batches):
            texts, lists = batch.column(1), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for lo, hi, words, firsts, (data, starts, ends) in hashed_documents(texts):
                raw = data.tobytes()
                for d in range(hi - lo):
                    a, b = firsts[d], firsts[d + 1]
                    goes = np.zeros(b - a, bool)
                    found = lists[lo + d].as_py()
                    if found and b - a >= width:
                        wanted = np.frombuffer(found, np.uint8).reshape(-1, 6)
                        wanted = np.hstack([wanted, np.zeros((len(wanted), 2), np.uint8)]).view("<u8").ravel()
                        hit = np.isin(window_hashes(words[a:b], width) >> np.uint64(16), wanted)
                        depth = np.zeros(b - a + 1, np.int64)
                        depth[: len(hit)] += hit
                        depth[width: width + len(hit)] -= hit
                        goes = np.cumsum(depth)[:-1] > 0
                    if goes.any():
                        left = np.flatnonzero(~goes) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())]).decode())
                    else:
                        whole = raw[starts[a]: ends[b - 1]] if b > a else b""
                        kept.append(b" ".join(whole.split()).decode())
                    n_words.append(int(b - a))
                    n_removed.append(int(goes.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    done = joined.select("doc_id", "text", "paths").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL = {
    "op6_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS path FROM d, unnest(range(1, len(words) - 11)) AS t(i)),
f AS (SELECT path, min(doc_id) AS least FROM w GROUP BY path),
gone AS (SELECT DISTINCT doc_id, p FROM w JOIN f USING (path), unnest(range(i, i + 13)) AS t(p) WHERE doc_id > least),
kept AS (SELECT doc_id, p, words[p] AS word FROM d, unnest(range(1, len(words) + 1)) AS t(p)
         WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}
