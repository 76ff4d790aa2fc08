"""Near duplicates by MinHash with tensored banding.

Two small collections of half keys are made, each of a few min-hashes. A table key
pairs one half of the first collection with one of the second. For a similarity of
0.85, 2 x 9 x 3 min-hashes serve 81 tables of 6 min-hashes each, where plain banding
would need 486. The collections are so large that texts of the least similarity meet
in no table with a probability below 5e-4. Halves that only one text has can be in
no shared table and are dropped first.

Texts with equal sets are one. In each table group all texts are compared with its
smallest and its largest id. Texts of groups that are not one component then meet
again by their half key, in blocks of bounded size that hold the full sets: there
pairs across components that share one of their rarest shingles and have alike
signatures are compared, and links that join components returned. Texts of one
template with text of their own share no rare shingle and are no pairs. Every link
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.writers import staged
from .common import keep_rows, released, small_side, table, text_batches, text_key
from .components import components
from .words import hashed_documents, mix, window_hashes

SHINGLE = 5
PERCENT = 80
DEPTH = 3  # min-hashes in a half key
MISSED = 5e-4
BLOCK = 2_000_000  # shingles in one block of many texts, about twice as many between two


def halves_for(percent: int) -> int:
    """Half keys in each collection, so that a pair of that similarity shares a half
    in both but for a probability of ``MISSED``."""
    differ = 1 - (percent / 100) ** DEPTH
    return max(1, ceil(log(MISSED / 2) / log(differ))) if 0 < differ < 1 else 1


def seeds(halves: int) -> np.ndarray:
    return mix(np.arange(1, 2 * halves * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of documents: first and last, the sorted distinct shingle hashes
    of each in one array, and where each document's begin."""
    for lo, hi, words, firsts, _ in hashed_documents(texts, lower=True):
        runs = window_hashes(words, width)
        sets = []
        for a, b in zip(firsts[:-1], firsts[1:]):
            if b - a >= width:
                sets.append(np.unique(runs[a: b - width + 1]))
            elif b > a:  # the whole sequence; its length goes into the hash
                sets.append(window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
            else:
                sets.append(words[a:b])
        yield lo, hi, np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets]))


def signatures(shingles: np.ndarray, begin: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Min-hashes of each document that has shingles, one column per hash."""
    at = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(at), len(multipliers)), np.uint64)
    for k, seed in enumerate(multipliers):
        if len(at):
            out[:, k] = np.minimum.reduceat((shingles ^ (seed >> np.uint64(7))) * seed, at)
    return mix(out)


def _signed(docs: DataFrame, width: int, n_halves: int) -> DataFrame:
    multipliers = seeds(n_halves)

    def sign(batches):
        for batch in released(batches):
            for lo, hi, shingles, begin in shingle_sets(batch.column(1), width):
                n = np.diff(begin)
                filled = n > 0
                mins = signatures(shingles, begin, multipliers)
                digests = np.zeros((hi - lo, 2), np.int64)
                halves = np.zeros((hi - lo, 2 * n_halves), np.int64)
                brief = np.zeros((hi - lo, len(multipliers)), np.uint16)
                if filled.any():
                    at = begin[:-1][filled]
                    digests[filled, 0] = mix(np.add.reduceat(mix(shingles), at)).view(np.int64)
                    digests[filled, 1] = mix(np.add.reduceat(mix(shingles ^ multipliers[0]), at)).view(np.int64)
                    for k in range(2 * n_halves):
                        group = mins[:, k * DEPTH: (k + 1) * DEPTH]
                        key = group[:, 0]
                        for j in range(1, DEPTH):
                            key = mix(key + group[:, j])
                        halves[filled, k] = mix(key + np.uint64(k)).view(np.int64)
                    brief[filled] = (mins & np.uint64(0xFFFF)).astype(np.uint16)
                both = pa.ListArray.from_arrays(
                    pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (2 * n_halves)), pa.array(halves.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     both, pa.array([row.tobytes() for row in brief], pa.binary())],
                    ["doc_id", "text_key", "n", "sid", "sid2", "halves", "brief"])

    return docs.mapInArrow(sign, "doc_id long, text_key long, n long, sid long, sid2 long, halves array<long>, brief binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid and shingle set of the documents whose id is in ``wanted`` (column node)."""
    def take(batches):
        for batch in released(batches):
            for lo, hi, shingles, begin in shingle_sets(batch.column(1), width):
                filled = np.flatnonzero(np.diff(begin) > 0)
                if len(filled):
                    sid = mix(np.add.reduceat(mix(shingles), begin[:-1][filled])).view(np.int64)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(begin[:-1][filled], begin[-1]).astype(np.int32)), pa.array(shingles.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(sid), lists], ["sid", "shingles"])

    rows = docs.join(small_side(wanted), docs["doc_id"] == wanted["node"], "left_semi")
    return rows.mapInArrow(take, "sid long, shingles array<long>").dropDuplicates(["sid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, sid_a, b, sid_b) whose full sets are alike enough."""
    left = sets.select(F.col("sid").alias("sid_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("sid").alias("sid_b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    return (
        pairs.join(left, "sid_a").join(right, "sid_b").withColumn("shared", shared)
        .filter(100 * F.col("shared").cast("long") >= percent * union.cast("long")).select("a", "b")
    )


def _tables(texts: DataFrame, n_halves: int) -> DataFrame:
    """node, first half and key of each table in which both halves are shared."""
    halves = texts.select("node", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("half")
    left = halves.join(shared, "half", "left_semi").groupBy("node").agg(  # at most 2 x n_halves entries
        F.collect_list(F.when(F.col("k") < n_halves, F.col("half"))).alias("first"),
        F.collect_list(F.when(F.col("k") >= n_halves, F.col("half"))).alias("second"),
    )
    return left.select("node", F.explode("first").alias("f"), "second").select(
        "node", "f", F.explode("second").alias("s")).select("node", "f", F.xxhash64("f", "s").alias("key"))


def _prefixes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For sets in order of size: the rare shingles of which each shares one with any
    later set alike enough. Two sets that have ``a`` shingles in common share one of
    the first ``n - a + 1`` of each, in whatever order; ``a`` is at least 2 p / (100 + p)
    of the smaller set and p / 100 of the larger one. With the rarest of the block
    first, what all texts of a template have in common is in no prefix.

    Ascending places of shingles, the set of each entry, and for each set the
    places to look up, of as many shingles as its role as the larger one needs."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    ranks, end = rank[place], np.cumsum(sizes)
    as_small = sizes + 2 * percent * sizes // -(100 + percent) + 1
    as_large = sizes + percent * sizes // -100 + 1
    rare = [np.sort(ranks[e - n: e])[:k] for e, n, k in zip(end, sizes, np.maximum(as_small, as_large))]
    of = np.repeat(np.arange(len(sets)), as_small)
    entries = np.concatenate([r[:k] for r, k in zip(rare, as_small)])
    order = np.argsort(entries, kind="stable")
    return entries[order], of[order], as_large, rare


def _joined(block: pd.DataFrame, percent: int, least: int) -> pd.DataFrame:
    """Links that join components of one block, or of two: pairs that share a rare
    shingle and ``least`` equal min-hashes are compared unless they are joined already."""
    block = block.sort_values(["n", "node"])
    sign = np.stack([np.frombuffer(b, np.uint16) for b in block["brief"]])
    sets = [np.sort(x) for x in block["shingles"]]
    node, n, own = (block[c].to_numpy() for c in ("node", "n", "own"))
    part = np.unique(block["component"].to_numpy(), return_inverse=True)[1]
    alone, parts = block["low"].iloc[0] == block["high"].iloc[0], len(np.unique(part))
    entries, of, as_large, rare = _prefixes(sets, percent)

    links = []
    for k in range(1, len(block)):
        if parts == 1:
            break
        wanted = rare[k][: as_large[k]]
        lo, hi = np.searchsorted(entries, wanted), np.searchsorted(entries, wanted, "right")
        length = hi - lo
        j = of[np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())]
        j = j[(j < k) & (part[j] != part[k])]
        j = np.unique(j[100 * n[j] >= percent * n[k]])
        if not alone:
            j = j[own[j] != own[k]]
        for i in j[(sign[j] == sign[k]).sum(1) >= least].tolist():
            if part[i] == part[k]:
                continue
            at = np.minimum(np.searchsorted(sets[k], sets[i]), len(sets[k]) - 1)
            shared = int((sets[k][at] == sets[i]).sum())
            if 100 * shared >= percent * (len(sets[i]) + len(sets[k]) - shared):
                part[part == part[i]] = part[k]
                parts -= 1
                links.append((int(min(node[i], node[k])), int(max(node[i], node[k]))))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def similar_groups(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``width`` words have a Jaccard similarity
    of at least ``percent``; a text of fewer words is one shingle, a missing or
    empty one has none and is alone. ``component_id`` is the smallest id reachable.
    Repeated rows get the same result; rows of one id with different texts are
    linked each by its own text. Rows without an id are not linked and get no
    component. Further columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs, percent, width, id_col, text_col).drop("text_key")


def _grouped(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``similar_groups`` with their text_key."""
    pair = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    n_halves = halves_for(percent)
    with text_batches(docs.sparkSession):
        signed = staged(_signed(pair, width, n_halves), "signed")
    texts = staged(
        signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid", "sid2").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.first("brief").alias("brief")),
        "texts")
    # the smallest id of a text is its node, unless other texts have that one too
    shared = staged(texts.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("node").alias("_shared")), "shared")
    clash = shared.limit(1).count() > 0
    texts = texts.withColumn("id", F.col("node"))
    if clash:
        own = F.when(F.col("_shared").isNotNull(), F.xxhash64("sid", "sid2")).otherwise(F.col("id"))
        texts = texts.join(small_side(shared), F.col("id") == F.col("_shared"), "left").withColumn("node", own).drop("_shared")
        texts = staged(texts, "texts")
    known = texts.select("node", "sid", "n")
    members = staged(_tables(texts, n_halves), "tables")
    ends = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    led = members.join(ends, "key").select("node", F.explode(F.array("lo", "hi")).alias("b")).filter("node <> b")
    tried = staged(led.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "led")
    involved = staged(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "involved")
    wanted = staged(involved.join(texts, "node").select(F.col("id").alias("node")).distinct(), "wanted") if clash else involved
    with text_batches(docs.sparkSession):
        sets = staged(_sets(pair, wanted, width), "sets")
    # neither the pairs nor what is confirmed of them is written: components() stages the links itself
    found = staged(components(_confirmed(_sized(tried, known, percent), sets, percent)), "components")
    more = staged(_across(members, texts, sets, found, percent, 2 * n_halves * DEPTH), "across")
    if more.limit(1).count():
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = staged(components(more.unionByName(stars)), "components")
    if clash:
        least = found.join(texts.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("id"))
        found = staged(found.join(least, "component").select("node", F.col("id").alias("component")), "components")
    of_text = signed.join(texts.select("sid", "sid2", F.col("node").alias("_node"), F.col("id").alias("_id")), ["sid", "sid2"], "left")
    joined = of_text.join(small_side(found), F.col("_node") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_id", "doc_id"))
    return joined.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sized(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs with both set ids, without those whose set sizes differ too much."""
    a = known.select(F.col("node").alias("a"), F.col("sid").alias("sid_a"), F.col("n").alias("n_a"))
    b = known.select(F.col("node").alias("b"), F.col("sid").alias("sid_b"), F.col("n").alias("n_b"))
    sized = pairs.join(a, "a").join(b, "b")
    return sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "sid_a", "b", "sid_b")


def _across(members: DataFrame, texts: DataFrame, sets: DataFrame, found: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Links between components in table groups of several components."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n"),
    ).filter("c1 < c2 AND n > 2").select("key")  # of two, both have been compared
    open_ = placed.join(groups, "key", "left_semi").select("f", "node", "component").distinct()
    open_ = staged(open_.join(texts.select("node", "n"), "node"), "open")
    # halves with the same texts need one search
    sizes = open_.groupBy("f").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")
    ).groupBy("who", "size", "shingles").agg(F.min("f").alias("f"))
    sizes = sizes.select("f", F.ceil(F.col("shingles") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = open_.join(sizes, "f").withColumn("own", own).join(texts.select("node", "sid", "brief"), "node").join(sets, "sid")
    spread = rows.select(
        "f", "node", "component", "n", "brief", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    share = percent / 100
    least = int(hashes * share - 4 * (hashes * share * (1 - share)) ** 0.5)  # four standard deviations below
    return spread.groupBy("f", "low", "high").applyInPandas(lambda g: _joined(g, percent, least), "a long, b long").distinct()


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without all of each group but the one of the smallest id."""
    dropped = staged(_grouped(docs).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_key"), "near")
    return keep_rows(docs, dropped)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), percent=85, width=3)


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
