"""Repeated byte strings by a distributed merge sort of suffixes.

Suffixes are taken at sync points: the 50 bytes there hash least of all 50-byte
strings within some 100-byte window, so equal windows have the same sync points at
the same distance. A sync point whose 50 bytes occur nowhere else has no repeated
window; all others get their suffix, cut at 100 bytes, into a sorted run of their
task, with the up to 50 bytes before it. Front-coded runs are sent to the groups
of their first 50 bytes and merged there by a loser tree that knows the common
prefixes; the common prefixes of the merged order tell which suffixes agree far
enough, the bytes before them the rest of a window.

Within a task windows that began earlier in the task are found the same way first,
and only suffixes with other windows are sent, so that a hot text costs one run
entry a task. A line of less than a window has other windows in each document: where
a point's 50 bytes are that frequent, no suffix is sent but a 128-bit fingerprint of
each of its windows, to the group of the fingerprint.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.writers import staged
from .common import table, text_key
from .exchange import BUNDLE, bundles, chunks, opened, pack_sorted, run_starts, squeeze, unpack_sorted, unsqueeze, used_places
from .suffix_merge import front_code, front_decode, merge_runs, prefix_lengths
from .words import BASE, STEP, mix, powers, powers_of, running, slices, text_buffer

WINDOW = 100
CHUNK_BYTES = 8 << 20
GROUP_POINTS = 400_000  # sync points in one group, about
SAMPLE_BYTES = 16 << 20  # of text in which frequent points are looked for, at least
SAMPLE_PARTS = 32  # and one in so many documents
HOT_SHARE = 8  # a point is frequent from this part of a group on; most points are not sent at all
PRINT_ROWS = 1 << 13  # points whose windows are hashed together
SORTED, KNOWN, PRINTS = 0, 1, 2  # kinds of rows that tasks send
LAST_ID = (1 << 63) - 1  # stands for a missing id
_KEY = "doc_id long, text_key long"
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` neighbours, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        n = len(values) - width + 1
        out = pick(out[:n], out[width - span: width - span + n])
    return out


def sync_points(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW):
    """Places, hashes of half a window there, and the first and last window start
    each place is the (leftmost) sync point of."""
    half = width // 2
    n_windows = len(data) - width + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = running(data)
    _, down = powers(len(sums))
    grams = len(data) - half + 1
    h = mix((sums[half:] - sums[:-half]) * down[:grams])
    least = _sliding(h, width - half + 1, np.minimum)[:n_windows]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fits = np.arange(n_windows) + width <= offsets[1:][doc[:n_windows]]
    # a window's sync point: the next place from its start on whose hash is the least
    at = np.zeros(len(h), bool)
    high = np.where(fits, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - half, np.uint64), high, np.zeros(len(h) - n_windows, np.uint64)])
    at = _sliding(padded, width - half + 1, np.maximum)[: len(h)] == h
    places = np.flatnonzero(at)
    starts = np.flatnonzero(fits)
    # of places with equal hashes in a window the leftmost counts
    follow = np.searchsorted(places, starts)
    wanted = least[starts]
    open_ = np.flatnonzero(h[places[np.minimum(follow, len(places) - 1)]] != wanted)
    while len(open_):
        follow[open_] += 1
        open_ = open_[h[places[follow[open_]]] != wanted[open_]]
    point = follow  # place of each window, ascending within a document
    first = np.full(len(places), -1)
    last = np.full(len(places), -1)
    begin = run_starts(point)
    first[point[begin]] = starts[begin]
    last[point[np.append(begin[1:], len(point)) - 1]] = starts[np.append(begin[1:], len(point)) - 1] if len(point) else 0
    used = first >= 0
    places, first, last = places[used], first[used], last[used]
    return places, h[places], first, last


def _points(texts, width: int):
    """Sync points of a text column, some documents at a time: document of each
    (as a place in the column), place in it, hash, first and last window start,
    and the bytes with the points' places in them."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        places, hashes, first, last = sync_points(part, at, width)
        doc = np.searchsorted(at, places, "right") - 1
        yield doc + lo, places - at[doc], hashes, first - at[doc], last - at[doc], part, places


def _brief(hashes: np.ndarray) -> bytes:
    return (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unbrief(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.hstack([rows, np.zeros((len(rows), 2), np.uint8)]).view("<u8").ravel()


def _spans(starts: np.ndarray) -> bytes:
    """Window starts as runs of neighbours: first and number of each."""
    starts = np.sort(starts)
    begin = np.flatnonzero(np.append(True, np.diff(starts) != 1)[: len(starts)])
    return np.stack([starts[begin], np.diff(np.append(begin, len(starts)))], 1).astype("<i8").tobytes()


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers, ascending, and each entry's place among them."""
    order = np.lexsort((two, one))
    pairs = np.stack([one[order], two[order]], 1)
    new = np.append(True, (pairs[1:] != pairs[:-1]).any(1))[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return pairs[new], place


def _by_document(doc: np.ndarray, values: np.ndarray):
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    begin = run_starts(doc)
    for a, b in zip(begin, np.append(begin[1:], len(doc))):
        yield int(doc[a]), values[a:b]


def _send(rows: list[tuple], kinds: list, names: list[str]):
    for i in range(0, len(rows), 1000):
        columns = list(zip(*rows[i: i + 1000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _bundled(found: list[tuple], buckets: int) -> pd.DataFrame:
    return pd.DataFrame(bundles(found, buckets, 2), columns=["bucket", "keys", "sizes", "data"]).astype({"bucket": "int64"})


def _answers(found: DataFrame, name: str) -> DataFrame:
    """One row per text from the rows of all groups, by bucket of texts; there are
    as many buckets as groups."""
    def open_(group: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "text_key", name]
        return pd.DataFrame(opened(group, 2), columns=columns).astype({"doc_id": "int64", "text_key": "int64"})

    return found.groupBy("bucket").applyInPandas(open_, f"{_KEY}, {name} binary")


def repeated_points(docs: DataFrame, width: int, groups: int) -> DataFrame:
    """doc_id, text_key and the hashes of its sync points that occur elsewhere too."""
    def own(batches):
        for part in chunks(batches, 2, CHUNK_BYTES):
            docs_, hashes_ = [], []
            for doc, _, hashes, *_ in _points(part.column(2), width):
                docs_.append(doc)
                hashes_.append(hashes)
            doc, hashes = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs_, np.int64), (hashes_, np.uint64)))
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            sort = np.argsort(hashes, kind="stable")
            ordered = hashes[sort]
            begin = run_starts(ordered)
            size = np.diff(np.append(begin, len(sort)))
            known = np.repeat(size > 1, size)
            rows = [(d % groups, 1, None, None, np.array([ids[d], keys[d]]).tobytes(), _brief(np.unique(p)))
                    for d, p in _by_document(doc[sort][known], ordered[known])]
            first, values = sort[begin], ordered[begin]
            seen = size > 1
            target = (values % np.uint64(groups)).astype(np.int64)
            order = np.argsort(target.astype(np.uint16 if groups < 1 << 16 else np.int64), kind="stable")
            cut = run_starts(target[order])
            for a, b in zip(cut, np.append(cut[1:], len(order))):
                of = order[a:b]
                used, at = used_places(doc[first[of]], len(ids))
                rows.append((int(target[of[0]]), 0, squeeze(ids[used]), squeeze(keys[used]),
                             squeeze((at << np.uint32(1)) | seen[of]), pack_sorted(values[of])))
            yield from _send(rows, [pa.int64(), pa.int32(), *[pa.binary()] * 4], ["grp", "kind", "ids", "keys", "at", "hashes"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["kind"] == 1]
        found = [(*np.frombuffer(a, np.int64).tolist(), p) for a, p in zip(known["at"], known["hashes"])]
        sent = group[group["kind"] == 0]
        if len(sent):
            at = [unsqueeze(x, np.uint32) for x in sent["at"]]
            ids = np.concatenate([unsqueeze(x, np.int64)[a >> 1] for x, a in zip(sent["ids"], at)])
            keys = np.concatenate([unsqueeze(x, np.int64)[a >> 1] for x, a in zip(sent["keys"], at)])
            asks = np.concatenate(at) & 1 == 0  # else its document knows already
            hashes = np.concatenate([unpack_sorted(x) for x in sent["hashes"]])
            sort = np.argsort(hashes, kind="stable")
            begin = run_starts(hashes[sort])
            size = np.diff(np.append(begin, len(sort)))
            hit = sort[np.repeat(size > 1, size)]
            hit = hit[asks[hit]]
            both, place = distinct_pairs(ids[hit], keys[hit])
            found += [(*both[d].tolist(), _brief(p)) for d, p in _by_document(place, hashes[hit])]
        return _bundled(found, groups)

    sent = docs.mapInArrow(own, "grp long, kind int, ids binary, keys binary, at binary, hashes binary")
    return _answers(sent.groupBy("grp").applyInPandas(meet, BUNDLE), "hashes")


def hot_points(docs: DataFrame, width: int, groups: int, parts: int) -> np.ndarray:
    """Hashes of sync points as frequent as a HOT_SHARE-th of a group's points, by
    one in ``parts`` documents; at most HOT_SHARE x ``groups``. Only the balance of the groups depends on this."""
    share = 1 / (2 * HOT_SHARE * groups)

    def count(batches):
        for part in chunks(batches, 2, CHUNK_BYTES):
            found = [hashes for _, _, hashes, *_ in _points(part.column(2), width)]
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            value, n = np.unique(hashes, return_counts=True)
            many = n >= share * len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.uint64(0), value[many]).view(np.int64)), pa.array(np.append(len(hashes), n[many]))], ["hash", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(parts)) == 0)
    counted = staged(sample.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "points")
    total = counted.filter("hash = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counted.filter((F.col("hash") != 0) & (F.col("n") >= max(2, total / groups / HOT_SHARE))).select("hash").collect()
    return np.array([r["hash"] for r in hot], np.int64).view(np.uint64)



class Suffixes:
    """Columns of suffixes: rank of the document and place, windows as a bit mask by
    their distance to the place, and up to half a window of bytes before it."""

    def __init__(self, rank, doc, place, mask, before, rows):
        self.rank, self.doc, self.place, self.mask, self.before, self.rows = rank, doc, place, mask, before, rows

    def take(self, at):
        return Suffixes(*(None if x is None else x[at] for x in (self.rank, self.doc, self.place, self.mask, self.before, self.rows)))


def later_windows(s: Suffixes, common: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in sorted order with their common prefixes: those windows (as
    suffix and distance) that also begin earlier, by rank and then window start."""
    half = width // 2
    by_start = np.lexsort((s.place, s.rank))
    left = np.zeros(len(s.mask), np.uint64)
    found, distance = [], []
    for o in range(half + 1):
        if o:
            left = mix(left + s.before[:, half - o].astype(np.uint64) + np.uint64(1))
        agree = np.cumsum(common < width - o).astype(np.uint64) + np.uint64(1 << 40)  # never a byte's number
        own = by_start[(s.mask[by_start] >> o) & 1 == 1]
        if len(own) < 2:
            continue
        key = mix(left[own] + mix(agree[own]))
        sort = np.argsort(key, kind="stable")
        begin = run_starts(key[sort])
        first = np.repeat(own[sort[begin]], np.diff(np.append(begin, len(sort))))
        each = own[sort]
        later = (s.rank[each] > s.rank[first]) | ((s.rank[each] == s.rank[first]) & (s.place[each] > s.place[first]))
        found.append(each[later])
        distance.append(np.full(int(later.sum()), o))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(distance)


def window_prints(context: np.ndarray, mask: np.ndarray, width: int) -> list[np.ndarray]:
    """Row, distance and two 64-bit fingerprints of each window in ``mask``; a row of
    ``context`` has half a window of bytes before its point and a window behind."""
    half = width // 2
    found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2]
    for lo in range(0, len(mask), PRINT_ROWS):
        part, bits = _BYTES[context[lo: lo + PRINT_ROWS]], mask[lo: lo + PRINT_ROWS]
        row, o = np.nonzero((bits[:, None] >> np.arange(half + 1)) & 1)
        prints = []
        for base in (BASE, STEP):
            up, down = powers_of(half + width, int(base)), powers_of(half + width, pow(int(base), -1, 1 << 64))
            sums = np.zeros((len(part), half + width + 1), np.uint64)
            np.cumsum(part * up, axis=1, out=sums[:, 1:])
            prints.append(mix((sums[row, half - o + width] - sums[row, half - o]) * down[half - o]))
        found.append([row + lo, o, *prints])
    return [np.concatenate(x) for x in zip(*found)]


def later_prints(ids: np.ndarray, starts: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Those windows whose two fingerprints also occur earlier, by id and then start."""
    order = np.lexsort((starts, ids, second, first))
    fresh = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    begin = np.flatnonzero(np.append(True, fresh)[: len(order)])
    least = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    return order[(ids[order] > ids[least]) | (starts[order] > starts[least])]  # of one id they ascend


def _runs(docs: DataFrame, width: int, groups: int, hot: np.ndarray) -> DataFrame:
    """Rows of each task: a front-coded sorted run for a group; starts of windows of a
    document that began earlier in the task; fingerprints of the other windows at
    ``hot`` points for a group."""
    half = width // 2

    def build(batches):
        for part in chunks(batches, 2, CHUNK_BYTES):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            lists = part.column(3).combine_chunks()
            wanted = {}
            columns = [[] for _ in range(6)]
            for doc, place, hashes, first, last, data, at in _points(part.column(2), width):
                keep = np.zeros(len(doc), bool)
                cut = run_starts(doc)
                for a, b in zip(cut, np.append(cut[1:], len(doc))):
                    d = int(doc[a])
                    if d not in wanted:
                        wanted[d] = _unbrief(lists[d].as_py())
                    keep[a:b] = np.isin(hashes[a:b] >> np.uint64(16), wanted[d])
                doc, place, first, last, at, hashes = (x[keep] for x in (doc, place, first, last, at, hashes))
                padded = np.concatenate([np.zeros(half, np.uint8), data, np.zeros(width, np.uint8)])
                around = at[:, None] + np.arange(half + width)
                context = padded[around] if len(at) else np.zeros((0, half + width), np.uint8)
                low, high = (place - last), (place - first)  # distances of its windows
                mask = ((np.int64(1) << (high + 1)) - 1) & ~((np.int64(1) << low) - 1)
                context[:, :half] *= np.arange(half) >= half - high[:, None]
                context[:, half:] *= np.arange(width) < width - low[:, None]
                for held, new in zip(columns, (doc, place, mask, context[:, :half], context[:, half:], hashes)):
                    held.append(new)
            if not columns[0]:
                continue
            doc, place, mask, before, rows, hashes = (np.concatenate(c) for c in columns)
            # the rank orders documents by id; rows of one id are one document
            _, rank = np.unique(ids, return_inverse=True)
            sort = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)
            s = Suffixes(rank[doc], doc, place, mask, before, rows).take(sort)
            hashes = hashes[sort]
            at, o = later_windows(s, prefix_lengths(s.rows), width)
            out = [(d % groups, KNOWN, None, np.array([ids[d], keys[d]]).tobytes(), _spans(p), None, None, None, None)
                   for d, p in _by_document(s.doc[at], s.place[at] - o)]
            gone = np.zeros(len(s.mask), np.int64)
            np.bitwise_or.at(gone, at, np.int64(1) << o)
            s.mask = s.mask & ~gone
            rest = np.flatnonzero(s.mask)
            wide = np.isin(hashes[rest], hot)
            spread, rest = s.take(rest[wide]), rest[~wide]
            row, o, one, two = window_prints(np.hstack([spread.before, spread.rows]), spread.mask, width)
            target = (one % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((one, target))
            cut = run_starts(target[order])
            for a, b in zip(cut, np.append(cut[1:], len(order))):
                own = order[a:b]
                docs_, at_doc = np.unique(spread.doc[row[own]], return_inverse=True)
                out.append((
                    int(target[own[0]]), PRINTS, squeeze(np.stack([ids[docs_], keys[docs_]], 1).ravel()), None,
                    squeeze(at_doc.astype(np.uint32)), squeeze(spread.place[row[own]] - o[own]), squeeze(two[own]),
                    None, pack_sorted(one[own]),
                ))
            target = (hashes[rest] % np.uint64(groups)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            cut = run_starts(target[order])
            for a, b in zip(cut, np.append(cut[1:], len(order))):
                run = s.take(rest[order[a:b]])
                common = prefix_lengths(run.rows)
                docs_, at_doc = np.unique(run.doc, return_inverse=True)
                out.append((
                    int(target[order[a]]), SORTED, squeeze(np.stack([ids[docs_], keys[docs_]], 1).ravel()), None,
                    squeeze(at_doc.astype(np.uint32)), squeeze(run.place), squeeze(run.mask),
                    squeeze(common.astype(np.uint16)), squeeze(np.frombuffer(front_code(run.rows, common) + run.before.tobytes(), np.uint8)),
                ))
            yield from _send(out, [pa.int64(), pa.int32(), *[pa.binary()] * 7],
                             ["grp", "kind", "docs", "of", "at", "place", "mask", "common", "bytes"])

    return docs.mapInArrow(build, "grp long, kind int, docs binary, of binary, at binary, place binary, mask binary, common binary, bytes binary")


def _merged(group: pd.DataFrame, width: int, groups: int) -> pd.DataFrame:
    half = width // 2
    known = group[group["kind"] == KNOWN]
    found = [(*np.frombuffer(a, np.int64).tolist(), p) for a, p in zip(known["of"], known["at"])]
    sent = group[group["kind"] == PRINTS]
    if len(sent):
        pairs = np.concatenate([
            unsqueeze(docs, np.int64).reshape(-1, 2)[unsqueeze(at, np.uint32)] for docs, at in zip(sent["docs"], sent["at"])])
        starts = np.concatenate([unsqueeze(x, np.int64) for x in sent["place"]])
        later = later_prints(pairs[:, 0], starts, np.concatenate([unpack_sorted(x) for x in sent["bytes"]]),
                             np.concatenate([unsqueeze(x, np.uint64) for x in sent["mask"]]))
        both, doc = distinct_pairs(*pairs[later].T)
        found += [(*both[d].tolist(), _spans(p)) for d, p in _by_document(doc, starts[later])]
    sent = group[group["kind"] == SORTED]
    if len(sent):
        runs, commons, ids, keys, place, mask, before = [], [], [], [], [], [], []
        for docs, at, where, bits, common, data in zip(*(sent[c] for c in ("docs", "at", "place", "mask", "common", "bytes"))):
            pairs, at, data = unsqueeze(docs, np.int64).reshape(-1, 2), unsqueeze(at, np.uint32), unsqueeze(data, np.uint8).tobytes()
            common = unsqueeze(common, np.uint16).tolist()
            size = len(common)
            runs.append(front_decode(data, common, width))
            commons.append(common)
            before.append(np.frombuffer(data, np.uint8)[len(data) - size * half:].reshape(size, half))
            ids.append(pairs[at, 0])
            keys.append(pairs[at, 1])
            place.append(unsqueeze(where, np.int64))
            mask.append(unsqueeze(bits, np.int64))
        order, lengths = merge_runs(runs, commons)
        order = np.array(order)
        # the i-th string of a run in the merged order is its i-th entry
        base = np.append(0, np.cumsum([len(r) for r in runs]))[:-1]
        at = np.empty(len(order), np.int64)
        by_run = np.argsort(order, kind="stable")
        at[by_run] = np.arange(len(order)) - np.repeat(np.searchsorted(order[by_run], np.arange(len(runs))), [len(r) for r in runs]) \
            + np.repeat(base, [len(r) for r in runs])
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        _, rank = np.unique(ids, return_inverse=True)
        s = Suffixes(rank, None, np.concatenate(place), np.concatenate(mask), np.concatenate(before), None).take(at)
        hit, o = later_windows(s, np.array(lengths), width)
        both, doc = distinct_pairs(ids, keys)  # of the suffixes, of which there are fewer than windows
        found += [(*both[d].tolist(), _spans(p)) for d, p in _by_document(doc[at[hit]], s.place[hit] - o)]
    return _bundled(found, groups)


def cut_repeated_bytes(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept
    (binary, what is left of the UTF-8 text).

    A byte goes if it lies in a ``width``-byte string that also begins earlier: in
    a document of a smaller id, or before it in the same one; overlaps count. Rows
    of one id and text are one document; of one id and different texts too, by
    their places. A missing text is empty, a row without an id stands after all
    others. 50-byte strings are told apart by 48 bits of a hash when the points
    are chosen, and bytes themselves are compared behind a point, 64-bit
    fingerprints before it; at frequent points 128-bit fingerprints of whole windows
    are. Further columns are ignored. ``width`` is even and at
    most 124.
    """
    if width % 2 or not 2 <= width <= 124:
        raise ValueError("width must be even and at most 124")
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))).first()[0] or 0
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / (width / 4) / GROUP_POINTS))
    known_id = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    keyed = docs.select(known_id.alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    key = ["doc_id", "text_key"]
    hot = hot_points(keyed, width, groups, min(max(1, size // SAMPLE_BYTES), SAMPLE_PARTS))
    points = repeated_points(keyed, width, groups)
    ahead = keyed.join(points, key).select(*key, "text", "hashes")
    removed = _runs(ahead, width, groups, hot).groupBy("grp").applyInPandas(lambda g: _merged(g, width, groups), BUNDLE)
    joined = keyed.join(_answers(removed, "starts"), key, "left").select("doc_id", "text", "starts")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(batch.column(1).fill_null(""), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_py() else np.zeros(0, np.uint8)
                found = found.as_py()
                if found:
                    at, n = np.frombuffer(found, "<i8").reshape(-1, 2).T
                    depth = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + n - 1 + width, minlength=len(data) + 1)
                    goes = np.cumsum(depth)[: len(data)] > 0
                    spans = int((goes & ~np.append(False, goes[:-1])).sum())
                    values = len(data), int(goes.sum()), spans, data[~goes].tobytes()
                else:
                    values = len(data), 0, 0, data.tobytes()
                for held, v in zip(out, values):
                    held.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
SQL: dict[str, str] = {}
