"""Compact columns for shuffles of very many small numbers.

A task sends its sorted hashes to a group as one binary value: differences, with
the bytes of equal weight together, compressed. That is about five bytes a hash
where a row of two numbers takes more than twenty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard

from .words import mix


def squeeze(values: np.ndarray) -> bytes:
    """Any numbers; equal-weight bytes are compressed together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[pa.Table]:
    """Whole rows of about ``size`` bytes of text together."""
    held, total = [], 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(text_at)).fill_null(0)), dtype=np.int64)
        while at < batch.num_rows:
            done = int(lengths[at - 1]) if at else 0
            to = int(np.searchsorted(lengths, done + size - total, "right"))
            to = min(max(to, at + 1), batch.num_rows)
            held.append(batch.slice(at, to - at))
            total += int(lengths[to - 1]) - done
            at = to
            if total >= size or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def used_places(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some places below ``size``, ascending, and where each entry is
    among them. A row to a group carries what belongs to these places only, so its
    size goes with its entries, however many groups a chunk has rows for."""
    if 4 * len(places) < size:
        used, at = np.unique(places, return_inverse=True)
    else:
        held = np.zeros(size, bool)
        held[places] = True
        used, at = np.flatnonzero(held), (np.cumsum(held) - 1)[places]
    return used, at.astype(np.uint32)


BUNDLE = "bucket long, keys binary, sizes binary, data binary"


def bundles(found: list[tuple], buckets: int, width: int) -> list[tuple]:
    """One row per bucket for answers (keys..., bytes) with ``width`` integer keys:
    documents of a bucket, bytes of each, and the bytes."""
    keys = np.array([f[:width] for f in found], np.int64).reshape(-1, width)
    bucket = (mix(np.ascontiguousarray(keys[:, 0]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = run_starts(bucket[order])
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        own = order[a:b]
        data = [found[i][width] for i in own]
        rows.append((int(bucket[own[0]]), squeeze(keys[own].ravel()), squeeze(np.array([len(x) for x in data], np.int64)),
                     zstandard.ZstdCompressor(level=1).compress(b"".join(data))))
    return rows


def opened(group, width: int) -> list[tuple]:
    """All answers of a bucket: keys and joined bytes, one row per document."""
    joined: dict[tuple, list[bytes]] = {}
    for keys, sizes, data in zip(group["keys"], group["sizes"], group["data"]):
        raw, at = zstandard.ZstdDecompressor().decompress(data), 0
        for key, size in zip(unsqueeze(keys, np.int64).reshape(-1, width).tolist(), unsqueeze(sizes, np.int64).tolist()):
            joined.setdefault(tuple(key), []).append(raw[at: at + size])
            at += size
    return [(*key, b"".join(parts)) for key, parts in joined.items()]
