"""A line of less than a window in half of the documents: results and group sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.llm import suffix_dedup
from somaframe.llm.common import text_key
from somaframe.llm.exchange import unsqueeze

GROUPS = 8


@pytest.fixture(scope="module")
def pairs():
    pick = random.Random(5)
    noise = lambda n: "".join(pick.choice("abcdefghij klmnop") for _ in range(n))
    line, passage = noise(80), noise(260)
    out = []
    for d in range(400):
        parts = [noise(pick.randint(60, 400)) for _ in range(2)]
        middle = line if d % 2 else passage if d % 5 == 0 else ""
        out.append((d, parts[0] + middle + parts[1] + (parts[0][:130] if d % 50 == 3 else "")))
    shared = noise(40) + line + noise(40)  # the line with the same neighbours in some documents
    return out + [(400 + d, noise(50) + shared + noise(50)) for d in range(20)] + [(7, out[9][1]), (7, out[7][1])]


@pytest.fixture(scope="module")
def keyed(spark, pairs):
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")


def entries(keyed, hot):
    points = suffix_dedup.repeated_points(keyed, 100, GROUPS)
    ahead = keyed.join(points, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "hashes")
    sizes = np.zeros(GROUPS, np.int64)
    for r in suffix_dedup._runs(ahead, 100, GROUPS, hot).collect():
        if r.docs is not None:
            sizes[r.grp] += len(unsqueeze(r["at"], np.uint32))
    return sizes


def test_no_group_holds_a_hot_line(keyed):
    alone = entries(keyed, np.zeros(0, np.uint64))
    assert alone.max() > 0.4 * alone.sum()  # by the point's 50 bytes only
    hot = suffix_dedup.hot_points(keyed, 100, GROUPS, 1)
    spread = entries(keyed, hot)
    assert 0 < len(hot) <= 8 * GROUPS and spread.max() < 0.2 * spread.sum()


def test_same_bytes_go(spark, pairs):
    docs = [(d, t) for d, t in pairs[:-2]]
    seen, expected = set(), {}
    for d, text in docs:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(data[i:i + 100])
        expected[d] = np.frombuffer(data, np.uint8)[~gone].tobytes()
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.cut_repeated_bytes(made).collect()}
    assert got == expected and sum(map(len, expected.values())) < sum(len(t) for _, t in docs)


def test_prints_tell_windows_by_their_bytes():
    random_ = np.random.default_rng(3)
    context = random_.integers(0, 4, (50, 150)).astype(np.uint8)
    context[30:] = context[:20]
    row, o, one, two = suffix_dedup.window_prints(context, np.full(50, (1 << 51) - 1), 100)
    windows = [context[r, 50 - d: 150 - d].tobytes() for r, d in zip(row, o)]
    prints = list(zip(one.tolist(), two.tolist()))
    assert len(windows) == 50 * 51 and len(set(zip(windows, prints))) == len(set(windows)) == len(set(prints))
    later = suffix_dedup.later_prints(row, -o, one, two)
    assert len(later) == len(windows) - len(set(windows))


@pytest.fixture(scope="module")
def group(spark):
    """Rows sent to one group by documents that share long passages."""
    pick = random.Random(9)
    passage = "".join(pick.choice("abcdefghij klmnop") for _ in range(600))
    pairs = [(d % 40, f"{d} " * 30 + passage[d: d + 400] + f" {d * d}" * 30) for d in range(80)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    points = suffix_dedup.repeated_points(keyed, 100, 1)
    ahead = keyed.join(points, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "hashes")
    return suffix_dedup._runs(ahead, 100, 1, np.zeros(0, np.uint64)).toPandas()


def test_no_window_is_sorted_as_a_record(group, monkeypatch):
    """A group finds its documents among its suffixes, by two columns of numbers."""
    sizes, plain = [], np.unique

    def unique(values, *args, axis=None, **kwargs):
        if axis is not None:
            sizes.append(len(values))
        return plain(values, *args, axis=axis, **kwargs) if axis is not None else plain(values, *args, **kwargs)

    monkeypatch.setattr(np, "unique", unique)
    found = suffix_dedup._merged(group, 100, 1)
    assert len(found) and not sizes


@pytest.mark.parametrize("n", [0, 1, 500])
def test_distinct_pairs(n):
    pick = np.random.default_rng(n)
    one, two = pick.integers(-9, 9, n), pick.integers(-4, 4, n) * (1 << 60)
    pairs, place = suffix_dedup.distinct_pairs(one, two)
    expected, at = np.unique(np.stack([one, two], 1), axis=0, return_inverse=True)
    assert np.array_equal(pairs, expected) and np.array_equal(place, at.ravel())
