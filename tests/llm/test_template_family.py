"""Texts of one template with text of their own: near, but no near copies."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somaframe.llm import near_dedup


def joined(part, sets):
    above = {p: p for p in part}

    def root(p):
        while above[p] != p:
            p = above[p]
        return p

    def join(a, b):
        a, b = root(part[a]), root(part[b])
        above[max(a, b)] = min(a, b)

    return root, join


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
@pytest.mark.parametrize("two_blocks", [False, True])
def test_rare_shingles_find_every_link(percent, two_blocks):
    draw = np.random.default_rng(percent)
    sets, template = [], draw.integers(1, 1 << 62, 120)
    for _ in range(150):
        base = draw.choice(template, draw.integers(1, 120), replace=False) if draw.random() < 0.3 else template
        sets.append(np.concatenate([base, draw.integers(1, 1 << 62, draw.integers(0, 40))]))
        near = sets[draw.integers(len(sets))]
        sets.append(np.concatenate([near[draw.random(len(near)) > 0.06], draw.integers(1, 1 << 62, draw.integers(1, 6))]))
    n = np.array([len(s) for s in sets])
    part = draw.permutation(len(sets)) // 2  # some are joined already
    own = draw.integers(0, 2 if two_blocks else 1, len(sets))
    block = pd.DataFrame({
        "low": 0, "high": int(two_blocks), "own": own, "node": np.arange(len(sets)), "component": part, "n": n,
        "brief": [np.zeros(54, np.uint16).tobytes()] * len(sets), "shingles": sets})
    root, join = joined(part, sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if (not two_blocks or own[a] != own[b]) and 100 * shared >= percent * (n[a] + n[b] - shared):
            join(a, b)
    again, join = joined(part, sets)
    links = near_dedup._joined(block, percent, 54)
    for a, b in zip(links["a"], links["b"]):
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * shared >= percent * (n[a] + n[b] - shared) and again(part[a]) != again(part[b])
        join(a, b)
    assert [again(p) for p in part] == [root(p) for p in part]
    assert percent == 100 or len(links)


def family(n, own, seed=1):
    draw = random.Random(seed)
    template = [f"t{i}" for i in range(200)]
    for d in range(n):
        mine = [f"w{draw.randrange(1 << 40)}" for _ in range(own)]
        yield d, " ".join(template[:100] + mine[: own // 2] + template[100:] + mine[own // 2:])


def test_template_family(spark):
    """1,000 texts of one template, a fifth of them copies with one other word."""
    texts = dict(family(800, 22))
    for d in range(200):
        texts[800 + d] = texts[4 * d] + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs, 85, 3).collect()}
    assert got == {d: 4 * (d - 800) if d >= 800 else d for d in texts}


def test_compared_pairs_of_a_template(spark, monkeypatch):
    """Pairs that reach a comparison of full sets do not grow with the square."""
    compared = []
    for n in (200, 400):
        sets = [np.sort(np.array([hash(x) & (1 << 60) - 1 for x in zip(t.split(), t.split()[1:])], np.int64)) for _, t in family(n, 20)]
        entries, of, as_large, rare = near_dedup._prefixes(sets, 85)
        compared.append(sum(len(np.unique(of[np.isin(entries, r[:k])])) - 1 for r, k in zip(rare, as_large)))
    assert compared == [0, 0]
