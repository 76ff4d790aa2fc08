"""The models and the attribution of tokens against enumeration and plain loops."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from somaframe.llm import language_id as li
from somaframe.llm import quality_crf as qc
from somaframe.llm import token_counts as tc


# -- the field over lines

def enumerated(nodes, table):
    """Marginals of the label good and the log of the sum, over all labellings."""
    weights = {}
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(n for n, y in zip(nodes, labels) if y) + sum(table[a][b] for a, b in zip(labels, labels[1:]))
        weights[labels] = math.exp(score)
    whole = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[i]) / whole for i in range(len(nodes))], math.log(whole)


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(5)
    lines_of = np.array([3, 0, 8, 1, 5, 0, 2, 8])
    rows = draw.normal(size=(lines_of.sum(), 4))
    model = qc.QualityModel(draw.normal(size=4), np.full(4, 1.5), draw.normal(size=4), draw.normal(size=(2, 2)), 0.5)
    got = qc.score_lines(model, rows, lines_of)
    nodes = ((rows - model.mean) / model.spread) @ model.weights
    at = 0
    for n in lines_of:
        want, _ = enumerated(nodes[at: at + n], model.table)
        np.testing.assert_allclose(got[at: at + n], want, rtol=1e-9)
        at += n


def test_the_fit_ends_where_the_enumerated_likelihood_is_flat(monkeypatch):
    monkeypatch.setattr(qc, "STEPS", 2000)
    monkeypatch.setattr(qc, "RATE", 0.02)
    draw = np.random.default_rng(6)
    lines_of = np.array([4, 2, 6, 1, 3, 5])
    labels = np.array([1, 0, 0, 1, 1, 0])
    rows = np.hstack([np.ones((lines_of.sum(), 1)), draw.normal(size=(lines_of.sum(), 2))])
    model = qc.train(rows, lines_of, labels)
    scaled = (rows - model.mean) / model.spread

    def likelihood(theta):
        nodes, table, at, total = scaled @ theta[:-4], theta[-4:].reshape(2, 2), 0, 0.0
        for n, y in zip(lines_of, labels):
            own = nodes[at: at + n].sum() * y + table[y, y] * (n - 1)
            total += own - enumerated(nodes[at: at + n], table)[1]
            at += n
        return total / len(rows) - qc.PENALTY / 2 * (theta @ theta)

    theta = np.append(model.weights, model.table.ravel())
    for step in np.eye(len(theta)) * 1e-4:
        assert abs(likelihood(theta + step) - likelihood(theta - step)) / 2e-4 < 2e-3


# -- languages

def grams(text):
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    triples = (data[i: i + 3] for i in range(len(data) - 2))
    return Counter(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20 for a, b, c in triples if (a, b, c) != (32, 32, 32))


def test_nearest_centroid_loop():
    rng = random.Random(8)
    letters = {"xa": "aeioubcd", "xb": "éèßüöklm", "xc": "stuvwxyz"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 30)))
    texts = [text(lang) for lang in letters for _ in range(40)] + ["", "12 3", "A"]
    draw = np.random.default_rng(9)
    weights = draw.uniform(1, 4, li.DIMENSIONS).astype(np.float32)
    seen = {}
    for lo, hi, counts in li.gram_counts(pa.array(texts)):
        for i, vector in zip(range(lo, hi), li.vectors(counts, weights)):
            seen[i] = vector
    centroids = {i: seen[i] for i in (0, 7, 41, 52, 81, 99)}
    for i, t in enumerate(texts):
        own = {k: n * float(weights[k]) for k, n in grams(t).items()}
        norm = math.sqrt(sum(v * v for v in own.values()))
        for j, centroid in centroids.items():
            want = sum(v * float(centroid[k]) for k, v in own.items()) / norm if norm else 0.0
            assert float(seen[i] @ centroid) == pytest.approx(want, abs=1e-5), (i, j)


def test_equal_scores_take_the_first_language(spark):
    centre = np.zeros((2, li.DIMENSIONS), np.float32)
    centre[:] = 1 / math.sqrt(li.DIMENSIONS)
    model = li.LanguageModel(np.ones(li.DIMENSIONS, np.float32), ["xa", "xb"], centre, np.zeros(2))
    docs = spark.createDataFrame([(1, "some words"), (2, "other words here")], "doc_id long, text string")
    assert {r["_language"]["lang_pred"] for r in li.identify(docs, model).collect()} == {"xa"}


def keyed(spark):
    rng = random.Random(10)
    rows = [(lang, rng.randint(-50, 50), rng.randint(0, 3)) for lang in ("a", "b", "b", "b", "c") for _ in range(200)]
    rows += [("d", 1, 1)] * 500 + [("e", 5, 2), ("e", -5, 1)]
    return rows, spark.createDataFrame(rows, "lang string, order long, text_key long").repartition(7)


@pytest.mark.parametrize("most", [1, 9, 1000])
def test_least_rows_equal_a_sort(spark, most):
    rows, table = keyed(spark)
    own = defaultdict(set)
    for lang, *pair in rows:
        own[lang].add(tuple(pair))
    want = {(lang, *pair) for lang, pairs in own.items() for pair in sorted(pairs)[:most]}
    got = [tuple(r) for r in li.least_rows(table, most).collect()]
    assert sorted(got) == sorted(want)


def test_no_window_sorts_a_whole_language(spark):
    table = spark.range(200_000, numPartitions=16).select(
        F.lit("a").alias("lang"), F.xxhash64("id").alias("order"), F.lit(1).cast("long").alias("text_key"))
    first = li.least_rows(table, 500)
    assert first.count() == 500
    ordered = [r["order"] for r in table.orderBy("order").limit(500).collect()]
    assert sorted(r["order"] for r in first.collect()) == ordered
    node = first._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    sizes = []

    def walk(n):
        if n.nodeName().startswith("Exchange") or n.nodeName() == "ShuffleQueryStage":
            plan = n.plan() if n.nodeName() == "ShuffleQueryStage" else n
            sizes.append(plan.metrics().apply("shuffleRecordsWritten").value())
        for i in range(n.children().size()):
            walk(n.children().apply(i))

    walk(node)
    assert sizes and max(sizes) <= 1_500  # 500 and a range of the 256 at most


def test_sample_takes_rows_without_id_by_text(spark):
    rows = [(None, f"unnumbered text {i % 5}", "xa", "k") for i in range(40)] + [(i, "zwölf böse", "xb", "k") for i in range(3)]
    models = []
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, order string").repartition(parts)
        models.append(li.fit_languages(docs, F.lit(True), sample_per_language=3))
    assert models[0].languages == models[1].languages == sorted(models[0].languages)
    np.testing.assert_allclose(models[0].centroids, models[1].centroids, rtol=1e-6)


# -- tokens of sections

def plain_sections(fields, rule, encoding):
    there = [(f, v) for f, v in zip("ab", fields) if v is not None]
    lines = [(f, i, line) for f, v in there for i, line in enumerate(v.split("\n"))]
    text = "\n".join(line for _, _, line in lines)
    owner, names = [], [(f, i) for f, i, _ in lines]
    for k, (_, _, line) in enumerate(lines):
        owner += [k] * (len(line.encode()) + (k + 1 < len(lines)))
    tokens, shared, at = Counter(), Counter(), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        under = owner[at: at + size]
        at += size
        if rule == "most":
            most = max(Counter(under).values())
            section = min(k for k, n in Counter(under).items() if n == most)
        else:
            section = under[0] if rule == "first" else under[-1]
        tokens[section] += 1
        shared[section] += len(set(under)) > 1
    return {(*names[k], owner.count(k), tokens[k], shared[k]) for k in range(len(names))}


@pytest.mark.parametrize("rule", tc.RULES)
def test_tokens_of_sections_one_by_one(spark, rule):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, _ = tc._encoding(path)
    assert isinstance(encoding, tiktoken.Encoding)
    rng = random.Random(11)
    pieces = ["word ", "\n", "\n\n", "  ", "\n   \n", "é", "木", "12", ".", "\t"]
    make = lambda: None if rng.random() < 0.2 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
    rows = [(i, make(), make()) for i in range(150)]
    rows += [(150, "", "\n"), (151, "\n\n\n\n\n\n\n", None), (152, None, None), (153, "a\n \n \n \nb", "")]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    got = defaultdict(set)
    for r in tc.section_tokens(docs, path, ("a", "b"), rule).collect():
        got[r["doc_id"]].add((r["field"], r["section"], r["n_bytes"], r["n_tokens"], r["n_shared"]))
    for i, a, b in rows:
        want = plain_sections((a, b), rule, encoding) if (a, b) != (None, None) else set()
        assert got.get(i, set()) == want, (a, b)
