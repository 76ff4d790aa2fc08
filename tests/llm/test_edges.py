"""Missing values, empty and long texts, repeated rows, clashing columns, empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from somaframe.llm import (
    components, decontaminate, exact_dedup, language_id, lm_score, near_dedup, packing, quality_crf, substring_dedup,
    suffix_dedup, token_counts,
)

SCHEMA = "doc_id long, text string, lang string, source string, score double, kept boolean, n long, uid long, words string, key string"
PROSE = " ".join(f"word{i % 97} and{i % 13}" for i in range(60))
LONG = "\n".join(f"line {i} of many, the {i * 7919 % 10007} and the {i * 104729 % 30011}" for i in range(20_000))
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t"), (6, "?!"), (7, LONG), (8, "x" * 300_000),
    (9, PROSE + " more"), (None, PROSE), (None, None), (10, "short text"), (11, "naïve É 日本 \u0000 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", None, 0.1, True, 5, 6, "w", "k") for d, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE, "w"), (2, None, "w"), (3, "", "w"), (4, "Short Text", "w")], "item_id long, text string, words string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (7, 0), (99, 1), (10, None), (None, 1)], "doc_id long, quality long")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def same_rows(found):
    return {d: len(r) for d, r in found.items()} == {1: 1, 2: 2, None: 2} | {d: 1 for d in range(3, 12)}


def test_exact(docs):
    got = by_id(exact_dedup.exact_groups(docs))
    assert same_rows(got)
    assert got[1][0].kept and not got[2][0].kept and got[2][0].keep_id == 1 and got[1][0].group_size == 4
    assert got[3][0].group_size == 3 and got[4][0].keep_id == 3 and got[5][0].keep_id == 5  # a blank is not empty


def test_near(docs):
    got = by_id(near_dedup.similar_groups(docs))
    assert same_rows(got)
    assert [r.component_id for r in got[2]] == [1, 1] and got[9][0].component_id == 1 and not got[9][0].kept
    assert got[3][0].n_shingles == 0 and got[4][0].kept and got[10][0].n_shingles == 1
    assert all(r.component_id is None for r in got[None])


def test_components_of_a_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.component) for r in components.components(links).collect()} == {(i, 0) for i in range(301)}


def test_substrings(docs):
    got = by_id(substring_dedup.cut_repeats(docs))
    assert same_rows(got)
    assert got[1][0].n_removed == 0 and all(r.n_removed == 120 and r.kept == "" for r in got[2])
    assert got[9][0].kept == "more" and got[3][0].kept == "" and got[5][0].n_words == 0
    assert any(r.n_removed == 120 for r in got[None])


def test_bytes(docs):
    got = by_id(suffix_dedup.cut_repeated_bytes(docs))
    assert same_rows(got)
    assert got[1][0].n_removed == 0 and all(r.n_removed == len(PROSE) for r in got[2])
    assert got[8][0].n_removed == 300_000 - 1 and got[8][0].n_spans == 1  # all windows but the first begin earlier
    assert got[3][0].n_bytes == 0 and bytes(got[9][0].kept) == b" more"


def test_decontamination(docs, bench):
    got = by_id(decontaminate.contamination(docs, bench))
    assert same_rows(got)
    assert all(r.n_hit == 120 and r.n_items == 1 for r in got[2]) and got[10][0].n_hit == 2
    assert got[3][0].n_words == 0 and not got[7][0].contaminated


def test_languages(docs):
    model = language_id.fit_languages(docs, F.lit(True))
    got = by_id(language_id.identify(docs, model))
    assert same_rows(got)
    assert got[1][0]._language.lang_pred == "en" and got[1][0].score == 0.1
    assert {got[d][0]._language.lang_pred for d in (3, 4, 5, 6)} == {"und"}
    none = language_id.fit_languages(docs, F.lit(False))
    assert {r._language.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_quality(docs, labels):
    model = quality_crf.fit_quality(docs, labels)
    got = by_id(quality_crf.quality_scores(docs, model))
    assert same_rows(got)
    assert got[3][0].score == got[4][0].score == pytest.approx(model.prior) and got[5][0].n_lines == 2
    assert quality_crf.fit_quality(docs, labels.filter("false")) is None
    assert {r.score for r in quality_crf.quality_scores(docs, None).collect()} == {0.5}


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in TEXTS}
    assert sum(p.length for p in pieces if p.doc_id in (3, 4, 5)) == 3
    at = sorted((p.sequence_id * 4096 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0


def test_hilbert_neighbours():
    import numpy as np

    side = (np.arange(16) + 0.5) / 8 - 1
    points = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    order = np.argsort(packing.hilbert_keys(points, 4))
    steps = np.abs(np.diff(points[order], axis=0)).sum(1)
    assert len(set(packing.hilbert_keys(points, 4).tolist())) == 256 and np.allclose(steps, 1 / 8)


def test_words_as_the_tokenizer():
    encoder = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    import numpy as np

    for text in ["it's I'LL '' 12a3 É É ß İx a b \x00 z", "<|endoftext|> hi", "ﬁ Σας ΑΣ", "日本 語", "$$ ** 'RE'S", ""]:
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(docs, rule):
    found = token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), rule=rule)
    got = by_id(found.filter("field = 'text'"))
    assert 3 not in got and got[4][0].n_bytes == 0 and len(got[7]) == 20_000
    assert sum(r.n_bytes for r in got[7]) == len(LONG)


def test_allotment():
    import numpy as np

    ends, borders = np.array([2, 6, 9, 12]), np.array([0, 3, 10, 12])
    assert token_counts.allot(ends, borders, "first")[0].tolist() == [0, 0, 1, 1]
    assert token_counts.allot(ends, borders, "last")[0].tolist() == [0, 1, 1, 2]
    assert token_counts.allot(ends, borders, "most")[0].tolist() == [0, 1, 1, 2]
    assert token_counts.allot(ends, borders, "most")[1].tolist() == [False, True, False, True]


def test_scores(docs):
    got = by_id(lm_score.backoff_scores(docs))
    assert same_rows(got)
    assert got[3][0].log_score == 0 and got[1][0].n_backoff == 0 and got[10][0].n_backoff == 2


OPERATORS = {
    "exact": exact_dedup.exact_groups, "near": near_dedup.similar_groups, "substrings": substring_dedup.cut_repeats,
    "bytes": suffix_dedup.cut_repeated_bytes, "scores": lm_score.backoff_scores,
    "sections": lambda d: token_counts.section_tokens(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "languages": lambda d: language_id.identify(d, language_id.fit_languages(d, F.lit(True))),
    "quality": lambda d: quality_crf.quality_scores(d, None),
    "decontamination": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.filter("false")).count() == 0
