"""The encoder of packing: what it holds between tasks, and ids of words and texts."""

import gc
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from somaframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def made_words(n, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choices("aeioubdfgklmnprstéü", k=pick.randint(6, 14))) + pick.choice(["", ",", "."]) for _ in range(n)]


def test_remembered_words_are_small():
    """Idle workers keep the encoder while other stages run."""
    encoder = packing.WordEncoder(PATH)
    encoder.encode(["a b"])
    words = made_words(60_000)
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for i in range(0, len(words), 10_000):
        encoder.encode([" ".join(words[i: i + 10_000])])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * len(words)


def test_a_full_memory_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    encoder = packing.WordEncoder(PATH)
    words = made_words(300) + ["it's,", "'ll.", "12a3--", "××!", "日本.", "İx", "<b>", "--", "µg", "āb."]
    pick = random.Random(6)
    texts = ["", " \t", "x <|endoftext|> y", *(" ".join(pick.choices(words, k=40)) + pick.choice(["", " ", "\n"]) for _ in range(60)), ""]
    for i in range(0, len(texts), 8):
        part = texts[i: i + 8]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_words_are_counted_like_one_by_one():
    texts = pa.array([" a b A ", "", "b,  c\n", " "])
    words, at, first = packing.distinct_words(texts)
    named = np.array(words.to_pylist(), object)
    assert [[w for w in named[at[a:b]] if w] for a, b in zip(first, first[1:])] == [["a", "b", "a"], [], ["b,", "c"], []]
    found = packing.directions((words, at, first))
    alone = [packing.directions(packing.distinct_words(texts.slice(i, 1)))[0] for i in range(4)]
    assert np.array_equal(found, alone) and not found[[1, 3]].any() and np.allclose(np.linalg.norm(found[[0, 2]], axis=1), 1)
