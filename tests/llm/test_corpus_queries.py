"""Corpus queries against SQL or brute force on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from somaframe.llm import registry
from somaframe.sources.writers import staged

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def texts(sf=SF):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall())


def rows(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(registry.SQL[name])
    names = [d[0] for d in expected.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    assert got == Counter(expected.fetchall()) and got


def test_registered():
    kinds = {name.split("_")[0] for name in registry.QUERIES}
    assert kinds == {f"op{n}" for n in range(1, 14)} and "pipeline" in corpus_pipeline.QUERIES


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_near_dedup_brute_force(spark):
    sets = {d: shingles(t, 3) for d, t in texts(SMALL).items()}
    holders, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for members in holders.values():
        shared.update((a, b) for i, a in enumerate(members) for b in members[i + 1:])
    above = {d: d for d in sets}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op2_near_dedup", SMALL)}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
    assert len({c for _, c, _ in got.values()}) < len(got)


def test_suffix_dedup_brute_force(spark):
    seen, expected = set(), {}
    for d, text in texts().items():
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            window = data[i:i + 100]
            if window in seen:
                gone[i:i + 100] = True
            seen.add(window)
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        expected[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op10_suffix_dedup")}
    assert got == expected and sum(v[1] for v in got.values()) > 0


def check_packing(pieces, all_texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(all_texts)
    for d, own in by_doc.items():
        ids = np.array(tokenizer.encode(all_texts[d], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sum(sum(p.length for p in own) < 4096 for own in by_sequence.values()) <= 1


def test_packing_round_trip(spark):
    check_packing(rows(spark, "op9_packing"), texts())


def test_section_tokens_sum_to_the_document(spark):
    from somaframe.llm.token_counts import _encoding

    encoding, _ = _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table = duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{SF}/documents.parquet'").fetchall()
    expected = {d: len(encoding.encode_ordinary("\n".join(v))) for d, *v in table}
    got = Counter()
    for r in rows(spark, "op3_token_counts"):
        got[r.doc_id] += r.n_tokens
    assert got == expected


def test_language_held_out(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SMALL}/documents.parquet'").fetchall())
    found = rows(spark, "op7_language_id", SMALL)
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found) and sum(r.rejected for r in found) <= 0.002 * len(found)


def test_quality_held_out(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    found = rows(spark, "op1_quality", SMALL)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_pipeline_brute_force(spark):
    """Every stage against its definition on the documents the one before kept."""
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, kept = docs.columns, texts()
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        found[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(found["language"]) >= 0.99 * len(kept)
    first = {}
    for d in sorted(found["language"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", found["language"][d]), d)
    assert set(found["exact"]) == set(first.values())
    sets = {d: shingles(t, 5) for d, t in found["exact"].items()}
    above = {d: d for d in sets}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    assert set(found["near"]) == {d for d in sets if root(d) == d}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    dirty = {d for d, t in found["near"].items() for w in [words(t)] if any(tuple(w[i:i + 10]) in windows for i in range(len(w)))}
    assert set(found["benchmark"]) == set(found["near"]) - dirty
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(pieces, found["benchmark"])
    assert all(len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
