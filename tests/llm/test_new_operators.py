"""Personal data, collocations and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from somaframe.llm import collocations as co
from somaframe.llm import merkle_manifest as mm
from somaframe.llm import pii
from somaframe.llm import quality_crf as qc

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, place long, n long, key string, base string, terms string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "k", "b", "t") for r in rows], SCHEMA).repartition(parts)


def docs_with(spark, texts):
    return table(spark, [(i, "s", "en", 1, t) for i, t in texts])


# -- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """The last node and each lowest node's siblings, left and right by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // fanout * fanout
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1:a + fanout])))
        nodes = [H(*nodes[a:a + fanout]) for a in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], paths


def plain_manifest(rows, fanout, tampered):
    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)])
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subs.append((own, *tree([leaf(r, r[4]) for r in own], fanout)))
    root, tops = tree([s[1] for s in subs], fanout)
    out = []
    for (own, sub, paths), top in zip(subs, tops):
        for r, path in zip(own, paths):
            text = r[4]
            if tampered(r) and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in path + top:
                node = H(left, node, right)
            out.append((r[0], leaf(r, r[4]), sub, root, H(*[a + b for a, b in path + top]), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("fanout, n", [(2, 23), (16, 300), (3, 1)])
def test_manifest_equals_plain_trees(spark, fanout, n):
    rnd = random.Random(n)
    sources = ["hot"] * 6 + ["É", "a", "B", None, "one"]
    rows = [(i, "hot" if i < n // 3 else rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([i, None]),
             rnd.choice([None, "", "Text É", "lower", "UP" * 9])) for i in range(n)]
    rows += [(None, "a", None, None, "No Id"), (None, None, None, None, None), (5, "hot", "en", 1, "Again"), (5, "hot", "en", 1, "Again"),
             (9, "lone", "en", 1, "Only One")]
    third = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    got = mm.manifest(table(spark, rows), fanout, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    expected = plain_manifest(rows, fanout, third)
    assert Counter(tuple(r[x] for x in names) for r in got.collect()) == expected
    assert {x[-1] for x in expected} == ({True, False} if n > 1 else {x[-1] for x in expected})


def test_manifest_of_one_row_and_of_none(spark):
    one = mm.manifest(table(spark, [(1, None, None, None, None)])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("") and one[0].verified
    assert mm.manifest(table(spark, [])).collect() == []


# -- collocations

def plain_collocations(rows, threshold, top):
    counts, total = Counter(), Counter()
    for _, _, lang, _, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= threshold}
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and 100 * n >= 50 * a and p in (q[:2], q[1:]) for (x, q), n in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, left, right, total[lang], -score))
    return ranked


def colloc_rows():
    rnd = random.Random(4)
    words = ["New", "york", "city", "of", "the", "É", "x_1", "rare", "(a)", "b"]
    rows = []
    for i in range(240):
        text = "".join(rnd.choice(words[:3 + i % 8]) + rnd.choice([" ", "  ", "\t", " ", ", ", "\n", ".", " \r\n"]) for _ in range(rnd.randrange(40)))
        rows.append((i, "s", ["en", "fr", None][i % 3], 1, text))
    common = "one hot phrase again, one hot phrase"
    rows += [(900 + i, "s", "en", 1, common) for i in range(120)]
    return rows + [(None, "s", "en", 1, common), (1, "s", None, 1, None), (2, "s", "en", 1, ""), (2, "s", "en", 1, ""), (3, "s", "en", 1, " \t.;"),
                   (4, "s", "de", 1, "w" * 200_000 + " end " * 3_000)]


@pytest.mark.parametrize("options", [{}, {"rate": 0.0}, {"rate": 1.0, "proposed": 1}, {"bits": 20, "rate": 0.3, "proposed": 9}])
def test_collocations_equal_plain_counts(spark, options):
    rows = colloc_rows()
    got = co.collocations(table(spark, rows), top=15, bits=options.pop("bits", 22), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 10, 15)


def test_border_failures_lead_to_further_passes(spark):
    docs = table(spark, colloc_rows())
    counts, passes = co.phrase_counts(docs, rate=0.0, bits=20)
    assert passes == 3 and counts.filter("size = 3").count() > 0  # nothing proposed: words, then pairs, then triples
    assert co.phrase_counts(docs, rate=1.0, proposed=10, bits=20)[1] == 2
    assert co.collocations(table(spark, []), bits=20).collect() == []


# -- personal data

def plain_spans(text):
    out = []
    for rank, kind in enumerate(pii.PATTERNS):
        for m in re.finditer(pii._RE[kind], text):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
                  "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), v))
    return sorted(out)


def test_base_spans_equal_plain_matches(spark):
    rnd = random.Random(8)
    pieces = ["a.b+c@x-y.org", "q@r", "@", "z@a.b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "000255.01.2.3", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "79927398713", "+1 (555) 010-99 99", "+12", "+1 2-", "É", "日本", "\U0001f600", " ", "\n", ".", "-", "12", "7 ", "word"]
    texts = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30)))) for i in range(400)]
    texts += [(500, None), (501, ""), (502, "x" * 3_000), (503, "1" * 3_000), (504, "a@" + "b." * 2_000 + "c"), (505, "4 x " * 2_000 + "+1 555 010 9999"),
              (506, " ".join(f"u{i}@e.org" for i in range(900))), (None, "me@x.org"), (7, "again@x.org"), (7, "again@x.org")]
    got = pii.personal_data(docs_with(spark, texts)).select("doc_id", "base", "sanitised").collect()
    plain = {}
    for d, t in texts:
        plain.setdefault(d, []).append(plain_spans(t or ""))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append([(s.start, s.rank, s.end, s.value) for s in r.base])
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in plain.items()}
    assert len({s[1] for v in plain.values() for x in v for s in x}) == 4
    assert {r.doc_id: r.sanitised for r in got}[506].startswith("[EMAIL] [EMAIL]") and {r.doc_id: r.sanitised for r in got}[500] == ""
    assert pii.personal_data(docs_with(spark, [])).collect() == []


def test_long_runs_take_linear_time(spark):
    texts = [(1, "x" * 1_000_000 + "@"), (2, "1" * 1_000_000), (3, "a@" + "b." * 200_000 + "c"), (4, "+1" + " " * 500_000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.base] for r in pii.personal_data(docs_with(spark, texts)).select("doc_id", "base").collect()}
    assert got == {1: [], 2: [], 3: [(0, 400_003)], 4: []}


def test_terms_that_disclose_an_entity(spark):
    rnd = random.Random(3)
    filler = [f"common{chr(97 + i)}" for i in range(12)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [(i, f"{some(9)} Boss Zorblat {some(2)} zor@corp.org {some(9)}") for i in range(8)]
    texts += [(20 + i, f"{some(30)} x{i}@mail.org {some(4)} {chr(65 + i)}nique word") for i in range(12)]
    texts += [(40 + i, "Copy says Kwyjibo at kw@corp.org and more") for i in range(30)]  # one surrounding only
    texts += [(100 + i, some(40)) for i in range(200)]
    texts += [(400, "far Zorblat. " + some(60) + " zor@corp.org"), (401, "Zorblat, clean")]
    got = {r.doc_id: r for r in pii.personal_data(docs_with(spark, texts), alpha=1.5).collect()}
    spans = {d: [s.value for s in r.spans if s.rank == 4] for d, r in got.items()}
    assert all(set(spans[i]) == {"boss", "zorblat"} for i in range(8)) and spans[400] == ["zorblat"]
    assert not any(spans[d] for d in spans if d >= 20 and d != 400)  # copies, clean documents, common words
    # the name stands in a document without the address too, the title in none
    assert "Boss" not in got[0].sanitised and "[TERM]" in got[0].sanitised and "[EMAIL]" in got[0].sanitised
    text = dict(texts)[0]
    assert all(text[s.start:s.end].lower() == s.value for s in got[0].spans if s.rank == 4)


# -- quality: whole documents in training

def test_quality_learns_from_whole_long_documents(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(qc, "train", lambda rows, lines_of, labels: taught.append((len(rows), lines_of.tolist(), labels.tolist())))
    texts = [(1, "\n".join(f"line {i}" for i in range(900))), (2, "one\ntwo"), (3, "\n".join("z" for _ in range(3_000)))]
    docs, labels = docs_with(spark, texts), spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality long")
    qc.fit_quality(docs, labels)
    qc.fit_quality(docs, labels, longest=5_000)
    (total, lines, _), (whole, all_lines, _) = taught
    assert total == 902 and sorted(lines) == [2, 900] and whole == 3_902 and sorted(all_lines) == [2, 900, 3_000]
