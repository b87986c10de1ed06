"""Exact dedup, n-gram join and components against brute force."""

import hashlib
import random
from collections import defaultdict

import helpers as h
import pytest

from yieldloom.llm.components import connected
from yieldloom.llm.exact_dedup import exact_dedup
from yieldloom.llm.ngram_join import lead, linked, need, ngram_components, overlaps, shingle_set


def dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[h.lower(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep, done = max((i for i in ids if i is not None), default=None), False
        for d in ids:
            kept = d == keep and not done
            done |= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("first", [1, 64])
def test_exact_dedup(spark, first):
    df = h.edge(spark)
    got = exact_dedup(df, first=first, widen=64).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == dedup([(r.doc_id, r.text) for r in df.collect()])


def test_exact_dedup_shared_prefixes_and_ends(spark):
    p = "p" * 700
    texts = [p, p + "a", p + "b", p + "a", p[:64], p[:65], p[:64], p[:512 + 64], p[:512 + 64] + "q", (p + "A"), "é" * 40, "É" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == dedup(list(enumerate(texts)))


def test_empty_tables(spark):
    assert exact_dedup(h.empty(spark)).count() == 0
    assert ngram_components(h.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_ngram_components(spark, block):
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(90):  # chains of near copies around three texts, many near the threshold
        w = list(base[i % 3])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = "z" + str(rnd.randrange(5))
        rows.append((1000 - i, " ".join(w)))
    rows += [(r.doc_id, r.text) for r in h.edge(spark).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_components(df, block=block).select("doc_id", "n_shingles", "component_id").collect()
    want = h.jaccard_components(rows)
    want = [(d, n, c if n else d) for d, n, c in want]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_prefix_bound_holds():
    """Linked sets share at least the smaller lead of their prefixes, whatever the order."""
    rnd = random.Random(1)
    for _ in range(300):
        a = set(rnd.sample(range(400), rnd.randrange(1, 120)))
        b = {x for x in a if rnd.random() > 0.08} | set(rnd.sample(range(400), rnd.randrange(0, 8)))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        pa, pb = (set(sorted(s)[: len(s) - need(len(s), 85) + lead(len(s))]) for s in (a, b))
        assert len(pa & pb) >= min(lead(len(a)), lead(len(b)))


def test_overlaps_and_links():
    texts = ["a b c d e f", "a b c d e f g", "x y", "x  Y", "q r s t u"]
    sets = [shingle_set(t.encode()) for t in texts]
    plain = [h.shingles(t) for t in texts]
    assert overlaps(sets, sets).tolist() == [[len(a & b) for b in plain] for a in plain]
    assert linked(sets, sets, 85).tolist() == [[i, j] for i, a in enumerate(plain) for j, b in enumerate(plain) if 100 * len(a & b) >= 85 * len(a | b)]


def test_connected(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(7, 7)]
    find, join = h.union_find(300)
    for a, b in edges:
        join(a, b)
    got = {r.vertex: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if find(v) != v}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_id_link(spark):
    w = [f"a{i}" for i in range(120)]
    cut = lambda at: " ".join(w[at : at + 100])
    other = [f"b{i}" for i in range(100)]
    alone = [f"c{i}" for i in range(100)]
    rows = [(1, cut(0)), (None, cut(7)), (2, cut(14))]  # 1 and 2 are linked only through the row without an id
    rows += [(5, " ".join(other)), (None, " ".join(other + ["more"])), (None, " ".join(alone)), (None, " ".join(alone + ["more"])), (None, None)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(h.jaccard_components(rows), key=str)
    assert sorted(r.component_id for r in got if r.component_id) == [1, 1, 1, 5, 5]
    assert len({r.component for r in got if r.component is not None}) == 3


def test_short_words_are_hashed_without_a_call_each(monkeypatch):
    from yieldloom.llm import ngram_join

    called = []
    real = ngram_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngram_join.xxhash, "xxh3_64_intdigest", lambda w, *a: called.append(w) or real(w, *a))
    long, edge = b"Q" * 65, b"q" * 64
    raw = b"\x0b The the THE \xc3\x84 \xc3\xa4\tx\x00 x \x00x " + edge + b" " + long + b"\r\n" + long.lower() + b" ab ba a b" + b" \x1c\x85"
    assert len(shingle_set(raw)) == len(raw.lower().split()) - 3
    assert called == [long.lower()] * 2
    h, start, end = ngram_join.word_hashes(raw)
    words = raw.lower().split()
    assert [raw[i:j].lower() for i, j in zip(start.tolist(), end.tolist(), strict=True)] == words
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
    assert not len(ngram_join.word_hashes(b"")[0]) and not len(ngram_join.word_hashes(b" \t\n\x0b\x0c\r")[0])
