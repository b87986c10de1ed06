"""Language id, toxicity and the language model: held-out quality, brute-force counts, edge cases."""

import math
import random
import zlib
from collections import Counter

import helpers as h
import numpy as np
import pytest

from pyspark.sql import functions as F

from yieldloom.llm import langid, lm, queries, toxicity
from yieldloom.llm.common import doc_remainder

MID = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, MID).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.97 * len(out)


def test_language_edges(spark):
    df = h.edge(spark)
    model = langid.fit_languages(df.select("doc_id", "text", "lang"))
    got = langid.identify(df, model).collect()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id not in (None, 3)}
    for r in got:
        if r.doc_id in texts:
            t = texts[r.doc_id]
            assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    none = langid.fit_languages(h.empty(spark).select("doc_id", "text", "lang"))
    assert none.langs == [] and {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(h.empty(spark), model).count() == 0


def test_grams_do_not_depend_on_neighbours():
    texts = ["Der Hund", None, "le chien", "", "x" * 5000]
    together = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        assert (together[i] == langid.gram_counts([t])[0]).all()


def all_segments(scores):
    """Maximal scoring segments by their definition: best segment first, then left and right of it."""
    def rec(a, b):
        best = None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (best is None or s > best[2] or (s == best[2] and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1, s)
        return [] if best is None else rec(a, best[0]) + [best] + rec(best[1], b)

    return rec(0, len(scores))


def test_segments_are_the_maximal_ones():
    rnd = random.Random(8)
    for _ in range(300):
        n = rnd.randrange(1, 40)
        hits = [(i, rnd.choice([2.3, 1.1, 0.7, -1.3]) + rnd.random() / 100) for i in range(n) if rnd.random() < 0.3]
        cost = 0.37
        scores = [-cost] * n
        for i, s in hits:
            scores[i] = s
        got = [(a, b) for a, b, _ in toxicity.segments(hits, cost)]
        assert got == [(a, b) for a, b, _ in all_segments(scores)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in out) >= 0.97 * len(out)
    assert all(r.passages for r in out if r.predicted)


def test_toxicity_edges(spark):
    df = h.edge(spark)
    model = toxicity.fit_toxicity(spark.createDataFrame([("bad bad", 1), ("good", 0), (None, 0), ("x", None), ("y", 7)], "text string, toxic int"))
    assert toxicity.score_toxicity(df, model).count() == df.count()
    none = toxicity.fit_toxicity(spark.createDataFrame([], "text string, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(df, none).collect())
    assert toxicity.score_toxicity(h.empty(spark), model).count() == 0


def test_toxicity_lexicon_is_never_cut(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(12_000)) for x in "ab")
    train = spark.createDataFrame([(one, 1)] * 40 + [(two, 0)] * 40, "text string, toxic int")
    assert len(toxicity.fit_toxicity(train).lexicon) == 24_000
    with pytest.raises(ValueError):
        toxicity.fit_toxicity(train, size=23_999)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in lm.init_params(np.arange(200, 70, -1), 5, 1).items()}
    x, y, h0 = rng.integers(0, 130, (4, 3)), rng.integers(0, 130, (4, 3)), np.zeros((3, 5))
    x[2, 1] = lm.END
    g = lm.gradients(p, x, y, h0)[0]
    for k in p:
        for _ in range(10):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            if k == "E":
                i = (x.reshape(-1)[rng.integers(0, 12)], i[1])
            if k in ("W", "wb"):
                i = (y.reshape(-1)[rng.integers(0, 12)] // lm.WIDTH, *i[1:])
            old, e = p[k][i], 1e-5
            p[k][i] = old + e
            up = lm.gradients(p, x, y, h0)[2]
            p[k][i] = old - e
            down = lm.gradients(p, x, y, h0)[2]
            p[k][i] = old
            assert abs((up - down) / (2 * e) - g[k][i]) < 1e-6


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    rng = np.random.default_rng(1)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in lm.init_params(np.arange(300, 172, -1), 8, 2).items()}
    state = rng.normal(0, 1, (1, 8)).astype(np.float32)
    assert abs(sum(math.exp(lm.log_prob(p, state, np.array([y]))[0]) for y in range(128)) - 1) < 1e-4
    docs = [np.append(rng.integers(1, 128, n), lm.END) for n in (0, 1, 5, 300, 40, 5)]
    alone = [lm.score_documents(p, [d])[0] for d in docs]
    for tokens in (1, 7, 1 << 16):
        assert np.allclose(lm.score_documents(p, docs, tokens), alone, rtol=1e-4)


def counts(rows, held):
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update(h.words(h.lower(t)) + [None])
    return c


def check(got, rows, held):
    c = counts(rows, held)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(h.words(t)) + 1, sum(c[w] > 0 for w in h.words(h.lower(t)) + [None]), n) for d, t in rows), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    base = sorted(round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in h.words(h.lower(t)) + [None]), 4) for _, t in rows)
    assert np.allclose(sorted(r.base_score for r in got), base, rtol=1e-7, atol=1e-3)


def test_language_model(spark):
    df = spark.read.parquet(f"{MID}/documents.parquet")
    got = queries.op10_language_model(spark, MID).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()], lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the unigram on texts it has not seen


def test_language_model_edges(spark):
    df = h.edge(spark)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    got = lm.score_corpus(df, doc_remainder("doc_id", 7) == 2, epochs=1).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()], held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_corpus(h.empty(spark), doc_remainder("doc_id", 7) == 2).count() == 0
    all_out = lm.score_corpus(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in all_out)


def test_language_model_learns_from_every_training_document(spark):
    # each document repeats ten words of its own, so only a network that has read it beats the unigram on it
    rows = spark.createDataFrame([(d, " ".join(f"w{d}x{i}" for i in range(10)) + " ") for d in range(20)], "doc_id long, text string")
    got = lm.score_corpus(rows.select("doc_id", F.repeat("text", 2500).alias("text")), F.lit(False)).collect()
    assert len(got) == 20 and all(r.n_tokens == 25_001 for r in got)
    assert all(r.score > 0.5 * r.base_score for r in got), sorted(r.score / r.base_score for r in got)


def test_language_model_in_several_turns(spark):
    df = h.edge(spark)
    got = lm.score_corpus(df, F.lit(False), epochs=1, shard=12_000, workers=1).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()], lambda d: False)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    again = lm.score_corpus(df.repartition(3), F.lit(False), epochs=1, shard=12_000, workers=1).collect()
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in again), rtol=1e-5)


def test_training_reads_every_token_once():
    seen = []
    real = lm.gradients

    def watch(p, xs, ys, h):
        seen.extend(ys.reshape(-1).tolist())
        return real(p, xs, ys, h)

    lm.gradients = watch
    try:
        for n in (0, 1, 2, 50, 95, 96, 1000, 1001, 1047):
            seen.clear()
            stream = np.concatenate([[lm.END], 1 + np.arange(n) % 120])
            lm.train(stream, lm.init_params(np.full(121, 5), 4, 1))
            assert Counter(seen) == Counter(stream[1:].tolist())
    finally:
        lm.gradients = real


def test_each_distinct_word_of_a_slice_is_hashed_once(monkeypatch):
    called = []
    real = lm.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(lm.xxhash, "xxh3_64_intdigest", lambda w, *a: called.append(w) or real(w, *a))
    names = [b"w%d" % i for i in range(70_000)]
    texts = [b"", b" ".join(names), b" \n", b" ".join(names).upper(), b"W1  w1"]
    size, u, at = lm.words_of(texts)
    assert size.tolist() == [0, 70_000, 0, 70_000, 2] and called == names
    assert u[at].tolist() == [real(w) for x in texts for w in x.lower().split()]
    assert [len(x) for x in lm.words_of([b"", b" "])] == [2, 0, 0]


def test_sums_and_maxima_by_row():
    rng = np.random.default_rng(3)
    key = np.concatenate([np.repeat(i, i) for i in (1, 2, 8, 9, 10, 16, 17, 25, 31, 32, 33, 34, 129, 130, 500)])
    rng.shuffle(key)
    rows = rng.normal(0, 1, (len(key), 6)).astype(np.float32)
    seen, sums = lm._sums_by(key, rows, 501)
    want = np.zeros((501, 6))
    np.add.at(want, key, rows)
    assert seen.tolist() == sorted(set(key.tolist())) and np.allclose(sums, want[seen], atol=1e-4)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    assert (sums == np.add.reduceat(rows[order], first, axis=0)).all()  # the bits of numpy's own sums
    for n in (1, 6, 64):
        assert (lm._row_max(rows[:, :1] * np.arange(1, n + 1, dtype=np.float32)) == (rows[:, :1] * np.arange(1, n + 1)).max(1, keepdims=True).astype(np.float32)).all()
