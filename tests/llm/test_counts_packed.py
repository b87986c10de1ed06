"""Token counts travel as few bytes and leave no shuffle behind."""

import random
from pathlib import Path

import numpy as np

from yieldloom.llm import ngram_join as N


def test_counts_come_back():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (1, 1 << 40), (3, 5), (5000, 1 << 34), (70000, 1 << 17)):
        t = np.unique(rng.integers(0, top, n, np.uint64))
        c = np.where(rng.random(len(t)) < 0.1, rng.integers(2, 1 << 20, len(t)), 1)
        a, b = N._coded(t, c)
        back, counts = N._decoded(a, b)
        assert (back == t).all() and (counts == c).all()
        if n == 5000:
            assert 2 * (len(a) + len(b)) < 12 * len(t)


def test_frequent_tokens(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(300)]
    d = spark.createDataFrame([(x,) for x in [*texts, None, ""]], "text string").repartition(3)

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p.name for x in dirs for p in Path(x).rglob("shuffle_*.data")}

    d = d.localCheckpoint()
    before = files()
    t, n = N.frequent_tokens(d, 2, 8)
    assert not files() - before
    all_, count = np.unique(np.concatenate([N._short(N.shingle_set(x.encode(), 2)) for x in texts]), return_counts=True)
    keep = count >= N.HOT_FROM
    assert keep.sum() > 20 and (t == all_[keep]).all() and (n == count[keep]).all()
