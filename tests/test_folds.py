"""Folds over the days of many symbols against pandas and plain loops over one symbol."""

import numpy as np
import pandas as pd

from yieldloom.functions import sequential as sq
from yieldloom.operators.indicators import supertrend
from yieldloom.operators.mlprep import zigzag_labels


def histories(seed, sizes, gaps=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        x = np.round(100 + np.cumsum(rng.integers(-3, 4, n)), 2).astype(float)
        x[rng.random(n) < gaps] = np.nan
        out.append(x)
    return out


def of_one(x, rsi, ema, zero_loss, tight):
    s = pd.Series(x)
    move, out = s.diff(), []
    for p in rsi:
        gain = move.clip(lower=0).ewm(alpha=1 / p, adjust=False, min_periods=p).mean()
        loss = (-move).clip(lower=0).ewm(alpha=1 / p, adjust=False, min_periods=p).mean()
        y = 100 - 100 / (1 + gain / loss.where(loss > 0))
        out.append(y if zero_loss is None else y.mask((loss == 0) & (gain > 0), zero_loss))
    out += [s.ewm(span=n, adjust=False, min_periods=n).mean() for n in ema]
    width = {n: s.rolling(n, min_periods=n).std() * 4 / s.rolling(n, min_periods=n).mean() * 100 for n in sorted({t[0] for t in tight})}
    return out + list(width.values()) + [width[n] <= width[n].rolling(k, min_periods=k).quantile(q / 100) for n, q, k in tight]


def test_smoothing_equals_pandas():
    sizes = [1, 40, 3, 200, 40, 2, 117]
    for gaps in (0.0, 0.2):
        xs = histories(5, sizes, gaps)
        xs.append(np.full(30, 7.0)), xs.append(np.arange(30.0)), xs.append(np.full(9, np.nan))
        x = np.concatenate(xs)
        start = np.cumsum([0] + [len(v) for v in xs[:-1]])
        for zero_loss in (100.0, None):
            how = ((2, 7, 14), (3, 5, 20), zero_loss, ((5, 20.0, 10), (10, 30.0, 20)))
            _, fold, names = sq.smoothing("close", *how)
            got = fold({"close": x}, sq.Days(start, len(x)))
            want = [np.concatenate(c) for c in zip(*[of_one(v, *how) for v in xs])]
            assert len(got) == len(want) == len(names)
            for a, b in zip(got, want):
                np.testing.assert_array_equal(a, b)


def supertrend_of_one(h, lo, c, length, factor):
    prev = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - lo, np.fmax(np.abs(h - prev), np.abs(lo - prev)))
    atr = pd.Series(tr).ewm(alpha=1 / length, adjust=False, min_periods=length).mean().to_numpy()
    up, dn = (h + lo) / 2 + factor * atr, (h + lo) / 2 - factor * atr
    way, line = np.ones(len(c)), np.full(len(c), np.nan)
    for i in range(1, len(c)):
        way[i] = 1 if c[i] > up[i - 1] else -1 if c[i] < dn[i - 1] else way[i - 1]
        if way[i] == way[i - 1]:
            if way[i] > 0 and dn[i] < dn[i - 1]:
                dn[i] = dn[i - 1]
            if way[i] < 0 and up[i] > up[i - 1]:
                up[i] = up[i - 1]
        line[i] = dn[i] if way[i] > 0 else up[i]
    return line, way, np.where(way > 0, line, np.nan), np.where(way < 0, line, np.nan)


def test_supertrend_equals_a_loop():
    cs = histories(6, [60, 1, 300, 9, 60])
    rng = np.random.default_rng(7)
    each = [(c + rng.integers(0, 3, len(c)), c - rng.integers(0, 3, len(c)), c) for c in cs]
    start = np.cumsum([0] + [len(c) for c in cs[:-1]])
    got = supertrend(3, 1.0)[1](dict(zip(("high", "low", "close"), map(np.concatenate, zip(*each)))), sq.Days(start, sum(map(len, cs))))
    for a, b in zip(got, map(np.concatenate, zip(*[supertrend_of_one(*x, 3, 1.0) for x in each]))):
        np.testing.assert_array_equal(a, b)
    assert len(set(got[1])) == 2


def zigzag_of_one(c, threshold):
    out, lo, hi, trend = ["hold"] * len(c), 0, 0, 0
    for i in range(1, len(c)):
        lo, hi = i if c[i] < c[lo] else lo, i if c[i] > c[hi] else hi
        if trend >= 0 and c[i] <= c[hi] * (1 - threshold):
            out[hi], trend, lo, hi = "sell", -1, i, i
        elif trend <= 0 and c[i] >= c[lo] * (1 + threshold):
            out[lo], trend, lo, hi = "buy", 1, i, i
    return out


def test_histories_span_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sq, "BLOCK_ROWS", 64)
    cs = histories(8, [50, 1, 130, 20, 33], 0.05)
    names = ["a", None, "c", "", "e"]
    rows = [(s, "2000-01-01", i, float(x) if x == x else None) for s, c in zip(names, cs) for i, x in enumerate(c)]
    d = spark.createDataFrame(rows, "symbol string, d string, i int, close double").selectExpr("symbol", "date_add(d, i) as date", "close", "float(close) as f")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = zigzag_labels(d, 0.03).orderBy("symbol", "date").toPandas()
        rsi = sq.with_smoothed(d, "close", rsi=(3,)).orderBy("symbol", "date").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [1, 3, 0, 2, 4]
    assert got["trade_signal"].tolist() == [x for k in order for x in zigzag_of_one(cs[k], 0.03)]
    np.testing.assert_array_equal(rsi["rsi_3"], np.concatenate([of_one(cs[k], (3,), (), 100.0, ())[0] for k in order]))
    np.testing.assert_array_equal(rsi["close"], np.concatenate([cs[k] for k in order]))


def test_nan_becomes_null_and_no_rows_stay_none(spark):
    d = spark.sql("select 'a' as symbol, date'2000-01-01' as date, double('NaN') as close, double('NaN') as other")
    assert sq.with_smoothed(d, "close", rsi=(2,)).collect() == [("a", d.first().date, None, None, None)]
    assert sq.with_smoothed(d.limit(0), "close", rsi=(2,)).count() == 0
