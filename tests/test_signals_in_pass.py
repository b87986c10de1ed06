"""Signals and look-ahead come from the pass that smooths: nothing is dealt or sorted anew behind it."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldloom.functions.sequential import fold_by_symbol
from yieldloom.operators import strategy as S


def bars(spark):
    rng, rows = random.Random(5), []
    for s in ("A", "B", None):
        x = 100.0
        for k in range(150 if s != "B" else 2):
            x = max(20.0, x + rng.gauss(0, 2))
            gone = k in (60, 61)
            rows.append((s, "all", dt.date(2000, 1, 1) + dt.timedelta(days=k), k + 1, None if gone else round(x, 2), rng.choice(["bull", "bear", None]), 100.0 + k % 5, rng.random() * 100))
    return spark.createDataFrame(rows, "symbol string, part string, date date, rn int, close double, regime string, bench double, pct_20 double")


def plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def test_no_window_behind_the_pass(spark):
    rs = S.rules("quick")
    d = bars(spark)
    sig = S.signals(d, rs)
    above = plan(sig)[: plan(sig).index("MapInArrow")]
    assert "Window" not in above and "Exchange" not in above
    rows = sig.collect()
    assert len(rows) == 8 * d.count() and sum(r.setup for r in rows) > 3
    last = S.signals(d, rs, latest=True).collect()
    assert sorted(map(repr, last)) == sorted(repr(r) for r in rows if r.rn == (2 if r.symbol == "B" else 150)) and len(last) == 24
    assert "Window" not in plan(S.trades(d, rs, S.grid_table(spark, "quick")))


def test_signals_equal_window_columns(spark):
    rs = [S.Rule("regime_rsi", 7, 45, 10, 55), S.Rule("relative_strength", 5, -50.0, 7, 45)]
    d = bars(spark)
    w = Window.partitionBy("symbol", "part").orderBy("rn")
    rsi, avg = F.col("rsi_7"), F.col("avg_10_0")
    base = fold_by_symbol(d, S.KEY, "date", S.smoothed_of(rs))
    strength = ((F.col("close") / F.lag("close", 5).over(w)) - (F.col("bench") / F.lag("bench", 5).over(w))) * 100
    one = F.when(F.col("regime") == "bear", rsi < 45).otherwise((rsi < 55) & (F.col("close") > avg))
    two = (strength >= -50) & (rsi > 45) & (F.lag(rsi).over(w) <= 45) & (F.col("regime") == "bull")
    want = base.select("symbol", "rn", F.coalesce(one, F.lit(False)).alias("a"), F.coalesce(two, F.lit(False)).alias("b"), strength.alias("s")).collect()
    got = {(r.symbol, r.rn, r.rule): r for r in S.signals(d, rs).collect()}
    assert sum(r.a for r in want) > 5 and sum(r.b for r in want) > 2
    for r in want:
        x, y = got[r.symbol, r.rn, rs[0].id], got[r.symbol, r.rn, rs[1].id]
        assert (x.setup, y.setup, y.indicator) == (r.a, r.b, r.s)


def test_look_ahead_equals_window_frames(spark):
    d = bars(spark).withColumn("_s0", F.col("rn") % 3 == 0).withColumn("_x0", F.col("rn") % 4 == 0)
    rs = S.rules("quick")[:1]
    fold = S.look_ahead(rs, 5)
    got = {(r.symbol, r.rn): r for r in fold_by_symbol(d.repartition(4), S.KEY, "date", [fold]).collect()}
    w = Window.partitionBy("symbol", "part").orderBy("rn")
    bits = F.col("_x0").cast("long")
    want = d.select("symbol", "rn", F.lag("_s0").over(w).alias("due"), F.collect_list("close").over(w.rowsBetween(1, 5)).alias("ahead"), F.collect_list(bits).over(w.rowsBetween(0, 4)).alias("leaves"))
    seen = 0
    for r in want.collect():
        x = got[r.symbol, r.rn]
        assert x._em == int(bool(r.due)) and x.last_rn == (2 if r.symbol == "B" else 150)
        if r.due:
            seen += 1
            assert (x.ahead, x.leaves) == (r.ahead, r.leaves)
    assert seen == 98
