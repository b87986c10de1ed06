"""Trades are made once, rolling aggregates come from the Arrow pass."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldloom.functions.sequential import with_smoothed
from yieldloom.operators import strategy as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trades_are_read_once(spark):
    kind = "symbol string, part string, combo int, trade_no int, entry_rn int, exit_rn int, entry_date date, regime string, entry_price double, exit_price double, closes array<double>"
    day = dt.date(2000, 1, 3)
    rows = [("A", "train", 1, 1, 2, 4, day, "bull", 100.0, 110.0, [90.0, 110.0]), ("A", "train", 1, 2, 6, 7, day, "bear", 100.0, 99.0, [99.0]),
            ("A", "valid", 1, 1, 2, 3, day, "bull", 100.0, 105.0, [105.0]), ("B", "valid", 1, 1, 2, 3, day, "bull", 100.0, 105.0, [105.0]), (None, "train", 1, 1, 2, 3, day, "bull", 100.0, 105.0, [105.0])]
    m = S.metrics(spark.createDataFrame(rows, kind), 0, 0, 0)
    assert plan(m).count("LogicalRDD") == 1
    got = {(r.symbol, r.part): r for r in m.collect()}
    assert set(got) == {("A", "train"), ("A", "valid"), ("B", "valid")}
    a = got["A", "train"]
    assert (a.trades, a.bear_entries, a.bull_entries, a.win_rate) == (2, 1, 1, 50.0)
    assert abs(a.total_return - 8.9) < 1e-9 and abs(a.avg_trade - 4.5) < 1e-9 and abs(a.max_drawdown + 10) < 1e-9
    h = S.holdout_results(m)
    assert plan(h).count("LogicalRDD") == 1
    (r,) = h.collect()
    assert (r.symbol, r.trades, r.val_trades) == ("A", 2, 1) and abs(r.val_total_return - 5) < 1e-9
    (r,) = S.holdout_results(m.where("part = 'train'")).collect()
    assert r.val_trades == 0 and r.val_total_return is None


def test_rolling_columns_have_the_bits_of_window_frames(spark):
    rng = random.Random(1)
    rows = [(f"S{i}", k + 1, dt.date(2000, 1, 1) + dt.timedelta(k), round(rng.gauss(100, 5), 2) if rng.random() > 0.02 else None) for i in range(6) for k in range((5, 40, 90)[i % 3])]
    rows.append(("S1", 0, None, None))  # first by row number, last by date
    kinds = {"avg": F.avg, "sd": F.stddev_samp, "max": F.max, "min": F.min}
    rolls = frozenset((k, n, s) for k in kinds for n, s in ((5, 0), (20, 1), (7, 2)))
    d = with_smoothed(spark.createDataFrame(rows, "symbol string, rn int, date date, close double"), "close", rolls=rolls)
    checks = []
    for k, n, s in sorted(rolls):
        f = Window.partitionBy("symbol").orderBy("rn").rowsBetween(-(n - 1) - s, -s)
        old = F.when(F.count("close").over(f) >= n, kinds[k]("close").over(f))
        checks += [(~F.col(f"{k}_{n}_{s}").eqNullSafe(old)).cast("int").alias(f"{k}_{n}_{s}")]
    found = d.select("*", *[F.col(f"{k}_{n}_{s}").isNotNull().cast("int").alias(f"has_{k}_{n}_{s}") for k, n, s in sorted(rolls)]).agg(*[F.sum(f"has_{k}_{n}_{s}") for k, n, s in sorted(rolls)]).first()
    assert all(x > 0 for x in found)
    assert not any(any(r) for r in d.select(*checks).collect())
