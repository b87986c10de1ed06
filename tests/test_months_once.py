"""The detrended months read their prices once."""

import datetime as dt
import math
import re
import statistics

import numpy as np

from yieldloom.operators import events as E


def _prices(spark):
    rng, rows = np.random.default_rng(2), []
    for s, years in (("A", (1999, 2000)), ("B", (2000,)), (None, (2000,))):
        rows += [(s, dt.date(y, 1, 3) + dt.timedelta(days=9 * i), float(c)) for y in years for i, c in enumerate(np.round(50 + np.cumsum(rng.normal(0, 1, 40)), 2))]
    rows += [("B", dt.date(2001, m, 1), 5.0) for m in range(1, 12)]  # no December
    rows += [("A", None, 9.0), ("A", dt.date(2000, 5, 20), 0.0), ("A", dt.date(2000, 5, 21), None)]
    return rows, spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)


def test_detrended_months_by_hand(spark):
    rows, px = _prices(spark)
    d = E.detrended_months(px)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall("Exchange hashpartitioning", plan)) == 2
    want: dict = {}
    for s, y in (("A", 1999), ("A", 2000), ("B", 2000)):
        own = sorted((x, c) for n, x, c in rows if n == s and x and x.year == y and c)
        t = np.array([(x - own[0][0]).days for x, _ in own], float)
        v = np.log([c for _, c in own])
        b, a = np.polyfit(t, v, 1)
        by: dict = {}
        for (x, _), rel in zip(own, np.exp(v - (b * t + a)) * 100, strict=True):
            by.setdefault(x.month, []).append(rel)
        for m, vals in by.items():
            want.setdefault((s, m), []).append(statistics.median(vals))
    got = {(r.symbol, r.month): r.rel_price for r in d.collect()}
    assert got.keys() == want.keys() and len(got) == 24
    assert all(math.isclose(got[k], statistics.median(v), rel_tol=1e-9) for k, v in want.items())
