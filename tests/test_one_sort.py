"""Windows of one key and order share a sort."""

import datetime as dt
import re

from yieldloom.operators import returns as R

D = dt.date


def _prices(spark):
    days = [(D(2000, 1, 1), 10.0), (D(2000, 1, 5), 11.0), (D(2000, 1, 8), 12.0), (D(2000, 2, 1), None), (D(2001, 2, 1), 20.0)]
    return spark.createDataFrame([("A", *x) for x in days] + [("B", D(2000, 1, 8), 0.0), ("B", D(2000, 1, 15), 5.0), ("B", None, 7.0), (None, D(2000, 1, 3), 1.0)], "symbol string, date date, close double")


def test_price_changes_sort_once(spark):
    d = R.price_changes(_prices(spark))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1 and len(re.findall(r"\bWindow \[", plan)) == 1
    got = {(r.symbol, r.date): (r.previous_price, r.previous_price_7d, r.previous_price_30d, r.previous_price_365d) for r in d.collect()}
    assert got[("A", D(2000, 1, 8))] == (11.0, 10.0, None, None)
    assert got[("A", D(2000, 2, 1))] == (12.0, 12.0, 10.0, None)
    assert got[("A", D(2001, 2, 1))] == (None, None, None, None)  # the row a year ago has no close
    assert got[("B", D(2000, 1, 15))] == (0.0, 0.0, 7.0, 7.0)  # a row without a date comes before all others
    assert got[(None, D(2000, 1, 3))] == (None, None, None, None) and got[("B", D(2000, 1, 8))] == (7.0, 7.0, 7.0, 7.0)


def test_calendar_returns_sort_once(spark):
    d = R.calendar_returns(_prices(spark))
    assert len(re.findall(r"\bSort \[", d._jdf.queryExecution().executedPlan().toString())) == 1
    got = {(r.symbol, r.date): (r.return_7d, r.return_1m, r.return_1y) for r in d.where("symbol = 'A'").collect()}
    assert abs(got[("A", D(2000, 1, 8))][0] - 0.2) < 1e-12 and got[("A", D(2000, 1, 5))] == (None, None, None)
