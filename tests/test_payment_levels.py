"""Payments travel once for all levels of their sums."""

import datetime as dt
import re

from yieldloom.operators import portfolio as P

D = dt.date


def _tables(spark):
    rows = [(1, "A", D(2000, 1, 5), 10.0), (1, "A", D(2000, 1, 5), 5.0), (1, "B", D(2000, 2, 1), 7.0), (1, None, None, 1.0), (2, "X", D(2001, 1, 5), 3.0), (None, "A", D(2001, 1, 5), 2.0)]
    pay = spark.createDataFrame(rows, "holder long, stock string, date date, total double")
    return pay, spark.createDataFrame([("A", "S1", "I1"), ("B", "S1", "I2"), ("B", "S1", "I2")], "symbol string, sector string, industry string")


def _got(d):
    rows = [(r.holder, r.level, r.key, r.total, r.payments) for r in d.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_levels_and_hot_holders(spark):
    pay, sectors = _tables(spark)
    got = _got(P.payment_totals(pay, sectors))
    one = {x[1:] for x in got if x[0] == 1}
    assert one == {
        ("stock", "A", 15.0, 2), ("stock", "B", 14.0, 2), ("stock", None, 1.0, 1), ("year", "2000", 29.0, 4), ("year", None, 1.0, 1), ("year_month", "2000-01", 15.0, 2),
        ("year_month", "2000-02", 14.0, 2), ("year_month", None, 1.0, 1), ("date", "2000-01-05", 15.0, 2), ("date", "2000-02-01", 14.0, 2), ("date", None, 1.0, 1),
        ("sector", "S1", 29.0, 4), ("sector", "Unclassified", 1.0, 1), ("industry", "I1", 15.0, 2), ("industry", "I2", 14.0, 2), ("industry", "Unclassified", 1.0, 1)}
    assert {(x[0], x[4]) for x in got if x[1] == "stock" and x[0] != 1} == {(2, 1), (None, 1)}
    for hot in (0, 1):  # all but the payments without a holder, then holder 1 alone
        assert _got(P.payment_totals(pay, sectors, hot)) == got


def test_levels_share_a_shuffle(spark):
    pay, sectors = _tables(spark)
    d = P.payment_totals(pay, sectors)
    d.collect()
    final = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_holder = re.findall(r"Exchange hashpartitioning\(holder#\d+L[^)]*\), REPARTITION_BY_NUM", final)
    assert len(by_holder) == 1 and "Expand" not in final and not re.findall(r"hashpartitioning\(holder#\d+L, l#", final)
