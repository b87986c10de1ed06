"""Percentiles of one value share a buffer."""

import re

from yieldloom.operators import events as E


def test_percentiles_share_a_buffer(spark):
    d = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 4.0), ("B", None)], "symbol string, v double").groupBy("symbol").agg(*E._summary("v"))
    assert len(re.findall("partial_percentile", d._jdf.queryExecution().executedPlan().toString())) == 1
    got = {r.symbol: (r["mean"], r["median"], r.q25, r.q75) for r in d.collect()}
    assert got == {"A": (7 / 3, 2.0, 1.5, 3.0), "B": (None, None, None, None)}
