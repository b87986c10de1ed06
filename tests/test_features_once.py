"""The feature columns come from one pass and equal Spark's own window frames."""

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from yieldloom.functions.scalars import sdiv
from yieldloom.operators import indicators as I
from yieldloom.operators import mlprep as L
from yieldloom.operators.returns import rolling


def test_features_equal_window_frames(spark):
    rng, rows = np.random.default_rng(3), []
    for s, n in (("A", 60), ("B", 3), ("C", 40), (None, 30)):
        x = np.round(50 + np.cumsum(rng.normal(0, 1, n)), 2)
        if s == "C":
            x[10:32] = 50.0  # no range
        for i, c in enumerate(x.tolist()):
            day = None if s == "A" and i == 20 else dt.date(2000, 1, 1) + dt.timedelta(days=2 * i)
            rows.append((s, day, c, c + 1, c - 1, None if i == 33 else float("nan") if i == 36 else c, 1.0))
    d = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double").repartition(3)
    got = I.feature_indicators(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    mid, sd = rolling(F.avg, "close", 5), rolling(F.stddev_samp, "close", 5)
    low, up = mid - 2 * sd, mid + 2 * sd
    lo, hi = rolling(F.min, "RSI_14", 14), rolling(F.max, "RSI_14", 14)
    w = got.select("*", low.alias("l"), mid.alias("m"), up.alias("u"), (sdiv(up - low, mid) * 100).alias("b"), sdiv(F.col("close") - low, up - low).alias("p"), (sdiv(F.col("RSI_14") - lo, hi - lo) * 100).alias("st"))
    w = w.withColumn("k", rolling(F.avg, "st", 3)).withColumn("d", rolling(F.avg, "k", 3))
    seen = w.collect()
    assert len(seen) == len(rows) and sum(r["STOCHRSId_14_14_3_3"] is not None for r in seen) > 20
    names = {"BBL_5_2.0": "l", "BBM_5_2.0": "m", "BBU_5_2.0": "u", "BBB_5_2.0": "b", "BBP_5_2.0": "p", "STOCHRSIk_14_14_3_3": "k", "STOCHRSId_14_14_3_3": "d"}
    for r in seen:
        for a, b in names.items():
            assert r[a] == r[b], (a, r)


def test_pe_joins_once_and_repeats(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    px = spark.createDataFrame([("A", x, 1.0, 2.0, 0.5, 1.0 + i % 3, 5.0) for i, x in enumerate(days)], "symbol string, date date, open double, high double, low double, close double, volume double")
    pe = spark.createDataFrame([("A", days[3], 7.0), ("A", days[3], 8.0), ("A", days[4], None), ("A", days[4], None), ("A", days[5], float("nan")), ("B", days[6], 1.0)], "symbol string, date date, pe double")
    d = L.feature_table(px, pe)
    want = I.feature_indicators(px).join(pe, ["symbol", "date"], "left")
    assert d.columns == want.columns and d.schema["pe"].dataType == want.schema["pe"].dataType
    assert sorted(map(repr, d.collect())) == sorted(map(repr, want.collect())) and d.count() == 22
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # the join lies below the folds
