"""Momentum ranks of all look-backs share one sort; the series meets them without joins."""

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldloom.functions.ranking import avg_pct_rank
from yieldloom.functions.scalars import change
from yieldloom.functions.scan import scan_sorted
from yieldloom.operators import returns as R
from yieldloom.operators import strategy as S


def by_join(prices, n):
    """Every row with every row of its symbol n market sessions before, ranked by date."""
    cal = prices.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("_i"))
    px = prices.join(cal, "date").select("symbol", "date", "close", "_i")
    past = px.select("symbol", (F.col("_i") + n).alias("_i"), F.col("close").alias("_past"))
    r = px.join(past, ["symbol", "_i"]).select("symbol", "date", change("close", "_past").alias("ret"))
    ranked = avg_pct_rank(r.where("ret is not null"), "ret", "_p", by=["date"])
    return ranked.select("symbol", "date", "ret", (F.col("_p") * 100).alias("percentile"))


def prices(spark):
    rows = []
    for i, s in enumerate(("A", "B", "C", None)):
        for k in range(30):
            if (i + k) % 6:
                rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(days=k), 0.0 if k == 9 else None if k == 12 else 10.0 + (k * (i + 2)) % 7))
    rows += [("A", dt.date(2000, 1, 8), 12.5), ("B", None, 3.0), (None, None, 1.0)]  # a repeated key, a missing date
    return spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)


def test_ranks_equal_the_join(spark):
    px = prices(spark)
    got = R.momentum_percentiles(px, [2, 5]).collect()
    assert len({r.sessions for r in got}) == 2 and len(got) > 60
    for n in (2, 5):
        want = sorted(map(repr, by_join(px, n).collect()))
        assert sorted(repr(r) for r in R.momentum_percentile(px, n).collect()) == want
        assert sorted(repr((r.symbol, r.date, r.ret, r.percentile)) for r in got if r.sessions == n) == sorted(repr(tuple(r)) for r in by_join(px, n).collect())


def test_series_deals_its_rows_once(spark):
    px = prices(spark)
    days = px.select("date").distinct().where("date is not null")
    regime, bench = days.select("date", F.lit("bull").alias("regime")), days.select("date", F.lit(100.0).alias("close"))
    d = S.base_series(px, regime, bench, {2, 5})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == 1 and "SortMergeJoin" not in plan
    p = px.withColumn("regime", F.when(F.col("date").isNotNull(), "bull").otherwise("bear")).withColumn("bench", F.when(F.col("date").isNotNull(), 100.0))
    for n in (2, 5):
        p = p.join(by_join(px, n).select("symbol", "date", F.col("percentile").alias(f"_m{n}")), ["symbol", "date"], "left")
    w = Window.partitionBy("symbol").orderBy("date")
    shape = lambda x: sorted(map(repr, x.select("symbol", "date", "close", "regime", "bench", "rn").withColumn("rn", F.col("rn").cast("int")).drop("rn").collect()))
    assert shape(d) == shape(p.withColumn("rn", F.row_number().over(w)))
    once = d.where("not (symbol = 'A' and date >= date'2000-01-08') and symbol is not null")  # ranks behind a repeated key have no order
    want = {(r.symbol, r.date): (r.a, r.b) for r in p.select("symbol", "date", *[F.last(f"_m{n}", ignorenulls=True).over(w).alias(c) for n, c in ((2, "a"), (5, "b"))]).collect()}
    rows = once.collect()
    assert len(rows) > 50 and all((r.pct_2, r.pct_5) == want[r.symbol, r.date] for r in rows)


def test_places_hold_behind_a_union(spark):
    d = spark.range(4000).select((F.col("id") % 3).alias("g"), "id").repartition(6)
    ranked = scan_sorted(d, ["g"], ["id"])
    both = spark.range(100).repartition(5).select(F.lit(9).cast("long").alias("g"), "id", F.lit(0).cast("long").alias("_place"), F.lit(0).cast("long").alias("_n")).unionByName(ranked)
    assert all(r._place == r.id // 3 + 1 for r in both.where("g < 9").collect())
