"""Valuation against a stock's own history, dividend discounting and currency effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change, clip, row_mean, sdiv
from .returns import rolling

def whole():
    """Window over all rows of one symbol."""
    return Window.partitionBy("symbol")


def assess(hist: DataFrame, ratio: str, asof: str, years: int = 5, min_rows: int = 30) -> DataFrame:
    """Today's positive multiple against its own range, with fair prices and a three-way label."""
    start = F.date_sub(F.lit(asof).cast("date"), 365 * years)
    h = hist.where(F.col("date") >= start)
    price = h.where("close > 0").groupBy("symbol").agg(F.max_by("close", "date").alias("current_price"))
    v = h.where(F.col(ratio) > 0).select("symbol", "date", F.col(ratio).alias("v")).withColumn("now", F.max_by("v", "date").over(whole()))
    q = {"p5": 0.05, "p10": 0.10, "p45": 0.45, "p55": 0.55, "p90": 0.90, "p95": 0.95}
    g = v.groupBy("symbol", "now").agg(
        F.count("*").alias("observations"), F.median("v").alias("median"),
        *[F.percentile("v", F.lit(p)).alias(n) for n, p in q.items()],
        (F.avg((F.col("v") < F.col("now")).cast("double")) * 100).alias("percentile"),
    ).where(F.col("observations") >= min_rows).join(price, "symbol")
    for n, c in (("fair_price", "median"), ("fair_price_p10", "p10"), ("fair_price_p90", "p90")):
        g = g.withColumn(n, sdiv(c, "now") * F.col("current_price"))
    label = (
        F.when(F.col("now").between(F.col("p45"), F.col("p55")), "Fairly valued relative to its history")
        .when(F.col("now") < F.col("p45"), "Below its historical valuation range").otherwise("Above its historical valuation range")
    )
    return g.withColumn("upside", change("fair_price", "current_price") * 100).withColumn("assessment", label)


def fair_value_bands(hist: DataFrame, ratio: str, metric: str) -> DataFrame:
    """Median, p10 and p90 multiple times the per-share figure of every session."""
    ok = F.count(ratio).over(whole()) >= 4
    qs = [F.percentile(ratio, F.lit(p)).over(whole()).alias(n) for n, p in (("_med", 0.5), ("_p10", 0.1), ("_p90", 0.9))]
    h = hist.select("symbol", "date", "close", metric, ok.alias("_ok"), *qs).where(F.col("_ok") & F.col(metric).isNotNull())
    return h.select("symbol", "date", "close", *[(F.col(q) * F.col(metric)).alias(n) for q, n in (("_med", "fair_value_median"), ("_p10", "fair_value_p10"), ("_p90", "fair_value_p90"))])


def cost_of_equity(rf: float, erp: float):
    return F.lit(rf) + F.coalesce("beta", F.lit(1.0)) * erp


def discounted_dividends(stocks: DataFrame, rf: float = 6.5, erp: float = 5.0) -> DataFrame:
    """Gordon growth value per stock; NULL unless the required return exceeds growth.

    ``stocks``: symbol, price, lastDiv, beta, cagr_5y.
    """
    g = F.when(F.col("cagr_5y") > 0, F.least(F.col("cagr_5y"), F.lit(5.0))).otherwise(2.5)
    s = stocks.withColumn("ke", cost_of_equity(rf, erp)).withColumn("g", g)
    s = s.withColumn("next_div", F.col("lastDiv") * (1 + F.col("g") / 100))
    s = s.withColumn("value", F.when(F.col("ke") > F.col("g"), sdiv("next_div", (F.col("ke") - F.col("g")) / 100)))
    label = F.when(F.col("value") > F.col("price") * 1.05, "Undervalued").when(F.col("value") < F.col("price") * 0.95, "Overvalued").otherwise("Fair Valued")
    return (
        s.withColumn("margin_of_safety", change("value", "price") * 100)
        .withColumn("low", F.col("value") * 0.9).withColumn("high", F.col("value") * 1.1)
        .withColumn("assessment", F.when(F.col("value").isNotNull(), label))
    )


def sensitivity_grid(valued: DataFrame) -> DataFrame:
    """Value for growth and required return shifted by -2..2 points; 25 cells per stock at most."""
    steps = F.sequence(F.lit(-2), F.lit(2))
    d = valued.select("symbol", "lastDiv", "ke", "g", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    r = F.greatest(F.lit(1.0), F.col("ke") + F.col("i"))
    g = F.greatest(F.lit(0.0), F.col("g") + F.col("j"))
    d = d.select("symbol", "i", "j", "lastDiv", r.alias("r_val"), g.alias("g_val")).where("r_val > g_val")
    return d.select("symbol", "i", "j", "r_val", "g_val", (F.col("lastDiv") * (1 + F.col("g_val") / 100) / ((F.col("r_val") - F.col("g_val")) / 100)).alias("value"))


def annual_income(fin: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("calendarYear")
    y = fin.groupBy("symbol", "calendarYear").agg(F.sum("revenue").alias("revenue"), F.sum("netIncome").alias("netIncome"))
    return y.select(
        "symbol", "calendarYear", "revenue", "netIncome", (sdiv("netIncome", "revenue") * 100).alias("margin"),
        *[(change(m, F.lag(m).over(w)) * 100).alias(f"{m}_growth") for m in ("revenue", "netIncome")],
    )


def quarterly_income(fin: DataFrame) -> DataFrame:
    """Quarter labels, change on the previous quarter, the year-ago figure and clipped trailing margin."""
    w = Window.partitionBy("symbol").orderBy("date")
    ttm = sdiv(rolling(F.sum, "netIncome", 4, w), rolling(F.sum, "revenue", 4, w)) * 100
    return fin.select(
        "symbol", "date", F.concat_ws(" ", F.col("calendarYear").cast("string"), "period").alias("period_label"),
        *[(change(m, F.lag(m).over(w)) * 100).alias(f"{m}_qoq") for m in ("revenue", "netIncome")],
        *[F.lag(m, 4).over(w).alias(f"{m}_year_ago") for m in ("revenue", "netIncome")], clip(ttm, -50, 100).alias("ttm_margin"),
    )


FX_DAYS = {"return_7d": 7, "return_1m": 30, "return_1y": 365, "return_10y": 3650, "total_return_1y": 365, "total_return_10y": 3650}


def fx_factors(fx: DataFrame, day: str, days: list[int]) -> DataFrame:
    """Start rate over end rate per look-back, both ends taken as of the date."""
    upto = fx.where((F.col("pair") == "USDIDR") & (F.col("date") <= F.lit(day).cast("date")))
    end = upto.agg(F.max("date").alias("_end"), F.max_by("close", "date").alias("_end_close"))
    j = upto.crossJoin(F.broadcast(end))  # one row
    aggs = [F.max_by("close", F.when(F.col("date") <= F.date_sub("_end", n), F.col("date"))).alias(f"_s{n}") for n in days]
    return j.agg(F.max("_end_close").alias("_e"), *aggs).select(*[sdiv(f"_s{n}", "_e").alias(f"fx_{n}") for n in days])


def usd_returns(scores: DataFrame, factors: DataFrame) -> DataFrame:
    """Returns (percent) of the six horizons seen by a dollar investor."""
    j = scores.crossJoin(F.broadcast(factors))  # one row
    return j.select("symbol", *[(((1 + F.col(c)) * F.col(f"fx_{n}") - 1) * 100).alias(f"{c}_usd") for c, n in FX_DAYS.items()])


def growth_index(trailing: DataFrame) -> DataFrame:
    """Trailing totals rebased to 100 at their first non-zero value, one row per series and date."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = trailing.where("revenue_ttm is not null and netIncome_ttm is not null")
    for m in ("revenue", "netIncome"):
        c = F.col(f"{m}_ttm")
        t = t.withColumn(m, sdiv(c, F.first(F.when(c != 0, c), ignorenulls=True).over(w)) * 100)
    return t.select("symbol", "date", "revenue", "netIncome").unpivot(["symbol", "date"], ["revenue", "netIncome"], "series", "index")


def pe_discount(valuation: DataFrame) -> DataFrame:
    """Average of the 1/3/5-year mean PE and today's discount to it."""
    avg = row_mean("last_1y_mean", "last_3y_mean", "last_5y_mean")
    return valuation.withColumn("avg_pe", avg).withColumn("Discount", (1 - sdiv("current_pe", "avg_pe")) * 100)
