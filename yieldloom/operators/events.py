"""Seasonality, ex-date event studies, censored recovery times and density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import distribution
from ..functions.scalars import sdiv
from ..session import cut_lineage
from .asof import asof_join, event_window_join, month_key

SUMMARY = {"q25": 0.25, "median": 0.5, "q75": 0.75}
LOOKBACK, LOOKFORWARD = 180, 365


def _summary(value: str) -> list:
    """Distribution of a value inside one symbol (a bounded group)."""
    at = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one buffer of values for all three
    return [F.avg(value).alias("mean"), at[1].alias("median"), F.stddev_samp(value).alias("std"), at[0].alias("q25"), at[2].alias("q75")]


def stock_seasonality(prices: DataFrame) -> DataFrame:
    """Monthly median close relative to the year's mean, per stock; two years needed."""
    p = prices.select("symbol", F.year("date").alias("year"), F.month("date").alias("month"), "close")
    mean = p.groupBy("symbol", "year").agg(F.avg("close").alias("_m"))
    mon = p.groupBy("symbol", "year", "month").agg(F.median("close").alias("_p")).join(mean, ["symbol", "year"])
    mon = mon.select("symbol", "year", "month", (sdiv("_p", "_m") * 100).alias("rel_price"))
    years = mon.groupBy("symbol").agg(F.count_distinct("year").alias("_n")).where("_n >= 2").select("symbol")
    return mon.join(years, "symbol").groupBy("symbol", "month").agg(*_summary("rel_price"))


def ex_events(div: DataFrame) -> DataFrame:
    return div.where("date is not null").groupBy("symbol", F.col("date").alias("ex_date")).agg(F.max("adjDividend").alias("dividend_amount"))


def with_event_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the ex-date close (at or before) and the cum-date close (strictly before)."""
    px = prices.select("symbol", F.col("date").alias("ex_date"), "close", F.col("date").alias("_d"))
    e = asof_join(events, px, ["symbol"], {"close": "ex_price"}, on="ex_date")
    return asof_join(e, px, ["symbol"], {"close": "cum_price", "_d": "cum_date"}, on="ex_date", strict=True)


def held_days(prices: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Every event with the close of each calendar day in its window, as far as the symbol's prices reach: close and days_to_ex.

    A close holds until the day before the next one. The intervals meet the events by month, are clipped to the window, and
    only then become days.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    held = prices.select("symbol", "close", F.col("date").alias("_from"), F.coalesce(F.date_sub(F.lead("date").over(w), 1), "date").alias("_to"))
    held = held.withColumn("_m", F.explode(F.sequence(month_key("_from"), month_key("_to"))))
    lo, hi = F.date_sub("ex_date", before), F.date_add("ex_date", after)
    ev = events.withColumn("_m", F.explode(F.sequence(month_key(lo), month_key(hi))))
    first, last = F.greatest("_from", lo), F.least("_to", hi)
    j = held.join(ev, ["symbol", "_m"]).where((first <= last) & (F.col("_m") == month_key(first)))  # once, though both span months
    return j.withColumn("days_to_ex", F.explode(F.sequence(F.datediff(first, "ex_date"), F.datediff(last, "ex_date")))).drop("_from", "_to", "_m")


def ex_trajectory(prices: DataFrame, events: DataFrame, before: int = LOOKBACK, after: int = 30) -> DataFrame:
    """Price path around ex-dates (ex-date = 100) per symbol and day offset."""
    e = with_event_prices(events.select("symbol", "ex_date"), prices).where("ex_price <> 0")
    days = held_days(prices, e.select("symbol", "ex_date", "ex_price"), before, after)
    return days.withColumn("rel", sdiv("close", "ex_price") * 100).groupBy("symbol", "days_to_ex").agg(*_summary("rel"))


def ex_drop_stats(prices: DataFrame, events: DataFrame) -> DataFrame:
    e = with_event_prices(events.select("symbol", "ex_date"), prices).where("ex_price <> 0 and cum_price > 0")
    d = e.withColumn("drop", (sdiv("ex_price", "cum_price") - 1) * 100)
    return d.groupBy("symbol").agg(F.median("drop").alias("median"), F.avg("drop").alias("mean"), F.count("*").alias("count"))


def best_entry(prices: DataFrame, events: DataFrame, before: int = LOOKBACK) -> DataFrame:
    """Lowest close in the days before each ex-date, the earliest on a tie."""
    j = event_window_join(events, prices.select("symbol", "date", "close"), before, -1)
    low = j.groupBy(*events.columns).agg(F.min(F.struct("close", "date")).alias("_l"))
    out = low.select(*events.columns, F.col("_l.date").alias("low_date"), F.col("_l.close").alias("low_price"), F.datediff("ex_date", "_l.date").alias("days_before"))
    px = prices.select("symbol", F.col("date").alias("ex_date"), "close")
    return asof_join(out, px, ["symbol"], {"close": "ex_price"}, on="ex_date")


def recovery(prices: DataFrame, events: DataFrame, levels: dict[str, str], forward: int = LOOKFORWARD) -> DataFrame:
    """Days until the close reaches each level again, right-censored when it does not.

    ``levels`` maps an output prefix to the column with the level. All levels
    share one forward join. Events without a later session drop out.
    """
    j = event_window_join(events, prices.select("symbol", "date", "close"), 0, forward)
    hits = [F.min(F.when(F.col("close") >= F.col(c), F.struct("date", "close"))).alias(f"_{p}") for p, c in levels.items()]
    g = j.groupBy(*events.columns).agg(*hits)
    end = prices.groupBy("symbol").agg(F.max("date").alias("_end"))
    g = g.join(end, "symbol")
    seen = F.greatest(F.lit(0), F.datediff(F.least("_end", F.date_add("ex_date", forward)), "ex_date"))
    out = []
    for p, c in levels.items():
        hit, known = F.col(f"_{p}"), F.col(c).isNotNull()
        out += [
            F.col(f"_{p}.date").alias(f"{p}_recover_date"), F.col(f"_{p}.close").alias(f"{p}_recover_price"),
            F.when(known, F.coalesce(F.datediff(F.col(f"_{p}.date"), "ex_date"), seen)).alias(f"{p}_days_after"),
            F.when(known, hit.isNotNull()).alias(f"{p}_recovered"),
        ]
    return g.select(*events.columns, *out)


def cum_recovery(prices: DataFrame, events: DataFrame) -> DataFrame:
    e = with_event_prices(events, prices).where("cum_price > 0").drop("ex_price")
    return recovery(prices, e, {"cum": "cum_price"})


def detrended_months(prices: DataFrame, value: str = "close") -> DataFrame:
    """Median detrended price per symbol and month over complete years only.

    The log-linear trend of each (symbol, year) comes from the built-in
    regression aggregates, over windows of one sort; residuals go back to
    100-based prices.
    """
    w = Window.partitionBy("symbol", "year")
    p = prices.where((F.col(value) > 0) & F.col("symbol").isNotNull() & F.col("date").isNotNull())
    p = p.select("symbol", "date", F.year("date").alias("year"), F.month("date").alias("month"), F.log(value).alias("y"))
    seen = F.bit_or(F.expr("shiftleft(1, month)")).over(w)  # a bit for each month
    p = p.select("*", F.min("date").over(w).alias("_d0"), seen.alias("_k")).where(f"_k = {(1 << 13) - 2}").withColumn("x", F.datediff("date", "_d0").cast("double"))
    r = p.select("*", F.regr_slope("y", "x").over(w).alias("_b"), F.regr_intercept("y", "x").over(w).alias("_a")).where("_b is not null")
    r = r.withColumn("rel", F.exp(F.col("y") - (F.col("_b") * F.col("x") + F.col("_a"))) * 100)
    mon = r.groupBy("symbol", "year", "month").agg(F.median("rel").alias("rel"))
    return mon.groupBy("symbol", "month").agg(F.median("rel").alias("rel_price"))


def aggregate_seasonality(prices: DataFrame) -> DataFrame:
    """Every stock weighs the same; the spread across stocks is exact at any number of stocks."""
    return distribution(detrended_months(prices), "rel_price", ["month"], SUMMARY).drop("n")


def survival_quantiles(df: DataFrame, days: str, recovered: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Kaplan-Meier: first duration at which the share recovered reaches each probability.

    Rows are counted per duration first (at most a year of days per group).
    """
    d = df.where(F.col(days).isNotNull()).groupBy(*by, F.col(days).alias("_t")).agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce(F.col(recovered), F.lit(False))).alias("_d")
    )
    w = Window.partitionBy(*by).orderBy("_t")
    risk = F.sum("_n").over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_r", risk).withColumn("_f", 1 - F.col("_d") / F.col("_r"))
    s = F.product("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_s", s)
    reach = lambda p: F.min(F.when((F.col("_d") > 0) & (1 - F.col("_s") >= p - 1e-12), F.col("_t")))
    return d.groupBy(*by).agg(*[reach(p).alias(n) for n, p in probs.items()], F.sum("_d").alias("recovered"), (F.sum("_n") - F.sum("_d")).alias("censored"))


KM = {"p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def event_rows(prices: DataFrame, events: DataFrame) -> DataFrame:
    """One row per eligible event: entry low, both recoveries and prices.

    Eligible: the full look-back lies inside the price history and the ex-date
    is not after its end.
    """
    span = prices.groupBy("symbol").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    ok = events.join(span, "symbol").where((F.date_sub("ex_date", LOOKBACK) >= F.col("_lo")) & (F.col("ex_date") <= F.col("_hi"))).drop("_lo", "_hi")
    best = best_entry(prices, ok)
    full = with_event_prices(best.drop("ex_price"), prices)
    rec = recovery(prices, full.select("symbol", "ex_date", "low_price", "cum_price"), {"low": "low_price", "cum": "cum_price"}).drop("low_price", "cum_price")
    out = full.join(rec, ["symbol", "ex_date"], "left")
    return out.withColumn("entry_date", F.when(F.col("low_recovered").isNotNull(), F.col("low_date"))).withColumn("entry_price", F.when(F.col("low_recovered").isNotNull(), F.col("low_price")))


def event_table(prices: DataFrame, events: DataFrame, sectors: DataFrame) -> DataFrame:
    """Monthly and event records of all symbols in one table.

    The closes are stored once, since every step reads them.
    """
    prices = cut_lineage(prices.select("symbol", "date", "close", "adjClose"))
    month = detrended_months(prices, "adjClose").select(F.lit("monthly").alias("record_type"), "symbol", "month", "rel_price")
    ev = event_rows(prices, events).select(F.lit("event").alias("record_type"), "*")
    return month.unionByName(ev, allowMissingColumns=True).join(sectors.select("symbol", "sector"), "symbol", "left")


def sector_timing(table: DataFrame) -> DataFrame:
    """Best month, days-before spread and recovery times per sector."""
    t = cut_lineage(table)
    month = t.where("record_type = 'monthly'")
    ev = t.where("record_type = 'event'")
    med = distribution(month, "rel_price", ["sector", "month"], {"median": 0.5}, moments=False)
    best = med.groupBy("sector").agg(F.min(F.struct("median", "month")).alias("_b")).select("sector", F.col("_b.month").alias("best_month"), F.col("_b.median").alias("avg_rel_price"))
    stocks = t.groupBy("sector").agg(F.count_distinct("symbol").alias("n_stocks"))
    days = distribution(ev, "days_before", ["sector"], {"p25_days": 0.25, "median_days": 0.5, "p75_days": 0.75}, moments=False)
    days = days.select("sector", F.col("n").alias("n_events"), *[F.col(c).cast("int").alias(c) for c in ("median_days", "p25_days", "p75_days")])
    low = survival_quantiles(ev, "low_days_after", "low_recovered", ["sector"], KM).withColumnsRenamed(
        {"median": "median_recovery", "p25": "p25_recovery", "p75": "p75_recovery", "p90": "p90_recovery", "recovered": "n_recovery", "censored": "n_censored"})
    cum = survival_quantiles(ev, "cum_days_after", "cum_recovered", ["sector"], {"cum_median_recovery": 0.5}).withColumnsRenamed({"recovered": "cum_n_recovery", "censored": "cum_n_censored"})
    return stocks.join(best, "sector").join(days, "sector", "left").join(low, "sector", "left").join(cum, "sector", "left")


def density(df: DataFrame, value: str, by: list[str], lo: float, hi: float, points: int = 256) -> DataFrame:
    """Gaussian kernel density on a fixed grid, from counts of distinct values."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    tot = cells.groupBy(*by).agg(F.sum("_c").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    d = cells.join(tot, by)
    var = d.groupBy(*by, "_n").agg(F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("_mean"), F.lit(2.0))).alias("_ss"))
    sd = F.when(F.col("_n") > 1, F.sqrt(F.try_divide(F.col("_ss"), F.col("_n").cast("double") - 1))).otherwise(0.0)
    var = var.select(*by, F.greatest(1.06 * sd * F.pow(F.col("_n").cast("double"), F.lit(-0.2)), F.lit(1.0)).alias("_bw"))
    g = d.join(var, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("x", F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1)))
    z = (F.col("x") - F.col("_v")) / F.col("_bw")
    k = F.sum(F.col("_c") * F.exp(-0.5 * z * z))
    return g.groupBy(*by, "i", "x", "_n", "_bw").agg(k.alias("_k")).select(*by, "i", "x", (F.col("_k") / (F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi))).alias("density"))


def status(c: str):
    return F.when(F.col(c), "Recovered").when(~F.col(c), "Dividend Trap").otherwise("No Recovery Record")


def event_detail(best: DataFrame, low: DataFrame, cum: DataFrame, dividends: DataFrame) -> DataFrame:
    """Full outer merge of the entry, low and cum tables with recovery labels."""
    k = ["symbol", "ex_date"]
    m = best.join(low, k, "outer").join(cum, k, "outer").join(dividends, k, "left")
    return m.withColumn("cum_ex_diff", F.col("ex_price") - F.col("cum_price")).withColumn("low_recovery_status", status("low_recovered")).withColumn("cum_recovery_status", status("cum_recovered"))


def entry_comparison(ev: DataFrame) -> DataFrame:
    """Recovered and trapped events of both entries and the gain of the low entry."""
    rec = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    g = ev.groupBy("sector").agg(
        rec("low_recovered").alias("low_recovered"), F.count("low_days_after").alias("low_total"), rec("cum_recovered").alias("cum_recovered"), F.count("cum_days_after").alias("cum_total"),
    )
    return g.withColumn("low_traps", F.col("low_total") - F.col("low_recovered")).withColumn("cum_traps", F.col("cum_total") - F.col("cum_recovered")).withColumn("additional", F.col("low_recovered") - F.col("cum_recovered"))


def entry_yields(ev: DataFrame, price: str, days: str, recovered: str) -> DataFrame:
    y = ev.select("symbol", "sector", "ex_date", (sdiv("dividend_amount", price) * 100).alias("entry_yield"), F.col(days).alias("days_after"), F.coalesce(F.col(recovered), F.lit(False)).alias("recovered"))
    y = y.where("entry_yield > 0 and days_after is not null")
    return y.withColumn("status", F.when(F.col("recovered"), "Recovered").otherwise("Dividend Trap"))


def yield_fit(yields: DataFrame) -> DataFrame:
    """Linear fit of recovery days on entry yield over recovered events, per sector."""
    r = F.col("recovered")
    x, y = F.when(r, F.col("entry_yield")), F.when(r, F.col("days_after").cast("double"))
    g = yields.groupBy("sector").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.count_if(r).alias("recovered"), F.count_if(~r).alias("traps"),
    ).where("recovered >= 2 and x_max > x_min")
    return g.withColumn("fit_min", F.col("slope") * F.col("x_min") + F.col("intercept")).withColumn("fit_max", F.col("slope") * F.col("x_max") + F.col("intercept"))


def display_sample(yields: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable uniform sample for a scatter plot: the n smallest hashes."""
    return yields.orderBy(F.xxhash64("symbol", "ex_date", F.lit(seed)), "symbol", "ex_date").limit(n)
