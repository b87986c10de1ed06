"""Dividend histories, their statistics and dividend-based scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import order_index
from ..functions.scalars import clip, sdiv
from .returns import ewm_adjusted

def by_year():
    return Window.partitionBy("symbol").orderBy("year")


def yearly_dividends(div: DataFrame, asof: str) -> DataFrame:
    """Dividends per calendar year from the first payment on, years without one filled with 0."""
    y = div.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("adjDividend").alias("adjDividend"))
    span = y.groupBy("symbol").agg(F.min("year").alias("lo"), F.greatest(F.max("year"), F.year(F.lit(asof)) - 1).alias("hi"))
    spine = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("year"))
    return spine.join(y, ["symbol", "year"], "left").withColumn("adjDividend", F.coalesce("adjDividend", F.lit(0.0)))


def dividend_stats(yearly: DataFrame, asof: str) -> DataFrame:
    """Fifteen growth, cut and consistency statistics per symbol.

    Only completed years count, unless a symbol has none. The ten-year cut
    leaves the newest year out and the first year counts as positive. A rise
    from a zero year has no percentage and is skipped.
    """
    this_year = F.year(F.lit(asof))
    past = F.max(F.when(F.col("year") < this_year, 1)).over(Window.partitionBy("symbol"))
    v = F.col("adjDividend")
    d = yearly.withColumn("_past", past).where((F.col("year") < this_year) | F.col("_past").isNull())
    d = d.withColumn("inc_flat", v - F.lag(v).over(by_year()))
    d = d.withColumn("inc_pct", sdiv("inc_flat", F.lag(v).over(by_year())) * 100)
    d = d.withColumn("rd", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year"))))
    weight, flat = ewm_adjusted("inc_flat", 0.5, by_year())
    _, pct = ewm_adjusted("inc_pct", 0.5, by_year())
    d = d.withColumn("_wt", weight).withColumn("ew_flat", flat).withColumn("ew_pct", pct)

    def last(c, n):
        return F.avg(F.when(F.col("rd") <= n, F.col(c)))

    def at(k):
        return F.max(F.when(F.col("rd") == k, v))

    def cagr(n):
        ok = (F.count("*") >= n + 1) & (at(n + 1) > 0)
        return F.when(ok, (F.pow(sdiv(at(1), at(n + 1)), F.lit(1.0 / n)) - 1) * 100)

    g = d.groupBy("symbol").agg(
        F.min("inc_pct").alias("maximum_cut_pct"),
        F.min(F.when(F.col("rd").between(2, 10), F.col("inc_pct"))).alias("max_10y_cut_pct"),
        F.avg("inc_flat").alias("historical_mean_flat"), last("inc_flat", 2).alias("div_inc_2y_mean_flat"),
        last("inc_flat", 5).alias("div_inc_5y_mean_flat"), F.avg("ew_flat").alias("exponential_weighted_mean_flat"),
        F.avg("inc_pct").alias("historical_mean_pct"), last("inc_pct", 2).alias("div_inc_2y_mean_pct"),
        last("inc_pct", 5).alias("div_inc_5y_mean_pct"), F.avg("ew_pct").alias("exponential_weighted_mean_pct"),
        (F.count_if(F.col("inc_flat") > 0) + 1).alias("num_positive_year"), F.count_if(v > 0).alias("num_dividend_year"),
        cagr(5).alias("cagr_5y"), cagr(10).alias("cagr_10y"),
    )
    return g.withColumn("pct_positive_year", sdiv("num_positive_year", "num_dividend_year") * 100)


def trailing_sums(div: DataFrame, asof: str) -> DataFrame:
    """Dividends of the last 365 and 3650 days."""
    def s(days):
        return F.coalesce(F.sum(F.when(F.col("date") >= F.date_sub(F.lit(asof).cast("date"), days), F.col("adjDividend"))), F.lit(0.0))

    return div.groupBy("symbol").agg(s(365).alias("div_sum_1y"), s(3650).alias("div_sum_10y"))


def last_annual_dividend(div: DataFrame, asof: str) -> DataFrame:
    """Ordinary dividends of the newest final payment's fiscal year; 0 when that is over two years old."""
    final = div.where("dividend_type = 'final'").groupBy("symbol").agg(F.max_by("fiscal_year", "date").alias("fy"))
    ordinary = div.where("dividend_type <> 'special'").groupBy("symbol", F.col("fiscal_year").alias("fy")).agg(F.sum("adjDividend").alias("v"))
    j = div.select("symbol").distinct().join(final, "symbol", "left").join(ordinary, ["symbol", "fy"], "left")
    fresh = F.col("fy") >= F.year(F.lit(asof)) - 2
    return j.select("symbol", F.coalesce(F.when(fresh, F.col("v")), F.lit(0.0)).alias("lastDiv"))


def calendar(div: DataFrame, profiles: DataFrame, year: int, min_cap: float = 0, exclude: tuple[str, ...] = (), split: dict[str, float] | None = None) -> DataFrame:
    """One year's dividend events with the current price of each paying company."""
    d = div.where(F.year("date") == year)
    if exclude:
        d = d.where(~F.col("symbol").isin(*exclude))
    for symbol, factor in (split or {}).items():
        d = d.withColumn("adjDividend", F.when(F.col("symbol") == symbol, F.col("adjDividend") / factor).otherwise(F.col("adjDividend")))
    caps = profiles.where(F.col("mktCap") >= min_cap).select("symbol", "price")
    return d.join(caps, "symbol").select("date", "symbol", "adjDividend", "price")


def shift_to_year(c, year) -> "F.Column":
    """The same day in another year; 29 February becomes the 28th."""
    c = F.col(c) if isinstance(c, str) else c
    first = F.make_date(F.lit(year) if isinstance(year, int) else year, F.month(c), F.lit(1))
    return F.date_add(first, F.least(F.dayofmonth(c), F.dayofmonth(F.last_day(first))) - 1)


def extrapolate(yearly_last: DataFrame, years: int) -> DataFrame:
    """last + i * increase for the coming years; one bounded row set per symbol."""
    i = F.explode(F.sequence(F.lit(1), F.lit(years))).alias("i")
    return yearly_last.select("symbol", "year", "last", "inc", i).select("symbol", (F.col("year") + F.col("i")).alias("year"), (F.col("last") + F.col("i") * F.col("inc")).alias("adjDividend"))


def payout_history(div: DataFrame, fin: DataFrame, shares: DataFrame, rate: DataFrame) -> DataFrame:
    """Mean payout ratio over years with positive earnings per share."""
    y = div.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("adjDividend").alias("dps"))
    newest = fin.groupBy("symbol").agg(F.max_by("reportedCurrency", "date").alias("cur"))
    e = fin.groupBy("symbol", F.col("calendarYear").alias("year")).agg(F.sum("netIncome").alias("ni"))
    e = e.join(newest, "symbol").join(shares, "symbol").crossJoin(F.broadcast(rate))
    e = e.withColumn("eps", sdiv(F.col("ni") * F.when(F.col("cur") == "USD", F.col("rate")).otherwise(1.0), "outstandingShares"))
    return y.join(e, ["symbol", "year"]).where("eps > 0").groupBy("symbol").agg(F.avg(sdiv("dps", "eps") * 100).alias("avg_payout"), F.count("*").alias("payout_years"))


def dividend_outlook(scores: DataFrame, payout: DataFrame, stats: DataFrame) -> DataFrame:
    """Next dividend, forward yield, payout ratio and consistency."""
    eps = F.when(F.col("peRatio") > 0, sdiv("price", "peRatio"))
    nxt = F.col("lastDiv") + F.col("avgFlatAnnualDivIncrease")
    return (
        scores.join(payout, "symbol", "left").join(stats.select("symbol", "num_dividend_year", "num_positive_year", "cagr_5y", "cagr_10y"), "symbol")
        .select(
            "symbol", nxt.alias("next_div"), F.when(F.col("price") > 0, sdiv(nxt, "price") * 100).otherwise(0.0).alias("next_yield"),
            F.when(eps > 0, sdiv("lastDiv", eps) * 100).alias("payout_ratio"), "avg_payout",
            F.when(F.col("num_dividend_year") > 0, sdiv("num_positive_year", "num_dividend_year") * 100).otherwise(0.0).alias("consistency"),
            "cagr_5y", "cagr_10y",
        )
    )


def stored_score() -> "F.Column":
    """Dividend score of the nightly table."""
    years = 25 + F.col("numOfYear")
    return (
        sdiv(F.col("lastDiv") + F.col("avgFlatAnnualDivIncrease") * 5, "price")
        * sdiv(F.col("numDividendYear") * 2, years) * sdiv(F.col("positiveYear") * 2, years)
        * (1 + F.col("revenueGrowth") * 0.5 * 5) * F.col("lastDiv") / 100
    )


def score_table(profiles: DataFrame, fin: DataFrame, div: DataFrame, returns: DataFrame, rate: DataFrame, asof: str, home: bool = True) -> DataFrame:
    """The scored stock table: every profile with growth, dividend and return metrics.

    Dividend columns are filled only for symbols that also have usable
    statements; the others keep the defaults (0 or NULL). ``home`` takes the
    last annual dividend from the payments and converts USD reporters.
    """
    from .fundamentals import fin_stats

    fs = fin_stats(fin, rate if home else None).where("revenue_growth_TTM is not null and netIncome_growth_TTM is not null")
    fs = fs.select(
        "symbol", F.col("trim_mean_10y_revenue_growth").alias("revenueGrowth"), F.col("cagr_5y_revenue").alias("revenueCAGR5Y"),
        F.col("revenue_growth_TTM").alias("revenueGrowthTTM"), F.col("trim_mean_10y_netIncome_growth").alias("netIncomeGrowth"),
        F.col("netIncome_growth_TTM").alias("netIncomeGrowthTTM"), F.col("median_profit_margin").alias("medianProfitMargin"),
        "earningTTM", "revenueTTM", F.lit(True).alias("_fin"),
    )
    ds = dividend_stats(yearly_dividends(div, asof), asof).join(trailing_sums(div, asof), "symbol")
    ds = ds.join(last_annual_dividend(div, asof).withColumnRenamed("lastDiv", "_paid"), "symbol")
    ds = ds.withColumnsRenamed({"div_sum_1y": "_s1", "div_sum_10y": "_s10"}).withColumn("_div", F.lit(True))
    p = profiles.withColumnRenamed("lastDiv", "_profile_div")
    j = p.join(fs, "symbol", "left").join(ds, "symbol", "left").join(returns, "symbol", "left")
    ok = F.coalesce(F.col("_fin") & F.col("_div"), F.lit(False))
    last = F.when(ok, F.col("_paid") if home else F.col("_profile_div")).otherwise(0.0)
    out = j.select(
        *profiles.drop("lastDiv").columns, last.alias("lastDiv"),
        F.when(ok, sdiv(last, "price") * 100).otherwise(0.0).alias("yield"),
        "revenueGrowth", "revenueCAGR5Y", "revenueGrowthTTM", "netIncomeGrowth", "netIncomeGrowthTTM", "medianProfitMargin", "earningTTM", "revenueTTM",
        F.when(ok, F.least(F.coalesce("historical_mean_flat", F.lit(0.0)), F.coalesce("div_inc_5y_mean_flat", F.lit(0.0)))).alias("avgFlatAnnualDivIncrease"),
        F.when(ok, F.col("num_dividend_year")).alias("numDividendYear"), F.when(ok, F.col("num_positive_year")).alias("positiveYear"),
        F.when(ok, F.col("maximum_cut_pct")).otherwise(0.0).alias("maximumCutPct"), F.when(ok, F.col("max_10y_cut_pct")).otherwise(0.0).alias("max10CutPct"),
        F.when(ok, F.year(F.lit(asof)) - F.year("ipoDate")).alias("numOfYear"),
        F.when(ok, F.col("_s1")).otherwise(0.0).alias("div_sum_1y"), F.when(ok, F.col("_s10")).otherwise(0.0).alias("div_sum_10y"),
        "return_7d", "return_1m", "return_1y", "return_10y",
    )
    out = out.withColumn("peRatio", sdiv("mktCap", "earningTTM")).withColumn("psRatio", sdiv("mktCap", "revenueTTM")).withColumn("DScore", stored_score())
    return with_total_returns(out)


def with_total_returns(df: DataFrame) -> DataFrame:
    """Price return plus dividends over the price at the start of the period."""
    for h in ("1y", "10y"):
        start = sdiv("price", 1 + F.col(f"return_{h}"))
        df = df.withColumn(f"total_return_{h}", F.col(f"return_{h}") + sdiv(f"div_sum_{h}", start))
    return df


def cap_penalty(cap="mktCap"):
    """Logistic discount of small caps, centred on 3 trillion."""
    return 1 / (1 + F.exp(-2 * (F.col(cap) / 3_000_000_000_000 - 1)))


RETURN_COLS = ["return_7d", "return_1m", "return_1y", "return_10y", "total_return_1y", "total_return_10y"]


def cut_size(c: str):
    """A cut as a positive percentage."""
    return F.when(F.col(c).isNotNull(), -F.least(F.col(c), F.lit(0.0)))


def screener_table(scores: DataFrame) -> DataFrame:
    """Risk-adjusted projected yield and rank, payers first.

    Missing numbers end as 0, as on the ranking page.
    """
    null = F.lit(None).cast("double")
    pos = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(null)
    d = scores.withColumn("marginTTM", sdiv("earningTTM", "revenueTTM") * 100).withColumn("mc_penalty", cap_penalty())
    d = d.withColumn("maximumCutPct", cut_size("maximumCutPct")).withColumn("max10CutPct", cut_size("max10CutPct"))
    for c in RETURN_COLS:
        d = d.withColumn(c, F.col(c) * 100)
    reliability = F.coalesce(sdiv("positiveYear", pos("numOfYear")), F.lit(1.0))
    growth = F.coalesce(clip(sdiv("avgFlatAnnualDivIncrease", pos("lastDiv")), -0.20, 0.05), F.lit(0.0))
    projected = F.col("lastDiv") * (1 + growth * 5 * reliability)
    fwd = clip(clip(sdiv(projected, pos("price")) * 100, low=0), high=12)
    maturity = 1 - F.exp(-F.col("numDividendYear") / 10)
    payout = F.col("yield") / 100 * F.when(F.col("peRatio") > 0, F.col("peRatio"))
    sustain = F.coalesce(sdiv(F.lit(1.0), 1 + clip(payout - 1, low=0)), F.lit(1.0))
    adj = lambda c: F.coalesce(1 + clip(c, -100, 25) / 100, F.lit(1.0))
    payer = (F.col("yield") > 0).cast("double")
    score = fwd * maturity * (100 - F.col("max10CutPct")) / 100 * F.col("mc_penalty") * adj("revenueGrowthTTM") * adj("netIncomeGrowthTTM") * sustain * payer
    d = d.withColumn("DScore", F.coalesce(clip(score, low=0) + payer * 1e-6, F.lit(0.0))).withColumn("_payer", payer)
    numeric = [f.name for f in d.schema if f.dataType.typeName() in ("double", "long", "integer")]
    d = d.na.fill(0, subset=numeric)
    return order_index(d, [F.desc("_payer"), F.desc("DScore"), "symbol"], "Rank").drop("_payer")


def unscored_stats(profiles: DataFrame, fin: DataFrame, div: DataFrame, rate: DataFrame, shares: DataFrame, last_close: DataFrame, asof: str) -> DataFrame:
    """Statistics for symbols missing from the stored table, with its fallbacks.

    Every symbol with shares gets a row; without a profile, price falls back to
    the last close and the cap to price times shares.
    """
    from .fundamentals import fin_stats

    ds = dividend_stats(yearly_dividends(div, asof), asof)
    newest = yearly_dividends(div, asof).groupBy("symbol").agg(F.max_by("adjDividend", "year").alias("_last"))
    fs = fin_stats(fin, rate)
    p = profiles.select("symbol", F.col("price").alias("_p"), "changes", F.col("mktCap").cast("double").alias("_cap"), "sector", "industry", "beta", "ipoDate")
    j = shares.join(last_close, "symbol", "left").join(p, "symbol", "left").join(ds, "symbol", "left").join(newest, "symbol", "left").join(fs, "symbol", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    j = j.withColumn("price", F.coalesce("_p", "close", F.lit(0.0)))
    j = j.withColumn("mktCap", F.coalesce("_cap", F.col("price") * F.col("outstandingShares")))
    years = F.coalesce(F.datediff(F.lit(asof).cast("date"), "ipoDate") / 365.25, F.lit(10.0))
    ratio = lambda c: F.when(F.col(c) > 0, sdiv("mktCap", c)).otherwise(-1.0)
    return j.select(
        "symbol", "price", zero("changes").alias("changes"), "mktCap", F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"), F.coalesce("beta", F.lit(1.0)).alias("beta"), years.alias("numOfYear"),
        zero("_last").alias("lastDiv"), F.when(F.col("price") > 0, sdiv(zero("_last"), "price") * 100).otherwise(0.0).alias("yield"),
        zero("num_dividend_year").alias("numDividendYear"), zero("num_positive_year").alias("positiveYear"),
        zero("historical_mean_flat").alias("avgFlatAnnualDivIncrease"), zero("median_5y_revenue_growth").alias("revenueGrowth"),
        zero("median_5y_netIncome_growth").alias("netIncomeGrowth"), zero("median_profit_margin").alias("medianProfitMargin"),
        zero("earningTTM").alias("earningTTM"), zero("revenueTTM").alias("revenueTTM"), zero("marginTTM").alias("marginTTM"),
        zero("revenue_growth_TTM").alias("revenueGrowthTTM"), zero("netIncome_growth_TTM").alias("netIncomeGrowthTTM"),
        ratio("earningTTM").alias("peRatio"), ratio("revenueTTM").alias("psRatio"),
    )


