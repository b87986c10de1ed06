"""Trailing statements, growth statistics and multiples history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change, clip, row_mean, sdiv
from .asof import asof_join
from .returns import by_symbol, rolling



def newest():
    return Window.partitionBy("symbol").orderBy(F.desc("date"))


FALLBACK_RATE = 16_618.0  # fixed value: USD/IDR when no quote is known


def usd_rate(fx: DataFrame, asof: str, fallback: float = FALLBACK_RATE) -> DataFrame:
    """Latest USD/IDR close at or before ``asof`` as a one-row table."""
    last = fx.where((F.col("pair") == "USDIDR") & (F.col("date") <= F.lit(asof).cast("date"))).agg(F.max_by("close", "date").alias("r"))
    return last.select(F.coalesce("r", F.lit(fallback)).alias("rate"))


def usd_factor(currency: str = "reportedCurrency") -> Column:
    return F.when(F.col(currency) == "USD", F.col("rate")).otherwise(1.0)


def trimmed_mean(values: Column, share: float = 0.1) -> Column:
    """Mean of a short array after cutting int(n * share) values at each end."""
    s = F.array_sort(values)
    cut = F.floor(F.size(s) * share).cast("int")
    kept = F.slice(s, cut + 1, F.size(s) - 2 * cut)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(kept).cast("double"))


def trailing(fin: DataFrame) -> DataFrame:
    """Four-quarter sums, year-on-year growth and margin per statement."""
    t = fin.withColumn("revenue_ttm", rolling(F.sum, "revenue", 4, by_symbol())).withColumn("netIncome_ttm", rolling(F.sum, "netIncome", 4, by_symbol()))
    return t.select(
        "*", *[change(f"{m}_ttm", F.lag(f"{m}_ttm", 4).over(by_symbol())).alias(f"{m}_growth") for m in ("revenue", "netIncome")],
        (sdiv("netIncome_ttm", "revenue_ttm") * 100).alias("margin"), F.row_number().over(newest()).alias("rd"),
    )


def _growth_aggs(m: str) -> list[Column]:
    g, rd = F.col(f"{m}_growth"), F.col("rd")
    out = []
    for p in (2, 5, 10):
        recent = F.when(rd <= 4 * p, g)
        ratio = F.col(f"_{m}_ratio_{p}")
        newest = F.min_by(ratio, F.when(ratio.isNotNull(), rd))
        out += [
            (F.median(recent) * 100).alias(f"median_{p}y_{m}_growth"),
            (trimmed_mean(F.collect_list(recent)) * 100).alias(f"trim_mean_{p}y_{m}_growth"),
            F.when(newest > 0, (F.pow(newest, F.lit(1.0 / p)) - 1) * 100).alias(f"cagr_{p}y_{m}"),
        ]
    out.append((F.min_by(g, F.when(g.isNotNull() & (rd <= 40), rd)) * 100).alias(f"{m}_growth_TTM"))
    return out


def fin_stats(fin: DataFrame, rate: DataFrame | None) -> DataFrame:
    """Growth, margin and trailing totals per symbol (quarters per symbol are few).

    With ``rate`` the trailing totals of USD reporters are converted.
    """
    t = trailing(fin)
    t = t.select("*", *[
        sdiv(f"{m}_ttm", F.lag(f"{m}_ttm", 4 * p).over(by_symbol())).alias(f"_{m}_ratio_{p}") for m in ("revenue", "netIncome") for p in (2, 5, 10)
    ])
    at1 = lambda c: F.max(F.when(F.col("rd") == 1, F.col(c)))
    g = t.groupBy("symbol").agg(
        *_growth_aggs("revenue"), *_growth_aggs("netIncome"), F.median("margin").alias("median_profit_margin"),
        at1("netIncome_ttm").alias("earningTTM"), at1("revenue_ttm").alias("revenueTTM"), at1("reportedCurrency").alias("reportedCurrency"),
    )
    g = g.withColumn("marginTTM", F.when(F.col("revenueTTM") > 0, sdiv("earningTTM", "revenueTTM") * 100).otherwise(0.0))
    if rate is not None:
        g = g.crossJoin(F.broadcast(rate))  # one row
        for c in ("earningTTM", "revenueTTM"):
            g = g.withColumn(c, F.col(c) * usd_factor())
        g = g.drop("rate")
    return g


def convert_statements(fin: DataFrame, rate: DataFrame, target: str = "IDR") -> DataFrame:
    """Convert USD reporters and relabel them, so a second pass changes nothing."""
    f = fin.crossJoin(F.broadcast(rate))
    for c in ("revenue", "netIncome"):
        f = f.withColumn(c, F.col(c) * usd_factor())
    return f.withColumn("reportedCurrency", F.when(F.col("reportedCurrency") == "USD", target).otherwise(F.col("reportedCurrency"))).drop("rate")


def ratio_history(prices: DataFrame, fin: DataFrame, shares: DataFrame, rate: DataFrame) -> DataFrame:
    """Daily PE and PS: price over per-share trailing earnings and sales, as of each session."""
    f = fin.join(shares, "symbol").crossJoin(F.broadcast(rate))
    for m, o in (("netIncome", "eps"), ("revenue", "sps")):
        f = f.withColumn(f"_{o}", sdiv(F.col(m) * usd_factor(), "outstandingShares"))
    f = f.select("symbol", "date", rolling(F.sum, "_eps", 4, by_symbol()).alias("eps_ttm"), rolling(F.sum, "_sps", 4, by_symbol()).alias("sps_ttm"))
    j = asof_join(prices.select("symbol", "date", "close"), f, ["symbol"], {"eps_ttm": "eps_ttm", "sps_ttm": "sps_ttm"})
    return j.withColumn("pe", sdiv("close", "eps_ttm")).withColumn("ps", sdiv("close", "sps_ttm"))


def pe_history(prices: DataFrame, fin: DataFrame, rate: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Daily PE from reported EPS; with shares, USD reporters use net income per share."""
    f = fin.crossJoin(F.broadcast(rate))
    if shares is not None:
        f = f.join(shares, "symbol")
        usd = sdiv("netIncome", "outstandingShares") * F.col("rate")
    else:
        usd = F.col("eps") * F.col("rate")
    f = f.withColumn("_eps", F.when(F.col("reportedCurrency") == "USD", usd).otherwise(F.col("eps")))
    f = f.select("symbol", "date", rolling(F.sum, "_eps", 4, by_symbol()).alias("eps_ttm"))
    j = asof_join(prices.select("symbol", "date", "close"), f, ["symbol"], {"eps_ttm": "eps_ttm"})
    return j.withColumn("pe", sdiv("close", "eps_ttm"))


def pe_stats(pe: DataFrame) -> DataFrame:
    """Mean, 5th and 95th percentile of PE over the last 1/2/3/5/10 x 365 days per symbol."""
    p = pe.withColumn("_last", F.max("date").over(Window.partitionBy("symbol")))
    aggs = [F.max_by("pe", "date").alias("current_pe")]
    for y in (1, 2, 3, 5, 10):
        v = F.when(F.col("date") > F.date_sub("_last", y * 365), F.col("pe"))
        aggs += [F.avg(v).alias(f"last_{y}y_mean"), F.percentile(v, F.lit(0.05)).alias(f"last_{y}y_min_ci"), F.percentile(v, F.lit(0.95)).alias(f"last_{y}y_max_ci")]
    return p.groupBy("symbol").agg(*aggs)


def valuation_table(pe: DataFrame, fin: DataFrame) -> DataFrame:
    """PE statistics, revenue growth and the distance of today's PE from its range."""
    growth = [c for c in fin_stats(fin, None).columns if "revenue_growth" in c or c.endswith("y_revenue")]
    v = pe_stats(pe).join(fin_stats(fin, None).select("symbol", *growth), "symbol")
    return (
        v.withColumn("target", change("last_2y_mean", "current_pe"))
        .withColumn("risk", 1 - sdiv("last_2y_min_ci", "current_pe"))
        .withColumn("upside", change("last_2y_max_ci", "current_pe"))
    )


def statement_stats(fin: DataFrame) -> DataFrame:
    """Newest trailing figures and the median of the last 20 statements."""
    t = trailing(fin).where("revenue_ttm is not null and netIncome_ttm is not null")
    t = t.withColumn("rd", F.row_number().over(newest()))
    at1 = lambda c: F.max(F.when(F.col("rd") == 1, F.col(c)))
    med = lambda c: F.median(F.when(F.col("rd") <= 20, F.col(c)))
    return t.groupBy("symbol").agg(
        at1("revenue_ttm").alias("revenue_ttm"), at1("netIncome_ttm").alias("earnings_ttm"),
        (at1("revenue_growth") * 100).alias("revenue_growth_ttm"), (at1("netIncome_growth") * 100).alias("earnings_growth_ttm"),
        (med("revenue_growth") * 100).alias("revenue_growth_5y"), (med("netIncome_growth") * 100).alias("earnings_growth_5y"),
        at1("margin").alias("margin_ttm"), med("margin").alias("margin_median"), F.max("date").alias("statement_date"),
    )


def ratio_summary(hist: DataFrame, ratio: str, years: int, min_rows: int = 60) -> DataFrame:
    """Current, mean, median and percentile of one positive multiple over N calendar years."""
    h = hist.where(F.col(ratio) > 0).select("symbol", "date", F.col(ratio).alias("v"))
    last = Window.partitionBy("symbol")
    h = h.withColumn("_last", F.max("date").over(last)).withColumn("current", F.max_by("v", "date").over(last))
    w = h.where(F.col("date") >= F.add_months("_last", -12 * years))
    g = w.groupBy("symbol", "current").agg(
        F.avg("v").alias("mean"), F.median("v").alias("median"),
        (F.avg((F.col("v") <= F.col("current")).cast("double")) * 100).alias("percentile"), F.count("*").alias("observations"),
    ).where(F.col("observations") >= min_rows)
    return g.withColumn("discount", change("median", "current") * 100)


def project_upside(pe_now, pe_mean, ps_now, ps_mean, earn_growth, rev_growth, years: int) -> dict[str, Column]:
    """Return to the mean multiple plus capped growth, in percent."""
    rate = lambda g: clip(F.coalesce(g, F.lit(0.0)), -20, 30) / 100
    pe = sdiv(pe_mean, pe_now) * F.pow(1 + rate(earn_growth), F.lit(float(years)))
    ps = sdiv(ps_mean, ps_now) * F.pow(1 + rate(rev_growth), F.lit(float(years)))
    return {"blended": ((pe + ps) / 2 - 1) * 100, "earnings": (pe - 1) * 100, "revenue": (ps - 1) * 100}


def scan_rows(universe: DataFrame, prices: DataFrame, fin: DataFrame, rate: DataFrame, years: int = 5) -> DataFrame:
    """One row per company with enough history: multiples, growth and projected upside."""
    shares = universe.select("symbol", sdiv("mktCap", "price").alias("outstandingShares"))
    hist = ratio_history(prices, fin, shares, rate)
    pre = lambda r: {c: f"{r}_{c}" for c in ("current", "mean", "median", "percentile", "discount")}
    pe = ratio_summary(hist, "pe", years).drop("observations").withColumnsRenamed(pre("pe"))
    ps = ratio_summary(hist, "ps", years).drop("observations").withColumnsRenamed(pre("ps"))
    enough = fin.groupBy("symbol").agg(F.count("*").alias("_q")).where("_q >= 8").select("symbol")
    j = universe.select("symbol", "sector", "mktCap", "price").join(enough, "symbol").join(statement_stats(fin), "symbol").join(pe, "symbol").join(ps, "symbol")
    c = F.col
    one = project_upside(c("pe_current"), c("pe_mean"), c("ps_current"), c("ps_mean"), c("earnings_growth_ttm"), c("revenue_growth_ttm"), 1)
    five = project_upside(c("pe_current"), c("pe_mean"), c("ps_current"), c("ps_mean"), c("earnings_growth_5y"), c("revenue_growth_5y"), 5)
    back = (sdiv("pe_mean", "pe_current") + sdiv("ps_mean", "ps_current")) / 2
    return j.select(
        "*", ((back - 1) * 100).alias("upside_to_mean"), one["blended"].alias("upside_1y"), five["blended"].alias("upside_5y"),
        one["earnings"].alias("earnings_upside_1y"), one["revenue"].alias("revenue_upside_1y"),
        five["earnings"].alias("earnings_upside_5y"), five["revenue"].alias("revenue_upside_5y"),
        (c("price") * (1 + one["blended"] / 100)).alias("implied_price_1y"), (c("price") * (1 + five["blended"] / 100)).alias("implied_price_5y"),
    )


GROWTH_COLS = ["revenue_growth_5y", "revenue_growth_ttm", "earnings_growth_5y", "earnings_growth_ttm"]


def scan_scores(rows: DataFrame) -> DataFrame:
    """Valuation, growth and quality scores; a metric with at most one value scores 50."""
    from ..functions.ranking import long_pct_ranks
    from ..session import cut_lineage

    rows = cut_lineage(rows)  # read three times below
    metrics = [*GROWTH_COLS, "margin_ttm"]
    ranks = long_pct_ranks(rows, ["symbol"], {m: F.col(m) for m in metrics}).withColumnsRenamed({m: f"_r_{m}" for m in metrics})
    counts = rows.agg(*[F.count(m).alias(f"_n_{m}") for m in metrics])
    j = rows.join(ranks, "symbol", "left").crossJoin(F.broadcast(counts))
    r = lambda m: F.when(F.col(f"_n_{m}") <= 1, 50.0).otherwise(F.col(f"_r_{m}") * 100)
    j = j.withColumn("valuation_score", 100 - row_mean("pe_percentile", "ps_percentile"))
    j = j.withColumn("growth_score", row_mean(*[r(m) for m in GROWTH_COLS])).withColumn("quality_score", r("margin_ttm"))
    j = j.withColumn("score", F.col("valuation_score") * 0.55 + F.col("growth_score") * 0.35 + F.col("quality_score") * 0.10)
    return j.select(*rows.columns, "valuation_score", "growth_score", "quality_score", "score")
