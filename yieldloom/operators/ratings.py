"""Metric specifications, ratings and peer comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import avg_pct_rank, distribution, running_before
from ..functions.scalars import is_close, row_mean, sdiv
from ..session import cut_lineage
from .dividends import RETURN_COLS, cap_penalty

# Compared metrics with their preferred direction and validity rule.
METRICS = [
    ("yield", "higher_better", "nonnegative"),
    ("lastDiv", "neutral", "nonnegative"),
    ("avgFlatAnnualDivIncrease", "higher_better", "finite"),
    ("numDividendYear", "higher_better", "nonnegative"),
    ("positiveYear", "higher_better", "nonnegative"),
    ("dividendPayoutRatio", "neutral", "positive"),
    ("peRatio", "lower_better", "positive"),
    ("psRatio", "lower_better", "positive"),
    ("revenueGrowth", "higher_better", "finite"),
    ("revenueCAGR5Y", "higher_better", "finite"),
    ("netIncomeGrowth", "higher_better", "finite"),
    ("revenueGrowthTTM", "higher_better", "finite"),
    ("netIncomeGrowthTTM", "higher_better", "finite"),
    ("revenueTTM", "higher_better", "finite"),
    ("earningTTM", "higher_better", "finite"),
    ("medianProfitMargin", "higher_better", "finite"),
    ("marginTTM", "higher_better", "finite"),
    ("return_1m", "higher_better", "finite"),
    ("return_1y", "higher_better", "finite"),
    ("total_return_1y", "higher_better", "finite"),
    ("return_10y", "higher_better", "finite"),
    ("price", "neutral", "positive"),
    ("mktCap", "neutral", "positive"),
    ("beta", "neutral", "finite"),
]


def comparison_table(scores: DataFrame) -> DataFrame:
    """Margin, payout ratio, cap penalty, positive cuts and percent returns."""
    shares = F.when((F.col("mktCap") > 0) & (F.col("price") > 0), sdiv("mktCap", "price"))
    eps = sdiv("earningTTM", shares)
    d = scores.withColumn("marginTTM", sdiv("earningTTM", "revenueTTM") * 100)
    d = d.withColumn("dividendPayoutRatio", F.when(eps > 0, sdiv("lastDiv", eps) * 100)).withColumn("mc_penalty", cap_penalty())
    for c in ("maximumCutPct", "max10CutPct"):
        d = d.withColumn(c, F.when(F.col(c).isNotNull(), -F.least(F.col(c), F.lit(0.0))))
    for c in RETURN_COLS:
        d = d.withColumn(c, F.col(c) * 100)
    return d


def metric_values(table: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(symbol, metric, direction, value) with values that break their metric's rule removed."""
    cells = []
    for name, direction, rule in METRICS:
        v = F.col(name).cast("double")
        ok = {"positive": v > 0, "nonnegative": v >= 0, "finite": v.isNotNull() & ~F.isnan(v)}[rule]
        cells.append(F.struct(F.lit(name).alias("metric"), F.lit(direction).alias("direction"), F.when(ok, v).alias("value")))
    keep = ["symbol", *(extra or [])]
    return table.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*").where("value is not null")


def ratings(scores: DataFrame, min_peers: int = 3) -> DataFrame:
    """Valuation, dividend, growth, profitability, sector and overall rating per stock.

    All ranks come from one sorted pass over (metric, group, value) rows.
    """
    s = cut_lineage(scores.select("symbol", "sector", "peRatio", "yield", "numDividendYear", "revenueGrowth", "netIncomeGrowth", "medianProfitMargin"))
    pe_ok, payer = F.col("peRatio") > 0, F.col("yield") > 0
    cell = lambda n, v, g=F.lit(""): F.struct(F.lit(n).alias("metric"), g.alias("grp"), v.cast("double").alias("value"))
    cells = F.array(
        cell("pe", F.when(pe_ok, -F.col("peRatio"))), cell("years", F.when(payer, F.col("numDividendYear"))), cell("yield", F.when(payer, F.col("yield"))),
        cell("rev", F.col("revenueGrowth")), cell("inc", F.col("netIncomeGrowth")), cell("margin", F.col("medianProfitMargin")),
        cell("sector", F.when(pe_ok, -F.col("peRatio")), F.coalesce("sector", F.lit(""))),
    )
    long = s.select("symbol", F.explode(cells).alias("c")).select("symbol", "c.*").where("value is not null")
    ranked = avg_pct_rank(long, "value", "p", key="symbol", by=["metric", "grp"])
    names = ["pe", "years", "yield", "rev", "inc", "margin", "sector"]
    wide = ranked.groupBy("symbol").agg(*[F.max(F.when(F.col("metric") == n, F.col("p"))).alias(f"p_{n}") for n in names])
    peers = s.where(pe_ok).groupBy("sector").agg(F.count("*").alias("sector_peer_count"))
    j = s.join(wide, "symbol", "left").join(peers, "sector", "left").withColumn("sector_peer_count", F.coalesce("sector_peer_count", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = j.select(
        "symbol", "sector_peer_count", zero(F.col("p_pe") * 100).alias("valuation"),
        F.when(payer, (F.col("p_years") + F.col("p_yield")) / 2 * 100).otherwise(0.0).alias("dividend"),
        ((F.col("p_rev") + F.col("p_inc")) / 2 * 100).alias("growth"), (F.col("p_margin") * 100).alias("profitability"),
        F.when(F.col("sector_peer_count") >= min_peers, zero(F.col("p_sector") * 100)).alias("sector"),
    )
    return j.withColumn("overall", row_mean("valuation", "dividend", "growth", "profitability", "sector"))


def outside_ratings(universe: DataFrame, others: DataFrame, min_peers: int = 3) -> DataFrame:
    """Ratings of stocks outside the universe: share of peers beaten.

    Peers and candidates are sorted together and peers are counted on the way,
    so no (candidate, peer) pair is ever formed. Candidates sort before equal
    peers, which keeps the comparison strict.
    """
    cols = ["symbol", "sector", "peRatio", "yield", "numDividendYear", "revenueGrowth", "netIncomeGrowth", "medianProfitMargin"]
    both = cut_lineage(universe.select(*cols, F.lit(1).alias("peer")).unionByName(others.select(*cols, F.lit(0).alias("peer"))))
    pe_ok, payer = F.col("peRatio") > 0, F.col("yield") > 0
    cell = lambda n, v, g=F.lit(""): F.struct(F.lit(n).alias("metric"), g.alias("grp"), v.cast("double").alias("value"))
    cells = F.array(
        cell("pe", F.when(pe_ok, -F.col("peRatio"))), cell("years", F.when(payer, F.col("numDividendYear"))), cell("yield", F.when(payer, F.col("yield"))),
        cell("rev", F.col("revenueGrowth")), cell("inc", F.col("netIncomeGrowth")), cell("margin", F.col("medianProfitMargin")),
        cell("sector", F.when(pe_ok, -F.col("peRatio")), F.coalesce("sector", F.lit(""))),
    )
    long = both.select("symbol", "peer", F.explode(cells).alias("c")).select("symbol", "peer", "c.*").where("value is not null")
    run = running_before(long, ["metric", "grp", "value", "peer", "symbol"], "peer")
    start = run.groupBy("metric", "grp").agg(F.min("_before").alias("_s"))
    beaten = run.where("peer = 0").join(start, ["metric", "grp"]).withColumn("b", F.col("_before") - F.col("_s"))
    names = ["pe", "years", "yield", "rev", "inc", "margin", "sector"]
    wide = beaten.groupBy("symbol").agg(*[F.max(F.when(F.col("metric") == n, F.col("b"))).alias(f"b_{n}") for n in names])
    peers = both.where("peer = 1")
    totals = peers.agg(F.count("*").alias("n"), F.count_if(pe_ok).alias("n_pe"), F.count_if(payer).alias("n_pay"))
    sector = peers.where(pe_ok).groupBy("sector").agg(F.count("*").alias("n_sector"))
    j = both.where("peer = 0").join(wide, "symbol", "left").join(sector, "sector", "left").crossJoin(F.broadcast(totals))
    share = lambda b, n: F.coalesce(sdiv(b, n), F.lit(0.0)) * 100
    j = j.select(
        "symbol", share("b_pe", "n_pe").alias("valuation"), ((share("b_years", "n_pay") + share("b_yield", "n_pay")) / 2).alias("dividend"),
        ((share("b_rev", "n") + share("b_inc", "n")) / 2).alias("growth"), share("b_margin", "n").alias("profitability"),
        F.when(F.col("n_sector") >= min_peers, share("b_sector", "n_sector")).alias("sector"),
    )
    return j.withColumn("overall", row_mean("valuation", "dividend", "growth", "profitability", "sector"))


def direction_percentile(values: DataFrame) -> DataFrame:
    """Share of peers each stock beats per metric, with ties within float tolerance.

    Counts below, up to, and within the tolerance band come from probe points
    sorted together with the peers, not from comparing every pair.
    """
    v = F.col("value")
    tol = F.lit(1e-8) + F.lit(1e-5) * F.abs(v)
    probe = lambda tag, x, o, w: F.struct(F.lit(tag).alias("tag"), x.alias("x"), F.lit(o).alias("o"), F.lit(w).alias("w"))
    pts = F.array(probe("peer", v, 1, 1), probe("lt", v, 0, 0), probe("le", v, 2, 0), probe("t0", v - tol, 0, 0), probe("t1", v + tol, 2, 0))
    long = values.select("symbol", "metric", "direction", F.explode(pts).alias("p")).select("symbol", "metric", "direction", "p.*")
    run = running_before(long, ["metric", "x", "o", "symbol", "tag"], "w")
    base = run.groupBy("metric").agg(F.min("_before").alias("_s"), F.sum("w").alias("peer_count"))
    at = lambda t: F.max(F.when(F.col("tag") == t, F.col("_before")))
    g = run.groupBy("symbol", "metric", "direction").agg(at("lt").alias("lt"), at("le").alias("le"), (at("t1") - at("t0")).alias("tie_count"))
    j = g.join(F.broadcast(base), "metric")  # a row per metric
    below, upto = F.col("lt") - F.col("_s"), F.col("le") - F.col("_s")
    hit = F.when(F.col("direction") == "higher_better", below).when(F.col("direction") == "lower_better", F.col("peer_count") - upto).otherwise(upto)
    pct = sdiv(hit, "peer_count") * 100
    text = F.when(F.col("direction") != "neutral", F.concat(F.lit("Better than "), F.format_number(pct, 0), F.lit("% of "), F.col("peer_count").cast("string"), F.lit(" valid peers"))).otherwise(
        F.concat(F.lit("At or below the "), F.format_number(pct, 0), F.lit("th percentile among "), F.col("peer_count").cast("string"), F.lit(" valid peers"))
    )
    tied = F.when(F.col("tie_count") > 1, F.concat(F.lit("; tied with "), (F.col("tie_count") - 1).cast("string"))).otherwise("")
    return j.select("symbol", "metric", pct.alias("percent"), "peer_count", "tie_count", F.concat(text, tied).alias("text"))


def comparison_states(values: DataFrame, group: str) -> DataFrame:
    """Best / Weakest / Tied per metric inside each comparison basket."""
    hi = F.col("direction") == "higher_better"
    ext = values.groupBy(group, "metric").agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    j = values.join(ext, [group, "metric"])
    best, worst = F.when(hi, F.col("_hi")).otherwise(F.col("_lo")), F.when(hi, F.col("_lo")).otherwise(F.col("_hi"))
    state = (
        F.when(F.col("direction") == "neutral", "").when(is_close(best, worst), "Tied")
        .when(is_close(F.col("value"), best), "Best").when(is_close(F.col("value"), worst), "Weakest").otherwise("")
    )
    return j.select(group, "symbol", "metric", "value", state.alias("state"))


def peer_stats(values: DataFrame) -> DataFrame:
    d = distribution(values, "value", ["metric"], {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return d.select("metric", "n", "mean", "median", "p25", "p75")


def quadrants(table: DataFrame, x: str, y: str, x_high: bool, y_high: bool) -> DataFrame:
    """Label every stock by its side of the two peer medians.

    The medians come from the peers inside the 5th-95th percentile on both axes.
    """
    t = cut_lineage(table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("symbol", F.col(x).alias("x"), F.col(y).alias("y")))
    long = lambda d: d.unpivot(["symbol"], ["x", "y"], "axis", "v")
    spread = lambda d, c: d.agg(*[F.max(F.when(F.col("axis") == a, F.col(q))).alias(f"{a}_{q}") for a in ("x", "y") for q in c])
    rng = spread(distribution(long(t), "v", ["axis"], {"lo": 0.05, "hi": 0.95}, moments=False), ("lo", "hi"))
    inner = t.crossJoin(F.broadcast(rng)).where("x between x_lo and x_hi and y between y_lo and y_hi").select("symbol", "x", "y")
    med = spread(distribution(long(inner), "v", ["axis"], {"med": 0.5}, moments=False), ("med",))
    j = t.crossJoin(F.broadcast(med))  # one row
    fx = (F.col("x") >= F.col("x_med")) == F.lit(x_high)
    fy = (F.col("y") >= F.col("y_med")) == F.lit(y_high)
    label = F.when(fx & fy, "More favorable on both").when(fx, "X more favorable").when(fy, "Y more favorable").otherwise("Less favorable on both")
    return j.select("symbol", "x", "y", "x_med", "y_med", label.alias("quadrant"))


def daily_volatility(prices: DataFrame, lookback: int = 60, cap: float = 0.35) -> DataFrame:
    """Deviation of recent daily returns, leaving out jumps that look like data errors."""
    from .returns import pct_change, tail

    r = tail(prices, lookback + 1).withColumn("r", pct_change("close", 1))
    r = r.withColumn("r", F.when(F.abs("r") <= cap, F.col("r")))
    return r.groupBy("symbol").agg((F.stddev_samp("r") * 100).alias("volatility"), F.count("r").alias("observations"))


def trading_rank(base: DataFrame, volatility: DataFrame, weight: float = 0.6, lookback: int = 60, min_vol: float = 1.0, min_pe: float = 5, max_pe: float = 50, min_cap: float = 1e12) -> DataFrame:
    """Shortlist filter and the blended discount / volatility rank."""
    from ..functions.ranking import long_pct_ranks

    d = base.where((F.col("mktCap") >= min_cap) & F.col("current_pe").between(min_pe, max_pe) & (F.col("avg_pe") > 0) & (F.col("avg_pe") < 100))
    d = d.join(volatility, "symbol").where((F.col("observations") >= max(15, lookback // 2)) & (F.col("volatility") >= min_vol))
    d = cut_lineage(d)
    r = long_pct_ranks(d, ["symbol"], {"d": F.col("Discount"), "v": F.col("volatility")})
    j = d.join(r, "symbol", "left")
    return j.select(*d.columns, (F.col("d") * 100).alias("discount_score"), (F.col("v") * 100).alias("volatility_score"), (F.col("d") * 100 * (1 - weight) + F.col("v") * 100 * weight).alias("trading_rank"))


def pinned_top(ranked: DataFrame, pinned: DataFrame, n: int) -> DataFrame:
    """Pinned symbols first, then by rank, cut to n rows."""
    p = pinned.select("symbol").distinct().withColumn("_p", F.lit(1))
    j = ranked.join(p, "symbol", "left").withColumn("pinned", F.coalesce("_p", F.lit(0)) == 1).drop("_p")
    return j.orderBy(F.desc("pinned"), F.desc("trading_rank"), F.desc("volatility"), F.desc("Discount"), "symbol").limit(n)


def parse_symbol_lists(raw: DataFrame, valid: DataFrame, limit: int = 5) -> DataFrame:
    """Comma lists to known symbols: trimmed, upper case, first mention kept, at most ``limit``."""
    items = raw.select("query_id", F.posexplode(F.split("query", ",")).alias("pos", "item")).withColumn("symbol", F.upper(F.trim("item")))
    seen = items.where("symbol <> ''").groupBy("query_id", "symbol").agg(F.min("pos").alias("pos"))
    ok = seen.join(valid.select("symbol").distinct(), "symbol", "left_semi")
    ok = ok.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))  # the items of one short list
    over = ok.groupBy("query_id").agg(F.max("place").alias("_n"))
    return ok.where(F.col("place") <= limit).join(over, "query_id").select("query_id", "place", "symbol", (F.col("_n") > limit).alias("overflow"))
