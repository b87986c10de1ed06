"""Filters, summaries and rankings behind the screening pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import chunked_list, distribution, order_index
from ..functions.scalars import bin_right_closed, sdiv
from ..session import cut_lineage


def screen(scored: DataFrame, max_pe: float, min_rev: float, min_earn: float, recent_growth: bool = False, both_discounts: bool = False) -> DataFrame:
    """Candidates that pass every condition, ranked by score."""
    c = F.col
    ok = (c("pe_current") > 0) & (c("pe_current") <= max_pe) & (c("ps_current") > 0) & (c("revenue_growth_5y") >= min_rev) & (c("earnings_growth_5y") >= min_earn)
    ok = ok & (c("earnings_ttm") > 0) & (c("revenue_ttm") > 0)
    if recent_growth:
        ok = ok & (c("revenue_growth_ttm") > 0) & (c("earnings_growth_ttm") > 0)
    if both_discounts:
        ok = ok & (c("pe_discount") > 0) & (c("ps_discount") > 0)
    return order_index(scored.where(ok), [F.desc("score"), "symbol"], "Rank")


def universe_filter(df: DataFrame, min_cap_b: float = 0, sector: str | None = None, compliant: DataFrame | None = None) -> DataFrame:
    d = df.withColumn("mktCap_B", F.col("mktCap") / 1_000_000_000).where(F.col("mktCap_B") >= min_cap_b)
    if sector is not None:
        d = d.where(F.col("sector") == sector)
    if compliant is not None:
        d = d.join(compliant, "symbol", "left_semi")
    return d


def drop_twins(df: DataFrame, twins: DataFrame) -> DataFrame:
    """Drop a share class when its preferred twin is in the same selection.

    ``twins``: keep, drop.
    """
    present = twins.join(df.select(F.col("symbol").alias("keep")), "keep", "left_semi").select(F.col("drop").alias("symbol"))
    return df.join(present, "symbol", "left_anti")


def clip_quantiles(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows inside the quantile range plus the number of rows left out."""
    d = cut_lineage(df.where(F.col(value).isNotNull()))
    q = distribution(d, value, [], {"_lo": low, "_hi": high}, moments=False).withColumnRenamed("n", "_n")
    kept = d.crossJoin(F.broadcast(q)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    inside = kept.agg((F.max("_n") - F.count("*")).alias("excluded"))
    return kept.drop("_lo", "_hi", "_n").crossJoin(F.broadcast(inside))


def histogram(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, bins: int = 50) -> DataFrame:
    """Equal bins over the clipped range, the last bin closed on the right; empty bins stay."""
    kept = cut_lineage(clip_quantiles(df, value, low, high).select(F.col(value).cast("double").alias("v")))
    rng = kept.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    flat = F.col("a") == F.col("b")
    rng = rng.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    i = F.least(F.floor((F.col("v") - F.col("a")) * bins / (F.col("b") - F.col("a"))), F.lit(bins - 1)).cast("int")
    counts = kept.crossJoin(F.broadcast(rng)).groupBy(i.alias("bin")).agg(F.count("*").alias("count"))
    spine = rng.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    centre = F.col("a") + (F.col("bin") + 0.5) * (F.col("b") - F.col("a")) / bins
    return spine.join(counts, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("count", F.lit(0)).alias("count"))


def unit_histogram(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(value).alias("bin_min")).agg(F.count("*").alias("count"))


# Colour thresholds (percent) per return horizon.
RETURN_THRESHOLDS = {
    "1D": [-10, -5, -2, -0.5, 0.5, 2, 5, 10],
    "7D": [-15, -10, -5, -2, 2, 5, 10, 15],
    "1M": [-25, -15, -10, -5, 5, 10, 15, 25],
    "1Y": [-50, -25, -10, -5, 5, 10, 25, 50],
    "10Y": [-100, -50, -25, -10, 10, 25, 50, 100],
}
# Colour thresholds of the other coloured metrics.
METRIC_THRESHOLDS = {
    "PE": [-100, 0, 5, 15],
    "PS": [-1000, -100, -10, -1, 0, 1, 2, 3, 5],
    "yield": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
}


def hierarchy(df: DataFrame, size: str, color: str, edges: list[float]) -> DataFrame:
    """All / sector / industry / stock nodes with size, size-weighted colour and colour bin."""
    d = df.select("sector", "industry", "symbol", F.col(size).cast("double").alias("s"), F.col(color).cast("double").alias("c"))
    d = d.where("sector is not null and industry is not null and s is not null and c is not null")
    sets = [[], ["sector"], ["sector", "industry"], ["sector", "industry", "symbol"]]
    names = ["sector", "industry", "symbol"]
    g = d.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in names]).agg(
        F.sum("s").alias("size"), F.sum(F.col("s") * F.col("c")).alias("_sc"), F.avg("c").alias("_m"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "sector").when(F.col("_g") == 1, "industry").otherwise("stock")
    path = F.coalesce(F.nullif(F.concat_ws("/", *names), F.lit("")), F.lit("ALL"))
    mean = F.when(F.col("size") > 0, sdiv("_sc", "size")).otherwise(F.col("_m"))
    out = g.select(level.alias("level"), path.alias("path"), "size", mean.alias("color"))
    return out.withColumn("color_grad", bin_right_closed("color", edges))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean over positive weights; the plain mean when the weights do not add up."""
    v, w = F.col(value), F.col(weight)
    ok = v.isNotNull() & w.isNotNull() & (w > 0)
    total = F.sum(F.when(ok, w.cast("double")))
    return df.groupBy(*by).agg(F.when(total > 0, sdiv(F.sum(F.when(ok, v * w)), total)).otherwise(F.avg(v)).alias("weighted_mean"))


# Names of payout frequencies.
FREQUENCIES = ["Once per year", "Twice per year", "Thrice per year", "4 times per year"]


def payout_frequency(calendar: DataFrame, size: int = 1000) -> DataFrame:
    """Stocks per number of payment dates (capped at four), all four classes present.

    The sorted stock lists come in chunks, so no row grows with the market.
    """
    n = calendar.groupBy("symbol").agg(F.least(F.count_distinct("date"), F.lit(4)).alias("k"))
    label = F.element_at(F.array(*[F.lit(x) for x in FREQUENCIES]), F.col("k").cast("int"))
    d = cut_lineage(n.select("symbol", label.alias("frequency")))
    count = d.groupBy("frequency").agg(F.count("*").alias("count"))
    lists = chunked_list(d, ["frequency"], "symbol", "stocks", size)
    spine = count.sparkSession.createDataFrame([(x,) for x in FREQUENCIES], "frequency string")
    out = spine.join(count, "frequency", "left").join(lists, "frequency", "left")
    return out.select("frequency", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce(F.array_join("stocks", ", "), F.lit("")).alias("stocks"))


def breadth(returns: DataFrame, total: DataFrame) -> DataFrame:
    """Per session: gainers, losers, coverage, mean and exact median return."""
    r = cut_lineage(returns.where("return_1d_pct is not null").select("date", "return_1d_pct"))
    x = F.col("return_1d_pct")
    g = r.groupBy("date").agg(
        F.count("*").alias("reporting"), F.count_if(x > 0).alias("gainers"), F.count_if(x < 0).alias("losers"), F.count_if(x == 0).alias("flat"), F.avg(x).alias("avg_return"))
    med = distribution(r, "return_1d_pct", ["date"], {"median_return": 0.5}, moments=False).drop("n")
    j = g.join(med, "date").crossJoin(F.broadcast(total.agg(F.count("*").alias("_n"))))
    return j.select(
        "date", "reporting", F.greatest(F.col("_n") - F.col("reporting"), F.lit(0)).alias("unavailable"), (sdiv("reporting", "_n") * 100).alias("coverage_pct"),
        "gainers", "losers", "flat", "avg_return", "median_return", (sdiv("gainers", "reporting") * 100).alias("breadth_pct"))


def latest_usable_session(returns: DataFrame, day: str) -> DataFrame:
    """Newest date not after ``day`` on which at least one return exists."""
    ok = returns.where((F.col("date") <= F.lit(day).cast("date")) & F.col("return_1d_pct").isNotNull())
    last = ok.agg(F.max("date").alias("date"))
    return returns.join(F.broadcast(last), "date")


def top_movers(returns: DataFrame, n: int = 20) -> DataFrame:
    """The n largest strictly positive and n smallest strictly negative returns."""
    x = F.col("return_1d_pct")
    up = returns.where(x > 0).orderBy(F.desc(x), "symbol").limit(n).withColumn("side", F.lit("gainer"))
    down = returns.where(x < 0).orderBy(x, "symbol").limit(n).withColumn("side", F.lit("loser"))
    return up.unionByName(down)


def arg_extreme(df: DataFrame, by: list[str], value: Column | str, tie: str, take: list[str], largest: bool = True) -> DataFrame:
    """Row with the largest (smallest) value per group, the smaller key on a tie."""
    v = F.col(value) if isinstance(value, str) else value
    d = df.where(v.isNotNull())
    best = F.min(F.struct((-v if largest else v).alias("_v"), F.col(tie).alias("_t"), *[F.col(c) for c in take if c != tie]))
    g = d.groupBy(*by).agg(best.alias("_b"))
    return g.select(*by, *[(F.col("_b._t") if c == tie else F.col(f"_b.{c}")).alias(c) for c in take], (-F.col("_b._v") if largest else F.col("_b._v")).alias("value"))
