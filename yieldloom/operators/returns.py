"""Returns, rolling statistics and alignment of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import avg_pct_rank
from ..functions.scalars import change, sdiv
from .asof import asof_join, by_day, value_days_ago

def by_symbol():
    """Window over one symbol in date order."""
    return Window.partitionBy("symbol").orderBy("date")

# Sessions per horizon of the stored returns view, and calendar days per horizon.
SESSION_LAGS = {"return_7d": 5, "return_1m": 21, "return_1y": 252, "return_10y": 2520}
DAY_LAGS = {"return_7d": 7, "return_1m": 30, "return_1y": 365, "return_10y": 3650}


def latest_returns(prices: DataFrame) -> DataFrame:
    """Return over fixed numbers of sessions, on each symbol's last session."""
    cols = [change("close", F.lag("close", n).over(by_symbol())).alias(k) for k, n in SESSION_LAGS.items()]
    newest = F.lead("date").over(by_symbol()).isNull()  # same window, no second sort
    return prices.select("symbol", *cols, newest.alias("_newest")).where("_newest").drop("_newest")


def calendar_returns(prices: DataFrame) -> DataFrame:
    """Return against the last close at least N calendar days ago, for every row."""
    cols = [change("close", value_days_ago("close", n, ["symbol"])).alias(k) for k, n in DAY_LAGS.items()]
    return prices.select("symbol", "date", "close", *cols)


def session_return(prices: DataFrame, day: str) -> DataFrame:
    """One-day return on ``day`` against the market-wide previous session.

    A symbol without a row on that previous session has no return.
    """
    d = F.lit(day).cast("date")
    prev_day = prices.where(F.col("date") < d).agg(F.max("date").alias("date"))
    prev = prices.join(F.broadcast(prev_day), "date").select("symbol", F.col("close").alias("prev_close"))
    today = prices.where(F.col("date") == d).select("symbol", "close")
    return today.join(prev, "symbol", "left").withColumn("return_1d_pct", change("close", "prev_close") * 100)


def session_returns_all(prices: DataFrame) -> DataFrame:
    """The same for every date: prices joined to the previous market session."""
    cal = prices.select("date").distinct()  # a row per calendar day
    cal = cal.select("date", F.lag("date").over(Window.orderBy("date")).alias("prev_date"))
    prev = prices.select("symbol", F.col("date").alias("prev_date"), F.col("close").alias("prev_close"))
    return (
        prices.join(cal, "date")
        .join(prev, ["symbol", "prev_date"], "left")
        .select("symbol", "date", "close", "prev_close", (change("close", "prev_close") * 100).alias("return_1d_pct"))
    )


def price_changes(prices: DataFrame, value: str = "close") -> DataFrame:
    """Absolute and percent change against the previous row and 7/30/365 days ago."""
    ago = {f"previous_price_{days}d": value_days_ago(value, days, ["symbol"]) for days in (7, 30, 365)}
    # one order and one select: one sort
    out = prices.select("symbol", "date", value, F.lag(value).over(by_day(["symbol"])).alias("previous_price"), *[c.alias(n) for n, c in ago.items()])
    cols = []
    for name, prev in (("", "previous_price"), ("weekly_", "previous_price_7d"), ("monthly_", "previous_price_30d"), ("yearly_", "previous_price_365d")):
        diff = F.col(value) - F.col(prev)
        cols.append(diff.alias(f"{name}price_change"))
        cols.append(F.when(F.col(prev) == 0, 0.0).otherwise(sdiv(diff, prev) * 100).alias(f"{name}price_change_pct"))
    return out.select("symbol", "date", F.col(value).alias("current_price"), "previous_price", *ago, *cols)


def pct_change(value: Column | str, n: int, w=None) -> Column:
    return change(value, F.lag(value, n).over(w or by_symbol()))


def rolling(fn, value: str, n: int, w=None, min_periods: int | None = None) -> Column:
    """A rolling aggregate that stays NULL until enough values are present."""
    frame = (w or by_symbol()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= (n if min_periods is None else min_periods), fn(value).over(frame))


def rolling_quantile(value: str, n: int, p: float, w=None) -> Column:
    return rolling(lambda v: F.percentile(v, F.lit(p)), value, n, w)


def any_before(flag: Column | str, k: int, w=None) -> Column:
    """True when the flag held in any of the k previous sessions."""
    frame = (w or by_symbol()).rowsBetween(-k, -1)
    return F.coalesce(F.max(flag).over(frame), F.lit(False))


def ewm_adjusted(value: str, com: float, w: Window) -> Column:
    """Adjusted exponential mean over an ordered, year-sized series.

    Weights only matter up to a common factor, so r**position with r =
    (1+com)/com replaces the pairwise decay; NULLs are skipped but counted.
    """
    r = (1 + com) / com
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(r), F.row_number().over(w).cast("double"))
    num = F.sum(F.col(value) * F.col("_wt")).over(upto)
    den = F.sum(F.when(F.col(value).isNotNull(), F.col("_wt"))).over(upto)
    return weight, F.try_divide(num, den)


def momentum_percentile(prices: DataFrame, n: int) -> DataFrame:
    """Per date, the percent rank of each symbol's return over n market sessions."""
    return momentum_percentiles(prices, [n]).drop("sessions")


def momentum_percentiles(prices: DataFrame, sessions: list[int]) -> DataFrame:
    """``momentum_percentile`` for several numbers of sessions, one row for each.

    Sessions are counted on the market calendar: positions come from the small
    table of dates, the earlier close from a frame of that one position in the
    symbol's history, so the dense (date x symbol) grid is never built. All
    numbers share one sort by symbol and one range sort.
    """
    cal = prices.select("date").distinct()
    cal = cal.select("date", F.row_number().over(Window.orderBy("date")).alias("_i"))  # a row per calendar day
    px = prices.join(F.broadcast(cal), "date").where("symbol is not null")
    w = Window.partitionBy("symbol").orderBy("_i")
    past = [F.collect_list("close").over(w.rangeBetween(-n, -n)).alias(f"_p{n}") for n in sessions]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("sessions"), F.col(f"_p{n}").alias("past")) for n in sessions]))
    r = px.select("symbol", "date", "close", *past).select("symbol", "date", "close", each.alias("_e"))
    r = r.select("symbol", "date", "close", "_e.sessions", F.explode("_e.past").alias("_past")).select("symbol", "date", "sessions", change("close", "_past").alias("ret"))
    ranked = avg_pct_rank(r.where("ret is not null"), "ret", "_p", by=["sessions", "date"])
    return ranked.select("symbol", "date", "sessions", "ret", (F.col("_p") * 100).alias("percentile"))


def daily_fill(prices: DataFrame) -> DataFrame:
    """Calendar-day series per symbol, forward filled between sessions."""
    span = prices.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("date"))
    return asof_join(days, prices, ["symbol"], {"close": "close"})


def rebase_on_shared_date(prices: DataFrame, group: str) -> DataFrame:
    """All series rebased to 100 on the earliest date every one of them has."""
    ok = prices.where("close is not null and close <> 0")
    total = ok.agg(F.count_distinct(group).alias("_n"))
    per_day = ok.groupBy("date").agg(F.count_distinct(group).alias("_k"))
    start = per_day.join(F.broadcast(total), F.col("_k") == F.col("_n")).agg(F.min("date").alias("_start"))
    base = ok.join(F.broadcast(start), F.col("date") == F.col("_start")).select(group, F.col("close").alias("_base"), "_start")
    return ok.join(base, group).where(F.col("date") >= F.col("_start")).select(group, "date", "close", (sdiv("close", "_base") * 100).alias("normalized"))


def regime_series(index: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Bull / bear label per date of one index (fast above slow average).

    Empty when the index has fewer than slow + 5 rows. One row per calendar day.
    """
    w = Window.orderBy("date")
    n = F.count("*").over(Window.partitionBy())
    labelled = index.select(
        "date", "close", n.alias("_n"),
        rolling(F.avg, "close", fast, w).alias("sma_fast"), rolling(F.avg, "close", slow, w).alias("sma_slow"),
    ).where(F.col("_n") >= slow + 5)
    return labelled.select("date", "sma_fast", "sma_slow", F.when(F.col("sma_fast") > F.col("sma_slow"), "bull").otherwise("bear").alias("regime"))


def regime_changes(regime: DataFrame) -> DataFrame:
    prev = F.lag("regime").over(Window.orderBy("date"))
    return regime.withColumn("_prev", prev).where("_prev is null or _prev <> regime").select("date", "regime")


def period_and_day_return(prices: DataFrame, group: str, start: str, end: str, home: str) -> DataFrame:
    """First-to-last return of a period and the last day's return per series, home series first."""
    p = prices.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    agg = p.groupBy(group).agg(F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_b"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("date")
    day = prices.withColumn("_prev", F.lag("close").over(w)).where(F.col("date") == F.lit(end).cast("date"))
    day = day.select(group, (change("close", "_prev") * 100).alias("return_1d"))
    out = agg.where("_n >= 2").select(group, (change("_b", "_a") * 100).alias("period_return")).join(day, group, "left")
    order = Window.orderBy((F.col(group) != home).cast("int"), F.desc("period_return"), group)  # a row per index
    return out.withColumn("position", F.row_number().over(order))


def price_levels(prices: DataFrame) -> DataFrame:
    """All-time and 52-week extremes, drawdown and moving averages on the last session."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ma = [rolling(F.avg, "close", n, by_symbol(), max(1, n // 2)).alias(f"ma{n}") for n in (20, 50, 200)]
    p = prices.select("symbol", "date", "close", "high", "low", F.max("date").over(Window.partitionBy("symbol")).alias("_last"), *ma)
    recent = F.col("date") >= F.date_sub("_last", 364)
    g = p.groupBy("symbol").agg(
        F.max_by("close", "date").alias("current_price"), F.max("high").alias("ath"), F.min("low").alias("atl"),
        F.max(F.when(recent, F.col("high"))).alias("high_52w"), F.min(F.when(recent, F.col("low"))).alias("low_52w"),
        *[F.max_by(f"ma{n}", "date").alias(f"ma{n}") for n in (20, 50, 200)],
    )
    return g.withColumn("drawdown_ath", change("current_price", "ath") * 100)


def tail(prices: DataFrame, n: int) -> DataFrame:
    """The last n rows per symbol."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return prices.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
