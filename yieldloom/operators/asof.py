"""As-of joins without cross products: one union and one ordered window per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    take: dict[str, str],
    on: str = "date",
    direction: str = "backward",
    strict: bool = False,
) -> DataFrame:
    """For each left row the nearest right row at or before (after) its date.

    ``take`` maps right columns to output names. The matched row travels as a
    struct, so a NULL inside the matched row is kept, not skipped. Without
    ``by`` both sides have to be calendar-sized series (a row per date).
    """
    back = direction == "backward"
    # inclusive: the right row sorts on the near side of an equal date
    right_rank = (0 if back else 2) if not strict else (2 if back else 0)
    pack = F.struct(*[F.col(s).alias(o) for s, o in take.items()])
    r = right.select(*by, on, pack.alias("_r"), F.lit(right_rank).alias("_k"))
    u = left.withColumn("_k", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    # forward is backward in the reversed order: a frame that ends at the row is a running value, one that starts there is not
    w = w.orderBy(on, "_k") if back else w.orderBy(F.col(on).desc(), F.col("_k").desc())
    m = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return u.withColumn("_m", m).where("_k = 1").select(*left.columns, *[F.col(f"_m.{o}").alias(o) for o in take.values()])


def by_day(by: list[str], on: str = "date"):
    """Window over one key in the order of calendar days, as numbers. Columns over it share a sort if one ``select`` makes them."""
    return Window.partitionBy(*by).orderBy(F.datediff(F.col(on), F.lit("1970-01-01")))


def value_days_ago(value: str, days: int, by: list[str], on: str = "date") -> Column:
    """Latest value at or before ``on`` minus ``days`` calendar days.

    A range frame does this in the same sort as every other window of ``by_day``.
    """
    return F.last(value).over(by_day(by, on).rangeBetween(Window.unboundedPreceding, -days))


def align_series(dates: DataFrame, series: DataFrame, take: dict[str, str]) -> DataFrame:
    """Forward-fill one market-wide series onto another calendar.

    The as-of runs over distinct dates only and is joined back on the date, so
    the single-partition window sees at most one row per calendar day.
    """
    calendar = dates.select("date").distinct()
    filled = asof_join(calendar, series, [], take)
    return dates.join(F.broadcast(filled), "date", "left")  # a row per calendar day


def month_key(c: Column | str) -> Column:
    return F.year(c) * 12 + F.month(c)


def event_window_join(
    events: DataFrame, prices: DataFrame, before: int, after: int, key: str = "symbol", ex: str = "ex_date"
) -> DataFrame:
    """Prices within [ex - before, ex + after] days of each event.

    The range is cut into calendar months, which makes it an equi-join on
    (symbol, month): no quadratic compare per symbol, and a hot symbol spreads
    over many keys.
    """
    lo, hi = F.date_sub(ex, before), F.date_add(ex, after)
    ev = events.withColumn("_m", F.explode(F.sequence(month_key(lo), month_key(hi))))
    px = prices.withColumn("_m", month_key("date"))
    return ev.join(px, [key, "_m"]).where(F.col("date").between(lo, hi)).drop("_m")
