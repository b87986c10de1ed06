"""Column helpers that fix the null policy: missing is NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOT_SIZE = 100


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a: Column | str, b: Column | str) -> Column:
    """Division that gives NULL on a zero or missing divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(a: Column | str, b: Column | str) -> Column:
    """Fractional change from ``b`` to ``a``."""
    return sdiv(a, b) - 1


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)


def exact_sum(c: Column | str, digits: int = 18) -> Column:
    """Sum of doubles as a fixed-point number: the same bits in whatever order the rows come."""
    return F.sum(col(c).cast(f"decimal(38,{digits})")).cast("double")


def exact_avg(c: Column | str, digits: int = 18) -> Column:
    """Mean of doubles, independent of the order of rows."""
    return exact_sum(c, digits) / F.count(col(c))


def finite(c: Column | str) -> Column:
    """NULL for NaN and both infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps NULL (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return F.when(c.isNotNull(), out)


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns, skipping NULLs; NULL when all are missing."""
    cs = [col(c).cast("double") for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.try_divide(total, n.cast("double"))


def is_close(a: Column | str, b: Column | str) -> Column:
    """|a-b| within 1e-8 + 1e-5*|b|, the usual float tolerance."""
    return F.abs(col(a) - col(b)) <= (F.lit(1e-8) + F.lit(1e-5) * F.abs(col(b)))


def bin_right_closed(c: Column | str, edges: list[float]) -> Column:
    """Position of a value among right-closed bins, scaled to 0..100."""
    c = col(c)
    step = 100.0 / len(edges)
    out = F.when(c <= edges[0], F.lit(0.0))
    for i, e in enumerate(edges[1:], start=1):
        out = out.when(c <= e, F.lit(i * step))
    return F.when(c.isNotNull(), out.otherwise(F.lit(100.0)))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}.")
    return df


def by_date(*keys: str) -> "Window":
    return Window.partitionBy(*keys).orderBy("date")
