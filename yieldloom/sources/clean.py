"""Cleaning rules applied before any analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, require_columns, sdiv


def _number(c: str):
    return finite(F.col(c).try_cast("double"))


def _day(c: str):
    return F.col(c).try_cast("date")


def clean_prices(raw: DataFrame, seq: str) -> DataFrame:
    """Parse, keep positive finite closes, last row wins per (symbol, date).

    ``max_by`` combines before the shuffle, so many copies of one key stay cheap.
    """
    require_columns(raw, "symbol", "date", "close")
    d = raw.select("symbol", _day("date").alias("date"), _number("close").alias("close"), seq)
    d = d.where("date is not null and close > 0")
    return d.groupBy("symbol", "date").agg(F.max_by("close", seq).alias("close"))


def clean_dividends(raw: DataFrame) -> DataFrame:
    require_columns(raw, "symbol", "date", "adjDividend")
    d = raw.select("symbol", _day("date").alias("date"), _number("adjDividend").alias("adjDividend"))
    return d.where("date is not null and adjDividend >= 0")


def clean_financials(raw: DataFrame) -> DataFrame:
    require_columns(raw, "symbol", "date", "revenue", "netIncome", "reportedCurrency")
    d = raw.select("symbol", _day("date").alias("date"), _number("revenue").alias("revenue"), _number("netIncome").alias("netIncome"), "reportedCurrency")
    return d.where("date is not null and revenue is not null and netIncome is not null")


def clean_universe(profiles: DataFrame, seq: str | None = None) -> DataFrame:
    """Active ordinary stocks with a price and a size; the first profile per symbol wins."""
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = profiles
    if seq is not None:
        cols = [c for c in p.columns if c not in ("symbol", seq)]
        p = p.groupBy("symbol").agg(F.min_by(F.struct(*cols), seq).alias("_p")).select("symbol", "_p.*")
    return p.where(off("isActivelyTrading") & ~off("isEtf") & ~off("isFund") & (F.col("mktCap") > 0) & (F.col("price") > 0))


def parse_quotes(raw: DataFrame) -> DataFrame:
    """Close, previous close and percent change from whichever fields a quote carries."""
    q = raw.select("symbol", _number("price").alias("close"), F.col("changes").alias("_c"), F.col("changesPercentage").alias("_p"), _number("changes").alias("chg"), _number("changesPercentage").alias("pct"))
    prev = F.when(F.col("_c").isNotNull(), F.col("close") - F.col("chg")).otherwise(sdiv("close", 1 + F.col("pct") / 100))
    q = q.withColumn("prev_close", prev)
    ret = F.when(F.col("_p").isNotNull(), F.col("pct")).otherwise((sdiv("close", "prev_close") - 1) * 100)
    q = q.withColumn("return_1d_pct", ret)
    return q.where("symbol is not null and close is not null and prev_close is not null and return_1d_pct is not null").select("symbol", "close", "prev_close", "return_1d_pct")


def adapt_history(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Column names of the adjusted history; a missing adjusted close is the close, a missing dividend 0."""
    d = raw.where(F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return d.select(
        "symbol", F.col("Date").alias("date"), F.col("Close").alias("close"),
        F.coalesce(F.col("Adj Close"), F.col("Close")).alias("adjClose"), F.coalesce(F.col("Dividends"), F.lit(0.0)).alias("dividend"),
    )
