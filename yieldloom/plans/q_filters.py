"""Filter and top-k queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import fundamentals as U
from ..operators import ratings as J
from ..operators import returns as R
from ..operators import screens as X
from ..sources.readers import parse_logs
from .oracle import shared
from .q_dividends import scores
from .q_fundamentals import rounded, scan_scores, shortlist_base
from .q_ratings import mval, mval_sql, trading, values
from .registry import query

SCREEN_WHERE = "pe_current>0 AND pe_current<=40 AND ps_current>0 AND revenue_growth_5y>=-5 AND earnings_growth_5y>=-20 AND earnings_ttm>0 AND revenue_ttm>0"


@query("B01_screen", f"SELECT symbol, row_number() OVER (ORDER BY score DESC, symbol) AS Rank, R4{{score}} AS score FROM scanscore WHERE {SCREEN_WHERE}")
def _(m):
    return X.screen(scan_scores(m), 40, -5, -20).select("symbol", "Rank", rnd("score", 4).alias("score"))


@query("B01_screen_strict", f"SELECT symbol, row_number() OVER (ORDER BY score DESC, symbol) AS Rank, R4{{score}} AS score FROM scanscore WHERE {SCREEN_WHERE} AND revenue_growth_ttm>0 AND earnings_growth_ttm>0 AND pe_discount>0 AND ps_discount>0")
def _(m):
    return X.screen(scan_scores(m), 40, -5, -20, True, True).select("symbol", "Rank", rnd("score", 4).alias("score"))


@query("B02_shortlist", "SELECT symbol, mktCap, R4{current_pe} AS current_pe, R4{avg_pe} AS avg_pe, R6{volatility} AS volatility, observations FROM elig")
def _(m):
    d = shortlist_base(m).where("mktCap >= 1e12 and current_pe between 5 and 50 and avg_pe > 0 and avg_pe < 100").join(J.daily_volatility(m.closes), "symbol")
    return d.where("observations >= 30 and volatility >= 1").select("symbol", "mktCap", rnd("current_pe", 4).alias("current_pe"), rnd("avg_pe", 4).alias("avg_pe"), rnd("volatility").alias("volatility"), "observations")


@query("B03_universe_filter", "SELECT symbol, sector, R6{mktCap/1000000000} AS mktCap_B FROM profiles WHERE mktCap/1000000000>=5000 AND sector='ASIA' AND symbol IN (SELECT kode FROM compliant)")
def _(m):
    ok = m.compliant.select(F.col("Kode").alias("symbol"))
    return X.universe_filter(m.profiles, 5000, "ASIA", ok).select("symbol", "sector", rnd("mktCap_B").alias("mktCap_B"))


@query("B04_twin_listing", """
SELECT symbol, sk FROM companies f WHERE NOT (sk%5=1 AND EXISTS (SELECT 1 FROM companies k WHERE k.sk=f.sk-1))""")
def _(m):
    f = m.companies.select("symbol", "sk")
    twins = m.companies.where("sk % 5 = 1").select(F.format_string("S%06d", F.col("sk") - 1).alias("keep"), F.col("symbol").alias("drop"))
    twins = twins.unionByName(m.companies.where("sk % 5 = 3").select(F.concat("symbol", F.lit("-X")).alias("keep"), F.col("symbol").alias("drop")))  # their twin is not listed
    return X.drop_twins(f, twins)


@query("B05_metric_validity", f"SELECT symbol, metric, direction, {mval_sql()} AS value FROM mvals")
def _(m):
    return values(m).select("symbol", "metric", "direction", mval().alias("value"))


@query("B06_quantile_clip", """
q AS (SELECT quantile_cont(peRatio,0.05) AS a, quantile_cont(peRatio,0.95) AS b, count(peRatio) AS n FROM scores), k AS (SELECT symbol, peRatio, n FROM scores, q WHERE peRatio BETWEEN a AND b)
SELECT symbol, R5{peRatio} AS peRatio, n-count(*) OVER () AS excluded FROM k""")
def _(m):
    return X.clip_quantiles(scores(m).select("symbol", "peRatio"), "peRatio", 0.05, 0.95).select("symbol", rnd("peRatio", 5).alias("peRatio"), "excluded")


@query("B07_unit_scaling", "SELECT symbol, R6{mktCap/1000000000} AS mktCap_B, R6{mktCap/1000000000000} AS mktCap_T, R4{earningTTM/1000000000000} AS earning_T, R4{revenueTTM/1000000000000} AS revenue_T, R6{return_1y*100} AS return_1y_pct, R6{total_return_1y*100} AS total_return_1y_pct FROM scores")
def _(m):
    t = 1_000_000_000_000
    d = scores(m).select(
        "symbol", (F.col("mktCap") / 1_000_000_000).alias("mktCap_B"), (F.col("mktCap") / t).alias("mktCap_T"), (F.col("earningTTM") / t).alias("earning_T"), (F.col("revenueTTM") / t).alias("revenue_T"),
        (F.col("return_1y") * 100).alias("return_1y_pct"), (F.col("total_return_1y") * 100).alias("total_return_1y_pct"))
    return rounded(d, ["symbol"], 6, earning_T=4, revenue_T=4)


@query("B08_range_slice", """
r AS (SELECT * FROM (VALUES ('3M',90),('6M',180),('1Y',365),('3Y',1095),('All',NULL)) r(range, days))
SELECT p.symbol, range, count(*) AS sessions, min(date) AS first, R8{avg(close)} AS avg_close FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM prices) p, r WHERE days IS NULL OR date >= last-days GROUP BY p.symbol, range""")
def _(m):
    p = m.closes.withColumn("last", F.max("date").over(Window.partitionBy("symbol")))
    ranges = {"3M": 90, "6M": 180, "1Y": 365, "3Y": 1095, "All": None}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("range"), F.lit(v).cast("int").alias("days")) for k, v in ranges.items()]))
    d = p.select("*", cells.alias("c")).where("c.days is null or date >= date_sub(last, c.days)")
    return d.groupBy("symbol", "c.range").agg(F.count("*").alias("sessions"), F.min("date").alias("first"), rnd(F.avg("close"), 8).alias("avg_close"))


shared("sess", """
SELECT t.symbol, t.date, t.close, p.close AS prev_close, (t.close/nullif(p.close,0)-1)*100 AS return_1d_pct FROM prices t JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT DISTINCT date FROM prices)) c ON c.date=t.date LEFT JOIN prices p ON p.symbol=t.symbol AND p.date=c.pd""")


@query("B09_latest_usable_session", "SELECT symbol, date, close, R6{return_1d_pct} AS return_1d_pct FROM sess WHERE date=(SELECT max(date) FROM sess WHERE return_1d_pct IS NOT NULL AND date<=DATE '2001-11-04')")
def _(m):
    return X.latest_usable_session(R.session_returns_all(m.closes), "2001-11-04").select("symbol", "date", "close", rnd("return_1d_pct").alias("return_1d_pct"))


@query("B10_wide_to_long", "SELECT symbol, date, 'revenue_ttm' AS series, rt AS value FROM ttm UNION ALL SELECT symbol, date, 'netIncome_ttm', nt FROM ttm")
def _(m):
    return U.trailing(m.financials).unpivot(["symbol", "date"], ["revenue_ttm", "netIncome_ttm"], "series", "value")


@query("G01_top_movers", """
s AS (SELECT symbol, return_1d_pct AS r FROM sess WHERE date=DATE '2001-06-15')
SELECT symbol, R6{r} AS return_1d_pct, 'gainer' AS side FROM (SELECT * FROM s WHERE r>0 ORDER BY r DESC, symbol LIMIT 20) UNION ALL SELECT symbol, R6{r}, 'loser' FROM (SELECT * FROM s WHERE r<0 ORDER BY r, symbol LIMIT 20)""")
def _(m):
    return X.top_movers(R.session_return(m.closes, "2001-06-15")).select("symbol", rnd("return_1d_pct").alias("return_1d_pct"), "side")


@query("G02_pinned_top", """
SELECT symbol, CAST(substr(symbol,2) AS BIGINT)%12=1 AS pinned, R6{trading_rank} AS trading_rank FROM trank ORDER BY CAST(substr(symbol,2) AS BIGINT)%12=1 DESC, trading_rank DESC, volatility DESC, Discount DESC, symbol LIMIT 20""")
def _(m):
    pins = m.companies.where("sk % 12 = 1").select("symbol")
    return J.pinned_top(trading(m), pins, 20).select("symbol", "pinned", rnd("trading_rank").alias("trading_rank"))


@query("G03_largest", "SELECT symbol, mktCap FROM universe ORDER BY mktCap DESC, symbol LIMIT 25")
def _(m):
    from ..sources.clean import clean_universe

    return clean_universe(m.profiles).orderBy(F.desc("mktCap"), "symbol").limit(25).select("symbol", "mktCap")


@query("G04_most_common", "SELECT stock, count(*) AS searches FROM parsed WHERE kind='download' GROUP BY stock ORDER BY count(*) DESC, stock LIMIT 10")
def _(m):
    return parse_logs(m.logs).where("kind = 'download'").groupBy("stock").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "stock").limit(10)


