"""Window and series queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranking import avg_pct_rank, group_row_number, group_running_totals
from ..functions.scalars import rnd, sdiv
from ..functions.sequential import with_smoothed
from ..operators import returns as R
from ..operators.dividends import calendar, yearly_dividends
from .registry import query



def horizons():
    return [rnd(c).alias(c) for c in R.SESSION_LAGS]


@query("E01_latest_returns", """
SELECT symbol, R6{return_7d} AS return_7d, R6{return_1m} AS return_1m, R6{return_1y} AS return_1y, R6{return_10y} AS return_10y
FROM (SELECT symbol, close/lag(close,5) OVER w - 1 AS return_7d, close/lag(close,21) OVER w - 1 AS return_1m,
             close/lag(close,252) OVER w - 1 AS return_1y, close/lag(close,2520) OVER w - 1 AS return_10y,
             row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn
      FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE rn = 1""")
def _(m):
    return R.latest_returns(m.prices).select("symbol", *horizons())


@query("E02_calendar_returns", """
s AS (SELECT a.symbol, a.date, a.close, p7.close AS c7, p30.close AS c30, p365.close AS c365, p3650.close AS c3650
FROM prices a
ASOF LEFT JOIN prices p7 ON a.symbol=p7.symbol AND p7.date <= a.date - 7
ASOF LEFT JOIN prices p30 ON a.symbol=p30.symbol AND p30.date <= a.date - 30
ASOF LEFT JOIN prices p365 ON a.symbol=p365.symbol AND p365.date <= a.date - 365
ASOF LEFT JOIN prices p3650 ON a.symbol=p3650.symbol AND p3650.date <= a.date - 3650)
SELECT symbol, date, close, R6{close/c7-1} AS return_7d, R6{close/c30-1} AS return_1m, R6{close/c365-1} AS return_1y, R6{close/c3650-1} AS return_10y FROM s""")
def _(m):
    return R.calendar_returns(m.prices).select("symbol", "date", "close", *horizons())


@query("E03_session_return", """
SELECT t.symbol, t.close, p.close AS prev_close, R6{(t.close/nullif(p.close,0)-1)*100} AS return_1d_pct
FROM prices t LEFT JOIN prices p ON p.symbol=t.symbol AND p.date=(SELECT max(date) FROM prices WHERE date < DATE '2001-06-15')
WHERE t.date = DATE '2001-06-15'""")
def _(m):
    return R.session_return(m.closes, "2001-06-15").withColumn("return_1d_pct", rnd("return_1d_pct"))


@query("E04_price_changes", """
s AS (SELECT a.symbol, a.date, a.close AS c, lag(a.close) OVER (PARTITION BY a.symbol ORDER BY a.date) AS p1, p7.close AS p7, p30.close AS p30, p365.close AS p365
FROM prices a
ASOF LEFT JOIN prices p7 ON a.symbol=p7.symbol AND p7.date <= a.date - 7
ASOF LEFT JOIN prices p30 ON a.symbol=p30.symbol AND p30.date <= a.date - 30
ASOF LEFT JOIN prices p365 ON a.symbol=p365.symbol AND p365.date <= a.date - 365)
SELECT symbol, date, c AS current_price, p1 AS previous_price, p7 AS previous_price_7d, p30 AS previous_price_30d, p365 AS previous_price_365d,
 R4{c-p1} AS price_change, R6{CASE WHEN p1=0 THEN 0 ELSE (c-p1)/p1*100 END} AS price_change_pct,
 R4{c-p7} AS weekly_price_change, R6{CASE WHEN p7=0 THEN 0 ELSE (c-p7)/p7*100 END} AS weekly_price_change_pct,
 R4{c-p30} AS monthly_price_change, R6{CASE WHEN p30=0 THEN 0 ELSE (c-p30)/p30*100 END} AS monthly_price_change_pct,
 R4{c-p365} AS yearly_price_change, R6{CASE WHEN p365=0 THEN 0 ELSE (c-p365)/p365*100 END} AS yearly_price_change_pct FROM s""")
def _(m):
    d = R.price_changes(m.closes)
    return d.select(*[rnd(c, 6).alias(c) if c.endswith("pct") else rnd(c, 4).alias(c) if c.endswith("change") else F.col(c) for c in d.columns])


@query("E05_pct_change", """
SELECT symbol, date, R6{close/nullif(lag(close) OVER w,0)-1} AS ret_1, R6{close/nullif(lag(close,20) OVER w,0)-1} AS ret_20
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(m):
    return m.closes.select("symbol", "date", rnd(R.pct_change("close", 1)).alias("ret_1"), rnd(R.pct_change("close", 20)).alias("ret_20"))


@query("E06_ttm_sums", """
SELECT symbol, date, CASE WHEN count(revenue) OVER w = 4 THEN sum(revenue) OVER w END AS revenue_ttm,
 CASE WHEN count(netIncome) OVER w = 4 THEN sum(netIncome) OVER w END AS net_income_ttm
FROM financials WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(m):
    return m.financials.select("symbol", "date", R.rolling(F.sum, "revenue", 4).alias("revenue_ttm"), R.rolling(F.sum, "netIncome", 4).alias("net_income_ttm"))


@query("E07_rolling_stats", """
SELECT symbol, date, R5{CASE WHEN count(*) OVER w=20 THEN avg(close) OVER w END} AS mean_20, R3{CASE WHEN count(*) OVER w=20 THEN stddev_samp(close) OVER w END} AS std_20,
 CASE WHEN count(*) OVER w=20 THEN min(close) OVER w END AS min_20, CASE WHEN count(*) OVER w=20 THEN max(close) OVER w END AS max_20
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(m):
    return m.closes.select(
        "symbol", "date", rnd(R.rolling(F.avg, "close", 20), 5).alias("mean_20"), rnd(R.rolling(F.stddev_samp, "close", 20), 3).alias("std_20"),
        R.rolling(F.min, "close", 20).alias("min_20"), R.rolling(F.max, "close", 20).alias("max_20"),
    )


@query("E08_rolling_quantile", """
SELECT symbol, date, R5{CASE WHEN count(*) OVER w=60 THEN quantile_cont(close, 0.2) OVER w END} AS q20_60
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def _(m):
    return m.closes.select("symbol", "date", rnd(R.rolling_quantile("close", 60, 0.2), 5).alias("q20_60"))


@query("E09_any_before", """
f AS (SELECT symbol, date, close < lag(close) OVER (PARTITION BY symbol ORDER BY date) * 0.95 AS dip FROM prices)
SELECT symbol, date, coalesce(max(dip) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS dip_before FROM f""")
def _(m):
    f = m.closes.select("symbol", "date", (F.col("close") < F.lag("close").over(R.by_symbol()) * 0.95).alias("dip"))
    return f.select("symbol", "date", R.any_before("dip", 5).alias("dip_before"))


EWM_SQL = """
x AS (SELECT symbol, date, close, row_number() OVER w AS t, close-lag(close) OVER w AS mv FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, t-1 AS k, greatest(mv,0) AS up, greatest(-mv,0) AS dn FROM x),
e AS (SELECT symbol, date, t, k,
 pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*up*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS u14,
 pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*dn*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS d14,
 pow(19/21.0,t)*sum(CASE WHEN t=1 THEN 1 ELSE 2/21.0 END*close*pow(19/21.0,-t)) OVER w AS ema20
 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


@query("E10_exponential_means", EWM_SQL + """
SELECT symbol, date, R4{CASE WHEN t>=20 THEN ema20 END} AS ema_20,
 R4{CASE WHEN k>=14 THEN CASE WHEN d14>0 THEN 100-100/(1+u14/d14) WHEN u14>0 THEN 100 END END} AS rsi_14 FROM e""")
def _(m):
    return with_smoothed(m.closes, "close", rsi=(14,), ema=(20,)).select("symbol", "date", rnd("ema_20", 4).alias("ema_20"), rnd("rsi_14", 4).alias("rsi_14"))


@query("E11_adjusted_ewm", """
yq AS (SELECT symbol, year(date) AS y, sum(adjDividend) AS v FROM dividends GROUP BY ALL),
i AS (SELECT symbol, y, v - lag(v) OVER (PARTITION BY symbol ORDER BY y) AS inc, row_number() OVER (PARTITION BY symbol ORDER BY y) AS t FROM yq),
p AS (SELECT a.symbol, a.y, sum(b.inc*pow(1/3.0, a.t-b.t))/sum(pow(1/3.0, a.t-b.t)) AS ew
 FROM i a JOIN i b ON a.symbol=b.symbol AND b.t<=a.t AND b.inc IS NOT NULL GROUP BY ALL)
SELECT i.symbol, i.y AS year, R6{inc} AS inc, R6{ew} AS ewm FROM i LEFT JOIN p ON i.symbol=p.symbol AND i.y=p.y""")
def _(m):
    w = Window.partitionBy("symbol").orderBy("year")
    y = m.dividends.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("adjDividend").alias("v"))
    i = y.select("symbol", "year", (F.col("v") - F.lag("v").over(w)).alias("inc"))
    weight, mean = R.ewm_adjusted("inc", 0.5, w)
    return i.withColumn("_wt", weight).select("symbol", "year", rnd("inc").alias("inc"), rnd(mean).alias("ewm"))


@query("E12_percent_rank_ties", """
v AS (SELECT symbol, CASE WHEN lastDiv>0 THEN floor(lastDiv/10) END AS v FROM profiles)
SELECT symbol, v, R6{CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY v)-1)/2.0)/count(v) OVER () END} AS pct FROM v""")
def _(m):
    d = m.profiles.select("symbol", F.when(F.col("lastDiv") > 0, F.floor(F.col("lastDiv") / 10)).cast("double").alias("v"))
    return avg_pct_rank(d, "v", "pct").select("symbol", "v", rnd("pct").alias("pct"))


@query("E13_momentum_percentile", """
c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM prices)),
x AS (SELECT symbol, p.date, close, i FROM prices p JOIN c ON p.date=c.date),
r AS (SELECT a.symbol, a.date, a.close/b.close-1 AS ret FROM x a JOIN x b ON a.symbol=b.symbol AND b.i=a.i-20)
SELECT symbol, date, R6{ret} AS ret, R6{(rank() OVER (PARTITION BY date ORDER BY ret)+(count(*) OVER (PARTITION BY date, ret)-1)/2.0)/count(*) OVER (PARTITION BY date)*100} AS percentile FROM r""")
def _(m):
    return R.momentum_percentile(m.closes, 20).select("symbol", "date", rnd("ret").alias("ret"), rnd("percentile").alias("percentile"))


@query("E14_running_sums", """
SELECT holder, l_orderkey, l_linenumber, sum(qty) OVER w AS cum_lots, sum(qty*(100+disc)*level*1000) OVER w AS cum_cost,
 sum(qty) OVER w * (100+disc)*level*1000 AS market_value
FROM trades WINDOW w AS (PARTITION BY holder ORDER BY date, l_orderkey, l_linenumber, sk, qty, cents, disc, tax)""")
def _(m):
    unit = (100 + F.col("disc")) * F.col("level") * 1000
    order = ["date", "l_orderkey", "l_linenumber", "sk", "qty", "cents", "disc", "tax"]
    t = m.trades.select("holder", *order, unit.alias("unit"), (F.col("qty") * unit).alias("cost"))
    run = group_running_totals(t, ["holder"], order, {"cum_lots": "qty", "cum_cost": "cost"})
    return run.select("holder", "l_orderkey", "l_linenumber", "cum_lots", "cum_cost", (F.col("cum_lots") * F.col("unit")).alias("market_value"))


@query("E15_daily_fill", """
d AS (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM prices GROUP BY symbol)
SELECT d.symbol, d.date, p.close FROM d ASOF JOIN prices p ON d.symbol=p.symbol AND p.date<=d.date""")
def _(m):
    return R.daily_fill(m.closes)


@query("E16_rebase_shared_date", """
s AS (SELECT min(date) AS d FROM (SELECT date FROM index_prices GROUP BY date HAVING count(DISTINCT index)=(SELECT count(DISTINCT index) FROM index_prices)))
SELECT i.index, i.date, i.close, R6{i.close/b.close*100} AS normalized FROM index_prices i JOIN s ON i.date>=s.d JOIN index_prices b ON b.index=i.index AND b.date=s.d""")
def _(m):
    return R.rebase_on_shared_date(m.index_prices, "index").withColumn("normalized", rnd("normalized"))


@query("E17_regime", """
s AS (SELECT date, CASE WHEN count(*) OVER f=50 THEN avg(close) OVER f END AS sf, CASE WHEN count(*) OVER l=200 THEN avg(close) OVER l END AS ss, count(*) OVER () AS n
 FROM bench WINDOW f AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), l AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
g AS (SELECT date, sf, ss, CASE WHEN sf>ss THEN 'bull' ELSE 'bear' END AS regime FROM s WHERE n>=205)
SELECT date, R5{sf} AS sma_fast, R5{ss} AS sma_slow, regime, coalesce(lag(regime) OVER (ORDER BY date) <> regime, true) AS changed FROM g""")
def _(m):
    g = R.regime_series(m.benchmark)
    changed = R.regime_changes(g).select("date", F.lit(True).alias("changed"))
    return g.join(changed, "date", "left").select("date", rnd("sma_fast", 5).alias("sma_fast"), rnd("sma_slow", 5).alias("sma_slow"), "regime", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("E18_rank_in_month", """
c AS (SELECT d.symbol, d.date, adjDividend/price*100 AS yield FROM dividends d JOIN profiles p ON d.symbol=p.symbol WHERE year(d.date)=2000)
SELECT symbol, date, R6{yield} AS yield, row_number() OVER (PARTITION BY month(date) ORDER BY yield DESC, symbol) AS rank FROM c""")
def _(m):
    c = calendar(m.dividends, m.profiles, 2000).withColumn("month", F.month("date")).withColumn("yield", sdiv("adjDividend", "price") * 100)
    return group_row_number(c, ["month"], [F.desc("yield"), "symbol"], "rank").select("symbol", "date", rnd("yield").alias("yield"), "rank")


PERIOD_SQL = """
p AS (SELECT {g}, arg_min(close,date) AS a, arg_max(close,date) AS b, count(*) AS n FROM {t} WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-07-31' GROUP BY {g}),
d AS (SELECT {g}, date, (close/nullif(lag(close) OVER (PARTITION BY {g} ORDER BY date),0)-1)*100 AS r FROM {t}),
o AS (SELECT p.{g}, (b/a-1)*100 AS pr, d.r FROM p LEFT JOIN d ON d.{g}=p.{g} AND d.date=DATE '2001-07-31' WHERE n>=2)
SELECT {g}, R6[pr] AS period_return, R6[r] AS return_1d, row_number() OVER (ORDER BY {g}<>'{h}', pr DESC, {g}) AS position FROM o"""


def period_sql(**k):
    return PERIOD_SQL.format(**k).replace("R6[", "R6{").replace("]", "}")


@query("E19_index_period_returns", period_sql(g="index", t="index_prices", h="ASIA"))
def _(m):
    return R.period_and_day_return(m.index_prices, "index", "2000-01-01", "2001-07-31", "ASIA").select("index", rnd("period_return").alias("period_return"), rnd("return_1d").alias("return_1d"), "position")


@query("E19_fx_period_returns", period_sql(g="pair", t="fx_pairs", h=""))
def _(m):
    return R.period_and_day_return(m.fx_pairs, "pair", "2000-01-01", "2001-07-31", "").select("pair", rnd("period_return").alias("period_return"), rnd("return_1d").alias("return_1d"), "position")


@query("E20_price_levels", """
l AS (SELECT symbol, max(date) AS last FROM prices GROUP BY symbol),
w AS (SELECT symbol, date, CASE WHEN count(*) OVER a>=10 THEN avg(close) OVER a END AS ma20, CASE WHEN count(*) OVER b>=25 THEN avg(close) OVER b END AS ma50, CASE WHEN count(*) OVER c>=100 THEN avg(close) OVER c END AS ma200
 FROM prices WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING))
SELECT p.symbol, arg_max(p.close,p.date) AS current_price, max(high) AS ath, min(low) AS atl, max(high) FILTER (WHERE p.date>=last-364) AS high_52w, min(low) FILTER (WHERE p.date>=last-364) AS low_52w,
 R5{arg_max(ma20,p.date)} AS ma20, R5{arg_max(ma50,p.date)} AS ma50, R5{arg_max(ma200,p.date)} AS ma200, R6{(arg_max(p.close,p.date)/max(high)-1)*100} AS drawdown_ath
FROM prices p JOIN l ON p.symbol=l.symbol JOIN w ON w.symbol=p.symbol AND w.date=p.date GROUP BY p.symbol""")
def _(m):
    d = R.price_levels(m.prices)
    return d.select(*[rnd(c, 5).alias(c) if c.startswith("ma") else rnd(c).alias(c) if c == "drawdown_ath" else F.col(c) for c in d.columns])


@query("E21_tail", "SELECT symbol, date, close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 61")
def _(m):
    return R.tail(m.closes, 61)
