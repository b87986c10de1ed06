"""Dividend queries (F01-F15) and the shared checking tables behind them."""

from pyspark.sql import functions as F

from ..functions.ranking import group_row_number
from ..functions.scalars import rnd, sdiv
from ..operators import dividends as D
from ..operators import fundamentals as U
from ..operators.returns import latest_returns
from .market import ASOF, Market, without_partner
from .oracle import shared
from .registry import query

shared("rate", "SELECT coalesce(arg_max(close, date) FILTER (WHERE date <= :asof), 16618.0) AS rate FROM fx")
shared("yd", """
SELECT s.symbol, s.year, coalesce(v, 0.0) AS v FROM
 (SELECT symbol, unnest(generate_series(min(year(date)), greatest(max(year(date)), year(:asof)-1))) AS year FROM dividends GROUP BY symbol) s
 LEFT JOIN (SELECT symbol, year(date) AS year, sum(adjDividend) AS v FROM dividends GROUP BY ALL) y ON s.symbol=y.symbol AND s.year=y.year""")
shared("ydx", """
SELECT *, inc/nullif(pv,0)*100 AS pct, row_number() OVER (PARTITION BY symbol ORDER BY year) AS t, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rd FROM
 (SELECT symbol, year, v, v-lag(v) OVER w AS inc, lag(v) OVER w AS pv FROM
   (SELECT *, max(year < year(:asof)) OVER (PARTITION BY symbol) AS past FROM yd) WHERE year < year(:asof) OR NOT past
  WINDOW w AS (PARTITION BY symbol ORDER BY year))""")
shared("ydew", """
SELECT symbol, avg(ef) AS ewf, avg(ep) AS ewp FROM
 (SELECT a.symbol, a.t, sum(b.inc*pow(1/3.0,a.t-b.t)) FILTER (WHERE b.inc IS NOT NULL)/sum(pow(1/3.0,a.t-b.t)) FILTER (WHERE b.inc IS NOT NULL) AS ef,
   sum(b.pct*pow(1/3.0,a.t-b.t)) FILTER (WHERE b.pct IS NOT NULL)/sum(pow(1/3.0,a.t-b.t)) FILTER (WHERE b.pct IS NOT NULL) AS ep
  FROM ydx a JOIN ydx b ON a.symbol=b.symbol AND b.t<=a.t GROUP BY ALL) GROUP BY symbol""")
shared("divstats", """
SELECT x.symbol, min(pct) AS maximum_cut_pct, min(pct) FILTER (WHERE rd BETWEEN 2 AND 10) AS max_10y_cut_pct,
 avg(inc) AS historical_mean_flat, avg(inc) FILTER (WHERE rd<=2) AS div_inc_2y_mean_flat, avg(inc) FILTER (WHERE rd<=5) AS div_inc_5y_mean_flat, any_value(ewf) AS exponential_weighted_mean_flat,
 avg(pct) AS historical_mean_pct, avg(pct) FILTER (WHERE rd<=2) AS div_inc_2y_mean_pct, avg(pct) FILTER (WHERE rd<=5) AS div_inc_5y_mean_pct, any_value(ewp) AS exponential_weighted_mean_pct,
 count(*) FILTER (WHERE inc>0)+1 AS num_positive_year, count(*) FILTER (WHERE v>0) AS num_dividend_year,
 (count(*) FILTER (WHERE inc>0)+1)*100.0/nullif(count(*) FILTER (WHERE v>0),0) AS pct_positive_year,
 CASE WHEN count(*)>=6 AND max(v) FILTER (WHERE rd=6)>0 THEN (pow(max(v) FILTER (WHERE rd=1)/max(v) FILTER (WHERE rd=6), 0.2)-1)*100 END AS cagr_5y,
 CASE WHEN count(*)>=11 AND max(v) FILTER (WHERE rd=11)>0 THEN (pow(max(v) FILTER (WHERE rd=1)/max(v) FILTER (WHERE rd=11), 0.1)-1)*100 END AS cagr_10y
FROM ydx x JOIN ydew e ON x.symbol=e.symbol GROUP BY x.symbol""")
shared("divsums", """
SELECT symbol, coalesce(sum(adjDividend) FILTER (WHERE date >= :asof - 365), 0) AS div_sum_1y, coalesce(sum(adjDividend) FILTER (WHERE date >= :asof - 3650), 0) AS div_sum_10y FROM dividends GROUP BY symbol""")
shared("lastdiv", """
SELECT s.symbol, coalesce(CASE WHEN f.fy >= year(:asof)-2 THEN o.v END, 0.0) AS lastDiv FROM (SELECT DISTINCT symbol FROM dividends) s
LEFT JOIN (SELECT symbol, arg_max(fiscal_year, date) AS fy FROM dividends WHERE dividend_type='final' GROUP BY symbol) f ON s.symbol=f.symbol
LEFT JOIN (SELECT symbol, fiscal_year AS fy, sum(adjDividend) AS v FROM dividends WHERE dividend_type<>'special' GROUP BY ALL) o ON o.symbol=s.symbol AND o.fy=f.fy""")
shared("ttm", """
SELECT *, rt/nullif(lag(rt,4) OVER w,0)-1 AS rg, nt/nullif(lag(nt,4) OVER w,0)-1 AS ng, nt/nullif(rt,0)*100 AS margin, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rd,
 rt/nullif(lag(rt,8) OVER w,0) AS r2, rt/nullif(lag(rt,20) OVER w,0) AS r5, rt/nullif(lag(rt,40) OVER w,0) AS r10,
 nt/nullif(lag(nt,8) OVER w,0) AS n2, nt/nullif(lag(nt,20) OVER w,0) AS n5, nt/nullif(lag(nt,40) OVER w,0) AS n10
FROM (SELECT *, CASE WHEN count(*) OVER f=4 THEN sum(revenue) OVER f END AS rt, CASE WHEN count(*) OVER f=4 THEN sum(netIncome) OVER f END AS nt
      FROM financials WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


def _growth_sql(m, g, r):
    out = []
    for p in (2, 5, 10):
        lst = f"list_sort(list({g}) FILTER (WHERE {g} IS NOT NULL AND rd<={4 * p}))"
        newest = f"arg_min({r}{p}, rd) FILTER (WHERE {r}{p} IS NOT NULL)"
        out.append(f"median({g}) FILTER (WHERE rd<={4 * p})*100 AS median_{p}y_{m}_growth")
        out.append(f"list_avg(list_slice({lst}, CAST(floor(len({lst})*0.1) AS BIGINT)+1, len({lst})-CAST(floor(len({lst})*0.1) AS BIGINT)))*100 AS trim_mean_{p}y_{m}_growth")
        out.append(f"CASE WHEN {newest}>0 THEN (pow({newest}, {1 / p})-1)*100 END AS cagr_{p}y_{m}")
    out.append(f"arg_min({g}, rd) FILTER (WHERE {g} IS NOT NULL AND rd<=40)*100 AS {m}_growth_TTM")
    return ", ".join(out)


shared("finstats0", f"""
SELECT symbol, {_growth_sql('revenue', 'rg', 'r')}, {_growth_sql('netIncome', 'ng', 'n')}, median(margin) AS median_profit_margin,
 max(nt) FILTER (WHERE rd=1) AS earningTTM, max(rt) FILTER (WHERE rd=1) AS revenueTTM, max(reportedCurrency) FILTER (WHERE rd=1) AS reportedCurrency
FROM ttm GROUP BY symbol""")
shared("finstats", """
SELECT * REPLACE (earningTTM*k AS earningTTM, revenueTTM*k AS revenueTTM) FROM
 (SELECT f.*, CASE WHEN revenueTTM>0 THEN earningTTM/revenueTTM*100 ELSE 0 END AS marginTTM, CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END AS k FROM finstats0 f, (SELECT * FROM rate))""")
shared("returns", """
SELECT symbol, return_7d, return_1m, return_1y, return_10y FROM (SELECT symbol, close/lag(close,5) OVER w - 1 AS return_7d, close/lag(close,21) OVER w - 1 AS return_1m,
 close/lag(close,252) OVER w - 1 AS return_1y, close/lag(close,2520) OVER w - 1 AS return_10y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn
 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE rn=1""")


def _score_sql(home):
    last = "l.lastDiv" if home else "p.lastDiv"
    fin = "finstats" if home else "finstats0"
    return f"""
SELECT *, mktCap/nullif(earningTTM,0) AS peRatio, mktCap/nullif(revenueTTM,0) AS psRatio,
 (lastDiv+avgFlatAnnualDivIncrease*5)/nullif(price,0)*(numDividendYear*2.0/(25+numOfYear))*(positiveYear*2.0/(25+numOfYear))*(1+revenueGrowth*0.5*5)*lastDiv/100 AS DScore,
 return_1y + div_sum_1y/nullif(price/nullif(1+return_1y,0),0) AS total_return_1y, return_10y + div_sum_10y/nullif(price/nullif(1+return_10y,0),0) AS total_return_10y
FROM (SELECT p.* EXCLUDE (lastDiv), CASE WHEN ok THEN {last} ELSE 0 END AS lastDiv, CASE WHEN ok THEN {last}/nullif(price,0)*100 ELSE 0 END AS yield,
 f.trim_mean_10y_revenue_growth AS revenueGrowth, f.cagr_5y_revenue AS revenueCAGR5Y, f.revenue_growth_TTM AS revenueGrowthTTM, f.trim_mean_10y_netIncome_growth AS netIncomeGrowth,
 f.netIncome_growth_TTM AS netIncomeGrowthTTM, f.median_profit_margin AS medianProfitMargin, f.earningTTM, f.revenueTTM,
 CASE WHEN ok THEN least(coalesce(historical_mean_flat,0), coalesce(div_inc_5y_mean_flat,0)) END AS avgFlatAnnualDivIncrease,
 CASE WHEN ok THEN num_dividend_year END AS numDividendYear, CASE WHEN ok THEN num_positive_year END AS positiveYear,
 CASE WHEN ok THEN maximum_cut_pct ELSE 0 END AS maximumCutPct, CASE WHEN ok THEN max_10y_cut_pct ELSE 0 END AS max10CutPct,
 CASE WHEN ok THEN year(:asof)-year(ipoDate) END AS numOfYear, CASE WHEN ok THEN s.div_sum_1y ELSE 0 END AS div_sum_1y, CASE WHEN ok THEN s.div_sum_10y ELSE 0 END AS div_sum_10y,
 return_7d, return_1m, return_1y, return_10y
FROM (SELECT p.*, f.symbol IS NOT NULL AND d.symbol IS NOT NULL AS ok FROM profiles p LEFT JOIN (SELECT * FROM {fin} WHERE revenue_growth_TTM IS NOT NULL AND netIncome_growth_TTM IS NOT NULL) f ON p.symbol=f.symbol LEFT JOIN divstats d ON p.symbol=d.symbol) p
LEFT JOIN (SELECT * FROM {fin} WHERE revenue_growth_TTM IS NOT NULL AND netIncome_growth_TTM IS NOT NULL) f ON p.symbol=f.symbol
LEFT JOIN divstats d ON p.symbol=d.symbol LEFT JOIN divsums s ON p.symbol=s.symbol LEFT JOIN lastdiv l ON p.symbol=l.symbol LEFT JOIN returns r ON p.symbol=r.symbol)"""


shared("scores", _score_sql(True))
shared("scores_us", _score_sql(False))

SCORE_DIGITS = {
    "price": None, "lastDiv": 6, "yield": 6, "revenueGrowth": 6, "revenueCAGR5Y": 6, "revenueGrowthTTM": 6, "netIncomeGrowth": 4, "netIncomeGrowthTTM": 4, "medianProfitMargin": 6,
    "earningTTM": 0, "revenueTTM": 0, "peRatio": 5, "psRatio": 6, "avgFlatAnnualDivIncrease": 6, "numDividendYear": None, "positiveYear": None, "maximumCutPct": 6, "max10CutPct": 6,
    "numOfYear": None, "DScore": 4, "return_7d": 6, "return_1m": 6, "return_1y": 6, "return_10y": 6, "total_return_1y": 6, "total_return_10y": 6,
}
SCORE_SQL = ", ".join(["symbol", "sector", "industry", "mktCap", "ipoDate"] + [c if d is None else f"R{d}{{{c}}} AS {c}" for c, d in SCORE_DIGITS.items()])


def score_cols(*extra):
    return ["symbol", "sector", "industry", "mktCap", "ipoDate", *extra] + [F.col(c) if d is None else rnd(c, d).alias(c) for c, d in SCORE_DIGITS.items()]


def rate(m: Market):
    return U.usd_rate(m.fx, ASOF)


def scores(m: Market, home: bool = True):
    return D.score_table(m.profiles, m.financials, m.dividends, latest_returns(m.prices), rate(m), ASOF, home)


@query("F01_score_table", f"SELECT c.kode IS NOT NULL AS is_syariah, {SCORE_SQL} FROM scores s LEFT JOIN compliant c ON c.kode=s.symbol")
def _(m):
    listed = m.compliant.select(F.col("Kode").alias("symbol"), F.lit(True).alias("_c"))
    return scores(m).join(listed, "symbol", "left").select(*score_cols(F.col("_c").isNotNull().alias("is_syariah")))


@query("F01_score_table_foreign", f"SELECT {SCORE_SQL} FROM scores_us")
def _(m):
    return scores(m, home=False).select(*score_cols())


@query("F02_yearly_dividends", "SELECT symbol, year, R6{v} AS adjDividend FROM yd")
def _(m):
    return D.yearly_dividends(m.dividends, ASOF).select("symbol", "year", rnd("adjDividend").alias("adjDividend"))


STATS = ["maximum_cut_pct", "max_10y_cut_pct", "historical_mean_flat", "div_inc_2y_mean_flat", "div_inc_5y_mean_flat", "exponential_weighted_mean_flat", "historical_mean_pct",
         "div_inc_2y_mean_pct", "div_inc_5y_mean_pct", "exponential_weighted_mean_pct", "num_positive_year", "num_dividend_year", "pct_positive_year", "cagr_5y", "cagr_10y"]


@query("F03_dividend_stats", "SELECT symbol, " + ", ".join(f"R6{{{c}}} AS {c}" for c in STATS) + " FROM divstats")
def _(m):
    return D.dividend_stats(D.yearly_dividends(m.dividends, ASOF), ASOF).select("symbol", *[rnd(c).alias(c) for c in STATS])


@query("F04_trailing_dividends", "SELECT symbol, R6{div_sum_1y} AS div_sum_1y, R6{div_sum_10y} AS div_sum_10y FROM divsums")
def _(m):
    return D.trailing_sums(m.dividends, ASOF).select("symbol", rnd("div_sum_1y").alias("div_sum_1y"), rnd("div_sum_10y").alias("div_sum_10y"))


@query("F05_last_annual_dividend", "SELECT symbol, R6{lastDiv} AS lastDiv FROM lastdiv")
def _(m):
    return D.last_annual_dividend(m.dividends, ASOF).select("symbol", rnd("lastDiv").alias("lastDiv"))


@query("F06_dividend_calendar", """
SELECT d.date, d.symbol, R6{CASE WHEN d.symbol IN ('S000006','S000008') THEN adjDividend/4 ELSE adjDividend END} AS adjDividend, price
FROM dividends d JOIN profiles p ON d.symbol=p.symbol WHERE year(d.date)=2000 AND mktCap>=2000000000000 AND d.symbol NOT IN ('S000001','S000012','S000013')""")
def _(m):
    d = D.calendar(m.dividends, m.profiles, 2000, 2e12, ("S000001", "S000012", "S000013"), {"S000006": 4.0, "S000008": 4.0})
    return d.withColumn("adjDividend", rnd("adjDividend"))


@query("F07_calendar_months", """
SELECT month(d.date) AS month, row_number() OVER (PARTITION BY month(d.date) ORDER BY adjDividend/price DESC, d.symbol) AS rank, d.symbol AS stock, strftime(d.date, '%d %b') AS ex_date,
 R6{adjDividend/price*100} AS div_yield, adjDividend AS dividend, price FROM dividends d JOIN profiles p ON d.symbol=p.symbol WHERE year(d.date)=2000""")
def _(m):
    c = D.calendar(m.dividends, m.profiles, 2000).withColumn("month", F.month("date")).withColumn("y", sdiv("adjDividend", "price"))
    r = group_row_number(c, ["month"], [F.desc("y"), "symbol"], "rank")
    return r.select("month", "rank", F.col("symbol").alias("stock"), F.date_format("date", "dd MMM").alias("ex_date"), rnd(F.col("y") * 100).alias("div_yield"), F.col("adjDividend").alias("dividend"), "price")


@query("F08_shift_calendar", """
SELECT symbol, date, make_date(CAST(year(date)+1 AS BIGINT), month(date), CASE WHEN month(date)=2 AND day(date)=29 THEN 28 ELSE day(date) END) AS next_date FROM prices""")
def _(m):
    return m.prices.select("symbol", "date", D.shift_to_year("date", F.year("date") + 1).alias("next_date"))


@query("F09_extrapolate", """
l AS (SELECT symbol, max(year) AS y, arg_max(v, year) AS last FROM yd GROUP BY symbol)
SELECT l.symbol, y+i AS year, R6{last+i*s.historical_mean_flat} AS adjDividend FROM l JOIN divstats s ON l.symbol=s.symbol, generate_series(1,5) g(i)""")
def _(m):
    y = D.yearly_dividends(m.dividends, ASOF)
    last = y.groupBy("symbol").agg(F.max("year").alias("year"), F.max_by("adjDividend", "year").alias("last"))
    j = last.join(D.dividend_stats(y, ASOF).select("symbol", F.col("historical_mean_flat").alias("inc")), "symbol")
    return D.extrapolate(j, 5).withColumn("adjDividend", rnd("adjDividend"))


shared("payout", """
SELECT y.symbol, avg(dps/eps*100) AS avg_payout FROM (SELECT symbol, year(date) AS year, sum(adjDividend) AS dps FROM dividends GROUP BY ALL) y
JOIN (SELECT f.symbol, calendarYear AS year, sum(netIncome)*any_value(CASE WHEN f.reportedCurrency='USD' THEN rate ELSE 1 END)/any_value(outstandingShares) AS eps
      FROM financials f JOIN shares s ON f.symbol=s.symbol, (SELECT * FROM rate) GROUP BY ALL) e ON y.symbol=e.symbol AND y.year=e.year WHERE eps>0 GROUP BY y.symbol""")


@query("F10_dividend_outlook", """
SELECT s.symbol, R6{lastDiv+avgFlatAnnualDivIncrease} AS next_div, R6{CASE WHEN price>0 THEN (lastDiv+avgFlatAnnualDivIncrease)/price*100 ELSE 0 END} AS next_yield,
 R6{CASE WHEN peRatio>0 THEN lastDiv/nullif(price/peRatio,0)*100 END} AS payout_ratio, R6{avg_payout} AS avg_payout,
 R6{CASE WHEN num_dividend_year>0 THEN num_positive_year*100.0/num_dividend_year ELSE 0 END} AS consistency, R6{cagr_5y} AS cagr_5y, R6{cagr_10y} AS cagr_10y
FROM scores s LEFT JOIN payout p ON s.symbol=p.symbol JOIN divstats d ON s.symbol=d.symbol""")
def _(m):
    stats = D.dividend_stats(D.yearly_dividends(m.dividends, ASOF), ASOF)
    out = D.dividend_outlook(scores(m), D.payout_history(m.dividends, m.financials, m.shares, rate(m)), stats)
    return out.select("symbol", *[rnd(c).alias(c) for c in out.columns[1:]])


@query("F11_stored_score", "SELECT symbol, R4{DScore} AS DScore FROM scores")
def _(m):
    return scores(m).drop("DScore").withColumn("DScore", rnd(D.stored_score(), 4)).select("symbol", "DScore")


shared("screener", """
SELECT *, row_number() OVER (ORDER BY payer DESC, s DESC, symbol) AS Rank FROM (
SELECT *, coalesce(greatest(least(greatest(lastDiv*(1+coalesce(least(greatest(avgFlatAnnualDivIncrease/nullif(lastDiv,0),-0.20),0.05),0)*5*coalesce(positiveYear*1.0/nullif(numOfYear,0),1))/nullif(price,0)*100,0),12)
  * (1-exp(-numDividendYear/10.0)) * (100-c10)/100 * mc_penalty
  * coalesce(1+CASE WHEN revenueGrowthTTM<-100 THEN -100 WHEN revenueGrowthTTM>25 THEN 25 ELSE revenueGrowthTTM END/100,1) * coalesce(1+CASE WHEN netIncomeGrowthTTM<-100 THEN -100 WHEN netIncomeGrowthTTM>25 THEN 25 ELSE netIncomeGrowthTTM END/100,1)
  * CASE WHEN peRatio>0 THEN 1/(1+greatest(yield/100*peRatio-1,0)) ELSE 1 END * payer + 0*(numDividendYear+c10),0) + payer*1e-6, 0) AS s
FROM (SELECT *, CASE WHEN max10CutPct IS NOT NULL THEN -least(max10CutPct,0) END AS c10, CASE WHEN maximumCutPct IS NOT NULL THEN -least(maximumCutPct,0) END AS cmax,
  1/(1+exp(-2*(mktCap/3000000000000-1))) AS mc_penalty, CASE WHEN yield>0 THEN 1 ELSE 0 END AS payer, earningTTM/nullif(revenueTTM,0)*100 AS marginTTM FROM scores))""")


@query("F12_screener_ranking", """
SELECT symbol, Rank, R6{s} AS DScore, R6{coalesce(marginTTM,0)} AS marginTTM, R6{coalesce(cmax,0)} AS maximumCutPct, R6{coalesce(c10,0)} AS max10CutPct, R6{mc_penalty} AS mc_penalty,
 R6{coalesce(return_1y*100,0)} AS return_1y, R6{coalesce(total_return_1y*100,0)} AS total_return_1y, R5{coalesce(peRatio,0)} AS peRatio FROM screener""")
def _(m):
    d = D.screener_table(scores(m))
    cols = ["DScore", "marginTTM", "maximumCutPct", "max10CutPct", "mc_penalty", "return_1y", "total_return_1y"]
    return d.select("symbol", "Rank", *[rnd(c).alias(c) for c in cols], rnd("peRatio", 5).alias("peRatio"))


@query("F13_cut_sizes", "SELECT symbol, R6{-least(maximumCutPct,0)} AS maximumCutPct, R6{CASE WHEN max10CutPct IS NOT NULL THEN -least(max10CutPct,0) END} AS max10CutPct FROM scores")
def _(m):
    return scores(m).select("symbol", rnd(D.cut_size("maximumCutPct")).alias("maximumCutPct"), rnd(D.cut_size("max10CutPct")).alias("max10CutPct"))


@query("F14_total_returns", """
SELECT r.symbol, R6{return_1y + coalesce(div_sum_1y,0)/nullif(price/nullif(1+return_1y,0),0)} AS total_return_1y, R6{return_10y + coalesce(div_sum_10y,0)/nullif(price/nullif(1+return_10y,0),0)} AS total_return_10y
FROM returns r JOIN profiles p ON r.symbol=p.symbol LEFT JOIN divsums d ON d.symbol=r.symbol""")
def _(m):
    d = latest_returns(m.prices).join(m.profiles.select("symbol", "price"), "symbol").join(D.trailing_sums(m.dividends, ASOF), "symbol", "left").na.fill(0.0, ["div_sum_1y", "div_sum_10y"])
    return D.with_total_returns(d).select("symbol", rnd("total_return_1y").alias("total_return_1y"), rnd("total_return_10y").alias("total_return_10y"))


@query("F15_unscored_stats", """
h AS (SELECT * FROM shares UNION ALL SELECT symbol||'-N', outstandingShares FROM shares), l AS (SELECT symbol, arg_max(close,date) AS close FROM prices GROUP BY symbol), c AS (SELECT * FROM l UNION ALL SELECT symbol||'-N', close FROM l), n AS (SELECT symbol, arg_max(v,year) AS last FROM yd GROUP BY symbol),
j AS (SELECT h.symbol, coalesce(p.price, c.close, 0) AS price, coalesce(changes,0) AS changes, coalesce(CAST(mktCap AS DOUBLE), coalesce(p.price,c.close,0)*outstandingShares) AS cap,
 coalesce(sector,'Unknown') AS sector, coalesce(industry,'Unknown') AS industry, coalesce(beta,1) AS beta, coalesce((:asof-ipoDate)/365.25, 10) AS yrs, coalesce(last,0) AS last, d.*, f.*
 FROM h LEFT JOIN c ON h.symbol=c.symbol LEFT JOIN profiles p ON h.symbol=p.symbol LEFT JOIN divstats d ON h.symbol=d.symbol LEFT JOIN n ON n.symbol=h.symbol LEFT JOIN finstats f ON f.symbol=h.symbol)
SELECT symbol, price, changes, R0{cap} AS mktCap, sector, industry, beta, R6{yrs} AS numOfYear, R6{last} AS lastDiv, R6{CASE WHEN price>0 THEN last/price*100 ELSE 0 END} AS yield,
 R0{coalesce(num_dividend_year,0)} AS numDividendYear, R0{coalesce(num_positive_year,0)} AS positiveYear, R6{coalesce(historical_mean_flat,0)} AS avgFlatAnnualDivIncrease,
 R6{coalesce(median_5y_revenue_growth,0)} AS revenueGrowth, R4{coalesce(median_5y_netIncome_growth,0)} AS netIncomeGrowth, R6{coalesce(median_profit_margin,0)} AS medianProfitMargin,
 R0{coalesce(earningTTM,0)} AS earningTTM, R0{coalesce(revenueTTM,0)} AS revenueTTM, R6{coalesce(marginTTM,0)} AS marginTTM, R6{coalesce(revenue_growth_TTM,0)} AS revenueGrowthTTM, R4{coalesce(netIncome_growth_TTM,0)} AS netIncomeGrowthTTM,
 R5{CASE WHEN earningTTM>0 THEN cap/earningTTM ELSE -1 END} AS peRatio, R6{CASE WHEN revenueTTM>0 THEN cap/revenueTTM ELSE -1 END} AS psRatio FROM (SELECT * EXCLUDE (symbol_1, symbol_2) FROM j)""")
def _(m):
    last = m.closes.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    d = D.unscored_stats(m.profiles, m.financials, m.dividends, rate(m), without_partner(m.shares, "-N"), without_partner(last, "-N"), ASOF)  # with listings that have a price and nothing else
    digits = {"mktCap": 0, "earningTTM": 0, "revenueTTM": 0, "numDividendYear": 0, "positiveYear": 0, "netIncomeGrowth": 4, "netIncomeGrowthTTM": 4, "peRatio": 5}
    plain = {"symbol", "price", "changes", "sector", "industry", "beta"}
    return d.select(*[F.col(c) if c in plain else rnd(c, digits.get(c, 6)).alias(c) for c in d.columns])
