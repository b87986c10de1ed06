"""Fundamentals and valuation queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import dividends as D
from ..operators import fundamentals as U
from ..operators import valuation as V
from ..operators.returns import latest_returns
from ..sources.clean import clean_universe
from .market import ASOF
from .oracle import shared
from .q_dividends import rate, scores
from .registry import query


def rounded(df, keep, digits=6, **special):
    return df.select(*keep, *[rnd(c, special.get(c, digits)).alias(c) for c in df.columns if c not in keep])


GROWTH = [f"{k}_{p}y_{m}{s}" for m in ("revenue", "netIncome") for p in (2, 5, 10) for k, s in (("median", "_growth"), ("trim_mean", "_growth"), ("cagr", ""))] + ["revenue_growth_TTM", "netIncome_growth_TTM"]


@query("I01_growth_stats", "SELECT symbol, " + ", ".join(f"R4{{{c}}} AS {c}" for c in GROWTH) + " FROM finstats0")
def _(m):
    return rounded(U.fin_stats(m.financials, None).select("symbol", *GROWTH), ["symbol"], 4)


@query("I02_fin_stats", "SELECT symbol, reportedCurrency, R6{median_profit_margin} AS median_profit_margin, R0{earningTTM} AS earningTTM, R0{revenueTTM} AS revenueTTM, R6{marginTTM} AS marginTTM FROM finstats")
def _(m):
    d = U.fin_stats(m.financials, rate(m)).select("symbol", "reportedCurrency", "median_profit_margin", "earningTTM", "revenueTTM", "marginTTM")
    return rounded(d, ["symbol", "reportedCurrency"], earningTTM=0, revenueTTM=0)


shared("persh", """
SELECT symbol, date, CASE WHEN count(*) OVER w=4 THEN sum(e) OVER w END AS eps_ttm, CASE WHEN count(*) OVER w=4 THEN sum(s) OVER w END AS sps_ttm FROM
 (SELECT f.symbol, date, netIncome*k/outstandingShares AS e, revenue*k/outstandingShares AS s FROM (SELECT *, CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END AS k FROM financials, (SELECT * FROM rate)) f JOIN shares h ON h.symbol=f.symbol)
WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)""")
shared("ratios", "SELECT p.symbol, p.date, p.close, eps_ttm, sps_ttm, p.close/nullif(eps_ttm,0) AS pe, p.close/nullif(sps_ttm,0) AS ps FROM prices p ASOF LEFT JOIN persh f ON p.symbol=f.symbol AND f.date<=p.date")
shared("pehist", """
SELECT p.symbol, p.date, p.close, e AS eps_ttm, p.close/nullif(e,0) AS pe FROM prices p ASOF LEFT JOIN
 (SELECT symbol, date, CASE WHEN count(*) OVER w=4 THEN sum(eps*k) OVER w END AS e FROM (SELECT *, CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END AS k FROM financials, (SELECT * FROM rate))
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)) f ON p.symbol=f.symbol AND f.date<=p.date""")


def hist(m):
    return U.ratio_history(m.closes, m.financials, m.shares, rate(m))


@query("I03_ratio_history", "SELECT symbol, date, close, R6{eps_ttm} AS eps_ttm, R6{sps_ttm} AS sps_ttm, R6{pe} AS pe, R6{ps} AS ps FROM ratios")
def _(m):
    return rounded(hist(m), ["symbol", "date", "close"], 6)


@query("I04_pe_history", "SELECT symbol, date, close, R6{eps_ttm} AS eps_ttm, R6{pe} AS pe FROM pehist")
def _(m):
    return rounded(U.pe_history(m.closes, m.financials, rate(m)), ["symbol", "date", "close"], 6)


def _pe_sql():
    out = []
    for y in (1, 2, 3, 5, 10):
        f = f"FILTER (WHERE date > last - {y * 365})"
        out += [f"avg(pe) {f} AS last_{y}y_mean", f"quantile_cont(pe, 0.05) {f} AS last_{y}y_min_ci", f"quantile_cont(pe, 0.95) {f} AS last_{y}y_max_ci"]
    return ", ".join(out)


shared("pestats", f"SELECT symbol, arg_max(pe, date) AS current_pe, {_pe_sql()} FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM pehist) GROUP BY symbol")
PE_COLS = ["current_pe"] + [f"last_{y}y_{k}" for y in (1, 2, 3, 5, 10) for k in ("mean", "min_ci", "max_ci")]


@query("I05_pe_stats", "SELECT symbol, " + ", ".join(f"R6{{{c}}} AS {c}" for c in PE_COLS) + " FROM pestats")
def _(m):
    return rounded(U.pe_stats(U.pe_history(m.closes, m.financials, rate(m))), ["symbol"], 6)


VAL_COLS = [c for c in GROWTH if "revenue" in c]
shared("valuation", "SELECT v.*, " + ", ".join(VAL_COLS) + ", last_2y_mean/nullif(current_pe,0)-1 AS target, 1-last_2y_min_ci/nullif(current_pe,0) AS risk, last_2y_max_ci/nullif(current_pe,0)-1 AS upside FROM pestats v JOIN finstats0 f ON v.symbol=f.symbol")


@query("I06_valuation_table", "SELECT symbol, " + ", ".join(f"R6{{{c}}} AS {c}" for c in PE_COLS + VAL_COLS + ["target", "risk", "upside"]) + " FROM valuation")
def _(m):
    return rounded(U.valuation_table(U.pe_history(m.closes, m.financials, rate(m)), m.financials), ["symbol"], 6)


shared("stst", """
SELECT symbol, max(rt) FILTER (WHERE k=1) AS revenue_ttm, max(nt) FILTER (WHERE k=1) AS earnings_ttm, max(rg) FILTER (WHERE k=1)*100 AS revenue_growth_ttm, max(ng) FILTER (WHERE k=1)*100 AS earnings_growth_ttm,
 median(rg) FILTER (WHERE k<=20)*100 AS revenue_growth_5y, median(ng) FILTER (WHERE k<=20)*100 AS earnings_growth_5y, max(margin) FILTER (WHERE k=1) AS margin_ttm, median(margin) FILTER (WHERE k<=20) AS margin_median, max(date) AS statement_date
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ttm WHERE rt IS NOT NULL AND nt IS NOT NULL) GROUP BY symbol""")
ST = ["revenue_growth_ttm", "earnings_growth_ttm", "revenue_growth_5y", "earnings_growth_5y", "margin_ttm", "margin_median"]


@query("I07_statement_stats", "SELECT symbol, revenue_ttm, earnings_ttm, statement_date, " + ", ".join(f"R4{{{c}}} AS {c}" for c in ST) + " FROM stst")
def _(m):
    return rounded(U.statement_stats(m.financials), ["symbol", "revenue_ttm", "earnings_ttm", "statement_date"], 4)


def _summary_sql(table, r):
    return f"""SELECT symbol, any_value(cur) AS {r}_current, avg({r}) AS {r}_mean, median({r}) AS {r}_median, avg(CASE WHEN {r}<=cur THEN 1.0 ELSE 0.0 END)*100 AS {r}_percentile, count(*) AS {r}_n, (median({r})/any_value(cur)-1)*100 AS {r}_discount
FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last, arg_max({r}, date) OVER (PARTITION BY symbol) AS cur FROM {table} WHERE {r}>0) WHERE date >= last - INTERVAL 5 YEAR GROUP BY symbol HAVING count(*)>=60"""


shared("pesum", _summary_sql("ratios", "pe"))
shared("pssum", _summary_sql("ratios", "ps"))


@query("I08_ratio_summary", "SELECT symbol, R4{pe_current} AS current, R4{pe_mean} AS mean, R4{pe_median} AS median, R6{pe_percentile} AS percentile, pe_n AS observations, R4{pe_discount} AS discount FROM pesum")
def _(m):
    return rounded(U.ratio_summary(hist(m), "pe", 5), ["symbol", "observations"], 4, percentile=6)


shared("universe", "SELECT * FROM profiles WHERE isActivelyTrading AND NOT isEtf AND NOT isFund AND mktCap>0 AND price>0")
shared("persh2", """
SELECT symbol, date, CASE WHEN count(*) OVER w=4 THEN sum(e) OVER w END AS eps_ttm, CASE WHEN count(*) OVER w=4 THEN sum(s) OVER w END AS sps_ttm FROM
 (SELECT f.symbol, date, netIncome*k/(mktCap/price) AS e, revenue*k/(mktCap/price) AS s FROM (SELECT *, CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END AS k FROM financials, (SELECT * FROM rate)) f JOIN universe h ON h.symbol=f.symbol)
WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)""")
shared("ratios2", "SELECT p.symbol, p.date, p.close/nullif(eps_ttm,0) AS pe, p.close/nullif(sps_ttm,0) AS ps FROM prices p ASOF LEFT JOIN persh2 f ON p.symbol=f.symbol AND f.date<=p.date")
shared("pesum2", _summary_sql("ratios2", "pe"))
shared("pssum2", _summary_sql("ratios2", "ps"))


def _cl(c):
    return f"least(greatest(coalesce({c},0),-20),30)/100"


shared("scan", f"""
SELECT *, (fe+fs)/2 AS b1, (ge+gs)/2 AS b5 FROM (SELECT u.symbol, u.sector, u.mktCap, u.price, t.* EXCLUDE (symbol), a.* EXCLUDE (symbol), b.* EXCLUDE (symbol),
 ((pe_mean/pe_current+ps_mean/ps_current)/2-1)*100 AS upside_to_mean,
 pe_mean/pe_current*(1+{_cl('earnings_growth_ttm')}) AS fe, ps_mean/ps_current*(1+{_cl('revenue_growth_ttm')}) AS fs,
 pe_mean/pe_current*pow(1+{_cl('earnings_growth_5y')},5) AS ge, ps_mean/ps_current*pow(1+{_cl('revenue_growth_5y')},5) AS gs
FROM universe u JOIN stst t ON u.symbol=t.symbol JOIN pesum2 a ON a.symbol=u.symbol JOIN pssum2 b ON b.symbol=u.symbol
JOIN (SELECT symbol FROM financials GROUP BY symbol HAVING count(*)>=8) q ON q.symbol=u.symbol)""")


@query("I09_projected_upside", """
SELECT symbol, R4{upside_to_mean} AS upside_to_mean, R4{(b1-1)*100} AS upside_1y, R4{(b5-1)*100} AS upside_5y, R4{(fe-1)*100} AS earnings_upside_1y, R4{(fs-1)*100} AS revenue_upside_1y,
 R4{(ge-1)*100} AS earnings_upside_5y, R4{(gs-1)*100} AS revenue_upside_5y, R4{price*b1} AS implied_price_1y, R4{price*b5} AS implied_price_5y FROM scan""")
def _(m):
    d = U.scan_rows(clean_universe(m.profiles), m.closes, m.financials, rate(m))
    return d.select("symbol", *[rnd(c, 4).alias(c) for c in d.columns if "upside" in c or "implied" in c])


def _rank_sql(c):
    return f"CASE WHEN count({c}) OVER ()<=1 THEN 50 WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2.0)*100/count({c}) OVER () END"


_G = [_rank_sql(c) for c in U.GROWTH_COLS]
shared("scanscore", f"""
SELECT *, vs*0.55+gs_*0.35+qs*0.10 AS score FROM (SELECT *, 100-(pe_percentile+ps_percentile)/2 AS vs, list_avg([g1,g2,g3,g4]) AS gs_ FROM
 (SELECT *, {_G[0]} AS g1, {_G[1]} AS g2, {_G[2]} AS g3, {_G[3]} AS g4, {_rank_sql('margin_ttm')} AS qs FROM scan))""")


def scan_scores(m):
    return U.scan_scores(U.scan_rows(clean_universe(m.profiles), m.closes, m.financials, rate(m)))


@query("I10_fundamental_scan", "SELECT symbol, R4{vs} AS valuation_score, R4{gs_} AS growth_score, R4{qs} AS quality_score, R4{score} AS score FROM scanscore")
def _(m):
    return scan_scores(m).select("symbol", *[rnd(c, 4).alias(c) for c in ("valuation_score", "growth_score", "quality_score", "score")])


@query("I11_valuation_assessment", """
h AS (SELECT * FROM ratios WHERE date >= :asof - 365*5), v AS (SELECT symbol, date, pe, arg_max(pe,date) OVER (PARTITION BY symbol) AS now FROM h WHERE pe>0),
g AS (SELECT symbol, any_value(now) AS now, count(*) AS observations, median(pe) AS median, quantile_cont(pe,0.05) AS p5, quantile_cont(pe,0.10) AS p10, quantile_cont(pe,0.45) AS p45, quantile_cont(pe,0.55) AS p55,
 quantile_cont(pe,0.90) AS p90, quantile_cont(pe,0.95) AS p95, avg(CASE WHEN pe<now THEN 1.0 ELSE 0 END)*100 AS percentile FROM v GROUP BY symbol HAVING count(*)>=30),
c AS (SELECT symbol, arg_max(close,date) AS cp FROM h GROUP BY symbol)
SELECT g.symbol, observations, R4{now} AS now, R4{median} AS median, R4{p5} AS p5, R4{p10} AS p10, R4{p45} AS p45, R4{p55} AS p55, R4{p90} AS p90, R4{p95} AS p95, R4{percentile} AS percentile, cp AS current_price,
 R4{median/now*cp} AS fair_price, R4{p10/now*cp} AS fair_price_p10, R4{p90/now*cp} AS fair_price_p90, R4{(median/now-1)*100} AS upside,
 CASE WHEN now BETWEEN p45 AND p55 THEN 'Fairly valued relative to its history' WHEN now<p45 THEN 'Below its historical valuation range' ELSE 'Above its historical valuation range' END AS assessment
FROM g JOIN c ON g.symbol=c.symbol""")
def _(m):
    return rounded(V.assess(hist(m), "pe", ASOF), ["symbol", "observations", "current_price", "assessment"], 4)


@query("I12_fair_value_bands", """
q AS (SELECT symbol, median(pe) AS m, quantile_cont(pe,0.1) AS a, quantile_cont(pe,0.9) AS b FROM ratios GROUP BY symbol HAVING count(pe)>=4)
SELECT r.symbol, date, close, R4{m*eps_ttm} AS fair_value_median, R4{a*eps_ttm} AS fair_value_p10, R4{b*eps_ttm} AS fair_value_p90 FROM ratios r JOIN q ON r.symbol=q.symbol WHERE eps_ttm IS NOT NULL""")
def _(m):
    return rounded(V.fair_value_bands(hist(m), "pe", "eps_ttm"), ["symbol", "date", "close"], 4)


shared("ddm", """
SELECT *, CASE WHEN ke>g THEN nd/((ke-g)/100) END AS value FROM (SELECT *, lastDiv*(1+g/100) AS nd FROM (SELECT s.symbol, price, lastDiv, 6.5+beta*5.0 AS ke, CASE WHEN cagr_5y>0 THEN least(cagr_5y,5.0) ELSE 2.5 END AS g
 FROM scores s JOIN divstats d ON s.symbol=d.symbol))""")


def ddm(m):
    stats = D.dividend_stats(D.yearly_dividends(m.dividends, ASOF), ASOF).select("symbol", "cagr_5y")
    return V.discounted_dividends(scores(m).select("symbol", "price", "lastDiv", "beta").join(stats, "symbol"))


@query("I13_discounted_dividends", """
SELECT symbol, R6{ke} AS ke, R6{g} AS g, R6{nd} AS next_div, R6{value} AS value, R6{(value/price-1)*100} AS margin_of_safety, R6{value*0.9} AS low, R6{value*1.1} AS high,
 CASE WHEN value IS NULL THEN NULL WHEN value>price*1.05 THEN 'Undervalued' WHEN value<price*0.95 THEN 'Overvalued' ELSE 'Fair Valued' END AS assessment FROM ddm""")
def _(m):
    d = ddm(m).drop("price", "lastDiv", "beta", "cagr_5y")
    return rounded(d, ["symbol", "assessment"], 6)


@query("I14_sensitivity_grid", """
c AS (SELECT symbol, lastDiv, i, j, greatest(1.0, ke+i) AS r, greatest(0.0, g+j) AS gg FROM ddm, generate_series(-2,2) a(i), generate_series(-2,2) b(j))
SELECT symbol, CAST(i AS INT) AS i, CAST(j AS INT) AS j, R6{r} AS r_val, R6{gg} AS g_val, R6{lastDiv*(1+gg/100)/((r-gg)/100)} AS value FROM c WHERE r>gg""")
def _(m):
    return rounded(V.sensitivity_grid(ddm(m)), ["symbol", "i", "j"], 6)


@query("I15_annual_income", """
y AS (SELECT symbol, calendarYear, sum(revenue) AS r, sum(netIncome) AS n FROM financials GROUP BY ALL)
SELECT symbol, calendarYear, r AS revenue, n AS netIncome, R4{n/nullif(r,0)*100} AS margin, R4{(r/nullif(lag(r) OVER w,0)-1)*100} AS revenue_growth, R4{(n/nullif(lag(n) OVER w,0)-1)*100} AS netIncome_growth FROM y WINDOW w AS (PARTITION BY symbol ORDER BY calendarYear)""")
def _(m):
    return rounded(V.annual_income(m.financials), ["symbol", "calendarYear", "revenue", "netIncome"], 4)


@query("I15_quarterly_income", """
SELECT symbol, date, calendarYear||' '||period AS period_label, R4{(revenue/nullif(lag(revenue) OVER w,0)-1)*100} AS revenue_qoq, R4{(netIncome/nullif(lag(netIncome) OVER w,0)-1)*100} AS netIncome_qoq,
 lag(revenue,4) OVER w AS revenue_year_ago, lag(netIncome,4) OVER w AS netIncome_year_ago, R4{CASE WHEN margin<-50 THEN -50 WHEN margin>100 THEN 100 ELSE margin END} AS ttm_margin FROM ttm WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(m):
    return rounded(V.quarterly_income(m.financials), ["symbol", "date", "period_label", "revenue_year_ago", "netIncome_year_ago"], 4)


shared("fxf", """
SELECT s7/e AS fx_7, s30/e AS fx_30, s365/e AS fx_365, s3650/e AS fx_3650 FROM (SELECT arg_max(close,date) AS e, arg_max(close,date) FILTER (WHERE date<=l-7) AS s7, arg_max(close,date) FILTER (WHERE date<=l-30) AS s30,
 arg_max(close,date) FILTER (WHERE date<=l-365) AS s365, arg_max(close,date) FILTER (WHERE date<=l-3650) AS s3650 FROM (SELECT *, max(date) OVER () AS l FROM fx WHERE date<=:asof))""")


def factors(m):
    return V.fx_factors(m.fx, ASOF, [7, 30, 365, 3650])


@query("I16_fx_factors", "SELECT R6{fx_7} AS fx_7, R6{fx_30} AS fx_30, R6{fx_365} AS fx_365, R6{fx_3650} AS fx_3650 FROM fxf")
def _(m):
    return rounded(factors(m), [])


@query("I17_usd_returns", "SELECT symbol, " + ", ".join(f"R6{{((1+{c})*fx_{n}-1)*100}} AS {c}_usd" for c, n in V.FX_DAYS.items()) + " FROM scores, (SELECT * FROM fxf)")
def _(m):
    return rounded(V.usd_returns(scores(m), factors(m)), ["symbol"])


@query("I18_growth_index", """
t AS (SELECT symbol, date, rt/arg_min(rt,date) FILTER (WHERE rt<>0) OVER (PARTITION BY symbol)*100 AS r, nt/arg_min(nt,date) FILTER (WHERE nt<>0) OVER (PARTITION BY symbol)*100 AS n FROM ttm WHERE rt IS NOT NULL AND nt IS NOT NULL)
SELECT symbol, date, 'revenue' AS series, R4{r} AS index FROM t UNION ALL SELECT symbol, date, 'netIncome', R4{n} FROM t""")
def _(m):
    return rounded(V.growth_index(U.trailing(m.financials)), ["symbol", "date", "series"], 4)


shared("shortl", """
SELECT v.symbol, current_pe, avg_pe, (1-current_pe/nullif(avg_pe,0))*100 AS Discount, p.mktCap FROM (SELECT *, list_avg([last_1y_mean,last_3y_mean,last_5y_mean]) AS avg_pe FROM valuation) v JOIN profiles p ON p.symbol=v.symbol""")


def shortlist_base(m):
    v = V.pe_discount(U.valuation_table(U.pe_history(m.closes, m.financials, rate(m)), m.financials))
    return v.select("symbol", "current_pe", "avg_pe", "Discount").join(m.profiles.select("symbol", "mktCap"), "symbol")


@query("I19_pe_discount", "SELECT symbol, mktCap, R4{current_pe} AS current_pe, R4{avg_pe} AS avg_pe, R4{Discount} AS Discount FROM shortl")
def _(m):
    return rounded(shortlist_base(m), ["symbol", "mktCap"], 4)


@query("I20_convert_statements", """
SELECT symbol, date, R0{revenue*CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END} AS revenue, R0{netIncome*CASE WHEN reportedCurrency='USD' THEN rate ELSE 1 END} AS netIncome, 'IDR' AS reportedCurrency FROM financials, (SELECT * FROM rate)""")
def _(m):
    once = U.convert_statements(m.financials, rate(m))
    return rounded(U.convert_statements(once, rate(m)).select("symbol", "date", "revenue", "netIncome", "reportedCurrency"), ["symbol", "date", "reportedCurrency"], 0)
