"""Rating and comparison queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import ratings as J
from .oracle import shared
from .q_dividends import scores
from .q_fundamentals import rounded, shortlist_base
from .registry import query


def pct_sql(c, part="", asc=True, where=None):
    """Average-tie percent rank among rows where ``where`` (or the value) holds."""
    w = where or f"{c} IS NOT NULL"
    p = f"PARTITION BY ({w}){', ' + part if part else ''}"
    return (f"CASE WHEN {w} THEN (rank() OVER ({p} ORDER BY {c}{'' if asc else ' DESC'})+(count(*) OVER ({p}, {c})-1)/2.0)/count({c}) OVER ({p}) END")


shared("ratings", f"""
SELECT *, list_avg([valuation, dividend, growth, profitability, sec]) AS overall FROM (SELECT symbol, n AS sector_peer_count, coalesce(vp,0)*100 AS valuation, CASE WHEN yield>0 THEN (yp+dp)/2*100 ELSE 0 END AS dividend,
 (rp+ip)/2*100 AS growth, mp*100 AS profitability, CASE WHEN n>=3 THEN coalesce(sp,0)*100 END AS sec FROM
 (SELECT *, {pct_sql('peRatio', asc=False, where='coalesce(peRatio>0,false)')} AS vp, {pct_sql('numDividendYear', where='yield>0')} AS yp, {pct_sql('yield', where='yield>0')} AS dp, {pct_sql('revenueGrowth')} AS rp,
  {pct_sql('netIncomeGrowth')} AS ip, {pct_sql('medianProfitMargin')} AS mp, {pct_sql('peRatio', part='sector', asc=False, where='coalesce(peRatio>0,false)')} AS sp, count(*) FILTER (WHERE peRatio>0) OVER (PARTITION BY sector) AS n FROM scores))""")
RATE = ["valuation", "dividend", "growth", "profitability", "sector", "overall"]


@query("J01_ratings", "SELECT symbol, sector_peer_count, R6{valuation} AS valuation, R6{dividend} AS dividend, R6{growth} AS growth, R6{profitability} AS profitability, R6{sec} AS sector, R6{overall} AS overall FROM ratings")
def _(m):
    return rounded(J.ratings(scores(m)), ["symbol", "sector_peer_count"])


@query("J02_outside_ratings", """
u AS (SELECT * FROM scores WHERE isActivelyTrading), o AS (SELECT * FROM scores WHERE NOT isActivelyTrading),
r AS (SELECT o.symbol, CASE WHEN any_value(o.peRatio)>0 THEN count(*) FILTER (WHERE u.peRatio>0 AND u.peRatio>o.peRatio)*100.0/count(*) FILTER (WHERE u.peRatio>0) ELSE 0 END AS valuation,
 CASE WHEN any_value(o.yield)>0 THEN (count(*) FILTER (WHERE u.yield>0 AND u.numDividendYear<o.numDividendYear)+count(*) FILTER (WHERE u.yield>0 AND u.yield<o.yield))*50.0/count(*) FILTER (WHERE u.yield>0) ELSE 0 END AS dividend,
 (count(*) FILTER (WHERE u.revenueGrowth<o.revenueGrowth)+count(*) FILTER (WHERE u.netIncomeGrowth<o.netIncomeGrowth))*50.0/count(*) AS growth, count(*) FILTER (WHERE u.medianProfitMargin<o.medianProfitMargin)*100.0/count(*) AS profitability,
 CASE WHEN count(*) FILTER (WHERE u.sector=o.sector AND u.peRatio>0)>=3 THEN CASE WHEN any_value(o.peRatio)>0 THEN count(*) FILTER (WHERE u.sector=o.sector AND u.peRatio>0 AND u.peRatio>o.peRatio)*100.0/count(*) FILTER (WHERE u.sector=o.sector AND u.peRatio>0) ELSE 0 END END AS sec
 FROM o, u GROUP BY o.symbol)
SELECT symbol, R6{valuation} AS valuation, R6{dividend} AS dividend, R6{growth} AS growth, R6{profitability} AS profitability, R6{sec} AS sector, R6{list_avg([valuation,dividend,growth,profitability,sec])} AS overall FROM r""")
def _(m):
    s = J.cut_lineage(scores(m))
    return rounded(J.outside_ratings(s.where("isActivelyTrading"), s.where("not isActivelyTrading")), ["symbol"])


shared("comp", """
SELECT * REPLACE (return_7d*100 AS return_7d, return_1m*100 AS return_1m, return_1y*100 AS return_1y, return_10y*100 AS return_10y, total_return_1y*100 AS total_return_1y, total_return_10y*100 AS total_return_10y,
 CASE WHEN maximumCutPct IS NOT NULL THEN -least(maximumCutPct,0) END AS maximumCutPct, CASE WHEN max10CutPct IS NOT NULL THEN -least(max10CutPct,0) END AS max10CutPct),
 earningTTM/nullif(revenueTTM,0)*100 AS marginTTM, CASE WHEN earningTTM/(mktCap/price)>0 THEN lastDiv/(earningTTM/(mktCap/price))*100 END AS dividendPayoutRatio, 1/(1+exp(-2*(mktCap/3000000000000-1))) AS mc_penalty FROM scores""")


def _metric_sql():
    rule = {"positive": "{c}>0", "nonnegative": "{c}>=0", "finite": "{c} IS NOT NULL"}
    return " UNION ALL ".join(f"SELECT symbol, industry, '{c}' AS metric, '{d}' AS direction, CAST({c} AS DOUBLE) AS value FROM comp WHERE {rule[r].format(c=c)}" for c, d, r in J.METRICS)


shared("mvals", _metric_sql())


def values(m):
    return J.metric_values(J.comparison_table(scores(m)), ["industry"])


BIG = ["earningTTM", "revenueTTM", "mktCap"]


def mval(c="value"):
    return F.when(F.col("metric").isin(*BIG), F.round(c, 0)).otherwise(F.round(c, 4))


def mval_sql(c="value"):
    return f"CASE WHEN metric IN ('earningTTM','revenueTTM','mktCap') THEN R0{{{c}}} ELSE R4{{{c}}} END"


@query("J03_direction_percentile", """
c AS (SELECT a.symbol, a.metric, any_value(a.direction) AS d, count(*) AS n, count(*) FILTER (WHERE abs(b.value-a.value)<=1e-8+1e-5*abs(a.value)) AS tie_count,
 CASE any_value(a.direction) WHEN 'higher_better' THEN count(*) FILTER (WHERE b.value<a.value) WHEN 'lower_better' THEN count(*) FILTER (WHERE b.value>a.value) ELSE count(*) FILTER (WHERE b.value<=a.value) END*100.0/count(*) AS pct
 FROM mvals a JOIN mvals b ON a.metric=b.metric GROUP BY a.symbol, a.metric)
SELECT symbol, metric, R6{pct} AS percent, n AS peer_count, tie_count, CASE WHEN d<>'neutral' THEN 'Better than '||printf('%.0f',CAST(pct AS DOUBLE))||'% of '||n||' valid peers' ELSE 'At or below the '||printf('%.0f',CAST(pct AS DOUBLE))||'th percentile among '||n||' valid peers' END
 || CASE WHEN tie_count>1 THEN '; tied with '||(tie_count-1) ELSE '' END AS text FROM c""")
def _(m):
    return J.direction_percentile(values(m)).withColumn("percent", rnd("percent"))


@query("J04_comparison_states", f"""
e AS (SELECT industry, metric, max(value) AS hi, min(value) AS lo FROM mvals GROUP BY ALL),
j AS (SELECT v.*, CASE WHEN direction='higher_better' THEN hi ELSE lo END AS best, CASE WHEN direction='higher_better' THEN lo ELSE hi END AS worst FROM mvals v JOIN e ON v.industry=e.industry AND v.metric=e.metric)
SELECT industry, symbol, metric, {mval_sql()} AS value, CASE WHEN direction='neutral' THEN '' WHEN abs(best-worst)<=1e-8+1e-5*abs(worst) THEN 'Tied' WHEN abs(value-best)<=1e-8+1e-5*abs(best) THEN 'Best' WHEN abs(value-worst)<=1e-8+1e-5*abs(worst) THEN 'Weakest' ELSE '' END AS state FROM j""")
def _(m):
    return J.comparison_states(values(m), "industry").withColumn("value", mval())


CT = ["marginTTM", "dividendPayoutRatio", "mc_penalty", "maximumCutPct", "max10CutPct", "return_7d", "return_1m", "return_1y", "return_10y", "total_return_1y", "total_return_10y"]


@query("J05_comparison_table", "SELECT symbol, " + ", ".join(f"R6{{{c}}} AS {c}" for c in CT) + " FROM comp")
def _(m):
    return rounded(J.comparison_table(scores(m)).select("symbol", *CT), ["symbol"])


@query("J06_peer_stats", f"SELECT metric, count(*) AS n, {mval_sql('avg(value)')} AS mean, {mval_sql('median(value)')} AS median, {mval_sql('quantile_cont(value,0.25)')} AS p25, {mval_sql('quantile_cont(value,0.75)')} AS p75 FROM mvals GROUP BY metric")
def _(m):
    return J.peer_stats(values(m)).select("metric", "n", *[mval(c).alias(c) for c in ("mean", "median", "p25", "p75")])


@query("J07_quadrants", """
t AS (SELECT symbol, peRatio AS x, yield AS y FROM comp WHERE peRatio>0), q AS (SELECT quantile_cont(x,0.05) AS a, quantile_cont(x,0.95) AS b, quantile_cont(y,0.05) AS c, quantile_cont(y,0.95) AS d FROM t),
md AS (SELECT median(x) AS xm, median(y) AS ym FROM t, q WHERE x BETWEEN a AND b AND y BETWEEN c AND d)
SELECT symbol, R5{x} AS x, R6{y} AS y, R5{xm} AS x_med, R6{ym} AS y_med, CASE WHEN x<xm AND y>=ym THEN 'More favorable on both' WHEN x<xm THEN 'X more favorable' WHEN y>=ym THEN 'Y more favorable' ELSE 'Less favorable on both' END AS quadrant FROM t, md""")
def _(m):
    t = J.comparison_table(scores(m)).where("peRatio > 0")
    return rounded(J.quadrants(t, "peRatio", "yield", x_high=False, y_high=True), ["symbol", "quadrant"], 6, x=5, x_med=5)


shared("vol", """
SELECT symbol, stddev_samp(r)*100 AS volatility, count(r) AS observations FROM (SELECT symbol, CASE WHEN abs(r)<=0.35 THEN r END AS r FROM
 (SELECT symbol, close/lag(close) OVER (PARTITION BY symbol ORDER BY date)-1 AS r FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC)<=61))) GROUP BY symbol""")


@query("J08_daily_volatility", "SELECT symbol, R6{volatility} AS volatility, observations FROM vol")
def _(m):
    return rounded(J.daily_volatility(m.closes), ["symbol", "observations"])


shared("elig", "SELECT s.*, volatility, observations FROM shortl s JOIN vol v ON s.symbol=v.symbol WHERE mktCap>=1e12 AND current_pe BETWEEN 5 AND 50 AND avg_pe>0 AND avg_pe<100 AND observations>=30 AND volatility>=1")
shared("trank", f"SELECT *, ds*0.4+vs*0.6 AS trading_rank FROM (SELECT *, {pct_sql('Discount')}*100 AS ds, {pct_sql('volatility')}*100 AS vs FROM elig)")


def trading(m):
    return J.trading_rank(shortlist_base(m), J.daily_volatility(m.closes))


@query("J09_trading_rank", "SELECT symbol, R6{ds} AS discount_score, R6{vs} AS volatility_score, R6{trading_rank} AS trading_rank FROM trank")
def _(m):
    return rounded(trading(m).select("symbol", "discount_score", "volatility_score", "trading_rank"), ["symbol"])


LIST_SQL = """
raw AS (SELECT c_custkey AS query_id, ' '||lower(printf('S%06d', c_custkey%130))||', '||printf('S%06d', c_custkey%7)||','||printf('S%06d', c_custkey%130)||',,XX,'||printf('S%06d', c_custkey%11+20)||','||printf('S%06d', c_custkey%13+40)||' ,'||printf('S%06d', c_custkey%17+60)||','||printf('S%06d', c_custkey%3) AS query FROM customer),
i AS (SELECT query_id, unnest(string_split(query, ',')) AS item, generate_subscripts(string_split(query, ','),1) AS pos FROM raw),
s AS (SELECT query_id, upper(trim(item)) AS symbol, min(pos) AS pos FROM i WHERE trim(item)<>'' GROUP BY ALL),
k AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM s WHERE symbol IN (SELECT symbol FROM companies))
SELECT query_id, place, symbol, n>5 AS overflow FROM k WHERE place<=5"""


@query("J10_symbol_lists", LIST_SQL)
def _(m):
    k = F.col("c_custkey")
    s = lambda n, off=0: F.format_string("S%06d", k % n + off)
    text = F.concat(F.lit(" "), F.lower(s(130)), F.lit(", "), s(7), F.lit(","), s(130), F.lit(",,XX,"), s(11, 20), F.lit(","), s(13, 40), F.lit(" ,"), s(17, 60), F.lit(","), s(3))
    return J.parse_symbol_lists(m.table("customer").select(k.alias("query_id"), text.alias("query")), m.companies)
