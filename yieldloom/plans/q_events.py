"""Seasonality and event-study queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import events as E
from .oracle import shared
from .q_fundamentals import rounded
from .registry import query

SUM = "R4{avg(%s)} AS mean, R4{median(%s)} AS median, R4{stddev_samp(%s)} AS std, R4{quantile_cont(%s,0.25)} AS q25, R4{quantile_cont(%s,0.75)} AS q75"


def summ(c):
    return SUM.replace("%s", c)


@query("K01_stock_seasonality", f"""
m AS (SELECT symbol, year(date) AS y, month(date) AS month, median(close) AS p FROM prices GROUP BY ALL), a AS (SELECT symbol, year(date) AS y, avg(close) AS am FROM prices GROUP BY ALL),
r AS (SELECT m.symbol, m.y, month, p/am*100 AS rel FROM m JOIN a ON m.symbol=a.symbol AND m.y=a.y)
SELECT symbol, month, {summ('rel')} FROM r WHERE symbol IN (SELECT symbol FROM r GROUP BY symbol HAVING count(DISTINCT y)>=2) GROUP BY ALL""")
def _(m):
    return rounded(E.stock_seasonality(m.closes), ["symbol", "month"], 4)


shared("filled", """
SELECT d.symbol, d.date, p.close FROM (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM prices GROUP BY symbol) d ASOF JOIN prices p ON d.symbol=p.symbol AND p.date<=d.date""")
shared("exev", """
SELECT e.*, p.close AS ex_price, c.close AS cum_price, c.date AS cum_date FROM (SELECT symbol, date AS ex_date, max(adjDividend) AS dividend_amount FROM dividends GROUP BY ALL) e
ASOF LEFT JOIN prices p ON p.symbol=e.symbol AND p.date<=e.ex_date ASOF LEFT JOIN prices c ON c.symbol=e.symbol AND c.date<e.ex_date""")


@query("K02_ex_trajectory", f"""
t AS (SELECT e.symbol, CAST(f.date-e.ex_date AS INT) AS days_to_ex, f.close/ex_price*100 AS rel FROM exev e JOIN filled f ON f.symbol=e.symbol AND f.date BETWEEN e.ex_date-180 AND e.ex_date+30 WHERE ex_price<>0)
SELECT symbol, days_to_ex, {summ('rel')} FROM t GROUP BY ALL""")
def _(m):
    return rounded(E.ex_trajectory(m.closes, E.ex_events(m.dividends)), ["symbol", "days_to_ex"], 4)


@query("K03_ex_drop", "SELECT symbol, R6{median((ex_price/cum_price-1)*100)} AS median, R6{avg((ex_price/cum_price-1)*100)} AS mean, count(*) AS count FROM exev WHERE ex_price<>0 AND cum_price>0 GROUP BY symbol")
def _(m):
    return rounded(E.ex_drop_stats(m.closes, E.ex_events(m.dividends)), ["symbol", "count"])


shared("bestev", """
SELECT e.symbol, e.ex_date, any_value(dividend_amount) AS dividend_amount, any_value(ex_price) AS ex_price, any_value(cum_price) AS cum_price, any_value(cum_date) AS cum_date,
 min(struct_pack(c := p.close, d := p.date)) AS low FROM exev e JOIN prices p ON p.symbol=e.symbol AND p.date>=e.ex_date-180 AND p.date<e.ex_date GROUP BY e.symbol, e.ex_date""")


@query("K04_best_entry", "SELECT symbol, ex_date, ex_price, low.d AS low_date, low.c AS low_price, ex_date-low.d AS days_before FROM bestev")
def _(m):
    return E.best_entry(m.closes, E.ex_events(m.dividends).select("symbol", "ex_date")).select("symbol", "ex_date", "ex_price", "low_date", "low_price", "days_before")


@query("K05_cum_recovery", """
f AS (SELECT e.symbol, e.ex_date, any_value(cum_date) AS cum_date, any_value(cum_price) AS cum_price, min(struct_pack(d := p.date, c := p.close)) FILTER (WHERE p.close>=cum_price) AS h
 FROM exev e JOIN prices p ON p.symbol=e.symbol AND p.date BETWEEN e.ex_date AND e.ex_date+365 WHERE cum_price>0 GROUP BY e.symbol, e.ex_date),
l AS (SELECT symbol, max(date) AS last FROM prices GROUP BY symbol)
SELECT f.symbol, ex_date, cum_date, cum_price, h.d AS cum_recover_date, h.c AS cum_recover_price, CASE WHEN h IS NOT NULL THEN h.d-ex_date ELSE greatest(0, least(last, ex_date+365)-ex_date) END AS cum_days_after, h IS NOT NULL AS cum_recovered FROM f JOIN l ON f.symbol=l.symbol""")
def _(m):
    d = E.cum_recovery(m.closes, E.ex_events(m.dividends).select("symbol", "ex_date"))
    return d.select("symbol", "ex_date", "cum_date", "cum_price", "cum_recover_date", "cum_recover_price", "cum_days_after", "cum_recovered")


shared("elev", """
SELECT b.*, low.c AS low_price, low.d AS low_date, ex_date-low.d AS days_before, last FROM bestev b JOIN (SELECT symbol, min(date) AS first, max(date) AS last FROM prices GROUP BY symbol) s ON b.symbol=s.symbol
WHERE ex_date-180>=first AND ex_date<=last""")
shared("recev", """
SELECT e.*, CASE WHEN n.symbol IS NULL THEN NULL ELSE lh IS NOT NULL END AS low_recovered, lh.d AS low_recover_date, lh.c AS low_recover_price, CASE WHEN n.symbol IS NULL THEN NULL WHEN lh IS NOT NULL THEN lh.d-e.ex_date ELSE greatest(0, least(last, e.ex_date+365)-e.ex_date) END AS low_days_after,
 CASE WHEN n.symbol IS NULL OR cum_price IS NULL THEN NULL ELSE ch IS NOT NULL END AS cum_recovered, ch.d AS cum_recover_date, ch.c AS cum_recover_price, CASE WHEN n.symbol IS NULL OR cum_price IS NULL THEN NULL WHEN ch IS NOT NULL THEN ch.d-e.ex_date ELSE greatest(0, least(last, e.ex_date+365)-e.ex_date) END AS cum_days_after, sector
FROM elev e LEFT JOIN (SELECT e.symbol, e.ex_date, min(struct_pack(d := p.date, c := p.close)) FILTER (WHERE p.close>=low_price) AS lh, min(struct_pack(d := p.date, c := p.close)) FILTER (WHERE p.close>=cum_price) AS ch
  FROM elev e JOIN prices p ON p.symbol=e.symbol AND p.date BETWEEN e.ex_date AND e.ex_date+365 GROUP BY e.symbol, e.ex_date) n ON n.symbol=e.symbol AND n.ex_date=e.ex_date
LEFT JOIN companies c ON c.symbol=e.symbol""")


def rows(m):
    return E.event_rows(m.closes, E.ex_events(m.dividends))


def sectored(m):
    return rows(m).join(m.companies.select("symbol", "sector"), "symbol", "left")


@query("K06_low_recovery", "SELECT symbol, ex_date, low_date AS entry_date, low_price AS entry_price, cum_date, cum_price, low_recover_date, low_recover_price, low_days_after, low_recovered FROM recev WHERE low_recovered IS NOT NULL")
def _(m):
    return rows(m).where("low_recovered is not null").select("symbol", "ex_date", "entry_date", "entry_price", "cum_date", "cum_price", "low_recover_date", "low_recover_price", "low_days_after", "low_recovered")


shared("det0", """
SELECT p.symbol, p.date, year(p.date) AS y, month(p.date) AS month, ln(close) AS v, CAST(p.date-d0 AS DOUBLE) AS x FROM prices p JOIN
 (SELECT symbol, year(date) AS y, min(date) AS d0 FROM prices WHERE close>0 GROUP BY ALL HAVING count(DISTINCT month(date))=12) k ON p.symbol=k.symbol AND year(p.date)=k.y WHERE close>0""")
shared("detm", """
SELECT symbol, month, median(rel) AS rel_price FROM (SELECT symbol, y, month, median(exp(v-(b*x+a))*100) AS rel FROM (SELECT d.*, b, a FROM det0 d JOIN
 (SELECT symbol, y, regr_slope(v,x) AS b, regr_intercept(v,x) AS a FROM det0 GROUP BY ALL) f ON d.symbol=f.symbol AND d.y=f.y WHERE b IS NOT NULL) GROUP BY ALL) GROUP BY ALL""")
EV = ["symbol", "sector", "ex_date", "dividend_amount", "ex_price", "low_date", "low_price", "days_before", "cum_date", "cum_price", "low_recover_date", "low_days_after", "low_recovered", "cum_recover_date", "cum_days_after", "cum_recovered"]


@query("K07_event_table", f"""
SELECT 'monthly' AS record_type, d.symbol, month, R4{{rel_price}} AS rel_price, {', '.join(f'NULL AS {c}' if c != 'sector' else 'c.sector' for c in EV[1:])} FROM detm d LEFT JOIN companies c ON c.symbol=d.symbol
UNION ALL SELECT 'event', symbol, NULL, NULL, {', '.join(EV[1:])} FROM recev""")
def _(m):
    t = E.event_table(m.prices, E.ex_events(m.dividends), m.companies)
    return t.select("record_type", "symbol", "month", rnd("rel_price", 4).alias("rel_price"), *EV[1:])


@query("K08_aggregate_seasonality", f"SELECT month, {summ('rel_price')} FROM detm GROUP BY month")
def _(m):
    return rounded(E.aggregate_seasonality(m.closes), ["month"], 4)


def km_sql(by, pre, probs):
    q = ", ".join(f"min(t) FILTER (WHERE d>0 AND 1-s>={p}-1e-12) AS {n}" for n, p in probs.items())
    return f"""SELECT {by}, {q}, sum(d)::BIGINT AS recovered, (sum(n)-sum(d))::BIGINT AS censored FROM (SELECT *, product(1-d/r) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM (SELECT {by}, {pre}_days_after AS t, count(*) AS n, count(*) FILTER (WHERE {pre}_recovered) AS d FROM recev WHERE {pre}_days_after IS NOT NULL GROUP BY ALL))) GROUP BY {by}"""


shared("kmlow", km_sql("sector", "low", E.KM))
shared("kmcum", km_sql("sector", "cum", {"cum_median_recovery": 0.5}))


@query("K09_survival_quantile", km_sql("symbol", "cum", {"median": 0.5}))
def _(m):
    return E.survival_quantiles(rows(m), "cum_days_after", "cum_recovered", ["symbol"], {"median": 0.5})


@query("K10_recovery_stats", "SELECT * FROM kmlow")
def _(m):
    return E.survival_quantiles(sectored(m), "low_days_after", "low_recovered", ["sector"], E.KM)


@query("K11_sector_timing", """
b AS (SELECT sector, min(struct_pack(v := md, k := month)) AS b FROM (SELECT sector, month, median(rel_price) AS md FROM detm d JOIN companies c ON c.symbol=d.symbol GROUP BY ALL) GROUP BY sector),
n AS (SELECT sector, count(DISTINCT symbol) AS n_stocks FROM (SELECT d.symbol, sector FROM detm d JOIN companies c ON c.symbol=d.symbol UNION ALL SELECT symbol, sector FROM recev) GROUP BY sector),
d AS (SELECT sector, count(*) AS n_events, CAST(trunc(median(days_before)) AS INT) AS median_days, CAST(trunc(quantile_cont(days_before,0.25)) AS INT) AS p25_days, CAST(trunc(quantile_cont(days_before,0.75)) AS INT) AS p75_days FROM recev GROUP BY sector)
SELECT n.sector, n_stocks, b.k AS best_month, R4{b.v} AS avg_rel_price, n_events, median_days, p25_days, p75_days, l.median AS median_recovery, l.p25 AS p25_recovery, l.p75 AS p75_recovery, l.p90 AS p90_recovery, l.recovered AS n_recovery, l.censored AS n_censored,
 cum_median_recovery, c.recovered AS cum_n_recovery, c.censored AS cum_n_censored FROM n JOIN b ON n.sector=b.sector LEFT JOIN d ON d.sector=n.sector LEFT JOIN kmlow l ON l.sector=n.sector LEFT JOIN kmcum c ON c.sector=n.sector""".replace("AS b FROM (SELECT sector, month", "AS b0 FROM (SELECT sector, month").replace("b.k", "b0.k").replace("b.v", "b0.v"))
def _(m):
    t = E.event_table(m.prices, E.ex_events(m.dividends), m.companies)
    return E.sector_timing(t).withColumn("avg_rel_price", rnd("avg_rel_price", 4))


@query("K12_density", """
s AS (SELECT sector, count(*) AS n, greatest(1.06*coalesce(stddev_samp(days_before),0)*pow(count(*),-0.2),1.0) AS bw FROM recev GROUP BY sector)
SELECT r.sector, CAST(i AS INT) AS i, R6{i*180.0/255} AS x, R6{sum(exp(-0.5*pow((i*180.0/255-days_before)/bw,2)))/(any_value(n)*any_value(bw)*sqrt(2*pi()))} AS density FROM recev r JOIN s ON s.sector=r.sector, generate_series(0,255) g(i) GROUP BY r.sector, i""")
def _(m):
    return rounded(E.density(sectored(m), "days_before", ["sector"], 0.0, 180.0), ["sector", "i"])


@query("K13_event_detail", """
SELECT symbol, ex_date, dividend_amount, ex_price, low_date, low_price, days_before, cum_date, cum_price, R6{ex_price-cum_price} AS cum_ex_diff, CASE WHEN low_recovered THEN 'Recovered' WHEN NOT low_recovered THEN 'Dividend Trap' ELSE 'No Recovery Record' END AS low_recovery_status,
 CASE WHEN cum_recovered THEN 'Recovered' WHEN NOT cum_recovered THEN 'Dividend Trap' ELSE 'No Recovery Record' END AS cum_recovery_status, low_days_after, cum_days_after FROM recev""")
def _(m):
    ev = E.cut_lineage(rows(m))
    k = ["symbol", "ex_date"]
    best = ev.select(*k, "ex_price", "low_date", "low_price", "days_before")
    low = ev.where("low_recovered is not null").select(*k, "low_recover_date", "low_days_after", "low_recovered")
    cum = ev.where("cum_price is not null").select(*k, "cum_date", "cum_price", "cum_recover_date", "cum_days_after", "cum_recovered")
    d = E.event_detail(best, low, cum, ev.select(*k, "dividend_amount"))
    return d.select(*k, "dividend_amount", "ex_price", "low_date", "low_price", "days_before", "cum_date", "cum_price", rnd("cum_ex_diff").alias("cum_ex_diff"), "low_recovery_status", "cum_recovery_status", "low_days_after", "cum_days_after")


@query("K14_entry_comparison", """
SELECT *, low_total-low_recovered AS low_traps, cum_total-cum_recovered AS cum_traps, low_recovered-cum_recovered AS additional FROM (SELECT sector, count(*) FILTER (WHERE low_recovered) AS low_recovered, count(low_days_after) AS low_total,
 count(*) FILTER (WHERE cum_recovered) AS cum_recovered, count(cum_days_after) AS cum_total FROM recev GROUP BY sector)""")
def _(m):
    return E.entry_comparison(sectored(m))


@query("K15_yield_fit", """
y AS (SELECT sector, dividend_amount/low_price*100 AS x, low_days_after AS d, coalesce(low_recovered,false) AS r FROM recev WHERE low_days_after IS NOT NULL AND dividend_amount/low_price>0)
SELECT *, R4{s*xn+i} AS fit_min, R4{s*xx+i} AS fit_max FROM (SELECT sector, regr_slope(d,x) FILTER (WHERE r) AS s, regr_intercept(d,x) FILTER (WHERE r) AS i, min(x) FILTER (WHERE r) AS xn, max(x) FILTER (WHERE r) AS xx, count(*) FILTER (WHERE r) AS recovered, count(*) FILTER (WHERE NOT r) AS traps FROM y GROUP BY sector) WHERE recovered>=2 AND xx>xn"""
       .replace("SELECT *, R4", "SELECT sector, recovered, traps, R4{s} AS slope, R4{i} AS intercept, R6{xn} AS x_min, R6{xx} AS x_max, R4"))
def _(m):
    f = E.yield_fit(E.entry_yields(sectored(m), "low_price", "low_days_after", "low_recovered"))
    return rounded(f, ["sector", "recovered", "traps"], 4, x_min=6, x_max=6)


@query("K15_entry_yields", """
SELECT symbol, sector, ex_date, R6{dividend_amount/low_price*100} AS entry_yield, low_days_after AS days_after, coalesce(low_recovered,false) AS recovered, CASE WHEN coalesce(low_recovered,false) THEN 'Recovered' ELSE 'Dividend Trap' END AS status
FROM recev WHERE low_days_after IS NOT NULL AND dividend_amount/low_price>0""")
def _(m):
    return E.entry_yields(sectored(m), "low_price", "low_days_after", "low_recovered").withColumn("entry_yield", rnd("entry_yield"))


@query("K15_display_sample")
def _(m):
    return E.display_sample(E.entry_yields(sectored(m), "low_price", "low_days_after", "low_recovered"), 5000)  # a scatter plot's sample is the feature
