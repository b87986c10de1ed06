"""Portfolio, replay and projection queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import portfolio as P
from .market import ASOF, without_partner
from .oracle import shared
from .q_fundamentals import rounded
from .registry import query

shared("rawhold", """
SELECT holder, CASE l_orderkey%3 WHEN 0 THEN ' '||lower(symbol)||'.jk ' WHEN 1 THEN symbol ELSE symbol||'.JK' END AS symbol,
 CASE WHEN l_orderkey%50=7 THEN 'n/a' ELSE format('{:,}', qty*100) END AS lots, CASE WHEN l_orderkey%60=11 THEN '-5' ELSE ' '||format('{:,}', (100+disc)*level*10)||' ' END AS price FROM trades""".replace("{:,}", "<:,>"))
shared("normhold", """
SELECT holder, upper(CASE WHEN upper(trim(symbol)) LIKE '%.JK' THEN left(trim(symbol), length(trim(symbol))-3) ELSE trim(symbol) END) AS symbol, try_cast(replace(lots,',','') AS DOUBLE) AS l, try_cast(trim(replace(price,',','')) AS DOUBLE) AS p FROM rawhold""")


def raw_holdings(m):
    k = F.col("l_orderkey")
    sym = F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("symbol"), F.lit(".jk "))).when(k % 3 == 1, F.col("symbol")).otherwise(F.concat("symbol", F.lit(".JK")))
    lots = F.when(k % 50 == 7, "n/a").otherwise(F.format_number(F.col("qty") * 100, 0))
    price = F.when(k % 60 == 11, "-5").otherwise(F.concat(F.lit(" "), F.format_number((100 + F.col("disc")) * F.col("level") * 10, 0), F.lit(" ")))
    return m.trades.select("holder", sym.alias("Symbol"), lots.alias("Available Lot"), price.alias("Average Price"))


@query("M01_normalize_holdings", "SELECT holder, symbol, sum(l) AS lots, R6{sum(l*p)/sum(l)} AS avg_price FROM normhold WHERE l>0 AND p>0 GROUP BY ALL")
def _(m):
    return rounded(P.normalize_holdings(raw_holdings(m))[0], ["holder", "symbol", "lots"])


@query("M01_rejected_holdings", "SELECT holder, symbol, CASE WHEN l IS NULL OR l<=0 THEN 'Available Lot' ELSE 'Average Price' END AS \"column\" FROM normhold WHERE NOT coalesce(l>0 AND p>0, false)")
def _(m):
    return P.normalize_holdings(raw_holdings(m))[1]


shared("mkt", """
SELECT symbol, CASE WHEN CAST(substr(symbol,2) AS BIGINT)%23=7 THEN NULL ELSE price END AS last_price, CASE WHEN CAST(substr(symbol,2) AS BIGINT)%10=3 THEN '' ELSE sector END AS sector, CASE WHEN CAST(substr(symbol,2) AS BIGINT)%29=11 THEN -1.0 ELSE lastDiv END AS div_rate FROM profiles""")


def market(m):
    k = F.expr("substr(symbol, 2)").cast("long")
    p = m.profiles.select(
        F.concat("symbol", F.lit(".JK")).alias("symbol"), F.when(k % 23 != 7, F.col("price")).alias("price"),
        F.when(k % 10 == 3, "").otherwise(F.col("sector")).alias("sector"), F.when(k % 29 == 11, -1.0).otherwise(F.col("lastDiv")).alias("lastDiv"),
    )
    return P.with_market(m.holdings, p)[0]


@query("M02_validate_market", "SELECT holder, h.symbol, lots, avg_price, last_price, CASE WHEN sector='' THEN 'Unclassified' ELSE sector END AS sector, div_rate FROM holdings h JOIN mkt k ON h.symbol=k.symbol WHERE last_price>0 AND div_rate>=0")
def _(m):
    return P.validate_market(market(m))[0].select("holder", "symbol", "lots", "avg_price", "last_price", "sector", "div_rate")


@query("M02_rejected_market", "SELECT holder, h.symbol, CASE WHEN NOT coalesce(last_price>0,false) THEN 'market price must be greater than zero' ELSE 'annual dividend must be zero or greater' END AS fault FROM holdings h JOIN mkt k ON h.symbol=k.symbol WHERE NOT coalesce(last_price>0 AND div_rate>=0, false)")
def _(m):
    return P.validate_market(market(m))[1]


shared("posn", """
SELECT h.holder, h.symbol, lots, avg_price, price AS last_price, sector, lastDiv AS div_rate, lots*avg_price*100 AS total_invested, lastDiv/nullif(avg_price,0)*100 AS yoc, lastDiv/nullif(price,0)*100 AS yop, CAST(trunc(lastDiv*lots*100) AS BIGINT) AS total_dividend
FROM holdings h JOIN profiles p ON h.symbol=p.symbol""")


def positions(m):
    return P.position_metrics(P.validate_market(P.with_market(m.holdings, m.profiles)[0])[0])


@query("M03_position_metrics", "SELECT holder, symbol, total_invested, R6{yoc} AS yield_on_cost, R6{yop} AS yield_on_price, total_dividend FROM posn")
def _(m):
    return rounded(positions(m).select("holder", "symbol", "total_invested", "total_dividend", "yield_on_cost", "yield_on_price"), ["holder", "symbol", "total_invested", "total_dividend"])


shared("htot", "SELECT holder, sum(total_dividend)::BIGINT AS annual_dividend, sum(total_invested) AS total_investment, sum(lots*last_price*100) AS current_value FROM posn GROUP BY holder")


@query("M03_holder_totals", "SELECT holder, annual_dividend, R0{total_investment} AS total_investment, R2{current_value} AS current_value, R6{annual_dividend/12.0*100/1000000} AS achieved_pct, R6{CASE WHEN total_investment>0 THEN annual_dividend/total_investment*100 ELSE 0 END} AS yield_on_cost FROM htot")
def _(m):
    return rounded(P.holder_totals(positions(m), 12), ["holder", "annual_dividend"], 6, total_investment=0, current_value=2)


@query("M04_sector_income", "SELECT holder, sector, sum(total_dividend)::BIGINT AS total_dividend, count(*) AS stocks FROM posn GROUP BY ALL")
def _(m):
    return P.sector_income(positions(m))


@query("M05_income_timeline", """
SELECT holder, p.symbol, d.date, adjDividend, CAST(trunc(lots*adjDividend*100) AS BIGINT) AS total_dividend, CAST(month(d.date) AS INT) AS month, R6{adjDividend/last_price*100} AS yield,
 make_date(2000, month(d.date), CASE WHEN month(d.date)=2 AND day(d.date)=29 THEN 29 ELSE day(d.date) END) AS calendar_date
FROM posn p JOIN dividends d ON p.symbol=d.symbol WHERE d.date>=:asof-365 AND d.date<:asof AND dividend_type<>'special'""")
def _(m):
    return P.income_timeline(positions(m), m.dividends, ASOF).withColumn("yield", rnd("yield"))


@query("M05_month_totals", """
SELECT holder, CAST(month(d.date) AS INT) AS month, sum(CAST(trunc(lots*adjDividend*100) AS BIGINT))::BIGINT AS total_dividend, count(*) AS payments FROM posn p JOIN dividends d ON p.symbol=d.symbol WHERE d.date>=:asof-365 AND d.date<:asof AND dividend_type<>'special' GROUP BY ALL""")
def _(m):
    return P.income_timeline(positions(m), m.dividends, ASOF).groupBy("holder", "month").agg(F.sum("total_dividend").alias("total_dividend"), F.count("*").alias("payments"))


@query("M06_income_projection", """
SELECT holder, CAST(i AS INT) AS year, R2{annual_dividend*pow(1.07,i-1)} AS income, annual_dividend*pow(1.07,i-1) > 12000000 AS achieved, R6{annual_dividend*pow(1.07,i-1)/nullif(total_investment,0)*100} AS yield_on_cost FROM htot, generate_series(1,25) g(i)""")
def _(m):
    return rounded(P.income_projection(P.holder_totals(positions(m), 12), 25, 7.0, 12), ["holder", "year", "achieved"], 6, income=2)


@query("M07_payment_totals", """
pay AS (SELECT holder, stock, total, date FROM payments UNION ALL SELECT holder, stock||'-X', total, date FROM payments),
b AS (SELECT p.*, coalesce(sector,'Unclassified') AS sector, coalesce(industry,'Unclassified') AS industry, year(date) AS y, month(date) AS mo FROM pay p LEFT JOIN companies c ON c.symbol=p.stock)
SELECT holder, 'stock' AS level, stock AS key, sum(total) AS total, count(*) AS payments FROM b GROUP BY holder, stock UNION ALL SELECT holder, 'year', y::VARCHAR, sum(total), count(*) FROM b GROUP BY holder, y
UNION ALL SELECT holder, 'year_month', printf('%04d-%02d', y, mo), sum(total), count(*) FROM b GROUP BY holder, y, mo UNION ALL SELECT holder, 'date', date::VARCHAR, sum(total), count(*) FROM b GROUP BY holder, date
UNION ALL SELECT holder, 'sector', sector, sum(total), count(*) FROM b GROUP BY holder, sector UNION ALL SELECT holder, 'industry', industry, sum(total), count(*) FROM b GROUP BY holder, industry""")
def _(m):
    return P.payment_totals(without_partner(m.payments, "-X", "stock"), m.companies)


@query("M07_day_shares", """
d AS (SELECT holder, date, year(date) AS y, sum(total) AS total, count(*) AS payments FROM payments GROUP BY ALL)
SELECT holder, date, payments, total, R6{total/sum(total) OVER (PARTITION BY holder, y)} AS pct FROM d""")
def _(m):
    return P.day_shares(m.payments).withColumn("pct", rnd("pct"))


@query("M07_compare_month", "SELECT holder, coalesce(sum(total) FILTER (WHERE year(date)=1999),0.0) AS first_total, coalesce(sum(total) FILTER (WHERE year(date)=2000),0.0) AS second_total FROM payments WHERE month(date)=5 AND year(date) IN (1999,2000) GROUP BY holder")
def _(m):
    return P.compare_month(m.payments, 1999, 2000, 5)


@query("M07_payment_span", """
SELECT *, CAST((last-first)//365 AS INT) AS years, CAST(((last-first)%365)//30 AS INT) AS months, CAST((last-first)%365%30 AS INT) AS days FROM (SELECT holder, sum(total) AS total, count(*) AS payments, count(DISTINCT stock) AS stocks, min(date) AS first, max(date) AS last FROM payments GROUP BY holder)""")
def _(m):
    return P.payment_span(m.payments)


shared("rawalloc", """
SELECT c_mktsegment AS scenario, h.symbol, sum(lots*avg_price)*100 AS v FROM holdings h JOIN customer ON c_custkey=holder GROUP BY ALL""")
shared("alloc", "SELECT scenario, symbol, v AS amount FROM rawalloc")


def raw_allocations(m):
    h = m.holdings.join(m.table("customer").select(F.col("c_custkey").alias("holder"), F.col("c_mktsegment").alias("scenario")), "holder")
    return h.groupBy("scenario", "symbol").agg((F.sum(F.col("lots") * F.col("avg_price")) * 100).alias("v"))


def allocations(m):
    return raw_allocations(m).withColumnRenamed("v", "amount")


BAD = """
r AS (SELECT scenario, symbol, CAST(CAST(v AS BIGINT) AS VARCHAR) AS v, CAST(substr(symbol,2) AS BIGINT) AS k FROM rawalloc),
x AS (SELECT scenario, ' '||lower(symbol)||' ' AS stock, CASE WHEN k%9=5 THEN '0' WHEN k%7=3 THEN 'ten' ELSE v END AS value FROM r UNION ALL SELECT scenario, symbol, v FROM r WHERE k%8=1 UNION ALL SELECT scenario, '  ', v FROM r),
n AS (SELECT scenario, upper(trim(stock)) AS symbol, count(*) AS n, min(try_cast(value AS DOUBLE)) AS amount, bool_and(coalesce(try_cast(value AS DOUBLE)>0,false)) AS ok FROM x WHERE trim(stock)<>'' GROUP BY ALL)"""


def messy_allocations(m):
    k = F.expr("substr(symbol, 2)").cast("long")
    r = raw_allocations(m).select("scenario", "symbol", F.col("v").cast("long").cast("string").alias("value"), k.alias("k"))
    a = r.select("scenario", F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("stock"), F.when(F.col("k") % 9 == 5, "0").when(F.col("k") % 7 == 3, "ten").otherwise(F.col("value")).alias("value"))
    b = r.where("k % 8 = 1").select("scenario", F.col("symbol").alias("stock"), "value")
    return a.unionByName(b).unionByName(r.select("scenario", F.lit("  ").alias("stock"), "value"))


@query("M08_allocations", BAD + " SELECT scenario, symbol, amount FROM n WHERE n=1 AND ok")
def _(m):
    return P.build_allocations(messy_allocations(m))[0]


@query("M08_rejected_allocations", BAD + " SELECT scenario, symbol, CASE WHEN n>1 THEN 'duplicate ticker' ELSE 'amount must be greater than zero' END AS reason FROM n WHERE n>1 OR NOT ok")
def _(m):
    return P.build_allocations(messy_allocations(m))[1]


START, END = 1997, 2001
shared("firstbuy", f"SELECT symbol, arg_min(close,date) AS p0, min(date) AS d0 FROM prices WHERE year(date)={START} GROUP BY symbol")
shared("yends", f"SELECT * FROM (SELECT symbol, year(date) AS y, arg_max(close,date) AS ep FROM prices WHERE year(date) BETWEEN {START} AND {END} GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY symbol)={END - START + 1}")
shared("divev", f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM (SELECT d.symbol, d.date, year(d.date) AS y, adjDividend AS dps, CASE WHEN year(p.date)=year(d.date) THEN p.close END AS bp, p.date AS bd
FROM dividends d JOIN firstbuy f ON f.symbol=d.symbol AND d.date>=d0 ASOF LEFT JOIN prices p ON p.symbol=d.symbol AND p.date>=d.date WHERE year(d.date) BETWEEN {START} AND {END})""")
shared("al0", "SELECT a.scenario, a.symbol, floor(amount/(p0*100)) AS lots, amount-floor(amount/(p0*100))*p0*100 AS cash FROM alloc a JOIN firstbuy f ON f.symbol=a.symbol WHERE a.symbol IN (SELECT symbol FROM yends)")
shared("drip", """
SELECT scenario, symbol, 0::BIGINT AS k, NULL::BIGINT AS y, lots, cash, 0.0::DOUBLE AS pay, 0.0::DOUBLE AS bought FROM al0
UNION ALL SELECT scenario, s.symbol, e.k, e.y, lots + n, cash + lots*100*dps - CASE WHEN n>0 THEN n*bp*100 ELSE 0 END, lots*100*dps, n FROM
 (SELECT d.*, e.k AS ek, coalesce(floor((cash+lots*100*dps)/(bp*100)),0) AS n FROM drip d JOIN divev e ON e.symbol=d.symbol AND e.k=d.k+1) s JOIN divev e ON e.symbol=s.symbol AND e.k=s.ek""")
shared("replay", """
SELECT a.scenario, a.symbol, e.y AS year, 'No DRIP' AS strategy, lots, ep AS price, lots*ep*100 AS value, cash + coalesce((SELECT sum(lots*100*dps) FROM divev d WHERE d.symbol=a.symbol AND d.y<=e.y),0) AS cash, coalesce((SELECT sum(lots*100*dps) FROM divev d WHERE d.symbol=a.symbol AND d.y=e.y),0) AS income
FROM al0 a JOIN yends e ON e.symbol=a.symbol
UNION ALL SELECT a.scenario, a.symbol, a.y, 'With DRIP', d.lots, ep, d.lots*ep*100, d.cash, i.inc FROM (SELECT a.scenario, a.symbol, e.y, ep, coalesce((SELECT max(k) FROM divev d WHERE d.symbol=a.symbol AND d.y<=e.y),0) AS k FROM al0 a JOIN yends e ON e.symbol=a.symbol) a
JOIN drip d ON d.scenario=a.scenario AND d.symbol=a.symbol AND d.k=a.k JOIN (SELECT a.scenario, a.symbol, e.y, coalesce(sum(pay),0) AS inc FROM al0 a JOIN yends e ON e.symbol=a.symbol LEFT JOIN drip d ON d.scenario=a.scenario AND d.symbol=a.symbol AND d.y=e.y GROUP BY ALL) i ON i.scenario=a.scenario AND i.symbol=a.symbol AND i.y=a.y""")


def detail(m):
    return P.replay(allocations(m), m.closes, m.dividends, START, END)


@query("M09_replay", "SELECT scenario, symbol, CAST(year AS INT) AS year, strategy, lots, price, R2{value} AS value, R2{cash} AS cash, R2{income} AS income FROM replay")
def _(m):
    return rounded(detail(m), ["scenario", "symbol", "year", "strategy", "lots", "price"], 2)


@query("M09_replay_totals", "SELECT scenario, CAST(year AS INT) AS year, strategy, R1{sum(value)} AS holdings_value, R1{sum(cash)} AS cash, R1{sum(income)} AS dividend_income, R1{sum(value)+sum(cash)} AS portfolio_value FROM replay GROUP BY scenario, year, strategy")
def _(m):
    return rounded(P.replay_totals(detail(m)), ["scenario", "year", "strategy"], 1)


@query("M09_transactions", f"""
SELECT scenario, a.symbol, d0 AS date, 'Both' AS strategy, 'buy' AS activity, lots, R2{{lots*p0*100}} AS amount FROM al0 a JOIN firstbuy f ON f.symbol=a.symbol
UNION ALL SELECT scenario, a.symbol, d.date, 'No DRIP', 'dividend', lots, R2{{lots*100*dps}} FROM al0 a JOIN divev d ON d.symbol=a.symbol
UNION ALL SELECT scenario, t.symbol, d.date, 'With DRIP', 'dividend', lots-bought, R2{{pay}} FROM drip t JOIN divev d ON d.symbol=t.symbol AND d.k=t.k
UNION ALL SELECT scenario, t.symbol, d.bd, 'With DRIP', 'reinvest', bought, R2{{bought*bp*100}} FROM drip t JOIN divev d ON d.symbol=t.symbol AND d.k=t.k WHERE bought>0""")
def _(m):
    return P.replay_transactions(allocations(m), m.closes, m.dividends, START, END).withColumn("amount", rnd("amount", 2))


@query("M09_rejected", f"""
al AS (SELECT scenario, symbol FROM alloc UNION ALL SELECT DISTINCT scenario, 'UNLISTED' FROM alloc),
y AS (SELECT symbol, unnest(range({START},{END + 1})) AS y FROM (SELECT DISTINCT symbol FROM al)), g AS (SELECT y.symbol, min(y.y) AS y FROM y LEFT JOIN (SELECT DISTINCT symbol, year(date) AS y FROM prices WHERE NOT (CAST(substr(symbol,2) AS BIGINT)%10=4 AND year(date)=1999)) p ON p.symbol=y.symbol AND p.y=y.y WHERE p.y IS NULL GROUP BY y.symbol)
SELECT scenario, a.symbol, CASE WHEN y={START} THEN 'no price in {START}' ELSE 'no price through '||y END AS reason FROM al a JOIN g ON g.symbol=a.symbol""")
def _(m):
    a = allocations(m)
    unlisted = a.select("scenario").distinct().withColumn("symbol", F.lit("UNLISTED"))
    gaps = m.closes.where("not (cast(substr(symbol, 2) as long) % 10 = 4 and year(date) = 1999)")  # some stocks lack a year
    return P.replay_rejected(a.select("scenario", "symbol").unionByName(unlisted), gaps, START, END)


PLANS = [("early", 1996, 2000), ("late", 1998, 2001)]
shared("plans", " UNION ALL ".join(f"SELECT '{n}' AS scenario, symbol, {a} AS y0, {b} AS y1, 20000000.0+10000.0*sk AS initial, 2000000.0 AS topup FROM companies" for n, a, b in PLANS))
shared("mon", """
SELECT m.symbol, m.month, coalesce(p.date, l.d) AS bd, coalesce(p.close, l.c) AS price, dps, ex FROM (SELECT symbol, unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month FROM companies) m ASOF LEFT JOIN prices p ON p.symbol=m.symbol AND p.date>=m.month
LEFT JOIN (SELECT symbol, date_trunc('month', date)::DATE AS month, sum(adjDividend) AS dps, min(date) AS ex FROM dividends GROUP BY ALL) d ON d.symbol=m.symbol AND d.month=m.month JOIN (SELECT symbol, max(date) AS d, arg_max(close,date) AS c FROM prices GROUP BY symbol) l ON l.symbol=m.symbol""")
shared("topup", """
SELECT p.scenario, p.symbol, y1, initial, topup, month, bd, price, floor(initial/price/100) AS bought, 0.0::DOUBLE AS income, floor(initial/price/100) AS lots, initial-floor(initial/price/100)*price*100 AS cash FROM plans p JOIN mon m ON m.symbol=p.symbol AND m.month=make_date(y0,1,1)
UNION ALL SELECT scenario, symbol, y1, initial, topup, month, bd, price, n, ep + CASE WHEN late THEN floor(dps*(lots+n)*100) ELSE 0 END, lots+n, cash+topup+ep-n*price*100 + CASE WHEN late THEN floor(dps*(lots+n)*100) ELSE 0 END FROM
 (SELECT *, floor((cash+topup+ep)/price/100) AS n FROM (SELECT t.scenario, t.symbol, y1, initial, topup, t.lots, t.cash, m.month, m.bd, m.price, coalesce(m.dps,0) AS dps, coalesce(m.bd<m.ex,false) AS late, CASE WHEN coalesce(m.bd<m.ex,false) THEN 0 ELSE floor(coalesce(m.dps,0)*t.lots*100) END AS ep
  FROM topup t JOIN mon m ON m.symbol=t.symbol AND m.month=(t.month + INTERVAL 1 MONTH)::DATE WHERE year(m.month)<=t.y1))""")


def topup(m):
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("start_year"), F.lit(b).alias("end_year")) for n, a, b in PLANS]))
    plans = m.companies.select("symbol", "sk", cells.alias("c")).select("c.*", "symbol", (20000000.0 + 10000.0 * F.col("sk")).alias("initial"), F.lit(2000000.0).alias("topup"))
    return P.topup_replay(plans, m.closes, m.dividends)


@query("M10_topup_replay", "SELECT scenario, symbol, month, bd AS buy_date, price, bought, income, lots, R2{cash} AS cash FROM topup")
def _(m):
    return topup(m).select("scenario", "symbol", "month", "buy_date", "price", "bought", "income", "lots", rnd("cash", 2).alias("cash"))


@query("M11_running_position", "SELECT scenario, symbol, month, price, bought, lots AS cum_lots, R2{sum(bought*price*100) OVER (PARTITION BY scenario, symbol ORDER BY month)} AS cum_cost, R2{lots*price*100} AS market_value FROM topup")
def _(m):
    return rounded(P.running_position(topup(m)), ["scenario", "symbol", "month", "price", "bought", "cum_lots"], 2)


@query("M11_topup_summary", """
g AS (SELECT scenario, symbol, sum(bought*price*100) AS cc, arg_max(price,month)*arg_max(lots,month)*100 AS mv, any_value(initial)+(count(*)-1)*any_value(topup) AS inv, sum(income) AS td, arg_max(lots,month) AS lots, avg(price) AS ap FROM topup GROUP BY ALL),
l AS (SELECT scenario, symbol, arg_max(i,y) AS li FROM (SELECT scenario, symbol, year(month) AS y, sum(income) AS i FROM topup GROUP BY ALL) WHERE i>0 GROUP BY ALL)
SELECT g.scenario, g.symbol, R1{cc} AS cum_cost, R1{mv} AS market_value, R1{inv} AS total_invested, R1{td} AS total_dividends, lots, floor(td/(ap*100)) AS bonus_lots, R6{coalesce(li,0)/inv*100} AS yield_on_cost, R6{(mv/inv-1)*100} AS total_return FROM g LEFT JOIN l ON g.scenario=l.scenario AND g.symbol=l.symbol""")
def _(m):
    return rounded(P.topup_summary(topup(m)), ["scenario", "symbol", "lots", "bonus_lots"], 1, yield_on_cost=6, total_return=6)


@query("M12_simple_compounding", """
p AS (SELECT c_custkey AS scenario, floor(abs(c_acctbal)*1000) AS b, 1+c_custkey%25 AS yrs, (c_custkey%12)/100 AS rate FROM customer),
c AS (SELECT scenario, yrs, rate, 1::BIGINT AS year, floor(b*rate) AS income, b+floor(b*rate) AS balance FROM p UNION ALL SELECT scenario, yrs, rate, year+1, floor(balance*rate), balance+floor(balance*rate) FROM c WHERE year<yrs)
SELECT scenario, CAST(year AS INT) AS year, income, balance FROM c""")
def _(m):
    k = F.col("c_custkey")
    plans = m.table("customer").select(k.alias("scenario"), F.floor(F.abs("c_acctbal") * 1000).cast("double").alias("initial"), (1 + k % 25).alias("years"), ((k % 12) / 100).alias("rate"))
    return P.simple_compounding(plans)


@query("M13_replay_summary", f"""
t AS (SELECT scenario, strategy, year, sum(value)+sum(cash) AS pv, sum(cash) AS cash, sum(income) AS inc FROM replay GROUP BY ALL), a AS (SELECT scenario, sum(amount) AS cap FROM alloc WHERE symbol IN (SELECT symbol FROM al0) GROUP BY scenario)
SELECT t.scenario, strategy, R1{{arg_max(pv,year)}} AS final_value, R1{{sum(inc)}} AS total_income, R6{{arg_max(inc,year)/any_value(cap)*100}} AS yield_on_cost, R1{{arg_max(cash,year)}} AS residual_cash FROM t JOIN a ON a.scenario=t.scenario GROUP BY t.scenario, strategy""")
def _(m):
    rows = detail(m)
    return rounded(P.replay_summary(P.replay_totals(rows), P.entered(allocations(m), rows)), ["scenario", "strategy"], 1, yield_on_cost=6)
