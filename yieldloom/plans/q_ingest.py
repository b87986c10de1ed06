"""Source, ingest, sink and set-operation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..session import scratch_path
from ..sources import clean as C
from ..sources import readers as I
from ..sources import sinks as K
from ..streaming import ingest as S
from .oracle import shared
from .q_fundamentals import rounded
from .registry import query


@query("A01_scan_parquet", "SELECT l_orderkey, l_quantity, CAST(l_shipdate AS DATE) AS shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity < 5")
def _(m):
    d = m.table("lineitem").where("l_shipdate >= timestamp'2000-01-01' and l_quantity < 5")
    return d.select("l_orderkey", "l_quantity", F.col("l_shipdate").cast("date").alias("shipdate"))


@query("A02_compliance_csv", 'SELECT CAST(no AS INT) AS no, kode, nama FROM compliant')
def _(m):
    path = scratch_path(m.spark, "compliance")
    rows = m.compliant.select(F.col("`No.`").alias("﻿No."), "Kode", "Nama Emiten", F.lit(None).cast("string").alias("Keterangan"))
    rows.write.csv(path, sep=";", header=True)
    return I.read_compliance_csv(m.spark, path).select(F.col("`No.`").alias("no"), F.col("Kode").alias("kode"), F.col("Nama Emiten").alias("nama"))


@query("A03_dividend_csv", "SELECT symbol, date, adjDividend, dividend_type, CAST(year(date) AS VARCHAR) AS year FROM dividends")
def _(m):
    path = scratch_path(m.spark, "dividends")
    d = m.dividends.select("symbol", F.col("date").alias("ex_date"), F.col("adjDividend").alias("dividend"), "dividend_type", F.year("date").alias("year"))
    d.write.partitionBy("year").csv(path, header=True)
    return I.read_dividend_csv(m.spark, path, r"year=(\d+)/", "year")


@query("A03_portfolio_csv", "SELECT symbol, printf('%d', CAST(lots AS BIGINT)) AS lots, printf('%d', CAST(avg_price AS BIGINT)) AS avg_price FROM holdings")
def _(m):
    path = scratch_path(m.spark, "portfolio")
    h = m.holdings.select(F.col("symbol").alias("Symbol"), F.col("lots").cast("long").alias("Available Lot"), F.col("avg_price").cast("long").alias("Average Price"))
    h.write.csv(path, header=True)
    return I.read_portfolio_csv(m.spark, path).toDF("symbol", "lots", "avg_price")


def _rows(df, *cols):
    """One symbol's history as an array: at most one element per day."""
    return df.groupBy("symbol").agg(F.collect_list(F.struct(*cols)).alias("rows"))


@query("A04_json_envelopes", "SELECT symbol, DATE '2001-11-30' AS updated, date, close FROM prices")
def _(m):
    env = F.to_json(F.struct(F.lit("2001-11-30").alias("date"), F.to_json("rows").alias("content")))
    return I.decode_envelopes(_rows(m.closes, "date", "close").select("symbol", env.alias("payload")), "date: date, close: double")


@query("A05_flatten_histories", "SELECT symbol, date, adjDividend FROM dividends")
def _(m):
    h = _rows(m.dividends, "date", "adjDividend").withColumnRenamed("rows", "historical").withColumn("k", F.expr("substr(symbol, 2)").cast("long"))
    single = h.where("k % 2 = 0").select(F.to_json(F.struct("symbol", "historical")).alias("payload"))
    many = h.where("k % 2 = 1").groupBy(F.floor(F.col("k") / 10)).agg(F.collect_list(F.struct("symbol", "historical")).alias("historicalStockList"))  # five symbols a page
    both = single.unionByName(many.select(F.to_json(F.struct("historicalStockList")).alias("payload")))
    return I.flatten_histories(both, "date: date, adjDividend: double")


shared("rawpx", """
SELECT symbol, CASE WHEN l_orderkey%41=0 THEN 'bad-date' ELSE CAST(date AS VARCHAR) END AS date, CASE WHEN l_orderkey%37=0 THEN 'n/a' WHEN l_orderkey%43=0 THEN 'NaN' WHEN l_orderkey%47=0 THEN '-3' ELSE CAST((100+disc)*trend*level AS VARCHAR) END AS close, l_orderkey, l_linenumber, disc FROM prints""")


@query("A06_clean_prices", """
c AS (SELECT symbol, try_cast(date AS DATE) AS date, try_cast(close AS DOUBLE) AS close, l_orderkey, l_linenumber, disc FROM rawpx)
SELECT symbol, date, close FROM c WHERE date IS NOT NULL AND close>0 AND isfinite(close) QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey DESC, l_linenumber DESC, disc DESC)=1""")
def _(m):
    k = F.col("l_orderkey")
    date = F.when(k % 41 == 0, "bad-date").otherwise(F.col("date").cast("string"))
    close = F.when(k % 37 == 0, "n/a").when(k % 43 == 0, "NaN").when(k % 47 == 0, "-3").otherwise(((100 + F.col("disc")) * F.col("trend") * F.col("level")).cast("string"))
    raw = m.prints.select("symbol", date.alias("date"), close.alias("close"), F.struct("l_orderkey", "l_linenumber", "disc").alias("seq"))
    return C.clean_prices(raw, "seq")


@query("A07_clean_dividends", """
r AS (SELECT symbol, CASE WHEN fiscal_year%5=0 THEN '2000-02-31' ELSE CAST(date AS VARCHAR) END AS d, CASE WHEN dividend_type='special' THEN '-1' WHEN fiscal_year=1998 THEN 'x' ELSE CAST(CAST(round(adjDividend*100) AS BIGINT) AS VARCHAR) END AS v FROM dividends)
SELECT symbol, CAST(d AS DATE) AS date, CAST(v AS DOUBLE) AS adjDividend FROM r WHERE try_cast(d AS DATE) IS NOT NULL AND try_cast(v AS DOUBLE)>=0""")
def _(m):
    y = F.col("fiscal_year")
    v = F.when(F.col("dividend_type") == "special", "-1").when(y == 1998, "x").otherwise(F.round(F.col("adjDividend") * 100).cast("long").cast("string"))
    return C.clean_dividends(m.dividends.select("symbol", F.when(y % 5 == 0, "2000-02-31").otherwise(F.col("date").cast("string")).alias("date"), v.alias("adjDividend")))


@query("A08_clean_financials", """
r AS (SELECT symbol, CASE WHEN period='Q2' AND calendarYear=1999 THEN '' ELSE CAST(date AS VARCHAR) END AS d, CASE WHEN period='Q1' AND calendarYear%3=0 THEN NULL ELSE revenue END AS r, netIncome, reportedCurrency FROM financials)
SELECT symbol, CAST(d AS DATE) AS date, r AS revenue, netIncome, reportedCurrency FROM r WHERE d<>'' AND r IS NOT NULL""")
def _(m):
    q, y = F.col("period"), F.col("calendarYear")
    raw = m.financials.select("symbol", F.when((q == "Q2") & (y == 1999), "").otherwise(F.col("date").cast("string")).alias("date"), F.when((q == "Q1") & (y % 3 == 0), F.lit(None)).otherwise(F.col("revenue")).alias("revenue"), "netIncome", "reportedCurrency")
    return C.clean_financials(raw)


@query("A09_clean_universe", "SELECT symbol, companyName, sector, mktCap, price FROM universe")
def _(m):
    again = m.profiles.withColumn("price", F.lit(0.0)).withColumn("seq", F.lit(2))
    both = m.profiles.withColumn("seq", F.lit(1)).unionByName(again)
    return C.clean_universe(both, "seq").select("symbol", "companyName", "sector", "mktCap", "price")


@query("A10_quotes", """
r AS (SELECT symbol, CASE WHEN k%9=0 THEN NULL ELSE price END AS price, CASE WHEN k%4=1 THEN NULL WHEN k%8=3 THEN price ELSE changes END AS ch, CASE WHEN k%4 IN (1,2) THEN (k%7)-3.0 END AS pc FROM (SELECT *, CAST(substr(symbol,2) AS BIGINT) AS k FROM profiles)),
v AS (SELECT symbol, price AS close, CASE WHEN ch IS NOT NULL THEN price-ch ELSE price/nullif(1+pc/100,0) END AS prev, ch, pc FROM r)
SELECT symbol, close, R6{prev} AS prev_close, R6{coalesce(pc, (close/nullif(prev,0)-1)*100)} AS return_1d_pct FROM v WHERE close IS NOT NULL AND prev IS NOT NULL AND coalesce(pc, (close/nullif(prev,0)-1)*100) IS NOT NULL""")
def _(m):
    k = F.expr("substr(symbol, 2)").cast("long")
    raw = m.profiles.select(
        "symbol", F.when(k % 9 != 0, F.col("price")).alias("price"), F.when(k % 4 == 1, F.lit(None)).when(k % 8 == 3, F.col("price")).otherwise(F.col("changes")).alias("changes"),
        F.when((k % 4).isin(1, 2), (k % 7 - 3).cast("double")).alias("changesPercentage"),
    )
    return rounded(C.parse_quotes(raw), ["symbol", "close"])


@query("A11_adjusted_history", """
SELECT p.symbol, p.date, p.close, CASE WHEN day(p.date)%3=0 THEN p.close ELSE p.low END AS adjClose, coalesce(d.adjDividend,0) AS dividend FROM prices p LEFT JOIN dividends d ON d.symbol=p.symbol AND d.date=p.date WHERE p.date BETWEEN DATE '1999-01-04' AND DATE '2000-06-30'""")
def _(m):
    raw = m.prices.join(m.dividends.select("symbol", "date", F.col("adjDividend").alias("Dividends")), ["symbol", "date"], "left").select(
        "symbol", F.col("date").alias("Date"), F.col("close").alias("Close"), F.when(F.dayofmonth("date") % 3 != 0, F.col("low")).alias("Adj Close"), "Dividends")
    return C.adapt_history(raw, "1999-01-04", "2000-06-30")


UPSERT_SQL = """
e AS (SELECT symbol, date, close FROM prices WHERE date < DATE '2001-10-10'), n AS (SELECT symbol, date, close+1 AS close FROM prices WHERE date >= DATE '2001-10-03')
SELECT symbol, date, R2{close} AS close FROM n UNION ALL SELECT symbol, date, close FROM e WHERE (symbol,date) NOT IN (SELECT symbol,date FROM n)"""


@query("A12_upsert_prices", UPSERT_SQL)
def _(m):
    old = m.closes.where("date < date'2001-10-10'")
    new = m.closes.where("date >= date'2001-10-03'").withColumn("close", F.col("close") + 1)
    path = scratch_path(m.spark, "upsert")
    K.upsert_prices(m.spark, path, old.withColumn("seq", F.lit(1)))
    K.upsert_prices(m.spark, path, new.withColumn("seq", F.lit(2)))
    return K.read_prices(m.spark, path).withColumn("close", rnd("close", 2))


@query("A13_stored_range", "SELECT symbol, date, close FROM prices WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-09-30' AND symbol IN ('S000001','S000002','S000007')")
def _(m):
    path = scratch_path(m.spark, "stored")
    K.upsert_prices(m.spark, path, m.closes.withColumn("seq", F.lit(1)))
    return K.read_prices(m.spark, path, "2000-03-01", "2000-09-30", ["S000001", "S000002", "S000007"])  # opens one year of three buckets


@query("A13_range_read", "SELECT symbol, date, close FROM prices WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-09-30' AND symbol IN (SELECT symbol FROM companies WHERE industry LIKE '%1')")
def _(m):
    want = m.companies.where("industry like '%1'").select("symbol")
    return m.closes.where("date between date'2000-03-01' and date'2000-09-30'").join(want, "symbol", "left_semi")


def received(m):
    return {"financial": m.financials.where("calendarYear = 1997 and netIncome > 0 and period = 'Q1'"), "dividend": m.dividends.where("fiscal_year = 2000"), "profile": m.profiles.where("mktCap < 0")}


GOT = {"financial": "SELECT DISTINCT symbol FROM financials WHERE calendarYear=1997 AND netIncome>0 AND period='Q1'", "dividend": "SELECT DISTINCT symbol FROM dividends WHERE fiscal_year=2000", "profile": "SELECT symbol FROM profiles WHERE mktCap<0"}


@query("A14_completeness", " UNION ALL ".join(
    f"SELECT '{t}' AS type, count(*) AS total, count(g.symbol) AS succeeded, count(*)-count(g.symbol) AS failed, R6{{count(g.symbol)*100.0/count(*)}} AS success_rate, count(g.symbol)=0 AS error FROM companies c LEFT JOIN ({s}) g ON g.symbol=c.symbol" for t, s in GOT.items()))
def _(m):
    return K.completeness(m.companies, received(m)).withColumn("success_rate", rnd("success_rate"))


@query("A14_failed_symbols", "SELECT type, CAST((rn-1)//1000 AS INT) AS chunk, list(symbol ORDER BY symbol) AS failed_symbols FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY symbol) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS type, symbol FROM companies WHERE symbol NOT IN ({s})" for t, s in GOT.items()) + ")) GROUP BY ALL")
def _(m):
    return K.failed_symbols(m.companies, received(m))


@query("A15_publish_together", "SELECT symbol, date, close, adjDividend FROM prices JOIN dividends USING (symbol, date)")
def _(m):
    root = scratch_path(m.spark, "published")
    K.publish_together(m.spark, root, {"prices": m.closes, "dividends": m.dividends})
    return K.read_published(m.spark, root, "prices").join(K.read_published(m.spark, root, "dividends"), ["symbol", "date"]).select("symbol", "date", "close", "adjDividend")


@query("A16_calendar_years", "SELECT CAST(year(date) AS INT) AS year, count(*) AS events FROM dividends WHERE year(date)<>1999 GROUP BY 1")
def _(m):
    path = scratch_path(m.spark, "calendar")
    rows = m.dividends.select("date", "symbol", "adjDividend")
    K.publish_calendar(rows, path)
    K.publish_calendar(rows.where("year(date) <> 1999"), path)  # a year that has no rows any more leaves the manifest
    return K.published_years(m.spark, path)


@query("A17_csv_export", "SELECT symbol, date, close FROM prices")
def _(m):
    path = scratch_path(m.spark, "export")
    K.export_csv(m.closes, path)
    return m.spark.read.csv(path, header=True, schema="symbol string, date date, close double")


shared("stmt", """
SELECT holder, CAST(floor(sk/20) AS BIGINT) AS page, holder%25=4 AS cut, symbol, CAST(lots AS BIGINT) AS lots, CAST(avg_price AS BIGINT) AS price FROM holdings h JOIN companies USING (symbol)""")


def statements(m):
    h = m.holdings.withColumn("page", F.floor(F.expr("substr(symbol, 2)").cast("long") / 20))
    row = F.concat_ws("\t", "symbol", F.col("lots").cast("long").cast("string"), F.lit("1"), F.col("avg_price").cast("long").cast("string"), F.lit("a b c d e f g"))
    g = h.groupBy("holder", "page").agg(F.concat_ws(" \n ", F.collect_list(row)).alias("text"))  # a page shows at most twenty stocks
    return g.withColumn("text", F.when(F.col("holder") % 25 == 4, F.concat("text", F.lit(" stray"))).otherwise(F.concat(F.lit("  "), "text")))


@query("A18_pasted_holdings", 'SELECT holder, page, symbol AS "Symbol", CAST(lots AS VARCHAR) AS "Available Lot", CAST(price AS VARCHAR) AS "Average Price" FROM stmt WHERE NOT cut')
def _(m):
    return I.parse_pasted_holdings(statements(m))[0]


@query("A18_rejected_statements", "SELECT holder, page, CAST(count(*)*11+1 AS INT) AS fields FROM stmt WHERE cut GROUP BY holder, page")
def _(m):
    return I.parse_pasted_holdings(statements(m))[1]


@query("A19_broker_history", """
SELECT l_orderkey, stock, CAST(lot AS DOUBLE) AS lot, CAST(CAST(dividend*100 AS BIGINT) AS DOUBLE) AS dividend, total, date FROM payments""")
def _(m):
    fill = lambda n: F.lit("\n" + "\n".join(["-"] * n) + "\n")
    text = F.concat(
        F.lit("header\nDIVIDEND "), "stock", F.lit(" cash"), fill(1), F.col("lot").cast("string"), fill(1), F.round(F.col("dividend") * 100).cast("long").cast("string"), fill(1),
        F.format_number("total", 0), fill(7), F.date_format("date", "d MMM yyyy"), F.lit("\nend"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", text.alias("text"))))  # a statement holds the few payments of an order
    statements = m.payments.groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    rec = I.payments_from_history(I.parse_broker_history(statements))
    return rec.select("l_orderkey", "stock", F.col("lot_n").alias("lot"), F.col("dividend_n").alias("dividend"), F.col("total_n").alias("total"), F.col("pay_date").alias("date"))


shared("parsed", r"""
SELECT event_id, kind, CASE WHEN kind='visit' THEN trim(regexp_extract(line, 'VISIT \| visitor=(.*?) \| page=(.*?) \| source=(.*?) \|', 1)) END AS visitor, CASE WHEN kind='visit' THEN trim(regexp_extract(line, 'VISIT \| visitor=(.*?) \| page=(.*?) \| source=(.*?) \|', 2)) END AS page,
 CASE WHEN kind='visit' THEN trim(regexp_extract(line, 'VISIT \| visitor=(.*?) \| page=(.*?) \| source=(.*?) \|', 3)) END AS source, CASE WHEN kind='fetch' THEN CAST(coalesce(nullif(regexp_extract(line, 'redis get .* took ([\d\.]+) seconds', 1),''), regexp_extract(line, 'get redis key:.*total time: ([\d\.]+) seconds', 1)) AS DOUBLE) END AS seconds,
 CASE WHEN kind='download' THEN trim(regexp_extract(line, 'Total download time for (.*?):', 1)) END AS stock
FROM (SELECT *, CASE WHEN line LIKE '%VISIT |%' THEN 'visit' WHEN line LIKE '%redis%' THEN 'fetch' WHEN line LIKE '%use_container_width%' THEN 'deprecation' WHEN line LIKE '%already connected!%' THEN 'reconnect' WHEN line LIKE '%Total download time for%' THEN 'download' END AS kind FROM logs)""")


@query("A20_parse_logs", "SELECT * FROM parsed")
def _(m):
    return I.parse_logs(m.logs)


@query("A21_digest")
def _(m):
    return I.frame_digest(m.prices)


@query("A21_digest_changes", "SELECT count(*) AS rows, true AS same_in_any_order, true AS changes_with_an_edit, false AS changes_with_nothing FROM prices")
def _(m):
    one = lambda d, n: I.frame_digest(d).select("rows", F.struct("xor", "total").alias(n))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) == 1
    edit = m.prices.withColumn("close", F.col("close") + F.when((F.col("symbol") == "S000001") & first, 0.01).otherwise(0.0))
    same = m.prices.withColumn("close", F.col("close") + 0.0)
    j = one(m.prices, "a").crossJoin(one(m.prices.orderBy(F.desc("date"), "symbol"), "b").drop("rows")).crossJoin(one(edit, "c").drop("rows")).crossJoin(one(same, "d").drop("rows"))  # single rows
    return j.select("rows", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("changes_with_an_edit"), (F.col("a") != F.col("d")).alias("changes_with_nothing"))


EDITED = "SELECT symbol, date, open, high, low, CASE WHEN symbol='S000001' AND date=(SELECT min(date) FROM prices WHERE symbol='S000001') THEN close+0.01 ELSE close END AS close, \"adjClose\", volume FROM prices WHERE NOT (symbol='S000002' AND date<DATE '1995-01-01')"


def edited(m):
    """The prices after a correction, a withdrawn stretch and a symbol that was not there before."""
    first = m.prices.where("symbol = 'S000001'").agg(F.min("date").alias("_first"))
    d = m.prices.crossJoin(F.broadcast(first)).where("not (symbol = 'S000002' and date < date'1995-01-01')")  # a single row
    d = d.withColumn("close", F.when((F.col("symbol") == "S000001") & (F.col("date") == F.col("_first")), F.col("close") + 0.01).otherwise(F.col("close"))).drop("_first")
    return d.unionByName(m.prices.where("symbol = 'S000003'").withColumn("symbol", F.lit("NEW")))


@query("A21_changed_parts", """
p AS (SELECT symbol, date_trunc('month', date)::DATE AS month, min(date) AS d FROM prices GROUP BY ALL)
SELECT symbol, month, 'edited' AS change FROM p WHERE symbol='S000001' AND d=(SELECT min(date) FROM prices WHERE symbol='S000001')
UNION ALL SELECT symbol, month, 'removed' FROM p WHERE symbol='S000002' AND month<DATE '1995-01-01' UNION ALL SELECT 'NEW', month, 'added' FROM p WHERE symbol='S000003'""")
def _(m):
    return I.changed_parts(I.digest_parts(m.prices), I.digest_parts(edited(m)), ["symbol", "month"])


@query("A21_digest_roll_up", "SELECT symbol, count(*) AS rows, true AS same_as_whole FROM prices GROUP BY symbol")
def _(m):
    parts = I.digest_parts(m.prices)
    whole = I.frame_digest(m.prices).select(F.struct("xor", "total").alias("_w"))
    again = I.roll_up(I.roll_up(parts, "symbol")).select(F.struct("xor", "total").alias("_a"))
    same = whole.crossJoin(again).select((F.struct("_w.xor", F.col("_w.total").cast("decimal(38,0)")) == F.struct("_a.xor", "_a.total")).alias("same_as_whole"))  # single rows
    return I.roll_up(parts, "symbol").select("symbol", "rows").crossJoin(F.broadcast(same))


@query("A21_refreshed_result", f"""
e AS ({EDITED} UNION ALL SELECT 'NEW', date, open, high, low, close, "adjClose", volume FROM prices WHERE symbol='S000003')
SELECT symbol, count(*) AS days, R4{{avg(close)}} AS mean FROM e GROUP BY symbol""")
def _(m):
    from ..session import cut_lineage

    stats = lambda d: d.groupBy("symbol").agg(F.count("*").alias("days"), rnd(F.avg("close"), 4).alias("mean"))
    old, now = cut_lineage(stats(m.prices)), edited(m)
    return I.refresh(old, now, I.changed_parts(I.digest_parts(m.prices), I.digest_parts(now), ["symbol", "month"]), stats)


@query("A22_statement_rates", """
s AS (SELECT symbol, date, reportedCurrency FROM financials UNION ALL SELECT symbol||'-P', (date-INTERVAL 20 YEAR)::DATE, reportedCurrency FROM financials)
SELECT s.symbol, s.date, s.reportedCurrency, CASE WHEN s.reportedCurrency='USD' THEN coalesce(x.close, 16618.0) ELSE 1 END AS rate FROM s ASOF LEFT JOIN fx x ON s.date>=x.date""")
def _(m):
    own = m.financials.select("symbol", "date", "reportedCurrency")
    before = own.select(F.concat("symbol", F.lit("-P")).alias("symbol"), F.add_months("date", -240).alias("date"), "reportedCurrency")  # older than any quote
    return I.statement_rates(own.unionByName(before), m.fx)


@query("A23_long_series", "SELECT symbol, date, close FROM prices UNION ALL SELECT 'INDEX-'||index, date, close FROM index_prices UNION ALL SELECT 'USDIDR', date, close FROM fx")
def _(m):
    idx = m.index_prices.select(F.concat(F.lit("INDEX-"), "index").alias("symbol"), "date", "close")
    return I.union_series({"stocks": m.closes, "index": idx, "USDIDR": m.fx.drop("pair")})


@query("H01_union_by_name", "SELECT symbol, date, close, NULL AS adjDividend FROM prices UNION ALL SELECT symbol, date, NULL, adjDividend FROM dividends")
def _(m):
    return m.closes.unionByName(m.dividends.select("symbol", "date", "adjDividend"), allowMissingColumns=True)


@query("H02_distinct_keep", """
SELECT symbol, arg_min(flag, k) AS first_flag, arg_max(flag, k) AS last_flag FROM (SELECT symbol, flag, l_orderkey*1000+l_linenumber*100+qty AS k FROM prints) GROUP BY symbol HAVING count(*)>0""")
def _(m):
    p = m.prints.select("symbol", "flag", (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("qty")).alias("k"))
    return K.keep_one(p, ["symbol"], "k", last=False).withColumnRenamed("flag", "first_flag").join(K.keep_one(p, ["symbol"], "k").withColumnRenamed("flag", "last_flag"), "symbol")


@query("H03_set_difference", "SELECT symbol, date FROM prices WHERE (symbol, date) NOT IN (SELECT symbol, date FROM dividends)")
def _(m):
    return m.closes.select("symbol", "date").join(m.dividends.select("symbol", "date"), ["symbol", "date"], "left_anti")


@query("S01_stream_ingest", UPSERT_SQL)
def _(m):
    root = scratch_path(m.spark, "ingest")
    first = m.closes.where("date < date'2001-10-10'").withColumn("seq", F.lit(1).cast("long"))
    fixes = m.closes.where("date >= date'2001-10-03'").select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(2).cast("long").alias("seq"))
    for landed in (first, fixes):  # two nightly deliveries, each ingested as it lands
        landed.write.mode("append").parquet(f"{root}/in")
        S.ingest_prices(m.spark, f"{root}/in", f"{root}/table", f"{root}/state")
    return K.read_prices(m.spark, f"{root}/table").select("symbol", "date", rnd("close", 2).alias("close"))


MODES_SQL = """
f AS (SELECT symbol, date, close FROM prices JOIN companies USING (symbol) WHERE bal%4<>1 AND date BETWEEN DATE '1996-01-01' AND DATE '2001-10-09'), mk AS (SELECT symbol, max(date) AS d FROM f GROUP BY symbol),
s AS (SELECT p.symbol, p.date, p.close+1 AS close FROM prices p LEFT JOIN mk USING (symbol) WHERE p.date<=DATE '2001-10-20' AND p.date>=CASE WHEN mk.d IS NULL THEN DATE '1996-01-01' ELSE greatest(DATE '1996-01-01', least(DATE '2001-10-13', mk.d)) END)"""


def two_runs(m):
    """A backfill that some companies failed, then an incremental run that has everything: gaps are closed, old rows stay."""
    path = scratch_path(m.spark, "modes")
    full = m.closes.withColumn("seq", F.lit(1).cast("long"))
    ok = m.companies.where("bal % 4 <> 1").select("symbol")
    a = K.ingest_delivery(m.spark, path, m.companies, full.join(ok, "symbol", "left_semi"), "backfill", "2001-10-09", start="1996-01-01")
    b = K.ingest_delivery(m.spark, path, m.companies, full.withColumn("close", F.col("close") + 1), "incremental", "2001-10-20", start="1996-01-01")
    return path, a.unionByName(b)


@query("S01_ingest_modes", MODES_SQL + "SELECT symbol, date, R2{close} AS close FROM s UNION ALL SELECT symbol, date, close FROM f WHERE (symbol, date) NOT IN (SELECT symbol, date FROM s)")
def _(m):
    return K.read_prices(m.spark, two_runs(m)[0]).withColumn("close", rnd("close", 2))


@query("S01_ingest_summary", MODES_SQL + """
SELECT 'backfill' AS mode, (SELECT count(*) FROM companies) AS symbols_total, count(DISTINCT symbol) AS symbols_succeeded, (SELECT count(*) FROM companies)-count(DISTINCT symbol) AS symbols_failed, count(*) AS rows_upserted FROM f
UNION ALL SELECT 'incremental', (SELECT count(*) FROM companies), count(DISTINCT symbol), (SELECT count(*) FROM companies)-count(DISTINCT symbol), count(*) FROM s""")
def _(m):
    return two_runs(m)[1]


@query("S02_stream_quotes", """
q AS (SELECT symbol, date, close, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS prev FROM prices)
SELECT symbol, max(date) AS day, arg_max(close,date) AS price, R6{(arg_max(close/prev,date)-1)*100} AS return_1d_pct FROM q GROUP BY symbol""")
def _(m):
    from ..operators.returns import by_symbol

    root = scratch_path(m.spark, "quotes")
    q = m.closes.select("symbol", F.col("date").cast("timestamp").alias("ts"), F.col("close").alias("price"), F.coalesce(F.lag("close").over(by_symbol()), "close").alias("prev_close"))
    q.repartition(4).write.parquet(f"{root}/in")
    S.run_latest_quotes(m.spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=2)
    d = S.read_latest_quotes(m.spark, f"{root}/out")
    return d.select("symbol", F.col("ts").cast("date").alias("day"), "price", rnd("return_1d_pct").alias("return_1d_pct"))
