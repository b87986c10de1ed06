"""Aggregation queries."""

from pyspark.sql import functions as F

from ..functions.ranking import distribution
from ..functions.scalars import rnd, row_mean, sdiv
from ..operators import dividends as D
from ..operators import fundamentals as U
from ..operators import returns as R
from ..operators import screens as X
from ..sources.readers import parse_logs
from .q_dividends import rate, scores
from .q_fundamentals import rounded
from .registry import query


@query("D01_sum_by_key", "SELECT stock, sum(total) AS total, count(*) AS payments FROM payments GROUP BY stock")
def _(m):
    return m.payments.groupBy("stock").agg(F.sum("total").alias("total"), F.count("*").alias("payments"))


@query("D02_distribution", """
SELECT month(date) AS month, count(*) AS n, R6{avg(adjDividend)} AS mean, R5{stddev_samp(adjDividend)} AS std, R6{quantile_cont(adjDividend,0.25)} AS q25, R6{median(adjDividend)} AS median, R6{quantile_cont(adjDividend,0.75)} AS q75 FROM dividends GROUP BY 1""")
def _(m):
    d = distribution(m.dividends.withColumn("month", F.month("date")), "adjDividend", ["month"], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return rounded(d, ["month", "n"], 6, std=5)


@query("D03_weighted_mean", "SELECT sector, R6{CASE WHEN sum(mktCap) FILTER (WHERE mktCap>0 AND yield IS NOT NULL)>0 THEN sum(yield*mktCap) FILTER (WHERE mktCap>0)/sum(CAST(mktCap AS DOUBLE)) FILTER (WHERE mktCap>0 AND yield IS NOT NULL) ELSE avg(yield) END} AS weighted_mean FROM scores GROUP BY sector")
def _(m):
    return X.weighted_mean(scores(m), ["sector"], "yield", "mktCap").withColumn("weighted_mean", rnd("weighted_mean"))


def _node(level, path, by, edges=None):
    grad = "CASE " + " ".join(f"WHEN color<={e} THEN {i * (100.0 / len(edges))!r}::DOUBLE" for i, e in enumerate(edges)) + " ELSE 100 END" if edges else "CASE WHEN color<=-50 THEN 0 WHEN color<=-25 THEN 12.5 WHEN color<=-10 THEN 25 WHEN color<=-5 THEN 37.5 WHEN color<=5 THEN 50 WHEN color<=10 THEN 62.5 WHEN color<=25 THEN 75 WHEN color<=50 THEN 87.5 ELSE 100 END"
    return f"SELECT level, path, R0{{size}} AS size, R6{{color}} AS color, CAST({grad} AS DOUBLE) AS color_grad FROM (SELECT '{level}' AS level, {path} AS path, sum(s) AS size, CASE WHEN sum(s)>0 THEN sum(s*c)/sum(s) ELSE avg(c) END AS color FROM n {by})"


@query("D04_hierarchy", "n AS (SELECT sector, industry, symbol, CAST(mktCap AS DOUBLE) AS s, return_1y*100 AS c FROM scores WHERE return_1y IS NOT NULL) " + " UNION ALL ".join([
    _node("all", "'ALL'", ""), _node("sector", "sector", "GROUP BY sector"), _node("industry", "sector||'/'||industry", "GROUP BY sector, industry"),
    _node("stock", "sector||'/'||industry||'/'||symbol", "GROUP BY sector, industry, symbol")]))
def _(m):
    d = scores(m).withColumn("ret", F.col("return_1y") * 100)
    return rounded(X.hierarchy(d, "mktCap", "ret", X.RETURN_THRESHOLDS["1Y"]), ["level", "path", "color_grad"], 6, size=0)


def _nodes(edges=None):
    return " UNION ALL ".join([
        _node("all", "'ALL'", "", edges), _node("sector", "sector", "GROUP BY sector", edges), _node("industry", "sector||'/'||industry", "GROUP BY sector, industry", edges),
        _node("stock", "sector||'/'||industry||'/'||symbol", "GROUP BY sector, industry, symbol", edges)])


def _metric_hierarchy(name, column, scale, edges):
    @query(f"D04_hierarchy_{name}", f"n AS (SELECT sector, industry, symbol, CAST(mktCap AS DOUBLE) AS s, {column}*{scale} AS c FROM scores WHERE {column} IS NOT NULL) " + _nodes(edges))
    def _(m):
        d = scores(m).withColumn("metric", F.col(column) * scale)
        return rounded(X.hierarchy(d, "mktCap", "metric", edges), ["level", "path", "color_grad"], 6, size=0)


_metric_hierarchy("pe", "peRatio", 1, X.METRIC_THRESHOLDS["PE"])
_metric_hierarchy("ps", "psRatio", 1, X.METRIC_THRESHOLDS["PS"])
_metric_hierarchy("yield", "yield", 1, X.METRIC_THRESHOLDS["yield"])


@query("D05_distinct_counts", "SELECT source, count(DISTINCT visitor) AS visitors, count(DISTINCT page) AS pages, count(*) AS visits FROM parsed WHERE kind='visit' GROUP BY source")
def _(m):
    v = parse_logs(m.logs).where("kind = 'visit'")
    return v.groupBy("source").agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("page").alias("pages"), F.count("*").alias("visits"))


@query("D06_payout_frequency", """
f AS (SELECT symbol, least(count(DISTINCT date),4) AS k FROM dividends WHERE year(date)=2000 GROUP BY symbol), l AS (SELECT * FROM (VALUES (1,'Once per year'),(2,'Twice per year'),(3,'Thrice per year'),(4,'4 times per year')) l(k, frequency))
SELECT frequency, count(symbol) AS count, 0 AS chunk, coalesce(string_agg(symbol, ', ' ORDER BY symbol),'') AS stocks FROM l LEFT JOIN f ON l.k=f.k GROUP BY frequency""")
def _(m):
    return X.payout_frequency(m.dividends.where("year(date) = 2000"))


CAL = "c AS (SELECT d.symbol, d.date, adjDividend/price*100 AS y FROM dividends d JOIN profiles p ON d.symbol=p.symbol WHERE year(d.date)=2000)"


def cal(m):
    return D.calendar(m.dividends, m.profiles, 2000).withColumn("y", sdiv("adjDividend", "price") * 100)


@query("D07_month_summary", CAL + " SELECT month(date) AS month, R6{avg(y)} AS avg_yield, count(y) AS events FROM c GROUP BY 1")
def _(m):
    return cal(m).groupBy(F.month("date").alias("month")).agg(rnd(F.avg("y")).alias("avg_yield"), F.count("y").alias("events"))


@query("D07_day_summary", CAL + " SELECT day(date) AS day, R6{avg(y)} AS avg_yield, count(y) AS events FROM c WHERE month(date) BETWEEN 7 AND 9 GROUP BY 1")
def _(m):
    return cal(m).where("month(date) between 7 and 9").groupBy(F.dayofmonth("date").alias("day")).agg(rnd(F.avg("y")).alias("avg_yield"), F.count("y").alias("events"))


@query("D08_arg_max", CAL + " SELECT month(date) AS month, arg_min(symbol, struct_pack(v := -y, s := symbol)) AS symbol, R6{max(y)} AS value FROM c GROUP BY 1")
def _(m):
    return X.arg_extreme(cal(m).withColumn("month", F.month("date")), ["month"], "y", "symbol", ["symbol"]).withColumn("value", rnd("value"))


@query("D09_breadth", """
SELECT date, count(*) AS reporting, greatest((SELECT count(*) FROM companies)-count(*),0) AS unavailable, R6{count(*)*100.0/(SELECT count(*) FROM companies)} AS coverage_pct, count(*) FILTER (WHERE r>0) AS gainers, count(*) FILTER (WHERE r<0) AS losers, count(*) FILTER (WHERE r=0) AS flat,
 R6{avg(r)} AS avg_return, R6{median(r)} AS median_return, R6{count(*) FILTER (WHERE r>0)*100.0/count(*)} AS breadth_pct FROM (SELECT date, return_1d_pct AS r FROM sess WHERE return_1d_pct IS NOT NULL) GROUP BY date""")
def _(m):
    d = X.breadth(R.session_returns_all(m.closes), m.companies)
    return rounded(d, ["date", "reporting", "unavailable", "gainers", "losers", "flat"])


@query("D10_histogram", """
q AS (SELECT quantile_cont(return_1d_pct,0.02) AS a, quantile_cont(return_1d_pct,0.98) AS b FROM sess), k AS (SELECT return_1d_pct AS v FROM sess, q WHERE return_1d_pct BETWEEN a AND b), g AS (SELECT min(v) AS lo, max(v) AS hi FROM k),
c AS (SELECT least(floor((v-lo)*50/(hi-lo)),49) AS bin, count(*) AS n FROM k, g GROUP BY 1)
SELECT CAST(i AS INT) AS bin, R6{lo+(i+0.5)*(hi-lo)/50} AS centre, coalesce(n,0) AS count FROM generate_series(0,49) s(i) CROSS JOIN g LEFT JOIN c ON c.bin=i""")
def _(m):
    return X.histogram(R.session_returns_all(m.closes), "return_1d_pct").withColumn("centre", rnd("centre"))


@query("D10_unit_histogram", "SELECT CAST(floor(y) AS BIGINT) AS bin_min, count(*) AS count FROM (SELECT adjDividend/price*100 AS y FROM dividends d JOIN profiles p ON p.symbol=d.symbol WHERE year(d.date)=2000) GROUP BY 1")
def _(m):
    return X.unit_histogram(cal(m), "y")


@query("D11_row_mean", "SELECT symbol, R4{list_avg([last_1y_mean,last_3y_mean,last_5y_mean])} AS avg_pe FROM pestats")
def _(m):
    d = U.pe_stats(U.pe_history(m.closes, m.financials, rate(m)))
    return d.select("symbol", rnd(row_mean("last_1y_mean", "last_3y_mean", "last_5y_mean"), 4).alias("avg_pe"))


@query("D12_trimmed_mean", """
r AS (SELECT symbol, rg, row_number() OVER (PARTITION BY symbol ORDER BY rg) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ttm WHERE rg IS NOT NULL)
SELECT symbol, R6{avg(rg)} AS trimmed_mean FROM r WHERE k>floor(n*0.1) AND k<=n-floor(n*0.1) GROUP BY symbol""")
def _(m):
    t = U.trailing(m.financials)
    return t.groupBy("symbol").agg(rnd(U.trimmed_mean(F.collect_list("revenue_growth"))).alias("trimmed_mean"))


@query("D13_feature_stats", """
x AS (SELECT p.symbol, p.close*p.volume AS v, r.pe, lead(p.close) OVER w/nullif(lead(p.close,2) OVER w,0)-1 AS r1, p.close > lag(p.close) OVER w * 1.04 AS buy FROM prices p JOIN pehist r ON r.symbol=p.symbol AND r.date=p.date WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date))
SELECT symbol, count(*) FILTER (WHERE buy) AS count_entry_labels, R2{avg(v)} AS avg_value, R4{avg(pe)} AS avg_pe, R6{avg(r1)*100} AS avg_daily_return FROM x GROUP BY symbol""")
def _(m):
    from ..operators.mlprep import feature_stats, forward_returns

    pe = U.pe_history(m.closes, m.financials, rate(m)).select("symbol", "date", "pe")
    sig = F.when(F.col("close") > F.lag("close").over(R.by_symbol()) * 1.04, "buy").otherwise("hold")
    d = forward_returns(m.prices.withColumn("trade_signal", sig)).join(pe, ["symbol", "date"])
    return rounded(feature_stats(d), ["symbol", "count_entry_labels"], 6, avg_value=2, avg_pe=4)
