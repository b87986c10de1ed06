"""Join queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd, sdiv
from ..operators import asof as A
from ..operators import dividends as D
from ..operators import events as E
from ..operators import portfolio as P
from ..operators import returns as R
from ..operators import strategy as S
from .market import ASOF, without_partner
from .q_dividends import rate, scores
from .q_fundamentals import rounded
from .registry import query


@query("C01_compliance_flag", "SELECT symbol, c.kode IS NOT NULL AS is_syariah FROM profiles p LEFT JOIN compliant c ON c.kode=p.symbol")
def _(m):
    listed = m.compliant.select(F.col("Kode").alias("symbol"), F.lit(True).alias("_c"))
    return m.profiles.join(listed, "symbol", "left").select("symbol", F.col("_c").isNotNull().alias("is_syariah"))


@query("C02_calendar_price", "SELECT d.date, d.symbol, adjDividend, price, R6{adjDividend/price*100} AS yield FROM dividends d JOIN profiles p ON d.symbol=p.symbol WHERE year(d.date)=2001")
def _(m):
    return D.calendar(m.dividends, m.profiles, 2001).withColumn("yield", rnd(sdiv("adjDividend", "price") * 100))


@query("C03_score_returns", """
s AS (SELECT symbol, DScore FROM scores UNION ALL SELECT symbol||'-W', DScore FROM scores), l AS (SELECT symbol, price FROM profiles WHERE isActivelyTrading UNION ALL SELECT symbol||'-W', price FROM profiles WHERE isActivelyTrading)
SELECT s.symbol, R4{DScore} AS DScore, R6{r.return_7d} AS live_7d, l.price AS live_price FROM s LEFT JOIN returns r ON r.symbol=s.symbol JOIN l ON l.symbol=s.symbol""")
def _(m):
    live = without_partner(m.profiles.where("isActivelyTrading").select("symbol", F.col("price").alias("live_price")), "-W")  # lines that never traded
    late = R.latest_returns(m.prices).select("symbol", F.col("return_7d").alias("live_7d"))
    return without_partner(scores(m).select("symbol", "DScore"), "-W").join(late, "symbol", "left").join(live, "symbol").select("symbol", rnd("DScore", 4).alias("DScore"), rnd("live_7d").alias("live_7d"), "live_price")


@query("C04_holdings_market", """
h AS (SELECT holder, symbol FROM holdings UNION ALL SELECT holder, symbol||'-X' FROM holdings)
SELECT holder, h.symbol, CASE WHEN p.symbol IS NULL THEN 'unknown' ELSE 'matched' END AS state, p.price AS last_price FROM h LEFT JOIN profiles p ON p.symbol=h.symbol""")
def _(m):
    matched, unknown = P.with_market(without_partner(m.holdings, "-X"), m.profiles)
    a = matched.select("holder", "symbol", F.lit("matched").alias("state"), "last_price")
    return a.unionByName(unknown.select("holder", "symbol", F.lit("unknown").alias("state"), F.lit(None).cast("double").alias("last_price")))


@query("C05_asof_backward", "SELECT p.symbol, p.date, p.close, f.revenue, f.date AS statement_date FROM prices p ASOF LEFT JOIN financials f ON f.symbol=p.symbol AND f.date<=p.date")
def _(m):
    fin = m.financials.select("symbol", "date", "revenue", F.col("date").alias("_d"))
    return A.asof_join(m.closes, fin, ["symbol"], {"revenue": "revenue", "_d": "statement_date"})


@query("C06_asof_forward", "SELECT p.symbol, p.date, d.date AS next_ex, d.adjDividend FROM prices p ASOF LEFT JOIN dividends d ON d.symbol=p.symbol AND d.date>=p.date")
def _(m):
    div = m.dividends.select("symbol", "date", "adjDividend", F.col("date").alias("_d"))
    return A.asof_join(m.closes.select("symbol", "date"), div, ["symbol"], {"_d": "next_ex", "adjDividend": "adjDividend"}, direction="forward")


@query("C07_asof_calendar_lag", "SELECT p.symbol, p.date, p.close, q.close AS close_30d FROM prices p ASOF LEFT JOIN prices q ON q.symbol=p.symbol AND q.date<=p.date-30")
def _(m):
    return m.closes.withColumn("close_30d", A.value_days_ago("close", 30, ["symbol"]))


@query("C08_align_series", "SELECT p.symbol, p.date, f.close AS usdidr FROM prices p ASOF LEFT JOIN fx f ON f.date<=p.date")
def _(m):
    return A.align_series(m.closes.select("symbol", "date"), m.fx, {"close": "usdidr"})


@query("C09_event_window", "SELECT d.symbol, d.date AS ex_date, p.date, p.close FROM dividends d JOIN prices p ON p.symbol=d.symbol AND p.date BETWEEN d.date-180 AND d.date+30")
def _(m):
    ev = m.dividends.select("symbol", F.col("date").alias("ex_date"))
    return A.event_window_join(ev, m.closes, 180, 30).select("symbol", "ex_date", "date", "close")


@query("C10_year_spine", "SELECT symbol, year, R6{v} AS adjDividend FROM yd")
def _(m):
    return D.yearly_dividends(m.dividends, ASOF).select("symbol", "year", rnd("adjDividend").alias("adjDividend"))


@query("C11_outer_merge", """
x AS (SELECT symbol, ex_date, low.c AS low_price FROM bestev), y AS (SELECT symbol, ex_date, cum_price FROM exev WHERE cum_price IS NOT NULL),
a AS (SELECT * FROM x UNION ALL SELECT symbol||'-A', ex_date, low_price FROM x), b AS (SELECT * FROM y UNION ALL SELECT symbol||'-B', ex_date, cum_price FROM y)
SELECT coalesce(a.symbol,b.symbol) AS symbol, coalesce(a.ex_date,b.ex_date) AS ex_date, low_price, cum_price, adjDividend FROM a FULL JOIN b ON a.symbol=b.symbol AND a.ex_date=b.ex_date
LEFT JOIN dividends d ON d.symbol=coalesce(a.symbol,b.symbol) AND d.date=coalesce(a.ex_date,b.ex_date)""")
def _(m):
    ev = E.ex_events(m.dividends).select("symbol", "ex_date")
    a = without_partner(E.best_entry(m.closes, ev).select("symbol", "ex_date", "low_price"), "-A")
    b = without_partner(E.with_event_prices(ev, m.closes).where("cum_price is not null").select("symbol", "ex_date", "cum_price"), "-B")
    d = m.dividends.select("symbol", F.col("date").alias("ex_date"), "adjDividend")
    return a.join(b, ["symbol", "ex_date"], "outer").join(d, ["symbol", "ex_date"], "left")


@query("C12_year_payout", "SELECT symbol, R6{avg_payout} AS avg_payout FROM payout")
def _(m):
    return D.payout_history(m.dividends, m.financials, m.shares, rate(m)).select("symbol", rnd("avg_payout").alias("avg_payout"))


@query("C13_semi_anti", "SELECT symbol, 'in' AS side FROM companies WHERE symbol IN (SELECT symbol FROM dividends WHERE dividend_type='special') UNION ALL SELECT symbol, 'out' FROM companies WHERE symbol NOT IN (SELECT symbol FROM dividends WHERE dividend_type='special')")
def _(m):
    sp = m.dividends.where("dividend_type = 'special'").select("symbol").distinct()
    c = m.companies.select("symbol")
    return c.join(sp, "symbol", "left_semi").withColumn("side", F.lit("in")).unionByName(c.join(sp, "symbol", "left_anti").withColumn("side", F.lit("out")))


@query("C14_grid_join", f"SELECT symbol, combo FROM companies, generate_series(0,{len(S.grid('balanced')) - 1}) g(combo)")
def _(m):
    n = len(S.grid("balanced"))
    return m.companies.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("combo"))


@query("C15_previous_session", "SELECT symbol, date, close, prev_close, R6{return_1d_pct} AS return_1d_pct FROM sess")
def _(m):
    return rounded(R.session_returns_all(m.closes), ["symbol", "date", "close", "prev_close"])


