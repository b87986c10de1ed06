"""Checking SQL: shared table expressions and a small text expander.

``R6{expr}`` in a query stands for rounding to six places without a negative
zero. Only the shared tables that a query names are put in front of it.
"""

from __future__ import annotations

import re
from functools import cache

from .market import ASOF

CTES: dict[str, str] = {
    "prints": """
SELECT l_suppkey AS sk, printf('S%06d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS date,
       CAST(round(l_discount*100) AS BIGINT) AS disc, CAST(round(l_tax*100) AS BIGINT) AS tax,
       CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice*100) AS BIGINT) AS cents,
       l_returnflag AS flag, l_orderkey, l_linenumber, l_suppkey % 9 + 1 AS level,
       1000 + (l_suppkey % 7 - 1) * ((year(l_shipdate)-1995)*12 + month(l_shipdate)) AS trend
FROM lineitem""",
    "prices": """
SELECT symbol, date, floor((max_c+min_c)/2)/100 AS open, max_c/100 AS high, min_c/100 AS low,
       close_c/100 AS close, close_c/100 AS adjClose, CAST(q AS DOUBLE) AS volume
FROM (SELECT symbol, date, CAST((100+max(disc))*any_value(trend*level) AS DOUBLE) AS max_c,
             CAST((100+min(disc))*any_value(trend*level) AS DOUBLE) AS min_c,
             floor((100*count(*)+sum(disc)::BIGINT)*any_value(trend*level) / count(*)) AS close_c,
             sum(qty)::BIGINT AS q
      FROM prints GROUP BY symbol, date)""",
    "dividends": """
SELECT symbol, date, floor((1000*n+500*t)*trend*level/(1000*n))/100 AS adjDividend,
       CASE WHEN half=1 AND (sk+year)%11=0 THEN 'special' WHEN half=2 THEN 'final' ELSE 'interim' END AS dividend_type,
       year AS fiscal_year
FROM (SELECT symbol, sk, level, year(date) AS year, CASE WHEN month(date)>6 THEN 2 ELSE 1 END AS half,
             min(date) AS date, count(*) AS n, sum(tax)::BIGINT AS t, arg_min(trend, date) AS trend
      FROM prints WHERE flag='R' AND (sk+year(date))%6<>0 GROUP BY ALL)""",
    "financials": """
SELECT symbol, make_date(y, q*3, 1) AS date, y AS calendarYear, 'Q'||q AS period,
       CAST(CASE WHEN usd THEN floor(rev/150000.0)*1000 ELSE floor(rev/10000.0)*1000000 END AS DOUBLE) AS revenue,
       CAST(CASE WHEN usd THEN floor(ni/1500000.0)*1000 ELSE floor(ni/100000.0)*1000000 END AS DOUBLE) AS netIncome,
       CAST(CASE WHEN usd THEN floor(ni/1500000.0)*1000 ELSE floor(ni/100000.0)*1000000 END AS DOUBLE)
         / CAST((sk%5+1)*500000000 AS DOUBLE) AS eps,
       CASE WHEN usd THEN 'USD' ELSE 'IDR' END AS reportedCurrency
FROM (SELECT symbol, sk, year(date) AS y, quarter(date) AS q, sk%5=0 AS usd,
             CAST(sum(cents*(100-disc)) AS DOUBLE) AS rev,
             CAST(sum(cents*(CASE WHEN sk%4=0 THEN 50 ELSE 120 END - 10*tax)) AS DOUBLE) AS ni
      FROM prints GROUP BY ALL)""",
    "orders_c": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders",
    "fx": "SELECT 'USDIDR' AS pair, date, 15000+floor(sum(c)::BIGINT/count(*)/1000)/100 AS close FROM orders_c GROUP BY date",
    "fx_pairs": "SELECT substr(o_orderpriority,3,20) AS pair, date, 15000+floor(sum(c)::BIGINT/count(*)/1000)/100 AS close FROM orders_c GROUP BY ALL",
    "companies": """
SELECT s_suppkey AS sk, printf('S%06d', s_suppkey) AS symbol, s_name AS companyName, r_name AS sector,
       n_name AS industry, floor(abs(s_acctbal)) AS bal
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "shares": "SELECT printf('S%06d', s_suppkey) AS symbol, CAST((s_suppkey%5+1)*500000000 AS DOUBLE) AS outstandingShares FROM supplier",
    "profiles": """
SELECT c.symbol, companyName, sector, industry, price, round(price-o, 2)+0.0 AS changes, (5+sk%10)/10 AS beta,
       CAST(floor(price*((sk%5+1)*500000000)) AS BIGINT) AS mktCap,
       CASE WHEN sk%13=5 THEN 0.0 ELSE bal/100 END AS lastDiv,
       make_date(CAST(1985+sk%12 AS INT), CAST(1+sk%12 AS INT), 15) AS ipoDate, volAvg,
       sk%11<>0 AS isActivelyTrading, sk%17=3 AS isEtf, sk%19=4 AS isFund, 'IDR' AS currency
FROM companies c JOIN (SELECT symbol, arg_max(close,date) AS price, arg_max(open,date) AS o, floor(avg(volume)) AS volAvg
                       FROM prices GROUP BY symbol) l ON l.symbol=c.symbol""",
    "compliant": "SELECT s_suppkey+1 AS no, printf('S%06d', s_suppkey) AS kode, s_name AS nama FROM supplier WHERE s_suppkey%3<>1",
    "index_prices": """
SELECT c.sector AS index, date, floor(sum(CAST(round(close*100) AS BIGINT))::BIGINT/count(*))/100 AS close
FROM prices p JOIN companies c ON p.symbol=c.symbol GROUP BY ALL""",
    "bench": "SELECT date, floor(sum(CAST(round(close*100) AS BIGINT))::BIGINT/count(*))/100 AS close FROM prices GROUP BY date",
    "trades": "SELECT p.*, o_custkey AS holder FROM prints p JOIN orders ON l_orderkey=o_orderkey",
    "holdings": """
SELECT holder, symbol, CAST(sum(qty) AS DOUBLE) AS lots,
       floor(sum(qty*(100+disc)*level*10)::BIGINT/sum(qty)::BIGINT) AS avg_price FROM trades GROUP BY ALL""",
    "payments": """
SELECT holder, symbol AS stock, qty AS lot, (1000+50*tax)/100 AS dividend, CAST(qty*(1000+50*tax) AS DOUBLE) AS total,
       date, l_orderkey, l_linenumber FROM trades WHERE flag='R'""",
    "logs": """
SELECT event_id, CASE
 WHEN event_id%10=7 THEN 'INFO redis get key'||event_id||' took 0.'||lpad(CAST(event_id%1000 AS VARCHAR),3,'0')||' seconds'
 WHEN event_id%10=8 THEN 'INFO get redis key: k'||event_id||', total time: 0.'||lpad(CAST(event_id%1000 AS VARCHAR),3,'0')||' seconds'
 WHEN event_id%10=9 THEN 'INFO Total download time for '||printf('S%06d', user_id%40)||': 0.'||lpad(CAST(event_id%1000 AS VARCHAR),3,'0')
 WHEN event_id%97=0 THEN 'WARN use_container_width will be removed after the next release'
 WHEN event_id%89=0 THEN 'Session already connected! Connecting to a new session.'
 ELSE 'INFO VISIT | visitor=u'||user_id||' | page=/'||event_type||' | source='||CASE WHEN event_id%3=0 THEN 'None' ELSE 'ref'||(event_id%4) END||' | lang=id' END AS line
FROM events""",
}


def shared(name: str, sql: str) -> None:
    CTES[name] = sql


def _rounded(text: str) -> str:
    while True:
        m = re.search(r"\bR(\d)\{", text)
        if not m:
            return text
        depth, i = 1, m.end()
        while depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        text = f"{text[:m.start()]}(round(CAST({text[m.end():i - 1]} AS DOUBLE), {m.group(1)}) + 0.0){text[i:]}"


def _dated(text: str) -> str:
    return text.replace(":asof", f"DATE '{ASOF}'")


@cache
def _prepared(name: str, sql: str) -> tuple[str, frozenset[str]]:
    """One shared table as written into a query, and the tables it names."""
    return f"{name} AS ({_rounded(_dated(sql))})", _named(sql)


def _named(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)) & CTES.keys()


def expand(body: str) -> str:
    body = _dated(body.strip())
    need: set[str] = set()
    todo = list(_named(body))
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += _prepared(name, CTES[name])[1]
    head = [_prepared(n, s)[0] for n, s in CTES.items() if n in need]
    body = _rounded(body)
    sep = "" if body.upper().startswith(("SELECT", "FROM")) else ", "
    if head:
        body = "WITH RECURSIVE " + ",\n".join(head) + sep + "\n" + body
    elif sep:
        body = "WITH RECURSIVE " + body
    return body.replace("<:,>", "{:,}")
