"""Strategy queries."""

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..functions.sequential import with_smoothed
from ..operators import indicators as N
from ..operators import returns as R
from ..operators import strategy as S
from ..session import cut_packed, spread
from .oracle import shared
from .registry import query

RULES = S.rules("balanced")  # the default search; the deep one has queries of its own
DEEP = S.rules("deep")
SCANNED = list(dict.fromkeys([*RULES, *S.rules("quick")]))  # a scan falls back to the baseline presets
LOOKBACKS = sorted(S.lookbacks_of([*RULES, *DEEP, *SCANNED]))
WARM = max(r.warmup for r in RULES)
HOLDOUT = 28.0
SCAN_DAY = "2001-11-05"

# ---------------------------------------------------------------- checking SQL

shared("regime", """
SELECT date, CASE WHEN sf>ss THEN 'bull' ELSE 'bear' END AS regime FROM (SELECT date, CASE WHEN count(*) OVER f=50 THEN avg(close) OVER f END AS sf, CASE WHEN count(*) OVER l=200 THEN avg(close) OVER l END AS ss, count(*) OVER () AS n
 FROM bench WINDOW f AS (ORDER BY date ROWS 49 PRECEDING), l AS (ORDER BY date ROWS 199 PRECEDING)) WHERE n>=205""")


def _mom(name, src):
    shared(f"cal_{name}", f"SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM {src})")
    for n in LOOKBACKS:
        shared(f"mom{n}_{name}", f"""
SELECT symbol, date, (rank() OVER (PARTITION BY date ORDER BY ret)+(count(*) OVER (PARTITION BY date, ret)-1)/2.0)/count(*) OVER (PARTITION BY date)*100 AS pct FROM
 (SELECT a.symbol, a.date, a.close/b.close-1 AS ret FROM (SELECT symbol, p.date, close, i FROM {src} p JOIN cal_{name} c ON p.date=c.date) a JOIN (SELECT symbol, p.date, close, i FROM {src} p JOIN cal_{name} c ON p.date=c.date) b ON a.symbol=b.symbol AND b.i=a.i-{n})""")
    joins = " ".join(f"ASOF LEFT JOIN mom{n}_{name} m{n} ON m{n}.symbol=p.symbol AND p.date>=m{n}.date" for n in LOOKBACKS)
    shared(f"ser_{name}", f"""
SELECT p.symbol, 'all' AS part, p.date, p.close, coalesce(r.regime,'bear') AS regime, b.close AS bench, {', '.join(f'm{n}.pct AS pct{n}' for n in LOOKBACKS)}, row_number() OVER (PARTITION BY p.symbol ORDER BY p.date) AS rn, NULL::DATE AS start
FROM (SELECT symbol, date, close FROM {src}) p ASOF LEFT JOIN regime r ON p.date>=r.date ASOF LEFT JOIN bench b ON p.date>=b.date {joins}""")


def _ew(x, q, alpha, t, w):
    return f"pow({q},{t})*sum(CASE WHEN {t}=1 THEN 1 ELSE {alpha} END*{x}*pow({q},-{t})) FILTER (WHERE {t}>=1) OVER {w}"


def _c(*parts):
    """Column name of a parameterised indicator."""
    return "_".join(f"{x:g}" if isinstance(x, (int, float)) else x for x in parts).replace(".", "p")


def _rule_sql(r):
    """(setup, exit, indicator) of a rule over the columns of i4, and the columns it needs by step."""
    a, b, c, d = r.a, float(r.b), r.c, float(r.d)
    bull = "regime='bull'"
    need = {"rsi": set(), "ema": set(), "sma": set(), "band": set(), "high": set(), "low": set(), "lagged": set(), "was": {}, "tight": set(), "rs": set()}
    if r.strategy == "regime_rsi":
        need["rsi"], need["sma"] = {a}, {c}
        return (f"CASE WHEN regime='bear' THEN rsi_{a}<{b} ELSE rsi_{a}<{d} AND close>sma_{c} END", "false", f"rsi_{a}"), need
    if r.strategy == "bollinger_lower":
        need["rsi"], need["band"] = {c}, {a}
        low = f"(mid_{a}-{b}*sd_{a})"
        return (f"close<{low} AND pc>=(pmid_{a}-{b}*psd_{a}) AND rsi_{c}<={d}", f"close>=mid_{a} AND pc<pmid_{a}", f"(close/{low}-1)*100"), need
    if r.strategy == "rsi_recovery":
        need["rsi"], need["was"] = {a}, {_c("os", a, b): (f"rsi_{a}<={b}", 5)}
        if c:
            need["sma"] = {c}
        return (f"{_c('os', a, b)} AND rsi_{a}>{d} AND prsi_{a}<={d}" + (f" AND close>sma_{c}" if c else ""), f"rsi_{a}>=70 AND prsi_{a}<70", f"rsi_{a}"), need
    if r.strategy == "donchian":
        need["high"], need["low"] = {a}, {int(b)}
        if c:
            need["sma"] = {c}
        k = 1 + d / 100
        return (f"close>h_{a}*{k!r} AND pc<=ph_{a}*{k!r}" + (f" AND close>sma_{c}" if c else "") + f" AND {bull}", f"close<l_{int(b)}", f"(close/(h_{a}*{k!r})-1)*100"), need
    if r.strategy == "squeeze":
        need["band"], need["high"], need["tight"] = {a}, {c}, {(a, b, int(d))}
        return (f"{_c('sq', a, b, d)} AND close>h_{c} AND pc<=ph_{c} AND {bull}", f"close<mid_{a}", f"bw_{a}"), need
    if r.strategy == "trend_pullback":
        f, g = a, int(b)
        touch = _c("touch", f, c, d)
        need["ema"], need["was"] = {f, g}, {touch: (f"close<=e_{f}*{1 + float(c) / 100!r}", int(d))}
        return (f"{touch} AND e_{f}>e_{g} AND close>e_{f} AND pc<=pe_{f} AND {bull}", f"e_{f}<e_{g} OR (close<e_{f} AND pc>=pe_{f})", f"(close/e_{f}-1)*100"), need
    rec = f"rsi_{c}>{d} AND prsi_{c}<={d}"
    need["rsi"] = {c}
    if r.strategy == "relative_strength":
        need["rs"] = {a}
        return (f"rs_{a}>={b} AND {rec} AND {bull}", f"rs_{a}<0", f"rs_{a}"), need
    return (f"pct{a}>={b} AND {rec} AND {bull}", f"pct{a}<50", f"pct{a}"), need


def _signals(name, rs):
    """sig_{name}: setup, exit and indicator of every rule over the series ser_{name}."""
    w = "(PARTITION BY symbol, part ORDER BY rn)"
    sql = {r.id: _rule_sql(r) for r in rs}
    get = lambda k: sorted(set().union(*(n[k] for _, n in sql.values())))
    was = {k: v for _, n in sql.values() for k, v in n["was"].items()}
    rsi, ema, sma, band, high, low, tight = (get(k) for k in ("rsi", "ema", "sma", "band", "high", "low", "tight"))
    back = lambda n: f"(PARTITION BY symbol, part ORDER BY rn ROWS {n - 1} PRECEDING)"
    past = lambda n: f"(PARTITION BY symbol, part ORDER BY rn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    i1 = [f"{_ew(f'greatest({s}mv,0)', f'{n - 1}/{n}.0', f'1/{n}.0', 'k', 'w')} AS {v}_{n}" for n in rsi for s, v in (("", "u"), ("-", "d"))]
    i1 += [f"CASE WHEN rn>={n} THEN {_ew('close', f'{n - 1}/{n + 1}.0', f'2/{n + 1}.0', 'rn', 'w')} END AS e_{n}" for n in ema]
    shared(f"i1_{name}", f"SELECT *, {', '.join(i1)} FROM (SELECT *, rn-1 AS k, close-lag(close) OVER {w} AS mv FROM ser_{name}) WINDOW w AS {w}")
    i2 = [f"CASE WHEN k>={n} THEN CASE WHEN d_{n}>0 THEN 100-100/(1+u_{n}/d_{n}) WHEN u_{n}>0 THEN 100 END END AS rsi_{n}" for n in rsi]
    i2 += [f"CASE WHEN rn>={n} THEN avg(close) OVER {back(n)} END AS sma_{n}" for n in sma]
    i2 += [f"CASE WHEN rn>={n} THEN {f}(close) OVER {back(n)} END AS {v}_{n}" for n in band for f, v in (("avg", "mid"), ("stddev_samp", "sd"))]
    i2 += [f"CASE WHEN rn>{n} THEN {f}(close) OVER {past(n)} END AS {v}_{n}" for f, v, ns in (("max", "h", high), ("min", "l", low)) for n in ns]
    i2 += [f"(close/lag(close,{n}) OVER {w} - bench/lag(bench,{n}) OVER {w})*100 AS rs_{n}" for n in get("rs")]
    shared(f"i2_{name}", f"SELECT *, {', '.join(i2)} FROM i1_{name}")
    i3 = ["lag(close) OVER w AS pc"] + [f"lag({v}_{n}) OVER w AS p{v}_{n}" for v, ns in (("rsi", rsi), ("mid", band), ("sd", band), ("h", high), ("e", ema)) for n in ns]
    i3 += [f"sd_{n}*4/nullif(mid_{n},0)*100 AS bw_{n}" for n in band]
    i3 += [f"coalesce(max(coalesce({x},false)) OVER {past(n)}, false) AS {k}" for k, (x, n) in was.items()]
    shared(f"i3_{name}", f"SELECT *, {', '.join(i3)} FROM i2_{name} WINDOW w AS {w}")
    t = [f"bw_{n} <= CASE WHEN count(bw_{n}) OVER {back(d)}={d} THEN quantile_cont(bw_{n},{q / 100!r}) OVER {back(d)} END AS {_c('t', n, q, d)}" for n, q, d in tight]
    sq = [f"coalesce(max(coalesce({_c('t', n, q, d)},false)) OVER {past(5)}, false) AS {_c('sq', n, q, d)}" for n, q, d in tight]
    shared(f"i4_{name}", f"SELECT *, {', '.join(sq)} FROM (SELECT *, {', '.join(t)} FROM i3_{name})" if tight else f"SELECT * FROM i3_{name}")
    shared(f"sig_{name}", " UNION ALL ".join(
        f"SELECT symbol, part, rn, date, close, regime, start, '{k}' AS rule, coalesce({x},false) AS setup, coalesce({y},false) AS leave, {v} AS indicator FROM i4_{name}" for k, ((x, y, v), _) in sql.items()))


_mom("all", "prices")
_signals("all", RULES)
shared("ser_deep", "SELECT * FROM ser_all")
_signals("deep", DEEP)
shared("cutoff", f"""
SELECT symbol, count(*) AS n, CAST(floor(count(*)*{1 - HOLDOUT / 100!r}) AS INT) AS cut, CAST(floor(count(*)*{1 - HOLDOUT / 100!r}) AS INT)>={WARM} AND count(*)-CAST(floor(count(*)*{1 - HOLDOUT / 100!r}) AS INT)>={WARM} AS enough FROM prices GROUP BY symbol""")
shared("ser_split", f"""
SELECT symbol, part, date, close, regime, bench, {', '.join(f'pct{n}' for n in LOOKBACKS)}, start, row_number() OVER (PARTITION BY symbol, part ORDER BY date) AS rn FROM
 (SELECT s.symbol, p.part, s.date, s.close, s.regime, s.bench, {', '.join(f's.pct{n}' for n in LOOKBACKS)}, (SELECT t.date FROM ser_all t WHERE t.symbol=s.symbol AND t.rn=c.cut+1) AS start FROM ser_all s JOIN cutoff c ON c.symbol=s.symbol AND enough,
  (VALUES ('train'),('valid')) p(part) WHERE (p.part='train' AND s.rn<=c.cut) OR (p.part='valid' AND s.rn-1>=greatest(0,c.cut-{WARM})))""")
_signals("split", RULES)
for _name, _preset in (("combos", "balanced"), ("combos_deep", "deep"), ("presets", "quick")):
    shared(_name, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r.id}', '{r.strategy}', {h}, {t}, {s}, {r.b}::DOUBLE, {r.d}::DOUBLE, {r.warmup})" for i, (r, h, t, s) in enumerate(S.grid(_preset))) + ") c(combo, rule, strategy, max_hold, pt, sl, pb, pd, warm)")


def _trades(name, combos="combos"):
    shared(f"act_{name}", f"""
SELECT *, coalesce(lag(setup) OVER w,false) AS entry, coalesce(lag(leave) OVER w,false) AS out, max(rn) OVER (PARTITION BY symbol, part, rule) AS last FROM sig_{name} WINDOW w AS (PARTITION BY symbol, part, rule ORDER BY rn)""")
    shared(f"cand_{name}", f"""
SELECT c.symbol, c.part, combo, c.rn AS e, any_value(c.date) AS entry_date, any_value(c.close) AS ep, any_value(c.regime) AS regime,
 coalesce(min(f.rn) FILTER (WHERE f.close>=c.close*(1+pt/100) OR f.close<=c.close*(1-sl/100) OR f.out OR f.rn-c.rn>=max_hold), max(f.rn)) AS x
FROM act_{name} c JOIN {combos} k ON c.rule=k.rule JOIN act_{name} f ON f.symbol=c.symbol AND f.part=c.part AND f.rule=c.rule AND f.rn>c.rn AND f.rn<=c.rn+max_hold
WHERE c.entry AND c.rn<c.last AND c.last>=k.warm AND (c.part<>'valid' OR c.date>=c.start) GROUP BY c.symbol, c.part, combo, c.rn""")
    shared(f"pick_{name}", f"""
SELECT symbol, part, combo, min(e) AS e, arg_min(x,e) AS x, 1::BIGINT AS k FROM cand_{name} GROUP BY ALL
UNION ALL SELECT t.symbol, t.part, t.combo, min(t.e), arg_min(t.x,t.e), max(p.k)+1 FROM pick_{name} p JOIN cand_{name} t ON t.symbol=p.symbol AND t.part=p.part AND t.combo=p.combo AND t.e>p.x GROUP BY t.symbol, t.part, t.combo""")
    shared(f"trd_{name}", f"""
SELECT p.symbol, p.part, p.combo, p.k AS trade_no, p.e AS entry_rn, p.x AS exit_rn, c.entry_date, c.regime, c.ep AS entry_price, s.close AS exit_price, s.close*(1-0.0025)/(c.ep*(1+0.0015)) AS g, s.close/c.ep*(1-0.0025)-(1+0.0015) AS r
FROM pick_{name} p JOIN cand_{name} c ON c.symbol=p.symbol AND c.part=p.part AND c.combo=p.combo AND c.e=p.e JOIN ser_{name} s ON s.symbol=p.symbol AND s.part=p.part AND s.rn=p.x""")
    shared(f"eq_{name}", f"""
SELECT t.symbol, t.part, t.combo, trade_no, s.rn, CASE WHEN s.rn=exit_rn THEN bef*g ELSE bef*s.close/(entry_price*(1+0.0015)) END AS eq FROM
 (SELECT *, coalesce(product(g) OVER (PARTITION BY symbol, part, combo ORDER BY trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS bef FROM trd_{name}) t JOIN ser_{name} s ON s.symbol=t.symbol AND s.part=t.part AND s.rn BETWEEN entry_rn AND exit_rn""")
    shared(f"met_{name}", f"""
SELECT m.*, d.max_drawdown FROM (SELECT symbol, part, combo, (product(g)-1)*100 AS total_return, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END)*100 AS win_rate, count(*) AS trades, (sum(CAST(r AS DECIMAL(38,18)))::DOUBLE/count(r))*100 AS avg_trade, count(*) FILTER (WHERE regime='bear') AS bear_entries, count(*) FILTER (WHERE regime='bull') AS bull_entries FROM trd_{name} GROUP BY ALL) m
JOIN (SELECT symbol, part, combo, least(0,min(eq/pk-1))*100 AS max_drawdown FROM (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, part, combo ORDER BY trade_no, rn)) AS pk FROM eq_{name}) GROUP BY ALL) d ON d.symbol=m.symbol AND d.part=m.part AND d.combo=m.combo""")


_trades("all")
_trades("split")
_trades("deep", "combos_deep")
VAL = ["total_return", "win_rate", "max_drawdown", "trades", "avg_trade"]
shared("hold_", f"""
SELECT t.*, {', '.join(f'coalesce(v.{c},0) AS val_{c}' if c == 'trades' else f'v.{c} AS val_{c}' for c in VAL)} FROM (SELECT * EXCLUDE (part) FROM met_split WHERE part='train') t LEFT JOIN met_split v ON v.part='valid' AND v.symbol=t.symbol AND v.combo=t.combo""")
shared("hold", "SELECT * FROM hold_")


def _pr(c, part=""):
    p = f"PARTITION BY {part + ', ' if part else ''}{c} IS NULL"
    return f"coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({p} ORDER BY {c})+(count(*) OVER ({p}, {c})-1)/2.0)/count(*) OVER ({p}) END,0)"


def _wm(v, w, cond="true"):
    return f"sum(CAST({v}*{w} AS DECIMAL(38,12))) FILTER (WHERE {cond} AND {v} IS NOT NULL AND {w}>0)::DOUBLE/nullif(sum({w}) FILTER (WHERE {cond} AND {v} IS NOT NULL AND {w}>0),0)"


shared("strat0", f"""
SELECT combo, count(DISTINCT symbol) AS stocks_tested, count(DISTINCT symbol) FILTER (WHERE val_trades>0) AS stocks_validated, sum(trades)::BIGINT AS train_trades, sum(val_trades)::BIGINT AS val_trades, {_wm('avg_trade', 'trades')} AS train_avg_trade,
 {_wm('val_avg_trade', 'val_trades', 'val_trades>0')} AS val_avg_trade, {_wm('val_win_rate', 'val_trades', 'val_trades>0')} AS val_win_rate, {_wm('val_max_drawdown', 'val_trades', 'val_trades>0')} AS val_drawdown,
 avg(CASE WHEN val_total_return>0 THEN 1.0 ELSE 0 END) FILTER (WHERE val_trades>0)*100 AS positive_pct, median(val_total_return) FILTER (WHERE val_trades>0) AS median_return,
 count(DISTINCT symbol) FILTER (WHERE val_trades>0)*100.0/(SELECT count(DISTINCT symbol) FROM hold) AS coverage_pct FROM hold GROUP BY combo""")
shared("strat", "SELECT *, val_avg_trade-train_avg_trade AS generalization_gap, (" + " + ".join(f"{_pr(f"round({c}::DOUBLE,9)" if c != 'drawdown_control' else 'round(-abs(val_drawdown),9)')}*{w}*100" for c, w in S.SUMMARY_WEIGHTS.items()) + ") AS score FROM strat0")
shared("qual", """
SELECT * FROM (SELECT *, bool_or(ok) OVER () AS anyok FROM (SELECT *, stocks_validated>=greatest(3,ceil((max(stocks_tested) OVER ())*0.2)) AND val_trades>=greatest(20,2*max(stocks_tested) OVER ()) AS ok FROM strat)) WHERE CASE WHEN anyok THEN ok ELSE val_trades>0 END""")
shared("bestc", "SELECT * FROM qual ORDER BY round(score,9) DESC, round(val_avg_trade,9) DESC NULLS LAST, val_trades DESC, combo LIMIT 1")
shared("over", f"""
SELECT symbol, combo, score, val_trades, val_avg_trade, val_total_return, gr AS global_return, val_total_return-gr AS return_uplift FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score,9) DESC, val_trades DESC, round(val_avg_trade,9) DESC, combo) AS k FROM
 (SELECT *, {' + '.join(f"{_pr(f"round({c}::DOUBLE,9)" if c != 'drawdown_control' else 'round(-abs(val_max_drawdown),9)', 'symbol')}*{w}*100" for c, w in S.STOCK_WEIGHTS.items())} AS score FROM
  (SELECT h.*, g.val_total_return AS gr FROM hold h JOIN (SELECT * FROM hold WHERE combo IN (SELECT combo FROM bestc) AND val_trades>0 AND val_total_return IS NOT NULL) g ON g.symbol=h.symbol WHERE h.val_trades>0 AND h.val_total_return>g.val_total_return+1e-9))) WHERE k=1""")
shared("lastp", f"SELECT symbol, max(date) AS d, arg_max(close,date) AS c FROM prices GROUP BY symbol HAVING count(*)>={WARM} AND max(date)>=DATE '{SCAN_DAY}'-7")
shared("quotes", "SELECT symbol, floor(price*100*(6+CAST(substr(symbol,2) AS BIGINT)%9)/10)/100 AS quote FROM profiles")
shared("live", f"""
SELECT p.symbol, p.date, p.close FROM prices p JOIN lastp l ON p.symbol=l.symbol WHERE p.date < DATE '{SCAN_DAY}' UNION ALL
SELECT l.symbol, DATE '{SCAN_DAY}', quote FROM lastp l JOIN quotes q ON l.symbol=q.symbol WHERE quote>0 AND quote/c BETWEEN 0.65 AND 1.35""")
_mom("live", "live")
_signals("live", SCANNED)

# ---------------------------------------------------------------- queries


def stored_closes(m):
    """The closes, made from the prints once for series, index and calendar, and stored by symbol."""
    if not getattr(m, "_stored", False):
        m.closes, m._stored = cut_packed(spread(m.closes, "symbol").sortWithinPartitions("symbol", "date")), True
    return m.closes


def series(m, prices=None, lookbacks=None):
    closes = stored_closes(m)
    px = closes if prices is None else prices
    return S.base_series(px, R.regime_series(m.benchmark), m.benchmark, S.lookbacks_of(RULES) if lookbacks is None else lookbacks)


def all_signals(m, rs=RULES):
    return S.signals(series(m, lookbacks=S.lookbacks_of(rs)), rs)


def grid(m, preset="balanced"):
    return S.grid_table(m.spark, preset)


@query("L01_wilder_rsi", """
x AS (SELECT symbol, date, row_number() OVER w - 1 AS k, close-lag(close) OVER w AS mv FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e AS (SELECT symbol, date, k, pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*greatest(mv,0)*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS u, pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*greatest(-mv,0)*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS d,
 pow(6/7.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/7.0 END*greatest(mv,0)*pow(6/7.0,-k)) FILTER (WHERE k>=1) OVER w AS u7, pow(6/7.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/7.0 END*greatest(-mv,0)*pow(6/7.0,-k)) FILTER (WHERE k>=1) OVER w AS d7 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY k))
SELECT symbol, date, R4{CASE WHEN k>=14 THEN 100-100/(1+u/nullif(d,0)) END} AS rsi_14, R4{CASE WHEN k>=7 THEN 100-100/(1+u7/nullif(d7,0)) END} AS rsi_7 FROM e""")
def _(m):
    d = with_smoothed(m.closes, "close", rsi=(7, 14), zero_loss=None)
    return d.select("symbol", "date", rnd("rsi_14", 4).alias("rsi_14"), rnd("rsi_7", 4).alias("rsi_7"))


@query("L02_bollinger_bands", """
SELECT symbol, date, R5{mid} AS middle, R3{mid-2*sd} AS lower, R3{mid+2*sd} AS upper FROM (SELECT symbol, date, CASE WHEN count(*) OVER w=20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w=20 THEN stddev_samp(close) OVER w END AS sd
 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))""")
def _(m):
    d = N.bollinger(m.closes, 20, 2.0)
    return d.select("symbol", "date", rnd("middle", 5).alias("middle"), rnd("lower", 3).alias("lower"), rnd("upper", 3).alias("upper"))


shared("st0", """
SELECT *, (high+low)/2+3*atr AS up0, (high+low)/2-3*atr AS dn0 FROM (SELECT *, CASE WHEN k>=7 THEN pow(6/7.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/7.0 END*tr*pow(6/7.0,-k)) OVER (PARTITION BY symbol ORDER BY k) END AS atr FROM
 (SELECT *, greatest(high-low, coalesce(abs(high-pc),0), coalesce(abs(low-pc),0)) AS tr FROM (SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS k FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date))))""")
shared("st1", """
SELECT symbol, k, 1 AS way, up0 AS up, dn0 AS dn, NULL::DOUBLE AS line FROM st0 WHERE k=1
UNION ALL SELECT symbol, k, w, u, d, CASE WHEN w>0 THEN d ELSE u END FROM (SELECT symbol, k, w, CASE WHEN w=way AND w<0 AND coalesce(up0>up,false) THEN up ELSE up0 END AS u, CASE WHEN w=way AND w>0 AND coalesce(dn0<dn,false) THEN dn ELSE dn0 END AS d FROM
 (SELECT b.symbol, b.k, b.up0, b.dn0, a.up, a.dn, a.way, CASE WHEN coalesce(b.close>a.up,false) THEN 1 WHEN coalesce(b.close<a.dn,false) THEN -1 ELSE a.way END AS w FROM st1 a JOIN st0 b ON b.symbol=a.symbol AND b.k=a.k+1))""")


shared("feats", """
WITH r AS (SELECT symbol, date, k-1 AS k, close-pc AS mv FROM st0), e AS (SELECT symbol, date, k, pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*greatest(mv,0)*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS u, pow(13/14.0,k)*sum(CASE WHEN k=1 THEN 1 ELSE 1/14.0 END*greatest(-mv,0)*pow(13/14.0,-k)) FILTER (WHERE k>=1) OVER w AS d FROM r WINDOW w AS (PARTITION BY symbol ORDER BY k)),
i AS (SELECT symbol, date, k, CASE WHEN k>=14 THEN CASE WHEN d>0 THEN 100-100/(1+u/d) WHEN u>0 THEN 100 END END AS rsi FROM e),
s AS (SELECT *, CASE WHEN count(rsi) OVER w=14 THEN (rsi-min(rsi) OVER w)/nullif(max(rsi) OVER w-min(rsi) OVER w,0)*100 END AS st FROM i WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS 13 PRECEDING)),
t AS (SELECT *, CASE WHEN count(st) OVER w=3 THEN avg(st) OVER w END AS sk FROM s WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS 2 PRECEDING)),
x AS (SELECT *, CASE WHEN count(sk) OVER w=3 THEN avg(sk) OVER w END AS sd FROM t WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS 2 PRECEDING)),
b AS (SELECT symbol, date, CASE WHEN count(*) OVER w=5 THEN avg(close) OVER w END AS m, CASE WHEN count(*) OVER w=5 THEN stddev_samp(close) OVER w END AS sd, close FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))
SELECT x.symbol, x.date, R4{rsi} AS rsi, R4{line} AS supertrend, way AS direction, R4{sk} AS stoch_k, R4{x.sd} AS stoch_d, R3{m-2*b.sd} AS band_low, R5{m} AS band_mid, R3{m+2*b.sd} AS band_high, R4{(4*b.sd)/nullif(m,0)*100} AS band_width, R4{(close-(m-2*b.sd))/nullif(4*b.sd,0)} AS band_pos
FROM x JOIN st1 ON st1.symbol=x.symbol AND st1.k=x.k+1 JOIN b ON b.symbol=x.symbol AND b.date=x.date""")


@query("L03_feature_indicators", "SELECT * FROM feats")
def _(m):
    d = N.feature_indicators(m.prices)
    c = lambda n, dp: rnd(F.col(f"`{n}`"), dp)
    return d.select(
        "symbol", "date", c("RSI_14", 4).alias("rsi"), c("SUPERT_7_3.0", 4).alias("supertrend"), F.col("`SUPERTd_7_3.0`").cast("int").alias("direction"), c("STOCHRSIk_14_14_3_3", 4).alias("stoch_k"), c("STOCHRSId_14_14_3_3", 4).alias("stoch_d"),
        c("BBL_5_2.0", 3).alias("band_low"), c("BBM_5_2.0", 5).alias("band_mid"), c("BBU_5_2.0", 3).alias("band_high"), c("BBB_5_2.0", 4).alias("band_width"), c("BBP_5_2.0", 4).alias("band_pos"))


def _strategy_query(number, strategy):
    rs = [r for r in RULES if r.strategy == strategy]

    @query(f"{number}_{strategy}", f"SELECT symbol, date, rule, setup, leave, R4{{indicator}} AS indicator FROM sig_all WHERE rule IN ({', '.join(repr(r.id) for r in rs)})")
    def _(m):
        return all_signals(m, rs).select("symbol", "date", "rule", "setup", "leave", rnd("indicator", 4).alias("indicator"))


for _n, _s in zip(("L04", "L05", "L06", "L07", "L08", "L09", "L10", "L11"), S.STRATEGIES):
    _strategy_query(_n, _s)


@query("L12_warmup", f"""
w AS (SELECT * FROM (VALUES {', '.join(f"('{r.id}', {r.warmup})" for r in S.rules('deep'))}) w(rule, warmup)), n AS (SELECT symbol, count(*) AS n FROM prices GROUP BY symbol)
SELECT symbol, rule, warmup, n>=warmup AS enough FROM n, w""")
def _(m):
    n = m.closes.groupBy("symbol").agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.warmup).alias("warmup")) for r in S.rules("deep")]))
    return n.select("symbol", "n", cells.alias("c")).select("symbol", "c.rule", "c.warmup", (F.col("n") >= F.col("c.warmup")).alias("enough"))


TR = "symbol, combo, trade_no, entry_rn, exit_rn, entry_date, regime, entry_price, exit_price"


@query("L13_trades", f"SELECT {TR} FROM trd_all")
def _(m):
    return S.trades(series(m), RULES, grid(m)).select(*TR.split(", "))


@query("L13_trades_deep", f"SELECT {TR} FROM trd_deep")
def _(m):
    return S.trades(series(m, lookbacks=S.lookbacks_of(DEEP)), DEEP, grid(m, "deep")).select(*TR.split(", "))


MET = ["total_return", "win_rate", "avg_trade", "max_drawdown"]


@query("L14_backtest_metrics", "SELECT symbol, combo, trades, bear_entries, bull_entries, " + ", ".join(f"R4{{{c}}} AS {c}" for c in MET) + " FROM met_all")
def _(m):
    d = S.metrics(S.trades(series(m), RULES, grid(m)))
    return d.select("symbol", "combo", "trades", "bear_entries", "bull_entries", *[rnd(c, 4).alias(c) for c in MET])


def holdout(m):
    parts, status = S.split_series(series(m), HOLDOUT, WARM)
    met = S.metrics(S.trades(parts, RULES, grid(m)))
    return S.holdout_results(met), status


HOLD = MET + [f"val_{c}" for c in MET]


@query("L15_holdout_results", "SELECT symbol, combo, trades, val_trades, " + ", ".join(f"R4{{{c}}} AS {c}" for c in HOLD) + " FROM hold")
def _(m):
    return holdout(m)[0].select("symbol", "combo", "trades", "val_trades", *[rnd(c, 4).alias(c) for c in HOLD])


@query("L15_symbol_status", """
SELECT c.symbol, CASE WHEN k.symbol IS NULL THEN 'missing_data' WHEN NOT enough THEN 'insufficient_history' WHEN h.symbol IS NOT NULL THEN 'ok' ELSE 'no_signals' END AS status
FROM (SELECT symbol FROM companies UNION ALL SELECT 'UNLISTED') c LEFT JOIN cutoff k ON k.symbol=c.symbol LEFT JOIN (SELECT DISTINCT symbol FROM hold) h ON h.symbol=c.symbol""")
def _(m):
    results, status = holdout(m)
    ask = m.companies.select("symbol").unionByName(m.spark.createDataFrame([("UNLISTED",)], "symbol string"))
    return S.symbol_status(ask, status, results)


@query("L16_parameter_grid", f"""
SELECT p.symbol, g.combo, g.rule, g.max_hold, g.stop_loss FROM (SELECT DISTINCT symbol FROM prices) p, (VALUES {', '.join(f"({i}, '{r.id}', {h}, {s})" for i, (r, h, t, s) in enumerate(S.grid('deep')))}) g(combo, rule, max_hold, stop_loss)""")
def _(m):
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(r.id).alias("rule"), F.lit(h).alias("max_hold"), F.lit(s).alias("stop_loss")) for i, (r, h, t, s) in enumerate(S.grid("deep"))]))
    return m.closes.select("symbol").distinct().select("symbol", cells.alias("c")).select("symbol", "c.*")


SUMC = ["train_avg_trade", "val_avg_trade", "val_win_rate", "val_drawdown", "positive_pct", "median_return", "coverage_pct", "generalization_gap", "score"]
SUM_SQL = "SELECT combo, stocks_tested, stocks_validated, train_trades, val_trades, " + ", ".join(f"R4{{{c}}} AS {c}" for c in SUMC) + " FROM "


def summ(d):
    return d.select("combo", "stocks_tested", "stocks_validated", "train_trades", "val_trades", *[rnd(c, 4).alias(c) for c in SUMC])


@query("L17_strategy_summary", SUM_SQL + "strat")
def _(m):
    return summ(S.summarize(holdout(m)[0]))


@query("L18_recommended", SUM_SQL + "qual")
def _(m):
    return summ(S.qualified(S.summarize(holdout(m)[0])))


OV = ["score", "val_avg_trade", "val_total_return", "global_return", "return_uplift"]


@query("L19_stock_overrides", "SELECT symbol, combo, val_trades, " + ", ".join(f"R4{{{c}}} AS {c}" for c in OV) + " FROM over")
def _(m):
    res = S.cut_lineage(holdout(m)[0])
    return S.stock_overrides(res, S.best_combo(S.summarize(res))).select("symbol", "combo", "val_trades", *[rnd(c, 4).alias(c) for c in OV])


@query("L20_setup_scan", f"""
pl0 AS (SELECT l.symbol, q.strategy, coalesce(o.rule, g.rule, q.rule) AS rule, coalesce(o.max_hold, g.max_hold, {S.MAX_HOLD}) AS max_hold, coalesce(o.sl, g.sl, {S.STOP_LOSS}) AS stop_loss,
 CASE WHEN o.symbol IS NOT NULL THEN 'Stock-specific optimized' WHEN g.combo IS NOT NULL THEN 'Global optimized' ELSE 'Baseline preset' END AS parameter_source, CASE WHEN o.symbol IS NOT NULL THEN o.score ELSE g.score END AS score, o.return_uplift
 FROM lastp l CROSS JOIN presets q LEFT JOIN (SELECT v.symbol, v.score, v.return_uplift, k.* FROM over v JOIN combos k ON k.combo=v.combo) o ON o.symbol=l.symbol AND o.strategy=q.strategy LEFT JOIN (SELECT v.score, k.* FROM bestc v JOIN combos k ON k.combo=v.combo) g ON g.strategy=q.strategy),
pl AS (SELECT pl0.*, p.pb, p.pd FROM pl0 JOIN (SELECT rule, pb, pd FROM combos UNION SELECT rule, pb, pd FROM presets) p ON p.rule=pl0.rule),
nw AS (SELECT * FROM sig_live QUALIFY row_number() OVER (PARTITION BY symbol, rule ORDER BY rn DESC)=1), rg AS (SELECT arg_max(regime,date) AS mr FROM regime),
j AS (SELECT pl.*, n.date, n.close, n.indicator AS i, n.setup, coalesce(CASE strategy WHEN 'regime_rsi' THEN n.indicator<=CASE WHEN mr='bull' THEN pd ELSE pb END+3 WHEN 'rsi_recovery' THEN n.indicator BETWEEN pb AND pd+3 WHEN 'bollinger_lower' THEN abs(n.indicator)<=3 WHEN 'donchian' THEN abs(n.indicator)<=3
 WHEN 'trend_pullback' THEN abs(n.indicator)<=3 WHEN 'relative_strength' THEN n.indicator>=pb-3 WHEN 'cross_momentum' THEN n.indicator>=pb-3 ELSE n.indicator<=3 END, false) AS near FROM pl JOIN nw n ON n.symbol=pl.symbol AND n.rule=pl.rule, rg)
SELECT symbol, strategy, rule, date, close, R4{{i}} AS indicator, parameter_source, R4{{score}} AS score, R4{{return_uplift}} AS return_uplift, stop_loss, max_hold, 5.0 AS profit_target, CASE WHEN setup THEN 'Setup Confirmed' WHEN near THEN 'Watch' ELSE 'Neutral' END AS signal FROM j""")
def _(m):
    res = S.cut_lineage(holdout(m)[0])
    best = S.cut_lineage(S.best_combo(S.summarize(res)))
    quote = F.floor(F.col("price") * 100 * (6 + F.expr("substr(symbol, 2)").cast("long") % 9) / 10) / 100
    px = S.with_live_quote(stored_closes(m), m.profiles.select("symbol", quote.alias("quote")), SCAN_DAY, WARM)
    px = cut_packed(px)
    plan = S.scan_plan(px.select("symbol").distinct(), grid(m, "quick"), grid(m), best, S.stock_overrides(res, best))
    both = grid(m).unionByName(grid(m, "quick"))
    out = S.scan(S.signals(series(m, px, S.lookbacks_of(SCANNED)), SCANNED, latest=True), plan, both, R.regime_series(m.benchmark))
    return out.select(*[rnd(c, 4).alias(c) if c in ("indicator", "score", "return_uplift") else F.col(c) for c in out.columns])


@query("L21_buy_and_hold", """
b AS (SELECT symbol, (arg_max(close,date)/arg_min(close,date)-1)*100 AS bh FROM prices GROUP BY symbol)
SELECT m.symbol, combo, R4{bh} AS benchmark_return, R4{total_return-bh} AS alpha FROM met_all m JOIN b ON b.symbol=m.symbol""")
def _(m):
    d = S.metrics(S.trades(series(m), RULES, grid(m))).join(S.buy_and_hold(m.closes), "symbol")
    return d.select("symbol", "combo", rnd("benchmark_return", 4).alias("benchmark_return"), rnd(F.col("total_return") - F.col("benchmark_return"), 4).alias("alpha"))


@query("L22_label_trades", """
l AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM prices), b AS (SELECT * FROM l WHERE rn%11=3), s AS (SELECT symbol, date, close FROM l WHERE rn%17=5)
SELECT b.symbol, b.date, b.close AS close_buy, s.close AS close_sell, s.date AS sell_date, R6{s.close/b.close*100-100} AS gain, s.date-b.date AS duration FROM b ASOF LEFT JOIN s ON b.symbol=s.symbol AND b.date<=s.date""")
def _(m):
    rn = F.row_number().over(R.by_symbol())
    lab = m.closes.select("symbol", "date", rn.alias("rn"))
    lab = lab.where("rn % 11 = 3").select("symbol", "date", F.lit("buy").alias("label")).unionByName(lab.where("rn % 17 = 5").select("symbol", "date", F.lit("sell").alias("label")))
    return S.label_trades(m.closes, lab).withColumn("gain", rnd("gain"))


