"""Rule-based swing strategies: signals, trades, metrics, holdout and scanning.

Indicators are computed once per series, signals once per parameter set; exit
rules meet only the sparse entry candidates. A series is one (symbol, part)
with at most one row per day, so its windows are bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import long_pct_ranks
from ..functions.scalars import exact_avg, exact_sum, sdiv
from ..functions.sequential import Days, Fold, Frames, fold_by_symbol, rolling_columns, smoothing
from ..session import cut_lineage, spread
from .asof import align_series
from .indicators import _ratio
from .returns import momentum_percentiles

KEY = ["symbol", "part"]


# Strategies, their parameter presets and default exits.
STRATEGIES = [
    "regime_rsi", "bollinger_lower", "rsi_recovery", "donchian",
    "squeeze", "trend_pullback", "relative_strength", "cross_momentum",
]
PROFIT_TARGET, STOP_LOSS, MAX_HOLD = 5.0, 2.0, 5
RULES_AT_ONCE = 63  # bits of a long
PRESETS = {
    "quick": {
        "params": {
            "regime_rsi": [(14, 30, 50, 45)],
            "bollinger_lower": [(20, 2.0, 14, 40)],
            "rsi_recovery": [(14, 30, 0, 35)],
            "donchian": [(20, 10, 50, 0.0)],
            "squeeze": [(20, 20, 10, 120)],
            "trend_pullback": [(20, 50, 2.0, 5)],
            "relative_strength": [(20, 2.0, 14, 40)],
            "cross_momentum": [(20, 80, 14, 40)],
        },
        "hold": [5],
        "exits": [(PROFIT_TARGET, STOP_LOSS)],
    },
    "balanced": {
        "params": {
            "regime_rsi": [(7, 30, 50, 45), (14, 30, 50, 45), (14, 35, 100, 50)],
            "bollinger_lower": [(20, 1.5, 14, 45), (20, 2.0, 14, 40)],
            "rsi_recovery": [(7, 25, 0, 35), (14, 30, 50, 40)],
            "donchian": [(10, 5, 20, 0.0), (20, 10, 50, 0.0)],
            "squeeze": [(20, 20, 10, 120), (20, 30, 20, 120)],
            "trend_pullback": [(10, 30, 1.5, 3), (20, 50, 2.0, 5)],
            "relative_strength": [(20, 0.0, 14, 40), (60, 3.0, 14, 45)],
            "cross_momentum": [(20, 75, 14, 40), (60, 80, 14, 45)],
        },
        "hold": [3, 5],
        "exits": [(PROFIT_TARGET, STOP_LOSS)],
    },
    "deep": {
        "params": {
            "regime_rsi": [(7, 25, 20, 40), (7, 30, 50, 45), (14, 30, 50, 45), (14, 35, 100, 50)],
            "bollinger_lower": [(10, 1.5, 7, 40), (20, 1.5, 14, 45), (20, 2.0, 14, 40), (30, 2.0, 14, 45)],
            "rsi_recovery": [(7, 25, 0, 35), (14, 25, 50, 35), (14, 30, 50, 40)],
            "donchian": [(10, 5, 20, 0.0), (20, 10, 50, 0.0), (50, 20, 100, 0.5)],
            "squeeze": [(10, 20, 10, 60), (20, 20, 10, 120), (20, 30, 20, 120)],
            "trend_pullback": [(5, 20, 1.0, 3), (10, 30, 1.5, 3), (20, 50, 2.0, 5)],
            "relative_strength": [(20, 0.0, 7, 40), (20, 2.0, 14, 40), (60, 3.0, 14, 45)],
            "cross_momentum": [(10, 70, 7, 40), (20, 75, 14, 40), (60, 80, 14, 45)],
        },
        "hold": [3, 5, 7],
        "exits": [(PROFIT_TARGET, 1.5), (PROFIT_TARGET, STOP_LOSS)],
    },
}


@dataclass(frozen=True)
class Rule:
    """One strategy with its four parameters."""

    strategy: str
    a: float
    b: float
    c: float
    d: float

    @property
    def id(self) -> str:
        return f"{self.strategy}:{self.a:g},{self.b:g},{self.c:g},{self.d:g}"

    @property
    def warmup(self) -> int:
        """Sessions needed before the first signal can be trusted (fixed values)."""
        a, b, c, d = (int(v) for v in (self.a, self.b, self.c, self.d))
        return {
            "squeeze": a + d + 5,
            "relative_strength": max(a, c, 50) + 5,
            "cross_momentum": max(a, c, 50) + 5,
            "trend_pullback": max(a, b, 50) + d + 5,
            "bollinger_lower": max(a, c, 50) + 5,
            "rsi_recovery": max(a, c, 50) + 10,
        }.get(self.strategy, max(a, b, c, 50) + 5)


def rules(preset: str) -> list[Rule]:
    return [Rule(s, *p) for s, ps in PRESETS[preset]["params"].items() for p in ps]


def grid(preset: str) -> list[tuple[Rule, int, float, float]]:
    """Every rule with every holding limit and exit rule of a preset."""
    p = PRESETS[preset]
    return [(r, h, t, s) for r, h, (t, s) in product(rules(preset), p["hold"], p["exits"])]


def grid_table(spark, preset: str) -> DataFrame:
    rows = [(i, r.id, r.strategy, float(r.a), float(r.b), float(r.c), float(r.d), h, t, s, r.warmup) for i, (r, h, t, s) in enumerate(grid(preset))]
    return spark.createDataFrame(rows, "combo int, rule string, strategy string, param_a double, param_b double, param_c double, param_d double, max_hold int, profit_target double, stop_loss double, warmup int")


def base_series(prices: DataFrame, regime: DataFrame, benchmark: DataFrame, lookbacks: set[int]) -> DataFrame:
    """Closes with the aligned regime, benchmark and momentum percentiles."""
    p = align_series(prices.select("symbol", "date", "close"), regime, {"regime": "regime"})
    p = align_series(p, benchmark, {"close": "bench"})
    w = Window.partitionBy("symbol").orderBy("date")
    if lookbacks:
        p = _with_momentum(p, prices, sorted(lookbacks))
    p = spread(p, "symbol") if not lookbacks else p  # all later windows and folds reuse this layout
    p = p.select("symbol", "date", "close", "regime", "bench", *[F.last(f"_m{n}", ignorenulls=True).over(w).alias(f"pct_{n}") for n in sorted(lookbacks)])
    return p.withColumn("regime", F.coalesce("regime", F.lit("bear"))).withColumn("part", F.lit("all")).withColumn("rn", F.row_number().over(w))


def _with_momentum(p: DataFrame, prices: DataFrame, lookbacks: list[int]) -> DataFrame:
    """A left join with the percentiles of every look-back, as ``_m{n}``: both sides are dealt by symbol once and meet by date in place."""
    found = momentum_percentiles(prices, lookbacks).select("symbol", "date", "sessions", "percentile")
    both = p.select("symbol", "date", F.struct("close", "regime", "bench").alias("_row")).unionByName(found, allowMissingColumns=True)
    each = [F.collect_list(F.when(F.col("sessions") == n, F.col("percentile"))).alias(f"_m{n}") for n in lookbacks]
    d = spread(both, "symbol").groupBy("symbol", "date").agg(F.collect_list("_row").alias("_row"), *each)
    d = d.select("symbol", "date", F.inline("_row"), *[f"_m{n}" for n in lookbacks])
    for n in lookbacks:
        d = d.withColumn(f"_m{n}", F.explode_outer(f"_m{n}"))
    return d


def lookbacks_of(rs: list[Rule]) -> set[int]:
    return {int(r.a) for r in rs if r.strategy == "cross_momentum"}


def rolls_of(r: Rule) -> set[tuple[str, int, int]]:
    """The rolling aggregates a rule reads: (kind, rows, shift).

    A window frame of Spark adds up all its rows anew for every row, so these come from the Arrow pass.
    """
    a, b, c = int(r.a), int(r.b), int(r.c)
    mean = {("avg", c, 0)} if c > 0 else set()
    if r.strategy in ("regime_rsi", "rsi_recovery"):
        return mean
    if r.strategy == "bollinger_lower":
        return {(kind, a, shift) for kind in ("avg", "sd") for shift in (0, 1)}
    if r.strategy == "donchian":
        return {("max", a, 1), ("max", a, 2), ("min", b, 1)} | mean
    if r.strategy == "squeeze":
        return {("max", c, 1), ("max", c, 2), ("avg", a, 0)}
    return set()


def smoothed_of(rs: list[Rule]) -> list[tuple]:
    """Folds of the smoothed columns and rolling aggregates that the rules read."""
    rsi, ema = set(), set()
    for r in rs:
        if r.strategy in ("regime_rsi", "rsi_recovery"):
            rsi.add(int(r.a))
        if r.strategy in ("bollinger_lower", "relative_strength", "cross_momentum"):
            rsi.add(int(r.c))
        if r.strategy == "trend_pullback":
            ema |= {int(r.a), int(r.b)}
    tight = {(int(r.a), float(r.b), int(r.d)) for r in rs if r.strategy == "squeeze"}
    return [smoothing("close", tuple(sorted(rsi)), tuple(sorted(ema)), tight=tuple(sorted(tight))), rolling_columns("close", frozenset().union(*(rolls_of(r) for r in rs)), "rn")]


def components(r: Rule, get: Callable[[str], np.ndarray], frames: Frames) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closing setup, strategy exit and the displayed indicator of one rule, in the order of the bars.

    ``get`` gives a column by name, NaN where it is missing; a comparison with what is missing does not hold.
    """
    lag, was = frames.lag, frames.was
    close = get("close")
    prev, bull, never = lag(close), get("_bull") == 1, np.zeros(len(close), bool)
    a, b, c, d = r.a, float(r.b), r.c, float(r.d)

    def roll(kind: str, n: float, shift: int = 0) -> np.ndarray:
        return get(f"{kind}_{int(n)}_{shift}")

    if r.strategy == "regime_rsi":
        rsi = get(f"rsi_{int(a)}")
        return np.where(get("_bear") == 1, rsi < b, (rsi < d) & (close > roll("avg", c))), never, rsi
    if r.strategy == "bollinger_lower":
        mid, pmid = roll("avg", a), roll("avg", a, 1)
        low = mid - b * roll("sd", a)
        plow = pmid - b * roll("sd", a, 1)
        setup = (close < low) & (prev >= plow) & (get(f"rsi_{int(c)}") <= d)
        return setup, (close >= mid) & (prev < pmid), (_ratio(close, low) - 1) * 100
    if r.strategy == "rsi_recovery":
        rsi = get(f"rsi_{int(a)}")
        prsi = lag(rsi)
        setup = was(rsi <= b, 5) & (rsi > d) & (prsi <= d)
        if int(c) > 0:
            setup &= close > roll("avg", c)
        return setup, (rsi >= 70) & (prsi < 70), rsi
    if r.strategy == "donchian":
        k = 1 + d / 100
        level, plevel = roll("max", a, 1) * k, roll("max", a, 2) * k
        setup = (close > level) & (prev <= plevel)
        if int(c) > 0:
            setup &= close > roll("avg", c)
        return setup & bull, close < roll("min", b, 1), (_ratio(close, level) - 1) * 100
    if r.strategy == "squeeze":
        n = int(a)
        tight = get(f"tight_{n}_{r.b:g}_{int(d)}".replace(".", "_"))
        high, phigh = roll("max", c, 1), roll("max", c, 2)
        return was(tight, 5) & (close > high) & (prev <= phigh) & bull, close < roll("avg", n), get(f"bw_{n}")
    if r.strategy == "trend_pullback":
        fast, slow = get(f"ema_{int(a)}"), get(f"ema_{int(b)}")
        pfast = lag(fast)
        setup = was(close <= fast * (1 + float(c) / 100), int(d)) & (fast > slow) & (close > fast) & (prev <= pfast) & bull
        return setup, (fast < slow) | ((close < fast) & (prev >= pfast)), (_ratio(close, fast) - 1) * 100
    rsi = get(f"rsi_{int(c)}")
    recovered = (rsi > d) & (lag(rsi) <= d)
    if r.strategy == "relative_strength":
        n, bench = int(a), get("bench")
        rs = (_ratio(close, lag(close, n)) - _ratio(bench, lag(bench, n))) * 100
        return (rs >= b) & recovered & bull, rs < 0, rs
    if r.strategy == "cross_momentum":
        pct = get(f"pct_{int(a)}")
        return (pct >= b) & recovered & bull, pct < 50, pct
    raise ValueError(f"Unknown strategy: {r.strategy}")


def _reads(rs: list[Rule]) -> list[str]:
    bench = ["bench"] if any(r.strategy == "relative_strength" for r in rs) else []
    return ["close", "rn", "_bull", "_bear", *bench, *(f"pct_{n}" for n in sorted(lookbacks_of(rs)))]


def _with_signals(series: DataFrame, rs: list[Rule], more: list[tuple], emit: list[str]) -> DataFrame:
    """One Arrow pass per series: smoothed columns, the signals of every rule (``_s``, ``_x`` and ``_v`` by number) and the folds of ``more``."""
    folds = smoothed_of(rs)
    made = [n.rsplit(" ", 1)[0] for f in folds for n in f[2]]

    def run(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        frames = Frames(values["rn"], days)
        ordered: dict[str, np.ndarray] = {}

        def get(name: str) -> np.ndarray:
            if name not in ordered:
                ordered[name] = values[name][frames.at]
            return ordered[name]

        with np.errstate(all="ignore"):
            return [frames.back(x) for r in rs for x in components(r, get, frames)]

    signal = ([*_reads(rs), *made], run, [n for i in range(len(rs)) for n in (f"_s{i} boolean", f"_x{i} boolean", f"_v{i} double")])
    known = series.withColumn("_bull", (F.col("regime") == "bull").cast("double")).withColumn("_bear", (F.col("regime") == "bear").cast("double"))
    return fold_by_symbol(known, KEY, "date", [*folds, signal, *more], emit)


def signals(series: DataFrame, rs: list[Rule], latest: bool = False) -> DataFrame:
    """(symbol, part, rule, rn) rows with setup, strategy exit and indicator; ``latest`` returns those of each series' last bar only."""
    cells = [F.struct(F.lit(r.id).alias("rule"), F.col(f"_s{i}").alias("setup"), F.col(f"_x{i}").alias("leave"), F.col(f"_v{i}").alias("indicator")) for i, r in enumerate(rs)]
    keep = [*KEY, "rn", "date", "close", "regime"]
    last = (["rn"], lambda values, days: [_last_of(values["rn"], days)], ["_last bigint"])
    d = _with_signals(series, rs, [last], [*keep, "_last", *(f"_{k}{i}" for i in range(len(rs)) for k in "sxv")])
    if latest:
        d = d.where("rn = _last")
    return d.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*")


def _last_of(rn: np.ndarray, days: Days) -> np.ndarray:
    return np.repeat(np.fmax.reduceat(rn, days.start), days.end - days.start).astype(np.int64)


def look_ahead(rs: list[Rule], longest: int) -> tuple[list[str], Fold, list[str]]:
    """For every session the setups of the one before as bits (``_em``) and, where there are any, the next ``longest`` closes and the exits signalled one session before each."""

    def run(values: dict[str, np.ndarray], days: Days) -> list:
        frames = Frames(values["rn"], days)
        setups, exits = (sum((values[f"_{k}{i}"].astype(np.int64) << i for i in range(len(rs))), np.zeros(len(values["rn"]), np.int64))[frames.at] for k in "sx")
        due = frames.lag(setups)
        return [frames.back(due), _last_of(values["rn"], days), frames.ahead(values["close"][frames.at], due > 0, 1, longest), frames.ahead(exits, due > 0, 0, longest)]

    return ["close", "rn", *(f"_{k}{i}" for i in range(len(rs)) for k in "sx")], run, ["_em bigint", "last_rn bigint", "ahead array<double>", "leaves array<bigint>"]


def trades(series: DataFrame, rs: list[Rule], combos: DataFrame) -> DataFrame:
    """Non-overlapping trades per (symbol, part, combo).

    A setup acts at the next session's close. The exit is the first later close
    that meets target, stop, a strategy exit signalled the session before, or
    the holding limit; an open position ends on the last bar and a position
    that would open there is dropped. The setups and exits of all rules travel
    as bits of one number, so the look-ahead runs once per session, in the pass
    that makes the signals, and only the sparse candidates leave it. Only the choice of the next entry
    after an exit is sequential: a fold over the few candidates of one series.
    A series shorter than a rule's warm-up has no trades under it. The
    look-ahead is the largest holding limit among the combos (a small table);
    a number holds the bits of 63 rules at most, larger sets go in groups.
    """
    if len(rs) > RULES_AT_ONCE:
        parts = [trades(series, rs[i : i + RULES_AT_ONCE], combos) for i in range(0, len(rs), RULES_AT_ONCE)]
        return reduce(DataFrame.unionByName, parts)
    longest = combos.agg(F.max("max_hold")).first()[0] or 1
    held = [*KEY, "rn", "date", "close", "regime", *(["start"] if "start" in series.columns else [])]
    c = _with_signals(series, rs, [look_ahead(rs, longest)], [*held, "_em", "last_rn", "ahead", "leaves"]).where("_em > 0 and rn < last_rn")
    if "start" in series.columns:
        c = c.where("part <> 'valid' or date >= start")
    c = spread(c, *KEY)  # before each candidate meets its combos
    warm = F.create_map(*[x for r in rs for x in (F.lit(r.id), F.lit(r.warmup))])
    bits = F.create_map(*[x for i, r in enumerate(rs) for x in (F.lit(r.id), F.lit(i))])
    j = F.broadcast(combos.select("combo", "max_hold", "profit_target", "stop_loss", bits[F.col("rule")].alias("bit"), warm[F.col("rule")].alias("warm")).where("bit is not null"))  # the preset grid
    c = c.join(j, F.expr("(shiftright(_em, bit) & 1L) = 1L and last_rn >= warm")).drop("warm")

    def hit(k: Column) -> Column:
        x = F.element_at("ahead", k)
        up = (F.col("profit_target") > 0) & (x >= F.col("close") * (1 + F.col("profit_target") / 100))
        down = (F.col("stop_loss") > 0) & (x <= F.col("close") * (1 - F.col("stop_loss") / 100))
        out = F.call_function("shiftright", F.element_at("leaves", k), F.col("bit")).bitwiseAND(F.lit(1)) == 1
        return up | down | out | (k >= F.col("max_hold"))

    steps = F.sequence(F.lit(1), F.size("ahead"))
    c = c.withColumn("held", F.coalesce(F.array_min(F.filter(steps, hit)), F.size("ahead")))
    c = c.withColumn("closes", F.slice("ahead", 1, F.col("held")))
    t = F.struct("rn", (F.col("rn") + F.col("held")).alias("exit_rn"), "date", "regime", F.col("close").alias("entry_price"), "closes")
    g = c.groupBy(*KEY, "combo").agg(F.array_sort(F.collect_list(t)).alias("ts"))
    kind = g.schema["ts"].dataType.simpleString()
    init = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("kept"))
    keep = lambda acc, x: F.when(
        x["rn"] > acc["free"], F.struct(x["exit_rn"].alias("free"), F.concat(acc["kept"], F.array(x)).alias("kept"))
    ).otherwise(acc)
    g = g.select(*KEY, "combo", F.posexplode(F.aggregate("ts", init, keep)["kept"]).alias("k", "t"))
    return g.select(
        *KEY, "combo", (F.col("k") + 1).alias("trade_no"), F.col("t.rn").alias("entry_rn"), "t.exit_rn", F.col("t.date").alias("entry_date"), "t.regime",
        "t.entry_price", F.element_at("t.closes", -1).alias("exit_price"), "t.closes",
    )


def metrics(tr: DataFrame, buy_fee: float = 0.15, sell_fee: float = 0.15, sell_tax: float = 0.1) -> DataFrame:
    """All-in compounding metrics in percent.

    Growth of one trade: exit*(1-s) / (entry*(1+b)). Trade return on the entry
    value: exit/entry*(1-s) - (1+b). Drawdown follows the daily marked equity,
    starting at 1.
    """
    b, s = buy_fee / 100, (sell_fee + sell_tax) / 100
    grown = F.col("exit_price") * (1 - s) / (F.col("entry_price") * (1 + b))
    ret = F.col("exit_price") / F.col("entry_price") * (1 - s) - (1 + b)
    w = Window.partitionBy(*KEY, "combo").orderBy("trade_no")
    t = tr.withColumn("g", grown).withColumn("r", ret)
    t = t.withColumn("before", F.coalesce(F.product("g").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    marks = F.concat(F.array("entry_price"), F.slice("closes", 1, F.size("closes") - 1))
    path = F.concat(F.transform(marks, lambda x: F.col("before") * x / (F.col("entry_price") * (1 + b))), F.array(F.col("before") * F.col("g")))
    # one pass: the trade's own figures count on the first mark of its path only
    e = t.select(*KEY, "combo", "trade_no", "before", "g", "r", "regime", F.posexplode(path).alias("j", "equity"))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(Window.partitionBy(*KEY, "combo").orderBy("trade_no", "j")))
    e = e.withColumn("dd", F.col("equity") / peak - 1)
    first = F.col("j") == 0
    once = lambda c: F.when(first, c)
    m = e.groupBy(*KEY, "combo").agg(
        ((F.max_by(F.col("before") * F.col("g"), once(F.col("trade_no"))) - 1) * 100).alias("total_return"), (F.avg(once((F.col("r") > 0).cast("double"))) * 100).alias("win_rate"),
        F.count(once(F.lit(1))).alias("trades"), (exact_avg(once(F.col("r"))) * 100).alias("avg_trade"),
        F.count_if(first & (F.col("regime") == "bear")).alias("bear_entries"), F.count_if(first & (F.col("regime") == "bull")).alias("bull_entries"),
        (F.least(F.lit(0.0), F.min("dd")) * 100).alias("max_drawdown"),
    )
    return m.dropna(subset=[*KEY, "combo"])


def split_series(series: DataFrame, validation_pct: float, warmup: int) -> tuple[DataFrame, DataFrame]:
    """Train and validation parts per symbol plus a status row per symbol.

    The validation part starts ``warmup`` rows early so indicators are ready;
    its trades may only open from the split date on.
    """
    n = Window.partitionBy("symbol")
    s = series.withColumn("_n", F.count("*").over(n)).withColumn("_cut", F.floor(F.col("_n") * F.lit(1 - validation_pct / 100)).cast("int"))
    ok = (F.col("_cut") >= warmup) & (F.col("_n") - F.col("_cut") >= warmup)
    status = s.groupBy("symbol").agg(F.bool_and(ok).alias("enough"))
    s = s.where(ok).withColumn("start", F.max(F.when(F.col("rn") == F.col("_cut") + 1, F.col("date"))).over(n))
    i = F.col("rn") - 1
    parts = F.array_compact(F.array(F.when(i < F.col("_cut"), F.lit("train")), F.when(i >= F.greatest(F.lit(0), F.col("_cut") - warmup), F.lit("valid"))))
    s = s.withColumn("part", F.explode(parts)).drop("_n", "_cut", "rn")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy("date"))), status


def holdout_results(m: DataFrame) -> DataFrame:
    """One row per (symbol, combo) that traded in training, with its validation figures."""
    cols = ["total_return", "win_rate", "max_drawdown", "trades", "avg_trade"]
    both = [c for c in m.columns if c not in ("symbol", "part", "combo")]
    # ``metrics`` has one row per part, so one grouping reads it once where a join of its parts would make it twice
    g = m.groupBy("symbol", "combo").agg(
        F.max(F.when(F.col("part") == "train", F.struct(*both))).alias("_t"),
        F.max(F.when(F.col("part") == "valid", F.struct(*[F.col(c).alias(f"val_{c}") for c in cols]))).alias("_v"),
    ).where("_t is not null")
    return g.select("symbol", "combo", "_t.*", "_v.*").withColumn("val_trades", F.coalesce("val_trades", F.lit(0)))


def symbol_status(requested: DataFrame, split_status: DataFrame, results: DataFrame) -> DataFrame:
    got = results.select("symbol").distinct().withColumn("_got", F.lit(True))
    j = requested.select("symbol").distinct().join(split_status, "symbol", "left").join(got, "symbol", "left")
    s = F.when(F.col("enough").isNull(), "missing_data").when(~F.col("enough"), "insufficient_history").when(F.col("_got"), "ok").otherwise("no_signals")
    return j.select("symbol", s.alias("status"))


def _wmean(v: str, w: str, cond: Column) -> Column:
    use = cond & F.col(v).isNotNull() & (F.col(w) > 0)
    return F.try_divide(exact_sum(F.when(use, F.col(v) * F.col(w)), 12), F.sum(F.when(use, F.col(w))).cast("double"))


# Weights of the blended strategy score.
SUMMARY_WEIGHTS = {"val_avg_trade": 0.30, "val_win_rate": 0.15, "median_return": 0.15, "positive_pct": 0.15, "coverage_pct": 0.15, "drawdown_control": 0.10}


def summarize(results: DataFrame) -> DataFrame:
    """Holdout robustness of every combo across stocks and its blended score.

    The median per combo is exact for any number of stocks. Sums are fixed-point
    and ranks compare nine digits, so combos that traded alike are ties in
    whatever order and partitions their rows come.
    """
    from ..functions.ranking import distribution

    r = cut_lineage(results)
    ok = F.col("val_trades") > 0
    total = r.agg(F.count_distinct("symbol").alias("_u"))
    med = distribution(r.where(ok), "val_total_return", ["combo"], {"median_return": 0.5}, moments=False).select("combo", "median_return")
    s = r.groupBy("combo").agg(
        F.count_distinct("symbol").alias("stocks_tested"), F.count_distinct(F.when(ok, F.col("symbol"))).alias("stocks_validated"),
        F.sum("trades").alias("train_trades"), F.sum("val_trades").alias("val_trades"),
        _wmean("avg_trade", "trades", F.lit(True)).alias("train_avg_trade"), _wmean("val_avg_trade", "val_trades", ok).alias("val_avg_trade"),
        _wmean("val_win_rate", "val_trades", ok).alias("val_win_rate"), _wmean("val_max_drawdown", "val_trades", ok).alias("val_drawdown"),
        (F.avg(F.when(ok, (F.col("val_total_return") > 0).cast("double"))) * 100).alias("positive_pct"),
    ).join(med, "combo", "left").crossJoin(F.broadcast(total))
    s = s.withColumn("coverage_pct", sdiv("stocks_validated", "_u") * 100).withColumn("drawdown_control", -F.abs("val_drawdown"))
    s = cut_lineage(s.withColumn("generalization_gap", F.col("val_avg_trade") - F.col("train_avg_trade")))
    ranks = long_pct_ranks(s, ["combo"], {c: F.round(F.col(c).cast("double"), 9) for c in SUMMARY_WEIGHTS}).withColumnsRenamed({c: f"_r_{c}" for c in SUMMARY_WEIGHTS})
    score = sum((F.coalesce(F.col(f"_r_{c}"), F.lit(0.0)) * w * 100 for c, w in SUMMARY_WEIGHTS.items()), F.lit(0.0))
    return s.join(ranks, "combo", "left").withColumn("score", score).drop("_u", "drawdown_control", *[f"_r_{c}" for c in SUMMARY_WEIGHTS])


def qualified(summary: DataFrame) -> DataFrame:
    """Combos with enough validation evidence, or all that traded when none has it.

    The summary has one row per combo of the preset.
    """
    s = summary.crossJoin(F.broadcast(summary.agg(F.max("stocks_tested").alias("_t"))))
    strict = (F.col("stocks_validated") >= F.greatest(F.lit(3), F.ceil(F.col("_t") * 0.20))) & (F.col("val_trades") >= F.greatest(F.lit(20), F.col("_t") * 2))
    s = s.withColumn("_ok", strict)
    s = s.crossJoin(F.broadcast(s.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_any"))))
    return s.where(F.when(F.col("_any"), F.col("_ok")).otherwise(F.col("val_trades") > 0)).drop("_t", "_ok", "_any")


def best_combo(summary: DataFrame) -> DataFrame:
    return qualified(summary).orderBy(F.round("score", 9).desc(), F.round("val_avg_trade", 9).desc_nulls_last(), F.desc("val_trades"), "combo").limit(1)


# Weights of a stock's own score.
STOCK_WEIGHTS = {"val_avg_trade": 0.35, "val_win_rate": 0.20, "val_total_return": 0.20, "val_trades": 0.15, "drawdown_control": 0.10}


def stock_overrides(results: DataFrame, best: DataFrame) -> DataFrame:
    """Per stock the best combo that beats the global one on holdout return.

    Candidates of one stock are at most the combos of the preset, so the ranks
    are plain windows per symbol.
    """
    glob = results.join(F.broadcast(best.select("combo")), "combo").where("val_trades > 0 and val_total_return is not null").select("symbol", F.col("val_total_return").alias("global_return"))
    c = results.join(glob, "symbol").where((F.col("val_trades") > 0) & (F.col("val_total_return") > F.col("global_return") + 1e-9))
    c = c.withColumn("drawdown_control", -F.abs("val_max_drawdown"))
    for m, _ in STOCK_WEIGHTS.items():
        k = F.round(F.col(m).cast("double"), 9)  # equal results of combos that traded alike are ties, whatever the order of sums
        part = Window.partitionBy("symbol", k.isNull())
        r = F.rank().over(part.orderBy(k)) + (F.count("*").over(Window.partitionBy("symbol", k)) - 1) / 2
        c = c.withColumn(f"_r_{m}", F.when(F.col(m).isNotNull(), r / F.count("*").over(part)))
    score = sum((F.coalesce(F.col(f"_r_{m}"), F.lit(0.0)) * w * 100 for m, w in STOCK_WEIGHTS.items()), F.lit(0.0))
    c = c.withColumn("score", score)
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("score", 9).desc(), F.desc("val_trades"), F.round("val_avg_trade", 9).desc(), "combo"))
    return c.withColumn("_rn", rn).where("_rn = 1").select("symbol", "combo", "score", "val_trades", "val_avg_trade", "val_total_return", "global_return", (F.col("val_total_return") - F.col("global_return")).alias("return_uplift"))


def scan_plan(symbols: DataFrame, base: DataFrame, combos: DataFrame, best: DataFrame, overrides: DataFrame) -> DataFrame:
    """One configuration per (symbol, strategy): own optimum, else the global one, else the preset."""
    own = overrides.join(F.broadcast(combos), "combo").select("symbol", "strategy", F.struct("rule", "max_hold", "stop_loss", "score", "return_uplift").alias("_o"))
    glob = best.select("combo", "score").join(combos, "combo").select("strategy", F.struct("rule", "max_hold", "stop_loss", "score", F.lit(None).cast("double").alias("return_uplift")).alias("_g"))
    pre = F.struct("rule", F.lit(MAX_HOLD).alias("max_hold"), F.lit(STOP_LOSS).alias("stop_loss"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("return_uplift"))
    plan = symbols.select("symbol").withColumn("_s", F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))).withColumnRenamed("_s", "strategy")
    plan = plan.join(F.broadcast(base.select("strategy", pre.alias("_p"))), "strategy").join(own, ["symbol", "strategy"], "left").join(F.broadcast(glob), "strategy", "left")
    source = F.when(F.col("_o").isNotNull(), "Stock-specific optimized").when(F.col("_g").isNotNull(), "Global optimized").otherwise("Baseline preset")
    return plan.select("symbol", "strategy", F.coalesce("_o", "_g", "_p").alias("c"), source.alias("parameter_source")).select("symbol", "strategy", "c.*", "parameter_source")


def with_live_quote(prices: DataFrame, quotes: DataFrame, asof: str, required: int, fresh_days: int = 7) -> DataFrame:
    """Histories long and fresh enough, plus today's quote when within 35 % of the last close."""
    last = prices.groupBy("symbol").agg(F.max("date").alias("_d"), F.max_by("close", "date").alias("_c"), F.count("*").alias("_n"))
    d = F.lit(asof).cast("date")
    ok = last.where((F.col("_n") >= required) & (F.col("_d") >= F.date_sub(d, fresh_days)))
    live = ok.join(quotes, "symbol").where((F.col("quote") > 0) & sdiv("quote", "_c").between(0.65, 1.35))
    old = prices.select("symbol", "date", "close").join(ok.select("symbol"), "symbol", "left_semi").where(F.col("date") < d)
    return old.unionByName(live.select("symbol", d.alias("date"), F.col("quote").alias("close")))


# How far from its trigger a setup is still worth watching, by strategy.
def near_setup(band: float) -> Column:
    i, b, d = F.col("indicator"), F.col("param_b"), F.col("param_d")
    s = F.col("strategy")
    limit = F.when(F.col("market_regime") == "bull", d).otherwise(b)
    return F.coalesce(
        F.when(s == "regime_rsi", i <= limit + band)
        .when(s == "rsi_recovery", i.between(b, d + band))
        .when(s.isin("bollinger_lower", "donchian", "trend_pullback"), F.abs(i) <= band)
        .when(s.isin("relative_strength", "cross_momentum"), i >= b - band)
        .otherwise(i <= band), F.lit(False))


def scan(sig: DataFrame, plan: DataFrame, combos: DataFrame, regime: DataFrame, band: float = 3.0) -> DataFrame:
    """State of every planned strategy on each symbol's latest bar."""
    last = Window.partitionBy("symbol", "rule").orderBy(F.desc("rn"))
    now = sig.withColumn("_l", F.row_number().over(last)).where("_l = 1").select("symbol", "rule", "date", "close", "setup", "indicator")
    params = combos.select("rule", "param_b", "param_d").distinct()
    today = regime.agg(F.max_by("regime", "date").alias("market_regime"))
    j = plan.join(now, ["symbol", "rule"]).join(F.broadcast(params), "rule").crossJoin(F.broadcast(today))
    j = j.withColumn("near", near_setup(band))
    signal = F.when(F.col("setup"), "Setup Confirmed").when(F.col("near"), "Watch").otherwise("Neutral")
    return j.select("symbol", "strategy", "rule", "date", "close", "indicator", "parameter_source", "score", "return_uplift", "stop_loss", "max_hold", F.lit(PROFIT_TARGET).alias("profit_target"), signal.alias("signal"))


def label_trades(prices: DataFrame, labels: DataFrame) -> DataFrame:
    """Each buy with the next sell at or after it: gain in percent and days held."""
    from .asof import asof_join

    j = prices.join(labels, ["symbol", "date"])
    buy = j.where("label = 'buy'").select("symbol", "date", F.col("close").alias("close_buy"))
    sell = j.where("label = 'sell'").select("symbol", "date", "close", F.col("date").alias("sell_date"))
    t = asof_join(buy, sell, ["symbol"], {"close": "close_sell", "sell_date": "sell_date"}, direction="forward")
    return t.withColumn("gain", sdiv("close_sell", "close_buy") * 100 - 100).withColumn("duration", F.datediff("sell_date", "date"))


def buy_and_hold(prices: DataFrame) -> DataFrame:
    g = prices.groupBy("symbol").agg(F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_b"))
    return g.select("symbol", ((sdiv("_b", "_a") - 1) * 100).alias("benchmark_return"))


