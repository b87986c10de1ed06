"""Holdings, income, historical replay and projections for many holders at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LOT_SIZE, finite, require_columns, sdiv
from ..session import spread
from .asof import asof_join
from .dividends import shift_to_year


def clean_symbol(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.upper(F.trim(c)), r"\.JK$", "")


def _positive(c: str) -> Column:
    """The number in a text if it is positive and finite; the text is parsed once."""
    v = F.trim(F.replace(F.col(c), F.lit(","), F.lit(""))).try_cast("double")
    return F.get(F.filter(F.array(v), lambda x: (x > 0) & (x < float("inf"))), F.lit(0))  # NaN is above infinity


def normalize_holdings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean holdings with duplicates combined at weighted cost, and the rejected rows.

    Input columns: holder, Symbol, Available Lot, Average Price (text).
    """
    require_columns(raw, "Symbol", "Available Lot", "Average Price")
    # behind a generator no filter is pushed down, where it would parse every text again
    parsed = F.struct(clean_symbol("Symbol").alias("symbol"), _positive("Available Lot").alias("lots"), _positive("Average Price").alias("price"))
    d = raw.select("holder", F.explode(F.array(parsed)).alias("_r")).select("holder", "_r.*")
    d = d.where("symbol is not null and symbol <> ''")
    bad = d.where("lots is null or price is null").select("holder", "symbol", F.when(F.col("lots").isNull(), "Available Lot").otherwise("Average Price").alias("column"))
    good = d.where("lots is not null and price is not null").groupBy("holder", "symbol").agg(F.sum("lots").alias("lots"), F.sum(F.col("lots") * F.col("price")).alias("_v"))
    return good.select("holder", "symbol", "lots", sdiv("_v", "lots").alias("avg_price")), bad


def with_market(holdings: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings with price, sector and dividend, plus rows without market data.

    Profiles are made unique per cleaned symbol first, so the join stays one to one.
    """
    p = profiles.select(clean_symbol("symbol").alias("symbol"), F.col("symbol").alias("_raw"), "price", "sector", F.col("lastDiv").alias("div_rate"))
    p = p.groupBy("symbol").agg(F.min_by(F.struct(F.col("price").alias("last_price"), "sector", "div_rate"), "_raw").alias("p")).select("symbol", "p.*")
    unknown = holdings.join(p, "symbol", "left_anti").select("holder", "symbol")
    return holdings.join(p, "symbol"), unknown


def validate_market(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with usable market fields, and the others with the field at fault."""
    fault = (
        F.when(F.coalesce(finite("last_price") > 0, F.lit(False)) == F.lit(False), "market price must be greater than zero")
        .when(F.coalesce(finite("div_rate") >= 0, F.lit(False)) == F.lit(False), "annual dividend must be zero or greater")
    )
    d = df.withColumn("fault", fault)
    sector = F.when(F.coalesce("sector", F.lit("")) == "", "Unclassified").otherwise(F.col("sector"))
    return d.where("fault is null").drop("fault").withColumn("sector", sector), d.where("fault is not null").select("holder", "symbol", "fault")


def position_metrics(df: DataFrame) -> DataFrame:
    return df.select(
        "*", (F.col("lots") * F.col("avg_price") * LOT_SIZE).alias("total_invested"), (sdiv("div_rate", "avg_price") * 100).alias("yield_on_cost"),
        (sdiv("div_rate", "last_price") * 100).alias("yield_on_price"), (F.col("div_rate") * F.col("lots") * LOT_SIZE).cast("long").alias("total_dividend"),
    )


def holder_totals(pos: DataFrame, target_millions: float) -> DataFrame:
    g = pos.groupBy("holder").agg(F.sum("total_dividend").alias("annual_dividend"), F.sum("total_invested").alias("total_investment"), F.sum(F.col("lots") * F.col("last_price") * LOT_SIZE).alias("current_value"))
    return g.withColumn("achieved_pct", F.col("annual_dividend") / target_millions * 100 / 1_000_000 if target_millions > 0 else F.lit(0.0)).withColumn(
        "yield_on_cost", F.when(F.col("total_investment") > 0, sdiv("annual_dividend", "total_investment") * 100).otherwise(0.0))


def sector_income(pos: DataFrame) -> DataFrame:
    return pos.groupBy("holder", "sector").agg(F.sum("total_dividend").alias("total_dividend"), F.count("*").alias("stocks"))


def income_timeline(pos: DataFrame, div: DataFrame, asof: str) -> DataFrame:
    """Ordinary dividends each holder received over the last 365 days."""
    d = F.lit(asof).cast("date")
    recent = div.where((F.col("date") >= F.date_sub(d, 365)) & (F.col("date") < d) & (F.col("dividend_type") != "special"))
    j = pos.select("holder", "symbol", "lots", "last_price").join(recent, "symbol")
    return j.select(
        "holder", "symbol", "date", "adjDividend", (F.col("lots") * F.col("adjDividend") * LOT_SIZE).cast("long").alias("total_dividend"),
        F.month("date").alias("month"), F.when(F.col("last_price") > 0, sdiv("adjDividend", "last_price") * 100).otherwise(0.0).alias("yield"),
        shift_to_year("date", F.year(d) - 1).alias("calendar_date"),
    )


def income_projection(totals: DataFrame, years: int, growth_pct: float, target_millions: float) -> DataFrame:
    i = F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year")
    p = totals.select("holder", "annual_dividend", "total_investment", i)
    income = F.col("annual_dividend") * F.pow(F.lit(1 + growth_pct / 100), (F.col("year") - 1).cast("double"))
    p = p.withColumn("income", income)
    return p.select("holder", "year", "income", (F.col("income") > target_millions * 1_000_000).alias("achieved"), (sdiv("income", "total_investment") * 100).alias("yield_on_cost"))


HOT_PAYMENTS = 1 << 20  # a holder with more payments is summed up in all tasks


def payment_totals(pay: DataFrame, sectors: DataFrame, hot: int = HOT_PAYMENTS) -> DataFrame:
    """Received dividends by stock, year, month, day, sector and industry; unknown stocks count as 'Unclassified'.

    The payments travel once, to the task of their holder, which makes the sums
    of every level. A holder with more than ``hot`` payments would be one long
    task: those are summed up before they travel, level by level.
    """
    big = pay.groupBy("holder").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("holder")
    s = sectors.select(F.col("symbol").alias("stock"), "sector", "industry")

    rows = pay.select("holder", "stock", "date", "total", F.lit(1).cast("long").alias("n"))

    def described(p: DataFrame) -> DataFrame:
        return p.join(s, "stock", "left").fillna("Unclassified", ["sector", "industry"])

    near = spread(described(rows.join(F.broadcast(big), "holder", "left_anti")), "holder")
    far = rows.join(F.broadcast(big), "holder", "left_semi").groupBy("holder", "stock", "date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _level_sums(near).unionByName(_level_sums(described(far)))


def _level_sums(b: DataFrame) -> DataFrame:
    """Sums of every level; rows that lie in the task of their holder stay there."""
    keys = {
        "stock": F.col("stock"), "year": F.year("date").cast("string"), "year_month": F.when(F.col("date").isNotNull(), F.format_string("%04d-%02d", F.year("date"), F.month("date"))),
        "date": F.col("date").cast("string"), "sector": F.col("sector"), "industry": F.col("industry"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("l"), k.alias("key")) for i, k in enumerate(keys.values())])).alias("_e")
    g = b.select("holder", "total", "n", each).groupBy("holder", F.col("_e.l").alias("l"), F.col("_e.key").alias("key")).agg(F.sum("total").alias("total"), F.sum("n").alias("payments"))
    level = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("l") + 1)
    return g.select("holder", level.alias("level"), "key", "total", "payments")


def day_shares(pay: DataFrame) -> DataFrame:
    """Payments of each day and their share of the year."""
    d = pay.groupBy("holder", "date").agg(F.sum("total").alias("total"), F.count("*").alias("payments"))
    y = d.groupBy("holder", F.year("date").alias("year")).agg(F.sum("total").alias("_y"))
    return d.withColumn("year", F.year("date")).join(y, ["holder", "year"]).select("holder", "date", "payments", "total", sdiv("total", "_y").alias("pct"))


def compare_month(pay: DataFrame, first: int, second: int, month: int) -> DataFrame:
    p = pay.where((F.month("date") == month) & F.year("date").isin(first, second))
    return p.groupBy("holder").agg(*[F.coalesce(F.sum(F.when(F.year("date") == y, F.col("total"))), F.lit(0.0)).alias(n) for y, n in ((first, "first_total"), (second, "second_total"))])


def payment_span(pay: DataFrame) -> DataFrame:
    """First and last payment and the span as years of 365 and months of 30 days."""
    g = pay.groupBy("holder").agg(F.sum("total").alias("total"), F.count("*").alias("payments"), F.count_distinct("stock").alias("stocks"), F.min("date").alias("first"), F.max("date").alias("last"))
    d = F.datediff("last", "first")
    return g.select("*", F.floor(d / 365).cast("int").alias("years"), F.floor((d % 365) / 30).cast("int").alias("months"), ((d % 365) % 30).alias("days"))


def build_allocations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid (scenario, symbol, amount) rows and the rejected ones with a reason.

    Blank symbols are skipped; a repeated symbol or a bad amount is an error.
    """
    d = raw.select("scenario", F.upper(F.trim("stock")).alias("symbol"), finite(F.col("value").try_cast("double")).alias("amount")).where("symbol is not null and symbol <> ''")
    n = d.groupBy("scenario", "symbol").agg(F.count("*").alias("_n"), F.min("amount").alias("amount"), F.bool_and(F.coalesce(F.col("amount") > 0, F.lit(False))).alias("_ok"))
    reason = F.when(F.col("_n") > 1, "duplicate ticker").when(~F.col("_ok"), "amount must be greater than zero")
    n = n.withColumn("reason", reason)
    return n.where("reason is null").select("scenario", "symbol", "amount"), n.where("reason is not null").select("scenario", "symbol", "reason")


def _buy_days(events: DataFrame, prices: DataFrame) -> DataFrame:
    """First close on or after each event date."""
    px = prices.select("symbol", "date", "close", F.col("date").alias("buy_date"))
    return asof_join(events, px, ["symbol"], {"close": "buy_price", "buy_date": "buy_date"}, direction="forward")


def year_ends(prices: DataFrame, start: int, end: int) -> DataFrame:
    p = prices.where(F.year("date").between(start, end))
    return p.groupBy("symbol", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("end_price"))


def _replay_input(alloc: DataFrame, prices: DataFrame, div: DataFrame, start: int, end: int) -> DataFrame:
    """Allocations with first purchase, year ends and dividend events of symbols that have a close in every year."""
    opens = prices.select("symbol").distinct().withColumn("date", F.make_date(F.lit(start), F.lit(1), F.lit(1)))
    first = _buy_days(opens, prices).where(F.year("buy_date") == start).select("symbol", F.col("buy_price").alias("first_price"), F.col("buy_date").alias("first_date"))
    ends = year_ends(prices, start, end).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("year", "end_price"))).alias("ends"))
    ends = ends.where(F.size("ends") == end - start + 1)
    ev = div.where(F.col("adjDividend") >= 0).select("symbol", "date", "adjDividend").where(F.year("date").between(start, end))
    ev = _buy_days(ev, prices).join(first.select("symbol", "first_date"), "symbol").where("date >= first_date")
    usable = F.when(F.year("buy_date") == F.year("date"), F.col("buy_price"))
    ev = ev.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", F.year("date").alias("year"), "adjDividend", usable.alias("buy_price"), "buy_date"))).alias("events"))
    j = alloc.join(first, "symbol").join(ends, "symbol").join(ev, "symbol", "left")
    j = j.withColumn("events", F.coalesce("events", F.array().cast(ev.schema["events"].dataType.simpleString())))
    lots = F.floor(F.col("amount") / (F.col("first_price") * LOT_SIZE)).cast("double")
    return j.withColumn("lots0", lots).withColumn("cash0", F.col("amount") - F.col("lots0") * F.col("first_price") * LOT_SIZE)


def replay_rejected(alloc: DataFrame, prices: DataFrame, start: int, end: int) -> DataFrame:
    """Allocations that cannot be replayed: the stock has no close in the first or in a later year."""
    have = prices.where(F.year("date").between(start, end)).groupBy("symbol").agg(F.collect_set(F.year("date")).alias("_have"))
    every = F.sequence(F.lit(start), F.lit(end))
    j = alloc.select("scenario", "symbol").join(have, "symbol", "left")
    j = j.withColumn("_y", F.array_min(F.array_except(every, F.coalesce("_have", F.array().cast("array<int>"))))).where("_y is not null")
    reason = F.when(F.col("_y") == start, f"no price in {start}").otherwise(F.concat(F.lit("no price through "), F.col("_y").cast("string")))
    return j.select("scenario", "symbol", reason.alias("reason"))


def entered(alloc: DataFrame, detail: DataFrame) -> DataFrame:
    """The allocations that a replay took in."""
    return alloc.join(detail.select("scenario", "symbol").distinct(), ["scenario", "symbol"], "left_semi")


def replay(alloc: DataFrame, prices: DataFrame, div: DataFrame, start: int, end: int) -> DataFrame:
    """Year-by-year replay of every (scenario, symbol) with and without reinvestment.

    Whole lots only; dividends turn to cash; with reinvestment the cash buys
    the same stock at the first close on or after the ex-date if that falls in
    the same year. ``replay_rejected`` lists the symbols that it cannot take.
    The state is one stock's lots and cash, so the fold runs over its few
    dividend events; events are gathered once per symbol, scenarios only add
    their amount.
    """
    j = _replay_input(alloc, prices, div, start, end)
    row = "struct<year:int,strategy:string,lots:double,price:double,value:double,cash:double,income:double>"

    def run(drip: bool) -> Column:
        def step(acc, e):
            pay = acc["lots"] * LOT_SIZE * e["adjDividend"]
            cash = acc["cash"] + pay
            n = F.coalesce(F.floor(cash / (e["buy_price"] * LOT_SIZE)).cast("double"), F.lit(0.0)) if drip else F.lit(0.0)
            cost = F.when(n > 0, n * e["buy_price"] * LOT_SIZE).otherwise(0.0)
            return F.struct((acc["lots"] + n).alias("lots"), (cash - cost).alias("cash"), (acc["income"] + pay).alias("income"))

        def year(acc, y):
            mine = F.filter("events", lambda e: e["year"] == y["year"])
            s = F.aggregate(mine, F.struct(acc["lots"].alias("lots"), acc["cash"].alias("cash"), F.lit(0.0).alias("income")), step)
            out = F.struct(
                y["year"].alias("year"), F.lit("With DRIP" if drip else "No DRIP").alias("strategy"), s["lots"].alias("lots"), y["end_price"].alias("price"),
                (s["lots"] * y["end_price"] * LOT_SIZE).alias("value"), s["cash"].alias("cash"), s["income"].alias("income"),
            ).cast(row)
            return F.struct(s["lots"].alias("lots"), s["cash"].alias("cash"), F.concat(acc["rows"], F.array(out)).alias("rows"))

        init = F.struct(F.col("lots0").alias("lots"), F.col("cash0").alias("cash"), F.array().cast(f"array<{row}>").alias("rows"))
        return F.aggregate("ends", init, year)["rows"]

    both = F.concat(run(True), run(False))
    return j.select("scenario", "symbol", F.explode(both).alias("r")).select("scenario", "symbol", "r.*")


def replay_transactions(alloc: DataFrame, prices: DataFrame, div: DataFrame, start: int, end: int) -> DataFrame:
    """First purchases, dividends under both strategies and reinvestment purchases of the replay, as rows.

    ``lots`` are those bought, or those held when the dividend is paid.
    """
    j = _replay_input(alloc, prices, div, start, end)
    row = "struct<date:date,strategy:string,activity:string,lots:double,amount:double>"

    def step(acc, e):
        pay, plain = acc["lots"] * LOT_SIZE * e["adjDividend"], F.col("lots0") * LOT_SIZE * e["adjDividend"]
        cash = acc["cash"] + pay
        n = F.coalesce(F.floor(cash / (e["buy_price"] * LOT_SIZE)).cast("double"), F.lit(0.0))
        cost = F.when(n > 0, n * e["buy_price"] * LOT_SIZE).otherwise(0.0)
        paid = F.array(
            F.struct(e["date"], F.lit("With DRIP"), F.lit("dividend"), acc["lots"], pay).cast(row),
            F.struct(e["date"], F.lit("No DRIP"), F.lit("dividend"), F.col("lots0"), plain).cast(row),
        )
        bought = F.when(n > 0, F.array(F.struct(e["buy_date"], F.lit("With DRIP"), F.lit("reinvest"), n, cost).cast(row))).otherwise(F.array().cast(f"array<{row}>"))
        return F.struct((acc["lots"] + n).alias("lots"), (cash - cost).alias("cash"), F.concat(acc["rows"], paid, bought).alias("rows"))

    buy = F.struct(F.col("first_date"), F.lit("Both"), F.lit("buy"), F.col("lots0"), F.col("lots0") * F.col("first_price") * LOT_SIZE).cast(row)
    init = F.struct(F.col("lots0").alias("lots"), F.col("cash0").alias("cash"), F.array(buy).alias("rows"))
    return j.select("scenario", "symbol", F.explode(F.aggregate("events", init, step)["rows"]).alias("r")).select("scenario", "symbol", "r.*")


def replay_totals(detail: DataFrame) -> DataFrame:
    g = detail.groupBy("scenario", "strategy", "year").agg(F.sum("value").alias("holdings_value"), F.sum("cash").alias("cash"), F.sum("income").alias("dividend_income"))
    return g.withColumn("portfolio_value", F.col("holdings_value") + F.col("cash"))


def replay_summary(totals: DataFrame, alloc: DataFrame) -> DataFrame:
    start = alloc.groupBy("scenario").agg(F.sum("amount").alias("_capital"))
    at = lambda c: F.max_by(c, "year")
    g = totals.groupBy("scenario", "strategy").agg(at("portfolio_value").alias("final_value"), F.sum("dividend_income").alias("total_income"), at("dividend_income").alias("_last"), at("cash").alias("residual_cash"))
    return g.join(start, "scenario").select("scenario", "strategy", "final_value", "total_income", (sdiv("_last", "_capital") * 100).alias("yield_on_cost"), "residual_cash")


def topup_replay(plans: DataFrame, prices: DataFrame, div: DataFrame) -> DataFrame:
    """Monthly top-ups and reinvested dividends, one row per month and plan.

    ``plans``: scenario, symbol, start_year, end_year, initial, topup. Each
    month's first session price is found once by an as-of join; the fold only
    walks the months of one plan. A dividend paid before the month's purchase
    is spent with it, a later one counts the lots just bought and stays cash.
    The first month only invests the initial amount. Every purchase and every
    dividend is recorded.
    """
    span = F.sequence(F.make_date("start_year", F.lit(1), F.lit(1)), F.make_date("end_year", F.lit(12), F.lit(1)), F.expr("interval 1 month"))
    months = plans.select("symbol", F.explode(span).alias("date")).distinct()
    last = prices.groupBy("symbol").agg(F.max_by(F.struct("date", "close"), "date").alias("_l"))
    m = _buy_days(months, prices).join(last, "symbol")
    m = m.select("symbol", F.col("date").alias("month"), F.coalesce("buy_date", "_l.date").alias("buy_date"), F.coalesce("buy_price", "_l.close").alias("price"))
    d = div.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.sum("adjDividend").alias("dps"), F.min("date").alias("ex_date"))
    m = m.join(d, ["symbol", "month"], "left")
    hist = m.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("month", "buy_date", "price", "dps", "ex_date"))).alias("months"))
    j = plans.join(hist, "symbol")
    first = F.make_date("start_year", F.lit(1), F.lit(1))
    own = F.filter("months", lambda x: (x["month"] >= first) & (F.year(x["month"]) <= F.col("end_year")))
    row = "struct<month:date,buy_date:date,price:double,bought:double,income:double,lots:double,cash:double>"

    def step(acc, x):
        start = x["month"] == first
        cash0 = acc["cash"] + F.when(start, 0.0).otherwise(F.col("topup"))
        dps = F.when(start, 0.0).otherwise(F.coalesce(x["dps"], F.lit(0.0)))
        late = F.coalesce(x["buy_date"] < x["ex_date"], F.lit(False))
        early_pay = F.when(late, 0.0).otherwise(F.floor(dps * acc["lots"] * LOT_SIZE).cast("double"))
        cash1 = cash0 + early_pay
        n = F.floor(cash1 / x["price"] / LOT_SIZE).cast("double")
        lots = acc["lots"] + n
        late_pay = F.when(late, F.floor(dps * lots * LOT_SIZE).cast("double")).otherwise(0.0)
        cash = cash1 - n * x["price"] * LOT_SIZE + late_pay
        out = F.struct(x["month"], x["buy_date"], x["price"], n, early_pay + late_pay, lots, cash).cast(row)
        return F.struct(lots.alias("lots"), cash.alias("cash"), F.concat(acc["rows"], F.array(out)).alias("rows"))

    init = F.struct(F.lit(0.0).alias("lots"), F.col("initial").cast("double").alias("cash"), F.array().cast(f"array<{row}>").alias("rows"))
    return j.select("scenario", "symbol", "initial", "topup", F.explode(F.aggregate(own, init, step)["rows"]).alias("r")).select("scenario", "symbol", "initial", "topup", "r.*")


def topup_summary(rows: DataFrame) -> DataFrame:
    """Cost, value, income and yield of each top-up plan."""
    y = rows.groupBy("scenario", "symbol", F.year("month").alias("year")).agg(F.sum("income").alias("income"))
    latest = y.where("income > 0").groupBy("scenario", "symbol").agg(F.max_by("income", "year").alias("_latest"))
    g = rows.groupBy("scenario", "symbol").agg(
        F.sum(F.col("bought") * F.col("price") * LOT_SIZE).alias("cum_cost"), (F.max_by("price", "month") * F.max_by("lots", "month") * LOT_SIZE).alias("market_value"),
        (F.first("initial") + (F.count("*") - 1) * F.first("topup")).alias("total_invested"), F.sum("income").alias("total_dividends"), F.max_by("lots", "month").alias("lots"), F.avg("price").alias("_p"),
    ).join(latest, ["scenario", "symbol"], "left")
    return g.select(
        "scenario", "symbol", "cum_cost", "market_value", "total_invested", "total_dividends", "lots", F.floor(sdiv("total_dividends", F.col("_p") * LOT_SIZE)).alias("bonus_lots"),
        (sdiv(F.coalesce("_latest", F.lit(0.0)), "total_invested") * 100).alias("yield_on_cost"), ((sdiv("market_value", "total_invested") - 1) * 100).alias("total_return"),
    )


def simple_compounding(plans: DataFrame) -> DataFrame:
    """Balance per year with the yearly return cut to whole units.

    ``plans``: scenario, initial, years, rate.
    """
    row = "struct<year:int,income:double,balance:double>"

    def step(acc, i):
        inc = F.floor(acc["balance"] * F.col("rate")).cast("double")
        bal = acc["balance"] + inc
        return F.struct(bal.alias("balance"), F.concat(acc["rows"], F.array(F.struct(i, inc, bal).cast(row))).alias("rows"))

    ok = plans.where("years >= 1 and initial >= 0 and rate >= 0")
    init = F.struct(F.col("initial").cast("double").alias("balance"), F.array().cast(f"array<{row}>").alias("rows"))
    r = F.aggregate(F.sequence(F.lit(1), F.col("years").cast("int")), init, step)["rows"]
    return ok.select("scenario", F.explode(r).alias("r")).select("scenario", "r.*")


def running_position(buys: DataFrame) -> DataFrame:
    """Cumulative lots and cost of one plan's purchases and their value at each purchase price."""
    w = Window.partitionBy("scenario", "symbol").orderBy("month")
    cum = F.sum("bought").over(w)
    return buys.select("scenario", "symbol", "month", "price", "bought", cum.alias("cum_lots"), F.sum(F.col("bought") * F.col("price") * LOT_SIZE).over(w).alias("cum_cost"), (cum * F.col("price") * LOT_SIZE).alias("market_value"))
