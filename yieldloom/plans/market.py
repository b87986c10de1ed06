"""Market tables derived from the star-schema test tables.

Every supplier is a listed company, every line item a trade print of it. The
number of symbols grows with the data while one symbol keeps at most one row
per calendar day, so per-symbol windows stay bounded at any scale. All amounts
are built from integer sums, which makes them identical in every engine.
Prints are summed per (symbol, date) before anything is keyed by symbol alone,
so a symbol that owns a third of all prints is spread out and combined early.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def symbol_of(key):
    """Ticker of a company number; made after grouping, so shuffles carry the number."""
    text = F.col(key).cast("string") if isinstance(key, str) else key.cast("string")
    return F.concat(F.lit("S"), F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0")))


def cents(c: str):
    """A non-negative two-decimal number in hundredths, without decimal rounding per row."""
    return F.floor(F.col(c) * 100 + 0.5)


def without_partner(df: DataFrame, suffix: str, col: str = "symbol") -> DataFrame:
    """All rows, and each again under a symbol that no other table knows."""
    return df.withColumn(col, F.explode(F.array(F.col(col), F.concat(F.col(col), F.lit(suffix)))))


def trend_of(date: str = "date"):
    return 1000 + (F.col("sk") % 7 - 1) * ((F.year(date) - 1995) * 12 + F.month(date))


ASOF = "2001-11-30"  # stands for "today" in every clock-dependent operator


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def prints(self) -> DataFrame:
        """One row per trade print, in exact integer units."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_suppkey").alias("sk"), F.col("l_shipdate").cast("date").alias("date"),
            cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), F.col("l_quantity").cast("long").alias("qty"),
            cents("l_extendedprice").alias("cents"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber",
        ).select("*", symbol_of("sk").alias("symbol"), (F.col("sk") % 9 + 1).alias("level"), trend_of().alias("trend"))

    @cached_property
    def prices(self) -> DataFrame:
        p = self.prints.groupBy("sk", "date").agg(
            F.count("*").alias("n"), F.sum("disc").alias("d"),
            F.max("disc").alias("dx"), F.min("disc").alias("dn"), F.sum("qty").alias("q"),
        ).select("*", symbol_of("sk").alias("symbol"), (F.col("sk") % 9 + 1).alias("level"), trend_of().alias("trend"))
        scale = F.col("trend") * F.col("level")
        close_c = F.floor((100 * F.col("n") + F.col("d")) * scale / F.col("n"))
        high_c = (100 + F.col("dx")) * scale
        low_c = (100 + F.col("dn")) * scale
        return p.select(
            "symbol", "date",
            (F.floor((high_c + low_c) / 2) / 100).alias("open"),
            (high_c / 100).alias("high"), (low_c / 100).alias("low"),
            (close_c / 100).alias("close"), (close_c / 100).alias("adjClose"),
            F.col("q").cast("double").alias("volume"),
        )

    @cached_property
    def closes(self) -> DataFrame:
        return self.prices.select("symbol", "date", "close")

    @cached_property
    def dividends(self) -> DataFrame:
        p = self.prints.where("flag = 'R'").withColumn("year", F.year("date"))
        p = p.withColumn("half", F.when(F.month("date") > 6, 2).otherwise(1)).where("(sk + year) % 6 <> 0")
        g = p.groupBy("sk", "year", "half").agg(F.min("date").alias("date"), F.count("*").alias("n"), F.sum("tax").alias("t"))
        g = g.select("*", symbol_of("sk").alias("symbol"), (F.col("sk") % 9 + 1).alias("level"), trend_of().alias("trend"))
        return g.select(
            "symbol", "date",
            (F.floor((1000 * F.col("n") + 500 * F.col("t")) * F.col("trend") * F.col("level") / (1000 * F.col("n"))) / 100).alias("adjDividend"),
            F.when((F.col("half") == 1) & ((F.col("sk") + F.col("year")) % 11 == 0), "special")
            .when(F.col("half") == 2, "final").otherwise("interim").alias("dividend_type"),
            F.col("year").alias("fiscal_year"),
        )

    @cached_property
    def financials(self) -> DataFrame:
        p = self.prints.withColumn("calendarYear", F.year("date")).withColumn("q", F.quarter("date"))
        margin = F.when(F.col("sk") % 4 == 0, 50).otherwise(120)
        g = p.groupBy("sk", "calendarYear", "q").agg(
            F.sum(F.col("cents") * (100 - F.col("disc"))).alias("rev"),
            F.sum(F.col("cents") * (margin - 10 * F.col("tax"))).alias("ni"),
        )
        usd = F.col("sk") % 5 == 0
        shares = (F.col("sk") % 5 + 1) * 500000000
        rev = F.when(usd, F.floor(F.col("rev") / 150000.0) * 1000).otherwise(F.floor(F.col("rev") / 10000.0) * 1000000)
        ni = F.when(usd, F.floor(F.col("ni") / 1500000.0) * 1000).otherwise(F.floor(F.col("ni") / 100000.0) * 1000000)
        return g.select(
            symbol_of("sk").alias("symbol"), F.expr("make_date(calendarYear, q * 3, 1)").alias("date"), "calendarYear",
            F.concat(F.lit("Q"), F.col("q").cast("string")).alias("period"),
            rev.cast("double").alias("revenue"), ni.cast("double").alias("netIncome"),
            (ni.cast("double") / shares.cast("double")).alias("eps"),
            F.when(usd, "USD").otherwise("IDR").alias("reportedCurrency"),
        )

    @cached_property
    def _orders_fx(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority",
            cents("o_totalprice").alias("c"),
        )

    @cached_property
    def fx(self) -> DataFrame:
        g = self._orders_fx.groupBy("date").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
        return g.select(F.lit("USDIDR").alias("pair"), "date", (15000 + F.floor(F.col("s") / F.col("n") / 1000) / 100).alias("close"))

    @cached_property
    def fx_pairs(self) -> DataFrame:
        g = self._orders_fx.groupBy(F.substring("o_orderpriority", 3, 20).alias("pair"), "date").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
        return g.select("pair", "date", (15000 + F.floor(F.col("s") / F.col("n") / 1000) / 100).alias("close"))

    @cached_property
    def companies(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("s_suppkey").alias("sk"), symbol_of("s_suppkey").alias("symbol"),
                F.col("s_name").alias("companyName"), F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"), F.floor(F.abs("s_acctbal")).alias("bal"),
            )
        )

    @cached_property
    def shares(self) -> DataFrame:
        return self.table("supplier").select(
            symbol_of("s_suppkey").alias("symbol"),
            ((F.col("s_suppkey") % 5 + 1) * 500000000).cast("double").alias("outstandingShares"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        last = self.prices.groupBy("symbol").agg(
            F.max_by("close", "date").alias("price"), F.max_by("open", "date").alias("o"),
            F.floor(F.avg("volume")).alias("volAvg"),
        )
        sk = F.col("sk")
        shares = (sk % 5 + 1) * 500000000
        return self.companies.join(last, "symbol").select(
            "symbol", "companyName", "sector", "industry", "price",
            F.round(F.col("price") - F.col("o"), 2).alias("changes"),
            ((5 + sk % 10) / 10).alias("beta"),
            F.floor(F.col("price") * shares).cast("long").alias("mktCap"),
            F.when(sk % 13 == 5, 0.0).otherwise(F.col("bal") / 100).alias("lastDiv"),
            F.expr("make_date(CAST(1985 + sk % 12 AS INT), CAST(1 + sk % 12 AS INT), 15)").alias("ipoDate"),
            F.col("volAvg").cast("double").alias("volAvg"),
            (sk % 11 != 0).alias("isActivelyTrading"), (sk % 17 == 3).alias("isEtf"), (sk % 19 == 4).alias("isFund"),
            F.lit("IDR").alias("currency"),
        )

    @cached_property
    def compliant(self) -> DataFrame:
        """Compliance list: code without the exchange suffix."""
        return self.table("supplier").where("s_suppkey % 3 <> 1").select(
            (F.col("s_suppkey") + 1).alias("No."), symbol_of("s_suppkey").alias("Kode"),
            F.col("s_name").alias("Nama Emiten"),
        )

    @cached_property
    def index_prices(self) -> DataFrame:
        p = self.closes.join(self.companies.select("symbol", F.col("sector").alias("index")), "symbol")
        g = p.groupBy("index", "date").agg(F.sum(cents("close")).alias("s"), F.count("*").alias("n"))
        return g.select("index", "date", (F.floor(F.col("s") / F.col("n")) / 100).alias("close"))

    @cached_property
    def benchmark(self) -> DataFrame:
        """The home index: one close per date over all symbols."""
        g = self.closes.groupBy("date").agg(F.sum(cents("close")).alias("s"), F.count("*").alias("n"))
        return g.select("date", (F.floor(F.col("s") / F.col("n")) / 100).alias("close"))

    @cached_property
    def trades(self) -> DataFrame:
        """Prints with the customer who traded them."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return self.prints.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "holder")

    @cached_property
    def holdings(self) -> DataFrame:
        g = self.trades.groupBy("holder", "sk").agg(
            F.sum("qty").alias("lots"), F.sum(F.col("qty") * (100 + F.col("disc")) * F.col("level") * 10).alias("v"),
        )
        return g.select("holder", symbol_of("sk").alias("symbol"), F.col("lots").cast("double").alias("lots"), (F.floor(F.col("v") / F.col("lots")).cast("double")).alias("avg_price"))

    @cached_property
    def payments(self) -> DataFrame:
        return self.trades.where("flag = 'R'").select(
            "holder", F.col("symbol").alias("stock"), F.col("qty").alias("lot"),
            ((1000 + 50 * F.col("tax")) / 100).alias("dividend"),
            (F.col("qty") * (1000 + 50 * F.col("tax"))).cast("double").alias("total"), "date",
            "l_orderkey", "l_linenumber",
        )

    @cached_property
    def logs(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id").cast("string")
        page = F.concat(F.lit("/"), F.col("event_type"))
        src = F.when(F.col("event_id") % 3 == 0, "None").otherwise(F.concat(F.lit("ref"), (F.col("event_id") % 4).cast("string")))
        secs = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
        k = F.col("event_id") % 10
        stock = F.format_string("S%06d", F.col("user_id") % 40)
        line = (
            F.when(k == 7, F.concat(F.lit("INFO redis get key"), eid, F.lit(" took "), secs, F.lit(" seconds")))
            .when(k == 8, F.concat(F.lit("INFO get redis key: k"), eid, F.lit(", total time: "), secs, F.lit(" seconds")))
            .when(k == 9, F.concat(F.lit("INFO Total download time for "), stock, F.lit(": "), secs))
            .when(F.col("event_id") % 97 == 0, F.lit("WARN use_container_width will be removed after the next release"))
            .when(F.col("event_id") % 89 == 0, F.lit("Session already connected! Connecting to a new session."))
            .otherwise(F.concat(F.lit("INFO VISIT | visitor=u"), F.col("user_id").cast("string"), F.lit(" | page="), page, F.lit(" | source="), src, F.lit(" | lang=id")))
        )
        return e.select("event_id", line.alias("line"))
