"""Readers and decoders: CSV, nested JSON, pasted statements and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import align_series
from ..operators.fundamentals import FALLBACK_RATE
from ..session import cut_lineage

COMPLIANCE_SCHEMA = "`No.` int, Kode string, `Nama Emiten` string, Keterangan string"
PORTFOLIO_SCHEMA = "Symbol string, `Available Lot` string, `Average Price` string"
DIVIDEND_CSV_SCHEMA = "symbol string, ex_date date, dividend double, dividend_type string"


def read_compliance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon file with a byte-order mark; the fixed schema goes by position."""
    return spark.read.csv(path, sep=";", header=True, schema=COMPLIANCE_SCHEMA)


def read_portfolio_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PORTFOLIO_SCHEMA)


def read_dividend_csv(spark: SparkSession, path: str, from_path: str, out: str, schema: str = DIVIDEND_CSV_SCHEMA) -> DataFrame:
    """Dividend files whose path carries a value (a symbol or a year), with the usual column names."""
    d = spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True)
    return d.withColumn(out, F.regexp_extract(F.input_file_name(), from_path, 1)).withColumnsRenamed({"ex_date": "date", "dividend": "adjDividend"})


def decode_envelopes(raw: DataFrame, schema: str, text: str = "payload") -> DataFrame:
    """``{"date": ..., "content": "<json array>"}`` to rows."""
    outer = raw.withColumn("_e", F.from_json(text, "date string, content string"))
    rows = F.from_json(F.col("_e.content"), f"array<struct<{schema}>>")
    return outer.select(*[c for c in raw.columns if c != text], F.col("_e.date").cast("date").alias("updated"), F.explode(rows).alias("_r")).select("*", "_r.*").drop("_r")


def flatten_histories(raw: DataFrame, element: str, text: str = "payload") -> DataFrame:
    """One row per (symbol, element) of single and multi-symbol history payloads."""
    one = f"struct<symbol:string,historical:array<struct<{element}>>>"
    p = F.from_json(text, f"symbol string, historical array<struct<{element}>>, historicalStockList array<{one}>")
    d = raw.select(p.alias("p"))
    single = F.array(F.struct(F.col("p.symbol").alias("symbol"), F.col("p.historical").alias("historical")))
    stocks = F.coalesce("p.historicalStockList", single)
    s = d.select(F.explode(stocks).alias("s")).where("s.symbol is not null")
    return s.select("s.symbol", F.explode_outer("s.historical").alias("h")).select("symbol", "h.*")


PASTE_FIELDS = 11  # fixed value: tokens per row of a pasted holdings table


def parse_pasted_holdings(raw: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Whitespace tokens, eleven per row: symbol, lot and price sit at 0, 1 and 3.

    Statements with an incomplete last row are returned separately.
    """
    t = raw.withColumn("_t", F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    whole = (F.size("_t") > 0) & (F.size("_t") % PASTE_FIELDS == 0)
    at = lambda i, k: F.element_at("_t", i * PASTE_FIELDS + k + 1)
    rows = F.transform(
        F.sequence(F.lit(0), (F.size("_t") / PASTE_FIELDS).cast("int") - 1),
        lambda i: F.struct(at(i, 0).alias("Symbol"), at(i, 1).alias("Available Lot"), at(i, 3).alias("Average Price")),
    )
    keys = [c for c in raw.columns if c != text]
    good = t.where(whole).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return good, t.where(~whole).select(*keys, F.size("_t").alias("fields"))


def parse_broker_history(raw: DataFrame, text: str = "text") -> DataFrame:
    """Records that start at a line with DIVIDEND; fields follow at fixed line offsets."""
    t = raw.withColumn("_l", F.split(text, "\n"))
    line = lambda i, k: F.get("_l", i + k)
    hits = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.get("_l", i).contains("DIVIDEND"))
    rec = F.transform(hits, lambda i: F.struct(
        F.get(F.split(line(i, 0), " "), F.lit(1)).alias("stock"), line(i, 2).alias("lot"), line(i, 4).alias("dividend"), line(i, 6).alias("total"), line(i, 14).alias("date"),
    ))
    keys = [c for c in raw.columns if c != text]
    return t.select(*keys, F.explode(rec).alias("r")).select(*keys, "r.*")


def _num(c: str) -> Column:
    return F.regexp_replace(F.col(c), ",", "").try_cast("double")


def payments_from_history(records: DataFrame) -> DataFrame:
    return records.select(
        "*", _num("lot").alias("lot_n"), _num("dividend").alias("dividend_n"), _num("total").alias("total_n"), F.try_to_date("date", "d MMM yyyy").alias("pay_date"),
    )


# The four log line patterns.
VISIT = r"VISIT \| visitor=(.*?) \| page=(.*?) \| source=(.*?) \|"
FETCH = r"redis get .* took ([\d\.]+) seconds"
FETCH_KEY = r"get redis key:.*total time: ([\d\.]+) seconds"
DOWNLOAD = r"Total download time for (.*?):"


def parse_logs(lines: DataFrame, text: str = "line") -> DataFrame:
    """Kind and fields of each log line; the first matching kind wins."""
    x = F.col(text)
    visit = x.contains("VISIT |")
    timing = x.contains("redis") & (x.contains("took") | x.contains("total time:"))
    kind = (
        F.when(visit, F.when(x.rlike(VISIT), "visit"))
        .when(timing, F.when(x.rlike(FETCH) | x.rlike(FETCH_KEY), "fetch"))
        .when(x.contains("use_container_width") & x.contains("will be removed"), "deprecation")
        .when(x.contains("already connected! Connecting to a new session."), "reconnect")
        .when(x.contains("Total download time for"), F.when(x.rlike(DOWNLOAD), "download"))
    )
    d = lines.withColumn("kind", kind).where("kind is not null")
    part = lambda k, i: F.when(F.col("kind") == "visit", F.trim(F.regexp_extract(text, VISIT, i)))
    secs = F.when(x.rlike(FETCH), F.regexp_extract(text, FETCH, 1)).otherwise(F.regexp_extract(text, FETCH_KEY, 1))
    return d.select(
        *[c for c in lines.columns if c != text], "kind", part("visitor", 1).alias("visitor"), part("page", 2).alias("page"), part("source", 3).alias("source"),
        F.when(F.col("kind") == "fetch", secs.try_cast("double")).alias("seconds"), F.when(F.col("kind") == "download", F.trim(F.regexp_extract(text, DOWNLOAD, 1))).alias("stock"),
    )


def frame_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive content version: row count, xor and sum of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.select(h.alias("_h")).agg(F.count("*").alias("rows"), F.bit_xor("_h").alias("xor"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total"))


def digest_parts(df: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Digest of every (symbol, month): rows, xor and total of row hashes, as ``frame_digest`` has them for a whole table."""
    h = F.xxhash64(*sorted(df.columns))
    return df.select(key, F.trunc(date, "month").alias("month"), h.alias("_h")).groupBy(key, "month").agg(
        F.count("*").alias("rows"), F.bit_xor("_h").alias("xor"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total")
    )


def roll_up(parts: DataFrame, *keys: str) -> DataFrame:
    """Digests of larger parts from those of smaller ones; without keys the digest of the table."""
    return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.bit_xor("xor").alias("xor"), F.sum("total").cast("decimal(38,0)").alias("total"))


def changed_parts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose digests differ: the keys and ``change`` (added, removed or edited)."""
    a = old.select(*keys, F.struct("rows", "xor", "total").alias("_a"))
    b = new.select(*keys, F.struct("rows", "xor", "total").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("edited")
    return a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, kind.alias("change"))


def refresh(result: DataFrame, data: DataFrame, changed: DataFrame, compute, key: str = "symbol") -> DataFrame:
    """A result with a row or more per symbol, computed anew only for symbols with a changed part; the others keep their rows."""
    touched = cut_lineage(changed.select(key).distinct())
    return result.join(touched, key, "left_anti").unionByName(compute(data.join(touched, key, "left_semi")))


def statement_rates(fin: DataFrame, fx: DataFrame, fallback: float = FALLBACK_RATE) -> DataFrame:
    """Rate applied to each statement: the last known quote, else the constant; 1 unless USD."""
    usd = fx.where("pair = 'USDIDR'").select("date", "close")
    r = align_series(fin, usd, {"close": "_r"})
    return r.select(*fin.columns, F.when(F.col("reportedCurrency") == "USD", F.coalesce("_r", F.lit(fallback))).otherwise(1.0).alias("rate"))


def union_series(named: dict[str, DataFrame]) -> DataFrame:
    """Several (date, close) series and price tables as one long price table."""
    out = None
    for name, df in named.items():
        d = df if "symbol" in df.columns else df.withColumn("symbol", F.lit(name))
        d = d.select("symbol", "date", "close")
        out = d if out is None else out.unionByName(d)
    return out
