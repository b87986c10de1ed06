"""Writers: upserts, joint publication and per-year calendars."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import chunked_list
from ..functions.scalars import require_columns
from ..session import cut_lineage


PRICES = "symbol string, date date, close double"
BUCKETS = 8


def merge_prices(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union where the newer copy of a (symbol, date) wins; within ``new`` the highest seq, which has to be there."""
    require_columns(new, "symbol", "date", "close", "seq")
    old = existing.select("symbol", "date", "close", F.lit(0).alias("_gen"), F.lit(0).cast("long").alias("_seq"))
    inc = new.select("symbol", "date", "close", F.lit(1).alias("_gen"), F.col("seq").cast("long").alias("_seq"))
    return old.unionByName(inc).groupBy("symbol", "date").agg(F.max_by("close", F.struct("_gen", "_seq")).alias("close"))


# A table is a folder of written versions and numbered pointer files. A pointer is written aside and renamed to the next
# number, which either happens or does not; readers take the highest number. A lost writer leaves the last pointer as it was.


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/_pointers")
    if not fs.exists(p):
        return []
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> dict | None:
    """What the newest pointer says; None if nothing was published yet."""
    n = _pointers(spark, root)
    return json.loads(spark.read.text(f"{root}/_pointers/{n[-1]}", wholetext=True).first()[0]) if n else None


def _publish(spark: SparkSession, root: str, says: dict, keep: int = 2) -> None:
    """Move the pointer; versions that the last ``keep`` pointers do not name are deleted."""
    n = _pointers(spark, root)
    fs, aside = _fs(spark, f"{root}/_pointers/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(says).encode()))
    out.close()
    if not fs.rename(aside, _fs(spark, f"{root}/_pointers/{(n[-1] if n else 0) + 1}")[1]):
        raise RuntimeError(f"another writer published {root} at the same time")
    n = _pointers(spark, root)
    named = {v for k in n[-keep:] for v in json.loads(spark.read.text(f"{root}/_pointers/{k}", wholetext=True).first()[0])["versions"]}
    for k in n[:-keep]:
        fs.delete(_fs(spark, f"{root}/_pointers/{k}")[1], False)
    for x in fs.listStatus(_fs(spark, root)[1]):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in named:
            fs.delete(x.getPath(), True)


def _part() -> list:
    """Where a price is kept: its year and one of ``BUCKETS`` symbol buckets."""
    return [F.year("date").alias("year"), _bucket().alias("bucket")]


def _bucket():
    return F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")


def upsert_prices(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Merge into a table kept by year and symbol bucket; only the parts touched are written, as a new version, then the pointer moves.

    Beside the prices the table keeps a high-water mark per symbol. A failed or repeated call leaves a whole table. Reading a stored
    part with other columns is an error, never an empty part.
    """
    require_columns(new, "symbol", "date", "close", "seq")
    says = current(spark, path) or {"parts": {}, "marks": None, "versions": []}
    new = new.select("symbol", "date", "close", "seq", *_part()).persist()
    try:
        touched = {f"{r['year']}/{r['bucket']}" for r in new.select("year", "bucket").distinct().collect()}  # calendar years times BUCKETS
        stored = _read_parts(spark, path, {k: v for k, v in says["parts"].items() if k in touched})
        version = f"v-{uuid.uuid4().hex}"
        out = merge_prices(stored, new).select("*", *_part())
        out.repartition("year", "bucket").sortWithinPartitions("year", "bucket", "symbol", "date").write.option("compression", "snappy").partitionBy("year", "bucket").parquet(f"{path}/{version}/prices")
        marks = high_water(spark, path).unionByName(new.select("symbol", F.col("date").alias("mark"))).groupBy("symbol").agg(F.max("mark").alias("mark"))
        marks.write.parquet(f"{path}/{version}/marks")
    finally:
        new.unpersist()
    moved = says["parts"] | {k: version for k in touched}
    _publish(spark, path, {"parts": moved, "marks": version, "versions": sorted({*moved.values(), version})})


def _read_parts(spark: SparkSession, path: str, parts: dict[str, str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], PRICES)
    paths = [f"{path}/{v}/prices/year={k.split('/')[0]}/bucket={k.split('/')[1]}" for k, v in sorted(parts.items())]
    found = require_columns(spark.read.parquet(*paths), "symbol", "date", "close")
    return found.select("symbol", "date", F.col("close").cast("double").alias("close"))


def high_water(spark: SparkSession, path: str) -> DataFrame:
    """symbol, mark: the last date stored of every symbol."""
    says = current(spark, path)
    return spark.read.parquet(f"{path}/{says['marks']}/marks") if says else spark.createDataFrame([], "symbol string, mark date")


def read_prices(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """The price table as the newest pointer has it; a range or a list of symbols opens only the parts that can hold them."""
    parts = (current(spark, path) or {"parts": {}})["parts"]
    if start is not None:
        parts = {k: v for k, v in parts.items() if int(k.split("/")[0]) >= int(start[:4])}
    if end is not None:
        parts = {k: v for k, v in parts.items() if int(k.split("/")[0]) <= int(end[:4])}
    if symbols is not None:
        asked = spark.createDataFrame([(x,) for x in symbols], "symbol string").select(_bucket().alias("b")).distinct()
        held = {str(r["b"]) for r in asked.collect()}  # BUCKETS rows at most
        parts = {k: v for k, v in parts.items() if k.split("/")[1] in held}
    out = _read_parts(spark, path, parts)
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out if symbols is None else out.where(F.col("symbol").isin(symbols))


# The two modes of a price stage, the first date of a backfill, and the days an incremental run fetches again.
MODES = ("incremental", "backfill")
BACKFILL_START = "2010-01-01"
REFETCH_DAYS = 7


def fetch_plan(symbols: DataFrame, marks: DataFrame, mode: str, asof: str, start: str = BACKFILL_START) -> DataFrame:
    """symbol, from_date: what a run asks for.

    A backfill asks for everything since ``start``. An incremental run asks for the last ``REFETCH_DAYS`` days again, from the symbol's
    high-water mark on if that is older (a gap is closed), and since ``start`` for a symbol that has no mark.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    ask = symbols.select("symbol").where("symbol is not null").distinct()
    first = F.lit(start).cast("date")
    if mode == "backfill":
        return ask.withColumn("from_date", first)
    back = F.date_sub(F.lit(asof).cast("date"), REFETCH_DAYS)
    return ask.join(marks, "symbol", "left").select("symbol", F.coalesce(F.when(F.col("mark").isNotNull(), F.greatest(first, F.least(back, "mark"))), first).alias("from_date"))


def ingest_delivery(spark: SparkSession, path: str, symbols: DataFrame, delivery: DataFrame, mode: str, asof: str, start: str = BACKFILL_START) -> DataFrame:
    """Merge what a run was delivered and report it: mode, symbols_total, symbols_succeeded, symbols_failed, rows_upserted.

    Only rows that the plan asked for count (up to ``asof``, of the given symbols); of several copies of a (symbol, date) the highest
    seq. Symbols without a row failed; the others are merged all the same, so a partial delivery is kept. A delivery without any row,
    and an unknown mode, are errors and change nothing.
    """
    require_columns(delivery, "symbol", "date", "close", "seq")
    plan = cut_lineage(fetch_plan(symbols, high_water(spark, path), mode, asof, start))
    due = delivery.join(plan, "symbol").where((F.col("date") >= F.col("from_date")) & (F.col("date") <= F.lit(asof).cast("date")) & F.col("close").isNotNull())
    due = cut_lineage(keep_one(due.select("symbol", "date", "close", "seq").withColumn("s", F.col("seq")), ["symbol", "date"], "s"))
    got = due.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("ok")).first()
    if not got["rows"]:
        raise RuntimeError("the delivery has no price that was asked for")
    upsert_prices(spark, path, due)
    return plan.agg(F.count("*").alias("symbols_total")).select(
        F.lit(mode).alias("mode"), "symbols_total", F.lit(got["ok"]).alias("symbols_succeeded"), (F.col("symbols_total") - got["ok"]).alias("symbols_failed"), F.lit(got["rows"]).alias("rows_upserted")
    )


def publish_together(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables below one version folder, then move the pointer.

    Readers follow the pointer, so they see all new tables or none of them.
    """
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("compression", "snappy").parquet(f"{root}/{version}/{name}")
    _publish(spark, root, {"tables": sorted(tables), "versions": [version]})
    return version


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)['versions'][0]}/{name}")


def publish_calendar(calendar: DataFrame, path: str) -> None:
    """Calendar rows per year as one new version: years without rows leave no partition and are not in the manifest."""
    spark, version = calendar.sparkSession, f"v-{uuid.uuid4().hex}"
    calendar.withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{path}/{version}")
    _publish(spark, path, {"versions": [version]})


def published_years(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)['versions'][0]}").groupBy("year").agg(F.count("*").alias("events"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def completeness(expected: DataFrame, received: dict[str, DataFrame]) -> DataFrame:
    """Per data type: total, succeeded, failed and success rate of the expected symbols."""
    ask = expected.select("symbol").distinct()
    out = None
    for name, df in received.items():
        got = df.select("symbol").distinct().withColumn("_ok", F.lit(1))
        j = ask.join(got, "symbol", "left").agg(F.count("*").alias("total"), F.count("_ok").alias("succeeded")).select(
            F.lit(name).alias("type"), "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"),
            F.coalesce(F.try_divide(F.col("succeeded") * 100.0, F.col("total")), F.lit(0.0)).alias("success_rate"),
        )
        out = j if out is None else out.unionByName(j)
    return out.withColumn("error", (F.col("total") > 0) & (F.col("succeeded") == 0))


def failed_symbols(expected: DataFrame, received: dict[str, DataFrame], size: int = 1000) -> DataFrame:
    """Sorted failed symbols per data type, in chunks of bounded length."""
    out = None
    for name, df in received.items():
        miss = expected.select("symbol").distinct().join(df.select("symbol").distinct(), "symbol", "left_anti").withColumn("type", F.lit(name))
        out = miss if out is None else out.unionByName(miss)
    return chunked_list(out, ["type"], "symbol", "failed_symbols", size)


def keep_one(df: DataFrame, keys: list[str], seq: str, last: bool = True) -> DataFrame:
    """First or last row per key with an explicit order; combines before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")
