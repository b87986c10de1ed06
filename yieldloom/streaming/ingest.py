"""Structured Streaming: incremental price ingest and latest quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sdiv
from ..sources.sinks import upsert_prices

PRICE_SCHEMA = "symbol string, date date, close double, seq long"
QUOTE_SCHEMA = "symbol string, ts timestamp, price double, prev_close double"


def ingest_prices(spark: SparkSession, incoming: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Take every landed file once and merge it into the price table, corrections winning.

    The merge is idempotent, so a batch that is retried after a failure ends in
    the same table.
    """
    stream = spark.readStream.schema(PRICE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    q = (
        stream.writeStream.foreachBatch(lambda batch, _: upsert_prices(batch.sparkSession, table, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def latest_quotes(stream: DataFrame) -> DataFrame:
    """Newest price per symbol and its return on the previous close; one state row per symbol."""
    g = stream.withWatermark("ts", "7 days").groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(F.struct("price", "prev_close"), F.struct("ts", "price", "prev_close")).alias("_q"))
    return g.select("symbol", "ts", F.col("_q.price").alias("price"), ((sdiv("_q.price", "_q.prev_close") - 1) * 100).alias("return_1d_pct"))


def run_latest_quotes(spark: SparkSession, incoming: str, out: str, checkpoint: str, files_per_batch: int = 1000, keep: int = 8) -> None:
    """Each micro-batch writes only the symbols that changed, under its batch number.

    After ``keep`` batches a snapshot with one row per symbol takes the place of their folders, so the number of files follows the
    symbols, not the batches. A late quote changes nothing: the state keeps the newest time stamp.
    """
    stream = spark.readStream.schema(QUOTE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if len(_folders(spark, out)) > keep:
            compact_quotes(spark, out)

    q = (
        latest_quotes(stream).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def _folders(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(batch number, folder) of what readers need: the newest finished snapshot, which has all batches up to its number, and the batches behind it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))
    snaps = sorted((int(n[9:]), n) for n in names if n.startswith("snapshot=") and done(n))
    base = snaps[-1:]
    return base + sorted((int(n[6:]), n) for n in names if n.startswith("batch=") and done(n) and (not base or int(n[6:]) > base[0][0]))


def compact_quotes(spark: SparkSession, out: str) -> None:
    """Write one snapshot of all batches so far, then delete what it replaces; a stop in between leaves the old folders or the new one valid."""
    last = _folders(spark, out)[-1][0]
    read_latest_quotes(spark, out).write.mode("overwrite").parquet(f"{out}/snapshot={last}")
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    needed = {n for _, n in _folders(spark, out)}
    for x in fs.listStatus(p):
        if x.getPath().getName() not in needed:
            fs.delete(x.getPath(), True)


def read_latest_quotes(spark: SparkSession, out: str) -> DataFrame:
    parts = [spark.read.parquet(f"{out}/{n}").withColumn("batch", F.lit(k)) for k, n in _folders(spark, out)]  # at most the batches kept
    d = parts[0]
    for x in parts[1:]:
        d = d.unionByName(x)
    return d.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "return_1d_pct"), "batch").alias("_q")).select("symbol", "_q.*")
