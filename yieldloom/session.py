"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "yieldloom") -> SparkSession:
    """Session for tests and the bench; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged files.

    The session names it in ``spark.checkpoint.dir``. Where it is unset, a
    folder beside the tables of the session's warehouse is taken, if every
    executor reaches that as well; a warehouse on the driver's own disk is
    refused on a cluster. No machine-local temporary folder is ever used.
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes checkpoints
    that are no longer referenced; staged tables stay until the folder is
    emptied, so a cluster should give the folder an expiry.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or _beside_tables(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


def _beside_tables(warehouse: str, master: str) -> str:
    if not master.startswith("local") and warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dropping_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries planned meanwhile delete their shuffle files once they are done, instead of when the driver next collects its garbage.

    Only for results that are written: a query that runs again makes its shuffles anew.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def joining_in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins planned meanwhile keep a side that is dealt by some of their keys. For keys that start with a bounded one, like a symbol."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors."""
    scratch_root(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so the setting holds


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(column: pa.Array) -> Iterator[pa.RecordBatch]:
    for x in column:
        yield from pa.ipc.open_stream(x.as_buffer())


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for tables with many rows: the checkpoint has compressed batches, the rows stay in their partitions and order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([packed(b)], pa.binary())], names=["b"])

    names = df.columns

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in unpacked(b.column(0)):
                yield x.rename_columns(names)

    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # names may have dots
    return cut_lineage(plain.mapInArrow(pack, "b binary")).mapInArrow(unpack, df.schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by key over all shuffle partitions, kept as it is at run time.

    For stages that compute far more than they read: small partitions would
    otherwise be merged into a few slow tasks. Windows, folds and groupings on
    these keys (or on more keys) need no further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
