"""Helpers shared by the text operators: staged tables, byte-bounded batches, word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropping_shuffles, scratch_path

#: ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"


_STAGED: dict[str, str] = {}  # folders of staged tables and who staged them
_OWNER: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def staging_for(owner: str) -> Iterator[None]:
    """Tables staged meanwhile belong to ``owner``, who may ``release`` them; all others' stay."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    _STAGED[path] = _OWNER.get()
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (all that was made from them is staged itself)."""
    for t in tables:
        _delete(t.sparkSession, t._staged_at)


def release(spark: SparkSession, owner: str) -> None:
    """Delete every table that was staged for ``owner``; only for callers whose results are written elsewhere."""
    for path in [p for p, whose in _STAGED.items() if whose == owner]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if _STAGED.pop(path, None) is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_remainder(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; NULL ids give NULL."""
    return F.crc32(F.col(col).cast("string")) % mod


_CACHES: dict[str, Callable[[], None]] = {}  # what this process remembers, by owner


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _CACHES[owner] = forget


def claim(owner: str = "") -> None:
    """Start of a task of ``owner``: Python workers serve one operator after the other, so the others' memory is given up first."""
    for name, forget in _CACHES.items():
        if name != owner:
            forget()


def give_back() -> None:
    """Memory that earlier tasks of this worker freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def keeping_freed() -> Iterator[None]:
    """Freed memory stays with the process meanwhile, where the C library can do that: loops over arrays of one size don't ask the system for the same pages again."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is None:
        yield
        return
    trim, from_system = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    tune(trim, 1 << 29), tune(from_system, 1 << 25)
    try:
        yield
    finally:
        tune(trim, 1 << 17), tune(from_system, 1 << 17)
        give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``limit`` text bytes (one row at least), so that memory follows the slice, not the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def pack(*arrays, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=names)


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer files have ``name``; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)
