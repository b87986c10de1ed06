"""Exact dedup by distributed MSD radix partitioning.

A digit is a run of successive bytes, and digits widen from level to level
(64 bytes, 512, 4 KiB, ...), so the depth is logarithmic in the longest text.
On every level the documents of a group that still has company are parted by
their next digit: a group by (parent group, digit, text ends here) whose counts
combine before the shuffle finds the groups with two members or more, and a
join gives the members their new group. Members that stand alone leave at once,
a group whose texts end is a set of equal texts. No digest decides equality.

A group of any size costs one combined row per task in the count; the join back
is left to adaptive execution, which splits a hot side. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces, stage


def _digits(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in batches:
            raw = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[:width].lower() for x in raw], pa.binary()), pa.array([len(x) <= width for x in raw], pa.bool_())],
                names=["doc_id", "digit", "ends"],
            )

    return run


def _bodies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in pieces(batches, "text"):
            raw = [x.lower() for x in as_bytes(b.column(1))]  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[:width] for x in raw], pa.binary()),
                    pa.array([len(x) <= width for x in raw], pa.bool_()),
                    pa.array([x[width:] for x in raw], pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    b.column("row_id"),
                ],
                names=["doc_id", "digit", "ends", "rest", "text_sha256", "row_id"],
            )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 64, widen: int = 8, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Texts are equal when identical after lower-casing A-Z; NULL counts as
    empty, so NULL and empty texts form one group. Of equal texts the row with
    the largest id stays; NULL ids lose against any id; of repeated rows with
    the same id and text one stays. An empty table gives an empty result; other
    columns are not read. ``row_col`` names a unique row number that ``row_id``
    then repeats.
    """
    number = F.lit(None).cast("long") if row_col is None else F.col(row_col).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), number.alias("row_id"))
    found = src.mapInArrow(_digits(first), "doc_id long, digit binary, ends boolean")
    level, parts = 0, []
    state = src.mapInArrow(_bodies(first), "doc_id long, digit binary, ends boolean, rest binary, text_sha256 string, row_id long")
    if row_col is None:
        state = state.withColumn("row_id", F.monotonically_increasing_id())
    width, keys = first, ["digit", "ends"]
    while True:
        groups = stage(
            found.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            f"radix-groups-{level}",
        )
        open_ = ~F.col("ends") & F.col("next").isNotNull()
        placed = stage(
            state.join(groups.hint("shuffle_hash"), keys, "left").select(
                "doc_id", "row_id", "text_sha256", F.lit(level).alias("level"), F.col("next").alias("group"), "group_size", "keep_id",
                open_.alias("open"), F.when(open_, F.col("rest")).alias("rest"),
            ),
            f"radix-{level}",
        )
        parts.append(placed.where("not open").drop("open", "rest"))
        if groups.where("not ends").isEmpty():
            break
        level, width = level + 1, width * widen
        body = F.col("rest")
        state = placed.where("open").select(
            "doc_id", "row_id", "text_sha256", F.col("group"),
            F.substring(body, 1, width).alias("digit"), (F.octet_length(body) <= width).alias("ends"), F.substring(body, width + 1, 2**31 - 1).alias("rest"),
        )
        found, keys = state, ["group", "digit", "ends"]
        state = state.select("doc_id", "row_id", "text_sha256", *keys, "rest")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stays = out.where(F.col("group").isNotNull() & same).groupBy("level", "group").agg(F.min("row_id").alias("stays"))
    return out.join(stays, ["level", "group"], "left").select(
        "doc_id",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group").isNull() | F.col("row_id").eqNullSafe(F.col("stays"))).alias("kept"),
        "text_sha256",
        "row_id",
    )
