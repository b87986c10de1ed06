"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key ``-ln(u) / weight``, with ``u`` hashed
from seed and id, so reruns agree. A source's target is first met by complete
epochs over all its documents; the rest is taken in key order until the prefix
sum of sizes meets the budget. All of it is DataFrame functions.

A hot source is never one task: the key is cut into ``cells`` ranges, prefix
sums run inside (source, cell) and over the few rows of cell totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Weights of the sources in code point order, repeating.
CYCLE = (3, 1, 2)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Targets per source from (source, source_size): one row per source, a small table.

    Sources share ``share`` of all sizes by weight; none gets more than ``most``
    times its size, the excess goes to the others by weight. With the sources
    sorted by size over weight, the capped ones come first, and the level of the
    rest follows from prefix sums, which is the fixed point of the resharing.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    lev = rows.withColumn("level", left / F.sum("weight").over(onward)).withColumn("own", F.col("cap") / F.col("weight"))
    # the first source that is not capped at the level of those from it on sets the level for all after it
    fits = F.min(F.when(F.col("own") >= F.col("level"), F.struct("own", "source", "level"))).over(Window.partitionBy())["level"]
    return lev.withColumn("final", fits).select(
        "source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target")
    )


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from seed and id: 52 bits of an MD5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix_sources(
    sized: DataFrame, weight: str | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    seed: int = 20, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE, cells: int = 4096,
) -> DataFrame:
    """Adds source_size, weight, target, epochs, taken and copies to rows that have id, source and size.

    ``weight`` names a positive quality weight (NULL or not positive: 1). A document's ``taken`` is
    its size times the complete epochs, plus what the fractional selection
    takes: its size, or, for the one document of a source that crosses the
    budget, the words that are left. ``copies`` counts started repeats. Sources
    with a target of nothing take nothing. NULL is a source of its own, last in
    order; NULL sizes count as 0; repeated rows count as rows of their own, in
    the order of their hash; an empty table gives an empty result.
    """
    rows = sized.withColumn(size_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    sizes = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    targets = source_targets(sizes, share, most, cycle).select(
        "source", "source_size", F.col("weight").alias("source_weight"), "target",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("long").alias("epochs"),
    )
    q = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(1.0)
    key = -F.log(uniform(id_col, seed)) / q
    by_source = ["_none", "_name"]  # NULL as a source of its own, without NULL in a join key
    named = lambda c: [F.col(c).isNull().alias("_none"), F.coalesce(F.col(c), F.lit("")).alias("_name")]
    keyed = rows.select("*", *named(source_col), key.alias("_key")).withColumn("_cell", F.floor((1 - F.exp(-F.col("_key"))) * cells).cast("int"))
    wd = Window.partitionBy(*by_source, "_cell").orderBy("_key", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_in", F.coalesce(F.sum(size_col).over(wd), F.lit(0)))
    wc = Window.partitionBy(*by_source).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = keyed.groupBy(*by_source, "_cell").agg(F.sum(size_col).alias("_cs")).withColumn("_off", F.coalesce(F.sum("_cs").over(wc), F.lit(0))).drop("_cs")
    cell = cell.join(targets.select(*named("source"), "source_size", "source_weight", "target", "epochs"), by_source)
    size = F.col(size_col)
    left = F.floor(F.col("target") + F.lit(1e-6)) - F.col("epochs") * F.col("source_size") - F.col("_off") - F.col("_in")
    part = F.when(F.col("epochs") >= int(most), F.lit(0)).otherwise(F.least(size, F.greatest(left, F.lit(0)))).cast("long")
    return (
        run.join(cell, [*by_source, "_cell"])
        .withColumn("_part", part)
        .withColumn("taken", F.col("epochs") * size + F.col("_part"))
        .withColumn("copies", (F.col("epochs") + (F.col("_part") > 0).cast("long")).cast("int"))
        .drop("_key", "_cell", "_in", "_off", "_part", *by_source)
    )


def with_quality(rows: DataFrame, labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Adds quality_weight: ``good`` where labelled 1, ``bad`` where labelled 0, else 1; the best of repeated labels counts."""
    q = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    w = F.when(F.col("_q") == 1, good).when(F.col("_q") == 0, bad).otherwise(1.0)
    return rows.join(q, F.col("doc_id") == F.col("_id"), "left").withColumn("quality_weight", w).drop("_id", "_q")
