"""Exact ranks and quantiles over groups of any size.

A window without a bounded partition would bring a whole market, or one hot
group of it, into one task. Here a range sort spreads the rows over all tasks
(a unique key splits ties) and ``scan_sorted`` reads places, ties and sums off
the sorted partitions. Only one row per *partition* is handled in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan_sorted


def order_index(df: DataFrame, order: list[Column | str], out: str = "_rn") -> DataFrame:
    """Add the 1-based position of each row in the total order.

    ``order`` has to end in a unique key.
    """
    return scan_sorted(df, [], order).withColumnRenamed("_place", out).drop("_n")


def running_before(df: DataFrame, order: list[Column | str], weight: str, out: str = "_before", by: list[str] | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all rows of the group strictly earlier in the order."""
    return scan_sorted(df, by or [], order, weights={out: weight}).drop("_place", "_n", f"{out}_total")


def group_running_totals(df: DataFrame, by: list[str], order: list[str], weights: dict[str, str]) -> DataFrame:
    """Inclusive running sums per group for groups of unbounded size.

    ``weights`` maps output names to columns; ``order`` has to be unique in a group.
    """
    run = scan_sorted(df, by, order, weights=weights)
    return run.select(*df.columns, *[(F.col(o) + F.coalesce(F.col(c), F.lit(0))).alias(o) for o, c in weights.items()])


def group_row_number(df: DataFrame, by: list[str], order: list[Column | str], out: str) -> DataFrame:
    """``row_number`` per group for groups of unbounded size."""
    return scan_sorted(df, by, order).withColumnRenamed("_place", out).drop("_n")


def avg_pct_rank(df: DataFrame, value: str, out: str, key: str | list[str] = "symbol", by: list[str] | None = None) -> DataFrame:
    """Percent rank (0..1) with average ties among non-null values; NULL stays NULL."""
    keys = [key] if isinstance(key, str) else key
    d = scan_sorted(df, by or [], [F.col(value).asc_nulls_last(), *keys], value=value)
    rank = F.col("_low") - 1 + (F.col("_count") + 1) / 2
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.try_divide(rank, F.col("_n").cast("double")))).drop("_place", "_n", "_low", "_count")


def long_pct_ranks(df: DataFrame, key: list[str], metrics: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Average-tie percent ranks of several metrics with one sort.

    The metrics are stacked into (key, metric, value) rows, ranked per metric
    and spread again, so six ranks cost one range sort instead of six.
    """
    by = by or []
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()]))
    long = df.select(*key, *[b for b in by if b not in key], cells.alias("_c")).select(
        *key, *[b for b in by if b not in key], "_c.metric", "_c.value"
    ).where("value is not null")
    ranked = avg_pct_rank(long, "value", "_pct", key=key, by=["metric", *by])
    return ranked.groupBy(*key).agg(*[F.max(F.when(F.col("metric") == n, F.col("_pct"))).alias(n) for n in metrics])


def distribution(df: DataFrame, value: str, by: list[str], quantiles: dict[str, float], moments: bool = True) -> DataFrame:
    """count, mean, sample deviation and exact linear quantiles per group.

    Equal values are counted first, so a hot value is one row before the sort,
    and the groups are never gathered: every quantile is picked by position.
    """
    if not by:
        one = df.withColumn("_one", F.lit(1))
        return distribution(one, value, ["_one"], quantiles, moments).drop("_one")
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    placed = scan_sorted(cells, by, ["_v"], weights={"_from": "_c"}).withColumnRenamed("_from_total", "n")
    aggs, outs = [], []
    for name, p in quantiles.items():
        k = F.lit(float(p)) * (F.col("n") - 1)
        for side, pos in (("lo", F.floor(k)), ("hi", F.ceil(k))):
            hit = (F.col("_from") <= pos) & (pos < F.col("_from") + F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        frac = k - F.floor(k)
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    res = placed.groupBy(*by, "n").agg(*aggs)
    if not moments:
        return res.select(*by, "n", *outs)
    plain = df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.stddev_samp(F.col(value).cast("double")).alias("std"))
    return res.join(plain, [res[b].eqNullSafe(plain[b]) for b in by]).select(*[res[b] for b in by], "n", "mean", "std", *outs)


def chunked_list(df: DataFrame, by: list[str], item: str, out: str, size: int = 1000) -> DataFrame:
    """Sorted list per group, in chunks of bounded length so no row grows with the data."""
    ranked = group_row_number(df.select(*by, item), by, [item], "_pos")
    return (
        ranked.withColumn("chunk", F.floor((F.col("_pos") - 1) / size).cast("int"))
        .groupBy(*by, "chunk")
        .agg(F.array_sort(F.collect_list(item)).alias(out))
    )
