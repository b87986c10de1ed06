"""Ranks, quantiles and running sums, also with one value or key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldloom.functions import ranking as K
from yieldloom.functions.scan import scan_sorted


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    v = rng.integers(0, 400, n).astype(float)
    v[: n // 3] = 42.0
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"symbol": [f"X{i:05d}" for i in range(n)], "g": g, "v": v})
    pdf.loc[pdf.index % 17 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df.repartition(7)


def test_pct_rank_matches_pandas(skewed):
    pdf, df = skewed
    got = K.avg_pct_rank(df, "v", "p").select("symbol", "p").toPandas().set_index("symbol")["p"]
    want = pdf.set_index("symbol")["v"].rank(pct=True)
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index(), check_names=False)


def test_pct_rank_by_group(skewed):
    pdf, df = skewed
    got = K.avg_pct_rank(df, "v", "p", by=["g"]).select("symbol", "p").toPandas().set_index("symbol")["p"]
    want = pdf.set_index("symbol").groupby("g")["v"].rank(pct=True)
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index(), check_names=False)


def test_distribution_is_exact(skewed):
    pdf, df = skewed
    got = K.distribution(df, "v", ["g"], {"q10": 0.1, "med": 0.5, "q75": 0.75}).toPandas().set_index("g").sort_index()
    g = pdf.groupby("g")["v"]
    for c, p in (("q10", 0.1), ("med", 0.5), ("q75", 0.75)):
        np.testing.assert_allclose(got[c], g.quantile(p).sort_index())
    np.testing.assert_allclose(got["std"], g.std().sort_index())
    np.testing.assert_allclose(got["mean"], g.mean().sort_index())
    assert list(got["n"]) == list(g.count().sort_index())


def test_row_numbers_and_running_totals(skewed):
    pdf, df = skewed
    d = df.withColumn("w", F.lit(2))
    rn = K.group_row_number(d, ["g"], ["symbol"], "rn").select("symbol", "rn").toPandas().set_index("symbol")["rn"].sort_index()
    want = pdf.sort_values("symbol").groupby("g").cumcount() + 1
    assert list(rn) == list(want)
    run = K.group_running_totals(d, ["g"], ["symbol"], {"t": "w"}).select("symbol", "t").toPandas().set_index("symbol")["t"].sort_index()
    assert list(run) == list(want * 2)


def test_chunked_list_keeps_everything(skewed):
    pdf, df = skewed
    rows = K.chunked_list(df, ["g"], "symbol", "items", 100).collect()
    assert max(len(r["items"]) for r in rows) <= 100
    assert sorted(x for r in rows for x in r["items"]) == sorted(pdf["symbol"])


def plain_scan(rows, by, order, value, weight):
    """Places, ties and sums of sorted rows, one after the other."""
    rows = sorted(rows, key=order)
    groups = {}
    for r in rows:
        groups.setdefault(by(r), []).append(r)
    out = []
    for g in groups.values():
        n = sum(r[value] is not None for r in g)
        total = sum(r[weight] or 0 for r in g)
        before = 0
        for i, r in enumerate(g):
            low = next(k for k, x in enumerate(g) if x[value] == r[value] or (x[value] is None and r[value] is None))
            out.append((*r, i + 1, n, low + 1, sum(x[value] == r[value] for x in g), before, total))
            before += r[weight] or 0
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 61])
def test_scan_carries_over_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    n = 900
    rows = [(i, "hot" if i % 2 else f"g{i % 40}" if i % 7 else None, 5.0 if i % 2 else None if i % 5 == 0 else float(rng.integers(0, 6)), None if i % 11 == 0 else int(rng.integers(0, 9))) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, g string, v double, w long").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan_sorted(d, ["g"], [F.col("v").asc_nulls_last(), "id"], value="v", weights={"b": "w"})
        assert got.rdd.getNumPartitions() >= min(parts, 4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        key = lambda r: (r[1] is not None, r[1] or "", r[2] is None, r[2] or 0.0, r[0])
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_scan(rows, lambda r: r[1], key, 2, 3)
        whole = scan_sorted(d, [], ["id"], weights={"b": "w"}).collect()
        assert [(r._place, r._n, r.b, r.b_total) for r in sorted(whole)] == [(i + 1, n, sum(x[3] or 0 for x in rows[:i]), sum(x[3] or 0 for x in rows)) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_scan_of_nothing_and_of_float_sums(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert scan_sorted(empty, [], ["id"], weights={"b": "v"}).columns == ["id", "v", "_place", "_n", "b", "b_total"] and scan_sorted(empty, [], ["id"]).count() == 0
    # sums start anew in every group, so a large group does not take digits from a small one
    d = spark.createDataFrame([(1, "a", 1e17), (2, "b", 0.1), (3, "b", 0.2), (4, "c", float("nan")), (5, "c", float("nan"))], "id long, g string, v double")
    got = scan_sorted(d, ["g"], ["id"], weights={"b": "v"}).where("g = 'b'").orderBy("id").collect()
    assert [r.b for r in got] == [0.0, 0.1] and got[0].b_total == 0.1 + 0.2
    ties = scan_sorted(d, ["g"], ["v", "id"], value="v").where("g = 'c'").collect()
    assert {(r._low, r._count) for r in ties} == {(1, 2)}
