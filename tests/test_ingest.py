"""Price stages with their modes, stored parts, quote snapshots, digests and sums that do not depend on partitions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldloom.operators import strategy as S
from yieldloom.session import scratch_path
from yieldloom.sources import readers as I
from yieldloom.sources import sinks as K
from yieldloom.streaming import ingest as Q

DAY = dt.date(2024, 3, 1)


def delivery(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(d), float(c), q) for s, d, c, q in rows], "symbol string, date date, close double, seq long")


@pytest.fixture()
def table(spark):
    return scratch_path(spark, "stage")


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([("A",), ("B",), ("C",), (None,), ("A",)], "symbol string")


def stored(spark, path):
    return {(r.symbol, (r.date - DAY).days): r.close for r in K.read_prices(spark, path).collect()}


def test_unknown_mode_is_refused(spark, table, symbols):
    with pytest.raises(ValueError, match="mode"):
        K.ingest_delivery(spark, table, symbols, delivery(spark, [("A", 0, 1, 1)]), "daily", "2024-03-01")
    assert K.current(spark, table) is None


def test_empty_delivery_is_an_error_and_changes_nothing(spark, table, symbols):
    K.ingest_delivery(spark, table, symbols, delivery(spark, [("A", 0, 1, 1)]), "backfill", "2024-03-02")
    before = K.current(spark, table)
    for rows in ([], [("A", -9000, 1, 1)], [("Z", 0, 1, 1)], [("A", 40, 1, 1)]):  # nothing, too old, not asked for, not due yet
        with pytest.raises(RuntimeError, match="asked for"):
            K.ingest_delivery(spark, table, symbols, delivery(spark, rows), "incremental", "2024-03-02")
    assert K.current(spark, table) == before


def test_partial_delivery_is_merged_and_reported(spark, table, symbols):
    got = K.ingest_delivery(spark, table, symbols, delivery(spark, [("A", 0, 1, 1), ("A", 0, 2, 5), ("B", -400, 3, 1)]), "backfill", "2024-03-02")
    assert [tuple(r) for r in got.collect()] == [("backfill", 3, 2, 1, 2)]
    assert stored(spark, table) == {("A", 0): 2.0, ("B", -400): 3.0}
    assert {r.symbol: r.mark for r in K.high_water(spark, table).collect()} == {"A": DAY, "B": DAY - dt.timedelta(400)}
    # the next run asks a week for A, from its mark for B, everything for C
    plan = {r.symbol: r.from_date for r in K.fetch_plan(symbols, K.high_water(spark, table), "incremental", "2024-03-12").collect()}
    assert plan == {"A": DAY, "B": DAY - dt.timedelta(400), "C": dt.date(2010, 1, 1)}
    rows = [("A", -1, 9, 9), ("A", 0, 4, 9), ("A", 5, 5, 9), ("B", -399, 6, 9), ("C", -3000, 7, 9)]  # the first lies before A's window
    got = K.ingest_delivery(spark, table, symbols, delivery(spark, rows), "incremental", "2024-03-12")
    assert [tuple(r) for r in got.collect()] == [("incremental", 3, 3, 0, 4)]
    assert stored(spark, table) == {("A", 0): 4.0, ("A", 5): 5.0, ("B", -400): 3.0, ("B", -399): 6.0, ("C", -3000): 7.0}


def test_only_touched_parts_are_written_and_only_needed_ones_read(spark, table):
    many = [(f"S{i:03d}", d, i, 1) for i in range(64) for d in (0, -366, -731)]
    K.upsert_prices(spark, table, delivery(spark, many))
    first = K.current(spark, table)["parts"]
    K.upsert_prices(spark, table, delivery(spark, [("S005", 0, 99, 2)]))
    then = K.current(spark, table)["parts"]
    assert sum(first[k] != then[k] for k in first) == 1 and first.keys() == then.keys()
    one = K.read_prices(spark, table, "2024-01-01", "2024-12-31", ["S005"])
    assert [r.close for r in one.collect()] == [99.0] and len(one.inputFiles()) < len(K.read_prices(spark, table).inputFiles()) / 20
    assert K.read_prices(spark, table).count() == len(many)


def test_quote_files_do_not_grow_with_batches(spark):
    root = scratch_path(spark, "quotes-test")
    t0 = dt.datetime(2024, 3, 1)
    sizes, want = [], {}
    for k in range(14):
        late = k == 9
        rows = [("A", t0 + dt.timedelta(days=-30 if late else k), 100.0 + k, 100.0), (f"B{k % 3}", t0 + dt.timedelta(days=k), float(k + 1), 1.0)]
        for s, ts, p, _ in rows:
            if s not in want or ts >= want[s][0]:
                want[s] = ts, p
        spark.createDataFrame(rows, Q.QUOTE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        Q.run_latest_quotes(spark, f"{root}/in", f"{root}/out", f"{root}/state", keep=3)
        sizes.append(len(Q._folders(spark, f"{root}/out")))
    assert max(sizes) <= 3 and len(sizes) == 14
    assert {r.symbol: (r.ts, r.price) for r in Q.read_latest_quotes(spark, f"{root}/out").collect()} == want


def test_digest_tree(spark):
    d = delivery(spark, [("A", 0, 1, 1), ("A", 40, 2, 1), ("B", 0, 3, 1), ("B", 1, 3, 1)])
    e = delivery(spark, [("A", 0, 1, 1), ("A", 40, 2.5, 1), ("B", 1, 3, 1), ("B", 0, 3, 1), ("C", 0, 1, 1)])
    a, b = I.digest_parts(d), I.digest_parts(e)
    assert {(r.symbol, r.month.month, r.change) for r in I.changed_parts(a, b, ["symbol", "month"]).collect()} == {("A", 4, "edited"), ("C", 3, "added")}
    assert {(r.symbol, r.change) for r in I.changed_parts(I.roll_up(b, "symbol"), I.roll_up(a, "symbol"), ["symbol"]).collect()} == {("A", "edited"), ("C", "removed")}
    whole, again = I.frame_digest(d).first(), I.roll_up(I.roll_up(a, "symbol")).first()
    assert (whole.rows, whole.xor, int(whole.total)) == (again.rows, again.xor, int(again.total))
    seen = []

    def count(x):
        seen.extend(r.symbol for r in x.select("symbol").distinct().collect())
        return x.groupBy("symbol").agg(F.count("*").alias("n"))

    old = d.groupBy("symbol").agg(F.count("*").alias("n"))
    new = I.refresh(old, e, I.changed_parts(a, b, ["symbol", "month"]), count)
    assert {tuple(r) for r in new.collect()} == {("A", 2), ("B", 2), ("C", 1)} and sorted(seen) == ["A", "C"]


def test_summary_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        v = [float(x) for x in rng.normal(0, 3, 8)]
        for combo in (0, 1, 2, 3):  # 0 and 1, and 2 and 3, traded alike
            w = v if combo < 2 else [x * 1.1 for x in v]
            n = int(abs(w[0]) * 2)
            rows.append((f"S{i}", combo, w[1], 50 + w[2], -abs(w[3]), 3, w[4], w[5], 50 + w[6], -abs(w[7]), n, w[1] / 3))
    cols = "symbol string, combo int, total_return double, win_rate double, max_drawdown double, trades long, avg_trade double, val_total_return double, val_win_rate double, val_max_drawdown double, val_trades long, val_avg_trade double"
    d = spark.createDataFrame(rows, cols)
    seen = set()
    for parts in (1, 4, 211):
        shuffled = d.orderBy(F.rand(parts)).repartition(parts)
        seen.add(tuple(sorted(str(tuple(r)) for r in S.summarize(shuffled).collect())))
    assert len(seen) == 1
    got = {r.combo: r for r in S.summarize(d).collect()}
    assert got[0].score == got[1].score and got[2].score == got[3].score and got[0].val_avg_trade == got[1].val_avg_trade


