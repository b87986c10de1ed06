"""Edge rules on hand-made rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldloom.functions.sequential import with_smoothed
from yieldloom.operators import asof as A
from yieldloom.operators import dividends as D
from yieldloom.operators import events as E
from yieldloom.operators import fundamentals as U
from yieldloom.operators import mlprep as L
from yieldloom.operators import portfolio as P
from yieldloom.operators import returns as R
from yieldloom.operators import screens as X
from yieldloom.operators import strategy as S
from yieldloom.sources import clean as C
from yieldloom.sources import readers as I
from yieldloom.sources import sinks as K

D0 = dt.date(2020, 1, 1)


def days(n):
    return [D0 + dt.timedelta(days=i) for i in range(n)]


def prices(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, d, float(c)) for d, c in zip(days(len(closes)), closes)], "symbol string, date date, close double")


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first()


@pytest.mark.parametrize("n,has5,has10", [(5, False, False), (6, True, False), (10, True, False), (11, True, True)])
def test_cagr_needs_enough_years(spark, n, has5, has10):
    rows = [("A", dt.date(2000 + i, 6, 1), 1.0 + i) for i in range(n)]
    div = spark.createDataFrame(rows, "symbol string, date date, adjDividend double")
    asof = f"{2000 + n}-03-01"
    s = D.dividend_stats(D.yearly_dividends(div, asof), asof).first()
    assert (s["cagr_5y"] is not None) == has5 and (s["cagr_10y"] is not None) == has10


def test_zero_year_gives_no_percentage(spark):
    div = spark.createDataFrame([("A", dt.date(2000, 6, 1), 2.0), ("A", dt.date(2002, 6, 1), 3.0)], "symbol string, date date, adjDividend double")
    y = D.yearly_dividends(div, "2003-05-01")
    assert [r["adjDividend"] for r in y.orderBy("year").collect()] == [2.0, 0.0, 3.0]
    s = D.dividend_stats(y, "2003-05-01").first()
    assert s["historical_mean_pct"] == -100.0 and s["num_positive_year"] == 2 and s["num_dividend_year"] == 2


def test_trailing_sum_waits_for_four_quarters(spark):
    fin = spark.createDataFrame([("A", dt.date(2020, 3 * q, 1), 10.0 * q, 1.0) for q in (1, 2, 3, 4)], "symbol string, date date, revenue double, netIncome double")
    t = U.trailing(fin.withColumn("reportedCurrency", F.lit("IDR"))).orderBy("date").collect()
    assert [r["revenue_ttm"] for r in t] == [None, None, None, 100.0]


def test_leap_day_moves_to_28(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2020, 2, 28),)], "date date")
    assert {r[0] for r in df.select(D.shift_to_year("date", 2021)).collect()} == {dt.date(2021, 2, 28)}


def test_rsi_without_losses(spark):
    up, flat = prices(spark, range(1, 21)), prices(spark, [5] * 20, "F")
    d = with_smoothed(up.unionByName(flat), "close", rsi=(14,))
    last = {r["symbol"]: r["rsi_14"] for r in d.where(F.col("date") == days(20)[-1]).collect()}
    assert last == {"A": 100.0, "F": None}
    assert with_smoothed(up, "close", rsi=(14,), zero_loss=None).where("rsi_14 is not null").count() == 0


def test_asof_inclusive_strict_and_forward(spark):
    left = prices(spark, [1, 2, 3])
    right = spark.createDataFrame([("A", days(3)[1], 9.0)], "symbol string, date date, v double")
    get = lambda **k: [r["v"] for r in A.asof_join(left, right, ["symbol"], {"v": "v"}, **k).orderBy("date").collect()]
    assert get() == [None, 9.0, 9.0]
    assert get(strict=True) == [None, None, 9.0]
    assert get(direction="forward") == [9.0, 9.0, None]


def test_asof_keeps_null_of_matched_row(spark):
    left = prices(spark, [1, 2, 3])
    right = spark.createDataFrame([("A", days(3)[0], 1.0), ("A", days(3)[1], None)], "symbol string, date date, v double")
    assert [r["v"] for r in A.asof_join(left, right, ["symbol"], {"v": "v"}).orderBy("date").collect()] == [1.0, None, None]


def test_missing_previous_session_has_no_return(spark):
    d = prices(spark, [10, 11, 12]).unionByName(prices(spark, [5], "B").unionByName(prices(spark, [5, 6, 7], "B").where(F.col("date") == days(3)[2])))
    r = R.session_return(d, str(days(3)[2]))
    assert one(r, symbol="B")["return_1d_pct"] is None
    assert one(r, symbol="A")["return_1d_pct"] == pytest.approx(100 / 11)


def test_recovery_censored_and_recovered(spark):
    px = prices(spark, [10, 10, 8, 9, 10]).unionByName(prices(spark, [10, 10, 8, 8, 8], "B"))
    ev = spark.createDataFrame([("A", days(5)[2]), ("B", days(5)[2])], "symbol string, ex_date date")
    r = E.cum_recovery(px, ev)
    a, b = one(r, symbol="A"), one(r, symbol="B")
    assert (a["cum_recovered"], a["cum_days_after"]) == (True, 2)
    assert (b["cum_recovered"], b["cum_days_after"], b["cum_recover_date"]) == (False, 2, None)


def test_lowest_entry_takes_the_earliest_tie(spark):
    px = prices(spark, [10, 7, 7, 9, 9])
    ev = spark.createDataFrame([("A", days(5)[4])], "symbol string, ex_date date")
    r = E.best_entry(px, ev).first()
    assert r["low_date"] == days(5)[1] and r["days_before"] == 3


def test_survival_quantile_by_hand(spark):
    rows = [("g", 5, True), ("g", 5, True), ("g", 7, False), ("g", 9, True), ("g", 12, False)]
    df = spark.createDataFrame(rows, "g string, d int, r boolean")
    s = E.survival_quantiles(df, "d", "r", ["g"], {"p25": 0.25, "median": 0.5, "p90": 0.9}).first()
    assert (s["p25"], s["median"], s["p90"], s["recovered"], s["censored"]) == (5, 9, None, 3, 2)


def test_trades_do_not_overlap_or_start_on_the_last_bar(spark):
    # falls below the oversold level stay on, so every bar after the warm-up is a setup
    closes = [100 - 0.1 * i for i in range(140)]
    px = prices(spark, closes)
    rule = S.Rule("regime_rsi", 2, 101, 5, 101)
    series = px.withColumn("regime", F.lit("bear")).withColumn("bench", F.col("close")).withColumn("part", F.lit("all")).withColumn("rn", F.row_number().over(R.by_symbol()))
    combos = spark.createDataFrame([(0, rule.id, 3, 5.0, 50.0)], "combo int, rule string, max_hold int, profit_target double, stop_loss double")
    t = S.trades(series, [rule], combos).orderBy("trade_no").collect()
    assert t and all(a["exit_rn"] < b["entry_rn"] for a, b in zip(t, t[1:]))
    assert all(x["exit_rn"] - x["entry_rn"] <= 3 for x in t) and t[-1]["entry_rn"] < 140
    assert t[0]["exit_rn"] - t[0]["entry_rn"] == 3 and t[1]["entry_rn"] == t[0]["exit_rn"] + 1


def test_drip_never_ends_with_fewer_lots(spark):
    px = prices(spark, [10.0] * 700)
    div = spark.createDataFrame([("A", days(700)[i], 1.0) for i in (100, 300, 500)], "symbol string, date date, adjDividend double")
    alloc = spark.createDataFrame([("s", "A", 10500.0)], "scenario string, symbol string, amount double")
    r = {(x["strategy"], x["year"]): x for x in P.replay(alloc, px, div, 2020, 2021).collect()}
    assert r[("No DRIP", 2021)]["lots"] == 10 and r[("No DRIP", 2021)]["cash"] == 500 + 3000
    assert r[("With DRIP", 2021)]["lots"] > 10 and r[("With DRIP", 2020)]["income"] >= r[("No DRIP", 2020)]["income"]


def test_topup_by_hand(spark):
    px = prices(spark, [10.0] * 366)
    div = spark.createDataFrame([("A", dt.date(2020, 3, 15), 0.5)], "symbol string, date date, adjDividend double")
    plans = spark.createDataFrame([("s", "A", 2020, 2020, 1000.0, 1000.0)], "scenario string, symbol string, start_year int, end_year int, initial double, topup double")
    r = {x["month"].month: x for x in P.topup_replay(plans, px, div).collect()}
    assert r[1]["lots"] == 1 and r[3]["lots"] == 3 and r[3]["income"] == 150 and r[12]["lots"] == 12
    assert r[12]["cash"] == 150


def test_forward_returns_as_stored_and_as_meant(spark):
    r = one(L.forward_returns(prices(spark, [10, 11, 22]), (1,)), date=D0)
    assert r["return_1d"] == pytest.approx(-50) and r["return_1d_intended"] == pytest.approx(10)


def test_cleaning_drops_bad_rows_and_keeps_the_last(spark):
    raw = spark.createDataFrame(
        [("A", "2020-01-01", "10", 1), ("A", "2020-01-01", "11", 2), ("A", "bad", "12", 3), ("A", "2020-01-02", "-1", 4), ("A", "2020-01-03", "NaN", 5), ("A", "2020-01-04", "x", 6)],
        "symbol string, date string, close string, seq long")
    assert [(r["date"], r["close"]) for r in C.clean_prices(raw, "seq").collect()] == [(D0, 11.0)]
    with pytest.raises(ValueError, match="close"):
        C.clean_prices(raw.drop("close"), "seq")


def test_upsert_corrections_win_and_failed_write_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "px")
    put = lambda df, n=1: K.upsert_prices(spark, path, df.withColumn("seq", F.lit(n)))
    assert K.read_prices(spark, path).count() == 0
    put(prices(spark, [90, 91]))
    put(prices(spark, [100]))
    read = lambda: {r["date"]: r["close"] for r in K.read_prices(spark, path).collect()}
    assert read() == {days(2)[0]: 100.0, days(2)[1]: 91.0}
    put(prices(spark, [100]))  # a repeated batch changes nothing
    assert read() == {days(2)[0]: 100.0, days(2)[1]: 91.0}
    two = prices(spark, [5]).withColumn("seq", F.lit(7)).unionByName(prices(spark, [6]).withColumn("seq", F.lit(3)))
    K.upsert_prices(spark, path, two)
    assert read()[days(2)[0]] == 5.0
    put(prices(spark, [100]))
    with pytest.raises(ValueError, match="seq"):
        K.upsert_prices(spark, path, prices(spark, [1]))
    broken = prices(spark, [1, 2]).withColumn("seq", F.lit(9)).withColumn("close", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        K.upsert_prices(spark, path, broken)
    assert read() == {days(2)[0]: 100.0, days(2)[1]: 91.0}


def test_upsert_refuses_stored_parts_it_cannot_read(spark, tmp_path):
    path = str(tmp_path / "px")
    K.upsert_prices(spark, path, prices(spark, [90, 91]).withColumn("seq", F.lit(1)))
    part = next((tmp_path / "px").glob("v-*/prices/year=*/bucket=*"))
    prices(spark, [1, 2]).withColumnRenamed("close", "price").drop("year").write.mode("overwrite").parquet(str(part))
    with pytest.raises(ValueError, match="close"):
        K.upsert_prices(spark, path, prices(spark, [100]).withColumn("seq", F.lit(2)))


def test_a_lost_writer_leaves_the_last_pointer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "px")
    K.upsert_prices(spark, path, prices(spark, [90]).withColumn("seq", F.lit(1)))
    publish = K._publish
    monkeypatch.setattr(K, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError, match="driver lost"):
        K.upsert_prices(spark, path, prices(spark, [80]).withColumn("seq", F.lit(2)))
    monkeypatch.setattr(K, "_publish", publish)
    assert [r["close"] for r in K.read_prices(spark, path).collect()] == [90.0]
    K.upsert_prices(spark, path, prices(spark, [80]).withColumn("seq", F.lit(2)))
    assert [r["close"] for r in K.read_prices(spark, path).collect()] == [80.0]


def test_forward_as_of_takes_the_next_row_and_ties(spark):
    left = spark.createDataFrame([("A", d) for d in days(5)], "symbol string, date date")
    right = spark.createDataFrame([("A", days(5)[1], 1.0), ("A", days(5)[3], 3.0)], "symbol string, date date, v double")
    d = {x["date"]: x["v"] for x in A.asof_join(left, right, ["symbol"], {"v": "v"}, direction="forward").collect()}
    assert [d[x] for x in days(5)] == [1.0, 1.0, 3.0, 3.0, None]
    d = {x["date"]: x["v"] for x in A.asof_join(left, right, ["symbol"], {"v": "v"}, direction="forward", strict=True).collect()}
    assert [d[x] for x in days(5)] == [1.0, 3.0, 3.0, None, None]


def _zigzag(spark, n):
    closes = [100 + (10 if i % 7 == 0 else -i % 5) for i in range(n)]
    s = prices(spark, closes).withColumn("regime", F.lit("bull")).withColumn("bench", F.lit(1.0)).withColumn("part", F.lit("all"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


def test_no_trades_before_the_warm_up_and_the_combos_hold(spark):
    rule = S.Rule("regime_rsi", 3, 200, 2, 200)  # every close above its mean is a setup
    combos = spark.createDataFrame([(0, rule.id, 7, 1000.0, 1000.0)], "combo int, rule string, max_hold int, profit_target double, stop_loss double")
    assert rule.warmup == 205
    assert S.trades(_zigzag(spark, 204), [rule], combos).count() == 0
    t = S.trades(_zigzag(spark, 230), [rule], combos).collect()
    assert t and max(r["exit_rn"] - r["entry_rn"] for r in t) == 7


def test_more_rules_than_bits(spark):
    many = [S.Rule("regime_rsi", 3, 30 + i, 2, 200) for i in range(70)]
    combos = spark.createDataFrame([(i, r.id, 3, 1000.0, 1000.0) for i, r in enumerate(many)], "combo int, rule string, max_hold int, profit_target double, stop_loss double")
    got = {r["combo"] for r in S.trades(_zigzag(spark, 230), many, combos).select("combo").distinct().collect()}
    assert got == set(range(70))


def test_completeness_counts_empty_as_failed(spark):
    ask = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = {"x": prices(spark, [1]), "y": prices(spark, [1]).limit(0)}
    r = {x["type"]: x for x in K.completeness(ask, got).collect()}
    assert (r["x"]["failed"], r["x"]["success_rate"], r["x"]["error"]) == (1, 50.0, False)
    assert (r["y"]["failed"], r["y"]["error"]) == (2, True)
    assert {x["type"]: x["failed_symbols"] for x in K.failed_symbols(ask, got).collect()} == {"x": ["B"], "y": ["A", "B"]}


def test_empty_years_stay_out_of_the_manifest(spark, tmp_path):
    cal = spark.createDataFrame([(dt.date(2020, 5, 1), "A", 1.0), (dt.date(2022, 5, 1), "A", 1.0)], "date date, symbol string, adjDividend double")
    K.publish_calendar(cal, str(tmp_path / "c"))
    assert sorted(r["year"] for r in K.published_years(spark, str(tmp_path / "c")).collect()) == [2020, 2022]


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿No.;Kode;Nama Emiten;Keterangan\n1;AADI;Name Tbk.;\n", encoding="utf-8")
    r = I.read_compliance_csv(spark, str(tmp_path / "c.csv")).first()
    assert (r["No."], r["Kode"]) == (1, "AADI")
    (tmp_path / "div").mkdir()
    (tmp_path / "div" / "AADI.csv").write_text("ex_date,dividend\n2020-05-01,12.5\n")
    d = I.read_dividend_csv(spark, str(tmp_path / "div"), r"([A-Z]+)\.csv", "symbol", "ex_date date, dividend double").first()
    assert (d["symbol"], d["adjDividend"]) == ("AADI", 12.5)


def test_digest_ignores_row_order(spark):
    a = spark.range(100).select("id", (F.col("id") * 3).alias("x"))
    assert I.frame_digest(a).first() == I.frame_digest(a.orderBy(F.desc("id")).repartition(5)).first()
    assert I.frame_digest(a).first() != I.frame_digest(a.withColumn("x", F.col("x") + 1)).first()


def test_display_sample_is_whole_below_its_size_and_repeatable(spark):
    y = spark.range(50).select(F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.lit(D0).alias("ex_date"))
    assert E.display_sample(y, 100).count() == 50
    assert E.display_sample(y, 10).collect() == E.display_sample(y.repartition(4), 10).collect()


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(1.0,)] * 9, "v double")
    h = X.histogram(df, "v").toPandas()
    assert len(h) == 50 and h["count"].sum() == 9


def test_signal_returns_alternate(spark):
    px = prices(spark, [10, 20, 10, 30])
    sig = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": days(4), "signal": ["buy", "buy", "sell", "buy"]}), "symbol string, date date, signal string")
    r = L.signal_returns(px, sig, "m").first()
    assert r["m_trades"] == 2 and r["m_return"] == pytest.approx(0.0)


def test_boosted_trees_run_at_the_operators_defaults(monkeypatch):
    from yieldloom.plans import q_ops, registry

    registry.queries()
    asked = []
    monkeypatch.setattr(q_ops, "modelled", lambda m, **how: asked.append(how) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        registry._QUERIES["N07_boosted_trees"](None)
    assert asked == [{"kind": "boosted"}]


def labelled(spark, n=60):
    """Close falls on every label 'sell', rises on 'buy'; the feature tells them apart."""
    says = ["buy", "hold", "sell"]
    rows = [(s, d, float(i % 3), says[i % 3]) for s in ("A", "B") for i, d in enumerate(days(n))]
    return spark.createDataFrame(rows, "symbol string, date date, x double, trade_signal string")


def test_models_are_trained_saved_and_compared(spark, tmp_path):
    d = labelled(spark)
    rows = L.training_set(d, ["x"], "2020-01-01", "2020-12-31")
    specs = [L.ModelSpec("forest", trees=5), L.ModelSpec("boosted", "boosted", trees=2, learning_rate=0.5), L.ModelSpec("stump", trees=1, child_weight=1e9)]
    models = L.train_all(rows, ["x"], specs)
    p = L.predict_all(models, rows, ["x"])
    assert p.count() == 360
    closes = d.select("symbol", "date", F.element_at(F.array(F.lit(10.0), F.lit(12.0), F.lit(12.0)), F.col("x").cast("int") + 1).alias("close"))
    got = {r.model: r for r in L.compare_models(closes, p, d.select("symbol", "date", F.col("trade_signal").alias("signal"))).collect()}
    for name in ("forest", "boosted"):
        r = got[name]
        assert (r.rows, r.symbols, r.weighted_accuracy, r.buy_precision, r.sell_recall) == (120, 2, 1.0, 1.0, 1.0)
        assert r.model_return == pytest.approx(r.ideal_return) == pytest.approx((1.2**20 - 1) * 100) and r.trades == 40
    assert got["stump"].weighted_accuracy < 1 and got["stump"]["rank"] == 3 and got["boosted"]["rank"] == 1  # a tie goes by name
    L.save_models(models, str(tmp_path))
    for x in specs:
        again = L.predict(L.load_model(str(tmp_path), x.kind, x.name), rows, ["x"])
        assert again.exceptAll(p.where(F.col("model") == x.name).select(again.columns)).count() == 0


def test_models_need_known_kinds_and_names_of_their_own(spark):
    rows = L.training_set(labelled(spark, 6), ["x"], "2020-01-01", "2020-12-31")
    with pytest.raises(ValueError, match="names"):
        L.train_all(rows, ["x"], [L.ModelSpec("a"), L.ModelSpec("a", trees=3)])
    with pytest.raises(ValueError, match="unknown kind"):
        L.train(rows, ["x"], kind="net")


def test_a_model_without_signals_has_no_precision(spark):
    p = spark.createDataFrame([("m", "A", D0, 0, 25, "hold"), ("m", "A", D0 + dt.timedelta(days=1), 1, 1, "hold")], "model string, symbol string, date date, label int, weight int, signal string")
    lab = spark.createDataFrame([("A", D0, "buy")], "symbol string, date date, signal string")
    r = L.compare_models(prices(spark, [10, 11]), p, lab).first()
    assert r.buy_precision is None and r.buy_recall == 0 and r.sell_recall is None and r.model_return == 0 and r.benchmark_return == pytest.approx(10)
    assert L.compare_models(prices(spark, [10, 11]), p.where("false"), lab).count() == 0


def test_scratch_folder_is_one_that_executors_reach():
    from yieldloom.session import _beside_tables

    assert _beside_tables("file:/w/", "local[4]") == "file:/w/_scratch" and _beside_tables("s3a://b/w", "yarn") == "s3a://b/w/_scratch"
    for w in ("file:/w", "file:///w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _beside_tables(w, "spark://host:7077")
