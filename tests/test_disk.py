"""What is written to disk: shuffles go once their result is stored, stored rows are compressed, wide rows are not dealt anew."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom import session as S
from yieldloom.llm.common import stage
from yieldloom.operators import indicators as I
from yieldloom.operators import mlprep as L

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}


@pytest.mark.parametrize("store", [S.cut_lineage, S.cut_packed, lambda d: stage(d, "t")])
def test_shuffles_go_when_the_result_is_stored(spark, store):
    d = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")).orderBy("k")
    before = shuffles(spark)
    out = store(d)
    assert not shuffles(spark) - before
    assert out.agg(F.sum("n")).first()[0] == 5000
    assert spark.conf.get(SETTING) == "false"


def test_packed_rows_stay_as_they_are(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"S{i % 5:06d}", float("nan") if i == 3 else i / 4, dt.date(2000, 1, 1 + i % 28), [i] if i % 2 else None) for i in range(20000)]
    d = spark.createDataFrame(rows, "id long, `a.b` string, x double, day date, l array<int>").repartition(5, "day").sortWithinPartitions("day", "id")
    look = lambda x: x.select("*", F.spark_partition_id().alias("p")).collect()
    want, got = look(d), look(S.cut_packed(d))
    assert list(map(repr, got)) == list(map(repr, want)) and S.cut_packed(d).schema == d.schema
    empty = S.cut_packed(d.where("id < 0"))
    assert empty.columns == d.columns and empty.count() == 0

    root = Path(S.scratch_root(spark).removeprefix("file:"))
    size = lambda: {p: p.stat().st_size for p in root.rglob("part-*")}
    first = size()
    plain = S.cut_lineage(d)
    second = size()
    packed = S.cut_packed(d)
    third = size()
    assert 2 * sum(third[p] for p in third.keys() - second.keys()) < sum(second[p] for p in second.keys() - first.keys())
    assert plain.count() == packed.count() == 20000


def test_labels_join_narrow_rows(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    px = spark.createDataFrame([(s, x, 1.0, 2.0, 0.5, 1.0 + i % 3, 5.0) for s in ("A", "B", None) for i, x in enumerate([*days, None])], "symbol string, date date, open double, high double, low double, close double, volume double")
    pe = spark.createDataFrame([("A", days[3], 7.0), ("A", days[3], 8.0), ("B", days[4], None), (None, days[3], 1.0)], "symbol string, date date, pe double")
    lab = spark.createDataFrame([("A", x, "hold") for x in days[2:30]] + [("A", days[3], "buy"), ("B", days[4], None), (None, days[4], "sell"), ("A", None, "sell"), ("C", days[5], "buy")], "symbol string, date date, trade_signal string")
    d = L.feature_table(px, pe, lab)
    want = I.feature_indicators(px).join(pe, ["symbol", "date"], "left").join(lab, ["symbol", "date"])
    assert d.columns == want.columns and sorted(map(repr, d.collect())) == sorted(map(repr, want.collect())) and d.count() == 28 + 3 + 1
    plan = d._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above  # nothing is dealt anew behind the folds


def test_boosted_trees_keep_no_copy_of_the_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("A", dt.date(2000, 1, 1), float(i % 9), i % 3, 1) for i in range(90)], "symbol string, date date, x double, label int, weight int")

    def kept(*_):
        raise AssertionError("rows are kept")

    monkeypatch.setattr(DataFrame, "persist", kept)
    monkeypatch.setattr(type(rows), "persist", kept)
    model = L.train(rows, ["x"], trees=2, depth=2, kind="boosted")
    monkeypatch.undo()
    p = L.predict(model, rows, ["x"])
    assert p.where("signal = element_at(array('buy', 'hold', 'sell'), label + 1)").count() == 90
