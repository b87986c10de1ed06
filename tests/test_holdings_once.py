"""Texts of holdings are parsed once."""

from yieldloom.operators import portfolio as P


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_holdings_are_parsed_once(spark):
    rows = [(1, " abc.jk ", "1,000", " 2,500 "), (1, "ABC", "500", "1000"), (2, "X", "n/a", "5"), (2, "Y", "3", "-5"), (3, "Z", "NaN", "1"), (3, "Z", "1", "Infinity"), (4, " ", "1", "1"), (4, None, "1", "1"), (5, "Q", None, None)]
    raw = spark.createDataFrame(rows, "holder int, Symbol string, `Available Lot` string, `Average Price` string")
    good, bad = P.normalize_holdings(raw)
    assert [tuple(r) for r in good.collect()] == [(1, "ABC", 1500.0, 2000.0)]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "X", "Available Lot"), (2, "Y", "Average Price"), (3, "Z", "Available Lot"), (3, "Z", "Average Price"), (5, "Q", "Available Lot")]
    for d in (good, bad):
        assert plan(d).count("regexp_replace(") == 1
        assert plan(d).count("try_cast(") == 2
