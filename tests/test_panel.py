"""Panels of dates against the same question asked date by date."""

import datetime
import random

import pytest

from tidemark.operators import adjust, pit, timeline
from tidemark.operators.pit import Moment
from tidemark.plans import fields as fld
from tidemark.plans import rebalance
from tidemark.sources import stored

D = datetime.date
DAY = datetime.timedelta(1)


def panel_of(spark, days, extra=""):
    return spark.createDataFrame([(d, k) for k, d in enumerate(days)], f"as_of date, run {extra or 'int'}")


def test_holding_is_a_slice_of_the_dates(spark):
    rng = random.Random(1)
    days = [D(2024, 1, 1) + DAY * rng.randrange(90) for _ in range(25)]  # unsorted, with repeats
    facts = [(k, D(2023, 12, 1) + DAY * rng.randrange(150), None if rng.random() < 0.3 else D(2023, 12, 1) + DAY * rng.randrange(150)) for k in range(200)]
    facts += [(900, None, None), (901, D(2024, 2, 1), D(2024, 2, 1))]
    df = spark.createDataFrame(facts, "id int, since date, until date")
    when = Moment(panel=panel_of(spark, days), keys=("as_of", "run"))
    got = sorted((r.id, r.run) for r in when.holding(df, "since", "until").collect())
    assert got == sorted((i, k) for i, a, b in facts for k, d in enumerate(days) if a and a <= d and (b is None or d < b))
    open_ = sorted((r.id, r.run) for r in when.holding(df, "since").collect())
    assert open_ == sorted((i, k) for i, a, _ in facts for k, d in enumerate(days) if a and a <= d)
    plan = when.holding(df, "since", "until")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert Moment(panel=panel_of(spark, [None]), keys=("as_of", "run")).holding(df, "since").count() == 0


def test_cutoffs_of_a_panel(spark):
    facts = spark.createDataFrame([(1, D(2024, 1, 1), 5), (2, D(2024, 1, 1), 9)], "id int, since date, loaded int")
    panel = spark.createDataFrame([(D(2024, 2, 1), 0, None), (D(2024, 2, 1), 1, 7), (D(2024, 2, 1), 2, 0)], "as_of date, run int, cut_KRX int")
    rows = Moment(panel=panel, keys=("run",)).holding(facts, "since", None, "KRX").collect()
    assert sorted((r.run, r.id) for r in rows) == [(0, 1), (0, 2), (1, 1)]


def test_a_panel_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(Moment, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        Moment(panel=panel_of(spark, [D(2024, 1, k) for k in range(1, 6)])).holding(spark.createDataFrame([(D(2024, 1, 1),)], "d date"), "d")


def made_market(rng):
    """Bars with gaps and zero prices; actions that are announced late, replaced, or meet on a day."""
    bars, actions, n = [], [], 0
    for code in ("a", "b", "c"):
        day = D(2022, 6, 1)
        while day < D(2024, 7, 1):
            if rng.random() < 0.6:
                bars.append((code, day, 0.0 if code == "c" and rng.random() < 0.01 else float(rng.randrange(50, 200))))
            if rng.random() < 0.05:
                n += 1
                kind = rng.choice(["split", "bonus_issue", "cash_dividend", "cash_dividend", "merger"])
                said = day + DAY * rng.randrange(-30, 60)  # often after it took effect
                later = rng.random() < 0.4
                actions.append((n * 2, code, kind, said, day, 2.0, 5.0 if kind == "cash_dividend" else None, n * 2 + 1 if later else None))
                if later:
                    actions.append((n * 2 + 1, code, "cash_dividend", said + DAY * rng.randrange(80), day + DAY * rng.randrange(3), None, 3.0, None))
            day += DAY
    return bars, actions


def views(spark, bars, actions):
    tables = {
        "bars": spark.createDataFrame(bars, "code string, d date, close double"),
        "actions": spark.createDataFrame(actions, "id long, code string, action_type string, announced_date date, effective_date date, ratio double, cash_amount double, superseded_by long"),
        "securities": spark.createDataFrame([(c, D(2020, 1, 1), None, "common") for c in "abcd"], "code string, listing_date date, delisting_date date, security_type string"),
    }
    return tables.__getitem__


def test_prices_and_returns_of_a_panel_are_those_of_each_date(spark):
    view = views(spark, *made_market(random.Random(7)))
    days = [D(2023, 1, 15) + DAY * 37 * k for k in range(14)]
    names = ["close_price_adjusted", "total_return_trailing_1y"]
    panel = Moment(panel=spark.createDataFrame([(d,) for d in days], "as_of date"))
    got = {(r.as_of, r.code): r for r in fld.from_prices(view, panel, names).collect()}
    seen = 0
    for d in days:
        for r in fld.from_prices(view, Moment(str(d)), names).collect():
            mine = got[d, r.code]
            for n in names:
                seen += r[n] is not None
                assert mine[n] == (None if r[n] is None else pytest.approx(r[n], rel=1e-10, abs=1e-12)), (d, r.code, n)
    assert seen > 50


def test_a_panel_of_every_day_stores_a_bar_once(spark):
    """What the running sums are made of grows with bars, actions and dates, not with their product."""
    view = views(spark, *made_market(random.Random(8)))
    points = timeline.day_points(view("bars"), timeline.action_days(view("actions")))
    assert points.count() <= view("bars").count() + view("actions").count()
    days = [D(2023, 7, 1) + DAY * k for k in range(365)]
    panel = Moment(panel=spark.createDataFrame([(d,) for d in days], "as_of date"))
    rows = fld.from_prices(view, panel, ["total_return_trailing_1y"])
    assert rows.count() == 4 * 365
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_period_returns_of_a_back_test(spark):
    bars, actions = made_market(random.Random(9))
    view = views(spark, bars, actions)
    days = [D(2023, 1, 1) + DAY * 50 * k for k in range(10)]
    dates = spark.createDataFrame([(d,) for d in days], "as_of date")
    held = dates.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "code string"))
    got = {r.as_of: r.period_return for r in rebalance.period_returns(held, view("bars"), view("actions"), dates).collect()}
    for a, b in zip(days, days[1:]):
        series = adjust.adjusted(view("bars"), view("actions"), str(b)).collect()
        gains = []
        for code in "abc":
            last = lambda day: max((r.d, r.close_adjusted) for r in series if r.code == code and r.d <= day)[1]  # noqa: B023, E731
            if last(a) > 0:
                gains.append(last(b) / last(a) - 1)
        assert got[a] == pytest.approx(sum(gains) / len(gains), rel=1e-10)
    assert set(got) == set(days[:-1])


def test_kept_views_follow_the_files(spark, small, tmp_path):
    """A view is written once, bucketed by code so that windows of a code need no shuffle, and again when files change."""
    import shutil

    folder = str(tmp_path / "sf")
    shutil.copytree(small, folder)
    first = stored.kept_view(spark, folder, "securities")
    assert stored.kept_view(spark, folder, "securities").inputFiles() == first.inputFiles()
    assert first.count() == spark.read.parquet(f"{folder}/supplier.parquet").count()
    by_code = pit.newest(first, ["code"], "listing_date")
    assert "Exchange" not in by_code._jdf.queryExecution().executedPlan().toString()
    some = spark.read.parquet(f"{small}/supplier.parquet").limit(3).toPandas()
    shutil.rmtree(f"{folder}/supplier.parquet") if (tmp_path / "sf" / "supplier.parquet").is_dir() else (tmp_path / "sf" / "supplier.parquet").unlink()
    some.to_parquet(f"{folder}/supplier.parquet")
    assert stored.kept_view(spark, folder, "securities").count() == 3
    assert first.count() > 3


def test_listed_members_of_a_panel(spark):
    securities = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 3, 1), "common"), ("b", D(2024, 2, 1), None, "common"), ("c", D(2024, 1, 1), None, "etf")], "code string, listing_date date, delisting_date date, security_type string")
    dates = spark.createDataFrame([(D(2024, m, 1),) for m in (1, 2, 3)], "as_of date")
    rows = rebalance.universe(securities, dates).orderBy("as_of", "code").collect()
    assert [(r.as_of.month, r.code) for r in rows] == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
