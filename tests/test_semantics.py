"""Golden cases and edges of the operators, on literal frames."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formulas, words
from tidemark.functions import records as rec
from tidemark.operators import adjust, pit
from tidemark.plans import factors, screen
from tidemark.plans.fields import quarterly_series
from tidemark.sources import loads, records
from tidemark.streaming.loads import append_stream

D = datetime.date


def test_running_totals_become_quarters(spark):
    ytd = [("2023Q1", 206), ("2023Q2", 228), ("2023Q3", 810), ("2023Q4", 2131), ("2024Q1", 975)]
    rows = [(k, "000001", "basic_eps", int(p[:4]), int(p[5]), p, D(2023 + k // 4, 1 + 3 * (k % 4), 20) if k < 4 else D(2024, 5, 1), x, None) for k, (p, x) in enumerate(ytd)]
    facts = spark.createDataFrame(rows, "id long, code string, account string, fy int, fq int, period string, effective_date date, value int, superseded_by long")
    assert [[int(x) for x in r.series] for r in quarterly_series(facts, "2024-06-30").collect()] == [[975, 1321, 582, 22]]
    gap = facts.where("period <> '2023Q3'")
    assert [r.series for r in quarterly_series(gap, "2024-06-30").collect()] == [None]


def test_a_correction_counts_once_it_is_visible(spark):
    facts = spark.createDataFrame([(1, D(2024, 1, 1), 2), (2, D(2024, 3, 1), None), (3, D(2024, 1, 5), 9)], "id long, effective_date date, superseded_by long")
    ids = lambda day: sorted(r.id for r in pit.active(facts, day).collect())
    assert ids("2024-02-29") == [1, 3] and ids("2024-03-01") == [2, 3] and ids("2023-01-01") == []


def test_chain_defects(spark):
    rows = [(k, k + 1 if k < 150 else None) for k in range(151)] + [(1000, 1001), (1001, 1000)]
    bad = {r.id for r in pit.chain_defects(spark.createDataFrame(rows, "id long, superseded_by long")).collect()}
    assert bad == {*range(50), 1000, 1001}


BARS = "code string, d date, open double, high double, low double, close double, volume long"
ACTS = "id long, code string, action_type string, announced_date date, effective_date date, ratio double, cash_amount double, superseded_by long"


def test_actions_of_a_day_multiply_and_spare_its_bar(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, k), 100.0, 100.0, 100.0, 100.0, 1) for k in (1, 2, 3)], BARS)
    acts = spark.createDataFrame([(1, "a", "split", D(2024, 1, 1), D(2024, 1, 2), 2.0, None, None), (2, "a", "bonus_issue", D(2024, 1, 1), D(2024, 1, 2), 1.0, None, None), (3, "a", "split", D(2024, 1, 1), D(2024, 1, 9), 2.0, None, None)], ACTS)
    closes = {r.d.day: r.close_adjusted for r in adjust.adjusted(bars, acts, "2024-01-05").collect()}
    assert closes == {1: 25.0, 2: 100.0, 3: 100.0}


def test_total_return_brings_dividends_to_adjusted_terms(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, k), x, x, x, x, 1) for k, x in ((1, 100.0), (2, 100.0), (3, 50.0))], BARS)
    acts = spark.createDataFrame([(1, "a", "split", D(2024, 1, 1), D(2024, 1, 3), 2.0, None, None), (2, "a", "cash_dividend", D(2024, 1, 1), D(2024, 1, 2), None, 10.0, None)], ACTS)
    series = adjust.adjusted(bars, acts, "2024-01-05")
    index = {r.d.day: round(r["index"], 9) for r in adjust.total_return(series, pit.dividends(acts, "2024-01-05")).collect()}
    assert index == {1: 1.0, 2: 1.1, 3: 1.1}


def test_formula_reasons_and_ties(spark):
    rows = spark.createDataFrame([("a", "common", 1.0, 0.0), ("b", "common", 2.0, 4.0), ("c", "common", 2.0, None), ("d", "etf", 7.0, 1.0)], "code string, security_type string, x double, y double")
    trees = {"q": {"op": "div", "left": {"field": "x"}, "right": {"field": "y"}}, "p": {"op": "percentile", "field": "x"}, "z": {"op": "zscore", "field": "x"}, "r": {"op": "ratio_pct", "left": {"field": "x"}, "right": {"const": "4"}}}
    out = {r.code: r for r in formulas.with_factors(rows, trees).collect()}
    assert (out["a"].q_reason, out["b"].q, out["c"].q_reason) == ("division_by_zero", 0.5, "missing_input:y")
    assert (out["b"].p, out["c"].p) == (100.0, 100.0) and out["a"].p == pytest.approx(100 / 3)
    assert out["d"].z is None and out["d"].z_reason == "universe_distribution_na:zscore:x" and out["a"].r == 0.25
    assert all((r[n] is None) == (r[f"{n}_reason"] is not None) for r in out.values() for n in trees)


def test_defects_of_trees():
    fields = {"x"}
    bad = lambda t: formulas.defects(t, fields)
    assert bad({"field": "x"}) == [] and bad({"field": "y"}) == ["undeclared_field:y"] and bad({"const": True}) == ["bad_const"]
    assert bad({"op": "rank", "field": "x"}) == ["unknown_op:rank"] and bad({"op": "add", "left": {"field": "x"}}) == ["wrong_shape:add"]
    assert bad({"op": "weighted_sum", "args": [{"field": "x"}], "weights": []}) == ["weights_length"]
    deep = {"field": "x"}
    for _ in range(40):
        deep = {"op": "avg", "args": [deep]}
    assert bad(deep) == ["too_deep"]
    with pytest.raises(ValueError, match="cycle"):
        factors.plan(["a"], {"a": {"field": "b"}, "b": {"field": "a"}})


def test_tax_of_the_first_day_of_a_rate(spark):
    rates = spark.createDataFrame([("M", D(2020, 1, 1), 0.003), ("M", D(2023, 1, 1), 0.002)], "market string, effective_from date, rate double").withColumn("rate", F.col("rate").cast("decimal(6,4)"))
    trades = spark.createDataFrame([(1, "M", D(2022, 12, 31), 1500), (2, "M", D(2023, 1, 1), 1250), (3, "M", D(2019, 1, 1), 1), (4, "X", D(2023, 1, 1), 1)], "id long, market string, trade_date date, amount long").withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    tax = {r.id: r.tax and float(r.tax) for r in screen.transaction_tax(trades, rates).collect()}
    assert tax == {1: 5.0, 2: 3.0, 3: None, 4: None}  # 4.5 and 2.5 round up


def test_positions(spark):
    trades = [(1, "a", D(2024, 1, 1), 1, "buy", 10, 100.0, 0.0), (2, "a", D(2024, 1, 2), 1, "buy", 10, 200.0, 0.0), (3, "a", D(2024, 1, 3), 1, "sell", 5, 180.0, 1.0), (4, "a", D(2024, 1, 4), 1, "sell", 50, 1.0, 0.0)]
    rows = screen.positions(spark.createDataFrame(trades, "id long, code string, trade_date date, user_id long, side string, quantity long, unit_price double, fee double")).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 15, 150.0, 149.0, 1)]


def test_restatement_keeps_missing_accounts(spark):
    old = spark.createDataFrame([(1, "a", "x", 7), (2, "a", "y", 7), (3, "b", "x", 8)], "id long, code string, account string, receipt long")
    new = spark.createDataFrame([(9, "a", "x", 70), (10, "a", "z", 70), (11, "b", "x", 8)], "id long, code string, account string, receipt long")
    out = {(r.code, r.account): r.action for r in loads.restatements(old, new, ["code", "account"]).collect()}
    assert out == {("a", "x"): "supersede", ("a", "y"): "keep", ("a", "z"): "insert", ("b", "x"): "noop"}


def test_uuid5_and_hash(spark):
    names = ["lineage:000001", "lineage:000002", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", records.uuid5(records.OID, F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names}
    row = spark.range(1).select(rec.canonical(z=F.lit("1000000"), a=F.array(F.lit("-1.5"), F.lit("0.001")), b=F.lit("0.5")).alias("j")).first()
    assert row.j == '{"a":["-1.5","0.001"],"b":"0.5","z":"1000000"}'


def test_stream_appends_what_a_batch_would(spark, tmp_path):
    schema, landed, target = "code string, d date, close double", str(tmp_path / "landed"), str(tmp_path / "target")
    for day in (1, 2, 2):
        spark.createDataFrame([("a", D(2024, 1, day), 1.0 * day), ("b", D(2024, 1, day), 2.0)], schema).coalesce(1).write.mode("append").parquet(landed)
        append_stream(spark, landed, schema, target, str(tmp_path / "marks"), ["code", "d"])
    rows = sorted((r.code, r.d.day) for r in spark.read.parquet(target).collect())
    assert rows == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_stream_reads_only_its_days(spark, tmp_path):
    schema, landed, target = "code string, d date, close double", str(tmp_path / "landed"), str(tmp_path / "target")
    for day in (1, 2, 2, 3):
        spark.createDataFrame([("a", D(2024, 1, day), 1.0 * day), ("a", D(2024, 1, day), 9.0), ("b", D(2024, 1, day), 2.0)], schema).coalesce(1).write.mode("append").parquet(landed)
        append_stream(spark, landed, schema, target, str(tmp_path / "marks"), ["code", "d"], by="d")
    rows = sorted((r.code, r.d.day, r.close) for r in spark.read.parquet(target).collect())
    assert rows == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 2.0), ("b", 2, 2.0), ("b", 3, 2.0)]
    assert {p.name for p in (tmp_path / "target").iterdir() if p.is_dir()} == {"d=2024-01-01", "d=2024-01-02", "d=2024-01-03"}


def test_words_and_allowed_phrases(spark):
    scan = words.Scanner()
    at = lambda text: [(h["canonical"], h["index"]) for h in scan(text)]
    assert at("Strong buy or sell") == [("Strong Buy", 0), ("Sell", 14)] and at("buyer, buyout, Best Practice") == []
    assert at("종목 추천을 제공 추천") == [("추천", 10)] and at("강력 매수") == [("강력 매수", 0)] and at("매수자와 매수") == [("매수", 5)]
    assert at("ｂｕｙ　now") == [("Buy", 0)] and at("") == [] and scan(None) == []
    assert [h["kind"] for h in words.Scanner(sentiment=True)("호재")] == ["ko_sentiment"] and at("호재") == []
    deep = "[" * 80 + '"buy"' + "]" * 80
    rows = spark.createDataFrame([(1, deep), (2, '{"a": ["Sell", {"name": "Buy"}], "n": 1}'), (3, "{"), (4, None)], "id long, payload string")
    assert sorted((r.id, r.kind) for r in words.scanned_payloads(rows, "id", frozenset({"name"})).collect()) == [(1, "too_deep"), (2, "en_absolute"), (3, "no_json")]


def test_positions_follow_later_splits(spark):
    trades = [(1, "a", D(2024, 1, 1), 1, "buy", 11, 100.0, 0.0), (2, "b", D(2024, 1, 1), 1, "buy", 10, 50.0, 0.0)]
    acts = [(1, "a", "split", D(2024, 1, 5), D(2024, 1, 9), 2.0, None, None), (2, "a", "reverse_split", D(2024, 1, 5), D(2024, 1, 12), 5.0, None, None), (3, "b", "merger", D(2024, 1, 5), D(2024, 1, 9), None, None, None), (4, "b", "split", D(2023, 1, 1), D(2023, 12, 1), 2.0, None, None)]
    rows = screen.positions(spark.createDataFrame(trades, "id long, code string, trade_date date, user_id long, side string, quantity long, unit_price double, fee double"), spark.createDataFrame(acts, ACTS), "2024-02-01").collect()
    assert {(r.code, r.quantity, r.average_cost, r.noticed) for r in rows} == {("a", 4, 275.0, 0), ("b", 10, 50.0, 1)}


def test_loads_keep_one_row_of_a_key(spark):
    stored = spark.createDataFrame([("a", 1, 1.0)], "code string, d int, x double")
    new = spark.createDataFrame([("a", 1, 3.0), ("a", 1, 2.0), ("b", 1, 5.0), ("b", 1, 4.0)], "code string, d int, x double")
    assert sorted(map(tuple, loads.upserted(stored, new, ["code", "d"]).collect())) == [("a", 1, 2.0), ("b", 1, 4.0)]
    assert sorted(map(tuple, loads.appended(stored, new, ["code", "d"]).collect())) == [("b", 1, 4.0)]


def test_chains_by_group_and_by_joins_agree(spark):
    rows = [(k, k + 1 if k < 150 else None, "x") for k in range(151)] + [(1000, 1001, "y"), (1001, 1000, "y"), (2000, 2001, "z"), (2001, None, "z")]
    facts = spark.createDataFrame(rows, "id long, superseded_by long, code string")
    assert {r.id for r in pit.chain_defects(facts, keys=("code",)).collect()} == {*range(50), 1000, 1001}


def test_facts_without_a_successor_are_dealt_to_all_tasks(spark):
    """Most facts have none: they must not meet in one task of the join that looks for successors."""
    rows = [(k, k + 1 if k % 10 == 0 else None, datetime.date(2024, 1, 1 + k % 10)) for k in range(2000)] + [(None, None, datetime.date(2024, 1, 1))]
    facts = spark.createDataFrame(rows, "id long, superseded_by long, effective_date date")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, x in zip(before, ("-1", "false")):
        spark.conf.set(k, x)
    try:
        got = pit.active(facts, "2024-01-05").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    date = {r[0]: r[2] for r in rows}
    asked = datetime.date(2024, 1, 5)
    assert sorted(str(r.id) for r in got) == sorted(str(i) for i, n, d in rows if d <= asked and (n is None or date[n] > asked))
    tasks = [r.task for r in got]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 2
