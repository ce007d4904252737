"""Stored snapshots, streams of restatements, dense bars, nested texts and the rules of single operators."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue, catalogue_loads, catalogue_market, catalogue_plans, catalogue_runs  # noqa: F401
from tidemark.functions import words
from tidemark.operators import pit
from tidemark.operators import trading_calendar as cal
from tidemark.plans import factors, fields, rebalance, screen, snapshots
from tidemark.sources import loads, records
from tidemark.streaming.loads import restatement_stream

D = datetime.date


def test_a_save_replaces_its_own_partitions_only(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    rows = lambda day, value, codes="ab", v="1": spark.createDataFrame([(c, f, value, "krw", None, {"x": True}, {"KRX": v}, day) for c in codes for f in ("f", "g")], snapshots.SCHEMA)
    assert snapshots.read(spark, folder).count() == 0
    snapshots.save(rows(D(2024, 1, 1), 1.0), folder)
    snapshots.save(rows(D(2024, 1, 2), 2.0), folder)
    files = lambda day: sorted(os.listdir(f"{folder}/as_of={day}"))
    before = files("2024-01-01")
    snapshots.save(rows(D(2024, 1, 2), 3.0, "b", "2").unionByName(rows(D(2024, 1, 2), 3.0, "b", "2")), folder)
    assert files("2024-01-01") == before
    found = {(r.as_of.day, r.code, r.factor): r.value for r in snapshots.read(spark, folder).collect()}
    assert found == {(d, c, f): x for d, c, x in ((1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (2, "b", 3.0)) for f in ("f", "g")}
    one = snapshots.read(spark, folder, "2024-01-02")
    assert "PartitionFilters: [isnotnull(as_of" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.code for r in snapshots.served(one, ["f", "g"], {"KRX": "2"}).collect()] == ["b"]
    assert snapshots.served(one, ["f", "h"], {"KRX": "2"}).count() == 0
    assert snapshots.served(one, ["f", "g"], {"KRX": "2", "DART": "1"}).count() == 0
    assert snapshots.served(one, ["f", "g"], {"KRX": "2"}, never=("g",)).count() == 0


def test_faulty_codes_are_told_and_spare_the_others(spark, small):
    view = lambda name: catalogue.spark_view(spark, small, name)
    bad = lambda name: view(name).unionByName(view("bars").where("code = '000001'").limit(1)) if name == "bars" else view(name)
    rows, rejects = snapshots.computed(bad, catalogue.AS_OF, ["fac_mcap_official", "fac_eps_ttm"], {"KRX": "1"})
    assert [(r.code, r.error) for r in rejects.collect()] == [("000001", "duplicate_bar")]
    codes = {r.code for r in rows.select("code").collect()}
    assert "000001" not in codes and len(codes) > 3
    one = rows.where("factor = 'fac_mcap_official'").first()
    assert one.unit == "krw" and set(one.inputs) == {"shares_issued", "close_price_adjusted"} and one.versions == {"KRX": "1"}


def test_a_snapshot_has_every_factor_of_the_pack(spark, small):
    rows = catalogue.QUERIES["q_snapshot_precompute"](spark, small).where("factor <> 'rejected'")
    factors_of = {r.code: set(r.fs) for r in rows.groupBy("code").agg(F.collect_list("factor").alias("fs"), F.count("unit").alias("n")).where("n = size(fs)").collect()}
    assert len(factors_of) == rows.select("code").distinct().count() > 0
    assert all(fs == set(factors.BUILT_IN) for fs in factors_of.values())


def landed(seed):
    rng = random.Random(seed)
    reports = []
    for code in ("a", "b", "c"):
        for n in range(rng.randrange(2, 6)):
            receipt, day = f"{code}{n}", D(2024, 1, 1) + datetime.timedelta(rng.randrange(20))
            reports.append([(rng.randrange(10**9), code, "2024Q1", account, day, receipt, n) for account in rng.sample(["x", "y", "z"], rng.randrange(1, 4))])
    return reports + [reports[0], [(r[0] + 1, *r[1:4], r[4] + datetime.timedelta(1), *r[5:]) for r in reports[1]]]  # one repeated, one again under other ids


def test_a_stream_of_restatements_is_a_batch_in_any_order(spark, tmp_path):
    schema = "id long, code string, period string, account string, effective_date date, receipt string, n int"
    keys, reports = ["code", "period", "account"], landed(3)
    frame = lambda some: spark.createDataFrame([r for report in some for r in report], schema)
    plain = sorted(map(tuple, loads.chained(frame(reports), keys).collect()))
    assert sum(r[-1] is None for r in plain) == len({r[1:4] for r in plain})  # one head for each account
    for order in (1, 2):
        files = list(reports)
        random.Random(order).shuffle(files)
        place = tmp_path / str(order)
        for k in range(0, len(files), 4):
            for report in files[k : k + 4]:
                frame([report]).coalesce(1).write.mode("append").parquet(f"{place}/landed")
            restatement_stream(spark, f"{place}/landed", schema, f"{place}/chains", f"{place}/progress", keys, parts=4)
        restatement_stream(spark, f"{place}/landed", schema, f"{place}/chains", f"{place}/progress", keys, parts=4)  # nothing new
        found = spark.read.parquet(f"{place}/chains").select(*schema.replace(" long", "").replace(" string", "").replace(" date", "").replace(" int", "").split(", "), "superseded_by")
        assert sorted(map(tuple, found.collect())) == plain


def test_a_batch_rewrites_only_the_parts_of_its_keys(spark, tmp_path):
    schema = "id long, code string, effective_date date, receipt string"
    run = lambda: restatement_stream(spark, f"{tmp_path}/landed", schema, f"{tmp_path}/chains", f"{tmp_path}/progress", ["code"], parts=16)
    spark.createDataFrame([(k, f"c{k}", D(2024, 1, 1), "r") for k in range(40)], schema).write.parquet(f"{tmp_path}/landed")
    run()
    files = lambda: {(d, f) for d, _, names in os.walk(tmp_path / "chains") for f in names if f.endswith(".parquet")}
    before = files()
    spark.createDataFrame([(100, "c3", D(2024, 2, 1), "s")], schema).write.mode("append").parquet(f"{tmp_path}/landed")
    run()
    assert len({d for d, _ in before - files()}) == 1 and len({d for d, _ in before}) > 8
    assert {r.id: r.superseded_by for r in spark.read.parquet(f"{tmp_path}/chains").where("code = 'c3'").collect()} == {3: 100, 100: None}


def test_many_landed_files_are_one_batch(spark, tmp_path):
    """What is stored is taken and written once a run, however many files have landed."""
    schema = "id long, code string, effective_date date, receipt string"
    rows = spark.createDataFrame([(k, f"c{k % 7}", D(2024, 1, 1 + k // 7), "r" + str(k)) for k in range(140)], schema)
    rows.repartition(140, "id").write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/landed")
    assert len([f for f in os.listdir(f"{tmp_path}/landed") if f.endswith(".parquet")]) > 100
    restatement_stream(spark, f"{tmp_path}/landed", schema, f"{tmp_path}/chains", f"{tmp_path}/progress", ["code"], parts=4)
    assert [f for f in os.listdir(f"{tmp_path}/progress/commits") if not f.startswith(".")] == ["0"]
    assert {r.id: r.superseded_by for r in spark.read.parquet(f"{tmp_path}/chains").collect()} == {k: k + 7 if k < 133 else None for k in range(140)}


def test_a_batch_leaves_nothing_beside_the_chains(spark, tmp_path):
    """One shuffle of the versions, whose files go with it, and no table but the chains themselves."""
    schema = "id long, code string, account string, effective_date date, receipt string"
    rows = spark.createDataFrame([(k, f"c{k % 7}", "x", D(2024, 1, 1 + k // 7), "r" + str(k)) for k in range(140)], schema)
    assert loads.chained(rows, ["code", "account"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    shared = spark.conf.get("spark.checkpoint.dir") + "/tidemark"
    kept = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    before = kept()
    for first in (0, 70):
        rows.where(F.col("id").between(first, first + 69)).write.mode("append").parquet(f"{tmp_path}/landed")
        restatement_stream(spark, f"{tmp_path}/landed", schema, f"{tmp_path}/chains", f"{tmp_path}/progress", ["code", "account"], parts=4)
    assert kept() == before
    assert {r.id: r.superseded_by for r in spark.read.parquet(f"{tmp_path}/chains").collect()} == {k: k + 7 if k < 133 else None for k in range(140)}


def test_dense_bars(spark):
    days = [D(2024, 1, k) for k in (1, 2, 3, 4, 5, 8, 9, 10)]  # business days
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "day date, bd_index int")
    bars = [("a", D(2024, 1, 2), 10.0, 100), ("a", D(2024, 1, 4), 11.0, 200), ("a", D(2024, 1, 6), 12.0, 300), ("b", D(2024, 1, 9), 5.0, 7), ("c", D(2024, 1, 11), 1.0, 1)]
    rows = fields.dense_bars(spark.createDataFrame(bars, "code string, d date, close double, trading_value int"), calendar).collect()
    found = {(r.code, r.d.day): (r.close, r.trading_value) for r in rows}
    assert len(rows) == len(found) == 9
    assert {k[1]: x for k, x in found.items() if k[0] == "a"} == {2: (10.0, 100), 3: (10.0, 0), 4: (11.0, 200), 5: (11.0, 0), 8: (12.0, 0), 9: (12.0, 0), 10: (12.0, 0)}
    assert {k[1]: x for k, x in found.items() if k[0] != "a"} == {9: (5.0, 7), 10: (5.0, 0)}
    as_of = lambda day, n: {r.code: r.x for r in fields.trading_value(spark.createDataFrame(bars, "code string, d date, close double, trading_value int"), calendar, day, n, "x").collect()}
    assert as_of("2024-01-04", 1) == {"a": 200.0} and as_of("2024-01-04", 2) == {}


def leaves_by_python(payload, excluded, deepest):
    """(texts, kind) of a JSON text."""
    try:
        ahead, out = [(json.loads(payload), 0)], []
    except ValueError:
        return [], "no_json"
    while ahead:
        node, depth = ahead.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, dict | list):
            if depth == deepest and node:
                return [], "too_deep"
            ahead += [(x, depth + 1) for x in (node if isinstance(node, list) else [x for k, x in node.items() if k not in excluded])]
    return sorted(out), "text"


def test_nested_texts(spark):
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Best Buy", "clean", "추천종목", 1, 2.5, None, True, ""])
        return [made(depth - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {rng.choice("abcd"): made(depth - 1) for _ in range(rng.randrange(4))}

    payloads = [(k, json.dumps(made(7), ensure_ascii=False)) for k in range(60)]
    payloads += [(100, "{not json"), (101, None), (102, '"Strong Buy"'), (103, "[" * 9 + '"Buy"' + "]" * 9), (104, "[" * 6 + '"Buy"' + "]" * 6), (105, "{}"), (106, "")]
    df = spark.createDataFrame(payloads, "id int, payload string")
    found = {}
    for r in words.leaves(df, "id", frozenset("c"), 6).collect():
        found.setdefault(r.id, []).append((r.kind, r.text))
    for k, payload in payloads:
        texts, kind = ([], "text") if payload is None else leaves_by_python(payload, "c", 6)
        want = [("text", t) for t in texts] if kind == "text" else [(kind, None)]
        assert sorted(found.get(k, []), key=repr) == sorted(want, key=repr), (k, payload)
    hits = [(r.id, r.kind, r.canonical) for r in words.scanned_payloads(df.where("id >= 100"), "id", frozenset(), 6).collect()]
    assert sorted(hits) == [(100, "no_json", ""), (102, "en_absolute", "Strong Buy"), (103, "too_deep", ""), (104, "en_absolute", "Buy"), (106, "no_json", "")]


def test_words_within_phrases(spark):
    """A hit is compared with the one phrase that could hold it, in time that does not grow with hits x phrases."""
    scan = words.Scanner()
    assert [h["canonical"] for h in scan("Best Practice, best, Holdings, Hold On, hold, 매수자 매수 추천하지 않")] == ["Best", "Hold", "매수"]
    import time

    text = "Best Practice hold " * 20_000
    began = time.time()
    assert len(scan(text)) == 20_000
    assert time.time() - began < 20


def test_quantiles_round_half_to_even(spark):
    rows = spark.createDataFrame([("a", 0.0000005), ("b", 0.0000005)], "code string, f double")
    r = screen.overview(rows, ["f"]).first()
    assert r["mean"] == 0.0 and r["min"] == 0.0000005 and r["max"] == 0.0000005
    assert screen.overview(spark.createDataFrame([("a", 0.0000015)], "code string, f double"), ["f"]).first()["median"] == 0.000002


def test_compared_codes(spark):
    asked = [(1, 1, "5930"), (1, 2, " 005930 "), (1, 3, "660"), (1, 4, " "), (2, 1, "1"), (2, 2, "000001"), (3, 1, "A1"), (3, 2, "2"), *((4, k, str(k)) for k in range(7)), (5, 1, "1234567"), (5, 2, "1")]
    rows = screen.compared_codes(spark.createDataFrame(asked, "request int, place int, code string")).orderBy("request", "place").collect()
    assert [(r.place, r.code, r.status) for r in rows if r.request == 1] == [(1, "005930", "ok"), (2, "000660", "ok")]
    assert {(r.request, r.status) for r in rows} == {(1, "ok"), (2, "too_few"), (3, "bad_code"), (4, "too_many"), (5, "bad_code")}


def test_prices_and_actions(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, k)) for k in (1, 5, 9)], "code string, d date")
    actions = spark.createDataFrame([(1, "split", D(2024, 1, 1), D(2024, 1, 6), 3), (2, "split", D(2024, 1, 8), D(2024, 1, 6), None), (3, "split", D(2024, 1, 5), D(2024, 1, 6), None), (4, "split", D(2024, 1, 1), D(2024, 1, 20), None)], "id long, action_type string, announced_date date, effective_date date, superseded_by long")
    got, acts = screen.prices(bars, actions, "2024-01-07", 4)
    assert [r.d.day for r in got.collect()] == [5] and [r.id for r in acts.collect()] == [3]
    for days in (0, 3651):
        with pytest.raises(ValueError):
            screen.prices(bars, actions, "2024-01-07", days)


def test_dividends_of_a_feed(spark):
    feed = [(1, "a", D(2024, 1, 1), "x"), (2, "a", D(2024, 1, 1), None), (3, "a", D(2024, 1, 1), ""), (4, "a", D(2024, 1, 1), "x"), (5, "a", None, "x"), (6, "b", D(2024, 1, 1), "x"), (7, "b", D(2024, 1, 2), None)]
    stored = [("b", D(2024, 1, 1), "cash_dividend", "x"), ("b", D(2024, 1, 2), "split", None)]
    rows, counts = loads.new_dividends(spark.createDataFrame(feed, "id int, code string, effective_date date, type string"), spark.createDataFrame(stored, "code string, effective_date date, action_type string, type string"))
    assert sorted(r.id for r in rows.collect()) == [1, 2, 7] and rows.columns == ["id", "code", "effective_date", "type"]
    assert sorted(map(tuple, counts.collect())) == [("a", 2, 2, 1), ("b", 1, 1, 0)]


def test_disclosures_by_citation(spark):
    facts = [(1, "a", "Q1", "CFS", 1, None), (2, "a", "Q1", "CFS", 2, None), (3, "a", "Q1", "OFS", 3, None), (4, "a", "Q2", "CFS", 1, 9), (5, "b", "Q1", "CFS", 1, None), (6, "b", "Q1", "CFS", 3, None)]
    cited = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r3")], "id long, identifier string")
    rows = pit.active_disclosures(spark.createDataFrame(facts, "id long, code string, period string, ifrs_type string, citation_id long, superseded_by long"), cited)
    assert sorted(map(tuple, rows.collect())) == [("a", "Q1", "CFS", 1, "r1", False), ("a", "Q1", "OFS", 1, "r3", False), ("b", "Q1", "CFS", 2, None, True)]


def test_closed_days_have_reasons(spark):
    traded = spark.createDataFrame([(D(2024, 2, 29),), (D(2024, 3, 5),)], "d date")
    rows = {r.day: r.reason for r in cal.closed_days(traded).collect()}
    assert rows == {D(2024, 3, 1): "삼일절", D(2024, 3, 4): cal.OTHERWISE_CLOSED}
    assert cal.closed_days(traded, "2024-02-28", "2024-03-01").count() == 2


def test_macro_rows(spark):
    raw = [(1, "M", "202401", " 1.5 "), (2, "M", "202413", "1"), (3, "Q", "2024Q2", "x"), (4, "A", "2024", None), (5, "A", "1850", "1"), (6, "D", "20240131", "-2"), (7, "M", "202402", "1,5"), (8, "Z", "2024", "1")]
    df = spark.createDataFrame([(*r, D(2024, 5, 1)) for r in raw], "id int, cycle string, period string, value string, observed date")
    assert sorted((r.id, r.reference_date, float(r.value), r.vintage_date) for r in records.macro_rows(df).collect()) == [(1, D(2024, 1, 1), 1.5, D(2024, 5, 1)), (6, D(2024, 1, 31), -2.0, D(2024, 5, 1))]


def test_summaries_of_a_back_test(spark):
    members = spark.createDataFrame([(D(2024, 1, 1), "a", True), (D(2024, 1, 1), "b", False), (D(2024, 2, 1), "a", True)], "as_of date, code string, has_price boolean")
    rows = rebalance.missing_prices(members).orderBy("as_of").collect()
    assert [(r.members, r.missing, r.mean_missing, r.survivorship_complete) for r in rows] == [(2, 0.5, 0.25, False), (1, 0.0, 0.25, False)]
    assert rebalance.missing_prices(members.where("has_price")).first().survivorship_complete
    traded = spark.createDataFrame([(D(2024, 1, 1), 0.0, 1.0), (D(2024, 2, 1), 0.5, 0.5)], "as_of date, sell double, buy double")
    assert {r.turnover for r in rebalance.mean_turnover(traded).collect()} == {0.5}


#: Columns that once had one value in every row, with the least number of values that they must have.
TELLING = {
    "q_screen_from_snapshot": "served", "fld_trading_value_20d": "value", "fac_turnover_20d": "value", "fx_sum_last_n_quarters_7": "value", "pit_active_disclosure": "corrupt", "rep_reproduce_panel": "identical",
    "bt_missing_price": "missing", "q_positions": "noticed", "q_compare": "status", "src_calendar_derive": "reason", "load_dividend_dedup": "gaps",
}


def test_checks_that_could_fail():
    """The oracles' rows at the size of the correctness run have more than one value where a rule decides."""
    import duckdb

    from tidemark.views import TABLES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, column in TELLING.items():
        assert con.execute(f"SELECT count(DISTINCT {column}) FROM ({catalogue.ORACLES[name]}) x").fetchone()[0] >= 2, name


