"""Steps that once grew faster than their input."""

import re
import time

from pyspark.sql import functions as F

from tidemark import catalogue, catalogue_loads, catalogue_market, catalogue_plans, catalogue_runs, views  # noqa: F401
from tidemark.functions import words
from tidemark.operators import pit
from tidemark.plans import screen
from tidemark.sources import loads, stored
from tidemark.views import SPARK_VIEWS, VIEWS, fill, spark_texts, spark_view, table_name


def test_facts_meet_their_batch_by_a_key(spark, small):
    """Facts and batches are joined on the batch's place, never pair by pair; the rows are those of the common text."""
    for name in ("loaded_statements", "loaded_bars"):
        own = spark_view(spark, small, name)
        loops = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if ("NestedLoopJoin" in x or "CartesianProduct" in x) and "place" in x]
        assert not loops(own)
        texts = {v: VIEWS[v] for v in spark_texts(name)}
        places = {t: table_name(spark, small, t) for t in ("lineitem", "orders", "events")}
        common = spark.sql("WITH " + ", ".join(f"{v} AS ({fill(x, places, 6, '/')})" for v, x in texts.items()) + f" SELECT * FROM {name}")
        assert loops(common)  # what there was before
        assert own.columns == common.columns and own.count() == common.count() > 0
        assert own.exceptAll(common).isEmpty()
    assert set(SPARK_VIEWS) <= set(VIEWS)


def test_positions_are_of_all_trades(spark, small):
    """Every trade is part of a position: the table's users have those of all their trades, not of the early ones only."""
    rows = catalogue.QUERIES["q_positions"](spark, small).where("user_id < 20")
    trades, actions = (spark_view(spark, small, name) for name in ("trades", "actions"))
    assert trades.where("trade_date >= DATE '1998-12-01'").count() > 0
    whole = screen.positions(trades, actions, catalogue.AS_OF)
    whole = whole.withColumns({c: F.round(c, 2) for c in ("average_cost", "realised")}).select(rows.columns)
    assert sorted(rows.collect(), key=repr) == sorted(whole.collect(), key=repr)


def test_a_long_chain_is_not_searched_at_each_hop(spark):
    """Places of successors are found once for each fact: a walk's hops look up an array, not a map of the group."""
    rows = [(k, 1, k + 1) for k in range(700)] + [(k, 2, k + 1 if k < 1099 else 1000) for k in range(1000, 1100)] + [(k, 3, k + 1) for k in range(2000, 2100)]
    facts = spark.createDataFrame([*rows, (700, 1, None), (2100, 3, None)], "id long, block int, superseded_by long")
    bad = pit.chain_defects(facts, keys=("block",))
    assert {(r.id, r.hops) for r in bad.collect()} == {(k, 101) for k in (*range(600), *range(1000, 1100))}
    assert "element_at" not in bad._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_grow_with_the_tables(spark, small, tmp_path, monkeypatch):
    """A task's share of kept facts does not grow with the tables, and views of a folder still meet without a shuffle."""
    import shutil

    folder = str(tmp_path / "sf")
    shutil.copytree(small, folder)
    monkeypatch.setattr(stored, "BUCKET_BYTES", 5_000)
    n = stored.bucket_count(spark, folder)
    assert n > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = stored.kept_view(spark, folder, "bars").groupBy("code").count().join(stored.kept_view(spark, folder, "securities"), "code")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and both.rdd.getNumPartitions() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_allowed_phrases_are_not_searched_in_the_whole_text():
    """A word is compared with the phrases that hold it, where it stands: a hit costs no pass of its text for each phrase."""
    scan, plain = words.Scanner(), "lorem ipsum dolor sit amet " * 40_000

    def least(text):
        took = []
        for _ in range(3):
            began = time.process_time()
            scan(text)
            took.append(time.process_time() - began)
        return min(took)

    assert least(plain + "매수") < 2.5 * least(plain + "매")
    for text in ("매수/매도 x 매수", "Long-term LONG-TERM", "매수", "term Long-", "추천하지 않 추천하지", "a short-circuit, short", "이베스트 베스트셀러 베스트", "Best Best Practice"):
        spans = [(m.start(), m.start() + len(p)) for p in words.ALLOWED for m in re.finditer(f"(?={re.escape(p)})", text)]
        found = [(m.start(), m.end()) for _, pattern in scan.parts for m in pattern.finditer(text)]
        assert [h["index"] for h in scan(text)] == sorted(a for a, b in found if not any(x <= a and b <= y for x, y in spans))


def test_trades_are_dealt_out_by_their_size(spark, small, monkeypatch):
    """Bars are grouped in partitions that follow from the size of the tables, and that are not merged; the rows are those of the common text."""
    monkeypatch.setattr(views, "PART_BYTES", 5_000)
    n = -(-views.facts_bytes(spark, small) // 5_000)
    assert n > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bars = spark_view(spark, small, "bars")
    common = spark.sql(fill(VIEWS["bars"], {"lineitem": table_name(spark, small, "lineitem")}, 6, "/"))
    assert bars.columns == common.columns and bars.count() == common.count() > 0 and bars.exceptAll(common).isEmpty()
    for rows in (bars, bars.groupBy("code", "d").count()):
        assert rows.rdd.getNumPartitions() == n  # it was that of shuffles at most
    early = bars.where("d <= DATE '1998-12-31'")._jdf.queryExecution().optimizedPlan().toString()
    assert early.index("RepartitionByExpression") < early.index("Filter")  # days are left out before trades are sent


def test_a_backfill_deals_codes_out_by_the_tables_size(spark, small, monkeypatch):
    """Bars meet windows in partitions that follow from the size of the tables; the counts are those of plain Python."""
    monkeypatch.setattr(views, "PART_BYTES", 5_000)
    n = -(-views.facts_bytes(spark, small) // 5_000)
    rows = catalogue.QUERIES["load_survivorship_backfill"](spark, small)
    by_code = re.findall(r"Exchange hashpartitioning\(code#\d+, (\d+)\)", rows._jdf.queryExecution().executedPlan().toString())
    assert by_code and set(by_code) == {str(n)}
    spans = [("a", "x", 1, 5), ("a", "y", 2, 3), ("b", "x", 4, 9), ("c", "z", 1, 2)]
    raw, old = [("x", d) for d in (1, 4, 5, 8)] + [("y", 7), (None, 3)], [("x", 4), ("y", 7), ("w", 1)]
    inside = {s: [b for b in raw if b[0] == s[1] and s[2] <= b[1] <= s[3]] for s in spans}
    day = lambda rows, *names: rows.withColumns({c: F.expr(f"DATE '2024-01-01' + {c}") for c in names})
    counts = loads.backfill(day(spark.createDataFrame(spans, "id string, code string, start int, stop int"), "start", "stop"), day(spark.createDataFrame(raw, "code string, d int"), "d"), day(spark.createDataFrame(old, "code string, d int"), "d"))
    total = lambda id, f: sum(f(inside[s]) for s in spans if s[0] == id)
    want = {(i, total(i, lambda bs: sum(b not in old for b in bs)), total(i, lambda bs: sum(b in old for b in bs)), total(i, lambda bs: not bs)) for i in "abc"}
    assert {tuple(r) for r in counts.collect()} == want
