"""Queries on saved runs, packs of definitions, word checks and further raw sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.catalogue import AS_OF, FACTS, query
from tidemark.catalogue_market import D
from tidemark.catalogue_plans import CONDITIONS, START, VIEWS, dates
from tidemark.functions import formulas, words
from tidemark.functions import records as rec
from tidemark.operators import pit
from tidemark.operators import trading_calendar as cal
from tidemark.plans import factors, packs, rebalance, reproduce
from tidemark.sources import loads, records


# ---- further raw sources ----------------------------------------------------------------------------------------


@query("src_recent_quarter", """SELECT d, CAST(max(q) // 4 AS INTEGER) AS fy, CAST(max(q) % 4 + 1 AS INTEGER) AS fq FROM (SELECT d, year(d) * 4 + quarter(d) - 1 - unnest(range(8)) AS q FROM (SELECT DISTINCT d FROM order_days) o) x
 WHERE last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) + CAST(CASE q % 4 WHEN 3 THEN 90 ELSE 45 END AS INTEGER) <= d GROUP BY d""")
def _(v):
    found = records.recent_quarter(F.col("d"))
    return v("order_days").select("d").distinct().withColumn("q", found).select("d", "q.fy", F.col("q.fq").cast("int").alias("fq"))


VIEWS["raw_treasury"] = """SELECT l_orderkey AS report, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS line, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN '보통주' WHEN 1 THEN ' 합계 ' WHEN 2 THEN '우선주' WHEN 3 THEN '보통주' ELSE '기타' END AS se,
 CASE l_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '-5' WHEN 3 THEN '1.5' ELSE concat('1,', CAST(100 + l_partkey % 900 AS STRING)) END AS tesstk_co, CAST(l_suppkey AS STRING) AS istc_totqy,
 CASE WHEN l_orderkey % 3 = 0 THEN '' WHEN l_linenumber = 1 THEN '' ELSE concat('r', CAST(l_linenumber AS STRING)) END AS rcept_no FROM {lineitem}"""


@query("src_treasury", """SELECT r.report, CASE WHEN regexp_full_match(replace(tesstk_co, ',', ''), '[0-9]+') THEN CAST(replace(tesstk_co, ',', '') AS BIGINT) END AS treasury, CAST(istc_totqy AS BIGINT) AS issued, coalesce(receipt, concat('report:', CAST(r.report AS VARCHAR))) AS receipt
 FROM (SELECT report, min_by(rcept_no, line) FILTER (rcept_no <> '') AS receipt FROM raw_treasury GROUP BY report) r
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE trim(se) WHEN '보통주' THEN 0 ELSE 1 END, line DESC) AS n FROM raw_treasury WHERE trim(se) IN ('보통주', '합계')) c WHERE n = 1) x ON x.report = r.report""")
def _(v):
    return records.treasury(v("raw_treasury"))


VIEWS["raw_kosis"] = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'M' WHEN 2 THEN 'Q' WHEN 3 THEN 'H' WHEN 4 THEN 'Y' ELSE 'S' END AS cycle,
 concat(CASE WHEN event_id % 50 = 7 THEN '1850' ELSE CAST(year(ts) AS STRING) END, CASE event_id % 6 WHEN 0 THEN '0315' WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN '13' ELSE '07' END WHEN 2 THEN concat('0', CAST(1 + event_id % 5 AS STRING)) WHEN 3 THEN CASE WHEN event_id % 2 = 1 THEN 'H2' ELSE '02' END WHEN 4 THEN '' ELSE '01' END) AS period,
 CASE WHEN event_id % 9 = 0 THEN '-' ELSE concat('1,', CAST(100 + event_id % 900 AS STRING)) END AS amount FROM {events}"""


@query("src_macro_kosis", """SELECT id, reference_date, CASE WHEN amount <> '-' THEN CAST(replace(amount, ',', '') AS DECIMAL(38,4)) END AS value FROM (SELECT id, amount, CASE WHEN CAST(substr(period, 1, 4) AS INTEGER) BETWEEN 1900 AND 2100 THEN CASE
 WHEN cycle = 'D' THEN CAST(strptime(period, '%Y%m%d') AS DATE) WHEN cycle = 'Y' THEN make_date(CAST(period AS INTEGER), 1, 1) WHEN cycle = 'M' AND substr(period, 5) <> '13' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), 7, 1)
 WHEN cycle = 'Q' AND substr(period, 5) <> '05' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(substr(period, 6, 1) AS INTEGER) * 3 - 2, 1) WHEN cycle = 'H' AND substr(period, 5) = '02' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), 7, 1) END END AS reference_date FROM raw_kosis) x""")
def _(v):
    date = records.period_start_digits(F.col("period"), F.col("cycle"))
    return v("raw_kosis").select("id", date.alias("reference_date"), records.amount(F.col("amount")).alias("value"))


VIEWS["raw_dividends"] = """SELECT o_orderkey AS id, lpad(CAST(o_custkey AS STRING), 6, '0') AS code, CASE WHEN o_orderkey % 7 = 0 THEN '우선주' ELSE '보통주' END AS kind,
 CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'x' WHEN 3 THEN '0' WHEN 4 THEN '-12' ELSE concat('1,', CAST(100 + o_orderkey % 900 AS STRING), '.50') END AS amount,
 CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '20300101' ELSE replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') END AS record_date,
 CASE WHEN o_orderkey % 19 = 0 THEN '19900101' WHEN o_orderkey % 5 = 0 THEN '' ELSE replace(CAST(CAST(o_orderdate AS DATE) + 30 AS STRING), '-', '') END AS pay_date FROM {orders}"""


@query("src_dividends", """SELECT id, code, status, CASE WHEN status = 'kept' THEN x.cash END AS cash_amount, CASE WHEN status = 'kept' THEN ex END AS effective_date, CASE WHEN status = 'kept' THEN paid END AS payment_date FROM (SELECT *, CASE WHEN kind <> '보통주' THEN 'not_common' WHEN amount IN ('', '-') THEN 'no_amount' WHEN cash IS NULL THEN 'not_a_number' WHEN cash = 0 THEN 'zero'
 WHEN cash < 0 THEN 'negative' WHEN record_date = '' THEN 'no_record_date' WHEN ex IS NULL THEN 'data_gap' WHEN paid < ex THEN 'paid_before_ex_date' ELSE 'kept' END AS status FROM (
 SELECT r.*, TRY_CAST(replace(amount, ',', '') AS DECIMAL(20,8)) AS cash, CASE WHEN pay_date <> '' THEN CAST(strptime(pay_date, '%Y%m%d') AS DATE) END AS paid, g.previous AS ex FROM raw_dividends r
 LEFT JOIN (SELECT d, max(c.day) AS previous FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d FROM calendar) s LEFT JOIN calendar c ON c.day < s.d GROUP BY d) g ON r.record_date = strftime(g.d, '%Y%m%d')) a) x""")
def _(v):
    return records.dividends(v("raw_dividends"), cal.all_days(v("calendar")))


VIEWS["raw_corps"] = """SELECT p_partkey AS place, CASE WHEN p_partkey % 23 = 0 THEN 'bad' ELSE lpad(CAST((p_partkey * 7) % 500 + CAST(floor(p_partkey / 40) AS BIGINT) * 20 AS STRING), 8, '0') END AS corp_code,
 CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 29 = 0 THEN '12A456' ELSE lpad(CAST((p_partkey * 11) % 600 + CAST(floor(p_partkey / 30) AS BIGINT) * 20 AS STRING), 6, '0') END AS stock_code FROM {part}"""


@query("src_corp_map", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM raw_corps WHERE regexp_full_match(trim(stock_code), '[0-9]{6}') AND regexp_full_match(trim(corp_code), '[0-9]{8}')),
 walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS s, CAST([] AS VARCHAR[]) AS c, CAST('' AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS place UNION ALL
 SELECT o.n, CASE WHEN list_contains(w.s, o.stock_code) OR list_contains(w.c, o.corp_code) THEN w.s ELSE list_append(w.s, o.stock_code) END, CASE WHEN list_contains(w.s, o.stock_code) OR list_contains(w.c, o.corp_code) THEN w.c ELSE list_append(w.c, o.corp_code) END,
 CASE WHEN list_contains(w.s, o.stock_code) THEN 'duplicate_stock' WHEN list_contains(w.c, o.corp_code) THEN 'duplicate_corp' ELSE 'mapped' END, o.place FROM walk w JOIN o ON o.n = w.n + 1)
 SELECT place, status FROM walk WHERE n > 0 UNION ALL SELECT place, CASE WHEN trim(stock_code) = '' THEN 'unlisted' ELSE 'bad_format' END FROM raw_corps WHERE NOT (regexp_full_match(trim(stock_code), '[0-9]{6}') AND regexp_full_match(trim(corp_code), '[0-9]{8}'))""")
def _(v):
    return records.code_map(v("raw_corps")).select("place", "status")


VIEWS["delisted_windows"] = """SELECT id, code, start, least(stop, delisting_date) AS stop FROM (SELECT id, lpad(CAST(id + 500 AS STRING), 6, '0') AS code, listing_date AS start, listing_date + 300 AS stop, delisting_date FROM securities
 UNION ALL SELECT id, code, listing_date + 301, delisting_date, delisting_date FROM securities) x WHERE delisting_date IS NOT NULL AND start <= least(stop, delisting_date)"""


@query("load_survivorship_backfill", """SELECT id, CAST(sum(new) AS BIGINT) AS saved, CAST(sum(old) AS BIGINT) AS skipped, CAST(count(*) FILTER (new + old = 0) AS BIGINT) AS empty FROM (SELECT w.id, w.code, w.start, count(b.d) FILTER (s.d IS NULL) AS new, count(s.d) AS old
 FROM delisted_windows w LEFT JOIN bars b ON b.code = w.code AND b.d BETWEEN w.start AND w.stop LEFT JOIN bars_verify s ON s.code = b.code AND s.d = b.d GROUP BY 1, 2, 3) x GROUP BY id""")
def _(v):
    return loads.backfill(v("delisted_windows"), v("bars"), v("bars_verify"))


@query("pit_latest_nav", f"SELECT code, d, nav FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS n FROM raw_nav WHERE d <= {D}) x WHERE n = 1")
def _(v):
    return pit.latest_nav(v("raw_nav"), AS_OF).select("code", "d", "nav")


# ---- saved runs -------------------------------------------------------------------------------------------------

#: Five runs: one without a cutoff for bars, one whose cutoff is empty, one that names an unknown batch.
VIEWS["runs"] = """SELECT CAST(r.r_regionkey AS BIGINT) AS run, DATE '1997-06-30' + CAST(r.r_regionkey * 180 AS INT) AS as_of, CASE r.r_regionkey WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' ELSE CAST(k.id AS STRING) END AS batch_KRX,
 CASE r.r_regionkey WHEN 3 THEN '999999999999' ELSE CAST(d.id AS STRING) END AS batch_DART FROM {region} r JOIN batch_order k ON k.source = 'KRX' AND k.place = k.of - 7 * r.r_regionkey JOIN batch_order d ON d.source = 'DART' AND d.place = d.of - 11 * r.r_regionkey"""
VIEWS["o_asked"] = """SELECT run, as_of, m.mode, CASE WHEN mode = 0 AND batch_KRX IS NOT NULL THEN coalesce(k.place, 0) END AS cut_KRX, CASE WHEN mode = 0 AND batch_DART IS NOT NULL THEN coalesce(d.place, 0) END AS cut_DART FROM runs r CROSS JOIN (SELECT 0 AS mode UNION ALL SELECT 1) m
 LEFT JOIN batch_order k ON k.source = 'KRX' AND CAST(k.id AS VARCHAR) = r.batch_KRX LEFT JOIN batch_order d ON d.source = 'DART' AND CAST(d.id AS VARCHAR) = r.batch_DART"""
VIEWS["o_seen"] = """SELECT t.run, t.mode, r.* FROM o_asked t JOIN loaded_statements r ON r.account = 'basic_eps' AND r.effective_date <= t.as_of AND (t.cut_DART IS NULL OR r.loaded <= t.cut_DART)
 LEFT JOIN loaded_statements s ON r.superseded_by = s.id AND s.effective_date <= t.as_of AND (t.cut_DART IS NULL OR s.loaded <= t.cut_DART) WHERE s.id IS NULL"""
VIEWS["o_seen8"] = """SELECT *, row_number() OVER (PARTITION BY run, mode, code ORDER BY period DESC) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run, mode, code ORDER BY effective_date DESC, period DESC) AS rk FROM (
 SELECT *, row_number() OVER (PARTITION BY run, mode, code, period ORDER BY effective_date DESC, CAST(id AS VARCHAR) DESC) AS rn FROM o_seen) x WHERE rn = 1) y WHERE rk <= 8"""
VIEWS["o_seen_eps"] = """SELECT a.run, a.mode, a.code FROM o_seen8 a LEFT JOIN o_seen8 b ON a.run = b.run AND a.mode = b.mode AND a.code = b.code AND a.fy = b.fy AND a.fq = b.fq + 1 WHERE a.n <= 4 GROUP BY 1, 2, 3
 HAVING count(CASE WHEN a.fq = 1 THEN a.value ELSE a.value - b.value END) = 4 AND sum(CASE WHEN a.fq = 1 THEN a.value ELSE a.value - b.value END) > 300000"""
VIEWS["o_seen_bar"] = "SELECT t.run, t.mode, b.code, count(*) AS n FROM o_asked t JOIN loaded_bars b ON b.d <= t.as_of AND b.d >= t.as_of - 30 AND (t.cut_KRX IS NULL OR b.loaded <= t.cut_KRX) WHERE b.close > 0 GROUP BY 1, 2, 3"
VIEWS["o_screened"] = """SELECT e.run, e.mode, e.code FROM o_seen_eps e JOIN o_seen_bar b ON e.run = b.run AND e.mode = b.mode AND e.code = b.code JOIN runs r ON r.run = e.run
 JOIN securities s ON s.code = e.code AND s.listing_date <= r.as_of AND (s.delisting_date IS NULL OR s.delisting_date > r.as_of)"""
RUN_TREES = {"eps": factors.BUILT_IN["fac_eps_ttm"], "close": {"field": "close_price_adjusted"}}
RUN_CONDITIONS = [("eps", ">", 300000.0), ("close", ">", 0.0)]


def loaded(v):
    """The views with bars and statements as batches have loaded them."""
    return lambda name: v({"bars": "loaded_bars", "statements": "loaded_statements"}.get(name, name))


@query("rep_reproduce_screen", """SELECT r.run, CAST(count(*) FILTER (x.mode = 1) AS BIGINT) AS stored, CAST(count(*) FILTER (x.mode = 0) AS BIGINT) AS reproduced, CAST(count(*) FILTER (x.mode = 1) - count(*) FILTER (x.both = 2) / 2 AS BIGINT) AS missing,
 CAST(count(*) FILTER (x.mode = 0) - count(*) FILTER (x.both = 2) / 2 AS BIGINT) AS extra, count(*) FILTER (x.both = 1) = 0 AS identical FROM runs r LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY run, code) AS both FROM o_screened) x ON r.run = x.run GROUP BY r.run""", kept=FACTS)
def _(v):
    runs = reproduce.cutoffs(v("runs"), v("batch_order"))
    none = F.lit(None).cast("int")
    # what a run stored: its screen when nothing had yet to be cut off
    both = runs.withColumn("mode", F.lit(0)).unionByName(runs.withColumns({"mode": F.lit(1), "cut_KRX": none, "cut_DART": none}))
    rows = reproduce.screened(loaded(v), both.select("run", "mode", "as_of", "cut_KRX", "cut_DART"), ("run", "mode"), RUN_CONDITIONS, RUN_TREES)
    stored, again = (rows.where(F.col("mode") == m).drop("mode") for m in (1, 0))
    return reproduce.compared(runs, stored, again)


#: A saved back-test: the newest batches that it saw, early enough for its cutoffs to matter.
VIEWS["panel_run"] = """SELECT 1 AS run, CAST(k.id AS STRING) AS batch_KRX, CAST(d.id AS STRING) AS batch_DART FROM batch_order k JOIN batch_order d ON k.source = 'KRX' AND d.source = 'DART' AND k.place = CAST(floor(k.of * 0.9) AS INT) AND d.place = CAST(floor(d.of * 0.7) AS INT)"""
VIEWS["o_panel_cut"] = "SELECT max(place) FILTER (source = 'KRX') AS cut_KRX, max(place) FILTER (source = 'DART') AS cut_DART FROM (SELECT source, place FROM batch_order WHERE place = floor(of * CASE source WHEN 'KRX' THEN 0.9 ELSE 0.7 END)) x"
CUT = {"KRX": "(SELECT cut_KRX FROM o_panel_cut)", "DART": "(SELECT cut_DART FROM o_panel_cut)"}
VIEWS["o_members_cut"] = VIEWS["o_members"].replace("FROM bars b WHERE", f"FROM loaded_bars b WHERE b.loaded <= {CUT['KRX']} AND")
VIEWS["o_known_cut"] = f"""SELECT t.as_of, r.* FROM o_dates t JOIN loaded_statements r ON r.account = 'basic_eps' AND r.effective_date <= t.as_of AND r.loaded <= {CUT['DART']}
 LEFT JOIN loaded_statements s ON r.superseded_by = s.id AND s.effective_date <= t.as_of AND s.loaded <= {CUT['DART']} WHERE s.id IS NULL"""
VIEWS["o_panel8_cut"] = VIEWS["o_panel8"].replace("o_known", "o_known_cut")
VIEWS["o_eps_panel_cut"] = VIEWS["o_eps_panel"].replace("o_panel8", "o_panel8_cut")
VIEWS["o_priced_all"] = "SELECT m.as_of, m.code FROM o_members m JOIN o_eps_panel e ON m.as_of = e.as_of AND m.code = e.code WHERE m.has_price AND e.eps4 > 300000"
VIEWS["o_priced_cut"] = VIEWS["o_priced_all"].replace("o_members", "o_members_cut").replace("o_eps_panel", "o_eps_panel_cut")
for _kind in ("cut", "all"):
    VIEWS[f"o_picks_{_kind}"] = VIEWS["o_picks"].replace("o_held", f"o_priced_{_kind}").replace("JOIN bars b ON", "JOIN loaded_bars b ON" + (f" b.loaded <= {CUT['KRX']} AND" if _kind == "cut" else ""))
    VIEWS[f"o_gain_{_kind}"] = VIEWS["o_gain"].replace("o_picks", f"o_picks_{_kind}")
    VIEWS[f"o_moves_{_kind}"] = VIEWS["o_turnover"].replace("o_held", f"o_priced_{_kind}")
    VIEWS[f"o_curve_{_kind}"] = f"""SELECT as_of, product((1 - cost) * (1 + r)) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT c.as_of, c.sell * (0.0015 + 0.00015) + c.buy * 0.00015 AS cost,
 coalesce(lag(g.period_return) OVER (ORDER BY c.as_of), 0) AS r FROM o_moves_{_kind} c LEFT JOIN o_gain_{_kind} g ON c.as_of = g.as_of) x"""


@query("rep_reproduce_panel", """SELECT a.as_of, round(a.value, 6) AS stored, round(b.value, 6) AS reproduced, round(a.value, 9) = round(b.value, 9) AS identical, TRUE AS same_engine FROM o_curve_all a JOIN o_curve_cut b ON a.as_of = b.as_of""", kept=FACTS)
def _(v):
    cuts = reproduce.cutoffs(v("panel_run"), v("batch_order")).select("cut_KRX", "cut_DART")
    none = cuts.select(*(F.lit(None).cast("int").alias(c) for c in cuts.columns))  # what the run stored: before anything had to be cut off
    curves = [rebalance.backtest(loaded(v), dates(v).crossJoin(F.broadcast(one)), [("eps", ">", 300000.0)], START, RUN_TREES) for one in (none, cuts)]  # one row
    rows = reproduce.curves_compared(*(c.withColumn("value", F.round("value", 9)) for c in curves), F.lit("1.0.0"), reproduce.POLICIES["evaluator_version"])
    return rows.select("as_of", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("stored", "reproduced")), "identical", "same_engine")


@query("rep_batch_versions", """SELECT s.x AS source, coalesce(CAST(b.id AS VARCHAR), '') AS batch_id FROM (SELECT unnest(['KRX', 'DART', 'FSC', 'ECOS']) AS x) s LEFT JOIN (SELECT source, max_by(id, (started_at, id)) AS id FROM batch_runs
 WHERE status IN ('success', 'partial') AND CAST(started_at AS DATE) <= (SELECT CAST(max(ts) AS DATE) - 7 FROM {events}) GROUP BY source) b ON s.x = b.source""")
def _(v):
    runs = v("batch_runs")
    week_before = F.broadcast(runs.agg(F.date_sub(F.max("started_at").cast("date"), 7).alias("as_of")))  # one row
    runs = runs.where(F.col("status").isin("success", "partial")).join(week_before, F.col("started_at").cast("date") <= F.col("as_of"))
    newest = runs.groupBy("source").agg(F.max_by("id", F.struct("started_at", "id")).alias("id"))
    known = v("runs").select(F.explode(F.array(*map(F.lit, ("KRX", "DART", "FSC", "ECOS")))).alias("source")).distinct()
    return known.join(newest, "source", "left").select("source", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("batch_id"))


def batch_map():
    return F.create_map(F.lit("KRX"), F.coalesce("batch_KRX", F.lit("")), F.lit("DART"), F.coalesce("batch_DART", F.lit("")))


POLICY_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS key, '{x}' AS value" for k, x in sorted(reproduce.policy_versions().items()))


@query("rep_policy_versions", f"SELECT run, key, value FROM (SELECT run, 'KRX' AS key, coalesce(batch_KRX, '') AS value FROM runs UNION ALL SELECT run, 'DART', coalesce(batch_DART, '') FROM runs UNION ALL SELECT r.run, p.key, p.value FROM runs r CROSS JOIN ({POLICY_ROWS}) p) x")
def _(v):
    return v("runs").select("run", F.explode(reproduce.with_policies(batch_map())).alias("key", "value"))


@query("rep_version_diff", """SELECT run, key, stored, current FROM (SELECT r.run, 'KRX' AS key, coalesce(r.batch_KRX, '') AS stored, CAST(b.id AS VARCHAR) AS current FROM runs r JOIN batch_order b ON b.source = 'KRX' AND b.place = b.of
 UNION ALL SELECT run, 'DART', coalesce(batch_DART, ''), '' FROM runs UNION ALL SELECT run, 'pit', '', '1.0.0' FROM runs) x WHERE stored <> current""")
def _(v):
    # now: the newest batch of bars, no statements, and a rule that the stored runs did not know
    newest = F.broadcast(v("batch_order").where("source = 'KRX' AND place = of").select(F.col("id").cast("string").alias("krx")))
    stored = v("runs").select("run", batch_map().alias("versions"))
    current = v("runs").crossJoin(newest).select("run", F.create_map(F.lit("KRX"), F.col("krx"), F.lit("pit"), F.lit("1.0.0")).alias("versions"))
    return rec.version_diff(stored, current)


VIEWS["asked_conditions"] = "SELECT l_orderkey AS run, l_linenumber AS place, concat('f', l_returnflag) AS factor, CASE WHEN l_partkey % 2 = 0 THEN '<' ELSE '>=' END AS op, CAST(l_suppkey % 3 AS STRING) AS value FROM {lineitem}"
VIEWS["asked_types"] = "SELECT o_orderkey AS run, CASE o_orderkey % 5 WHEN 0 THEN 'reit' WHEN 1 THEN 'common' ELSE 'etf' END AS security_type FROM {orders} WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'common' FROM {orders} WHERE o_orderkey % 6 = 0"


@query("rep_canonical_query", """SELECT c.run, c.conditions, c.factors, coalesce(t.types, 'common') AS types, c.presentation_order FROM (SELECT run, string_agg(concat(factor, ' ', op, ' ', value), ';' ORDER BY factor, op, value) AS conditions, string_agg(CAST(place AS VARCHAR), ';' ORDER BY factor, op, value) AS presentation_order,
 (SELECT string_agg(f, ';' ORDER BY f) FROM (SELECT DISTINCT unnest(list(factor)) AS f) q) AS factors FROM (SELECT run, factor, op, value, min(place) AS place FROM asked_conditions GROUP BY 1, 2, 3, 4) x GROUP BY run) c
 LEFT JOIN (SELECT run, string_agg(DISTINCT security_type, ';' ORDER BY security_type) AS types FROM asked_types GROUP BY run) t ON c.run = t.run""")
def _(v):
    rows = reproduce.canonical_queries(v("asked_conditions"), v("asked_types"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    return rows.select("run", text("conditions"), text("factors"), text("types"), text("presentation_order"))


VIEWS["saved_codes"] = "SELECT DISTINCT o_custkey AS run, CAST(o_orderkey AS STRING) AS k, max(d) OVER (PARTITION BY o_custkey) AS d FROM order_days"
HASH = """concat('sha256:', sha256(concat('{"as_of":"', CAST(max(d) AS VARCHAR), '","codes":["', string_agg(k, '","' ORDER BY k), '"]}')))"""


@query("rep_verify_runs", f"SELECT a.run FROM (SELECT run, {HASH} AS h FROM saved_codes GROUP BY run) a LEFT JOIN (SELECT run, {HASH} AS h FROM saved_codes WHERE NOT (run % 7 = 0 AND CAST(k AS BIGINT) % 2 = 0) GROUP BY run) b ON a.run = b.run WHERE a.h IS DISTINCT FROM b.h")
def _(v):
    kept = ~((F.col("run") % 7 == 0) & (F.col("k").cast("long") % 2 == 0))
    codes = lambda c: F.array_sort(F.collect_list(c))
    runs = v("saved_codes").groupBy("run").agg(F.max("d").cast("string").alias("as_of"), codes(F.col("k")).alias("codes"), codes(F.when(kept, F.col("k"))).alias("before"))
    # the stored hashes are those of the payloads before some runs got codes added
    runs = runs.withColumn("stored", F.when(F.size("before") > 0, rec.result_hash(as_of=F.col("as_of"), codes=F.col("before"))))
    return reproduce.verified(runs, "stored", rec.result_hash(as_of=F.col("as_of"), codes=F.col("codes"))).select("run")


# ---- packs of definitions ---------------------------------------------------------------------------------------

VIEWS["definitions"] = """SELECT CASE WHEN n = 0 THEN 'builtin' WHEN n % 3 = 0 THEN concat('community/p', CAST(n AS STRING)) WHEN n % 3 = 1 THEN concat('user/p', CAST(n AS STRING)) ELSE concat('@pub/p', CAST(n AS STRING)) END AS pack, place, canonical_id, uuid, md5(definition) AS hash, reads, citation, pack_citation FROM (
 SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS n, p_partkey AS place, concat(CASE WHEN p_partkey % 9 = 0 THEN 'factor:f_' ELSE 'factor:f-' END, CAST(p_size AS STRING)) AS canonical_id, concat('u', CAST((p_partkey * 13) % 400 AS STRING)) AS uuid, concat(p_brand, p_type) AS definition,
 CASE WHEN p_partkey % 5 <> 0 THEN concat('factor_f_', CAST((p_size * 3 + p_partkey % 2) % 50 + 1 AS STRING)) END AS reads, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_name END AS citation,
 CASE WHEN CAST(floor(p_partkey / 100) AS BIGINT) % 2 = 0 THEN 'title' END AS pack_citation FROM {part}) x"""
VIEWS["resolutions"] = """SELECT DISTINCT pack, canonical_id, CASE k % 6 WHEN 0 THEN 'skip' WHEN 1 THEN 'rename' WHEN 2 THEN 'replace' WHEN 3 THEN 'merge' ELSE 'rename' END AS action,
 CASE k % 6 WHEN 1 THEN concat('factor:own-', CAST(k % 4 AS STRING)) WHEN 4 THEN canonical_id WHEN 5 THEN 'factor:f-7' END AS new_id FROM (SELECT pack, canonical_id, CAST(substr(canonical_id, 10, 2) AS INT) AS k FROM definitions) x WHERE k % 7 <> 0"""
TIER = "CASE WHEN pack = 'builtin' THEN 0 WHEN starts_with(pack, 'community/') OR starts_with(pack, '@') THEN 1 ELSE 2 END"
VIEWS["o_known_ids"] = f"SELECT * FROM (SELECT *, {TIER} AS tier, row_number() OVER (PARTITION BY canonical_id ORDER BY {TIER}, pack, place) AS n FROM definitions WHERE {TIER} < 2) x WHERE n = 1"
VIEWS["o_known_uuids"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY {TIER}, pack, place) AS n FROM definitions WHERE {TIER} < 2) x WHERE n = 1"
VIEWS["o_coming"] = f"SELECT * FROM definitions WHERE {TIER} = 2"
VIEWS["o_clashes"] = "SELECT i.pack, i.place, i.canonical_id, i.hash AS incoming_hash, k.hash AS existing_hash, CASE k.tier WHEN 0 THEN 'canonical' ELSE 'community' END AS tier, CASE k.tier WHEN 0 THEN 'skip,rename' ELSE 'skip,rename,replace' END AS allowed FROM o_coming i JOIN o_known_ids k ON i.canonical_id = k.canonical_id WHERE i.hash <> k.hash"


def incoming(v):
    return v("definitions").where(packs.tier(F.col("pack")) == "custom")


def existing(v):
    return v("definitions").where(packs.tier(F.col("pack")) != "custom")


@query("def_duplicates", "SELECT pack, 'canonical_id' AS kind, canonical_id AS value, CAST(count(*) AS BIGINT) AS n FROM definitions GROUP BY pack, canonical_id HAVING count(*) > 1 UNION ALL SELECT pack, 'uuid', uuid, CAST(count(*) AS BIGINT) FROM definitions GROUP BY pack, uuid HAVING count(*) > 1")
def _(v):
    return packs.duplicates(v("definitions"))


@query("def_missing_citation", "SELECT pack, place, canonical_id FROM definitions WHERE trim(coalesce(citation, '')) = '' AND trim(coalesce(pack_citation, '')) = ''")
def _(v):
    return packs.without_citation(v("definitions"))


@query("def_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT pack, replace(replace(canonical_id, ':', '_'), '-', '_') AS name, reads FROM definitions WHERE reads IS NOT NULL), walk AS (SELECT pack, name AS start, reads AS node FROM e UNION SELECT w.pack, w.start, e.reads FROM walk w JOIN e ON e.pack = w.pack AND e.name = w.node)
 SELECT DISTINCT pack, start AS name, 'cycle' AS problem FROM walk WHERE start = node UNION ALL SELECT pack, replace(replace(canonical_id, ':', '_'), '-', '_'), 'collision' FROM definitions GROUP BY 1, 2 HAVING count(DISTINCT canonical_id) > 1""")
def _(v):
    rows = v("definitions")
    return packs.cycles(rows).withColumn("problem", F.lit("cycle")).unionByName(packs.collisions(rows).withColumn("problem", F.lit("collision")))


@query("def_conflicts", "SELECT * FROM o_clashes")
def _(v):
    return packs.conflicts(incoming(v), existing(v))


@query("def_uuid_reuse", "SELECT i.pack, i.place, i.canonical_id, i.uuid, k.canonical_id AS owner FROM o_coming i JOIN o_known_uuids k ON i.uuid = k.uuid WHERE i.canonical_id <> k.canonical_id")
def _(v):
    return packs.uuid_reuse(incoming(v), existing(v))


VIEWS["o_resolved"] = """SELECT i.pack, i.place, i.canonical_id, r.new_id, CASE WHEN c.allowed IS NULL THEN 'kept' WHEN r.action IS NULL THEN 'rejected:unresolved' WHEN r.action NOT IN ('skip', 'rename', 'replace') OR (r.action = 'replace' AND c.tier = 'canonical') THEN 'rejected:not_allowed' WHEN r.action = 'skip' THEN 'skipped' WHEN r.action = 'replace' THEN 'replaced'
 WHEN coalesce(r.new_id, '') = '' OR r.new_id = i.canonical_id THEN 'rejected:bad_name' WHEN r.new_id IN (SELECT canonical_id FROM o_known_ids) THEN 'rejected:clash' ELSE 'renamed' END AS status
 FROM o_coming i LEFT JOIN o_clashes c ON i.pack = c.pack AND i.place = c.place LEFT JOIN resolutions r ON i.pack = r.pack AND i.canonical_id = r.canonical_id"""
VIEWS["o_results"] = "SELECT *, CASE WHEN status IN ('kept', 'replaced') THEN canonical_id WHEN status = 'renamed' THEN new_id END AS result FROM o_resolved"


@query("def_apply_resolutions", """SELECT pack, place, canonical_id, CASE WHEN NOT late THEN result END AS result, CASE WHEN late THEN 'rejected:clash' ELSE status END AS status FROM (SELECT a.*, a.status = 'renamed' AND EXISTS (SELECT 1 FROM o_results b WHERE b.pack = a.pack AND b.result = a.result AND b.place < a.place) AS late FROM o_results a) x""")
def _(v):
    return packs.resolved(incoming(v), existing(v), v("resolutions"))


#: Formulas of all shapes, one for each part.
SHAPES = (
    ({"op": "add", "left": {"field": "x"}, "right": {"const": "1.5"}}, []), ({"op": "rank", "field": "x"}, ["unknown_op:rank"]), ({"op": "add", "left": {"field": "x"}}, ["wrong_shape:add"]), ({"field": "y"}, ["undeclared_field:y"]),
    ({"const": True}, ["bad_const"]), ({"op": "add", "const": 1}, ["op_and_const"]), ({"leaf": 1}, ["bad_leaf"]), ({"op": "avg", "args": [{"field": "y"}, {"const": "a"}]}, ["undeclared_field:y", "bad_const"]), ({"op": "winsorize", "args": [], "lower": "2", "upper": "1"}, ["empty_args:winsorize", "bad_bounds"]),
)
VIEWS["written_formulas"] = "SELECT p_partkey AS id, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{json.dumps(tree)}'" for k, (tree, _) in enumerate(SHAPES)) + " END AS tree FROM {part}"


@query("fx_validate", " UNION ALL ".join(f"SELECT p_partkey AS id, '{d}' AS defect FROM {{part}} WHERE p_partkey % 9 = {k}" for k, (_, found) in enumerate(SHAPES) for d in found))
def _(v):
    return formulas.defects_of(v("written_formulas"), "id", {"x"})


# ---- words ------------------------------------------------------------------------------------------------------

ENDINGS = ("", " 강력 매수 의견", " 매수자 추천종목", " Strong buy, Best Practice", " Hold On, hold", " Ｂｅｓｔ ｂｕｙ", " 추천하지 않 기대값 픽", " buyer Long-term LONG")
#: Words of the endings, in order: kind and canonical form.
ENDING_HITS = ((), (("ko_absolute", "강력 매수"),), (("ko_absolute", "추천종목"),), (("en_absolute", "Strong Buy"),), (("en_absolute", "Hold"),), (("en_absolute", "Best Buy"),), (("ko_absolute", "픽"),), (("en_absolute", "Long"),))
ENDING = "CASE {id} % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(ENDINGS)) + " END"
VIEWS["notices"] = "SELECT doc_id, concat(coalesce(text, ''), " + ENDING.replace("{id}", "doc_id") + ") AS text, CASE doc_id % 5 WHEN 1 THEN 'user_private' WHEN 2 THEN 'external_quote' ELSE 'system' END AS scope FROM {documents}"
#: Hits in the documents' own words (English; counted where no letter, digit or underscore is next to them) and the endings.
OWN_WORDS = "lower(unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}_]', '  ', 'g'), '(?i)(?:^| )(hold|best|buy|sell|long|short|conviction|recommended|recommendation|outperform|underperform|overweight|underweight|bullish|bearish|accumulate|upgrade|downgrade)(?: |$)', 1)))".replace("\\\\", "\\")
VIEWS["o_word_hits"] = f"SELECT doc_id, 'en_absolute' AS kind, concat(upper(substr(w, 1, 1)), substr(w, 2)) AS canonical FROM (SELECT doc_id, {OWN_WORDS} AS w FROM {{documents}}) x UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, '{kind}', '{word}' FROM {{documents}} WHERE doc_id % 8 = {k}" for k, hits in enumerate(ENDING_HITS) for kind, word in hits)


@query("txt_forbidden_scan", "SELECT doc_id, kind, canonical, CAST(count(*) AS BIGINT) AS n FROM o_word_hits GROUP BY doc_id, kind, canonical")
def _(v):
    return words.scanned(v("notices"), "doc_id").groupBy("doc_id", "kind", "canonical").agg(F.count("*").alias("n"))


@query("txt_assert_clean", "SELECT doc_id, doc_id % 5 IN (1, 2) OR doc_id NOT IN (SELECT doc_id FROM o_word_hits) AS clean FROM {documents}")
def _(v):
    bad = words.unclean(v("notices"), "doc_id").withColumn("bad", F.lit(True)).select("doc_id", "bad")
    return v("notices").select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("clean"))


VIEWS["messages"] = "SELECT conv_id, turn, role, concat(coalesce(text, ''), " + ENDING.replace("{id}", "(conv_id + turn)") + ") AS text FROM {conversations}"
VIEWS["o_message_hits"] = f"SELECT conv_id, 'en_absolute' AS kind, concat(upper(substr(w, 1, 1)), substr(w, 2)) AS canonical FROM (SELECT conv_id, {OWN_WORDS} AS w FROM {{conversations}}) x UNION ALL " + " UNION ALL ".join(f"SELECT conv_id, '{kind}', '{word}' FROM {{conversations}} WHERE (conv_id + turn) % 8 = {k}" for k, hits in enumerate(ENDING_HITS) for kind, word in hits)


@query("txt_nested_scan", "SELECT conv_id, kind, canonical, CAST(count(*) AS BIGINT) AS n FROM o_message_hits GROUP BY conv_id, kind, canonical")
def _(v):
    turn = F.struct("role", F.struct("text", F.struct(F.lit("Best Buy").alias("name")).alias("company")).alias("body"), F.array(F.lit(1)).alias("numbers"))
    payloads = v("messages").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(turn).alias("turns"), F.lit("Strong Buy").alias("name"))).alias("payload"))
    rows = words.scanned_payloads(payloads, "conv_id", frozenset({"name"}))
    return rows.groupBy("conv_id", "kind", "canonical").agg(F.count("*").alias("n"))
