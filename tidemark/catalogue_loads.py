"""Queries on raw records, loads, reproducibility and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.catalogue import AS_OF, query
from tidemark.catalogue_market import D
from tidemark.functions import records as rec
from tidemark.operators import pit
from tidemark.operators import trading_calendar as cal
from tidemark.sources import loads, records
from tidemark.sources.stored import shared_folder, shuffles_dropped
from tidemark.streaming.loads import restatement_stream
from tidemark.views import VIEWS

VIEWS["raw_bars"] = "SELECT code, d, open, high, low, close, volume, CASE WHEN volume % 7 <> 0 THEN trading_value END AS trading_value FROM bars"
VIEWS["raw_nav"] = "SELECT code, d, close AS nav, CASE WHEN volume % 5 <> 0 THEN open END AS market_price FROM bars"
VIEWS["raw_deviation"] = "SELECT code, d, CAST(0.25 AS DECIMAL(6,4)) AS deviation FROM bars WHERE volume % 3 = 0"
VIEWS["raw_lines"] = """SELECT o_orderkey AS report, CASE o_orderkey % 5 WHEN 0 THEN 'ifrs_Assets' WHEN 1 THEN 'ifrs_Equity' WHEN 2 THEN '' ELSE concat('own_', CAST(o_orderkey % 7 AS STRING)) END AS account_id,
 CASE l_linenumber % 6 WHEN 0 THEN 'BS' WHEN 1 THEN 'IS' WHEN 2 THEN 'CIS' WHEN 3 THEN 'CF' WHEN 4 THEN 'SCE' ELSE 'XX' END AS statement, l_linenumber AS line,
 CASE WHEN l_linenumber = 2 THEN '-' WHEN l_linenumber = 3 THEN '' ELSE concat('1,', CAST(100 + l_linenumber AS STRING), '.50') END AS amount FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
VIEWS["raw_accounts"] = "SELECT 'ifrs_Assets' AS account_id, 'assets' AS canonical FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'ifrs_Equity', 'equity' FROM {region} WHERE r_regionkey = 0"
VIEWS["raw_receipts"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE concat(replace(CAST(CAST(o_orderdate AS DATE) + 3000 AS STRING), '-', ''), '000123') END AS receipt,
 CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q FROM {orders}"""
VIEWS["raw_periods"] = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'M' WHEN 2 THEN 'Q' WHEN 3 THEN 'S' WHEN 4 THEN 'A' ELSE 'M' END AS cycle,
 concat(CAST(year(ts) AS STRING), CASE event_id % 6 WHEN 0 THEN '0315' WHEN 1 THEN '07' WHEN 2 THEN concat('Q', CAST(quarter(ts) AS STRING)) WHEN 3 THEN 'S2' WHEN 4 THEN '' ELSE '13' END) AS period FROM {events}"""
VIEWS["new_report"] = """SELECT id + 1000000000 AS id, code, account, period, CASE WHEN id % 3 = 0 THEN id % 7 ELSE id % 7 + 100 END AS receipt FROM statements WHERE superseded_by IS NULL AND id % 4 <> 1
 UNION ALL SELECT id + 2000000000, code, 'goodwill', period, 5 FROM statements WHERE superseded_by IS NULL AND account = 'equity' AND id % 2 = 0"""


@query("src_ohlcv", "SELECT code, d, close, volume, coalesce(trading_value, CAST(close * volume AS DECIMAL(28,2))) AS trading_value, trading_value IS NULL AS estimated FROM raw_bars")
def _(v):
    return records.ohlcv(v("raw_bars")).select("code", "d", "close", "volume", "trading_value", "estimated")


@query("src_price_facts", "SELECT code, d AS effective_date, open AS open_raw, high AS high_raw, low AS low_raw, close AS close_raw, volume, trading_value, close AS close_adjusted FROM bars")
def _(v):
    return records.price_facts(v("bars"))


VIEWS["raw_caps"] = "SELECT code, replace(CAST(effective_date AS STRING), '-', '') AS day, CASE WHEN shares % 3 = 0 THEN '' ELSE CAST(market_cap AS STRING) END AS cap, CAST(shares AS STRING) AS listed FROM market_caps"


@query("src_market_cap", "SELECT code, effective_date, market_cap, shares, CAST(NULL AS BIGINT) AS shares_treasury FROM market_caps WHERE shares % 3 <> 0")
def _(v):
    return records.market_caps(v("raw_caps"))


@query("src_etf_nav_premium", """SELECT n.code, n.d, n.nav, coalesce(market_price, nav) AS market_price, round(coalesce(CAST(deviation AS DOUBLE), CAST(coalesce(market_price, nav) - nav AS DOUBLE) / nullif(CAST(nav AS DOUBLE), 0), 0), 6) AS premium
 FROM raw_nav n LEFT JOIN raw_deviation x ON n.code = x.code AND n.d = x.d""")
def _(v):
    return records.nav_premium(v("raw_nav"), v("raw_deviation")).withColumn("premium", F.round("premium", 6))


@query("src_statement_json", "SELECT report, line, account_id, statement, CAST(replace(amount, ',', '') AS DECIMAL(38,4)) AS amount, CASE WHEN report % 4 = 0 THEN 'USD' ELSE 'KRW' END AS currency FROM raw_lines WHERE statement <> 'SCE' AND trim(account_id) <> '' AND amount NOT IN ('', '-')")
def _(v):
    given = v("raw_lines").withColumn("currency", F.when(F.col("report") % 4 == 0, "USD").when(F.col("report") % 4 == 1, ""))
    payloads = given.groupBy("report").agg(F.to_json(F.collect_list(F.struct("account_id", "statement", "line", "amount", "currency"))).alias("payload"))
    return records.statement_lines(payloads).select("report", "line", "account_id", "statement", "amount", "currency")


@query("src_statement_counters", """SELECT report, CAST(count(*) FILTER (statement = 'SCE') AS BIGINT) AS unread, CAST(count(*) FILTER (statement <> 'SCE' AND trim(account_id) = '') AS BIGINT) AS no_account,
 CAST(count(*) FILTER (statement <> 'SCE' AND trim(account_id) <> '' AND amount IN ('', '-')) AS BIGINT) AS no_amount, CAST(count(*) FILTER (statement <> 'SCE' AND trim(account_id) <> '' AND amount NOT IN ('', '-')) AS BIGINT) AS kept FROM raw_lines GROUP BY report""")
def _(v):
    return records.statement_counts(v("raw_lines"))


@query("src_statement_priority", """SELECT report, account_id, statement, line FROM (SELECT *, rank() OVER (PARTITION BY report, account_id ORDER BY CASE statement WHEN 'BS' THEN 0 WHEN 'IS' THEN 1 WHEN 'CIS' THEN 2 WHEN 'CF' THEN 3 ELSE 4 END) AS r
 FROM raw_lines WHERE statement <> 'SCE') x WHERE r = 1""")
def _(v):
    return records.best_statements(v("raw_lines"), ["report", "account_id"]).select("report", "account_id", "statement", "line")


@query("src_account_map", """SELECT account, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(a.canonical, CASE WHEN trim(l.account_id) = '' THEN 'unmapped:<empty>' ELSE concat('unmapped:', l.account_id) END) AS account FROM raw_lines l LEFT JOIN raw_accounts a ON l.account_id = a.account_id) x GROUP BY account""")
def _(v):
    return records.mapped(v("raw_lines"), v("raw_accounts")).groupBy("account").agg(F.count("*").alias("n"))


@query("src_effective_date", """SELECT id, coalesce(CASE WHEN receipt <> 'none' THEN CAST(strptime(substr(receipt, 1, 8), '%Y%m%d') AS DATE) END, last_day(make_date(y, q * 3, 1)) + CASE WHEN q = 4 THEN 90 ELSE 45 END) AS effective_date, receipt <> 'none' AS precise
 FROM raw_receipts WHERE receipt = 'none' OR receipt LIKE '20%'""")
def _(v):
    date, precise = records.publication(F.col("receipt"), F.col("y"), F.col("q"))
    return v("raw_receipts").where("receipt = 'none' OR receipt LIKE '20%'").select("id", date.alias("effective_date"), precise.alias("precise"))


VIEWS["raw_macro"] = "SELECT id, cycle, period, CASE WHEN id % 5 = 0 THEN 'n/a' WHEN id % 7 = 0 THEN ' ' ELSE concat(' ', CAST(id % 1000 AS STRING), '.25') END AS value, DATE '2024-02-01' + CAST(id % 10 AS INT) AS observed FROM raw_periods"


@query("src_macro_ecos", """SELECT * FROM (SELECT id, CASE cycle WHEN 'D' THEN CAST(strptime(period, '%Y%m%d') AS DATE) WHEN 'A' THEN make_date(CAST(period AS INTEGER), 1, 1) WHEN 'Q' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(substr(period, 6, 1) AS INTEGER) * 3 - 2, 1)
 WHEN 'S' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(substr(period, 6, 1) AS INTEGER) * 6 - 5, 1) ELSE CASE WHEN substr(period, 5, 2) <> '13' THEN make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(substr(period, 5, 2) AS INTEGER), 1) END END AS reference_date,
 TRY_CAST(trim(value) AS DECIMAL(38,6)) AS value, observed AS vintage_date FROM raw_macro) x WHERE reference_date IS NOT NULL AND value IS NOT NULL""")
def _(v):
    return records.macro_rows(v("raw_macro")).select("id", "reference_date", "value", "vintage_date")


@query("src_macro_counters", """SELECT cycle, CAST(count(*) FILTER (period LIKE '%13' AND cycle = 'M') AS BIGINT) AS bad_period, CAST(count(*) FILTER (id % 5 = 0 AND NOT (period LIKE '%13' AND cycle = 'M')) AS BIGINT) AS not_a_number,
 CAST(count(*) FILTER (id % 7 = 0 AND id % 5 <> 0 AND NOT (period LIKE '%13' AND cycle = 'M')) AS BIGINT) AS missing FROM raw_periods GROUP BY cycle""")
def _(v):
    value = F.when(F.col("id") % 5 == 0, "n/a").when(F.col("id") % 7 == 0, "").otherwise("1,5")
    return records.macro_counts(v("raw_periods").withColumn("value", value))


@query("src_lineage_id", """SELECT code, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS lineage_id
 FROM (SELECT code, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(concat('lineage:', code))) AS h FROM securities) x""")
def _(v):
    return v("securities").select("code", records.uuid5(records.OID, F.concat(F.lit("lineage:"), F.col("code"))).alias("lineage_id"))


VIEWS["raw_disclosures"] = "SELECT code, CASE WHEN id % 11 = 0 THEN '' ELSE CAST(id AS STRING) END AS receipt, CASE WHEN id % 13 = 0 THEN 'unknown' ELSE replace(CAST(effective_date AS STRING), '-', '') END AS day FROM statements"
FINE = "receipt <> '' AND day <> 'unknown'"


@query("src_disclosures", f"""SELECT code, receipt, day, CAST(bad AS BIGINT) AS malformed FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC, receipt) AS n FROM (
 SELECT *, count(*) FILTER (NOT ({FINE})) OVER (PARTITION BY code) AS bad FROM raw_disclosures) y WHERE {FINE} AND day <= '19990630') x WHERE n <= 5""")
def _(v):
    return records.disclosures(v("raw_disclosures"), AS_OF, 5).select("code", "receipt", F.date_format("date", "yyyyMMdd").alias("day"), "malformed")


REASONS = "CASE strftime(day, '%m-%d') " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in cal.CLOSED.items()) + f" ELSE '{cal.OTHERWISE_CLOSED}' END"


@query("src_calendar_derive", f"""SELECT day, {REASONS} AS reason FROM (SELECT CAST(g.d AS DATE) AS day FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM bars WHERE code = '000001') g
 WHERE dayofweek(g.d) NOT IN (0, 6) AND CAST(g.d AS DATE) NOT IN (SELECT d FROM bars WHERE code = '000001')) x""")
def _(v):
    return cal.closed_days(v("bars").where("code = '000001'"))  # the reference instrument


@query("src_security_master", "SELECT id, code, name, coalesce(listing_date, DATE '1980-01-01') AS listing_date, concat(code, ' ', CAST(coalesce(listing_date, DATE '1980-01-01') AS VARCHAR)) AS history FROM securities WHERE regexp_full_match(code, '[0-9]{6}') AND name IS NOT NULL AND name <> ''")
def _(v):
    rows = records.security_master(v("securities"))
    one = F.get("code_history", 0)
    return rows.select("id", "code", "name", "listing_date", F.concat_ws(" ", one["code"], one["valid_from"]).alias("history"))


# ---- loads ------------------------------------------------------------------------------------------------------


@query("sink_append_ignore", "SELECT code, d, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars_verify s WHERE s.code = b.code AND s.d = b.d)")
def _(v):
    return loads.appended(v("bars_verify"), v("bars"), ["code", "d"]).select("code", "d", "close")


@query("sink_upsert_snapshot", "SELECT b.code, b.d, CASE WHEN s.code IS NOT NULL THEN s.close ELSE b.close END AS close FROM bars b LEFT JOIN bars_verify s ON s.code = b.code AND s.d = b.d")
def _(v):
    return loads.upserted(v("bars"), v("bars_verify"), ["code", "d"]).select("code", "d", "close")


RESTATE = """(SELECT coalesce(n.code, o.code) AS code, coalesce(n.account, o.account) AS account, coalesce(n.period, o.period) AS period, o.id AS old_id, n.id AS new_id,
 CASE WHEN n.id IS NULL THEN 'keep' WHEN o.id IS NULL THEN 'insert' WHEN n.receipt = o.receipt THEN 'noop' ELSE 'supersede' END AS action
 FROM new_report n FULL JOIN (SELECT *, id % 7 AS receipt FROM statements WHERE superseded_by IS NULL) o ON n.code = o.code AND n.account = o.account AND n.period = o.period)"""


def restated(v):
    heads = v("statements").where("superseded_by IS NULL").withColumn("receipt", F.col("id") % 7)
    return loads.restatements(heads, v("new_report"), ["code", "account", "period"])


@query("load_restatement", f"SELECT code, account, period, old_id, new_id, action FROM {RESTATE} x")
def _(v):
    return restated(v)


@query("load_dry_run_report", f"SELECT action, CAST(count(*) AS BIGINT) AS n FROM {RESTATE} x GROUP BY action")
def _(v):
    return restated(v).groupBy("action").agg(F.count("*").alias("n"))


VIEWS["new_treasury"] = "SELECT id + 1000000000 AS id, code, period, CASE WHEN id % 3 = 0 THEN id % 7 ELSE id % 7 + 100 END AS receipt FROM treasury WHERE superseded_by IS NULL AND id % 4 <> 1 UNION ALL SELECT id + 2000000000, code, concat(period, 'X'), 5 FROM treasury WHERE superseded_by IS NULL AND id % 5 = 0"


@query("load_restatement_treasury", """SELECT coalesce(n.code, o.code) AS code, coalesce(n.period, o.period) AS period, o.id AS old_id, n.id AS new_id, CASE WHEN n.id IS NULL THEN 'keep' WHEN o.id IS NULL THEN 'insert' WHEN n.receipt = o.receipt THEN 'noop' ELSE 'supersede' END AS action
 FROM new_treasury n FULL JOIN (SELECT *, id % 7 AS receipt FROM treasury WHERE superseded_by IS NULL) o ON n.code = o.code AND n.period = o.period""")
def _(v):
    heads = v("treasury").where("superseded_by IS NULL").withColumn("receipt", F.col("id") % 7)
    return loads.restatements(heads, v("new_treasury"), ["code", "period"])


@query("load_date_regression", "SELECT n.id, n.announced_date, o.announced_date AS old_date FROM (SELECT id, announced_date - 25 AS announced_date FROM actions) n JOIN actions o ON o.superseded_by = n.id WHERE n.announced_date < o.announced_date - 0")
def _(v):
    acts = v("actions")
    new = acts.where("superseded_by IS NULL").withColumn("announced_date", F.date_sub("announced_date", 25))
    return loads.date_regressions(acts.where("superseded_by IS NOT NULL").unionByName(new), "announced_date")


@query("load_duplicate_accounts", "SELECT report, account_id, CAST(count(*) AS BIGINT) AS n FROM raw_lines GROUP BY report, account_id HAVING count(*) > 1")
def _(v):
    return loads.repeated(v("raw_lines"), ["report", "account_id"])


#: A feed of dividends with repeats, rows without an ex-date, and two kinds a day; of which some are stored, beside other actions.
VIEWS["dividend_feed"] = """SELECT id, code, CASE WHEN id % 26 = 0 THEN CAST(NULL AS DATE) ELSE effective_date END AS effective_date, CASE id % 6 WHEN 0 THEN '결산' WHEN 2 THEN '중간' END AS type FROM actions WHERE action_type = 'cash_dividend'
 UNION ALL SELECT id + 10000000000, code, effective_date, CASE id % 6 WHEN 0 THEN '결산' WHEN 2 THEN '중간' END FROM actions WHERE action_type = 'cash_dividend' AND id % 14 = 0"""
VIEWS["stored_dividends"] = "SELECT code, effective_date, action_type, CASE id % 6 WHEN 0 THEN '결산' WHEN 2 THEN '중간' END AS type FROM actions WHERE id % 10 = 0 OR action_type <> 'cash_dividend'"


@query("load_dividend_dedup", """SELECT code, CAST(count(*) FILTER (new) AS BIGINT) AS saved, CAST(count(*) FILTER (NOT new AND effective_date IS NOT NULL) AS BIGINT) AS skipped, CAST(count(*) FILTER (effective_date IS NULL) AS BIGINT) AS gaps,
 coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (new), '') AS ids FROM (SELECT f.*, f.effective_date IS NOT NULL AND row_number() OVER (PARTITION BY f.code, f.effective_date, coalesce(f.type, '') ORDER BY f.id) = 1 AND NOT EXISTS
 (SELECT 1 FROM stored_dividends s WHERE s.action_type = 'cash_dividend' AND s.code = f.code AND s.effective_date = f.effective_date AND coalesce(s.type, '') = coalesce(f.type, '')) AS new FROM dividend_feed f) x GROUP BY code""")
def _(v):
    rows, counts = loads.new_dividends(v("dividend_feed"), v("stored_dividends"))
    ids = rows.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return counts.join(ids, "code", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


#: Reports of statements as they land in three files: some land late, some twice.
VIEWS["landed_reports"] = """SELECT id, code, period, account, effective_date, concat('r', CAST(CAST(floor(id / 10) AS BIGINT) AS STRING)) AS receipt, value, id % 3 AS file FROM statements
 UNION ALL SELECT id + 100000000000, code, period, account, effective_date + 5, concat('r', CAST(CAST(floor(id / 10) AS BIGINT) AS STRING)), value + 1, (id + 1) % 3 FROM statements WHERE id % 7 = 0"""


@query("load_restatement_stream", """SELECT id, code, period, account, receipt, value, lead(id) OVER (PARTITION BY code, period, account ORDER BY effective_date, receipt) AS superseded_by FROM
 (SELECT *, row_number() OVER (PARTITION BY code, period, account, receipt ORDER BY effective_date, id) AS n FROM landed_reports) x WHERE n = 1""")
def _(v):
    spark = SparkSession.active()
    place = f"{shared_folder(spark)}/tidemark/reports-{uuid.uuid4().hex}"
    reports = v("landed_reports")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reports.schema if f.name != "file")
    for file in (2, 0, 1):  # each landing is one run of the stream
        with shuffles_dropped(spark):
            reports.where(F.col("file") == file).drop("file").write.mode("append").parquet(f"{place}/landed")
        restatement_stream(spark, f"{place}/landed", schema, f"{place}/chains", f"{place}/progress", ["code", "period", "account"], parts=8)
    return spark.read.parquet(f"{place}/chains").select("id", "code", "period", "account", "receipt", "value", "superseded_by")


@query("load_macro_future_filter", f"SELECT indicator_id, reference_date, vintage_date, value FROM macro WHERE reference_date <= {D}")
def _(v):
    return pit.visible(v("macro"), AS_OF, "reference_date").select("indicator_id", "reference_date", "vintage_date", "value")


@query("load_macro_window", "SELECT o_orderkey, CAST(date_trunc('month', d) - INTERVAL 23 MONTH AS DATE) AS start, CAST(date_trunc('month', d) AS DATE) AS stop FROM order_days")
def _(v):
    return v("order_days").select("o_orderkey", F.add_months(F.trunc("d", "month"), -23).alias("start"), F.trunc("d", "month").alias("stop"))


@query("load_incremental_window", f"SELECT s.code, coalesce(b.next, s.listing_date) AS start FROM securities s LEFT JOIN (SELECT code, max(d) + 1 AS next FROM bars WHERE d <= {D} GROUP BY code) b ON s.code = b.code WHERE coalesce(b.next, s.listing_date) <= {D}")
def _(v):
    return loads.missing_from(pit.visible(v("bars"), AS_OF, "d"), v("securities").select("code", F.col("listing_date").alias("start")), AS_OF)


@query("load_survivorship_windows", "SELECT id, code, start, least(stop, delisting_date) AS stop FROM (SELECT id, lpad(CAST(id + 500 AS VARCHAR), 6, '0') AS code, listing_date AS start, listing_date + 300 AS stop, delisting_date FROM securities UNION ALL SELECT id, code, listing_date + 301, delisting_date, delisting_date FROM securities) x WHERE delisting_date IS NOT NULL AND start <= least(stop, delisting_date)")
def _(v):
    past = F.struct(F.lpad((F.col("id") + 500).cast("string"), 6, "0").alias("code"), F.col("listing_date").alias("valid_from"), F.date_add("listing_date", 300).alias("valid_to"))
    now = F.struct("code", F.date_add("listing_date", 301).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return loads.windows(v("securities").withColumn("code_history", F.array(past, now))).withColumnRenamed("end", "stop")


VIEWS["tried"] = "SELECT concat(source, ' ', CAST(CAST(started_at AS DATE) AS STRING)) AS batch, CAST(id AS STRING) AS item, status <> 'partial' AS ok FROM batch_runs"
VIEWS["batches"] = """SELECT concat(source, ' ', CAST(d AS STRING)) AS batch, (dayofweek(d) + {dow}) % 7 NOT IN (0, 6) AS open, n % 13 <> 0 AS universe_ok FROM (SELECT source, CAST(started_at AS DATE) AS d, count(*) AS n FROM batch_runs GROUP BY 1, 2) x
 UNION ALL SELECT concat('EMPTY ', CAST(r_regionkey AS STRING)), TRUE, TRUE FROM {region}"""


@query("load_status", """SELECT batch, CAST(ok AS BIGINT) AS succeeded, CAST(bad AS BIGINT) AS failed, CASE WHEN closed OR ok + bad = 0 THEN 'skipped' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN closed THEN '' ELSE failures END AS failures FROM (
 SELECT b.batch, NOT (b.open AND b.universe_ok) AS closed, count(*) FILTER (t.ok AND b.open AND b.universe_ok) AS ok, count(*) FILTER (NOT t.ok AND b.open AND b.universe_ok) AS bad, coalesce(string_agg(t.item, ',' ORDER BY t.item) FILTER (NOT t.ok), '') AS failures
 FROM batches b LEFT JOIN tried t ON b.batch = t.batch GROUP BY b.batch, b.open, b.universe_ok) x""")
def _(v):
    return loads.status(v("tried"), v("batches")).withColumn("failures", F.array_join("failures", ","))


@query("chain_append_only_check", """SELECT id, 'changed' AS problem FROM statements WHERE id % 1001 = 0 AND id % 997 <> 0 UNION ALL SELECT id, 'vanished' FROM statements WHERE id % 997 = 0
 UNION ALL SELECT DISTINCT superseded_by, 'missing_successor' FROM statements WHERE superseded_by % 997 = 0 AND id % 997 <> 0""")
def _(v):
    before = v("statements")
    after = before.where("id % 997 <> 0").withColumn("value", F.when(F.col("id") % 1001 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return loads.append_only_violations(before, after, ["code", "account", "period", "value"])


# ---- reproducibility and texts ----------------------------------------------------------------------------------


@query("rep_result_hash", """SELECT o_custkey AS run, concat('sha256:', sha256(concat('{"as_of":"', CAST(max(d) AS VARCHAR), '","codes":["', string_agg(k, '","' ORDER BY k), '"]}'))) AS hash
 FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS k, max(d) OVER (PARTITION BY o_custkey) AS d FROM order_days) x GROUP BY o_custkey""")
def _(v):
    runs = v("order_days").groupBy("o_custkey").agg(F.max("d").alias("d"), F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("codes"))
    return runs.select(F.col("o_custkey").alias("run"), rec.result_hash(as_of=F.col("d").cast("string"), codes=F.col("codes")).alias("hash"))
