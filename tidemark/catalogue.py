"""All registered queries of the point-in-time engine, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pit, universe
from tidemark.operators import trading_calendar as cal
from tidemark.sources.stored import kept_view
from tidemark.views import VIEWS, oracle, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Dates as of which single-date queries ask.
AS_OF, EARLIER = "1999-06-30", "1998-12-31"
#: Views of facts that queries with many branches keep as tables.
FACTS = ("securities", "bars", "actions", "statements", "market_caps", "treasury", "calendar", "batch_order", "loaded_bars", "loaded_statements")


def query(name: str, sql: str | None = None, kept: tuple[str, ...] = ()):
    """Register a function of (view) -> DataFrame; ``view(name)`` gives a view. ``kept``: views that it reads in several
    branches, which are written once a session as tables bucketed by code."""

    def add(f):
        def views(spark: SparkSession, sf_dir: str):
            return cache(lambda v: (kept_view if v in kept else spark_view)(spark, sf_dir, v))  # a view is analysed once

        QUERIES[name] = lambda spark, sf_dir: f(views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


# ---- point-in-time resolution -------------------------------------------------------------------------------

#: Rows of a chain that count as of AS_OF, for the table and date column put in.
ACTIVE = "(SELECT r.* FROM {t} r LEFT JOIN {t} s ON r.superseded_by = s.id WHERE r.{d} <= DATE '1999-06-30' AND (s.id IS NULL OR s.{d} > DATE '1999-06-30'))"


def chain(table: str, date: str = "effective_date") -> str:
    return ACTIVE.replace("{t}", table).replace("{d}", date)


@query("pit_filter", "SELECT code, d, close FROM bars WHERE d <= DATE '1999-06-30'")
def _(v):
    return pit.visible(v("bars"), AS_OF, "d").select("code", "d", "close")


@query("pit_lookahead_violations", "SELECT id, code, effective_date FROM statements WHERE effective_date > DATE '1999-06-30'")
def _(v):
    return pit.lookahead(v("statements"), AS_OF).select("id", "code", "effective_date")


@query("pit_vintage_violations", "SELECT indicator_id, reference_date, vintage_date FROM macro WHERE reference_date > DATE '1999-06-30' OR vintage_date > DATE '1999-06-30'")
def _(v):
    return pit.lookahead(v("macro"), AS_OF, "reference_date", "vintage_date").select("indicator_id", "reference_date", "vintage_date")


@query("pit_active_rows", f"SELECT id, code, period, value FROM {chain('statements')} a")
def _(v):
    return pit.active(v("statements"), AS_OF).select("id", "code", "period", "value")


NEWEST = "row_number() OVER (PARTITION BY {k} ORDER BY effective_date DESC, CAST(id AS VARCHAR) DESC) AS rn"


@query("pit_latest_active", f"SELECT code, id, period, value FROM (SELECT *, {NEWEST.replace('{k}', 'code')} FROM {chain('statements')} a) x WHERE rn = 1")
def _(v):
    return pit.latest_active(v("statements"), AS_OF, ["code"]).select("code", "id", "period", "value")


@query("pit_latest_active_by_key", f"SELECT code, period, id, value FROM (SELECT *, {NEWEST.replace('{k}', 'code, period')} FROM {chain('statements')} a) x WHERE rn = 1")
def _(v):
    return pit.latest_active(v("statements"), AS_OF, ["code", "period"]).select("code", "period", "id", "value")


#: Chains of 150 orders each: closed to a cycle, in one piece (deeper than 100 hops at first), or cut every ten.
VIEWS["chains"] = """SELECT n AS id, CAST(floor(n / 150) AS BIGINT) AS block, CASE WHEN n % 150 = 149 THEN CASE WHEN CAST(floor(n / 150) AS BIGINT) % 3 = 0 THEN n - 149 END WHEN CAST(floor(n / 150) AS BIGINT) % 3 = 2 AND n % 10 = 9 THEN NULL ELSE n + 1 END AS superseded_by
 FROM (SELECT o_orderkey - first AS n, of FROM {orders} CROSS JOIN (SELECT min(o_orderkey) AS first, count(*) AS of FROM {orders}) c) x WHERE n < of - of % 150"""


@query("pit_chain_integrity", """SELECT block, CAST(count(*) AS BIGINT) AS facts, CAST(count(superseded_by) AS BIGINT) AS superseded, CAST(count(*) FILTER (block % 3 = 0 OR (block % 3 = 1 AND 149 - id % 150 > 100)) AS BIGINT) AS defects FROM chains GROUP BY block""")
def _(v):
    facts = v("chains")
    bad = pit.chain_defects(facts, keys=("block",)).select(F.col("id").alias("bad"))
    rows = facts.join(bad, F.col("id") == F.col("bad"), "left")
    return rows.groupBy("block").agg(F.count("*").alias("facts"), F.count("superseded_by").alias("superseded"), F.count("bad").alias("defects"))


PERIODS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, account ORDER BY effective_date DESC, period DESC, CAST(id AS VARCHAR) DESC) AS rk FROM (
 SELECT *, {NEWEST.replace('{k}', 'code, account, period')} FROM {chain('statements')} a) x WHERE rn = 1) y WHERE rk <= 8)"""


@query("pit_financial_periods", f"SELECT code, account, period, id, value FROM {PERIODS} p")
def _(v):
    return pit.financial_periods(v("statements"), AS_OF, ["code", "account"]).select("code", "account", "period", "id", "value")


@query("pit_latest_treasury", f"""SELECT code, period, shares_treasury FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY effective_date DESC, period DESC, CAST(id AS VARCHAR) DESC) AS rk FROM (
 SELECT *, {NEWEST.replace('{k}', 'code, period')} FROM {chain('treasury')} a) x WHERE rn = 1) y WHERE rk = 1""")
def _(v):
    return pit.financial_periods(v("treasury"), AS_OF, ["code"], n=1).select("code", "period", "shares_treasury")


@query("pit_active_actions", f"SELECT id, code, action_type, effective_date FROM {chain('actions', 'announced_date')} a")
def _(v):
    return pit.active_actions(v("actions"), AS_OF).select("id", "code", "action_type", "effective_date")


@query("pit_dividends", f"SELECT id, code, effective_date, cash_amount FROM {chain('actions', 'announced_date')} a WHERE action_type = 'cash_dividend' AND effective_date <= DATE '1999-06-30'")
def _(v):
    return pit.dividends(v("actions"), AS_OF).select("id", "code", "effective_date", "cash_amount")


CUT = "(SELECT id FROM batch_order WHERE source = 'DART' AND place = (of + 1) // 2)"


@query("pit_batch_cutoff", f"""SELECT l.id, l.batch_id FROM loaded_statements l JOIN batch_runs b ON l.batch_id = b.id AND b.source = 'DART'
 JOIN (SELECT started_at, id FROM batch_runs WHERE source = 'DART' AND id = {CUT}) c ON b.started_at < c.started_at OR (b.started_at = c.started_at AND b.id <= c.id)""")
def _(v):
    order = v("batch_order")  # the cutoff is the batch in the middle of the source's batches
    cutoff = order.where((F.col("source") == "DART") & (F.col("place") == F.floor((F.col("of") + 1) / 2))).first()
    return pit.batch_cutoff(v("loaded_statements"), v("batch_runs"), "DART", cutoff["id"] if cutoff else None).select("id", "batch_id")


@query("pit_prices_range", "SELECT b.code, b.d, b.close, b.volume FROM bars b WHERE d BETWEEN DATE '1998-12-31' AND DATE '1999-06-30' AND code IN (SELECT code FROM securities WHERE market = 'KOSPI')")
def _(v):
    codes = v("securities").where("market = 'KOSPI'").select("code")
    return v("bars").where(F.col("d").between(EARLIER, AS_OF)).join(codes, "code", "left_semi").select("code", "d", "close", "volume")


@query("pit_codes_with_prices", "SELECT DISTINCT code FROM bars WHERE d <= DATE '1999-06-30'")
def _(v):
    return pit.visible(v("bars"), AS_OF, "d").select("code").distinct()


@query("pit_latest_trade_date", "SELECT code, max(d) AS last_day FROM bars GROUP BY code")
def _(v):
    return v("bars").groupBy("code").agg(F.max("d").alias("last_day"))


@query("pit_latest_market_cap", "SELECT code, effective_date, market_cap, shares FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY effective_date DESC) AS rn FROM market_caps WHERE effective_date <= DATE '1999-06-30') x WHERE rn = 1")
def _(v):
    return pit.newest(pit.visible(v("market_caps"), AS_OF), ["code"], "effective_date").select("code", "effective_date", "market_cap", "shares")


@query("pit_latest_macro", "SELECT indicator_id, reference_date, vintage_date, value FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY reference_date DESC, vintage_date DESC) AS rn FROM macro WHERE reference_date <= DATE '1999-06-30' AND vintage_date <= DATE '1999-06-30') x WHERE rn = 1")
def _(v):
    return pit.latest_macro(v("macro"), AS_OF).select("indicator_id", "reference_date", "vintage_date", "value")


#: Statements with the citation of each row; reports of two kinds, some of whose rows cite another receipt.
VIEWS["cited_statements"] = "SELECT *, id AS citation_id, CASE WHEN id % 10 < 3 THEN 'CFS' ELSE 'OFS' END AS ifrs_type FROM statements"
VIEWS["citations"] = "SELECT id, CASE WHEN id % 10 = 1 AND CAST(code AS INT) % 7 = 0 THEN 'r0' ELSE concat('r', CAST(CAST(floor(id / 10) AS BIGINT) AS STRING)) END AS identifier FROM statements"


@query("pit_active_disclosure", """SELECT s.code, s.period, s.ifrs_type, CAST(count(DISTINCT c.identifier) AS BIGINT) AS receipts, CASE WHEN count(DISTINCT c.identifier) = 1 THEN min(c.identifier) END AS receipt, count(DISTINCT c.identifier) > 1 AS corrupt
 FROM cited_statements s JOIN citations c ON s.citation_id = c.id WHERE s.superseded_by IS NULL GROUP BY s.code, s.period, s.ifrs_type""")
def _(v):
    return pit.active_disclosures(v("cited_statements"), v("citations"))


@query("pit_restatement_history", "SELECT code, period, id, CAST(row_number() OVER (PARTITION BY code, period, account ORDER BY effective_date, id) AS INTEGER) AS sequence, superseded_by IS NULL AS is_active FROM statements")
def _(v):
    return pit.restatement_history(v("statements")).select("code", "period", "id", "sequence", "is_active")


@query("pit_restatement_lag", "SELECT DISTINCT code FROM (SELECT code FROM statements GROUP BY code, account, period HAVING bool_or(effective_date <= DATE '1999-06-30') AND bool_or(effective_date > DATE '1999-06-30')) x")
def _(v):
    return pit.restatement_lag(v("statements"), AS_OF)


# ---- calendar -----------------------------------------------------------------------------------------------

#: Every day of the calendar's span with the business days around it.
DAYS = """(SELECT d, c.day IS NOT NULL AS is_business_day, (SELECT max(day) FROM calendar k WHERE k.day <= d) AS previous_or_same, (SELECT min(day) FROM calendar k WHERE k.day >= d) AS next_or_same,
 (SELECT max(day) FROM calendar k WHERE k.day < d) AS previous, (SELECT min(day) FROM calendar k WHERE k.day > d) AS next
 FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d FROM calendar) g LEFT JOIN calendar c ON c.day = g.d)"""


@query("cal_is_business_day", f"SELECT o.o_orderkey, x.is_business_day FROM {{orders}} o JOIN {DAYS} x ON CAST(o.o_orderdate AS DATE) = x.d")
def _(v):
    orders = v("order_days")
    return cal.with_days(orders, v("calendar"), "d", "is_business_day").where("is_business_day IS NOT NULL").select("o_orderkey", "is_business_day")


@query("cal_snap", f"SELECT d, previous_or_same, next_or_same FROM {DAYS} x")
def _(v):
    return cal.all_days(v("calendar")).select("d", "previous_or_same", "next_or_same")


@query("cal_next_prev", f"SELECT d, previous, next FROM {DAYS} x")
def _(v):
    return cal.all_days(v("calendar")).select("d", "previous", "next")


@query("cal_count_between", """SELECT o_orderkey, CAST((SELECT count(*) FROM calendar WHERE day >= d AND day <= d + 30) AS INTEGER) AS both_ends,
 CAST((SELECT count(*) FROM calendar WHERE day > d AND day <= d + 30) AS INTEGER) AS right_end FROM order_days WHERE d BETWEEN (SELECT min(day) FROM calendar) AND (SELECT max(day) FROM calendar) - 30""")
def _(v):
    days = v("order_days").select("o_orderkey", F.col("d").alias("start"), F.date_add("d", 30).alias("end"))
    both = cal.count_between(days, v("calendar"), "both").select("o_orderkey", F.col("n").alias("both_ends"))
    right = cal.count_between(days, v("calendar"), "right").select("o_orderkey", F.col("n").alias("right_end"))
    return both.join(right, "o_orderkey")


@query("cal_rebalance_dates", """SELECT CAST(last_day(m) AS DATE) AS day FROM (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m, a, b FROM (SELECT min(d) AS a, max(d) AS b FROM bars) s) x
 WHERE last_day(m) BETWEEN a AND b""")
def _(v):
    return cal.rebalance_dates(v("bars").agg(F.min("d").alias("start"), F.max("d").alias("end")))


@query("cal_bounds", "SELECT min(day) AS first_day, max(day) AS last_day, (SELECT max(d) FROM bars) AS last_data, CAST(count(*) AS BIGINT) AS n FROM calendar")
def _(v):
    return v("calendar").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).crossJoin(F.broadcast(v("bars").agg(F.max("d").alias("last_data"))))


VIEWS["verified_calendars"] = "SELECT market, max(listing_date) AS verified FROM securities GROUP BY market UNION ALL SELECT 'none', CAST(NULL AS DATE) FROM {region} WHERE r_regionkey = 0"


@query("cal_stale", "SELECT market, CAST(DATE '1998-05-01' - verified AS INTEGER) AS age, coalesce(DATE '1998-05-01' - verified > 365, TRUE) AS stale FROM verified_calendars")
def _(v):
    return cal.stale(v("verified_calendars"), "1998-05-01")


@query("pit_asof_normalize", f"""SELECT q.d AS as_of, CASE WHEN q.d > DATE '2000-06-30' THEN NULL WHEN x.is_business_day THEN q.d WHEN x.previous_or_same IS NOT NULL THEN x.previous_or_same
  ELSE q.d - CAST(CASE dayofweek(q.d) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) END AS resolved,
 CASE WHEN q.d > DATE '2000-06-30' THEN 'future' WHEN x.is_business_day THEN 'exact' WHEN x.previous_or_same IS NOT NULL THEN 'snapped' ELSE 'outside' END AS status
 FROM (SELECT DISTINCT d FROM order_days) q LEFT JOIN {DAYS} x ON q.d = x.d""")
def _(v):
    return cal.normalise_as_of(v("order_days").select(F.col("d").alias("as_of")).distinct(), v("calendar"), "2000-06-30")


# ---- universe -----------------------------------------------------------------------------------------------

LISTED = "listing_date <= DATE '1999-06-30' AND (delisting_date IS NULL OR delisting_date > DATE '1999-06-30')"


@query("uni_active", f"SELECT id, code, market FROM securities WHERE {LISTED}")
def _(v):
    return universe.listed(v("securities"), AS_OF).select("id", "code", "market")


@query("uni_delisted_before", "SELECT id, code, delisting_date FROM securities WHERE delisting_date <= DATE '1999-06-30'")
def _(v):
    return universe.delisted_before(v("securities"), AS_OF).select("id", "code", "delisting_date")


@query("uni_filter_security_type", f"SELECT id, code, security_type FROM securities WHERE {LISTED} AND security_type IN ('common', 'preferred')")
def _(v):
    return universe.listed(v("securities"), AS_OF, ("common", "preferred")).select("id", "code", "security_type")


@query("uni_lookup_code", """SELECT code, id, historic FROM (SELECT q.code, s.id, s.way = 1 AS historic, row_number() OVER (PARTITION BY q.code ORDER BY s.way, s.id) AS rn
 FROM (SELECT DISTINCT lpad(CAST(l_suppkey * 2 AS VARCHAR), 6, '0') AS code FROM {lineitem}) q
 LEFT JOIN (SELECT code AS c, id, 0 AS way FROM securities UNION ALL SELECT lpad(CAST(id + 100000 AS VARCHAR), 6, '0'), id, 1 FROM securities UNION ALL SELECT lpad(CAST(id * 4 AS VARCHAR), 6, '0'), id, 1 FROM securities) s ON q.code = s.c) x WHERE rn = 1""")
def _(v):
    past = lambda n: F.lpad(n.cast("string"), 6, "0").alias("code")
    named = v("securities").withColumn("code_history", F.array(F.struct(past(F.col("id") + 100000)), F.struct(past(F.col("id") * 4))))
    asked = v("trades").select(F.lpad((F.col("code").cast("long") * 2).cast("string"), 6, "0").alias("code")).distinct()
    out = universe.lookup(asked, named)
    return out.select("code", "id", F.when(F.col("id").isNotNull(), F.col("historic")).alias("historic"))


VIEWS["known_as"] = "SELECT id, concat('Ｓｕｐｐｌｉｅｒ　', CAST(id AS STRING)) AS wide FROM securities"


@query("uni_search", f"""SELECT * FROM (SELECT 'name' AS by, code, name, starts_with(lower(name), 'supplier#00000001') AS prefix FROM securities WHERE {LISTED} AND contains(lower(name), 'supplier#00000001') ORDER BY 4 DESC, name, code LIMIT 20) a
 UNION ALL SELECT * FROM (SELECT 'code', code, name, code = '000005' OR lpad(CAST(id + 500 AS VARCHAR), 6, '0') = '000005' FROM securities WHERE {LISTED} AND (contains(code, '5') OR contains(lpad(CAST(id + 500 AS VARCHAR), 6, '0'), '5')) ORDER BY 4 DESC, name, code LIMIT 20) b
 UNION ALL SELECT * FROM (SELECT 'wide', code, concat('Ｓｕｐｐｌｉｅｒ　', CAST(id AS VARCHAR)), TRUE FROM securities WHERE starts_with(CAST(id AS VARCHAR), '1') ORDER BY 4 DESC, 3, code LIMIT 20) c""")
def _(v):
    past = F.array(F.struct(F.lpad((F.col("id") + 500).cast("string"), 6, "0").alias("code")))
    named = v("securities").withColumn("code_history", past)
    wide = named.drop("name").join(v("known_as").withColumnRenamed("wide", "name"), "id")
    found = {"name": universe.search(named, "Ｓupplier#00000001", AS_OF), "code": universe.search(named, "5", AS_OF), "wide": universe.search(wide, "supplier 1", AS_OF, delisted=True)}
    parts = [rows.select(F.lit(by).alias("by"), "code", "name", "prefix") for by, rows in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("uni_status", "SELECT id, code, CASE WHEN delisting_date <= DATE '1999-06-30' THEN 'delisted' WHEN listing_date > DATE '1999-06-30' THEN 'not_yet_listed' ELSE 'active' END AS status FROM securities")
def _(v):
    return universe.status(v("securities"), AS_OF).select("id", "code", "status")


@query("uni_normalize_codes", "SELECT DISTINCT lpad(trim(k), 6, '0') AS code FROM (SELECT concat(' ', CAST(l_partkey * 37 AS VARCHAR), ' ') AS k FROM {lineitem}) x WHERE regexp_full_match(trim(k), '[0-9]{1,6}')")
def _(v):
    return universe.normalised_codes(v("part_texts"), "k")


@query("uni_market_breakdown", f"SELECT market, CAST(count(*) AS BIGINT) AS n FROM securities WHERE {LISTED} GROUP BY market")
def _(v):
    return universe.by_market(v("securities"), AS_OF)
