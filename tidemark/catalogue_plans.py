"""Queries on screens, portfolios, rebalance panels, loads and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.catalogue import AS_OF, FACTS, chain, query
from tidemark.catalogue_market import D, FACTOR_SQL, MCAP, evaluated
from tidemark.operators import pit
from tidemark.operators import trading_calendar as cal
from tidemark.plans import factors, rebalance, screen, snapshots
from tidemark.sources.stored import shared_folder, written
from tidemark.views import VIEWS

CONDITIONS = [("fac_eps_ttm", ">", 500000.0), ("fac_pbr", "<", 2000.0)]
EPS_SQL, PBR_SQL = FACTOR_SQL["fac_eps_ttm"], FACTOR_SQL["fac_pbr"]
SHOWN = ["fac_mcap_ex_treasury", "fac_mcap_official", "fac_pbr", "fac_eps_ttm", "fac_roe_ttm", "fac_dividend_yield", "fac_total_return_1y"]


@query("q_screen", f"SELECT code, round({EPS_SQL}, 6) AS fac_eps_ttm, round({PBR_SQL}, 6) AS fac_pbr FROM o_fields WHERE {EPS_SQL} > 500000 AND {PBR_SQL} < 2000")
def _(v):
    rows = screen.passing(evaluated(v, ["fac_eps_ttm", "fac_pbr"]), CONDITIONS)
    return rows.select("code", F.round("fac_eps_ttm", 6).alias("fac_eps_ttm"), F.round("fac_pbr", 6).alias("fac_pbr"))


@query("q_screen_outcomes", f"""SELECT code, CASE WHEN {EPS_SQL} IS NULL THEN 'na' WHEN NOT {EPS_SQL} > 500000 THEN 'fail' WHEN {PBR_SQL} IS NULL THEN 'na' WHEN NOT {PBR_SQL} < 2000 THEN 'fail' ELSE 'pass' END AS outcome,
 CASE WHEN {EPS_SQL} IS NULL OR NOT {EPS_SQL} > 500000 THEN 1 WHEN {PBR_SQL} IS NULL OR NOT {PBR_SQL} < 2000 THEN 2 END AS at FROM o_fields""")
def _(v):
    return screen.outcomes(evaluated(v, ["fac_eps_ttm", "fac_pbr"]), CONDITIONS)


OWN = {"value_z": {"op": "zscore", "field": "close_price_adjusted"}, "cheap": {"op": "avg", "args": [{"field": "fac_eps_ttm"}, {"field": "shares_issued"}]}}


@query("q_screen_custom", "SELECT code, round((eps4 + shares) / 2, 6) AS cheap, 'universe_distribution_required' AS value_z_reason FROM o_fields WHERE (eps4 + shares) / 2 > 200000")
def _(v):
    rows = evaluated(v, ["cheap", "value_z"], {**factors.BUILT_IN, **OWN}, relative=False)
    return screen.passing(rows, [("cheap", ">", 200000.0)]).select("code", F.round("cheap", 6).alias("cheap"), "value_z_reason")


@query("q_evaluate_pack", """SELECT code, round((close_price_adjusted - avg(close_price_adjusted) OVER w) / nullif(stddev_pop(close_price_adjusted) OVER w, 0), 6) AS value_z,
 CAST(count(close_price_adjusted) OVER w AS BIGINT) AS sample, round((eps4 + shares) / 2, 6) AS cheap FROM o_fields WINDOW w AS (PARTITION BY security_type)""")
def _(v):
    rows = evaluated(v, ["value_z", "cheap"], {**factors.BUILT_IN, **OWN})
    return rows.select("code", F.round("value_z", 6).alias("value_z"), F.col("value_z_sample").alias("sample"), F.round("cheap", 6).alias("cheap"))


def long_sql(names: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT code, '{n}' AS factor, CAST({FACTOR_SQL[n]} AS DOUBLE) AS x{extra} FROM o_fields" for n in names)


@query("q_market_overview", f"""SELECT factor, CAST(count(x) AS BIGINT) AS count, CAST(count(*) - count(x) AS BIGINT) AS na_count, round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.25), 6) AS p25, round_even(quantile_cont(x, 0.5), 6) AS median,
 round_even(quantile_cont(x, 0.75), 6) AS p75, round(min(x), 6) AS min, round(max(x), 6) AS max FROM ({long_sql(SHOWN)}) l GROUP BY factor""")
def _(v):
    rows = screen.overview(evaluated(v, SHOWN), SHOWN)  # min and max are whole doubles there, rounded here to be compared
    return rows.withColumns({c: F.round(c, 6) for c in ("min", "max")})


UNIT_SQL = "CASE " + " ".join(f"WHEN factor = '{n}' THEN '{u}'" for n, u in snapshots.UNITS.items()) + " END"
#: Actions of which some are impossible; their codes are left out of a snapshot.
VIEWS["some_bad_actions"] = "SELECT id, code, CASE WHEN id % 1000 = 0 THEN 'renamed' ELSE action_type END AS action_type, announced_date, effective_date, ratio, cash_amount, superseded_by, details FROM actions"
#: A snapshot has every factor of the pack.
PACK = list(factors.BUILT_IN)
#: What a snapshot was computed from.
CURRENT, OLDER = {"KRX": "b2", "DART": "d2"}, {"KRX": "b1", "DART": "d2"}


def place() -> str:
    return f"{shared_folder(SparkSession.active())}/tidemark/snapshots-{uuid.uuid4().hex}"


@query("q_snapshot_precompute", f"""SELECT code, factor, round(x, 6) AS value, {UNIT_SQL} AS unit, 'DART=d2,KRX=b2' AS versions, x IS NULL AS missing, {D} AS as_of FROM ({long_sql(PACK)}) l
 WHERE code NOT IN (SELECT code FROM some_bad_actions WHERE action_type = 'renamed') UNION ALL SELECT DISTINCT code, 'rejected', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), 'unknown_action', TRUE, {D} FROM some_bad_actions WHERE action_type = 'renamed'""", kept=FACTS)
def _(v):
    view = lambda name: v("some_bad_actions") if name == "actions" else v(name)
    rows, rejects = snapshots.computed(view, AS_OF, PACK, CURRENT)
    snapshots.save(rows, folder := place())
    stored = snapshots.read(SparkSession.active(), folder, AS_OF)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("versions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    shown = stored.select("code", "factor", F.round("value", 6).alias("value"), "unit", said.alias("versions"), F.col("reason").isNotNull().alias("missing"), "as_of")
    none = F.lit(None)
    return shown.union(rejects.select("code", F.lit("rejected"), none.cast("double"), none.cast("string"), "error", F.lit(True), pit.on(AS_OF)))


#: Snapshots as nightly jobs left them: odd codes were covered, every third code last under older versions and with an
#: older value, codes of which 7 leaves 1 without one of the factors.
SERVED = "CAST(code AS INTEGER) % 2 = 1 AND CAST(code AS INTEGER) % 3 <> 0 AND CAST(code AS INTEGER) % 7 <> 1"
LEAST = [("fac_mcap_official", ">", 0.0), ("fac_mcap_ex_treasury", ">", 1000000.0)]
OFFICIAL, EX = FACTOR_SQL["fac_mcap_official"], FACTOR_SQL["fac_mcap_ex_treasury"]


def stored_snapshots(v, names: list[str]):
    """Two loads into one store: all odd codes under the older versions, then some of them again under the current ones."""
    code = F.col("code").cast("int")
    rows, _ = snapshots.computed(screen.only_codes(v, v("securities").where(code % 2 == 1).select("code")), AS_OF, names, OLDER)
    rows = written(rows, "snapshot").where(~((code % 7 == 1) & (F.col("factor") == names[1])))
    snapshots.save(rows.withColumn("value", F.col("value") + 1), folder := place())
    current = F.create_map(*(F.lit(x) for kv in CURRENT.items() for x in kv))
    snapshots.save(rows.where(code % 3 != 0).withColumn("versions", current), folder)
    return snapshots.read(SparkSession.active(), folder, AS_OF)


@query("q_screen_from_snapshot", f"""SELECT code, round({OFFICIAL}, 6) AS fac_mcap_official, round({EX}, 6) AS fac_mcap_ex_treasury, {SERVED} AS served FROM o_fields WHERE {OFFICIAL} > 0 AND {EX} > 1000000""", kept=FACTS)
def _(v):
    names = [c[0] for c in LEAST]
    ready = written(snapshots.served(stored_snapshots(v, names), names, CURRENT).withColumn("served", F.lit(True)), "served")
    # facts of codes that are served are not read
    rest = v("securities").join(ready, "code", "left_anti").select("code")
    live = evaluated(screen.only_codes(v, rest), names).select("code", *names, F.lit(False).alias("served"))
    rows = screen.passing(ready.unionByName(live), LEAST)
    return rows.select("code", *(F.round(n, 6).alias(n) for n in names), "served")


@query("q_macro_overview", f"SELECT indicator_id, value FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY reference_date DESC, vintage_date DESC) AS rn FROM macro WHERE reference_date <= {D} AND vintage_date <= {D}) x WHERE rn = 1")
def _(v):
    return pit.latest_macro(v("macro"), AS_OF).select("indicator_id", "value")


@query("q_stock_detail", f"SELECT code, factor, round(x, 6) AS value FROM ({long_sql(SHOWN)}) l WHERE x IS NOT NULL")
def _(v):
    rows = evaluated(v, SHOWN).unpivot("code", SHOWN, "factor", "value").where("value IS NOT NULL")
    return rows.select("code", "factor", F.round("value", 6).alias("value"))


#: Requests of codes as given: short ones, repeats, unknown ones, and some that are no code.
VIEWS["asked_codes"] = """SELECT s_suppkey % 30 AS request, s_suppkey AS place, CAST(s_suppkey AS STRING) AS code FROM {supplier} UNION ALL SELECT s_suppkey % 30, s_suppkey + 1000000, concat(' ', lpad(CAST(s_suppkey AS STRING), 6, '0')) FROM {supplier} WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey % 30, s_suppkey + 2000000, CASE WHEN s_suppkey % 30 = 7 THEN 'A12' ELSE '999999' END FROM {supplier} WHERE s_suppkey % 30 IN (4, 7, 11) UNION ALL SELECT 100 + s_suppkey % 60, s_suppkey, CAST(s_suppkey AS STRING) FROM {supplier}
 UNION ALL SELECT 200 + s_suppkey % 8, s_suppkey, CAST(s_suppkey AS STRING) FROM {supplier}"""
VIEWS["o_compared"] = """SELECT request, code, row_number() OVER (PARTITION BY request ORDER BY first, code) AS place, CASE WHEN max(bad) OVER (PARTITION BY request) = 1 THEN 'bad_code' WHEN count(*) OVER (PARTITION BY request) < 2 THEN 'too_few' WHEN count(*) OVER (PARTITION BY request) > 6 THEN 'too_many' ELSE 'ok' END AS status
 FROM (SELECT request, CASE WHEN trim(code) = 'A12' THEN 'A12' ELSE lpad(trim(code), 6, '0') END AS code, min(place) AS first, max(CASE WHEN trim(code) = 'A12' THEN 1 ELSE 0 END) AS bad FROM asked_codes GROUP BY 1, 2) x"""


@query("q_compare", f"SELECT q.request, CAST(q.place AS INTEGER) AS place, q.code, q.status, CASE WHEN q.status = 'ok' THEN f.code IS NOT NULL END AS found, CASE WHEN q.status = 'ok' THEN round({FACTOR_SQL['fac_mcap_official']}, 6) END AS fac_mcap_official FROM o_compared q LEFT JOIN o_fields f ON q.code = f.code")
def _(v):
    known = evaluated(v, ["fac_mcap_official"]).select("code", F.lit(True).alias("there"), F.round("fac_mcap_official", 6).alias("fac_mcap_official"))
    ok = F.col("status") == "ok"
    rows = screen.compared_codes(v("asked_codes")).join(known, "code", "left")
    return rows.select("request", "place", "code", "status", F.when(ok, F.col("there").isNotNull()).alias("found"), F.when(ok, F.col("fac_mcap_official")).alias("fac_mcap_official"))


@query("q_prices", f"""SELECT code, d, 'bar' AS kind, open, close, volume, CAST(NULL AS DECIMAL(20,8)) AS ratio FROM bars WHERE d BETWEEN {D} - 365 AND {D} UNION ALL
 SELECT code, effective_date, action_type, NULL, NULL, NULL, ratio FROM {chain('actions', 'announced_date')} a WHERE effective_date BETWEEN {D} - 365 AND {D}""")
def _(v):
    bars, actions = screen.prices(v("bars"), v("actions"), AS_OF, 365)
    rows = bars.select("code", "d", F.lit("bar").alias("kind"), "open", "close", "volume")
    return rows.unionByName(actions.select("code", F.col("effective_date").alias("d"), F.col("action_type").alias("kind"), "ratio"), allowMissingColumns=True)


@query("q_financial_series", """SELECT g.code, g.account, g.period, p.value FROM (SELECT a.code, a.account, q.period FROM (SELECT DISTINCT code, account FROM o_periods) a JOIN (SELECT DISTINCT code, period FROM o_periods) q ON a.code = q.code) g
 LEFT JOIN o_periods p ON g.code = p.code AND g.account = p.account AND g.period = p.period""")
def _(v):
    rows = pit.financial_periods(v("statements"), AS_OF, ["code", "account"]).select("code", "account", "period", "value")
    grid = rows.select("code", "account").distinct().join(rows.select("code", "period").distinct(), "code")
    return grid.join(rows, ["code", "account", "period"], "left")


@query("q_conflicts", """SELECT code, d, field, difference FROM (SELECT coalesce(a.code, b.code) AS code, coalesce(a.d, b.d) AS d, CASE WHEN a.code IS NULL THEN 'missing_first' WHEN b.code IS NULL THEN 'missing_second' END AS field, CAST(NULL AS DOUBLE) AS difference
 FROM bars a FULL JOIN bars_verify b ON a.code = b.code AND a.d = b.d UNION ALL
 SELECT a.code, a.d, 'close', abs(CAST(a.close AS DOUBLE) - CAST(b.close AS DOUBLE)) / greatest(CAST(a.close AS DOUBLE), CAST(b.close AS DOUBLE)) FROM bars a JOIN bars_verify b ON a.code = b.code AND a.d = b.d) x WHERE field <> 'close' OR difference > 0.001""")
def _(v):
    return screen.conflicts(v("bars"), v("bars_verify"))


VIEWS["run_days"] = "SELECT d AS day, CAST(row_number() OVER (ORDER BY d) AS INT) AS bd_index FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM {events}) x WHERE (dayofweek(d) + {dow}) % 7 NOT IN (0, 6)"
VIEWS["early_runs"] = "SELECT * FROM batch_runs WHERE id % 3 <> 0 OR source <> 'KRX'"
#: One date within the calendar of the runs, and one after it.
NOWS = ("2024-01-25", "2024-06-01")
FRESH = """SELECT s.source, r.id AS batch_id, CAST(DATE '{now}' - r.day AS INTEGER) AS age, r.id IS NULL OR (CASE WHEN s.source = 'KRX' AND r.day BETWEEN (SELECT min(day) FROM run_days) AND (SELECT max(day) FROM run_days) AND DATE '{now}' BETWEEN (SELECT min(day) FROM run_days) AND (SELECT max(day) FROM run_days)
 THEN (SELECT count(*) FROM run_days d WHERE d.day > r.day AND d.day <= DATE '{now}') ELSE greatest(DATE '{now}' - r.day, 0) END > CASE s.source WHEN 'KRX' THEN 3 WHEN 'KOSIS' THEN 45 ELSE 100 END) AS stale, r.status = 'partial' AS partial, DATE '{now}' AS now
 FROM (SELECT DISTINCT source FROM batch_runs UNION ALL SELECT 'ECOS') s LEFT JOIN (SELECT *, CAST(started_at AS DATE) AS day, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS rn FROM batch_runs WHERE status IN ('success', 'partial') AND started_at < DATE '{now}' - 6) r ON r.source = s.source AND r.rn = 1"""


@query("q_data_freshness", " UNION ALL ".join(f"SELECT * FROM ({FRESH.replace('{now}', n)}) x" for n in NOWS))
def _(v):
    runs = v("batch_runs")
    sources = runs.select("source").distinct().union(runs.select(F.lit("ECOS")).limit(1))
    parts = [screen.freshness(runs.where(F.col("started_at") < F.date_sub(F.lit(n).cast("date"), 6)), n, sources, v("run_days")).withColumn("now", F.lit(n).cast("date")) for n in NOWS]
    return parts[0].union(parts[1])


RATES = "(SELECT 'KOSPI' AS market, DATE '1990-01-01' AS effective_from, CAST(0.003 AS DECIMAL(6,4)) AS rate UNION ALL SELECT 'KOSPI', DATE '1998-01-01', 0.0023 UNION ALL SELECT 'KOSDAQ', DATE '1996-01-01', 0.0015)"
VIEWS["rates"] = f"SELECT market, effective_from, CAST(rate AS DECIMAL(6,4)) AS rate FROM {RATES} r"
VIEWS["taxed"] = "SELECT t.id, s.market, t.trade_date, CAST(t.unit_price * t.quantity AS DECIMAL(20,2)) AS amount FROM trades t JOIN securities s ON t.code = s.code WHERE t.side = 'sell'"


@query("q_transaction_tax", """SELECT t.id, r.rate, CAST(CASE WHEN r.rate IS NOT NULL THEN round(t.amount * r.rate, 0) END AS DOUBLE) AS tax FROM taxed t LEFT JOIN
 (SELECT *, lead(effective_from) OVER (PARTITION BY market ORDER BY effective_from) AS until FROM rates) r ON t.market = r.market AND t.trade_date >= r.effective_from AND (r.until IS NULL OR t.trade_date < r.until)""")
def _(v):
    return screen.transaction_tax(v("taxed"), v("rates")).select("id", "rate", F.col("tax").cast("double").alias("tax"))


#: All trades of all users, and beside them portfolios (numbered from 20) of the same users that ended before 1999, after
#: which there are actions.
VIEWS["kept_trades"] = """SELECT * FROM trades UNION ALL SELECT id, user_id + 20 AS user_id, code, side, quantity, unit_price, fee, trade_date FROM trades WHERE trade_date < DATE '1998-12-01'"""
VIEWS["o_trades"] = "SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY trade_date, id) AS n FROM kept_trades"
VIEWS["o_later"] = f"""SELECT p.user_id, p.code, product(a.f) AS f, count(*) FILTER (a.action_type = 'merger') AS noticed FROM (SELECT user_id, code, max(trade_date) AS last FROM kept_trades GROUP BY 1, 2) p
 JOIN {chain('o_values', 'announced_date')} a ON a.code = p.code AND a.effective_date > p.last AND a.effective_date <= {D} AND (a.f IS NOT NULL OR a.action_type = 'merger') GROUP BY 1, 2"""


@query("q_positions", """WITH RECURSIVE walk AS (SELECT user_id, code, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS gain, CAST(0 AS INTEGER) AS over FROM (SELECT DISTINCT user_id, code FROM kept_trades) k UNION ALL
 SELECT w.user_id, w.code, t.n, CASE WHEN side = 'buy' THEN q + t.quantity WHEN t.quantity > q THEN q ELSE q - t.quantity END, CASE WHEN side = 'buy' THEN cost + CAST(unit_price AS DOUBLE) * t.quantity + CAST(fee AS DOUBLE) WHEN t.quantity > q THEN cost ELSE cost - coalesce(cost / nullif(q, 0), 0) * t.quantity END,
 CASE WHEN side = 'buy' OR t.quantity > q THEN gain ELSE gain + (CAST(unit_price AS DOUBLE) - coalesce(cost / nullif(q, 0), 0)) * t.quantity - CAST(fee AS DOUBLE) END, over + CASE WHEN side <> 'buy' AND t.quantity > q THEN 1 ELSE 0 END FROM walk w JOIN o_trades t ON t.user_id = w.user_id AND t.code = w.code AND t.n = w.n + 1)
 SELECT user_id, code, CAST(quantity AS BIGINT) AS quantity, round(cost / nullif(quantity, 0), 2) AS average_cost, round(gain, 2) AS realised, over AS oversold, noticed FROM (SELECT w.*, floor(q / coalesce(l.f, 1) + 1e-9) AS quantity, CAST(coalesce(l.noticed, 0) AS BIGINT) AS noticed
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY n DESC) AS last FROM walk) w LEFT JOIN o_later l ON l.user_id = w.user_id AND l.code = w.code WHERE last = 1) x""")
def _(v):
    rows = screen.positions(v("kept_trades"), v("actions"), AS_OF)
    return rows.select("user_id", "code", "quantity", F.round("average_cost", 2).alias("average_cost"), F.round("realised", 2).alias("realised"), "oversold", "noticed")


# ---- rebalance panel --------------------------------------------------------------------------------------------

VIEWS["span"] = "SELECT DATE '1997-01-01' AS start, DATE '1999-12-31' AS end FROM {region} WHERE r_regionkey = 0"
VIEWS["o_dates"] = "SELECT make_date(y, q * 3, CASE WHEN q IN (1, 4) THEN 31 ELSE 30 END) AS as_of FROM (SELECT unnest([1997, 1998, 1999]) AS y) a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q) b"
VIEWS["o_steps"] = "SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS before, lead(as_of) OVER (ORDER BY as_of) AS next FROM o_dates"
VIEWS["o_members"] = """SELECT t.as_of, s.code, EXISTS (SELECT 1 FROM bars b WHERE b.code = s.code AND b.d <= t.as_of) AS has_price FROM securities s JOIN o_dates t
 ON s.security_type = 'common' AND s.listing_date <= t.as_of AND (s.delisting_date IS NULL OR s.delisting_date > t.as_of)"""
VIEWS["o_known"] = """SELECT t.as_of, r.* FROM o_dates t JOIN statements r ON r.account IN ('basic_eps', 'equity') AND r.effective_date <= t.as_of LEFT JOIN statements s ON r.superseded_by = s.id AND s.effective_date <= t.as_of WHERE s.id IS NULL"""
VIEWS["o_panel8"] = """SELECT *, row_number() OVER (PARTITION BY as_of, code, account ORDER BY period DESC) AS n FROM (SELECT *, row_number() OVER (PARTITION BY as_of, code, account ORDER BY effective_date DESC, period DESC) AS rk FROM (
 SELECT *, row_number() OVER (PARTITION BY as_of, code, account, period ORDER BY effective_date DESC, CAST(id AS VARCHAR) DESC) AS rn FROM o_known) x WHERE rn = 1) y WHERE rk <= 8"""
VIEWS["o_eps_panel"] = """SELECT a.as_of, a.code, sum(CASE WHEN a.fq = 1 THEN a.value ELSE a.value - b.value END) AS eps4 FROM o_panel8 a
 LEFT JOIN o_panel8 b ON a.as_of = b.as_of AND a.code = b.code AND a.account = b.account AND a.fy = b.fy AND a.fq = b.fq + 1 WHERE a.account = 'basic_eps' AND a.n <= 4 GROUP BY a.as_of, a.code
 HAVING count(CASE WHEN a.fq = 1 THEN a.value ELSE a.value - b.value END) = 4"""
VIEWS["o_shares_panel"] = """SELECT t.as_of, c.code, max_by(c.shares, c.effective_date) AS shares FROM o_dates t JOIN market_caps c ON c.effective_date <= t.as_of GROUP BY 1, 2"""
VIEWS["o_treasury_panel"] = """SELECT as_of, code, shares_treasury FROM (SELECT t.as_of, r.*, row_number() OVER (PARTITION BY t.as_of, r.code ORDER BY r.effective_date DESC, r.period DESC, CAST(r.id AS VARCHAR) DESC) AS rk
 FROM o_dates t JOIN treasury r ON r.effective_date <= t.as_of LEFT JOIN treasury s ON r.superseded_by = s.id AND s.effective_date <= t.as_of WHERE s.id IS NULL) x WHERE rk = 1"""
VIEWS["o_acts"] = """SELECT t.as_of, r.code, r.effective_date, r.f FROM o_dates t JOIN o_values r ON r.announced_date <= t.as_of AND r.effective_date <= t.as_of AND r.f IS NOT NULL LEFT JOIN actions s ON r.superseded_by = s.id AND s.announced_date <= t.as_of WHERE s.id IS NULL"""
VIEWS["o_last_bar"] = "SELECT t.as_of, b.code, max(b.d) AS d, max_by(CAST(b.close AS DOUBLE), b.d) AS close FROM o_dates t JOIN bars b ON b.d <= t.as_of AND b.d >= t.as_of - 30 GROUP BY 1, 2"
VIEWS["o_close_panel"] = "SELECT l.as_of, l.code, l.close * coalesce(product(a.f), 1) AS close FROM o_last_bar l LEFT JOIN o_acts a ON a.as_of = l.as_of AND a.code = l.code AND a.effective_date > l.d GROUP BY l.as_of, l.code, l.d, l.close"
VIEWS["o_held"] = """SELECT m.as_of, m.code FROM o_members m JOIN o_eps_panel e ON m.as_of = e.as_of AND m.code = e.code JOIN o_panel8 q ON q.as_of = m.as_of AND q.code = m.code AND q.account = 'equity' AND q.n = 1
 JOIN o_shares_panel c ON c.as_of = m.as_of AND c.code = m.code JOIN o_treasury_panel t ON t.as_of = m.as_of AND t.code = m.code JOIN o_close_panel p ON p.as_of = m.as_of AND p.code = m.code
 WHERE m.has_price AND e.eps4 > 500000 AND (c.shares - t.shares_treasury) * p.close / nullif(CAST(q.value AS DOUBLE), 0) < 2000"""
VIEWS["o_turnover"] = """SELECT as_of, n, CASE WHEN m > 0 THEN dropped / m ELSE 0 END AS sell, CASE WHEN n > 0 THEN added / n ELSE 0 END AS buy FROM (SELECT s.as_of, CAST((SELECT count(*) FROM o_held h WHERE h.as_of = s.as_of) AS BIGINT) AS n, (SELECT count(*) FROM o_held h WHERE h.as_of = s.before) AS m,
 (SELECT count(*) FROM o_held h WHERE h.as_of = s.as_of AND NOT EXISTS (SELECT 1 FROM o_held p WHERE p.as_of = s.before AND p.code = h.code)) AS added,
 (SELECT count(*) FROM o_held h WHERE h.as_of = s.before AND NOT EXISTS (SELECT 1 FROM o_held p WHERE p.as_of = s.as_of AND p.code = h.code)) AS dropped FROM o_steps s) x"""
VIEWS["o_cost"] = "SELECT as_of, n, sell, buy, sell * (0.0015 + 0.00015) + buy * 0.00015 AS cost FROM o_turnover"
VIEWS["o_picks"] = """SELECT h.as_of, s.next, h.code, max(b.d) FILTER (b.d <= h.as_of) AS da, max_by(CAST(b.close AS DOUBLE), b.d) FILTER (b.d <= h.as_of) AS ca, max(b.d) AS db, max_by(CAST(b.close AS DOUBLE), b.d) AS cb
 FROM o_held h JOIN o_steps s ON h.as_of = s.as_of AND s.next IS NOT NULL JOIN bars b ON b.code = h.code AND b.d <= s.next AND b.d >= DATE '1997-01-01' GROUP BY 1, 2, 3"""
VIEWS["o_gain"] = """SELECT s.as_of, coalesce(avg(g.gain), 0) AS period_return FROM (SELECT as_of FROM o_steps WHERE next IS NOT NULL) s LEFT JOIN (SELECT p.as_of, p.code, cb * coalesce(product(a.f) FILTER (a.effective_date > p.db), 1) / (ca * coalesce(product(a.f) FILTER (a.effective_date > p.da), 1)) - 1 AS gain
 FROM o_picks p LEFT JOIN o_acts a ON a.as_of = p.next AND a.code = p.code WHERE ca > 0 GROUP BY p.as_of, p.code, p.ca, p.cb, p.da, p.db) g ON s.as_of = g.as_of GROUP BY s.as_of"""
VIEWS["o_curve"] = "SELECT as_of, product((1 - cost) * (1 + r)) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT c.as_of, c.cost, coalesce(lag(g.period_return) OVER (ORDER BY c.as_of), 0) AS r FROM o_cost c LEFT JOIN o_gain g ON c.as_of = g.as_of) x"


def dates(v):
    return cal.rebalance_dates(v("span"), quarterly=True).select(F.col("day").alias("as_of"))


def members(v):
    return rebalance.universe(v("securities"), dates(v))


START = "1997-01-01"


def held(v):
    return rebalance.holdings(v, pit.Moment(panel=dates(v)), CONDITIONS)


def near(v):
    return v("bars").where(F.col("d") >= F.lit(START).cast("date"))


@query("bt_holdings", "SELECT as_of, code FROM o_held", kept=FACTS)
def _(v):
    return held(v)


#: Bars of which some codes have none before the middle of 1998.
VIEWS["late_bars"] = "SELECT * FROM bars WHERE CAST(code AS INT) % 9 <> 4 OR d > DATE '1998-06-01'"
VIEWS["o_late_members"] = VIEWS["o_members"].replace("FROM bars b", "FROM late_bars b")


@query("bt_missing_price", """SELECT as_of, members, round(missing, 6) AS missing, round(avg(missing) OVER (), 6) AS mean_missing, avg(missing) OVER () = 0 AS survivorship_complete FROM
 (SELECT as_of, CAST(count(*) AS BIGINT) AS members, count(*) FILTER (NOT has_price) / count(*) AS missing FROM o_late_members GROUP BY as_of) x""", kept=FACTS)
def _(v):
    rows = rebalance.missing_prices(rebalance.priced(members(v), v("late_bars")))
    return rows.withColumns({c: F.round(c, 6) for c in ("missing", "mean_missing")})


@query("bt_turnover", "SELECT as_of, n, round(sell, 6) AS sell, round(buy, 6) AS buy, round(avg((sell + buy) / 2) OVER (), 6) AS turnover FROM o_cost", kept=FACTS)
def _(v):
    rows = rebalance.mean_turnover(rebalance.turnover(held(v), dates(v)))
    return rows.select("as_of", "n", *(F.round(c, 6).alias(c) for c in ("sell", "buy", "turnover")))


@query("bt_cost_drag", "SELECT as_of, round(cost, 8) AS cost FROM o_cost", kept=FACTS)
def _(v):
    return rebalance.turnover(held(v), dates(v)).select("as_of", F.round("cost", 8).alias("cost"))


@query("bt_period_return", "SELECT as_of, round(period_return, 6) AS period_return FROM o_gain", kept=FACTS)
def _(v):
    return rebalance.period_returns(held(v), near(v), v("actions"), dates(v)).select("as_of", F.round("period_return", 6).alias("period_return"))


def curve(v):
    return rebalance.backtest(v, dates(v), CONDITIONS, START)


@query("bt_equity_curve", "SELECT as_of, round(value, 6) AS value FROM o_curve", kept=FACTS)
def _(v):
    return curve(v).select("as_of", F.round("value", 6).alias("value"))


@query("bt_stats", """SELECT round(max_by(value, as_of) - 1, 6) AS cumulative_return, round(min(value / peak - 1), 6) AS max_drawdown, round(stddev_samp(r) * 2, 6) AS volatility,
 round(CASE WHEN max_by(value, as_of) > 0 THEN pow(max_by(value, as_of), 1 / ((max(as_of) - min(as_of)) / 365.25)) - 1 END, 6) AS cagr, CAST(count(*) AS BIGINT) AS rebalances FROM
 (SELECT *, max(value) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS peak, value / lag(value) OVER (ORDER BY as_of) - 1 AS r FROM o_curve) x""", kept=FACTS)
def _(v):
    return rebalance.stats(curve(v), 4).select(*(F.round(c, 6).alias(c) for c in ("cumulative_return", "max_drawdown", "volatility", "cagr")), "rebalances")
