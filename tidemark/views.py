"""Views that give the given tables the shape of the domain: securities, bars, actions, statements, macro series.

Each view is one SQL text for both engines, so that a query and its oracle start from the same rows. Only what the
engines spell differently is filled in per engine: how the tables are named, what dayofweek counts from, and
integer division. Where a text would have Spark compare all pairs of rows, it has one of its own with the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "securities": """SELECT s_suppkey AS id, lpad(CAST(s_suppkey AS STRING), 6, '0') AS code, s_name AS name,
 CASE s_nationkey % 3 WHEN 0 THEN 'KOSPI' WHEN 1 THEN 'KOSDAQ' ELSE 'KONEX' END AS market,
 DATE '1995-01-01' + CAST((s_suppkey * 37) % 900 AS INT) AS listing_date,
 CASE WHEN s_suppkey % 11 = 3 THEN DATE '1999-01-01' + CAST((s_suppkey * 13) % 700 AS INT) END AS delisting_date,
 CASE s_suppkey % 10 WHEN 0 THEN 'preferred' WHEN 1 THEN 'etf' WHEN 2 THEN 'reit' ELSE 'common' END AS security_type
 FROM {supplier}""",
    "bars": """SELECT code, d, min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close,
 CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(px) AS DECIMAL(28,2)) AS trading_value FROM (
 SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS code, CAST(l_shipdate AS DATE) AS d,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS px, CAST(l_quantity AS BIGINT) AS qty,
  l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS k FROM {lineitem}) x GROUP BY code, d""",
    "bars_verify": """SELECT code, d, open, high, low, CASE WHEN volume % 97 = 0 THEN CAST(close * 1.002 AS DECIMAL(18,2)) ELSE close END AS close,
 volume, trading_value FROM bars WHERE (volume + day(d)) % 50 <> 0""",
    "traded_bars": "SELECT code, d, trading_value FROM bars",
    "calendar": """SELECT d AS day, CAST(row_number() OVER (ORDER BY d) AS INT) AS bd_index FROM (SELECT DISTINCT d FROM bars WHERE (dayofweek(d) + {dow}) % 7 NOT IN (0, 6)) x""",
    # every tenth order as an action of some security; every seventh of these corrected by a cash dividend
    "actions": """SELECT id, code, action_type, announced_date, effective_date, ratio,
 CASE WHEN action_type = 'cash_dividend' AND id % 3 <> 0 THEN CAST(price AS DECIMAL(20,8)) END AS cash_amount, superseded_by,
 CASE WHEN action_type = 'rights_issue' THEN concat('{"theoretical_ex_price":"', CAST(CAST(price * CASE WHEN id % 3 < 2 THEN 0.9 ELSE 0.8 END AS DECIMAL(18,2)) AS STRING),
   '","previous_close":"', CAST(price AS STRING), '","subscription_price":"', CAST(CAST(price * 0.4 AS DECIMAL(18,2)) AS STRING), '","subscription_ratio":"0.2"}')
  WHEN action_type = 'stock_dividend' THEN '{"dividend_ratio":"0.25"}'
  WHEN action_type = 'cash_dividend' AND id % 3 = 0 THEN concat('{"per_share":"', CASE WHEN id % 9 = 0 THEN 'none' ELSE CAST(price AS STRING) END, '"}') END AS details FROM (
 SELECT o_orderkey * 2 AS id, lpad(CAST(o_custkey % n AS STRING), 6, '0') AS code,
  CASE (o_orderkey {div} 10) % 8 WHEN 0 THEN 'split' WHEN 1 THEN 'reverse_split' WHEN 2 THEN 'bonus_issue' WHEN 3 THEN 'merger' WHEN 4 THEN 'rights_issue' WHEN 5 THEN 'stock_dividend' ELSE 'cash_dividend' END AS action_type,
  CAST(o_orderdate AS DATE) AS announced_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS effective_date,
  CAST(2 AS DECIMAL(20,8)) AS ratio, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
  CASE WHEN o_orderkey % 70 = 0 THEN o_orderkey * 2 + 1 END AS superseded_by FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) s WHERE o_orderkey % 10 = 0
 UNION ALL
 SELECT o_orderkey * 2 + 1, lpad(CAST(o_custkey % n AS STRING), 6, '0'), 'cash_dividend', CAST(o_orderdate AS DATE) + 20,
  CAST(o_orderdate AS DATE) + 30, CAST(2 AS DECIMAL(20,8)), CAST(o_totalprice AS DECIMAL(18,2)), CAST(NULL AS BIGINT) FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) s WHERE o_orderkey % 70 = 0) x""",
    "macro": """SELECT o_orderpriority AS indicator_id, m AS reference_date, m + CAST(35 + 60 * v AS INT) AS vintage_date,
 CAST(value + v AS DECIMAL(28,2)) AS value FROM (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
 sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM {orders} GROUP BY 1, 2) q CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) r""",
    "trades": """SELECT l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS id, l_orderkey % 20 AS user_id, lpad(CAST(l_suppkey AS STRING), 6, '0') AS code,
 CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price, CAST(l_tax AS DECIMAL(18,2)) AS fee, CAST(l_shipdate AS DATE) AS trade_date FROM {lineitem}""",
    "batch_runs": """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'KRX' WHEN 'click' THEN 'DART' WHEN 'purchase' THEN 'FSC' ELSE 'KOSIS' END AS source,
 ts AS started_at, CASE WHEN event_type = 'error' THEN 'skipped' WHEN value > 100 THEN 'partial' ELSE 'success' END AS status FROM {events}""",
    # numbered within each day, then by the days before it: a source's batches never meet in one task
    "batch_order": """SELECT r.id, r.source, CAST(r.n + c.before AS INT) AS place, CAST(c.of AS INT) AS of FROM (
 SELECT id, source, CAST(started_at AS DATE) AS day, row_number() OVER (PARTITION BY source, CAST(started_at AS DATE) ORDER BY started_at, id) AS n FROM batch_runs) r JOIN (
 SELECT source, day, sum(k) OVER (PARTITION BY source ORDER BY day) - k AS before, sum(k) OVER (PARTITION BY source) AS of FROM (
 SELECT source, CAST(started_at AS DATE) AS day, count(*) AS k FROM batch_runs GROUP BY source, CAST(started_at AS DATE)) q) c ON r.source = c.source AND r.day = c.day""",
    "loaded_statements": """SELECT s.*, b.id AS batch_id, b.place AS loaded FROM statements s JOIN batch_order b ON b.source = 'DART' AND b.place = s.id % b.of + 1""",
    "loaded_bars": """SELECT s.*, b.id AS batch_id, b.place AS loaded FROM bars s JOIN batch_order b ON b.source = 'KRX' AND b.place = s.volume % b.of + 1""",
    # quarterly sums of orders per customer as statements of five accounts; every fifth customer restated
    "statements": """SELECT id * 10 + k AS id, code, CASE k WHEN 0 THEN 'basic_eps' WHEN 1 THEN 'net_income' WHEN 2 THEN 'equity' WHEN 3 THEN 'dividends_paid' ELSE 'depreciation' END AS account,
 fy, fq, period, effective_date, CAST(CASE k WHEN 0 THEN v WHEN 1 THEN v * 3 - 400000 WHEN 2 THEN v + 1000 * fy WHEN 3 THEN -v ELSE v * 2 END AS DECIMAL(28,2)) AS value, superseded_by * 10 + k AS superseded_by FROM (
 SELECT c * 1000000 + fy * 100 + fq * 10 + r AS id, lpad(CAST(c AS STRING), 6, '0') AS code, fy, fq, concat(CAST(fy AS STRING), 'Q', CAST(fq AS STRING)) AS period,
  make_date(fy, fq * 3, 28) + (90 + 30 * r) AS effective_date, CAST(v + 1000 * r AS DECIMAL(28,2)) AS v, CASE WHEN r = 0 AND c % 5 = 0 THEN c * 1000000 + fy * 100 + fq * 10 + 1 END AS superseded_by
 FROM ytd CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1) e WHERE r = 0 OR c % 5 = 0) x
 CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) a""",
    "ytd": """SELECT c, CAST(fy AS INT) AS fy, CAST(fq AS INT) AS fq, CAST(sum(v) OVER (PARTITION BY c, fy ORDER BY fq) AS DECIMAL(28,2)) AS v FROM (
 SELECT o_custkey AS c, year(o_orderdate) AS fy, quarter(o_orderdate) AS fq, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM {orders} GROUP BY 1, 2, 3) q""",
    "market_caps": """SELECT code, d AS effective_date, CAST(close * (1000 + 10 * CAST(code AS INT)) AS DECIMAL(28,2)) AS market_cap, CAST(1000 + 10 * CAST(code AS INT) AS BIGINT) AS shares FROM bars WHERE day(d) > 20""",
    "order_days": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM {orders}",
    "part_texts": "SELECT concat(' ', CAST(l_partkey * 37 AS STRING), ' ') AS k FROM {lineitem}",
    "treasury": """SELECT id, code, period, effective_date, CAST(id % 97 AS BIGINT) AS shares_treasury, superseded_by FROM statements WHERE account = 'basic_eps'""",
}
#: Spark's own texts. A batch of facts is found by its place, for which their number of batches must be known on the facts'
#: side: a condition with both sides' columns on one side of its equality is no key to join by.
LOADED = """SELECT s.*, b.id AS batch_id, b.place AS loaded FROM {facts} s CROSS JOIN (SELECT nullif(count(*), 0) AS of FROM batch_runs WHERE source = '{source}') n
 JOIN batch_order b ON b.source = '{source}' AND b.place = s.{number} % n.of + 1"""
SPARK_VIEWS = {
    # trades are dealt out by the key that they are grouped by, to partitions whose size does not grow with the table: the
    # groups of a few MB of packed rows take a GB of a task's memory, and partitions left to Spark are merged by packed size
    "bars": VIEWS["bars"].replace("(\n SELECT lpad", "(\n SELECT /*+ REPARTITION({parts}, code, d) */ lpad"),
    "loaded_statements": LOADED.format(facts="statements", source="DART", number="id"),
    "loaded_bars": LOADED.format(facts="bars", source="KRX", number="volume"),
}
#: Bytes of the given tables of facts for each partition that facts are dealt out to.
PART_BYTES = 4 << 20
#: The given tables that facts are made of.
SIZED = ("orders", "lineitem")
#: Where a session keeps how many partitions the facts of the folder asked last are dealt out to.
PARTS = "tidemark.parts"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels", "pages", "benchmark", "embeddings")


def needs(text: str, views: Mapping[str, str] = VIEWS) -> list[str]:
    """The views that a text reads, each after those that it reads itself."""
    out: list[str] = []
    for name in views:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            out += [v for v in (*needs(views[name], views), name) if v not in out]
    return out


def spark_texts(name: str) -> dict[str, str]:
    """The texts of a view and of those that it reads, in order, as Spark reads them."""
    views = ChainMap(SPARK_VIEWS, VIEWS)
    return {v: views[v] for v in (*needs(views[name], views), name)}


def fill(text: str, tables: dict[str, str], dow: int, div: str) -> str:
    for name, place in (*tables.items(), ("dow", str(dow)), ("div", div)):
        text = text.replace("{" + name + "}", place)
    return text


def table_name(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A temporary view of a table's files, made once a session: their schema is then read once, not for each view."""
    name = f"tidemark_{zlib.crc32(sf_dir.encode()):08x}_{table}"
    if not spark.catalog.tableExists(name):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return name


def facts_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the given tables that facts are made of; one that is not there has none."""
    jvm, conf, size = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), 0
    for t in SIZED:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    return size


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in as many partitions as facts are dealt out to: a task's share does not grow with the tables."""
    n = rows.sparkSession.conf.get(PARTS, None)
    return rows.repartition(int(n), *keys) if n else rows.repartition(*keys)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    texts = spark_texts(name)
    used = [t for t in TABLES if any("{" + t + "}" in text for text in texts.values())]
    places = {t: table_name(spark, sf_dir, t) for t in used}
    if any("{parts}" in text for text in texts.values()):
        places["parts"] = str(max(spark.sparkContext.defaultParallelism, -(-facts_bytes(spark, sf_dir) // PART_BYTES)))
        spark.conf.set(PARTS, places["parts"])
    parts = ", ".join(f"{v} AS ({fill(text, places, 6, '/')})" for v, text in texts.items())
    return spark.sql(f"WITH {parts} SELECT * FROM {name}")


def oracle(text: str) -> str:
    """A DuckDB text with the views that it reads in front."""
    places = {t: t for t in TABLES}
    parts = [f"{v} AS MATERIALIZED ({fill(VIEWS[v], places, 0, '//')})" for v in needs(text)]
    own = fill(text, places, 0, "//").strip()
    if not parts:
        return own
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {own[15:]}"
    if own.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {own[5:]}"
    return f"WITH {', '.join(parts)} {own}"
