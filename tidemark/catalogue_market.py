"""Queries on adjusted prices, fields, factors, screens and rebalance panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue import AS_OF, LISTED, PERIODS, chain, query
from tidemark.functions import formulas
from tidemark.operators import adjust, pit
from tidemark.plans import factors
from tidemark.plans import fields as fld
from tidemark.views import VIEWS

D = "DATE '1999-06-30'"


def r6(column: str):
    return F.round(F.col(column), 6).alias(column)


# ---- views of the oracles: the same facts written independently in SQL ------------------------------------------

VIEWS["o_values"] = """SELECT *, CASE action_type WHEN 'split' THEN 1 / CAST(ratio AS DOUBLE) WHEN 'reverse_split' THEN CAST(ratio AS DOUBLE) WHEN 'bonus_issue' THEN 1 / (1 + CAST(ratio AS DOUBLE))
  WHEN 'stock_dividend' THEN 1 / (1 + TRY_CAST(json_extract_string(details, '$.dividend_ratio') AS DOUBLE))
  WHEN 'rights_issue' THEN TRY_CAST(json_extract_string(details, '$.theoretical_ex_price') AS DOUBLE) / TRY_CAST(json_extract_string(details, '$.previous_close') AS DOUBLE) END AS f,
 coalesce(CAST(cash_amount AS DOUBLE), TRY_CAST(json_extract_string(details, '$.per_share') AS DOUBLE)) AS cash FROM actions"""
VIEWS["o_factors"] = f"SELECT code, effective_date AS d, product(f) AS f FROM {chain('o_values', 'announced_date')} a WHERE effective_date <= {D} AND f IS NOT NULL GROUP BY code, effective_date"
VIEWS["o_adjusted"] = f"""SELECT b.code, b.d, b.volume, CAST(b.open AS DOUBLE) AS open, CAST(b.close AS DOUBLE) AS close, coalesce(product(f.f), 1) AS factor
 FROM (SELECT * FROM bars WHERE d <= {D}) b LEFT JOIN o_factors f ON f.code = b.code AND f.d > b.d GROUP BY b.code, b.d, b.volume, b.open, b.close"""
VIEWS["o_cash"] = f"SELECT code, effective_date AS d, sum(cash) AS cash FROM {chain('o_values', 'announced_date')} a WHERE action_type = 'cash_dividend' AND effective_date <= {D} AND cash >= 0 GROUP BY code, effective_date"


def returns(where: str) -> str:
    return f"""SELECT code, d, adj, close, dividend, product(gain) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS idx FROM (
 SELECT code, d, adj, close, dividend, CASE WHEN prev IS NULL THEN 1 ELSE (adj + dividend * adj / close) / prev END AS gain FROM (
 SELECT a.code, a.d, a.close * a.factor AS adj, a.close, lag(a.close * a.factor) OVER (PARTITION BY a.code ORDER BY a.d) AS prev,
  CASE WHEN row_number() OVER (PARTITION BY a.code ORDER BY a.d) = 1 THEN 0 ELSE coalesce(c.cash, 0) END AS dividend
 FROM o_adjusted a LEFT JOIN o_cash c ON a.code = c.code AND a.d = c.d WHERE {where}) x) y"""


VIEWS["o_returns"] = returns("TRUE")
VIEWS["o_returns_1y"] = returns(f"a.d >= {D} - 365")
VIEWS["o_periods"] = f"SELECT * FROM {PERIODS} p"
VIEWS["o_series"] = """SELECT code, account, CASE WHEN count(sv) = 4 THEN max(CASE WHEN n = 1 THEN sv END) END AS s1, CASE WHEN count(sv) = 4 THEN max(CASE WHEN n = 2 THEN sv END) END AS s2,
 CASE WHEN count(sv) = 4 THEN max(CASE WHEN n = 3 THEN sv END) END AS s3, CASE WHEN count(sv) = 4 THEN max(CASE WHEN n = 4 THEN sv END) END AS s4, CASE WHEN count(sv) = 4 THEN sum(sv) END AS total FROM (
 SELECT a.code, a.account, a.n, CASE WHEN a.fq = 1 OR a.account NOT IN ('basic_eps', 'net_income') THEN a.value ELSE a.value - b.value END AS sv
 FROM (SELECT *, row_number() OVER (PARTITION BY code, account ORDER BY period DESC) AS n FROM o_periods) a
 LEFT JOIN o_periods b ON a.code = b.code AND a.account = b.account AND a.fy = b.fy AND a.fq = b.fq + 1 WHERE a.n <= 4) x GROUP BY code, account"""
VIEWS["o_singles"] = """SELECT a.code, a.account, a.n, CASE WHEN a.fq = 1 THEN a.value ELSE a.value - b.value END AS sv FROM (SELECT *, row_number() OVER (PARTITION BY code, account ORDER BY period DESC) AS n FROM o_periods WHERE account = 'basic_eps') a
 LEFT JOIN o_periods b ON a.code = b.code AND a.account = b.account AND a.fy = b.fy AND a.fq = b.fq + 1"""
VIEWS["o_runs"] = "SELECT code, CASE WHEN count(sv) FILTER (n <= 2) = 2 THEN CAST(sum(sv) FILTER (n <= 2) AS DOUBLE) END AS eps2, CASE WHEN count(sv) FILTER (n <= 7) = 7 THEN CAST(sum(sv) FILTER (n <= 7) AS DOUBLE) END AS eps7 FROM o_singles GROUP BY code"
VIEWS["o_ranked"] = "SELECT code, account, value, row_number() OVER (PARTITION BY code, account ORDER BY period DESC) AS n FROM o_periods"
VIEWS["o_cap"] = f"SELECT code, market_cap, shares FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY effective_date DESC) AS rn FROM market_caps WHERE effective_date <= {D}) x WHERE rn = 1"
VIEWS["o_treasury"] = f"""SELECT code, shares_treasury FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY effective_date DESC, period DESC, CAST(id AS VARCHAR) DESC) AS rk FROM (
 SELECT *, row_number() OVER (PARTITION BY code, period ORDER BY effective_date DESC, CAST(id AS VARCHAR) DESC) AS rn FROM {chain('treasury')} a) x WHERE rn = 1) y WHERE rk = 1"""
VIEWS["o_close"] = f"SELECT code, max_by(close * factor, d) AS close_price_adjusted FROM o_adjusted WHERE d >= {D} - 30 GROUP BY code"
VIEWS["o_traded"] = f"""SELECT code, CAST(sum(trading_value) AS DOUBLE) / 20 AS trading_value_20d_avg FROM bars WHERE d IN (SELECT day FROM calendar WHERE day <= {D} ORDER BY day DESC LIMIT 20) GROUP BY code HAVING count(*) = 20"""
VIEWS["o_dps"] = f"SELECT code, sum(cash) AS dps FROM {chain('o_values', 'announced_date')} a WHERE action_type = 'cash_dividend' AND effective_date <= {D} AND effective_date > {D} - 365 AND cash >= 0 GROUP BY code"
VIEWS["o_year"] = f"SELECT code, max_by(idx, d) - 1 AS total_return FROM o_returns_1y GROUP BY code HAVING min(d) <= {D} - 340"
VIEWS["o_fields"] = f"""SELECT s.code, s.security_type, c.close_price_adjusted, t.trading_value_20d_avg, CAST(m.market_cap AS DOUBLE) AS cap, CAST(m.shares AS DOUBLE) AS shares, CAST(y.shares_treasury AS DOUBLE) AS treasury,
 CAST(e.total AS DOUBLE) AS eps4, CAST(i.total AS DOUBLE) AS income4, CAST(q1.value AS DOUBLE) AS equity, CAST(q2.value AS DOUBLE) AS equity_begin, CAST(abs(p.value) AS DOUBLE) AS paid, CAST(z.total AS DOUBLE) AS depreciation, d.dps, r.total_return, n.eps2, n.eps7
 FROM (SELECT code, security_type FROM securities WHERE {LISTED}) s LEFT JOIN o_close c ON s.code = c.code LEFT JOIN o_traded t ON s.code = t.code LEFT JOIN o_cap m ON s.code = m.code LEFT JOIN o_treasury y ON s.code = y.code
 LEFT JOIN o_series e ON s.code = e.code AND e.account = 'basic_eps' LEFT JOIN o_series i ON s.code = i.code AND i.account = 'net_income' LEFT JOIN o_ranked q1 ON s.code = q1.code AND q1.account = 'equity' AND q1.n = 1
 LEFT JOIN o_ranked q2 ON s.code = q2.code AND q2.account = 'equity' AND q2.n = 2 LEFT JOIN o_ranked p ON s.code = p.code AND p.account = 'dividends_paid' AND p.n = 1
 LEFT JOIN o_series z ON s.code = z.code AND z.account = 'depreciation' LEFT JOIN o_dps d ON s.code = d.code LEFT JOIN o_year r ON s.code = r.code LEFT JOIN o_runs n ON s.code = n.code"""
#: Bars on every business day from a code's first bar on: the last close, and nothing traded without a bar.
VIEWS["o_dense"] = """SELECT s.code, c.day AS d, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.code ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS close, coalesce(b.trading_value, 0) AS trading_value
 FROM (SELECT code, min(d) AS first FROM bars GROUP BY code) s JOIN calendar c ON c.day >= s.first LEFT JOIN bars b ON b.code = s.code AND b.d = c.day"""
VIEWS["o_dense_traded"] = VIEWS["o_traded"].replace("FROM bars", "FROM o_dense")
#: Statements of ten codes that have every quarter, for sums over more quarters than most codes have in a row.
VIEWS["ytd_dense"] = VIEWS["ytd"].replace("o_custkey AS c", "o_custkey % 10 AS c")
VIEWS["dense_statements"] = VIEWS["statements"].replace("FROM ytd", "FROM ytd_dense")
VIEWS["o_dense_periods"] = VIEWS["o_periods"].replace("statements", "dense_statements")
VIEWS["o_dense_singles"] = VIEWS["o_singles"].replace("o_periods", "o_dense_periods")
VIEWS["o_dense_runs"] = VIEWS["o_runs"].replace("o_singles", "o_dense_singles")
MCAP = "((shares - treasury) * close_price_adjusted)"

# ---- adjustment and total return --------------------------------------------------------------------------------


@query("adj_action_factor", "SELECT id, action_type, round(f, 9) AS factor FROM o_values")
def _(v):
    return v("actions").select("id", "action_type", F.round(adjust.factor(), 9).alias("factor"))


@query("adj_rights_check", """SELECT id, round(declared, 4) AS declared, round(recomputed, 4) AS recomputed FROM (SELECT id, CAST(json_extract_string(details, '$.theoretical_ex_price') AS DOUBLE) AS declared,
 (CAST(json_extract_string(details, '$.previous_close') AS DOUBLE) + CAST(json_extract_string(details, '$.subscription_price') AS DOUBLE) * 0.2) / 1.2 AS recomputed FROM actions WHERE action_type = 'rights_issue') x
 WHERE abs(declared - recomputed) / greatest(declared, recomputed) > 0.005""")
def _(v):
    return adjust.rights_defects(v("actions")).select("id", *(F.round(c, 4).alias(c) for c in ("declared", "recomputed")))


@query("adj_classify_events", f"""SELECT id, CASE WHEN action_type = 'cash_dividend' THEN 'ignore' ELSE concat(CASE action_type WHEN 'merger' THEN 'detect_merger' ELSE 'adjust' END, CASE WHEN effective_date <= {D} THEN '' ELSE '_announced' END) END AS class
 FROM {chain('actions', 'announced_date')} a""")
def _(v):
    return adjust.classified(v("actions"), AS_OF).select("id", "class")


@query("adj_unadjusted_jumps", f"SELECT DISTINCT code, effective_date FROM {chain('actions', 'announced_date')} a WHERE action_type = 'merger' AND effective_date <= {D}")
def _(v):
    return adjust.classified(v("actions"), AS_OF).where("class IN ('detect_merger', 'detect_spin_off')").select("code", "effective_date").distinct()


@query("adj_series", "SELECT code, d, round(open * factor + 1e-9, 6) AS open_adjusted, round(close * factor + 1e-9, 6) AS close_adjusted, volume FROM o_adjusted")
def _(v):
    prices = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("open_adjusted", "close_adjusted")]  # halved prices end in a tie
    return adjust.adjusted(v("bars"), v("actions"), AS_OF).select("code", "d", *prices, "volume")


@query("adj_input_errors", """SELECT code, 'bad_ratio' AS error, CAST(count(*) AS BIGINT) AS n FROM actions WHERE id % 12 = 0 AND action_type IN ('split', 'reverse_split', 'bonus_issue', 'rights_issue') GROUP BY code
 UNION ALL SELECT code, 'unknown_action', CAST(count(*) AS BIGINT) FROM actions WHERE id % 11 = 0 GROUP BY code""")
def _(v):
    bad = F.col("id") % 12 == 0
    damaged = v("actions").withColumns({"ratio": F.when(bad, F.col("ratio") * -1).otherwise(F.col("ratio")), "details": F.when(~bad | (F.col("action_type") == "stock_dividend"), F.col("details"))})
    unknown = v("actions").where("id % 11 = 0").withColumn("action_type", F.lit("renamed"))
    return adjust.input_errors(v("bars"), damaged.union(unknown))


@query("adj_identity_flag", f"SELECT s.code, f.code IS NULL AS identity FROM securities s LEFT JOIN (SELECT DISTINCT code FROM o_factors) f ON s.code = f.code")
def _(v):
    own = adjust.factors(v("actions"), AS_OF).select(F.col("code").alias("c")).distinct()
    return v("securities").select("code").join(own, F.col("code") == F.col("c"), "left").select("code", F.col("c").isNull().alias("identity"))


@query("tri_dividends_by_exdate", "SELECT code, d, round(dividend, 6) AS dividend FROM o_returns WHERE dividend > 0")
def _(v):
    rows = adjust.dividends_by_day(adjust.adjusted(v("bars"), v("actions"), AS_OF), pit.dividends(v("actions"), AS_OF))
    return rows.where("dividend > 0").select("code", "d", r6("dividend"))


def returned(v):
    return adjust.total_return(adjust.adjusted(v("bars"), v("actions"), AS_OF), pit.dividends(v("actions"), AS_OF))


@query("tri_index", "SELECT code, d, round(idx, 6) AS index FROM o_returns")
def _(v):
    return returned(v).select("code", "d", r6("index"))


@query("tri_rebased_series", "SELECT code, d, round(first_value(adj) OVER (PARTITION BY code ORDER BY d) * idx + 1e-7, 2) AS value FROM o_returns")
def _(v):
    from pyspark.sql import Window

    first = F.first("close_adjusted").over(Window.partitionBy("code").orderBy("d"))
    return returned(v).select("code", "d", F.round(first * F.col("index") + 1e-7, 2).alias("value"))


# ---- fields -----------------------------------------------------------------------------------------------------


def field_query(name: str, field: str, sql: str) -> None:
    @query(name, f"SELECT code, round({sql}, 6) AS value FROM o_fields")
    def _(v):
        return fld.fields(v, AS_OF, [field]).select("code", F.round(F.col(field).cast("double"), 6).alias("value"))


INCOME, EQUITY = factors.INCOME, factors.EQUITY
for _name, _field, _sql in (
    ("fld_close_adjusted", "close_price_adjusted", "close_price_adjusted"),
    ("fld_market_cap", "market_cap_krx_official", "cap"),
    ("fld_shares", "shares_issued", "shares"),
    ("fld_treasury", "shares_treasury", "treasury"),
    ("fld_fin_scalar", EQUITY, "equity"),
    ("fld_fin_period_begin", f"{EQUITY}_period_begin", "equity_begin"),
    ("fld_fin_annual", f"{INCOME}_annual", "income4"),
    ("fld_dps_ttm", "dividend_per_share_trailing_annual", "dps"),
    ("fld_total_return_1y", "total_return_trailing_1y", "total_return"),
):
    field_query(_name, _field, _sql)


def traded(v):
    """The views with bars on every business day where traded values are asked for."""
    return lambda name: fld.dense_bars(v("bars"), v("calendar")) if name == "traded_bars" else v(name)


@query("fld_trading_value_20d", "SELECT f.code, round(t.trading_value_20d_avg, 6) AS value FROM o_fields f LEFT JOIN o_dense_traded t ON f.code = t.code")
def _(v):
    return fld.fields(traded(v), AS_OF, ["trading_value_20d_avg"]).select("code", F.round("trading_value_20d_avg", 6).alias("value"))


@query("fld_fin_series", "SELECT code, account, s1, s2, s3, s4 FROM o_series")
def _(v):
    rows = fld.quarterly_series(v("statements"), AS_OF)
    return rows.select("code", "account", *(F.get("series", i).cast("decimal(38,2)").alias(f"s{i + 1}") for i in range(4)))


@query("fld_macro", f"SELECT s.code, m.indicator_id, CAST(m.value AS DOUBLE) AS value FROM (SELECT code FROM securities WHERE {LISTED}) s CROSS JOIN (SELECT indicator_id, value FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY reference_date DESC, vintage_date DESC) AS rn FROM macro WHERE reference_date <= {D} AND vintage_date <= {D}) x WHERE rn = 1) m")
def _(v):
    one = pit.latest_macro(v("macro"), AS_OF).select("indicator_id", F.col("value").cast("double").alias("value"))
    return fld.fields(v, AS_OF, []).select("code").crossJoin(F.broadcast(one))  # a handful of indicators


@query("fld_derived_factor", f"SELECT code, round({MCAP}, 4) AS market_cap_ex_treasury FROM o_fields")
def _(v):
    return evaluated(v, ["fac_mcap_ex_treasury"]).select("code", F.round("fac_mcap_ex_treasury", 4).alias("market_cap_ex_treasury"))


# ---- factors ----------------------------------------------------------------------------------------------------


def evaluated(v, names: list[str], trees: dict | None = None, relative: bool = True, types=None):
    """Fields and factors of the listed securities."""
    trees = trees or factors.BUILT_IN
    order, stored = factors.plan(names, trees)
    return formulas.with_factors(fld.fields(v, AS_OF, stored, types), order, relative)


FACTOR_SQL = {
    "fac_mcap_ex_treasury": MCAP,
    "fac_mcap_official": "shares * close_price_adjusted",
    "fac_per_ttm": f"{MCAP} / nullif(income4, 0)",
    "fac_per_annual": f"{MCAP} / nullif(income4, 0)",
    "fac_per_official": "cap / nullif(income4, 0)",
    "fac_pbr": f"{MCAP} / nullif(equity, 0)",
    "fac_roe_ttm": "income4 / nullif((equity_begin + equity) / 2, 0)",
    "fac_eps_ttm": "eps4",
    "fac_dividend_yield": "dps / nullif(close_price_adjusted, 0)",
    "fac_turnover_20d": f"trading_value_20d_avg / nullif({MCAP}, 0)",
    "fac_total_return_1y": "total_return",
    "fac_ffo_multiple_reit": f"{MCAP} / nullif(income4 + depreciation, 0)",
    "fac_dividend_yield_reit": f"paid / nullif({MCAP}, 0)",
}


def factor_query(name: str) -> None:
    @query(name, f"SELECT code, round({FACTOR_SQL[name]}, 6) AS value, ({FACTOR_SQL[name]}) IS NULL AS missing FROM o_fields")
    def _(v):
        return evaluated(v, [name]).select("code", F.round(name, 6).alias("value"), F.col(f"{name}_reason").isNotNull().alias("missing"))


for _name in FACTOR_SQL:
    if _name != "fac_turnover_20d":
        factor_query(_name)
TURNOVER = f"t.trading_value_20d_avg / nullif({MCAP}, 0)"


@query("fac_turnover_20d", f"SELECT f.code, round({TURNOVER}, 6) AS value, ({TURNOVER}) IS NULL AS missing FROM o_fields f LEFT JOIN o_dense_traded t ON f.code = t.code")
def _(v):
    return evaluated(traded(v), ["fac_turnover_20d"]).select("code", F.round("fac_turnover_20d", 6).alias("value"), F.col("fac_turnover_20d_reason").isNotNull().alias("missing"))


EPS = factors.EPS
CLOSE = {"field": "close_price_adjusted"}
#: name -> tree, its value in SQL over o_fields, its reason
TREES = {
    "fx_const": ({"op": "add", "left": CLOSE, "right": {"const": "2.5"}}, "close_price_adjusted + 2.5"),
    "fx_field": (CLOSE, "close_price_adjusted"),
    "fx_add": ({"op": "add", "left": CLOSE, "right": {"field": "shares_treasury"}}, "close_price_adjusted + treasury"),
    "fx_sub": ({"op": "sub", "left": {"field": "shares_issued"}, "right": {"field": "shares_treasury"}}, "shares - treasury"),
    "fx_mul": ({"op": "mul", "left": {"field": "shares_issued"}, "right": {"const": 3}}, "shares * 3"),
    "fx_div": ({"op": "div", "left": CLOSE, "right": {"op": "sub", "left": {"field": "shares_issued"}, "right": {"const": "1100"}}}, "close_price_adjusted / nullif(shares - 1100, 0)"),
    "fx_ratio_pct": ({"op": "ratio_pct", "left": {"field": "market_cap_krx_official"}, "right": {"field": "shares_issued"}}, "cap / nullif(shares, 0)"),
    "fx_sum_last_n_quarters": ({"op": "sum_last_n_quarters", "n": 4, "field": EPS}, "eps4"),
    "fx_sum_last_n_quarters_2": ({"op": "sum_last_n_quarters", "n": 2, "field": EPS}, "eps2"),
    "fx_sum_last_n_quarters_7": ({"op": "sum_last_n_quarters", "n": 7, "field": EPS}, "eps7"),
    "fx_avg": ({"op": "avg", "args": [{"field": f"{EQUITY}_period_begin"}, {"field": EQUITY}, {"field": "shares_issued"}]}, "(equity_begin + equity + shares) / 3"),
    "fx_weighted_sum": ({"op": "weighted_sum", "args": [{"field": EQUITY}, {"field": "shares_issued"}], "weights": ["0.5", "-2"]}, "equity * 0.5 + shares * -2"),
    "fx_winsorize": ({"op": "winsorize", "args": [{"op": "sum_last_n_quarters", "n": 4, "field": EPS}], "lower": "300000", "upper": "900000"}, "CASE WHEN eps4 IS NOT NULL THEN greatest(least(eps4, 900000), 300000) END"),
    "fx_zscore": ({"op": "zscore", "field": EQUITY}, "CASE WHEN count(equity) OVER w > 1 THEN (equity - avg(equity) OVER w) / nullif(stddev_pop(equity) OVER w, 0) END"),
    "fx_percentile": ({"op": "percentile", "field": EQUITY}, "CASE WHEN equity IS NOT NULL THEN 100 * cume_dist() OVER (PARTITION BY security_type, equity IS NULL ORDER BY equity) END"),
    "fx_min_max_scale": ({"op": "min_max_scale", "field": EQUITY}, "(equity - min(equity) OVER w) / nullif(max(equity) OVER w - min(equity) OVER w, 0)"),
}


def tree_query(name: str) -> None:
    tree, sql = TREES[name]

    @query(name, f"SELECT code, round({sql}, 6) AS value FROM o_fields WINDOW w AS (PARTITION BY security_type)")
    def _(v):
        return evaluated(v, [name], {name: tree}).select("code", F.round(name, 6).alias("value"))


for _name in TREES:
    if _name != "fx_sum_last_n_quarters_7":
        tree_query(_name)


@query("fx_sum_last_n_quarters_7", "SELECT f.code, round(n.eps7, 6) AS value FROM o_fields f LEFT JOIN o_dense_runs n ON f.code = n.code")
def _(v):
    view = lambda name: v("dense_statements") if name == "statements" else v(name)
    return evaluated(view, ["x"], {"x": TREES["fx_sum_last_n_quarters_7"][0]}).select("code", F.round("x", 6).alias("value"))



@query("fx_sample_size", "SELECT code, CAST(count(equity) OVER (PARTITION BY security_type) AS BIGINT) AS sample, count(equity) OVER (PARTITION BY security_type) < 30 AS small FROM o_fields")
def _(v):
    rows = evaluated(v, ["x"], {"x": TREES["fx_zscore"][0]})
    return rows.select("code", F.col("x_sample").alias("sample"), (F.col("x_sample") < formulas.SMALL_SAMPLE).alias("small"))


@query("fx_population", "SELECT security_type, CAST(count(*) AS BIGINT) AS members, CAST(count(equity) AS BIGINT) AS valued, round(avg(equity), 6) AS mean FROM o_fields GROUP BY security_type")
def _(v):
    e = F.col(EQUITY).cast("double")
    return fld.fields(v, AS_OF, [EQUITY]).groupBy("security_type").agg(F.count("*").alias("members"), F.count(e).alias("valued"), F.round(F.avg(e), 6).alias("mean"))


@query("fx_na_reason", f"""SELECT code, CASE WHEN trading_value_20d_avg IS NULL THEN 'missing_input:trading_value_20d_avg' WHEN eps4 IS NULL THEN 'insufficient_series:{EPS}:requested=4,got=0' WHEN shares - 1100 = 0 THEN 'division_by_zero' END AS reason FROM
 (SELECT code, coalesce(trading_value_20d_avg, CASE WHEN shares > 1200 THEN 1 END) AS trading_value_20d_avg, eps4, shares FROM o_fields) x""")
def _(v):
    rows = fld.fields(v, AS_OF, ["trading_value_20d_avg", EPS, "shares_issued"])
    rows = rows.withColumn("trading_value_20d_avg", F.coalesce("trading_value_20d_avg", F.when(F.col("shares_issued") > 1200, 1)))
    tree = {"op": "div", "left": {"op": "add", "left": {"field": "trading_value_20d_avg"}, "right": TREES["fx_sum_last_n_quarters"][0]}, "right": TREES["fx_div"][0]["right"]}
    return formulas.with_factors(rows, {"x": tree}).select("code", F.col("x_reason").alias("reason"))


INPUTS = {"op": "div", "left": {"op": "weighted_sum", "args": [{"field": "trading_value_20d_avg"}, {"field": EQUITY}], "weights": ["1", "2"]}, "right": {"field": "shares_issued"}}


@query("fx_inputs_used", f"""SELECT code, 'trading_value_20d_avg' AS input, trading_value_20d_avg IS NOT NULL AS given FROM o_fields UNION ALL
 SELECT code, '{EQUITY}', equity IS NOT NULL FROM o_fields WHERE trading_value_20d_avg IS NOT NULL UNION ALL SELECT code, 'shares_issued', shares IS NOT NULL FROM o_fields""")
def _(v):
    rows = fld.fields(v, AS_OF, ["trading_value_20d_avg", EQUITY, "shares_issued"])
    return rows.select("code", F.explode(formulas.read_inputs(INPUTS)).alias("input", "given"))
