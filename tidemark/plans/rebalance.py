"""A screen evaluated over a whole panel of rebalance dates, and what its portfolios earned.

All dates are one job: as_of is a column of every frame. Facts meet only the dates at which they count (a slice of the
sorted dates), and prices come from running sums over a code's history, so no bar is repeated for a date. Only the last
steps, one row for each date, are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas
from tidemark.operators import timeline
from tidemark.operators.pit import Moment
from tidemark.plans import factors, screen
from tidemark.plans.fields import fields
from tidemark.sources.stored import written

#: Tax and commission of a trade, as shares of its value.
TAX, COMMISSION = 0.0015, 0.00015
DAYS_A_YEAR = 365.25


def universe(securities: DataFrame, dates: DataFrame, types: tuple[str, ...] = ("common",)) -> DataFrame:
    """as_of, code of the securities of these types listed on each date."""
    rows = Moment(panel=dates).holding(securities.where(F.col("security_type").isin(*types)), "listing_date", "delisting_date")
    return rows.select("as_of", "code")


def priced(members: DataFrame, bars: DataFrame) -> DataFrame:
    """The members with has_price: a bar at or before the date. One row per code, its first bar day, decides."""
    first = bars.groupBy("code").agg(F.min("d").alias("_first"))
    return members.join(first, "code", "left").withColumn("has_price", F.coalesce(F.col("_first") <= F.col("as_of"), F.lit(False))).drop("_first")


def missing_prices(members: DataFrame) -> DataFrame:
    """as_of, members, missing (the share of members, as of ``priced``, without a price), and over all dates mean_missing
    and survivorship_complete: whether none was ever missing. One row for each date."""
    rows = members.groupBy("as_of").agg(F.count("*").alias("members"), (F.count_if(~F.col("has_price")) / F.count("*")).alias("missing"))
    rows = rows.withColumn("mean_missing", F.avg("missing").over(Window.partitionBy()))
    return rows.withColumn("survivorship_complete", F.col("mean_missing") == 0)


def mean_turnover(traded: DataFrame) -> DataFrame:
    """``traded`` (of ``turnover``) with turnover: the mean of (sell + buy) / 2 over its dates."""
    return traded.withColumn("turnover", F.avg((F.col("sell") + F.col("buy")) / 2).over(Window.partitionBy()))


def holdings(view, when: Moment, conditions: list[tuple[str, str, float]], trees: dict | None = None, types: tuple[str, ...] = ("common",)) -> DataFrame:
    """The panel's keys and code of listed securities of these types that have a price and meet all conditions on
    factors of the pack ``trees``; a condition on a factor that the pack does not have is met by none."""
    trees = trees or factors.BUILT_IN
    names = [name for name, *_ in conditions]
    if not set(names) <= set(trees):
        return Moment.holding(when, view("securities"), "listing_date").select(*when.keys, "code").where("false")
    order, stored = factors.plan(list(dict.fromkeys(names)), trees)
    rows = fields(view, when, stored, types)
    if "as_of" not in rows.columns:
        rows = rows.join(F.broadcast(when.panel.select(*when.keys, "as_of")), when.keys)
    rows = priced(rows, view("bars")).where("has_price")
    rows = formulas.with_factors(rows, order, population=(*when.keys, "security_type"))
    return screen.passing(rows, conditions).select(*when.keys, "code")


def steps(dates: DataFrame) -> DataFrame:
    """as_of, before, next: a few hundred dates, so one task may order them."""
    w = Window.orderBy("as_of")
    return dates.select("as_of", F.lag("as_of").over(w).alias("before"), F.lead("as_of").over(w).alias("next"))


def turnover(held: DataFrame, dates: DataFrame) -> DataFrame:
    """as_of, n, sell, buy, cost: the shares dropped of the portfolio before and added to this one."""
    order = F.broadcast(steps(dates))
    now = held.withColumn("now", F.lit(1))
    then = held.withColumnRenamed("as_of", "before").join(order.select("as_of", "before"), "before").select("as_of", "code", F.lit(1).alias("then"))
    counts = [F.count("now").alias("n"), F.count("then").alias("m"), F.count_if(F.col("then").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("dropped")]
    rows = now.join(then, ["as_of", "code"], "full_outer").groupBy("as_of").agg(*counts)
    rows = order.select("as_of").join(rows, "as_of", "left").na.fill(0)
    sell, buy = F.coalesce(F.try_divide("dropped", "m"), F.lit(0.0)), F.coalesce(F.try_divide("added", "n"), F.lit(0.0))
    return rows.select("as_of", "n", sell.alias("sell"), buy.alias("buy"), (sell * (TAX + COMMISSION) + buy * COMMISSION).alias("cost"))


def period_returns(held: DataFrame, bars: DataFrame, actions: DataFrame, dates: DataFrame) -> DataFrame:
    """as_of, period_return: the mean of close(next) / close(as_of) - 1 over the holdings; both are the last bars up
    to their dates, adjusted as of the next date by the actions after the bar that are known by then."""
    spans = held.join(F.broadcast(steps(dates).where("next IS NOT NULL").select("as_of", "next")), "as_of").withColumn("after", F.lit(False))
    asked = spans.withColumn("day", F.col("as_of")).unionByName(spans.withColumn("day", F.col("next")))
    days = timeline.action_days(actions)
    points = timeline.day_points(bars, days)
    at = lambda day, what: F.max(F.when(F.col("day") == F.col(day), F.col(what)))
    rows = timeline.asked_points(points, asked).groupBy("as_of", "next", "code").agg(at("as_of", "bar").alias("a"), at("next", "bar").alias("b"), at("next", "lf").alias("lf"))
    rows = rows.where(F.col("a.close") > 0).join(timeline.odd_actions(days, points), "code", "left")
    price = lambda bar: timeline.price(F.col(bar), F.col("lf"), F.col("odd"), F.col("next"), F.col("next"))
    rows = rows.groupBy("as_of").agg(F.avg(F.try_divide(price("b"), F.nullif(price("a"), F.lit(0.0))) - 1).alias("period_return"))
    return steps(dates).where("next IS NOT NULL").select("as_of").join(rows, "as_of", "left").na.fill(0.0)


def equity_curve(traded: DataFrame, returns: DataFrame) -> DataFrame:
    """as_of, value: after each date's cost and before its period's return; 1 before the first."""
    w = Window.orderBy("as_of")
    rows = traded.join(returns, "as_of", "left").withColumn("_r", F.coalesce(F.lag("period_return").over(w), F.lit(0.0)))
    return rows.select("as_of", F.product((1 - F.col("cost")) * (1 + F.col("_r"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def backtest(view, dates: DataFrame, conditions: list[tuple[str, str, float]], start: str, trees: dict | None = None) -> DataFrame:
    """The equity curve of a screen over the dates; returns are measured on bars from ``start`` on. Cutoffs (columns
    cut_KRX, cut_DART of ``dates``) bound what had been loaded. The portfolios, a few rows for each date, are written,
    as three steps read them."""
    whole = view("bars")
    if "loaded" in whole.columns and "cut_KRX" in dates.columns:  # one cutoff for all dates of a back-test
        cut = dates.agg(F.max("cut_KRX").alias("cut")).first().cut
        whole = whole if cut is None else whole.where(F.col("loaded") <= cut)
        whole, view = whole.drop("loaded"), (lambda name, given=view: whole if name == "bars" else given(name))
    held = written(holdings(view, Moment(panel=dates), conditions, trees), "portfolios")
    bars = whole.where(F.col("d") >= F.lit(start).cast("date"))
    return equity_curve(turnover(held, dates.select("as_of")), period_returns(held, bars, view("actions"), dates.select("as_of")))


def stats(curve: DataFrame, per_year: int) -> DataFrame:
    """cumulative_return, max_drawdown, volatility, cagr, rebalances of a curve."""
    w = Window.orderBy("as_of")
    rows = curve.withColumn("_peak", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.col("value") / F.lag("value").over(w) - 1)
    last = F.max_by("value", "as_of")
    years = F.datediff(F.max("as_of"), F.min("as_of")) / DAYS_A_YEAR
    return rows.agg(
        (last - 1).alias("cumulative_return"), F.min(F.col("value") / F.col("_peak") - 1).alias("max_drawdown"), (F.stddev_samp("_r") * per_year**0.5).alias("volatility"),
        F.when((F.count("*") > 1) & (last > 0), F.pow(last, 1 / years) - 1).alias("cagr"), F.count("*").alias("rebalances"),
    )
