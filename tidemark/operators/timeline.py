"""Prices and returns of a whole panel from running sums: one pass over a code's history answers all its dates.

The factor between two days is the quotient of two running products of a code's action factors, and the total return
between two bars that of two running products of the bars' gains; both are kept as sums of logarithms, which neither
overflow nor depend on the date asked for. What does depend on it are actions that were announced after they took effect
or that a later correction replaces: these few are kept with each code, and those not in force on the date
asked for are taken out of the quotient again. So a bar is stored once, however many dates there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import adjust, pit
from tidemark.sources.stored import together


def action_days(actions: DataFrame) -> DataFrame:
    """code, d (taking effect), lf (log of the price factor, 0 for none), cash (per share, 0 for none), start, until: in
    force on dates from start on and before until; odd: not simply from d on."""
    rows = adjust.with_details(pit.spans(actions, ["code"], "announced_date"))
    start = F.greatest("announced_date", "effective_date")
    cash = F.when(F.col("action_type") == "cash_dividend", adjust.dividend())
    odd = (start > F.col("effective_date")) | F.col("until").isNotNull()
    rows = rows.select("code", F.col("effective_date").alias("d"), F.coalesce(F.ln(adjust.factor()), F.lit(0.0)).alias("lf"), F.coalesce(cash, F.lit(0.0)).alias("cash"), start.alias("start"), "until", odd.alias("odd"))
    return rows.where((F.col("lf") != 0) | (F.col("cash") > 0))


def day_points(bars: DataFrame, days: DataFrame) -> DataFrame:
    """code, d, close (null without a bar), lf, cash: a row for each day with a bar or an action in effect."""
    rows = bars.select("code", "d", F.col("close").cast("double").alias("close"), F.lit(0.0).alias("lf"), F.lit(0.0).alias("cash")).unionByName(days.select("code", "d", F.lit(None).cast("double").alias("close"), "lf", "cash"))
    return together(rows, "code").groupBy("code", "d").agg(F.max("close").alias("close"), F.sum("lf").alias("lf"), F.sum("cash").alias("cash"))


def asked_points(points: DataFrame, asked: DataFrame, forward: bool = False) -> DataFrame:
    """``asked`` (code, day, after, further columns) with bar, the last bar up to the day, or where ``after`` (only
    with ``forward``) the first from it on, and lf, the running sum of factors at the day. bar: d, close, lf, and lg and bad, the running sum
    of the gains' logarithms and the running count of gains that have none (a price of zero)."""
    kind = F.when(F.col("after"), 0).otherwise(2)
    rows = together(points.withColumn("kind", F.lit(1)).unionByName(asked.withColumnRenamed("day", "d").withColumn("kind", kind), allowMissingColumns=True), "code")
    w = Window.partitionBy("code").orderBy("d", "kind")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lf", F.sum(F.coalesce("lf", F.lit(0.0))).over(upto))
    there = F.col("close").isNotNull()
    rows = rows.withColumn("_p", F.last(F.when(there, F.struct("close", "lf")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    second, fine = there & F.col("_p").isNotNull(), (F.col("close") > 0) & (F.col("_p.close") > 0)
    gain = F.ln(F.col("close") + F.col("cash")) - F.ln("_p.close") - (F.col("lf") - F.col("_p.lf"))
    rows = rows.withColumns({"lg": F.when(second & fine, gain).otherwise(0.0), "bad": F.when(second & ~fine, 1).otherwise(0)})
    rows = rows.withColumns({"lg": F.sum("lg").over(upto), "bad": F.sum("bad").over(upto)})
    bar = F.when(there, F.struct("d", "close", "lf", "lg", "bad"))
    rows = rows.withColumns({"_bar": bar, "_found": F.last(bar, ignorenulls=True).over(upto)})
    if forward:  # the other way round, as a frame up to the end would be read anew for each row
        back = Window.partitionBy("code").orderBy(F.desc("d"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_found", F.when(F.col("after"), F.last("_bar", ignorenulls=True).over(back)).otherwise(F.col("_found")))
    own = [c for c in asked.columns if c != "day"]
    return rows.where("kind <> 1").select(*own, F.col("d").alias("day"), F.col("_found").alias("bar"), "lf")


def odd_actions(days: DataFrame, points: DataFrame) -> DataFrame:
    """code, odd: a code's odd actions by day of effect, each with the day's bar and all its cash."""
    entries = days.where("odd").groupBy("code", "d").agg(F.collect_list(F.struct("lf", "cash", "start", "until")).alias("actions"))
    entries = entries.join(points.select("code", "d", "close", F.col("cash").alias("total")), ["code", "d"])
    return entries.groupBy("code").agg(F.collect_list(F.struct("d", "actions", "close", "total")).alias("odd"))


def taken_out(odd: Column, after: Column, upto: Column, as_of: Column) -> tuple[Column, Column]:
    """What the odd actions in effect after one day and up to another, but not in force on a date, have added to the
    running factors between these days, and what leaving them out adds to the logarithm of the return."""

    def off(x: Column, name: str) -> Column:
        gone = F.filter(x["actions"], lambda a: ~((a["start"] <= as_of) & (a["until"].isNull() | (a["until"] > as_of))))
        return F.aggregate(gone, F.lit(0.0), lambda total, a: total + a[name])

    between = F.filter(F.coalesce(odd, F.array().cast(ODD)), lambda x: (x["d"] > after) & (x["d"] <= upto))
    factors = F.aggregate(between, F.lit(0.0), lambda total, x: total + off(x, "lf"))
    paid = F.aggregate(between, F.lit(0.0), lambda total, x: total + F.when(x["close"] > 0, F.ln((x["close"] + x["total"] - off(x, "cash")) / (x["close"] + x["total"]))).otherwise(0.0))
    return factors, factors + paid


ODD = "array<struct<d:date,actions:array<struct<lf:double,cash:double,start:date,until:date>>,close:double,total:double>>"


def price(bar: Column, lf: Column, odd: Column, upto: Column, as_of: Column) -> Column:
    """A bar's close adjusted by the actions in effect after it and up to a day (with running sum ``lf``) that are in force as of a date."""
    return bar["close"] * F.exp(lf - bar["lf"] - taken_out(odd, bar["d"], upto, as_of)[0])


def gained(first: Column, last: Column, odd: Column, as_of: Column) -> Column:
    """The total return from the bar ``first`` to the bar ``last``, plus 1; null where a gain between has none."""
    return F.when(last["bad"] == first["bad"], F.exp(last["lg"] - first["lg"] + taken_out(odd, first["d"], last["d"], as_of)[1]))
