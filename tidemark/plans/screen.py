"""Screens and overviews of one date: conditions on factors over the listed securities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import adjust, pit

#: How far two sources may differ, relative to the larger, before it is told.
TOLERANCE = {"open": 0.001, "high": 0.001, "low": 0.001, "close": 0.001, "volume": 0.001, "trading_value": 0.005}
#: Days after which a source's last load is stale.
STALE_DAYS = {"KRX": 3, "DART": 100, "FSC": 100, "KOSIS": 45}
#: The source whose age counts in business days.
BY_BUSINESS_DAYS = "KRX"


def holds(name: str, op: str, value: float) -> Column:
    x = F.col(name)
    return {"<": x < value, "<=": x <= value, "=": x == value, ">=": x >= value, ">": x > value, "!=": x != value}[op]


def passing(rows: DataFrame, conditions: list[tuple[str, str, float]]) -> DataFrame:
    """Rows for which every condition holds; a missing value passes none."""
    return rows.where(reduce(lambda a, b: a & b, (F.coalesce(holds(*c), F.lit(False)) for c in conditions), F.lit(True)))


def outcomes(rows: DataFrame, conditions: list[tuple[str, str, float]]) -> DataFrame:
    """code, outcome, at: pass, or na or fail by the first condition that does not hold (from 1)."""
    outcome, at = F.lit("pass"), F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(conditions, 1))):
        missing, ok = F.col(c[0]).isNull(), holds(*c)
        outcome = F.when(missing, "na").when(~ok, "fail").otherwise(outcome)
        at = F.when(missing | ~ok, k).otherwise(at)
    return rows.select("code", outcome.alias("outcome"), at.alias("at"))


def overview(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per factor over all rows: count, na_count, mean and quartiles (interpolated), rounded half even to six places, and
    min and max as they are."""
    long = rows.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))).alias("factor", "x"))
    q = [F.percentile("x", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    out = long.groupBy("factor").agg(F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("na_count"), F.avg("x").alias("mean"), *q, F.min("x").alias("min"), F.max("x").alias("max"))
    return out.select("factor", "count", "na_count", *(F.bround(c, 6).alias(c) for c in ("mean", "p25", "median", "p75")), "min", "max")


def conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """code, d, field, difference of bars in which two sources differ by more than TOLERANCE, and the days that one
    of them lacks (field: missing_first or missing_second)."""
    b = second.select("code", "d", *(F.col(c).alias(f"_{c}") for c in TOLERANCE), F.lit(True).alias("_there"))
    rows = first.withColumn("there", F.lit(True)).join(b, ["code", "d"], "full_outer")
    missing = F.when(F.col("there").isNull(), "missing_first").when(F.col("_there").isNull(), "missing_second")
    checks = [F.struct(missing.alias("field"), F.lit(None).cast("double").alias("difference"))]
    for c, most in TOLERANCE.items():
        x, y = F.col(c).cast("double"), F.col(f"_{c}").cast("double")
        gap = F.try_divide(F.abs(x - y), F.nullif(F.greatest(F.abs(x), F.abs(y)), F.lit(0.0)))
        checks.append(F.struct(F.when(gap > most, c).alias("field"), gap.alias("difference")))
    return rows.select("code", "d", F.explode(F.array(*checks)).alias("x")).where("x.field IS NOT NULL").select("code", "d", "x.field", "x.difference")


def freshness(runs: DataFrame, now: str, sources: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per source the newest finished load by (started_at, id): its age in days and whether that is stale; none is
    stale. Bars age by business days after the load's day up to now; where one of the two is outside the calendar
    (day, bd_index), by days."""
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    last = runs.where(F.col("status").isin("success", "partial")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    today = F.lit(now).cast("date")
    rows = sources.join(last, "source", "left").withColumn("_day", F.col("started_at").cast("date")).withColumn("age", F.datediff(today, "_day"))
    bounds = calendar.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))  # one row
    upto = calendar.select("day", "bd_index")
    between = rows.join(F.broadcast(upto), (F.col("day") > F.col("_day")) & (F.col("day") <= today), "left").groupBy("source").agg(F.count("day").alias("_n"))
    rows = rows.join(between, "source").crossJoin(F.broadcast(bounds))
    known = F.col("_day").between(F.col("_first"), F.col("_last")) & today.between(F.col("_first"), F.col("_last"))
    days = F.when((F.col("source") == BY_BUSINESS_DAYS) & known, F.col("_n")).otherwise(F.when(F.col("age") < 0, 0).otherwise(F.col("age")))
    most = F.lit(None).cast("int")
    for s, n in STALE_DAYS.items():
        most = F.when(F.col("source") == s, n).otherwise(most)
    return rows.select("source", F.col("id").alias("batch_id"), "age", F.coalesce(days > most, F.lit(True)).alias("stale"), (F.col("status") == "partial").alias("partial"))


def transaction_tax(trades: DataFrame, rates: DataFrame) -> DataFrame:
    """trades (id, market, trade_date, amount) with the rate in force and the tax, rounded half up to one unit."""
    far = rates.withColumn("to", F.lead("effective_from").over(Window.partitionBy("market").orderBy("effective_from")))
    far = far.select(F.col("market").alias("_m"), "effective_from", "to", "rate")
    on = (F.col("market") == F.col("_m")) & (F.col("trade_date") >= F.col("effective_from")) & (F.col("to").isNull() | (F.col("trade_date") < F.col("to")))
    rows = trades.join(F.broadcast(far), on, "left")  # a rate table has a few rows for each market
    return rows.select("id", "rate", F.when(F.col("amount") >= 0, F.round(F.col("amount") * F.col("rate"), 0)).alias("tax"))


def positions(trades: DataFrame, actions: DataFrame | None = None, as_of=None) -> DataFrame:
    """Per (user_id, code): quantity, average cost, realised gain and oversold, by moving-average cost in the order
    (trade_date, id). A buy adds price * quantity + fee; a sell realises (price - average) * quantity - fee; a sell
    beyond the holding is left out and marks the position. The fold runs within each key's group.

    With ``actions``, those known as of the date that adjust prices after the last trade scale the quantity, rounded
    down, at unchanged cost; ``noticed`` counts mergers and spin-offs after it, which change nothing here."""
    step = F.struct("trade_date", "id", "side", F.col("quantity").cast("double").alias("q"), F.col("unit_price").cast("double").alias("p"), F.col("fee").cast("double").alias("f"))
    rows = trades.groupBy("user_id", "code").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max("trade_date").alias("last"))
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("gain"), F.lit(0).alias("over"))

    def fold(a: Column, s: Column) -> Column:
        buy, short = s["side"] == "buy", (s["side"] == "sell") & (s["q"] > a["q"])
        average = F.coalesce(F.try_divide(a["cost"], F.nullif(a["q"], F.lit(0.0))), F.lit(0.0))
        return F.struct(
            F.when(buy, a["q"] + s["q"]).when(short, a["q"]).otherwise(a["q"] - s["q"]).alias("q"),
            F.when(buy, a["cost"] + s["p"] * s["q"] + s["f"]).when(short, a["cost"]).otherwise(a["cost"] - average * s["q"]).alias("cost"),
            F.when(buy | short, a["gain"]).otherwise(a["gain"] + (s["p"] - average) * s["q"] - s["f"]).alias("gain"),
            (a["over"] + short.cast("int")).alias("over"),
        )

    rows = rows.select("user_id", "code", "last", F.aggregate("steps", zero, fold).alias("x"))
    quantity, noticed = F.col("x.q"), []
    if actions is not None:
        known = adjust.with_details(adjust.classified(actions, as_of)).where(F.col("class").isin("adjust", "detect_merger", "detect_spin_off"))
        known = known.select("code", "effective_date", F.when(F.col("class") == "adjust", adjust.factor()).alias("f"), (F.col("class") != "adjust").alias("_other"))
        later = rows.select("user_id", "code", "last").join(known, "code").where(F.col("effective_date") > F.col("last"))
        later = later.groupBy("user_id", "code").agg(F.product(F.coalesce("f", F.lit(1.0))).alias("_f"), F.count_if("_other").alias("noticed"))
        rows = rows.join(later, ["user_id", "code"], "left")
        quantity, noticed = F.floor(quantity / F.coalesce("_f", F.lit(1.0)) + 1e-9), [F.coalesce("noticed", F.lit(0)).alias("noticed")]
    average = F.try_divide(F.col("x.cost"), F.nullif(quantity.cast("double"), F.lit(0.0)))
    return rows.select("user_id", "code", quantity.cast("long").alias("quantity"), average.alias("average_cost"), F.col("x.gain").alias("realised"), F.col("x.over").alias("oversold"), *noticed)


#: How many codes a comparison has, and how many days a series of prices.
COMPARED, PRICE_DAYS = (2, 6), (1, 3650)


def compared_codes(asked: DataFrame) -> DataFrame:
    """asked (request, place, code as given) -> request, place (from 1), code, status: codes of one to six digits are
    filled up with zeros, repeats go (the first place stays), blanks too; a request with another text, or with fewer
    or more different codes than COMPARED, says so in status (bad_code, too_few, too_many) and is otherwise ok."""
    text = F.trim("code")
    good = text.rlike("^[0-9]{1,6}$")
    rows = asked.where(F.coalesce(text != "", F.lit(False))).withColumn("code", F.when(good, F.lpad(text, 6, "0")).otherwise(text)).withColumn("_bad", ~good)
    rows = rows.groupBy("request", "code").agg(F.min("place").alias("_first"), F.bool_or("_bad").alias("_bad"))
    all_ = Window.partitionBy("request")
    rows = rows.withColumns({"place": F.row_number().over(all_.orderBy("_first", "code")), "_n": F.count("*").over(all_), "_any": F.bool_or("_bad").over(all_)})
    status = F.when(F.col("_any"), "bad_code").when(F.col("_n") < COMPARED[0], "too_few").when(F.col("_n") > COMPARED[1], "too_many").otherwise("ok")
    return rows.select("request", "place", "code", status.alias("status"))


def prices(bars: DataFrame, actions: DataFrame, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(bars, actions) in effect from ``days`` before the date up to it; actions as known on the date."""
    if not PRICE_DAYS[0] <= days <= PRICE_DAYS[1]:
        raise ValueError(f"days from {PRICE_DAYS[0]} to {PRICE_DAYS[1]}")
    start, end = F.date_sub(pit.on(as_of), days), pit.on(as_of)
    return bars.where(F.col("d").between(start, end)), pit.active_actions(actions, as_of).where(F.col("effective_date").between(start, end))


def only_codes(view, codes: DataFrame, how: str = "left_semi"):
    """The views with the rows whose code is (left_semi) or is not (left_anti) among ``codes``; tables without a code
    stay as they are, and so do bars where the calendar is made from them."""

    def run(name: str) -> DataFrame:
        rows = view(name)
        return rows.join(codes.select("code"), "code", how) if "code" in rows.columns else rows

    return run
