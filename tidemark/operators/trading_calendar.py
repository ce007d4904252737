"""Calendar operators. A calendar is a table (day, bd_index) of business days, numbered in order. Joins on it are
against a few thousand rows, the days that markets have had, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_days(calendar: DataFrame, margin: int = 0) -> DataFrame:
    """Every day from the first to the last of the calendar, with the business days at or around it: is_business_day,
    previous_or_same, next_or_same, previous, next, and upto: how many business days there are up to it."""
    ends = calendar.agg((F.min("day") - margin).alias("a"), (F.max("day") + margin).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("d"))
    rows = days.join(calendar, F.col("d") == F.col("day"), "left")
    up = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("d").rowsBetween(1, Window.unboundedFollowing)
    return rows.select(
        "d",
        F.col("day").isNotNull().alias("is_business_day"),
        F.last("day", ignorenulls=True).over(up).alias("previous_or_same"),
        F.first("day", ignorenulls=True).over(down).alias("next_or_same"),
        F.last("day", ignorenulls=True).over(before).alias("previous"),
        F.first("day", ignorenulls=True).over(after).alias("next"),
        F.coalesce(F.max("bd_index").over(up), F.lit(0)).alias("upto"),
    )


#: Days of the year on which markets close, and what other closed days are called.
CLOSED = {
    "01-01": "신정", "03-01": "삼일절", "05-01": "근로자의날 (KRX 휴장)", "05-05": "어린이날", "06-06": "현충일", "08-15": "광복절", "10-03": "개천절", "10-09": "한글날", "12-25": "성탄절", "12-31": "연말 폐장",
}
OTHERWISE_CLOSED = "KRX 휴장 (pykrx 거래일 도출)"


def closed_days(traded: DataFrame, start=None, end=None) -> DataFrame:
    """day, reason: the weekdays from start to end (by default the first and last of ``traded``, the days d of a
    reference instrument that trades whenever the market is open) on which it did not trade."""
    days = traded.select(F.col("d").alias("day")).distinct()
    ends = days.agg((F.min("day") if start is None else F.lit(start).cast("date")).alias("a"), (F.max("day") if end is None else F.lit(end).cast("date")).alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b")).alias("day")).where(~F.dayofweek("day").isin(1, 7))
    names = F.create_map(*(F.lit(x) for kv in CLOSED.items() for x in kv))
    reason = F.coalesce(F.try_element_at(names, F.date_format("day", "MM-dd")), F.lit(OTHERWISE_CLOSED))
    return every.join(days, "day", "left_anti").select("day", reason.alias("reason"))


def with_days(rows: DataFrame, calendar: DataFrame, column: str, *take: str) -> DataFrame:
    """``rows`` with columns of all_days for the date in ``column``."""
    return rows.join(F.broadcast(all_days(calendar).select(F.col("d").alias(column), *take)), column, "left")


def count_between(pairs: DataFrame, calendar: DataFrame, inclusive: str = "both") -> DataFrame:
    """pairs (start, end) with n: business days between, with both ends, the left, the right or neither."""
    days = all_days(calendar)
    ends = {x: F.broadcast(days.select(F.col("d").alias(x), F.col("upto").alias(f"_{x}"), F.col("is_business_day").cast("int").alias(f"_on_{x}"))) for x in ("start", "end")}
    out = pairs.join(ends["start"], "start").join(ends["end"], "end")
    left = F.col("_on_start") if inclusive in ("both", "left") else F.lit(0)
    right = F.lit(0) if inclusive in ("both", "right") else F.col("_on_end")
    return out.select(*pairs.columns, F.greatest(F.col("_end") - F.col("_start") + left - right, F.lit(0)).alias("n"))


def rebalance_dates(spans: DataFrame, quarterly: bool = False) -> DataFrame:
    """Month ends (or quarter ends) within each span (start, end); calendar days, not snapped."""
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    out = spans.select(F.col("start"), F.col("end"), F.explode(months).alias("m")).select("start", "end", F.last_day("m").alias("day"))
    out = out.where(F.col("day").between(F.col("start"), F.col("end")))
    return (out.where(F.month("day") % 3 == 0) if quarterly else out).select("day")


def normalise_as_of(dates: DataFrame, calendar: DataFrame, today: str) -> DataFrame:
    """dates (as_of) with resolved, status: null takes the last business day up to today; a later date than today is
    an error (null); a closed day snaps back; a day outside the calendar falls back to the previous weekday."""
    last = calendar.where(F.col("day") <= F.lit(today).cast("date")).agg(F.max("day").alias("_last"))
    rows = with_days(dates.withColumn("d", F.col("as_of")), calendar, "d", "is_business_day", "previous_or_same").crossJoin(F.broadcast(last))
    weekday = F.col("as_of") - F.when(F.dayofweek("as_of") == 1, 2).when(F.dayofweek("as_of") == 7, 1).otherwise(0)
    status = (
        F.when(F.col("as_of").isNull(), "default").when(F.col("as_of") > F.lit(today).cast("date"), "future").when(F.col("is_business_day"), "exact")
        .when(F.col("previous_or_same").isNotNull(), "snapped").otherwise("outside")
    )
    resolved = F.when(status == "default", F.col("_last")).when(status == "exact", F.col("as_of")).when(status == "snapped", F.col("previous_or_same")).when(status == "outside", weekday)
    return rows.select("as_of", resolved.alias("resolved"), status.alias("status"))


def stale(calendars: DataFrame, now: str, most: int = 365) -> DataFrame:
    """calendars (market, verified) with age in days and whether it is more than ``most``; one never verified is stale."""
    age = F.datediff(F.lit(now).cast("date"), "verified")
    return calendars.select("market", age.alias("age"), F.coalesce(age > most, F.lit(True)).alias("stale"))
