"""Prices adjusted for corporate actions, and total return.

A bar is adjusted by every action in effect strictly after its day and known as of the date asked for. The product
of the later factors is a window over bars and actions of one code, so a whole history is adjusted in one shuffle
on code; dates asked for may be a column (a panel), in which case they are part of the window's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pit

#: What each type of action does to prices.
POLICY = {
    "split": "adjust", "reverse_split": "adjust", "bonus_issue": "adjust", "stock_dividend": "adjust", "rights_issue": "adjust",
    "cash_dividend": "ignore", "treasury_purchase": "ignore", "treasury_cancellation": "ignore", "par_value_change": "ignore", "code_change": "ignore",
    "merger": "detect_merger", "merger_absorption": "detect_merger", "spin_off_personal": "detect_spin_off", "spin_off_business": "detect_spin_off",
}


#: Fixed value: how far a declared theoretical price may be from the recomputed one, relative to the larger.
RIGHTS_TOLERANCE = 0.005


def detail(name: str) -> Column:
    """A number of an action's details, a JSON text; null where it is none."""
    return F.get_json_object("details", f"$.{name}").try_cast("double")


def with_details(actions: DataFrame) -> DataFrame:
    """Actions of a source without details have none."""
    return actions if "details" in actions.columns else actions.withColumn("details", F.lit(None).cast("string"))


def factor() -> Column:
    """The price factor of an action; null where what it needs is missing or impossible, and for other types. A ratio
    in the details goes before the column; a rights issue is its theoretical price over the previous close."""
    kind, given = F.col("action_type"), F.col("ratio").cast("double")
    split = F.coalesce(detail("split_ratio"), given)
    bonus = F.coalesce(detail("bonus_ratio"), detail("dividend_ratio"), given)
    theoretical, previous = detail("theoretical_ex_price"), detail("previous_close")
    return (
        F.when((kind == "split") & (split > 0), 1 / split).when((kind == "reverse_split") & (split > 0), split)
        .when(kind.isin("bonus_issue", "stock_dividend") & (bonus >= 0), 1 / (1 + bonus))
        .when((kind == "rights_issue") & (theoretical > 0) & (previous > 0), theoretical / previous)
    )


def rights_defects(actions: DataFrame) -> DataFrame:
    """id, declared, recomputed of rights issues whose declared theoretical price differs from
    (previous close + subscription price * ratio) / (1 + ratio) by more than RIGHTS_TOLERANCE of the larger."""
    rows = with_details(actions).where("action_type = 'rights_issue'")
    ratio = detail("subscription_ratio")
    recomputed = (detail("previous_close") + detail("subscription_price") * ratio) / (1 + ratio)
    rows = rows.select("id", detail("theoretical_ex_price").alias("declared"), recomputed.alias("recomputed"))
    return rows.where(F.abs(F.col("declared") - F.col("recomputed")) > RIGHTS_TOLERANCE * F.greatest("declared", "recomputed"))


def classified(actions: DataFrame, as_of) -> DataFrame:
    """Actions known as of the date with their class; what is announced but not in effect says so."""
    kind = F.col("action_type")
    policy = F.lit(None).cast("string")
    for name, what in POLICY.items():
        policy = F.when(kind == name, what).otherwise(policy)
    policy = F.when(F.col("effective_date") <= pit.on(as_of), policy).otherwise(F.when(policy == "ignore", policy).otherwise(F.concat(policy, F.lit("_announced"))))
    return pit.active_actions(actions, as_of).withColumn("class", policy)


def day_factors(known: DataFrame, keys: list[str]) -> DataFrame:
    """One factor for each code and day (and key) of actions in effect: actions of a day multiply."""
    rows = with_details(known).withColumn("f", factor()).where("f IS NOT NULL")
    return rows.groupBy(*keys, "code", F.col("effective_date").alias("d")).agg(F.product("f").alias("f"))


def factors(actions: DataFrame, as_of) -> DataFrame:
    return day_factors(pit.active_actions(actions, as_of).where(F.col("effective_date") <= pit.on(as_of)), [])


def adjusted_by(bars: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with ``factor``, the product of the later days' factors, and adjusted prices; volume stays."""
    rows = bars.withColumn("_kind", F.lit(0)).withColumn("f", F.lit(1.0))
    later = Window.partitionBy(*keys, "code").orderBy(F.desc("d"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(days.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("factor", F.product("f").over(later))
    rows = rows.where("_kind = 0").drop("_kind", "f")
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    return rows.withColumns({f"{c}_adjusted": F.col(c).cast("double") * F.col("factor") for c in prices})


def adjusted(bars: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Bars up to as_of with ``factor`` and adjusted open, high, low, close; volume stays."""
    return adjusted_by(pit.visible(bars, as_of, "d"), factors(actions, as_of), [])


def dividend() -> Column:
    """Cash per share of a dividend: the column, else the details' per_share; null where it is none or negative."""
    amount = F.coalesce(F.col("cash_amount").cast("double"), detail("per_share"))
    return F.when(amount >= 0, amount)


def input_errors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """code, error, n: bars given twice, action types without a policy, impossible ratios."""
    twice = bars.groupBy("code", "d").count().where("count > 1").groupBy("code").agg(F.count("*").alias("n")).withColumn("error", F.lit("duplicate_bar"))
    unknown = actions.where(~F.col("action_type").isin(*POLICY)).groupBy("code").agg(F.count("*").alias("n")).withColumn("error", F.lit("unknown_action"))
    wrong = with_details(actions).where(F.col("action_type").isin(*[k for k, what in POLICY.items() if what == "adjust"]) & factor().isNull()).groupBy("code").agg(F.count("*").alias("n")).withColumn("error", F.lit("bad_ratio"))
    return twice.unionByName(unknown).unionByName(wrong).select("code", "error", "n")


def dividends_by_day(series: DataFrame, dividends: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``series`` (adjusted bars) with ``dividend``: the day's cash per share; none on a code's first bar. Dividends
    on days without a bar, or below zero, are left out."""
    cash = with_details(dividends).withColumn("_cash", dividend()).where("_cash IS NOT NULL").groupBy(*keys, "code", F.col("effective_date").alias("d")).agg(F.sum("_cash").alias("dividend"))
    first = F.row_number().over(Window.partitionBy(*keys, "code").orderBy("d")) == 1
    return series.join(cash, [*keys, "code", "d"], "left").withColumn("dividend", F.when(first, 0.0).otherwise(F.coalesce("dividend", F.lit(0.0))))


def total_return(series: DataFrame, dividends: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``series`` with ``dividend`` and ``index``: 1 on the first bar, then times (adjusted close + dividend brought
    to adjusted terms) / previous adjusted close; null from a zero price on."""
    w = Window.partitionBy(*keys, "code").orderBy("d")
    rows = dividends_by_day(series, dividends, keys).withColumn("_before", F.lag("close_adjusted").over(w))
    gain = F.try_divide(F.col("close_adjusted") + F.try_divide(F.col("dividend") * F.col("close_adjusted"), F.col("close").cast("double")), F.col("_before"))
    rows = rows.withColumn("_gain", F.when(F.col("_before").isNull(), 1.0).otherwise(gain))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.count_if(F.col("_gain").isNull()).over(upto) > 0
    return rows.withColumn("index", F.when(~broken, F.product("_gain").over(upto))).drop("_before", "_gain")
