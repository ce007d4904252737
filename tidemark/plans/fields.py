"""The named inputs of factors, as one wide frame: a row for each listed security (and key of a panel), a column for
each field asked for. Fields of one source are resolved together: statements once for all their accounts, adjusted
bars once for prices and returns; only the sources of the fields asked for are read. Joins are on code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import adjust, pit, timeline, trading_calendar
from tidemark.operators.pit import Moment

#: Days back for the last close, for trailing sums, and how early a year's first bar must be.
CLOSE_DAYS, YEAR_DAYS, YEAR_START_DAYS = 30, 365, 340
TRADING_DAYS = 20
#: Fixed value: how many periods of an account are resolved.
PERIODS = 8
#: Accounts reported as running totals of the year.
CUMULATIVE = ("basic_eps", "net_income")
#: Fields from statements: account, and what of it: the quarters newest first, the sum of the newest four, the value
#: of the newest or second newest period, or the newest's magnitude.
STATEMENT_FIELDS = {
    "basic_eps_consolidated_ifrs": ("basic_eps", "quarters"),
    "net_income_attributable_consolidated_ifrs": ("net_income", "quarters"),
    "net_income_attributable_consolidated_ifrs_annual": ("net_income", "year"),
    "equity_attributable_to_common_consolidated_ifrs": ("equity", "newest"),
    "equity_attributable_to_common_consolidated_ifrs_period_begin": ("equity", "second"),
    "dividends_paid_annual": ("dividends_paid", "magnitude"),
    "depreciation_expense_annual": ("depreciation", "year"),
}


def resolved_periods(facts: DataFrame, when: Moment, keys: list[str], source: str = "DART") -> DataFrame:
    """The newest active row of each period, then the PERIODS newest periods of each key by (date, period, id text),
    at each moment. ``facts``: with the columns of ``keys``, period, effective_date, id, superseded_by.

    For a panel a fact leaves the resolved periods as soon as so many periods have appeared after its own, which
    bounds how often it is repeated, however long the panel."""
    rows = pit.spans(facts, [*keys, "period"])
    if when.panel is not None and "loaded" not in facts.columns:
        first = F.row_number().over(Window.partitionBy(*keys, "period").orderBy("effective_date", "id")) == 1
        rows = rows.withColumn("_first", first)
        after = F.lead("effective_date", PERIODS).over(Window.partitionBy(*keys, "_first").orderBy("effective_date", "period"))
        rows = rows.withColumn("until", F.when(F.col("_first"), F.least("until", after)).otherwise(F.col("until"))).drop("_first")
    if "loaded" in facts.columns:  # a successor that was loaded after the cutoff is not there yet
        cut = F.col(f"cut_{source}")
        there = F.col("next_loaded").isNotNull() & (cut.isNull() | (F.col("next_loaded") <= cut))
        rows = when.holding(rows, "effective_date", None, source).where(F.col("until").isNull() | ~there | (F.col("until") > when.on))
    else:
        rows = when.holding(rows, "effective_date", "until", source)
    rows = rows.withColumn("_text", F.col("id").cast("string"))
    rows = pit.newest(rows, [*when.keys, *keys, "period"], "effective_date", "_text")
    return pit.newest(rows, [*when.keys, *keys], "effective_date", "period", "_text", n=PERIODS).drop("_text")


def account_arrays(statements: DataFrame, when: Moment, accounts: list[str]) -> DataFrame:
    """A row for each code with an array for each account: its resolved periods (fy, fq, value), newest first."""
    rows = resolved_periods(statements.where(F.col("account").isin(*accounts)), when, ["code", "account"])
    step = F.struct((-F.col("fy") * 10 - F.col("fq")).alias("o"), "fy", "fq", "value")
    arrays = [F.array_sort(F.collect_list(F.when(F.col("account") == a, step))).alias(a) for a in accounts]
    return rows.groupBy(*when.keys, "code").agg(*arrays)


def quarters(periods: Column, cumulative) -> Column:
    """Single quarters, newest first: running totals less the quarter before; null where that is not resolved."""

    def single(x: Column) -> Column:
        before = F.get(F.filter(periods, lambda y: (y["fy"] == x["fy"]) & (y["fq"] == x["fq"] - 1)), 0)["value"]
        whole = F.lit(cumulative) if isinstance(cumulative, bool) else cumulative
        return F.when(~whole | (x["fq"] == 1), x["value"].cast("decimal(38,2)")).otherwise((x["value"] - before).cast("decimal(38,2)"))

    return F.transform(periods, single)


def quarterly_series(statements: DataFrame, as_of, n: int = 4) -> DataFrame:
    """code, account, series: the n newest single quarters, newest first; null as a whole where one is missing."""
    rows = resolved_periods(statements, Moment(as_of), ["code", "account"])
    step = F.struct((-F.col("fy") * 10 - F.col("fq")).alias("o"), "fy", "fq", "value")
    rows = rows.groupBy("code", "account").agg(F.array_sort(F.collect_list(step)).alias("periods"))
    some = F.slice(quarters(F.col("periods"), F.col("account").isin(*CUMULATIVE)), 1, n)
    rows = rows.select("code", "account", some.alias("some"))
    whole = (F.size("some") == n) & F.forall("some", lambda x: x.isNotNull())
    return rows.select("code", "account", F.when(whole, F.col("some")).alias("series"))


def year(series: Column, n: int = 4) -> Column:
    """The sum of the n newest quarters, if all are there."""
    some = F.slice(series, 1, n)
    there = (F.size(some) == n) & F.forall(some, lambda x: x.isNotNull())
    return F.when(there, F.aggregate(some, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)")))


def from_statements(view, when: Moment, names: list[str]) -> DataFrame:
    accounts = list(dict.fromkeys(STATEMENT_FIELDS[n][0] for n in names))
    columns = []
    for name in names:
        account, what = STATEMENT_FIELDS[name]
        value = F.get(F.col(account), 1 if what == "second" else 0)["value"]
        single = quarters(F.col(account), account in CUMULATIVE)
        columns.append({"quarters": single, "year": year(single), "magnitude": F.abs(value)}.get(what, value).alias(name))
    return account_arrays(view("statements"), when, accounts).select(*when.keys, "code", *columns)


def known_actions(view, when: Moment, since_days: int | None = None) -> DataFrame:
    """Actions known and in effect at each moment; ``since_days``: only those in effect within so many days."""
    rows = pit.spans(view("actions"), ["code"], "announced_date")
    start = F.greatest("announced_date", "effective_date")
    end = F.col("until") if since_days is None else F.least("until", F.date_add("effective_date", since_days + 1))
    return when.holding(rows, start, end)


def panel_prices(view, when: Moment, names: list[str]) -> DataFrame:
    """The same for a panel, from running sums: each listed code asks for its last bar at each date and, for returns,
    for its first of the year before."""
    asked = when.holding(view("securities"), "listing_date", "delisting_date").select(*dict.fromkeys([*when.keys, "as_of"]), "code")
    sides = asked.withColumns({"day": F.col("as_of"), "after": F.lit(False)})
    if returns := "total_return_trailing_1y" in names:
        sides = sides.unionByName(asked.withColumns({"day": F.date_sub("as_of", YEAR_DAYS), "after": F.lit(True)}))
    days = timeline.action_days(view("actions"))
    points = timeline.day_points(view("bars"), days)
    side = lambda after, what: F.max(F.when(F.col("after") == after, F.col(what)))
    rows = timeline.asked_points(points, sides, returns).groupBy(*when.keys, "code").agg(F.max("as_of").alias("_on"), side(False, "bar").alias("last"), side(False, "lf").alias("lf"), side(True, "bar").alias("first"))
    rows = rows.join(timeline.odd_actions(days, points), "code", "left")
    on, first, last, odd = (F.col(c) for c in ("_on", "first", "last", "odd"))
    columns = {"close_price_adjusted": F.when(last["d"] >= F.date_sub(on, CLOSE_DAYS), timeline.price(last, F.col("lf"), odd, on, on))}
    if returns:
        year = (first["d"] <= F.date_sub(on, YEAR_START_DAYS)) & (last["d"] >= first["d"])
        columns["total_return_trailing_1y"] = F.when(year, timeline.gained(first, last, odd, on) - 1)
    return rows.select(*when.keys, "code", *(columns[n].alias(n) for n in names))


def from_prices(view, when: Moment, names: list[str]) -> DataFrame:
    """The last adjusted close of CLOSE_DAYS and the total return of a year. One date reads the bars near it once;
    so does a panel whose rows are cut off at what had been loaded, once for each row."""
    if when.panel is not None and "loaded" not in view("bars").columns:
        return panel_prices(view, when, names)
    days = YEAR_DAYS if "total_return_trailing_1y" in names else CLOSE_DAYS
    bars = view("bars").select("code", "d", "close", *(["loaded"] if "loaded" in view("bars").columns else []))
    near = when.holding(bars, "d", F.date_add("d", days + 1), "KRX").drop("loaded")
    known = known_actions(view, when, days)
    rows = adjust.adjusted_by(near, adjust.day_factors(known, when.keys), when.keys)
    last = F.max_by("close_adjusted", "d")
    columns = {"close_price_adjusted": F.when(F.max("d") >= F.date_sub(F.max("_on"), CLOSE_DAYS), last)}
    if "total_return_trailing_1y" in names:
        rows = adjust.total_return(rows, known.where("action_type = 'cash_dividend'"), tuple(when.keys))
        columns["total_return_trailing_1y"] = F.when(F.min("d") <= F.date_sub(F.max("_on"), YEAR_START_DAYS), F.max_by("index", "d") - 1)
    return rows.withColumn("_on", when.on).groupBy(*when.keys, "code").agg(*(columns[n].alias(n) for n in names))


def dense_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """code, d, close, trading_value on every business day from a code's first bar on: where there is no bar, the last
    close and nothing traded. Each bar is repeated up to the next one of its code; a bar on a closed day moves the
    close of the days after it and is no row itself."""
    days = F.broadcast(calendar.select("day", "bd_index"))
    ends = F.broadcast(calendar.agg(F.max("bd_index").alias("_last")))  # one row
    upto = trading_calendar.all_days(calendar).select(F.col("d").alias("_d"), "upto", "is_business_day")
    rows = bars.select("code", "d", "close", "trading_value").join(F.broadcast(upto), F.col("d") == F.col("_d")).crossJoin(ends)
    first = F.col("upto") + F.when(F.col("is_business_day"), 0).otherwise(1)
    rows = rows.withColumn("_from", first).withColumn("_next", F.lead("_from").over(Window.partitionBy("code").orderBy("d")))
    rows = rows.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_last"))).where("_from <= _to")
    rows = rows.withColumn("bd_index", F.explode(F.sequence("_from", "_to"))).join(days, "bd_index")
    return rows.select("code", F.col("day").alias("d"), "close", F.when(F.col("day") == F.col("d"), F.col("trading_value")).otherwise(0).cast(bars.schema["trading_value"].dataType).alias("trading_value"))


def trading_value(bars: DataFrame, calendar: DataFrame, as_of, days: int = TRADING_DAYS, name: str = "trading_value_20d_avg") -> DataFrame:
    """Mean traded value of the last business days up to as_of (a date or a Moment); none if a day is missing. Bars
    with gaps have none for most codes: ``dense_bars`` fills them."""
    when = as_of if isinstance(as_of, Moment) else Moment(as_of)
    until = F.lead("day", days).over(Window.orderBy("day"))  # a day counts until so many have followed
    last = when.holding(calendar.withColumn("until", until), "day", "until").select(*when.keys, F.col("day").alias("d"))
    rows = bars.join(F.broadcast(last), "d").groupBy(*when.keys, "code").agg(F.sum("trading_value").alias("s"), F.count("*").alias("n"))
    return rows.where(F.col("n") == days).select(*when.keys, "code", (F.col("s").cast("double") / days).alias(name))


def from_caps(view, when: Moment, names: list[str]) -> DataFrame:
    """The newest market cap and share count; each counts until the next one of its code."""
    source = {"market_cap_krx_official": "market_cap", "shares_issued": "shares"}
    rows = view("market_caps")
    if when.panel is None:
        rows = when.holding(rows, "effective_date").groupBy("code")
        return rows.agg(*(F.max_by(source[n], "effective_date").alias(n) for n in names))
    after = F.lead("effective_date").over(Window.partitionBy("code").orderBy("effective_date"))
    rows = when.holding(rows.withColumn("until", after), "effective_date", "until")
    return rows.select(*when.keys, "code", *(F.col(source[n]).alias(n) for n in names))


def from_treasury(view, when: Moment, names: list[str]) -> DataFrame:
    """The newest active row by (date, period, id text)."""
    rows = when.holding(pit.spans(view("treasury"), ["code", "period"]), "effective_date", "until")
    newest = F.struct("effective_date", "period", F.col("id").cast("string"))
    return rows.groupBy(*when.keys, "code").agg(F.max_by("shares_treasury", newest).alias("shares_treasury"))


def from_dividends(view, when: Moment, names: list[str]) -> DataFrame:
    """The cash dividends per share of the last year."""
    rows = adjust.with_details(known_actions(view, when, YEAR_DAYS - 1).where("action_type = 'cash_dividend'")).withColumn("_cash", adjust.dividend())
    return rows.where("_cash IS NOT NULL").groupBy(*when.keys, "code").agg(F.sum("_cash").alias(names[0]))


#: The sources, each with its fields and the function that resolves some of them together.
SOURCES = (
    (("close_price_adjusted", "total_return_trailing_1y"), from_prices),
    (("trading_value_20d_avg",), lambda view, when, names: trading_value(view("traded_bars"), view("calendar"), when)),
    (("market_cap_krx_official", "shares_issued"), from_caps),
    (("shares_treasury",), from_treasury),
    (tuple(STATEMENT_FIELDS), from_statements),
    (("dividend_per_share_trailing_annual",), from_dividends),
)


def fields(view, as_of, names: list[str], types: tuple[str, ...] | None = None) -> DataFrame:
    """code, security_type and the fields of every security listed as of the date; null where there is none.
    ``as_of``: a date, or a Moment, whose panel's keys then come first."""
    when = as_of if isinstance(as_of, Moment) else Moment(as_of)
    securities = view("securities") if types is None else view("securities").where(F.col("security_type").isin(*types))
    rows = when.holding(securities, "listing_date", "delisting_date").select(*when.keys, "code", "security_type")
    if unknown := [n for n in names if not any(n in own for own, _ in SOURCES)]:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    for own, resolve in SOURCES:
        if some := [n for n in own if n in names]:
            rows = rows.join(resolve(view, when, some), [*when.keys, "code"], "left")
    return rows.select(*when.keys, "code", "security_type", *names)
