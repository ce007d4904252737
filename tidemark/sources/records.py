"""Raw records to typed facts. Rows that cannot be used are left out and counted, never fatal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stored import written

#: Statements from best to worst, and the one that is not read.
PRIORITY, UNREAD = ("BS", "IS", "CIS", "CF"), "SCE"
#: Days from a quarter's end to the filing deadline, for the last quarter and the others.
DEADLINE = {4: 90, 0: 45}
#: Fixed value: the OID namespace of RFC 4122.
OID = "6ba7b8129dad11d180b400c04fd430c8"


def ohlcv(raw: DataFrame) -> DataFrame:
    """Bars with trading_value filled by close * volume where it is absent, and whether it was."""
    return raw.withColumn("estimated", F.col("trading_value").isNull()).withColumn("trading_value", F.coalesce("trading_value", (F.col("close") * F.col("volume")).cast("decimal(28,2)")))


def price_facts(bars: DataFrame) -> DataFrame:
    """Facts of bars; the adjusted close starts as the raw close."""
    return bars.select("code", F.col("d").alias("effective_date"), *(F.col(c).alias(f"{c}_raw") for c in ("open", "high", "low", "close")), "volume", "trading_value", F.col("close").alias("close_adjusted"))


def nav_premium(nav: DataFrame, given: DataFrame) -> DataFrame:
    """NAV rows (code, d, nav, market_price) with the premium: the given deviation, else (price - nav) / nav, else 0;
    a missing price is the NAV."""
    price = F.coalesce("market_price", "nav")
    rate = F.coalesce(F.col("deviation").cast("double"), F.try_divide((price - F.col("nav")).cast("double"), F.nullif(F.col("nav").cast("double"), F.lit(0.0))), F.lit(0.0))
    return nav.join(given, ["code", "d"], "left").select("code", "d", "nav", price.alias("market_price"), rate.alias("premium"))


def amount(text: Column) -> Column:
    """A number with thousands' commas; null for blanks, a dash or other text."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(38,4)")


def best_statements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of the best statement present; ties are all kept."""
    place = F.lit(len(PRIORITY))
    for n, s in enumerate(PRIORITY):
        place = F.when(F.col("statement") == s, n).otherwise(place)
    rows = rows.where(F.col("statement") != UNREAD).withColumn("_p", F.rank().over(Window.partitionBy(*keys).orderBy(place)))
    return rows.where("_p = 1").drop("_p")


def mapped(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """account: the canonical name of account_id; unknown ids are unmapped:<id>, blanks unmapped:<empty>. The
    mapping is a table of a few dozen rows."""
    rows = rows.join(F.broadcast(accounts), "account_id", "left")
    blank = F.coalesce(F.trim("account_id") == "", F.lit(True))
    return rows.withColumn("account", F.coalesce("canonical", F.when(blank, "unmapped:<empty>").otherwise(F.concat(F.lit("unmapped:"), F.col("account_id"))))).drop("canonical")


def publication(receipt: Column, year: Column, quarter: Column) -> tuple[Column, Column]:
    """(date, precise): the receipt's first eight digits if they are a date of this century, else the quarter's end
    and its deadline."""
    given = F.when(receipt.rlike("^20[0-9]{12}$"), F.try_to_date(F.substring(receipt, 1, 8), "yyyyMMdd"))
    end = F.last_day(F.make_date(year, quarter * 3, F.lit(1)))
    late = F.date_add(end, F.when(quarter == 4, DEADLINE[4]).otherwise(DEADLINE[0]))
    return F.coalesce(given, late), given.isNotNull()


def period_start(text: Column, cycle: Column) -> Column:
    """First day of a period's text by its cycle: D yyyymmdd, M yyyymm, Q yyyyQn, S yyyySn, A yyyy; else null."""
    year, rest = F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 4)
    month = (
        F.when((cycle == "A") & text.rlike("^[0-9]{4}$"), 1).when((cycle == "Q") & text.rlike("^[0-9]{4}Q[1-4]$"), F.substring(text, 6, 1).try_cast("int") * 3 - 2)
        .when((cycle == "S") & text.rlike("^[0-9]{4}S[12]$"), F.substring(text, 6, 1).try_cast("int") * 6 - 5).when((cycle == "M") & text.rlike("^[0-9]{4}(0[1-9]|1[0-2])$"), F.substring(rest, 1, 2).try_cast("int"))
    )
    day = F.when((cycle == "D") & text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(day, F.when(month.isNotNull(), F.make_date(year, month, F.lit(1))))


def macro_rows(raw: DataFrame) -> DataFrame:
    """``raw`` (cycle, period and value as texts, observed, further columns) with reference_date, value and vintage_date
    of the rows that have both; a missing value, one that is no number, and a period that fits no date are skipped (and
    counted by macro_counts). The vintage is the day on which the value was observed."""
    value = F.trim("value").try_cast("decimal(38,6)")
    rows = raw.withColumns({"value": value, "reference_date": period_start(F.trim("period"), F.col("cycle")), "vintage_date": F.col("observed")})
    return rows.where(F.col("value").isNotNull() & F.col("reference_date").between("1900-01-01", "2100-12-31"))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def newest(rows: DataFrame, key: str, date: str, n: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(date), *ties)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


#: The fields of one line of a statement's JSON.
LINE = "array<struct<account_id:string,statement:string,line:int,amount:string,currency:string>>"


def statement_lines(payloads: DataFrame) -> DataFrame:
    """The usable lines of statements given as JSON lists (report, payload): with an account, of a statement that is
    read, with a number; the currency is KRW where none is given."""
    rows = payloads.select("report", F.explode(F.from_json("payload", LINE)).alias("x")).select("report", "x.*")
    currency = F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("KRW"))
    rows = rows.withColumns({"amount": amount(F.col("amount")), "currency": currency})
    return rows.where((F.col("statement") != UNREAD) & (F.trim("account_id") != "") & F.col("amount").isNotNull())


def statement_counts(rows: DataFrame) -> DataFrame:
    """Per report how many lines are of the statement that is not read, have no account, no number, or are kept."""
    unread, blank, none = F.col("statement") == UNREAD, F.trim("account_id") == "", amount(F.col("amount")).isNull()
    counts = {"unread": unread, "no_account": ~unread & blank, "no_amount": ~unread & ~blank & none, "kept": ~unread & ~blank & ~none}
    return rows.groupBy("report").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def macro_counts(rows: DataFrame) -> DataFrame:
    """Per cycle how many rows (period, cycle, value) have no valid period, no value, or one that is no number."""
    bad = period_start(F.col("period"), F.col("cycle")).isNull()
    none = F.trim("value").isin("", "-")
    wrong = ~none & amount(F.col("value")).isNull()
    counts = {"bad_period": bad, "not_a_number": ~bad & wrong, "missing": ~bad & none}
    return rows.groupBy("cycle").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def market_caps(raw: DataFrame) -> DataFrame:
    """Market caps and share counts from texts (code, day as yyyymmdd, cap, listed); rows without a number are left
    out; treasury shares come from elsewhere."""
    cap, shares = F.regexp_replace("cap", ",", "").try_cast("decimal(28,2)"), share_count(F.col("listed"))
    rows = raw.select("code", F.try_to_date("day", "yyyyMMdd").alias("effective_date"), cap.alias("market_cap"), shares.alias("shares"), F.lit(None).cast("long").alias("shares_treasury"))
    return rows.where("effective_date IS NOT NULL AND market_cap IS NOT NULL AND shares IS NOT NULL")


def disclosures(raw: DataFrame, as_of, n: int) -> DataFrame:
    """The n newest disclosures of each code up to a date, with how many of the code's rows were malformed (without a
    receipt or a day yyyymmdd)."""
    date = F.when(F.col("day").rlike("^[0-9]{8}$"), F.try_to_date("day", "yyyyMMdd"))
    rows = raw.withColumn("date", date).withColumn("_bad", F.col("date").isNull() | (F.coalesce("receipt", F.lit("")) == ""))
    rows = rows.withColumn("malformed", F.count_if("_bad").over(Window.partitionBy("code")))
    return newest(rows.where(~F.col("_bad") & (F.col("date") <= F.lit(as_of).cast("date"))), "code", "date", n, "receipt").drop("_bad")


def security_master(rows: DataFrame) -> DataFrame:
    """Lineage records of rows with a code of six digits and a name; listed since 1980-01-01 where no date is given,
    with one entry of history."""
    rows = rows.where(F.col("code").rlike("^[0-9]{6}$") & (F.coalesce("name", F.lit("")) != ""))
    rows = rows.withColumn("listing_date", F.coalesce("listing_date", F.lit("1980-01-01").cast("date")))
    entry = F.struct("code", F.col("listing_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return rows.withColumn("code_history", F.array(entry))


def deadline(year: Column, quarter: Column) -> Column:
    end = F.last_day(F.make_date(year, quarter * 3, F.lit(1)))
    return F.date_add(end, F.when(quarter == 4, DEADLINE[4]).otherwise(DEADLINE[0]))


def recent_quarter(day: Column) -> Column:
    """(fy, fq) of the newest of the last eight quarters whose filing deadline is at or before the day."""
    now = F.year(day) * 4 + F.quarter(day) - 1
    quarters = F.transform(F.sequence(now, now - 7, F.lit(-1)), lambda q: F.struct(F.floor(q / 4).cast("int").alias("fy"), (q % 4 + 1).alias("fq")))
    return F.get(F.filter(quarters, lambda q: deadline(q["fy"], q["fq"]) <= day), 0)


def share_count(text: Column) -> Column:
    """A whole number of shares with thousands' commas; null for blanks, a dash, other text and negatives."""
    n = F.regexp_replace(F.trim(text), ",", "").try_cast("long")
    return F.when(F.regexp_replace(F.trim(text), ",", "").rlike("^[+-]?[0-9]+$") & (n >= 0), n)


def treasury(rows: DataFrame, common: str = "보통주", total: str = "합계") -> DataFrame:
    """report, treasury, issued, receipt: of each report (rows with report, line, se, tesstk_co, istc_totqy, rcept_no)
    the last row for common stock, else the last total; the first receipt given, else a placeholder."""
    kind, place = F.trim("se"), F.col("line")
    pick = lambda name: F.max_by(F.struct("tesstk_co", "istc_totqy"), F.when(kind == name, place))
    receipt = F.min_by(F.col("rcept_no"), F.when(F.coalesce("rcept_no", F.lit("")) != "", place))
    out = rows.groupBy("report").agg(F.coalesce(pick(common), pick(total)).alias("row"), receipt.alias("receipt"))
    placeholder = F.concat(F.lit("report:"), F.col("report").cast("string"))
    return out.select("report", share_count(F.col("row.tesstk_co")).alias("treasury"), share_count(F.col("row.istc_totqy")).alias("issued"), F.coalesce("receipt", placeholder).alias("receipt"))


def period_start_digits(text: Column, cycle: Column) -> Column:
    """First day of a period of digits by its cycle: Y yyyy, H yyyyhh, Q yyyyqq, M yyyymm, D yyyymmdd, of the years
    1900 to 2100; else null."""
    year, part = F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int")
    month = (
        F.when((cycle == "Y") & text.rlike("^[0-9]{4}$"), 1).when((cycle == "H") & text.rlike("^[0-9]{4}0[12]$"), part * 6 - 5)
        .when((cycle == "Q") & text.rlike("^[0-9]{4}0[1-4]$"), part * 3 - 2).when((cycle == "M") & text.rlike("^[0-9]{4}(0[1-9]|1[0-2])$"), part)
    )
    day = F.when((cycle == "D") & text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.when(year.between(1900, 2100), F.coalesce(day, F.when(month.isNotNull(), F.make_date(year, month, F.lit(1)))))


def dividends(raw: DataFrame, days: DataFrame, common: str = "보통주") -> DataFrame:
    """Raw dividend rows (id, code, kind, amount, record_date, pay_date as texts) with status, cash_amount,
    effective_date and payment_date. Only common stock with a number above zero and a record date counts; the ex-date
    is the business day strictly before the record date (``days``: d, previous of a calendar), and a record date
    outside the calendar is a data gap. A payment before the ex-date is an error. Rejected rows say why in status."""
    number = F.regexp_replace(F.trim("amount"), ",", "").try_cast("decimal(20,8)")
    record, paid = (F.when(F.trim(c).rlike("^[0-9]{8}$"), F.try_to_date(F.trim(c), "yyyyMMdd")) for c in ("record_date", "pay_date"))
    rows = raw.withColumns({"cash_amount": number, "_record": record, "payment_date": paid})
    rows = rows.join(F.broadcast(days.select(F.col("d").alias("_record"), F.col("previous").alias("effective_date"))), "_record", "left")
    status = (
        F.when(F.coalesce(F.trim("kind") != common, F.lit(True)), "not_common").when(F.coalesce(F.trim("amount").isin("", "-"), F.lit(True)), "no_amount").when(F.col("cash_amount").isNull(), "not_a_number")
        .when(F.col("cash_amount") == 0, "zero").when(F.col("cash_amount") < 0, "negative").when(F.col("_record").isNull(), "no_record_date").when(F.col("effective_date").isNull(), "data_gap")
        .when(F.col("payment_date") < F.col("effective_date"), "paid_before_ex_date").otherwise("kept")
    )
    kept = F.col("status") == "kept"
    return rows.withColumn("status", status).select("id", "code", "status", *(F.when(kept, F.col(c)).alias(c) for c in ("cash_amount", "effective_date", "payment_date")))


#: Entries that one task may decide in file order.
IN_ORDER = 100_000


def in_file_order(batches):
    """The places of the entries that are mapped, of few entries: the first that still has both of its codes."""
    rows = sorted((p, s, c) for b in batches for p, s, c in zip(*(b.column(k).to_pylist() for k in range(3))))
    stocks, corps, mapped = set(), set(), []
    for place, stock, corp in rows:
        if stock not in stocks and corp not in corps:
            stocks.add(stock)
            corps.add(corp)
            mapped.append(place)
    yield pa.RecordBatch.from_arrays([pa.array(mapped, pa.int64())], ["_place"])


def code_map(entries: DataFrame) -> DataFrame:
    """entries (place, corp_code, stock_code, further columns) with status: mapped, unlisted, bad_format, or why a row is
    rejected: duplicate_stock or duplicate_corp. The first entry in file order has both of its codes; a rejected one
    claims none.

    Each round maps the entries that are the first in question for both of their codes, and rejects those that share a
    code with one of them: every round decides some, and on lists that are not sorted to spite it nearly all. Rounds are
    written tables. When at most IN_ORDER entries are in question, one task decides these in file order, so that a long
    chain of shared codes costs no round for each of its links. Places are unique."""
    stock, corp = F.trim(F.coalesce("stock_code", F.lit(""))), F.trim(F.coalesce("corp_code", F.lit("")))
    fine = stock.rlike("^[0-9]{6}$") & corp.rlike("^[0-9]{8}$")
    first = F.when(stock == "", "unlisted").when(~fine, "bad_format").otherwise("listed")
    rows = entries.withColumns({"_stock": stock, "_corp": corp, "_place": F.col("place").cast("long"), "status": first})
    listed = rows.where("status = 'listed'").select("_place", "_stock", "_corp")
    open_, mapped = written(listed, "entries"), listed.select("_place").where("false")
    while open_.count() > IN_ORDER:
        firsts = [open_.groupBy(c).agg(F.min("_place").alias(f"_first{c}")) for c in ("_stock", "_corp")]
        found = open_.join(firsts[0], "_stock").join(firsts[1], "_corp").where("_place = _first_stock AND _place = _first_corp").select("_place", "_stock", "_corp")
        found = written(found, "mapped")
        mapped = mapped.union(found.select("_place"))
        for c in ("_stock", "_corp"):
            open_ = open_.join(found.select(c), c, "left_anti")
        open_ = written(open_.select("_place", "_stock", "_corp"), "entries")
    rest = open_.coalesce(1).mapInArrow(in_file_order, "_place long")
    mapped = written(mapped.union(rest), "mapped").withColumn("_mapped", F.lit(True))
    rows = rows.join(mapped, "_place", "left")
    taken = rows.where("_mapped").groupBy("_stock").agg(F.min("_place").alias("_taken"))
    rows = rows.join(taken, "_stock", "left")
    status = F.when(F.col("status") != "listed", F.col("status")).when(F.col("_mapped"), "mapped").when(F.col("_taken") < F.col("_place"), "duplicate_stock").otherwise("duplicate_corp")
    return rows.withColumn("status", status).select(*entries.columns, "status")
