"""Point-in-time resolution: which facts were known on a date, and which of them count.

``as_of`` may be a date string, a date column or the name of a column, so that one code path answers a single date
and a panel of dates. A fact is superseded only by its direct successor, and only once that successor is visible.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.sources.stored import together, written


def on(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def visible(facts: DataFrame, as_of, date: str = "effective_date") -> DataFrame:
    """Facts dated at or before as_of."""
    return facts.where(F.col(date) <= on(as_of))


def lookahead(facts: DataFrame, as_of, *dates: str) -> DataFrame:
    """Facts that a query as of this date must not see: any of the date columns is later."""
    late = F.lit(False)
    for d in dates or ("effective_date",):
        late = late | (F.col(d) > on(as_of))
    return facts.where(late)


def active(facts: DataFrame, as_of, date: str = "effective_date", id: str = "id", next: str = "superseded_by", keep: tuple[str, ...] = ()) -> DataFrame:
    """Visible facts whose direct successor is missing or not yet visible. ``keep``: key columns shared by a chain
    (and a panel's as_of), which the self join then also uses, so that it stays within their partitions."""
    later = facts.select(F.col(id).alias("_next"), F.col(date).alias("_date"), *(F.col(k).alias(f"_{k}") for k in keep))
    if keep:
        same = F.col(next) == F.col("_next")
        for k in keep:
            same = same & (F.col(k) == F.col(f"_{k}"))
    else:
        # facts without a successor, nearly all, would meet in one task by their null: their own id deals them to all
        later = later.where("_next IS NOT NULL")
        own = F.when(F.col(next).isNull(), F.col(id))
        same = F.struct(F.col(next).alias("to"), own.alias("own")) == F.struct(F.col("_next").alias("to"), F.when(F.col("_next").isNull(), F.col("_next")).alias("own"))
    joined = visible(facts, as_of, date).join(later, same, "left")
    return joined.where(F.col("_next").isNull() | (F.col("_date") > on(as_of))).select(*(facts[c] for c in facts.columns))


def spans(facts: DataFrame, keys: list[str], date: str = "effective_date", id: str = "id", next: str = "superseded_by") -> DataFrame:
    """Facts with ``until``, the day from which their direct successor counts instead (null without one), and, where
    facts say when they were ``loaded``, next_loaded. ``keys``: columns that all facts of a chain share, code first;
    the successor is looked for among the few facts of these. Rows come out partitioned on the first key, which is all
    that later windows and aggregates of a code need: one shuffle for them together."""
    loaded = ["loaded"] if "loaded" in facts.columns else []
    entry = F.struct(F.col(id).alias("id"), F.col(date).alias("date"), *loaded)
    chain = F.collect_list(entry).over(Window.partitionBy(*keys))
    rows = together(facts, keys[0]).withColumn("_chain", chain)
    rows = rows.withColumn("_next", F.get(F.filter("_chain", lambda x: x["id"] == F.col(next)), 0))
    rows = rows.withColumn("until", F.col("_next.date"))
    if loaded:
        rows = rows.withColumn("next_loaded", F.col("_next.loaded"))
    return rows.drop("_chain", "_next")


class Moment:
    """When a question is asked: one date, or a panel, a frame of up to MOST_ROWS rows with as_of and further key
    columns (a run, say). One code path answers both; a panel's keys are part of every key."""

    MOST_ROWS = 100_000

    def __init__(self, as_of=None, panel: DataFrame | None = None, keys: tuple[str, ...] = ("as_of",)):
        self.panel, self.keys = panel, list(keys) if panel is not None else []
        self.on = on(as_of) if panel is None else F.col("as_of")

    @cached_property
    def rows(self) -> list[Row]:
        """The panel's rows by as_of; those without one ask nothing."""
        rows = self.panel.where("as_of IS NOT NULL").limit(self.MOST_ROWS + 1).collect()
        if len(rows) > self.MOST_ROWS:
            raise ValueError(f"a panel has at most {self.MOST_ROWS} rows: ask in several")
        return sorted(rows, key=lambda r: r.as_of)

    def place(self, day: Column) -> Column:
        """How many of the panel's rows are before a day: looked up by the day's distance from the first."""
        dates = [r.as_of for r in self.rows]
        if not dates:
            return F.lit(0)
        span = (dates[-1] - dates[0]).days
        before = ",".join(str(bisect_left(dates, dates[0] + timedelta(k))) for k in range(span + 1))
        off = F.datediff(day, F.lit(dates[0]))
        return F.when(off <= 0, 0).when(off <= span, F.get(F.split(F.lit(before), ",").cast("array<int>"), off)).otherwise(len(dates))

    def holding(self, facts: DataFrame, since: str | Column, until: str | Column | None = None, source: str | None = None) -> DataFrame:
        """The facts that count at the moment: since <= as_of < until (null: for ever), for each row of a panel. Facts
        are neither shuffled nor compared with every date: those of an interval are a slice of the sorted panel. Give
        ``until`` where it can be told, as it bounds how often a fact is repeated. ``source``: where a panel has a cutoff
        for it, facts loaded later than that (column ``loaded``) do not count."""
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        since = as_column(since)
        if self.panel is None:
            good = since <= self.on
            if until is not None:
                good = good & (as_column(until).isNull() | (as_column(until) > self.on))
            return facts.where(good)
        n = len(self.rows)
        first = F.when(since.isNull(), n).otherwise(self.place(since))
        last = F.lit(n) if until is None else F.when(as_column(until).isNull(), n).otherwise(self.place(as_column(until)))
        text = json.dumps([r.asDict() for r in self.rows], default=str)
        every = F.from_json(F.lit(text), f"array<{self.panel.schema.simpleString()}>")
        some = F.slice(every, first + 1, F.greatest(last - first, F.lit(0)))
        rows = facts.select("*", F.explode(some).alias("_panel")).select(*(F.col(f"`{c}`") for c in facts.columns), "_panel.*")
        cut = f"cut_{source}"
        if source and cut in self.panel.columns and "loaded" in facts.columns:
            rows = rows.where(F.col(cut).isNull() | (F.col("loaded") <= F.col(cut)))
        return rows


def newest(facts: DataFrame, keys: list[str], *order: str, n: int = 1) -> DataFrame:
    """The n greatest rows of each key by the order columns, all descending."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return facts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_active(facts: DataFrame, as_of, keys: list[str], date: str = "effective_date", id: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each key's active facts the last by date and then id as text; keys without any are absent."""
    rows = active(facts, as_of, date, id, keep=keep).withColumn("_text", F.col(id).cast("string"))
    return newest(rows, keys, date, "_text").drop("_text")


def financial_periods(statements: DataFrame, as_of, keys: list[str], n: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """The newest active row of each period, then the n newest periods of each key by (date, period, id text)."""
    rows = latest_active(statements, as_of, [*keys, "period"], keep=keep).withColumn("_text", F.col("id").cast("string"))
    return newest(rows, keys, "effective_date", "period", "_text", n=n).drop("_text")


def active_actions(actions: DataFrame, as_of, types: list[str] | None = None) -> DataFrame:
    """Actions active on their announcement date; a type filter applies before chains are resolved."""
    rows = actions.where(F.col("action_type").isin(types)) if types else actions
    return active(rows, as_of, "announced_date")


def dividends(actions: DataFrame, as_of) -> DataFrame:
    """Cash dividends in effect: chains are resolved over all types first, as another type may supersede one."""
    return active(actions, as_of, "announced_date").where((F.col("action_type") == "cash_dividend") & (F.col("effective_date") <= on(as_of)))


def chain_defects(facts: DataFrame, id: str = "id", next: str = "superseded_by", deepest: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, hops of facts whose chain has a cycle or more than ``deepest`` hops (counted until the chain ends or that is
    certain). ``keys``: columns that all facts of a chain share; chains are then walked within their group, which holds
    one series of restatements. Without keys pointers are doubled by joins, each round a written table: seven rounds
    follow 128 hops."""
    links = facts.where(F.col(next).isNotNull())
    if not keys:
        links = links.select(F.col(id).alias("id"), F.col(next).alias("to"), F.lit(1).alias("hops"))
        for _ in range(deepest.bit_length()):
            ahead = links.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
            links = links.join(ahead, F.col("to") == F.col("_id"), "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"))
            links = written(links, "links")
        return links.where(F.col("hops") > deepest).select("id", "hops")
    links = links.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(F.col(id).alias("id"), F.col(next).alias("to")))).alias("to"))
    rows = links.select(F.map_keys("to").alias("ids"), F.map_values("to").alias("to"))
    # places instead of ids, found once; then the places after 1, 2, 4 hops and so on, -1 where a chain has ended before
    rows = rows.withColumn("ahead", F.transform("to", lambda x: F.array_position("ids", x).cast("int") - 1)).withColumn("at", F.sequence(F.lit(0), F.size("ids") - 1))
    after = lambda start, by: F.transform(start, lambda p: F.when(p >= 0, F.get(by, p)).otherwise(-1))
    for bit in range(deepest.bit_length()):
        if deepest >> bit & 1:
            rows = rows.withColumn("at", after("at", F.col("ahead")))
        rows = rows.withColumn("ahead", after("ahead", F.col("ahead")))
    # where ``deepest`` hops end there is one more
    rows = rows.select(F.explode(F.arrays_zip("ids", "at")).alias("x"))
    return rows.where("x.at >= 0").select(F.col("x.ids").alias("id"), F.lit(deepest + 1).alias("hops"))


def batch_cutoff(facts: DataFrame, runs: DataFrame, source: str, cutoff: str | None, batch: str = "batch_id") -> DataFrame:
    """Facts loaded by a batch of the source not later than the cutoff batch, by (started_at, id). No cutoff keeps
    all facts; an unknown cutoff keeps none."""
    if cutoff is None:
        return facts
    own = runs.where(F.col("source") == source)
    last = own.where(F.col("id") == cutoff).agg(F.max(F.struct("started_at", "id")).alias("last"))
    allowed = own.join(F.broadcast(last), F.struct("started_at", "id") <= F.col("last")).select(F.col("id").alias(batch))
    return facts.join(allowed, batch, "left_semi")


def active_disclosures(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """code, period, ifrs_type, receipts, receipt, corrupt: of each report's heads (facts with citation_id and without a
    successor) the receipt that their citations (id, identifier) name. More than one receipt is corruption, and then
    receipt is null. Consolidated and separate reports (ifrs_type) never mix."""
    cited = citations.select(F.col("id").alias("citation_id"), "identifier")
    rows = facts.where("superseded_by IS NULL").join(cited, "citation_id").groupBy("code", "period", "ifrs_type")
    rows = rows.agg(F.count_distinct("identifier").alias("receipts"), F.min("identifier").alias("receipt"))
    return rows.withColumns({"receipt": F.when(F.col("receipts") == 1, F.col("receipt")), "corrupt": F.col("receipts") > 1})


def restatement_history(statements: DataFrame) -> DataFrame:
    """All vintages, numbered within (code, period, account) by (date, id), and whether each is the head."""
    w = Window.partitionBy("code", "period", "account").orderBy("effective_date", "id")
    return statements.withColumn("sequence", F.row_number().over(w)).withColumn("is_active", F.col("superseded_by").isNull())


def restatement_lag(statements: DataFrame, as_of) -> DataFrame:
    """Codes of which some (account, period) has facts both up to and after as_of."""
    early, late = F.bool_or(F.col("effective_date") <= on(as_of)), F.bool_or(F.col("effective_date") > on(as_of))
    rows = statements.groupBy("code", "account", "period").agg((early & late).alias("lagging"))
    return rows.where("lagging").select("code").distinct()


def latest_macro(macro: DataFrame, as_of) -> DataFrame:
    """Per indicator the newest reference date, then the newest vintage, both known as of the date."""
    return newest(macro.where((F.col("reference_date") <= on(as_of)) & (F.col("vintage_date") <= on(as_of))), ["indicator_id"], "reference_date", "vintage_date")


def latest_nav(nav: DataFrame, as_of) -> DataFrame:
    """Per fund the newest value at or before the date."""
    return newest(visible(nav, as_of, "d"), ["code"], "d")
