"""Reconciling a load with what is stored: what to append, supersede, keep or reject. Facts are only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.views import dealt


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the least by its other columns, so that it does not depend on the order of rows."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def appended(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored; of a key given twice the row that comes first by all its columns."""
    return once(incoming, keys).join(stored.select(*keys), keys, "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and incoming rows, the incoming one winning where a key is in both; of a key given twice one (see once)."""
    return once(incoming, keys).unionByName(stored.join(incoming.select(*keys), keys, "left_anti"))


def restatements(heads: DataFrame, incoming: DataFrame, keys: list[str], receipt: str = "receipt") -> DataFrame:
    """What each account of a report (keys + account) means against the stored heads: insert (no head), supersede
    (another receipt), noop (the same receipt) or keep (not in the new report)."""
    old = heads.select(*keys, F.col("id").alias("old_id"), F.col(receipt).alias("_old"))
    new = incoming.select(*keys, F.col("id").alias("new_id"), F.col(receipt).alias("_new"))
    action = F.when(F.col("new_id").isNull(), "keep").when(F.col("old_id").isNull(), "insert").when(F.col("_old") == F.col("_new"), "noop").otherwise("supersede")
    return new.join(old, keys, "full_outer").select(*keys, "old_id", "new_id", action.alias("action"))


def date_regressions(facts: DataFrame, date: str = "effective_date") -> DataFrame:
    """Facts dated before the fact they supersede."""
    old = facts.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"), F.col(date).alias("old_date"))
    return facts.join(old, "id").where(F.col(date) < F.col("old_date")).select("id", date, "old_date")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a report holds more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_from(stored: DataFrame, wanted: DataFrame, end: str) -> DataFrame:
    """code, start: from the day after the last stored one, or the wanted start; none where that is past the end."""
    last = stored.groupBy("code").agg(F.date_add(F.max("d"), 1).alias("_next"))
    rows = wanted.join(last, "code", "left").select("code", F.coalesce("_next", "start").alias("start"))
    return rows.where(F.col("start") <= F.lit(end).cast("date"))


def windows(securities: DataFrame) -> DataFrame:
    """For delisted securities one span for each code they had, cut at the delisting; empty spans are left out."""
    rows = securities.where("delisting_date IS NOT NULL").select("id", "delisting_date", F.explode("code_history").alias("h"))
    rows = rows.select("id", F.col("h.code").alias("code"), F.col("h.valid_from").alias("start"), F.least(F.coalesce("h.valid_to", "delisting_date"), "delisting_date").alias("end"))
    return rows.where(F.col("start") <= F.col("end"))


def status(items: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Per batch: success, partial (some items failed) or skipped, with counts and the failed items, sorted. A batch of
    ``batches`` (batch, open, universe_ok) is skipped on a closed day, without its universe, or with nothing tried."""
    name = F.col("item") if "item" in items.columns else F.lit(None).cast("string")
    counts = items.groupBy("batch").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), name))).alias("failures"))
    if batches is None:
        rows, closed = counts, F.lit(False)
    else:
        rows, closed = batches.join(counts, "batch", "left"), ~F.col("open") | ~F.col("universe_ok")
    ok, bad = (F.when(closed, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in ("succeeded", "failed"))
    failures = F.when(closed, F.array()).otherwise(F.coalesce("failures", F.array())).cast("array<string>")
    what = F.when(closed | (ok + bad == 0), "skipped").when(bad > 0, "partial").otherwise("success")
    return rows.select("batch", ok.alias("succeeded"), bad.alias("failed"), what.alias("status"), failures.alias("failures"))


def backfill(spans: DataFrame, raw: DataFrame, stored: DataFrame) -> DataFrame:
    """id, saved, skipped, empty of securities (spans: id, code, start, stop): raw bars inside their windows that are
    not stored, those that are, and the windows without any bar. A code's bars meet its own few windows only, and codes
    are dealt out to as many partitions as facts are."""
    near = dealt(raw.select("code", "d").join(stored.select("code", "d", F.lit(True).alias("there")), ["code", "d"], "left"), "code")
    inside = (F.col("w.code") == F.col("b.code")) & F.col("b.d").between(F.col("w.start"), F.col("w.stop"))
    rows = dealt(spans, "code").alias("w").join(near.alias("b"), inside, "left").select("w.*", F.col("b.d").alias("d"), F.col("b.there").alias("there"))
    rows = rows.groupBy("id", "code", "start", "stop").agg(F.count_if(F.col("d").isNotNull() & F.col("there").isNull()).alias("new"), F.count("there").alias("old"), F.count("d").alias("n"))
    return rows.groupBy("id").agg(F.sum("new").alias("saved"), F.sum("old").alias("skipped"), F.count_if(F.col("n") == 0).alias("empty"))


def append_only_violations(before: DataFrame, after: DataFrame, fixed: list[str]) -> DataFrame:
    """id, problem: facts that vanished, whose fixed columns changed, that are superseded twice, or whose successor
    is missing."""
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    new = after.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in fixed))
    both = before.join(new, F.col("id") == F.col("_id"), "left")
    changed = both.where(F.col("_id").isNull() | ~same).select("id", F.when(F.col("_id").isNull(), "vanished").otherwise("changed").alias("problem"))
    links = after.where("superseded_by IS NOT NULL").select("superseded_by")
    twice = links.groupBy("superseded_by").count().where("count > 1").select(F.col("superseded_by").alias("id"), F.lit("superseded_twice").alias("problem"))
    lost = links.distinct().join(after.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti").select(F.col("superseded_by").alias("id"), F.lit("missing_successor").alias("problem"))
    return changed.union(twice).union(lost)


def new_dividends(feed: DataFrame, stored: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to save, counts): dividends of the feed (code, effective_date, type) of which none with the same code,
    ex-date and type is stored or stands earlier in the feed's order. A null type is an empty one; only cash dividends
    among the stored actions count. A correction of the amount is thus skipped. Rows without an ex-date are data gaps.
    counts: code, saved, skipped, gaps."""
    keys = ["code", "effective_date", "type"]
    known = lambda rows: rows.withColumn("type", F.coalesce("type", F.lit("")))
    old = known(stored.where("action_type = 'cash_dividend'").select(*keys)).distinct().withColumn("_old", F.lit(True))
    rows = known(feed).join(old, keys, "left").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    gap = F.col("effective_date").isNull()
    new = ~gap & F.col("_old").isNull() & (F.col("_n") == 1)
    counts = rows.groupBy("code").agg(F.count_if(new).alias("saved"), F.count_if(~gap & ~new).alias("skipped"), F.count_if(gap).alias("gaps"))
    return rows.where(new).select(*feed.columns), counts


def chained(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions (id, keys, effective_date, receipt, further columns) with superseded_by: the id of the next version
    of their key by (effective_date, receipt); of a receipt given twice for a key the one with the least (date, id) counts."""
    first = F.row_number().over(Window.partitionBy(*keys, "receipt").orderBy("effective_date", "id")) == 1
    # dealt out by what both windows share: one shuffle
    rows = versions.repartition(*keys).withColumn("_first", first).where("_first").drop("_first")
    return rows.withColumn("superseded_by", F.lead("id").over(Window.partitionBy(*keys).orderBy("effective_date", "receipt")))


def first_of_feed(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the feed's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
