"""Saved runs: their canonical form, the versions they saw, and asking them again as of what had been loaded then.

A run names, for each source, the newest batch that it saw. A key that is absent sets no cutoff; an empty or unknown
batch excludes everything. All runs are asked again in one job: a run is a key of the panel (``pit.Moment``). Macro
series, actions and dividends are not cut off."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import formulas
from tidemark.operators.pit import Moment
from tidemark.plans import factors, screen
from tidemark.plans.fields import fields

SOURCES = ("KRX", "DART")
#: The versions of the rules that a run depends on.
POLICIES = {
    "adjustment_policy_version": "1.0.0",
    "ca_policy_version": "1.0.0",
    "calendar_version": "1.0.0",
    "distribution_policy_version": "1.0.0",
    "evaluator_version": "1.0.0",
    "factor_pack_slug": "builtin",
    "factor_pack_version": "1.0.0",
    "pit_policy_version": "1.0.0",
    "snapshot_schema_version": "1.3",
    "total_return_policy_version": "1.0.0",
}


def policy_versions(trees: dict | None = None) -> dict[str, str]:
    """The fixed versions and the hash of the pack's definitions (JSON with sorted keys)."""
    text = json.dumps(trees or factors.BUILT_IN, sort_keys=True, separators=(",", ":"))
    return {**POLICIES, "factor_pack_content_hash": "sha256:" + hashlib.sha256(text.encode()).hexdigest()}


def with_policies(versions: Column, trees: dict | None = None) -> Column:
    """A run's map of batch versions together with the versions of the rules."""
    pairs = [F.lit(x) for kv in policy_versions(trees).items() for x in kv]
    return F.map_concat(versions, F.create_map(*pairs))


def canonical_queries(conditions: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """run, conditions, factors, types, presentation_order: per run its conditions (place, factor, op, value), without
    repeats, in the order of (factor, op, value); its factors, sorted; its security types, sorted, ``common`` where
    none is given; and the first place of each condition, as asked."""
    once = conditions.groupBy("run", "factor", "op", "value").agg(F.min("place").alias("place"))
    rows = once.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("factor", "op", "value", "place"))).alias("cs"))
    out = rows.select(
        "run", F.transform("cs", lambda c: F.concat_ws(" ", c["factor"], c["op"], c["value"])).alias("conditions"),
        F.array_sort(F.array_distinct(F.transform("cs", lambda c: c["factor"]))).alias("factors"), F.transform("cs", lambda c: c["place"]).alias("presentation_order"),
    )
    common = F.array(F.lit("common"))
    if types is None:
        return out.withColumn("types", common)
    given = types.groupBy("run").agg(F.array_sort(F.collect_set("security_type")).alias("types"))
    return out.join(given, "run", "left").withColumn("types", F.coalesce("types", common))


def cutoffs(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """``runs`` (with a column batch_<source> of texts for each source) with cut_<source>: null without a cutoff, the
    batch's place in the order of its source, or 0, before all, where the text names none."""
    for source in SOURCES:
        own = batches.where(F.col("source") == source).select(F.col("id").cast("string").alias(f"batch_{source}"), F.col("place").alias("_place"))
        runs = runs.join(own, f"batch_{source}", "left")
        runs = runs.withColumn(f"cut_{source}", F.when(F.col(f"batch_{source}").isNotNull(), F.coalesce("_place", F.lit(0)))).drop("_place")
    return runs


def screened(view, runs: DataFrame, keys: tuple[str, ...], conditions: list[tuple[str, str, float]], trees: dict) -> DataFrame:
    """keys, code: who passes each run's screen, as of its date, under its cutoffs."""
    order, stored = factors.plan(list(dict.fromkeys(name for name, *_ in conditions)), trees)
    rows = fields(view, Moment(panel=runs, keys=keys), stored)
    rows = formulas.with_factors(rows, order, population=(*keys, "security_type"))
    return screen.passing(rows, conditions).select(*keys, "code")


def compared(runs: DataFrame, stored: DataFrame, again: DataFrame) -> DataFrame:
    """run, stored, reproduced, missing, extra, identical: each run's stored codes against those of asking again."""
    rows = stored.withColumn("old", F.lit(1)).join(again.withColumn("new", F.lit(1)), ["run", "code"], "full_outer")
    counts = rows.groupBy("run").agg(F.count("old").alias("stored"), F.count("new").alias("reproduced"), F.count_if(F.col("new").isNull()).alias("missing"), F.count_if(F.col("old").isNull()).alias("extra"))
    out = runs.select("run").join(counts, "run", "left").na.fill(0)
    return out.withColumn("identical", (F.col("missing") == 0) & (F.col("extra") == 0))


def curves_compared(stored: DataFrame, again: DataFrame, engine: Column, current: str) -> DataFrame:
    """as_of, stored, reproduced, identical, same_engine: two curves as exact texts, date by date."""
    a, b = (x.select("as_of", F.col("value").cast("string").alias(name)) for x, name in ((stored, "stored"), (again, "reproduced")))
    rows = a.join(b, "as_of", "full_outer")
    return rows.withColumns({"identical": F.col("stored").eqNullSafe(F.col("reproduced")), "same_engine": engine == F.lit(current)})


def verified(runs: DataFrame, stored_hash: str, recomputed: Column) -> DataFrame:
    """Runs whose stored hash is not the one recomputed from their stored payload."""
    return runs.where(~F.col(stored_hash).eqNullSafe(recomputed))
