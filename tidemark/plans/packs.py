"""Packs of factor definitions as tables: what is wrong inside one, and what clashes with those already there.

A row is a factor: pack, place (its order in the pack), canonical_id, uuid, hash (of its definition without the uuid),
reads (the derived field that it names, or null), citation and pack_citation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derived_name(canonical_id: Column) -> Column:
    """The field name under which others read a factor."""
    return F.translate(canonical_id, ":-", "__")


def tier(pack: Column) -> Column:
    """canonical for the built-in pack, community for shared ones (community/..., @publisher/...), else custom."""
    return F.when(pack == "builtin", "canonical").when(pack.startswith("community/") | pack.startswith("@"), "community").otherwise("custom")


def rank(name: Column) -> Column:
    return F.when(name == "canonical", 0).when(name == "community", 1).otherwise(2)


def duplicates(factors: DataFrame) -> DataFrame:
    """pack, kind, value, n: ids and uuids that a pack holds more than once."""
    rows = factors.select("pack", F.explode(F.create_map(F.lit("canonical_id"), F.col("canonical_id"), F.lit("uuid"), F.col("uuid"))).alias("kind", "value"))
    return rows.groupBy("pack", "kind", "value").agg(F.count("*").alias("n")).where("n > 1")


def without_citation(factors: DataFrame) -> DataFrame:
    """Factors without a citation in packs that have none either; blanks are none."""
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return factors.where(none(F.col("citation")) & none(F.col("pack_citation"))).select("pack", "place", "canonical_id")


def collisions(factors: DataFrame) -> DataFrame:
    """pack, name: field names that stand for several ids of a pack."""
    rows = factors.withColumn("name", derived_name(F.col("canonical_id"))).groupBy("pack", "name")
    return rows.agg(F.countDistinct("canonical_id").alias("n")).where("n > 1").select("pack", "name")


def on_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """The names of one pack that depend on themselves, by a walk from each. A pack has at most a few hundred factors."""
    reads: dict[str, set[str]] = {}
    for name, other in zip(pdf["name"], pdf["reads"]):
        reads.setdefault(name, set()).add(other)
    found = []
    for start in reads:
        seen, ahead = set(), list(reads[start])
        while ahead:
            at = ahead.pop()
            if at in reads and at not in seen:
                seen.add(at)
                ahead += reads[at]
        if start in seen:
            found.append(start)
    return pd.DataFrame({"pack": pdf["pack"].iloc[0] if len(pdf) else None, "name": found}, dtype=object)


def cycles(factors: DataFrame) -> DataFrame:
    """pack, name: field names of factors that, over others of their pack, read themselves."""
    rows = factors.where("reads IS NOT NULL").select("pack", derived_name(F.col("canonical_id")).alias("name"), "reads").distinct()
    return rows.groupBy("pack").applyInPandas(on_cycles, "pack string, name string")


def existing_index(existing: DataFrame, key: str) -> DataFrame:
    """Of each ``key`` (canonical_id or uuid) the factor of the best tier, then of the first pack and place."""
    w = Window.partitionBy(key).orderBy(rank(tier(F.col("pack"))), "pack", "place")
    return existing.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """pack, place, canonical_id, incoming_hash, existing_hash, tier, allowed: the same id with another definition.
    One of the built-in pack cannot be replaced."""
    own = existing_index(existing, "canonical_id").select("canonical_id", F.col("hash").alias("existing_hash"), tier(F.col("pack")).alias("tier"))
    rows = incoming.join(own, "canonical_id").where(F.col("hash") != F.col("existing_hash"))
    allowed = F.when(F.col("tier") == "canonical", "skip,rename").otherwise("skip,rename,replace")
    return rows.select("pack", "place", "canonical_id", F.col("hash").alias("incoming_hash"), "existing_hash", "tier", allowed.alias("allowed"))


def uuid_reuse(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """pack, place, canonical_id, uuid, owner: uuids that belong to another id already."""
    own = existing_index(existing, "uuid").select("uuid", F.col("canonical_id").alias("owner"))
    return incoming.join(own, "uuid").where(F.col("owner") != F.col("canonical_id")).select("pack", "place", "canonical_id", "uuid", "owner")


def resolved(incoming: DataFrame, existing: DataFrame, resolutions: DataFrame) -> DataFrame:
    """pack, place, canonical_id, result, status of each incoming factor under ``resolutions`` (pack, canonical_id,
    action, new_id). Without a conflict it is kept. A conflict is skipped, renamed or replaced; it is rejected without
    a resolution (unresolved), for an action not allowed, a rename to nothing or itself (bad_name) or to an id that
    exists or that an earlier factor of the pack has taken (clash)."""
    clash = conflicts(incoming, existing).select("pack", "place", "allowed")
    rows = incoming.join(clash, ["pack", "place"], "left").join(resolutions, ["pack", "canonical_id"], "left")
    known = existing.select(F.col("canonical_id").alias("new_id"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(known, "new_id", "left")
    action = F.col("action")
    status = (
        F.when(F.col("allowed").isNull(), "kept").when(action.isNull(), "rejected:unresolved").when(~F.array_contains(F.split("allowed", ","), action), "rejected:not_allowed")
        .when(action == "skip", "skipped").when(action == "replace", "replaced").when((F.coalesce("new_id", F.lit("")) == "") | (F.col("new_id") == F.col("canonical_id")), "rejected:bad_name")
        .when(F.coalesce("taken", F.lit(False)), "rejected:clash").otherwise("renamed")
    )
    rows = rows.withColumn("status", status)
    result = F.when(F.col("status").isin("kept", "replaced"), F.col("canonical_id")).when(F.col("status") == "renamed", F.col("new_id"))
    rows = rows.withColumn("result", result)
    earlier = Window.partitionBy("pack", "result").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    late = (F.col("status") == "renamed") & (F.count("*").over(earlier) > 0)
    rows = rows.withColumn("status", F.when(late, "rejected:clash").otherwise(F.col("status")))
    return rows.select("pack", "place", "canonical_id", F.when(~F.col("status").startswith("rejected"), F.col("result")).alias("result"), "status")
