"""Canonical forms and hashes of saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def result_hash(**fields: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(**fields), 256))


def version_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """run, key, stored, current where two maps (columns run, versions) differ; a missing key is ''."""
    a = stored.select("run", F.explode("versions").alias("key", "stored"))
    b = current.select("run", F.explode("versions").alias("key", "current"))
    rows = a.join(b, ["run", "key"], "full_outer").select("run", "key", F.coalesce("stored", F.lit("")).alias("stored"), F.coalesce("current", F.lit("")).alias("current"))
    return rows.where(F.col("stored") != F.col("current"))
