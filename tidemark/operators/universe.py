"""Securities: who was listed when, and finding one by code or name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.pit import on


def listed(securities: DataFrame, as_of, types: tuple[str, ...] | None = None) -> DataFrame:
    """Listed at or before as_of and not delisted by then, of the given types (all by default)."""
    rows = securities.where((F.col("listing_date") <= on(as_of)) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > on(as_of))))
    return rows.where(F.col("security_type").isin(*types)) if types else rows


def delisted_before(securities: DataFrame, cutoff) -> DataFrame:
    return securities.where(F.col("delisting_date") <= on(cutoff))


def status(securities: DataFrame, as_of) -> DataFrame:
    state = F.when(F.col("delisting_date") <= on(as_of), "delisted").when(F.col("listing_date") > on(as_of), "not_yet_listed").otherwise("active")
    return securities.withColumn("status", state)


def lookup(codes: DataFrame, securities: DataFrame) -> DataFrame:
    """codes (code) -> id: of current codes the lowest id, else of any earlier code (code_history) the lowest id."""
    now = securities.select(F.col("code").alias("c"), "id", F.lit(0).alias("way"))
    then = securities.select(F.explode("code_history.code").alias("c"), "id", F.lit(1).alias("way"))
    w = Window.partitionBy("code").orderBy("way", "id")
    rows = codes.join(now.union(then), F.col("code") == F.col("c"), "left").withColumn("_r", F.row_number().over(w))
    return rows.where("_r = 1").select("code", "id", F.when(F.col("way") == 1, True).otherwise(False).alias("historic"))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Built-in functions know no compatibility forms."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def search(securities: DataFrame, query: str, as_of, limit: int = 20, delisted: bool = False) -> DataFrame:
    """Digits match codes, those of ``code_history`` too; other text names, both in NFKC and any case. Matches anywhere,
    prefixes first (a code: equal to the query with leading zeros), then by name."""
    query = unicodedata.normalize("NFKC", query).strip()
    rows = securities if delisted else listed(securities, as_of)
    if query.isdigit():
        past = F.col("code_history.code") if "code_history" in rows.columns else F.array().cast("array<string>")
        rows = rows.withColumn("_codes", F.concat(F.array("code"), F.coalesce(past, F.array().cast("array<string>"))))
        there, prefix = F.exists("_codes", lambda c: c.contains(query)), F.array_contains("_codes", query.zfill(6))
    else:
        rows = rows.withColumn("_codes", F.lower(nfkc("name")))
        there, prefix = F.col("_codes").contains(query.lower()), F.col("_codes").startswith(query.lower())
    return rows.withColumn("prefix", prefix).where(there).orderBy(F.desc("prefix"), "name", "code").limit(limit).drop("_codes")


def normalised_codes(rows: DataFrame, column: str) -> DataFrame:
    """Distinct six-digit codes of the texts that are one to six digits within blanks."""
    text = F.trim(column)
    return rows.where(text.rlike("^[0-9]{1,6}$")).select(F.lpad(text, 6, "0").alias("code")).distinct()


def by_market(securities: DataFrame, as_of) -> DataFrame:
    return listed(securities, as_of).groupBy("market").agg(F.count("*").alias("n"))
