"""Stored factor values: a table partitioned by date, written whole partitions at a time, and served where it is current.

A snapshot is every factor of a pack for every listed security on one date, with its unit, the inputs it read, the
versions it rests on, and why a value is missing. Codes whose facts contradict themselves are left out and told in a
frame of rejects, so that one of them does not spoil the others."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formulas
from tidemark.operators import adjust, pit
from tidemark.plans import factors
from tidemark.plans.fields import fields
from tidemark.plans.screen import only_codes
from tidemark.sources.stored import written

#: Units of the built-in factors.
UNITS = {
    "fac_mcap_ex_treasury": "krw", "fac_mcap_official": "krw", "fac_per_ttm": "ratio", "fac_per_annual": "ratio", "fac_per_official": "ratio", "fac_pbr": "ratio", "fac_roe_ttm": "ratio",
    "fac_eps_ttm": "krw", "fac_dividend_yield": "percent", "fac_turnover_20d": "percent", "fac_total_return_1y": "percent",
    "fac_ffo_multiple_reit": "ratio", "fac_dividend_yield_reit": "percent",
}
KEYS = ["code", "as_of", "factor"]
SCHEMA = "code string, factor string, value double, unit string, reason string, inputs map<string,boolean>, versions map<string,string>, as_of date"


def faulty(view) -> DataFrame:
    """code, error of codes whose bars or actions contradict themselves: a day given twice, an unknown or impossible action."""
    return adjust.input_errors(view("bars"), view("actions")).groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("error"))


def computed(view, as_of: str, names: list[str], versions: dict[str, str], trees: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot rows, rejects): the factors of every listed security as of the date, and the codes left out with why."""
    trees = trees or factors.BUILT_IN
    rejects = written(faulty(view), "rejects")
    order, stored = factors.plan(names, trees)
    rows = formulas.with_factors(fields(only_codes(view, rejects, "left_anti"), as_of, stored), order)
    one = lambda n: F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("value"), F.lit(UNITS.get(n)).alias("unit"), F.col(f"{n}_reason").alias("reason"), formulas.read_inputs(order[n]).alias("inputs"))
    rows = rows.select("code", F.explode(F.array(*map(one, names))).alias("x")).select("code", "x.*")
    pairs = [F.lit(x) for kv in sorted(versions.items()) for x in kv]
    rows = rows.withColumns({"versions": F.create_map(*pairs).cast("map<string,string>"), "as_of": pit.on(as_of)})
    return rows.select(*(c.split(" ")[0] for c in SCHEMA.split(", "))), rejects


def read(spark: SparkSession, folder: str, as_of: str | None = None) -> DataFrame:
    """The stored snapshots, of one date only its partition; none where nothing has been stored."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows if as_of is None else rows.where(F.col("as_of") == pit.on(as_of))


def save(rows: DataFrame, folder: str) -> None:
    """Store rows by (code, as_of, factor), new ones winning: the partitions of their dates are replaced, each as a
    whole, and no other is read or written. Saving the same rows again changes nothing."""
    rest = [c for c in rows.columns if c not in KEYS]
    order = F.struct(*(F.to_json(c) if dict(rows.dtypes)[c].startswith("map") else F.col(c) for c in rest))
    once = rows.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*KEYS, "_row.*").select(*rows.columns)
    new = written(once, "snapshot")
    dates = [r[0] for r in new.select("as_of").distinct().collect()]
    if dates:
        old = read(rows.sparkSession, folder).where(F.col("as_of").isin(dates)).join(new.select(*KEYS), KEYS, "left_anti")
        both = written(new.unionByName(old), "partitions")
        both.repartition(len(dates), "as_of").write.partitionBy("as_of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def served(stored: DataFrame, names: list[str], versions: dict[str, str], never: tuple[str, ...] = factors.NEVER_SERVED) -> DataFrame:
    """code and a column for each factor, of the codes for which all factors are stored under just these versions; none
    if one of the factors is of those that are never served (they depend on dividends)."""
    if set(names) & set(never):
        return stored.select("code", *(F.lit(None).cast("double").alias(n) for n in names)).where("false")
    current = F.create_map(*(F.lit(x) for kv in versions.items() for x in kv))
    same = F.array_sort(F.map_entries("versions")) == F.array_sort(F.map_entries(current))
    rows = stored.where(F.col("factor").isin(*names)).groupBy("code").agg(
        F.countDistinct("factor").alias("_n"), F.bool_and(F.coalesce(same, F.lit(False))).alias("_same"), *(F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in names)
    )
    return rows.where((F.col("_n") == len(names)) & F.col("_same")).select("code", *names)
