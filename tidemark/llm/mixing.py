"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key; within its source documents stand in the order of (key, doc_id). The mix
takes a source's documents whole as often as the target allows, and then once more in that order up to the exact
rest of the budget. The cut is found by prefix sums in two levels: a source's key range is divided into about as
many equal ranges as the square root of its row count, the ranges' sums are accumulated, and only the range in
which the budget ends is summed row by row. Documents themselves are not sorted or moved: whether one lies before
the cut is a comparison with its source's cut key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise

#: Targets stop at so many times their source's size.
MOST = 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
SEED = 20240607
#: Columns of the result that replace a table's own.
RESULTS = ("size", "source_size", "target", "taken")
#: Source tables of up to so many rows (about 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with target. All sizes together are shared by weight; a share above ``most`` times
    its source's size is cut there and the excess reshared by weight among the others, until none is above.

    That ends where the sources with the lowest cap per weight are at their caps and the rest share what remains:
    a source is at its cap if the share per weight, with all before it in that order at their caps, exceeds its
    own cap per weight."""
    ranked = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    rows = sizes.withColumn("w", weight.cast("double")).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", rest).withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text, source) with size, source_size, target and taken: the words that
    the mix takes of this row, repeats counted. Existing columns of these names are replaced, all others stay.

    A null text has no words and is never taken. A null source is a source of its own, the last. Rows of a source
    with the same doc_id share a cut between them in proportion to their sizes, rounded down, so the result does
    not depend on the order of rows. Texts of any length count whole. Without words all targets are 0. An empty
    table gives an empty result.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))
    rows = materialise(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("size"), key.alias("key")), "sizes")
    ordered = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.sqrt(F.count("*"))).cast("long").alias("ranges"))
    plan = targets(sums.select("source", "source_size"), weights, most)
    plan = plan.withColumn("budget", F.round("target").cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    plan = materialise(plan.join(sums.select(F.col("source").alias("s"), "ranges"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")
    small = plan.count() <= BROADCAST_ROWS

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    # level one: sums of key ranges, and the range in which each source's rest ends
    unit = F.col("key").cast("double") / float(2**64) + 0.5  # rises with the key
    bucketed = with_source(rows.where("size > 0"), plan.select("source", "ranges", "rest")).withColumn("range", F.floor(unit * F.col("ranges")))
    ranges = bucketed.groupBy("source", "range").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("range")
    ends = ranges.withColumn("before", F.sum("n").over(upto) - F.col("n")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    ends = materialise(with_source(plan.select("source"), ends.select("source", "range", "before")), "ends")

    # level two: the documents of that range, and the one in which the rest ends
    last = with_source(bucketed, ends.select("source", F.col("range").alias("end"), "before")).where(F.col("range") == F.col("end"))
    last = last.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    step = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNotNull(), "doc_id")
    last = last.withColumn("from", F.col("before") + F.sum("n").over(step) - F.col("n")).where((F.col("from") <= F.col("rest")) & (F.col("from") + F.col("n") > F.col("rest")))
    cuts = last.select("source", ordered.alias("cut"), F.col("n").alias("cut_n"), (F.col("rest") - F.col("from")).alias("part"))
    plan = materialise(with_source(plan, cuts), "cuts")

    # whole rows travel as one column, so none of theirs can clash with the plan's
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    here = F.struct(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id")).alias("here")
    out = with_source(docs.select(row, "source", words_of(F.col("text")).alias("size"), here), plan.select("source", "source_size", "target", "epochs", "cut", "cut_n", "part"))
    size, here = F.col("size"), F.col("here")
    rest = F.when(here < F.col("cut"), size).when(here == F.col("cut"), F.floor(F.col("part") * size / F.col("cut_n")).cast("long")).otherwise(0)
    taken = (F.col("epochs") * size + F.coalesce(rest, F.lit(0))).cast("long")
    return out.select("row.*", "size", "source_size", "target", taken.alias("taken"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
