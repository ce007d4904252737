"""The loads as micro-batches: what a batch load appends, a stream of landed files appends too."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.loads import appended, chained, once
from tidemark.sources.stored import shuffles_dropped


def append_stream(spark: SparkSession, landed: str, schema: str, target: str, checkpoint: str, keys: list[str], by: str | None = None) -> None:
    """Append the rows of all files landed so far to the Parquet table ``target``, keys already stored being
    ignored; returns when they are in. A batch that is run again adds nothing, as its keys are stored.

    ``by``: one of the keys with few values in a batch (the day, say), which then partitions the target; a batch reads
    only the partitions of its own values, however long the table has grown."""

    def write(batch: DataFrame, _: int) -> None:
        try:
            stored = spark.read.schema(batch.schema).parquet(target)
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            new = once(batch, keys)
        else:
            if by:
                stored = stored.where(F.col(by).isin([r[0] for r in batch.select(by).distinct().collect()]))
            new = appended(stored, batch, keys)
        writer = new.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(target)

    rows = spark.readStream.schema(schema).parquet(landed)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: How many parts the versions of restated facts are dealt to by their keys; a batch rewrites only those that it meets.
PARTS = 64


def restatement_stream(spark: SparkSession, landed: str, schema: str, target: str, checkpoint: str, keys: list[str], parts: int = PARTS) -> None:
    """Keep the chains of restated facts in the Parquet table ``target`` (the landed columns, superseded_by, part) up to
    date with all reports landed so far: rows of id, keys (the account among them), effective_date, receipt and values.

    The table is the state: for each key all versions, linked in the order of (effective_date, receipt). A batch takes
    the parts of its keys, adds what is new and links them again, so files may come late, in any order, or twice, and a
    batch that failed may be run again: the result is that of one batch over all files. Accounts missing from a
    report stay as they are. ``parts`` stays what it was when the table was begun.

    All files landed since the last run are one batch, however many: keys stand in any file, so each batch takes and
    writes all that is stored, and batches of some files each would do so the more often the more is landed.

    A batch needs the disk of one shuffle of its parts and of these parts as they become: nothing is written beside them. Old
    parts are replaced when all new ones are there, so they may be read until then."""

    def write(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession  # the stream's, which plans without regard to sizes
        own.conf.set("spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled"))
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        met = [r[0] for r in batch.select("part").distinct().collect()]  # at most ``parts``
        if not met:
            return
        try:
            stored = own.read.parquet(target).where(F.col("part").isin(met)).select(*batch.columns)
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = batch.where("false")
        new = chained(stored.unionByName(batch), keys)
        with shuffles_dropped(own):
            new.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    rows = spark.readStream.schema(schema).parquet(landed)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
