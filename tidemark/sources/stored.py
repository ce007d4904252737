"""Tables in the shared folder: results that several steps read, and views of the given tables kept for a session.

A view of facts is written once, bucketed by code: whatever then windows, aggregates or joins a code's facts finds them
together and needs no shuffle, and a query's plan reads tables instead of deriving each fact anew in every branch."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.views import TABLES, facts_bytes, spark_texts, spark_view


#: Bytes of the given tables of facts for each bucket: what bounds a task's windows and sorts, however large the tables.
BUCKET_BYTES = 4 << 20
#: Spark deletes the shuffle files of a statement as it ends (Spark 4.1).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where a session keeps how many buckets the views of the folder asked last have.
BUCKETS = "tidemark.buckets"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors reach; only a session whose executor is the driver may go without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
    return f"{tempfile.gettempdir()}/tidemark-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own: it is computed once, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a statement inside are deleted with its end, and not at some later collection of garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def state(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """What tells one state of these tables' files from another: sizes, counts and times."""
    jvm, conf, said = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        inside = fs.getContentSummary(path)
        said.append(f"{path.toString()} {inside.getLength()} {inside.getFileCount()} {fs.getFileStatus(path).getModificationTime()}")
    return "\n".join(said)


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """As many buckets for all views of a folder, so that they meet without a shuffle: they grow with its tables."""
    size = facts_bytes(spark, sf_dir)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def together(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one partition, of as many as kept views have buckets: such a view's rows then stay where they are."""
    n = rows.sparkSession.conf.get(BUCKETS, None)
    return rows.repartition(int(n), key) if n else rows.repartition(key)


def kept_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view from its table, which the first call in a session writes; again when the given tables have changed."""
    texts = list(spark_texts(name).values())
    tables = [t for t in TABLES if any("{" + t + "}" in text for text in texts)]
    key = zlib.crc32("\n".join([state(spark, sf_dir, tables), *texts]).encode())
    table = f"tidemark_{name}_{key:08x}"
    buckets = bucket_count(spark, sf_dir)
    spark.conf.set(BUCKETS, str(buckets))
    if not spark.catalog.tableExists(table):
        rows = spark_view(spark, sf_dir, name)
        path = f"{shared_folder(spark)}/tidemark/{table}-{uuid.uuid4().hex}"
        if "code" in rows.columns:
            rows.repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code").option("path", path).saveAsTable(table)
        else:
            rows.write.option("path", path).saveAsTable(table)
    return spark.table(table)
