"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside Python tasks: ``bytes.lower()`` changes A-Z only and ``bytes.split()``
splits at exactly the six ASCII blanks (0x20, 0x09-0x0D), so both agree with the word rule used throughout.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule as Spark and DuckDB write it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one packed chunk of documents holds at most (a longer single text makes a longer chunk).
CHUNK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session, whose executor is the driver,
    gets one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
        path = f"{tempfile.gettempdir()}/tidemark-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Spark deletes the shuffle files of a statement as it ends (Spark 4.1).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor
    costs a read, not a recomputation. With ``drop_shuffles``, the shuffle files of the write, which nothing
    reads any more, are deleted with its end and not at some later collection of garbage."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no result reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(doc_id: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id's text leaves ``rest`` modulo ``mod``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


#: Rows of a batch that a task holds as Python objects, and hands back, at a time: a bound of its memory.
ROWS = 512


def parts(batch: pa.RecordBatch):
    """A batch in slices of ROWS rows, none of them copied."""
    for first in range(0, batch.num_rows, ROWS):
        yield batch.slice(first, ROWS)


class Hashes(dict):
    """word bytes -> signed 64-bit hash, remembered while it is small."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], memo: Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each window of ``n`` successive word hashes."""
    out = np.full(max(0, len(h) - n + 1), np.uint64(seed + n))
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as zstd over byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the key space, so that ascending keys fall into ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, buckets: int):
    """(bucket, first, end) of each bucket that ascending ``keys`` reach."""
    b = bucket_of(keys, buckets)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    return zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def shuffle_buckets(docs: DataFrame, text: str, each: int) -> int:
    """How many key ranges to use so that each stands for about ``each`` bytes of text; grows with the input."""
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(8, -(-total // each))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
