"""WARC archives: a deterministic sharded writer and a reader.

Which records repeat a payload is decided on a narrow table of ids, digests and sizes; a payload is sent once, to its
shard. Shards are key ranges with about the same number of bytes; their bounds come from the rows whose key hash is a
multiple of some number, so they follow from the rows alone and not from how Spark split them. Decisions travel to
the shards as rows of their own and meet the record that they are about in the sort order. A task takes the records of
its shard in key order, makes their headers and digests anew, compresses each by itself and begins a new file when
the one at hand is large enough: equal rows give equal files, however often and in however many tasks.

Commit: a task writes under names of its own in ``_temporary`` and returns a row for each file. Spark keeps the rows of
one attempt only; files of lost or repeated attempts are in no row. A second step gives the files of the rows their
final names, which may be done again, and its table ``manifest`` is what readers go by: without it there is no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, shared_dir

#: Payloads below this number of bytes are always stored.
REVISIT_BYTES = 1000
#: Bytes of payload that a shard stands for, and how many shards there are at most: beyond, shards grow.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 8192
#: Rows that the bounds are drawn from, for each shard.
DRAWN = 32
#: Compressed bytes at which a file ends.
FILE_BYTES = 64 << 20
#: The day records are dated by default, the profile of a record that repeats a payload.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(*key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, key)))}>"


def header(value: str) -> str:
    """A value that ends its line nowhere but at the end."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record, compressed by itself."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {header(v)}" for k, v in fields), f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def page_record(key: tuple, page_id, url: str | None, payload: bytes, to: tuple | None, to_page, date: str) -> bytes:
    """The record of a page: its payload, or where ``to`` is given, that it equals the payload of that record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(*key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest()))]
    if to is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*to))]
    if to_page is not None:
        fields.append(("X-Refers-To-Page-Id", str(to_page)))
    return record("revisit", fields, http)


class Files:
    """The files of one task: opened when needed, ended when large enough."""

    def __init__(self, uri: str, prefix: str, limit: int, date: str):
        self.fs, self.path = store(uri)
        self.prefix, self.limit, self.date, self.own = prefix, limit, date, uuid.uuid4().hex
        self.out, self.part, self.done = None, 0, []

    def write(self, shard: int, data: bytes) -> None:
        if self.out is None:
            self.shard, self.name = shard, f"{self.prefix}-{shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.own}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
            about = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.prefix}\r\n".encode()
            self.put(record("warcinfo", [("WARC-Record-ID", record_id(self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self.put(data)
        self.records += 1
        if self.size >= self.limit:
            self.end()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
            self.out, self.part = None, self.part + 1


MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
MANIFEST_SQL = "shard int, name string, temporary string, records long, bytes long, sha256 string"


def writes(uri: str, prefix: str, limit: int, date: str):
    """Rows of a shard in order (page_id, h, same, kind) to its files; kind 0 tells what the next record repeats."""

    def run(batches):
        files, at, told, place = Files(uri, prefix, limit, date), None, None, 0
        for b in batches:
            for r in b.to_pylist():
                key = (r["page_id"], r["h"], r["same"])
                if key != at:
                    at, told, place = key, None, 0
                if not r["kind"]:
                    told = (r["to_id"], r["to_h"], 0)
                    continue
                payload, to = r["payload"], None
                if len(payload) >= REVISIT_BYTES:  # of equal rows the first stands for all
                    to = told or ((r["page_id"], r["h"], 0) if place else None)
                own = (r["page_id"], r["h"], place)
                files.write(r["shard"], page_record(own, r["page_id"], r["url"], payload, to, to[0] if to else None, date))
                place += 1
        files.end()
        if files.done:
            yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, x)) for x in files.done], MANIFEST)

    return run


def moved(uri: str):
    """Give files their final names. A file that has it already, from a lost attempt of this step, stays."""

    def run(batches):
        where, path = store(uri)
        for b in batches:
            for r in b.to_pylist():
                old, new = f"{path}/{r['temporary']}", f"{path}/{r['name']}"
                if where.get_file_info(old).type != fs.FileType.NotFound:
                    where.move(old, new)
                elif where.get_file_info(new).size != r["bytes"]:
                    raise FileNotFoundError(f"{old}, and {new} is not whole")
            yield b

    return run


def shard_of(bounds: list[tuple[int | None, int]]):
    """The number of bounds at or below (page_id, h), null first."""
    least = np.iinfo(np.int64).min
    at = np.array([(least if p is None else p, h) for p, h in bounds], np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def run(page_id: pd.Series, there: pd.Series, h: pd.Series) -> pd.Series:
        p, x = page_id.to_numpy(np.int64), h.to_numpy(np.int64)
        p = np.where(there, p, least)
        first, last = np.searchsorted(at[:, 0], p, "left"), np.searchsorted(at[:, 0], p, "right")
        out = last.copy()
        for k in np.flatnonzero(first != last):  # bounds within one page_id
            out[k] = first[k] + np.searchsorted(at[first[k] : last[k], 1], x[k], "right")
        return pd.Series(out.astype(np.int32))

    return lambda page_id, h: run(F.coalesce(page_id, F.lit(0)), page_id.isNotNull(), h)


def drawn_bounds(narrow: DataFrame, rows: int, total: int) -> list[tuple[int | None, int]]:
    """Bounds of key ranges of about equal bytes, from some DRAWN rows a shard."""
    shards = max(1, min(MOST_SHARDS, -(-total // SHARD_BYTES)))
    if shards == 1:
        return []
    every = max(1, rows // (shards * DRAWN))
    some = narrow.where(F.pmod(F.xxhash64("h", "page_id"), F.lit(every)) == 0).select("page_id", "h", "bytes").collect()
    some = sorted((r.page_id is not None, r.page_id or 0, r.h, r.bytes + 1) for r in some)
    upto = np.cumsum([x[3] for x in some])
    if not len(upto):
        return []
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return [(some[c][1] if some[c][0] else None, some[c][2]) for c in sorted(set(cuts.tolist()))]


def write_archives(pages: DataFrame, folder: str | None = None, prefix: str = "pages", file_bytes: int = FILE_BYTES, date: str = DATE) -> tuple[str, DataFrame]:
    """(folder, manifest: shard, name, records, bytes, sha256) of the archives with a record for each row of ``pages``.

    ``pages``: page_id, url, html; other columns are ignored. A null html is an empty payload, a null url or page_id has
    no header. Of records with equal payloads of REVISIT_BYTES or more the one with the largest page_id holds it
    (ties: the largest hash of url and payload, and of equal rows one; null is smaller than any), the others refer to
    it. Texts of any length are stored whole; a record is held in memory while it is made. An empty table makes no
    file. Rows are sorted by page_id, then that hash; only rows equal in all three columns must share a shard.
    ``folder``: where to write, by default a new folder of the shared one; it may be any place pyarrow.fs opens.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string")
    same = F.unhex(F.sha2(payload, 256))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), same.alias("same")).withColumn("h", F.xxhash64("url", "same"))
    narrow = materialise(rows.select("page_id", "h", "same", F.octet_length("payload").cast("long").alias("bytes")), "warc-keys")
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bounds = drawn_bounds(narrow, n, total)
    shard = shard_of(bounds)

    long = narrow.where(F.col("bytes") >= REVISIT_BYTES)
    top = long.groupBy("same").agg(F.max(F.struct("page_id", "h")).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = ~(F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("h") == F.col("top.h")))
    notes = long.join(top, "same").where(other).select("page_id", "h", "same", F.lit(0).alias("kind"), F.col("top.page_id").alias("to_id"), F.col("top.h").alias("to_h"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    both = both.withColumn("shard", shard(F.col("page_id"), F.col("h")))
    dealt = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("page_id", "h", "same", "kind")

    where, path = store(folder)
    where.create_dir(f"{path}/_temporary", recursive=True)
    written = materialise(dealt.mapInArrow(writes(folder, prefix, file_bytes, date), MANIFEST_SQL), "warc-files")
    final = written.repartition(max(1, min(1000, len(bounds) + 1))).mapInArrow(moved(folder), MANIFEST_SQL)
    final.drop("temporary").write.parquet(f"{folder}/manifest")
    where.delete_dir(f"{path}/_temporary")
    discard(narrow, written)
    return folder, spark.read.schema("shard int, name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def members(stream):
    """(offset, bytes) of each compressed record of a file, which is read in parts."""
    rest, offset, inflate, out, used = b"", 0, zlib.decompressobj(31), [], 0
    while data := rest or stream.read(READ):
        rest = b""
        out.append(inflate.decompress(data))
        used += len(data) - len(inflate.unused_data)
        if inflate.eof:
            yield offset, b"".join(out)
            rest, offset = inflate.unused_data, offset + used
            inflate, out, used = zlib.decompressobj(31), [], 0
    if used:
        raise ValueError(f"a record at {offset} is cut off")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"a record is damaged: {fields.get('WARC-Record-ID')}")
    return fields, block


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; the digest of a payload that is there is taken anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"]
    if kind == "response" and base32(hashlib.sha1(payload).digest()) != said:
        raise ValueError(f"a payload is damaged: {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_id": fields["WARC-Record-ID"], "record_type": kind, "payload_bytes": size,
        "payload_digest": base64.b32decode(said.removeprefix("sha1:")).hex(), "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None,
    }


RECORDS = pa.schema([(c, pa.int64() if c in ("page_id", "payload_bytes", "refers_to", "offset") else pa.binary() if c == "payload" else pa.string()) for c in ("page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "file", "offset")])


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each page record of the manifest's files: page_id, url, record_id, record_type, payload_bytes,
    payload_digest (SHA-1, hexadecimal), refers_to, payload (null for revisits), file, offset. Digests are checked; a
    damaged record is an error. Files are dealt to tasks and read in parts."""
    schema = RECORDS if payloads else pa.schema([f for f in RECORDS if f.name != "payload"])
    sql = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in schema)

    def run(batches):
        where, path = store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for offset, data in members(stream):
                        fields, block = parsed(data)
                        if fields["WARC-Type"] != "warcinfo":
                            rows.append(page_of(fields, block) | {"file": name, "offset": offset})
                            held += len(block)
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.count()
    return manifest.select("name").repartition(max(1, files)).mapInArrow(run, sql)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
 CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM q
"""
