"""Token counts of whole texts for a sentencepiece BPE model, without the ids of any text.

The model's normaliser is the identity with a leading blank, and none of its pieces has a blank after another
character or holds a line feed. So no merge crosses the place before a run of blanks or either side of a line
feed: a text falls into pre-tokens there, and its count is the sum of its pre-tokens' counts. ``checked_model``
verifies these properties of the model that it loads.

Documents are packed in chunks that hold how often each document has each of the chunk's distinct pre-tokens.
Chunks send their distinct pre-tokens, once each, to the group of their key range, in as many hops as the number of
ranges needs (:mod:`tidemark.llm.ranges`); there each distinct pre-token of the corpus is counted once, and the counts
go back to the chunks, where they meet the frequencies.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, pack, shuffle_buckets, slices, text_bytes, unpack
from tidemark.llm.ranges import Route, exchange, returned

LIMIT = 4096
CHUNK = 12 << 20
#: Bytes of text for each key range.
RANGE = 8 << 20
#: sentencepiece shows a blank as this character and takes it for one in a text.
BLANK = "▁".encode()
PRE_TOKEN = re.compile(rb"\n| *[^ \n]+| +")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def checked_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁|\n", p) for p in pieces) or model.encode("ﬁ  x ", out_type=str) != ["▁", "ﬁ", "▁", "▁x", "▁"]:
        raise ValueError("this model's merges can cross pre-tokens")
    return model


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text with the blank that the model puts in front; none for an empty text."""
    return PRE_TOKEN.findall(b" " + text.replace(BLANK, b" ")) if text else []


def piece_counts(words: list[bytes], model) -> list[int]:
    """Pieces of each pre-token within a text: a line feed before it takes the model's leading blank; the two
    cost two pieces."""
    return [len(ids) - 2 for ids in model.encode(["\n" + w.decode() for w in words], num_threads=1)]


def message(words: list[bytes]) -> tuple[bytes, bytes]:
    """Pre-tokens as their sizes and their bytes."""
    return pack(np.array([len(w) for w in words], np.uint32)), zstandard.compress(b"".join(words), 1)


def messages(pdf: pd.DataFrame) -> list[list[bytes]]:
    """The pre-tokens of each row."""
    out = []
    for sizes, words in zip(pdf["numbers"], pdf["words"]):
        raw, ends = zstandard.decompress(words), np.cumsum(unpack(sizes, np.uint32), dtype=np.int64).tolist()
        out.append([raw[i:j] for i, j in zip([0, *ends], ends)])
    return out


def by_key(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of pre-tokens, ascending, and the order in which they ascend."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    up = np.argsort(keys, kind="stable")
    return keys[up], up


def packed(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK) -> DataFrame:
    """Two kinds of rows. bucket null: a chunk's document ids, sizes in bytes, how many distinct pre-tokens each
    document has, their numbers and frequencies. Otherwise: the chunk's distinct pre-tokens of one key range, in
    the order of their numbers."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0

        def rows():
            chunk = part * 1_000_000 + seq
            words = list(vocab)
            keys, up = by_key(words)
            place = np.empty(len(words), np.uint32)
            place[up] = np.arange(len(words), dtype=np.uint32)
            out = [(None, chunk, ids, sizes, [len(x) for x, _ in found], pack(place[np.concatenate([x for x, _ in found])]), pack(np.concatenate([n for _, n in found]).astype(np.uint32)), None)]
            for bucket, i, j in slices(keys, buckets):
                numbers, sent = message([words[k] for k in up[i:j]])
                out.append((bucket, chunk, None, None, None, numbers, None, sent))
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "chunk", "doc_id", "n_bytes", "n_words", "numbers", "times", "words"])

        def fresh():
            v = defaultdict()
            v.default_factory = v.__len__
            return v, [], [], [], 0

        vocab, ids, sizes, found, held = fresh()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                words = pre_tokens(text)
                ids.append(i)
                sizes.append(len(text))
                found.append(np.unique(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)), return_counts=True))
                held += len(text) + 64
                if held >= chunk_bytes:
                    yield rows()
                    seq += 1
                    vocab, ids, sizes, found, held = fresh()
        if ids:
            yield rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket int, chunk long, doc_id array<long>, n_bytes array<long>, n_words array<int>, numbers binary, times binary, words binary")


def counted(path: str):
    """Counts the distinct pre-tokens of one key range and tells each chunk the counts of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = checked_model(path)
        asked = messages(pdf)
        distinct = list(set().union(*asked))
        of = dict(zip(distinct, piece_counts(distinct, model)))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "pieces": [pack(np.fromiter(map(of.__getitem__, words), np.uint32, len(words))) for words in asked]})

    return run


RELAYED = "bucket int, grp int, chunk long, numbers binary, words binary, kids array<long>, places array<binary>"


def relayed(route: Route):
    """For each hop, the function that merges the pre-tokens asked for by one group and asks for them, once each."""

    def at(hop: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            bucket, group, asked = int(pdf["bucket"].iloc[0]), int(pdf["grp"].iloc[0]), messages(pdf)
            sender, words = route.sender(hop, bucket, group), list(dict.fromkeys(w for own in asked for w in own))
            keys, up = by_key(words)
            words = [words[k] for k in up]
            place = dict(zip(words, range(len(words))))
            out = [(b, group % route.groups(hop + 1), sender, *message(words[i:j]), None, None) for b, i, j in slices(keys, route.ranges(hop + 1))]
            places = [pack(np.fromiter(map(place.__getitem__, own), np.uint32, len(own))) for own in asked]
            out.append((bucket, group, sender, None, None, pdf["chunk"].tolist(), places))
            return pd.DataFrame(out, columns=["bucket", "grp", "chunk", "numbers", "words", "kids", "places"])

        return run

    return at


def given(_: int):
    """The function that tells each sender of a group the counts of its own pre-tokens."""

    def run(_, kept: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r = kept.iloc[0]
        pieces = np.concatenate([unpack(x, np.uint32) for x in told.sort_values("bucket")["pieces"]])
        return pd.DataFrame({"chunk": r["kids"], "bucket": r["bucket"], "pieces": [pack(pieces[unpack(x, np.uint32)]) for x in r["places"]]})

    return run


def summed(_, chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    r = chunk.iloc[0]
    told = told.sort_values("bucket")
    pieces = np.concatenate([np.zeros(0, np.uint32), *(unpack(x, np.uint32) for x in told["pieces"])]).astype(np.int64)
    n = pieces[unpack(r["numbers"], np.uint32)] * unpack(r["times"], np.uint32) if len(pieces) else np.zeros(0, np.int64)
    ends = np.cumsum(r["n_words"])
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = pd.array([None if i is None or i != i else int(i) for i in r["doc_id"]], "Int64")
    return pd.DataFrame({"doc_id": ids, "n_bytes": r["n_bytes"], "n_tokens": upto[ends] - upto[ends - r["n_words"]]})


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_bytes, n_tokens,
    over_limit, for the sentencepiece model at ``path`` (a file that every executor has, as the library needs).

    A null or empty text has no bytes and no tokens. Texts of any length count whole; one longer than a chunk is a chunk
    of its own. Repeated rows and null ids are rows like others. An empty table gives an empty result.
    """
    route = Route(shuffle_buckets(docs, "text", RANGE))
    rows = materialise(packed(docs, route.fan), "pre_tokens")
    asks = rows.where("bucket IS NOT NULL").select("bucket", "chunk", "numbers", "words")
    asks, kept = exchange(asks, route, "pre_tokens", relayed(route), RELAYED)
    told = asks.groupBy("bucket").applyInPandas(counted(path), "chunk long, bucket int, pieces binary")
    told = returned(told, kept, given, "chunk long, bucket int, pieces binary")
    chunks = rows.where("bucket IS NULL").select("chunk", "doc_id", "n_bytes", "n_words", "numbers", "times")
    counts = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(summed, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, model_path())
