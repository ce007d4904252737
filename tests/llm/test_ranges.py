"""Key ranges reached in several hops: the same results as in one, and rows that do not grow with the square."""

import math
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm import katz, ranges, token_count  # noqa: E402
from tidemark.llm.common import bucket_of  # noqa: E402


def small_chunks(monkeypatch, module, fan, chunk_bytes, each):
    """Chunks, ranges and rows for a sender so small that the smallest tables need several hops."""
    packed = module.packed
    monkeypatch.setattr(module, "packed", lambda docs, x: packed(docs, x, chunk_bytes))
    monkeypatch.setattr(module, "RANGE", each)
    monkeypatch.setattr(ranges, "FAN", fan)


def test_route():
    for n in (1, 7, 8, 9, 64, 65, 500, 513, 10**5, 12_000_000):
        for most in (2, 8, 512):
            r = ranges.Route(n, most)
            assert r.fan <= most and r.ranges(r.hops) >= n and r.groups(r.hops) == 1
            assert r.hops == 1 or most ** (r.hops - 1) < n
    r, keys = ranges.Route(300, 8), katz.mix(katz.np.arange(10_000, dtype=katz.np.uint64))
    for hop in range(1, r.hops):  # a range lies within one range of the hop before
        assert (bucket_of(keys, r.ranges(hop + 1)) // r.fan == bucket_of(keys, r.ranges(hop))).all()
    assert len({r.sender(1, b, g) for b in range(r.fan) for g in range(r.groups(1))}) == r.ranges(r.hops)


@pytest.mark.parametrize("fan", [3, 6])
def test_token_counts_in_hops(spark, small, monkeypatch, fan):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(3)
    model = token_count.checked_model(token_count.model_path())
    want = sorted((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    small_chunks(monkeypatch, token_count, fan, 20_000, 9_000)
    got = token_count.token_counts(docs, token_count.model_path()).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


@pytest.mark.parametrize("fan", [3, 6])
def test_katz_in_hops(spark, small, monkeypatch, fan):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(3)
    want, total, _ = brute.katz([(r.doc_id, r.text) for r in docs.collect()], lambda i: brute.crc(i) % 5 == 1)
    small_chunks(monkeypatch, katz, fan, 20_000, 9_000)
    rows = katz.katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-10) and r.score == pytest.approx(score, rel=1e-10)


def most_rows(route, chunks):
    return route.fan * (chunks + (route.hops - 1) * route.ranges(route.hops))


@pytest.mark.parametrize("module", [token_count, katz])
def test_rows_grow_with_n_log_n(module):
    """From 0.1 to 100 TB at the real sizes of chunks and ranges; a single hop would send the square."""
    a, b = (most_rows(ranges.Route(size // module.RANGE), size // module.CHUNK) for size in (10**11, 10**14))
    assert math.log(b / a, 1000) < 1.2
    assert b < (10**14 // module.RANGE) * (10**14 // module.CHUNK) / 2_000


def test_rows_are_as_counted(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").coalesce(1)
    materialise, written = ranges.materialise, []
    monkeypatch.setattr(ranges, "materialise", lambda df, name, **how: written.append(materialise(df, name, **how)) or written[-1])
    for route in (ranges.Route(60, 8), ranges.Route(200, 6)):
        rows, written[:] = materialise(token_count.packed(docs, route.fan, 20_000), "rows"), []
        asks = rows.where("bucket IS NOT NULL").select("bucket", "chunk", "numbers", "words")
        ranges.exchange(asks, route, "rows", token_count.relayed(route), token_count.RELAYED)
        sent = asks.count() + sum(t.where("kids IS NULL").count() for t in written)
        chunks = rows.where("bucket IS NULL").count()
        assert len(written) == route.hops - 1 > 0 and 0 < sent <= most_rows(route, chunks)
        assert sent < chunks * route.ranges(route.hops)
