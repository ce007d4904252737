"""Whitening, archives and hard negatives against plain numpy, Python and DuckDB."""

import gzip
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, topk, warc, whitening

VECTOR = "vec_id long, v array<long>, component int, n int, whitened string, x int"


def whitened_by_numpy(x, components):
    """(components' scores, shares explained) of the rows of x, by the singular vectors of all of them."""
    c = x - x.mean(0)
    _, sigma, w = np.linalg.svd(c, full_matrices=False)
    e, w = sigma**2 / len(c), w.T
    keep = min(components, int((sigma > 1e-11 * sigma[0]).sum()))
    return c @ w[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


def same_but_sign(rows, ids, want, shares, tolerance=1e-8):
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == want.size
    table = np.array([[got[i, k + 1].whitened for k in range(want.shape[1])] for i in ids])
    sign = np.sign((table * want).sum(0))
    assert np.abs(table * sign - want).max() < tolerance
    assert np.allclose([got[ids[0], k + 1].explained for k in range(want.shape[1])], shares, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_whitening(spark, small):
    data = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([np.floor(64 * np.array(r.embedding, np.float64)) for r in data]) + 1e6
    rows = whitening.op11(spark, small).collect()
    same_but_sign(rows, [r.vec_id for r in data], *whitened_by_numpy(x, 32))
    sums, n = [int(s) for s in x.sum(0)], len(x)
    want = {r.vec_id: sum((n * int(a) - s) ** 2 for a, s in zip(v, sums)) for r, v in zip(data, x)}
    assert all(r.deviation == want[r.vec_id] and r.n == n for r in rows)


def test_whitening_of_dependent_and_ill_conditioned_columns(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-1000, 1000, (300, 3))
    x = np.column_stack([a, a[:, 0] + a[:, 1], np.full(300, 7), a[:, 2] * 1_000_000, rng.integers(0, 2, 300)])  # rank 4 and a scale of 1e6
    rows = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")).collect()
    same_but_sign(rows, list(range(300)), *whitened_by_numpy(x.astype(float), 9), 1e-6)
    assert {r.component for r in rows} == {1, 2, 3, 4}


def test_whitening_odd(spark):
    rng = random.Random(5)
    good = [(i, [rng.randrange(50) for _ in range(4)]) for i in range(40)]
    good += [good[0], (None, good[1][1])]  # a repeated row, and one without an id
    odd = [(90, None), (91, []), (92, [1, 2])]
    rows = [(i, v, 1, 2, "w", 3) for i, v in good + odd]
    out = whitening.whiten(spark.createDataFrame(rows, VECTOR)).collect()
    assert len(out) == 4 * len(good) and {r.n for r in out} == {len(good)}
    assert sum(r.vec_id is None for r in out) == 4 and sum(r.vec_id == 0 for r in out) == 8
    table = np.array([[r.whitened for r in sorted(out, key=lambda r: r.component) if r.component == k] for k in range(1, 5)])
    assert np.abs(np.cov(table, bias=True) - np.eye(4)).max() < 1e-9
    for few in ([], rows[:1], rows[:1] * 3, [(90, None, 1, 2, "w", 3)]):
        assert whitening.whiten(spark.createDataFrame(few, VECTOR)).collect() == []


def decided(rows):
    """(page_id, url, html) rows -> [(page_id, bytes, digest, kind, refers_to)] by the rule for equal payloads."""
    out, groups = [], {}
    for i, _, t in rows:
        groups.setdefault(t or "", []).append(i)
    held = set()
    for i, _, t in rows:
        data = (t or "").encode()
        top = max(groups[t or ""], key=lambda x: (x is not None, x or 0))
        first = i == top and (t or "") not in held
        if first:
            held.add(t or "")
        kind = "response" if len(data) < 1000 or first else "revisit"
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, top if kind == "revisit" else None))
    return sorted(out, key=repr)


PAGE = "page_id long, url string, html string, h int, same string, kind int, shard string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages_of(rows, spark, parts=3):
    return spark.createDataFrame([(*r, 1, "s", 2, "x") for r in rows], PAGE).repartition(parts)


def odd_pages():
    big, other = "ä" * 700, "x" * 1000
    rows = [(i, f"http://h/{i}", big) for i in (3, 9, 5)] + [(9, "http://other/", big), (9, "http://h/9", big)]  # ties and an equal row
    rows += [(20, "http://h/20", other), (None, "http://n", other), (None, None, None), (21, None, ""), (22, "a b\r\nX-Page-Id: 1", "short"), (23, "u", "short")]
    rows += [(30, "l", "long text " * 300_000), (31, "l", "long text " * 300_000), (None, "n1", "y" * 2000), (None, "n2", "y" * 2000)]
    return rows


def test_archives_equal_duckdb(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = con.execute(warc.OP12_SQL).fetchall()
    got = [tuple(r) for r in warc.op12(spark, small).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_archives_odd(spark, parts, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 1 << 20)
    folder, manifest = warc.write_archives(pages_of(odd_pages(), spark, parts), file_bytes=2000)
    rows = warc.read_archives(folder, manifest).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == decided(odd_pages())
    ids = {r.record_id for r in rows}
    assert len(ids) == len(rows)
    texts = {(r.page_id, r.payload.decode()) for r in rows if r.record_type == "response"}
    assert texts <= {(i, t or "") for i, _, t in odd_pages()} and all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.url for r in rows if r.page_id == 22} == {"a b%0D%0AX-Page-Id: 1"}


def test_archives_are_the_same_however_rows_are_dealt(spark, small, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(warc, "DRAWN", 8)
    pages, seen = spark.read.parquet(f"{small}/pages.parquet"), []
    for parts in (1, 7):
        folder, manifest = warc.write_archives(pages.repartition(parts, F.rand(1)), file_bytes=10_000)
        files = {r.name: r.sha256 for r in manifest.collect()}
        assert len({n.split("-")[1] for n in files}) > 1 and len(files) > 4
        for name, digest in files.items():
            data = open(f"{folder}/{name}".removeprefix("file:"), "rb").read()
            assert hashlib.sha256(data).hexdigest() == digest
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        left = [x for x in os.listdir(folder.removeprefix("file:")) if x.endswith(".gz")]
        assert sorted(left) == sorted(files) and "_temporary" not in os.listdir(folder.removeprefix("file:"))
        seen.append(files)
    assert seen[0] == seen[1]


def test_archives_empty_and_damaged(spark):
    folder, manifest = warc.write_archives(pages_of([], spark))
    assert manifest.collect() == [] and warc.read_archives(folder, manifest).collect() == []
    whole = warc.page_record((1, 2, 0), 1, "u", b"payload", None, None, warc.DATE)
    import io

    assert [o for o, _ in warc.members(io.BytesIO(whole + whole))] == [0, len(whole)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(whole[:-9])))
    fields, block = warc.parsed(gzip.decompress(whole))
    with pytest.raises(ValueError, match="damaged"):
        warc.page_of(fields, block.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(gzip.decompress(whole).replace(b"payload", b"paYload"))


def test_a_second_commit_keeps_files(tmp_path):
    """Names are given again where the attempt that gave them was lost."""
    import pyarrow as pa

    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "a").write_bytes(b"12345")
    rows = pa.RecordBatch.from_pylist([{"shard": 0, "name": "n", "temporary": "_temporary/a", "records": 1, "bytes": 5, "sha256": ""}], warc.MANIFEST)
    for _ in range(2):
        list(warc.moved(str(tmp_path))([rows]))
    assert (tmp_path / "n").read_bytes() == b"12345"
    (tmp_path / "n").write_bytes(b"1")
    with pytest.raises(FileNotFoundError):
        list(warc.moved(str(tmp_path))([rows]))


def negatives_by_python(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if r[1] is not None and r[2]]
    out = []
    for a, label, v in (r for r in rows if anchors(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(i, n) for n, i, other in scored if other != label and -low * s <= -100 * n <= -high * s]
            out += [(a, p, k, i, -s, -n) for k, (i, n) in enumerate(fit[:negatives], 1)]
    return sorted(out)


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, **more):
    return sorted(tuple(r[c] for c in MINED) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0, **more).collect())


def test_hard_negatives_equal_duckdb(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(hard_negatives.OP13_SQL).fetchall()
    assert want and sorted(tuple(r[c] for c in MINED) for r in hard_negatives.op13(spark, small).collect()) == sorted(want)


def clustered(n, rng, dim=6, groups=8):
    centres = [[rng.randrange(-900, 900) for _ in range(dim)] for _ in range(groups)]
    return [(i, rng.randrange(3), [c + rng.randrange(-30, 30) for c in centres[rng.randrange(groups)]]) for i in range(n)]


def test_hard_negatives_in_many_regions(spark, monkeypatch):
    """Small regions and leaves: pairs of regions are dropped before anything is sent, and nothing is lost."""
    rng = random.Random(4)
    rows = clustered(900, rng)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(300)]  # a hot vector: a quarter of all rows
    links, written = [], hard_negatives.materialise

    def kept(df, name):
        out = written(df, name)
        if name == "pairs":
            links.append(out.count())
        if name == "regions":
            links.append(max(r["count"] for r in out.groupBy("region").count().collect()))
            links.append(out.select("region").distinct().count())
        return out

    monkeypatch.setattr(hard_negatives, "materialise", kept)
    for name, value in (("REGION", 64), ("LEAF", 8), ("FAN", 4), ("DRAWN", 8), ("QUERIES", 16), ("TOGETHER", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    assert mined(df) == negatives_by_python(rows, lambda i: i % 5 == 0)
    largest, regions, *pairs = links
    assert largest < 4 * 64 and regions >= 10
    assert pairs[0] < 0.7 * regions**2 and pairs[1] < regions**2


def test_hard_negatives_odd(spark):
    rng = random.Random(6)
    good = [(i, rng.randrange(2), [rng.randrange(-3, 4) for _ in range(3)]) for i in range(60)]  # many ties
    good += [(100, 0, [9, 9]), (101, 1, [8, 8]), (102, 0, [7, 7]), (105, 0, [0, 0, 0]), (110, 7, [1, 1, 1])]
    odd = [(200, None, [1, 1, 1]), (205, 1, None), (None, 1, [1, 1, 1]), (210, 1, [])]
    kind = "vec_id long, label int, v array<long>, region int, score string, x int, h int"
    df = spark.createDataFrame([(*r, 1, "s", 2, 3) for r in good + odd], kind)
    assert mined(df) == negatives_by_python(good, lambda i: i % 5 == 0)
    assert mined(df, positives=2, negatives=1, low=10, high=100) == negatives_by_python(good, lambda i: i % 5 == 0, 2, 1, 10, 100)
    twice = df.unionByName(df.where("vec_id < 20").withColumn("label", F.col("label") + 9))  # of one vec_id the smallest counts
    assert mined(twice) == mined(df)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 5")) == []


def test_boxes_of_large_numbers_are_not_too_small():
    """Scores beyond 2**53: bounds are inexact as doubles and take slack."""
    rng = np.random.default_rng(2)
    v = rng.integers(-(2**29), 2**29, (500, 4))
    tree = hard_negatives.Tree(hard_negatives.packed_tree(np.arange(500), np.zeros(500, np.int64), v), 4)
    q, none = v[:20], np.full((20, 1), hard_negatives.LOWEST)
    asks = hard_negatives.packed_anchors(np.arange(1000, 1020), np.zeros(20, np.int64), q, none, np.full((20, 1), hard_negatives.HIGHEST))
    (anchor, _, found, score), _ = hard_negatives.searched(tree, asks, 4, 3, True)
    s = q @ v.T
    want = {(a, int(i), int(s[a, i])) for a in range(20) for i in np.argsort(-s[a], kind="stable")[:3]}
    assert set(zip(anchor.tolist(), found.tolist(), score.tolist())) == want


def best_by_python(rows, k, is_query):
    out = []
    for q, v in (r for r in rows if is_query(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_pairs_of_blocks_are_dropped_before_vectors_are_sent(spark, monkeypatch):
    """Clustered vectors: most pairs of blocks cannot hold a best score; a hot vector and another length lose nothing."""
    rng = random.Random(11)
    centres = [[rng.randrange(-500, 500) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.randrange(-9, 10) for c in centres[rng.randrange(12)]]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one vector that a quarter of all rows have
    rows += [(2000 + i, [i, 1]) for i in range(30)]
    seen, written = {}, topk.materialise

    def kept(df, name):
        seen[name] = out = written(df, name)
        return out

    for name, value in (("BLOCK", 100), ("QUERY_BLOCK", 20), ("CELL", 16), ("FIRST", 256), ("POOL", 128), ("materialise", kept)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 5 == 0, 7, 16)
    assert sorted(map(tuple, got.collect())) == best_by_python(rows, 7, lambda i: i % 5 == 0)
    left = seen["block_pairs"].where("dim = 8")
    blocks = left.select("b").distinct().count() * left.select("c").distinct().count()
    assert blocks > 100 and left.count() < 0.5 * blocks
