"""Exact top-k by integer inner product with a pivot table.

Every vector's distances to P pivots are computed once and written beside it: the pivot table. By the triangle
inequality the distance of a query and a candidate is at least the largest difference of their distances to a
pivot; so <q, v> = (|q|^2 + |v|^2 - |q - v|^2) / 2 is at most the bound that this distance gives.

A first look at a fixed number of vectors, the same for all queries, tells each query a score that its k-th best
reaches at least; every block starts from there. Candidates are dealt into blocks of at most about BLOCK rows and queries
into blocks of QUERY_BLOCK, each of vectors with the same nearest pivot, or a few if that is little; many vectors near
one pivot fill several blocks.
A block's least and largest distance to each pivot bound what any of its vectors may score with any of another block,
and pairs of blocks that stay below what every query is sure of are dropped before a vector is sent. A pair of
blocks that is left is one group. In it candidates lie in cells of CELL rows near one
pivot, which are taken in the order of their bounds (from the cell's least and largest distances). In a cell the
candidates whose own bound reaches a query's k-th score so far are evaluated, as one product for all queries that
have any; a query leaves when no cell left can reach its k-th score. Equal bounds are still evaluated, so ties are
exact. A group returns the k best of its candidates for each query, and these are merged. Groups have a fixed size,
whatever vectors repeat.

The work is queries x rows at most, as the query set is a share of the rows; each candidate is sent at most once for
each block of queries. Where the distances tell vectors apart little (random directions in many dimensions, as in the
given tables) pivots eliminate some 3% of the candidates and the products do the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise

K = 20
PIVOTS = 32
#: Vectors that pivots are chosen from, and vectors of the first look: both a fixed number, whatever the table.
POOL, FIRST = 1024, 2048
BLOCK, QUERY_BLOCK = 8192, 8192
CELL, QUERIES = 512, 256
#: Pairs of blocks that are few enough to be sent to every task.
BROADCAST_PAIRS = 100_000
#: More than rounding takes away from a bound, as a share of the two squared lengths, and in itself.
SLACK = 1e-5
#: The same for a distance, as a share of the greatest to its pivot.
ROUNDING = 1e-6


def drawn_rows(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, vectors) of the ``n`` rows with the smallest hashes, of those the ones with most components."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "v").limit(n).collect()
    longest = max((len(r.v) for r in rows), default=0)
    rows = [r for r in rows if len(r.v) == longest]
    return np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.int64).reshape(len(rows), longest)


def far_apart(pool: np.ndarray, pivots: int) -> np.ndarray:
    """Up to ``pivots`` rows of ``pool``, each the one farthest from those before it."""
    pool = pool.astype(np.float64)
    if not len(pool):
        return pool
    picked, gap = [0], ((pool - pool[0]) ** 2).sum(1)
    while len(picked) < min(pivots, len(pool)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((pool - pool[picked[-1]]) ** 2).sum(1))
    return pool[picked]


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where products are whole below 2**53, and so exact; else as they are."""
    return x.astype(np.float64) if (x.astype(np.float64) ** 2).sum(1).max(initial=0) < 2**50 else x


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    same = q.dtype == c.dtype
    return q @ c.T if same else q.astype(np.int64) @ c.astype(np.int64).T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if pivots.shape[1:] != x.shape[1:] or not len(pivots):
        return np.zeros((len(x), 1), np.float32)  # no bound beyond the lengths
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T)).astype(np.float32)


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists have one length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(rows, -1)


def with_pivots(rows: DataFrame, pivots: np.ndarray, first_ids: np.ndarray, first: np.ndarray, k: int) -> DataFrame:
    """vec_id, v, q, dim with d (distances to the pivots) and, for queries, least: a score that the k-th best reaches."""
    first = exact(first)

    def run(batches):
        for b in batches:
            ids, dims, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 2))
            for dim in np.unique(dims).tolist():
                on = np.flatnonzero(dims == dim)
                part = b.take(pa.array(on))
                v = matrix(part.column(1), len(on))
                d = distances(v, pivots)
                least = np.full(len(on), np.iinfo(np.int64).min)
                wanted = np.flatnonzero(asks[on])
                if first.shape[1] == dim and len(first) > k and len(wanted):
                    s = products(exact(v[wanted]), first).astype(np.int64)
                    s[ids[on][wanted][:, None] == first_ids] = np.iinfo(np.int64).min
                    least[wanted] = np.partition(s, -k, axis=1)[:, -k]
                offsets = pa.array(np.arange(len(on) + 1, dtype=np.int32) * d.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1))), pa.array(least)], ["vec_id", "v", "q", "dim", "d", "least"])

    return rows.select("vec_id", "v", "q", "dim").mapInArrow(run, "vec_id long, v array<long>, q boolean, dim int, d array<float>, least long")


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Of hits (query number, id, score) each query's k best, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], score[place < k]


def searched(qid, Q, dq, least, cid, C, dc, k: int):
    """(query number, id, score) of the k best candidates of each query that reach ``least``, and how many pairs
    were evaluated. Q and C: vectors; dq and dc: their distances to the pivots."""
    Q, C = exact(Q), exact(C)
    nq, nc = (Q.astype(np.float64) ** 2).sum(1).astype(np.float32), (C.astype(np.float64) ** 2).sum(1).astype(np.float32)
    order = np.lexsort((dc.min(1), dc.argmin(1)))
    cid, C, dc, nc = cid[order], C[order], dc[order], nc[order]
    cells = [slice(i, min(i + CELL, len(C))) for i in range(0, len(C), CELL)]
    low, high, longest = (np.array([f(x[c], 0) for c in cells]) for f, x in ((np.min, dc), (np.max, dc), (np.max, nc)))
    most = dc.max(0)
    found, evaluated = [], 0
    for at in range(0, len(Q), QUERIES):
        part = slice(at, min(at + QUERIES, len(Q)))
        d, n, kth = dq[part], nq[part], least[part].copy()
        off = ROUNDING * np.maximum(d.max(0), most)  # what rounding may add to a difference of distances
        gap = np.maximum(0, np.maximum(d[:, None] - high, low - d[:, None]) - off).max(2)
        reach = (n[:, None] + longest - gap**2) / 2 + SLACK * (n[:, None] + longest) + SLACK
        hits = [np.empty(0, np.int64)] * 3
        for c in np.argsort(-reach.max(0), kind="stable").tolist():
            asks = np.flatnonzero(reach[:, c] >= kth)
            if not len(asks):
                continue
            far = np.zeros((len(asks), cells[c].stop - cells[c].start), np.float32)
            for x, y, z in zip(d[asks].T, dc[cells[c]].T, off):
                np.maximum(far, np.abs(x[:, None] - y) - z, out=far)
            total = n[asks][:, None] + nc[cells[c]]
            open_ = (total * (1 + 2 * SLACK) - far * far) / 2 + SLACK >= kth[asks][:, None]
            open_ &= cid[cells[c]] != qid[part][asks][:, None]
            evaluated += int(open_.sum())
            rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(rows):
                continue
            s = products(Q[part][asks[rows]], C[cells[c]][columns])
            i, j = np.nonzero((s >= kth[asks[rows]][:, None]) & open_[np.ix_(rows, columns)])
            new = asks[rows][i], cid[cells[c]][columns[j]], s[i, j].astype(np.int64)
            hits = best_of(*(np.concatenate(x) for x in zip(hits, new)), k)
            full = np.bincount(hits[0], minlength=len(kth)) == k
            last = np.flatnonzero(np.diff(hits[0], append=-1))
            kth[full] = np.maximum(kth[full], hits[2][last][full[hits[0][last]]])
        found.append((hits[0] + at, hits[1], hits[2]))
    query, ids, score = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
    return query, ids, score, evaluated


def group_search(k: int):
    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 3
        if queries.num_rows and cands.num_rows:
            sides = []
            for x in (queries, cands):
                v, d = (matrix(x[c], x.num_rows) for c in ("v", "d"))
                sides += [x["vec_id"].to_numpy(), v, d]
            qid, Q, dq, cid, C, dc = sides
            number, ids, score, _ = searched(qid, Q, dq, queries["least"].to_numpy(), cid, C, dc, k)
            out = [qid[number], ids, score]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    return run


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null where the vector is null or a component is null or not finite."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def blocked(table: DataFrame, size: int, kind: str) -> DataFrame:
    """``table`` with ``kind``, the number of each row's block: of one length, and of about ``size`` rows at most. The
    rows near one pivot fill blocks of their own, or share one with those of others if together they are no more."""
    near = F.array_position("d", F.array_min("d")).cast("int")
    rows = table.withColumn("near", near)
    counts = rows.groupBy("dim", "near").count().orderBy("dim", "near").collect()  # a row for each pivot (and length)
    cases, first, room, dim = [], -1, 0, None
    for r in counts:
        parts = -(-r["count"] // size)
        if r.dim != dim or r["count"] > room:
            first, room, dim = first + 1, size, r.dim
        cases.append((r.dim, r.near, first, parts))
        first, room = first + parts - 1, room - r["count"] if parts == 1 else 0
    places = table.sparkSession.createDataFrame(cases, "dim int, near int, first long, parts long")
    return rows.join(F.broadcast(places), ["dim", "near"]).withColumn(kind, F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))).drop("near", "first", "parts")


def block_bounds(rows: DataFrame, kind: str, pivots: int, query: bool) -> DataFrame:
    """dim, ``kind``, low and high (distances to each pivot), norm (largest squared length) and, of queries, least."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    low, high = ([F.coalesce(f(F.get("d", F.lit(i))), F.lit(0.0)).cast("double") for i in range(pivots)] for f in (F.min, F.max))
    least = [F.min("least").alias("least")] if query else []
    return rows.groupBy("dim", kind).agg(F.array(*low).alias("low"), F.array(*high).alias("high"), F.max(norm).alias("norm"), *least)


def may_meet(queries: pa.Table, cands: pa.Table) -> pa.Table:
    """The pairs (b, c) of blocks of which some query may reach its least score with some candidate."""
    out = []
    if queries.num_rows and cands.num_rows:
        low, high = matrix(cands["low"], cands.num_rows), matrix(cands["high"], cands.num_rows)
        norm, number = cands["norm"].to_numpy(), cands["c"].to_numpy()
        for q in queries.to_pylist():
            at, to = np.array(q["low"]), np.array(q["high"])
            off = ROUNDING * np.maximum(high, to)
            gap = np.maximum(0, np.maximum(at - high, low - to) - off).max(1)
            total = q["norm"] + norm
            out += [(q["dim"], q["b"], c) for c in number[(total * (1 + 2 * SLACK) - gap**2) / 2 + SLACK >= q["least"]].tolist()]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("dim", "b", "c"), list(zip(*out)) or [()] * 3, (pa.int32(), pa.int64(), pa.int64()))})


def block_pairs(queries: DataFrame, cands: DataFrame, pivots: int) -> DataFrame:
    """dim, b, c: the pairs of blocks left. Bounds meet in squares of 1024 blocks."""
    square = lambda c: F.floor(F.col(c) / 1024)
    q, c = block_bounds(queries, "b", pivots, True), block_bounds(cands, "c", pivots, False)
    upto = lambda rows, number: rows.groupBy("dim").agg(F.max(square(number)).alias("last"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    q2 = q.join(upto(c, "c"), "dim").withColumn("y", every).withColumn("x", square("b")).drop("last")
    c2 = c.join(upto(q, "b"), "dim").withColumn("x", every).withColumn("y", square("c")).drop("last")
    keys = ["dim", "x", "y"]
    q2, c2 = q2.toDF(*q2.columns), c2.toDF(*c2.columns)  # columns of their own, as both come from one table
    return q2.groupBy(*keys).cogroup(c2.groupBy(*keys)).applyInArrow(may_meet, "dim int, b long, c long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vector with ``is_query``, the k best of all others.

    ``vectors``: vec_id and v (whole numbers); other columns are ignored. Ties go to the smaller vec_id. Rows
    with null vec_id or v take no part; of rows with the same vec_id the smallest vector counts. Vectors of
    different lengths are not compared. An empty table, or a single vector, gives an empty result.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    first_ids, first = drawn_rows(rows, FIRST)
    table = materialise(with_pivots(rows, far_apart(first[:POOL], pivots), first_ids, first, k), "pivot_table")
    discard(rows)
    cands = blocked(table.drop("q", "least"), BLOCK, "c")
    queries = blocked(table.where("q").drop("q"), QUERY_BLOCK, "b")
    wide = F.max(F.size("d"))
    links = materialise(block_pairs(queries, cands, table.agg(wide).first()[0] or 1), "block_pairs")
    links = F.broadcast(links) if links.count() < BROADCAST_PAIRS else links
    asked, sent = queries.join(links, ["dim", "b"]), cands.join(links, ["dim", "c"])
    keys, asked = ["dim", "b", "c"], asked.toDF(*asked.columns)
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(group_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.select("vec_id", quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
