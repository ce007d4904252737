"""Hard negatives by an STR-packed R-tree.

Rows are dealt to regions by sort-tile-recursive splits: slabs of equal numbers along one coordinate, each cut along the
next. The splits are fitted on a bounded sample drawn by hash, all rows are dealt by them; equal vectors are told
apart by a hash of their ids, so that copies of one vector fill several regions. A region is packed into one tree: rows
of one label are tiled again, LEAF rows a leaf, FAN leaves a node, each with its minimum bounding box. The tree is one
row of a written table, its box another small one.

A box gives an interval for each coordinate, and with a query's sign the least and largest inner product in the box.
Anchors first search their own region, which tells each a score that its last wanted row reaches at least. Then pairs
of regions are dropped whole whose boxes cannot reach any anchor's window, before anything is sent. In each pair
left, nodes wait in a queue, best bound first, shared by QUERIES anchors; a box is passed over by an anchor whose window
its interval misses or whose k-th best so far lies strictly above it. Equal bounds are still searched, so ties are
exact. Positives are searched in trees of the anchor's label, negatives in all others, each positive with a window.

Anchors are a share of the rows, so the pairs are that share of rows x rows at most. Boxes in many dimensions tell
random directions apart little: on such vectors most of a region is evaluated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, pack, unpack
from tidemark.llm.topk import best_of, exact, matrix, products, quantised

#: Rows of a region (about), leaves and nodes, anchors that share a queue, regions whose anchors are sent together.
REGION, LEAF, FAN, QUERIES, TOGETHER = 8192, 64, 16, 256, 16
#: Rows that the splits are fitted on (about), and rows of it that a region needs.
SAMPLE, DRAWN = 32_768, 16
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rounding of a bound, as a share of the sum of its terms, where these are too large to be whole as doubles.
ROUNDING = 1e-12


def cuts(count: int, parts: int) -> np.ndarray:
    return count * np.arange(1, parts) // parts


def splits(v: np.ndarray, u: np.ndarray, regions: int, levels: int):
    """Nested (axis, bounds, children) that tile the rows into about so many regions; None is a region."""
    if regions <= 1 or len(v) < 2:
        return None
    slabs = regions if levels == 1 else int(np.ceil(regions ** (1 / levels)))
    axis = int(np.argmax(v.astype(np.float64).var(0)))
    key = np.sort(v[:, axis] + u)
    bounds = key[cuts(len(key), slabs)]
    slab = np.searchsorted(bounds, v[:, axis] + u, "right")
    return axis, bounds, [splits(v[slab == s], u[slab == s], -(-regions // slabs), levels - 1) for s in range(slabs)]


def size_of(tree) -> int:
    return 1 if tree is None else sum(map(size_of, tree[2]))


def dealt(tree, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The region of each row; regions are numbered as they are tiled, so near numbers are near."""
    out = np.zeros(len(v), np.int64)
    if tree is None:
        return out
    axis, bounds, children = tree
    slab, before = np.searchsorted(bounds, v[:, axis] + u, "right"), 0
    for s, child in enumerate(children):
        on = np.flatnonzero(slab == s)
        if len(on):
            out[on] = before + dealt(child, v[on], u[on])
        before += size_of(child)
    return out


def tiled(v: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` in leaves of LEAF, tiled along the coordinates in which they are widest."""
    if len(rows) <= LEAF:
        return [rows]
    leaves = -(-len(rows) // LEAF)
    slabs = max(2, int(np.ceil(np.sqrt(leaves)))) if leaves > 3 else leaves
    x = v[rows]
    rows = rows[np.argsort(x[:, int(np.argmax(x.max(0) - x.min(0)))], kind="stable")]
    return [leaf for part in np.split(rows, cuts(leaves, slabs) * len(rows) // leaves) for leaf in tiled(v, part)]


def packed_tree(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    """A region as one row: its rows in the order of the leaves, and where leaves and nodes begin."""
    order, starts, nodes = [], [0], [0]
    for label in np.unique(labels):
        leaves = tiled(v, np.flatnonzero(labels == label))
        order += leaves
        starts += (starts[-1] + np.cumsum([len(x) for x in leaves])).tolist()
        nodes += [nodes[-1] + min(k + FAN, len(leaves)) for k in range(0, len(leaves), FAN)]
    at = np.concatenate(order)
    return {"ids": pack(ids[at]), "labels": pack(labels[at]), "v": pack(v[at].reshape(-1)), "starts": pack(np.array(starts)), "nodes": pack(np.array(nodes))}


class Tree:
    """A region unpacked: boxes of leaves and nodes, and the label of each."""

    def __init__(self, row: dict, dim: int):
        self.ids, labels, starts, self.nodes = (unpack(row[c], np.int64) for c in ("ids", "labels", "starts", "nodes"))
        self.starts = starts
        v = unpack(row["v"], np.int64).reshape(-1, dim)
        self.v = exact(v)
        self.slack = 0 if self.v.dtype == np.float64 else ROUNDING
        edges = lambda f, x, at: f.reduceat(x, at[:-1], axis=0).astype(np.float64)
        self.low, self.high = edges(np.minimum, v, starts), edges(np.maximum, v, starts)
        self.node_low, self.node_high = edges(np.minimum, self.low, self.nodes), edges(np.maximum, self.high, self.nodes)
        self.label = labels[starts[:-1]]
        self.node_label = self.label[self.nodes[:-1]]


class Search:
    """Up to QUERIES anchors and their windows [low, high] of scores: the k best rows of each window."""

    def __init__(self, ids, labels, q, low, high, k: int, same: bool):
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, exact(q), k, same
        self.up, self.down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        self.kth, self.high = low.copy(), high
        self.hits = [np.empty(0, np.int64)] * 3
        self.evaluated = 0

    def open(self, low: np.ndarray, high: np.ndarray, label: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """For boxes: which anchors have a window that the box may reach (anchors x boxes), and the most it may score."""
        most = self.up @ high.T + self.down @ low.T
        least = self.up @ low.T + self.down @ high.T
        if slack:
            off = slack * (self.up - self.down) @ np.maximum(np.abs(low), np.abs(high)).T + 1
            most, least = most + off, least - off
        right = (self.labels[:, None] == label) == self.same
        reach = (most[:, None, :] >= self.kth[:, :, None]) & (least[:, None, :] <= self.high[:, :, None])
        return right & reach.any(1), most

    def run(self, tree: Tree) -> None:
        queue: list[tuple[float, int, int]] = []

        def push(first: int, open_: np.ndarray, most: np.ndarray, leaf: int) -> None:
            best = np.where(open_, most, -np.inf).max(0)
            for x in np.flatnonzero(open_.any(0)).tolist():
                heapq.heappush(queue, (-best[x], leaf, first + x))

        slack = max(tree.slack, 0 if self.q.dtype == np.float64 else ROUNDING)
        push(0, *self.open(tree.node_low, tree.node_high, tree.node_label, slack), 0)
        while queue:
            _, leaf, x = heapq.heappop(queue)
            some = slice(x, x + 1) if leaf else slice(tree.nodes[x], tree.nodes[x + 1])
            open_, most = self.open(tree.low[some], tree.high[some], tree.label[some], slack)  # k-th scores may have risen
            if leaf:
                self.leaf(tree, slice(tree.starts[x], tree.starts[x + 1]), np.flatnonzero(open_[:, 0]))
            else:
                push(some.start, open_, most, 1)

    def leaf(self, tree: Tree, rows: slice, asks: np.ndarray) -> None:
        if not len(asks):
            return
        s = products(self.q[asks], tree.v[rows]).astype(np.int64)
        self.evaluated += s.size
        good = (s[:, None, :] >= self.kth[asks][:, :, None]) & (s[:, None, :] <= self.high[asks][:, :, None])
        good &= (self.ids[asks][:, None] != tree.ids[rows])[:, None, :]
        a, w, r = np.nonzero(good)
        if len(a):
            windows = self.kth.shape[1]
            new = asks[a] * windows + w, tree.ids[rows][r], s[a, r]
            self.hits = best_of(*(np.concatenate(x) for x in zip(self.hits, new)), self.k)
            number, _, score = self.hits
            full = np.bincount(number, minlength=self.kth.size) == self.k
            last = np.flatnonzero(np.diff(number, append=-1))
            kth = self.kth.reshape(-1)
            kth[full] = np.maximum(kth[full], score[last][full[number[last]]])


def searched(tree: Tree, anchors: dict, dim: int, k: int, same: bool):
    """(anchor number, window number, id, score) of a pack of anchors in a tree, and the final k-th scores."""
    ids, labels, low, high = (unpack(anchors[c], np.int64) for c in ("ids", "labels", "low", "high"))
    q = unpack(anchors["v"], np.int64).reshape(-1, dim)
    low, high = low.reshape(len(ids), -1), high.reshape(len(ids), -1)
    out, kth = [], []
    for at in range(0, len(ids), QUERIES):
        part = slice(at, at + QUERIES)
        search = Search(ids[part], labels[part], q[part], low[part], high[part], k, same)
        search.run(tree)
        number, found, score = search.hits
        out.append((at + number // low.shape[1], number % low.shape[1], found, score))
        kth.append(search.kth)
    return [np.concatenate(x) for x in zip(*out)], np.concatenate(kth)


def packed_anchors(ids, labels, v, low, high) -> dict:
    """Anchors as one row, with the box of their vectors and the widest window of any of them."""
    return {
        "ids": pack(ids), "labels": pack(labels), "v": pack(v.reshape(-1)), "low": pack(low.reshape(-1)), "high": pack(high.reshape(-1)),
        "box_low": v.min(0).astype(float).tolist(), "box_high": v.max(0).astype(float).tolist(), "least": int(low.min()), "most": int(high.max()),
    }


ANCHORS = "ids binary, labels binary, v binary, low binary, high binary, box_low array<double>, box_high array<double>, least long, most long"
TREE = "ids binary, labels binary, v binary, starts binary, nodes binary"
KEYS = ["dim", "region"]


def arrow(rows: list[dict], sql: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.Table.from_pylist(rows, pa.schema([(c, kinds[t]) for c, t in (x.split(" ") for x in sql.split(", "))]))


INDEX = f"dim int, region long, low array<double>, high array<double>, {TREE}, {', '.join('a_' + x for x in ANCHORS.split(', '))}"


def indexed(k: int):
    """A region's rows as a tree, its box, and its anchors with the k-th score of their label in this region."""

    def run(rows: pa.Table) -> pa.Table:
        ids, labels, anchor = (rows[c].to_numpy() for c in ("vec_id", "label", "anchor"))
        dim, region = rows["dim"][0].as_py(), rows["region"][0].as_py()
        v = matrix(rows["v"], len(ids))
        order = np.argsort(ids)
        ids, labels, anchor, v = ids[order], labels[order], anchor[order], v[order]
        out = {"dim": dim, "region": region, "low": v.min(0).astype(float).tolist(), "high": v.max(0).astype(float).tolist()} | packed_tree(ids, labels, v)
        on = np.flatnonzero(anchor)
        if len(on):
            low, high = np.full((len(on), 1), LOWEST), np.full((len(on), 1), HIGHEST)
            _, low = searched(Tree(out, dim), packed_anchors(ids[on], labels[on], v[on], low, high), dim, k, True)
            out |= {f"a_{c}": x for c, x in packed_anchors(ids[on], labels[on], v[on], low, high).items()}
        return arrow([out], INDEX)

    return run


def reachable(asks: pa.Table, regions: pa.Table) -> pa.Table:
    """Pairs (asks' region, region) whose boxes leave a score that some anchor's window may hold."""
    out = []
    if asks.num_rows and regions.num_rows:
        box = lambda t, c: matrix(t[c], t.num_rows)
        low, high, number = box(regions, "low"), box(regions, "high"), regions["region"].to_numpy()
        for a in asks.to_pylist():
            corners = [np.array(x) * y for x in (a["box_low"], a["box_high"]) for y in (low, high)]
            most, least = np.maximum.reduce(corners).sum(1), np.minimum.reduce(corners).sum(1)
            off = ROUNDING * np.maximum.reduce(np.abs(corners)).sum(1)
            near = number[(most + off >= a["least"]) & (least - off <= a["most"])]
            out += [{"dim": a["dim"], "region": int(r), "from": a["region"]} for r in near]
    return arrow(out, "dim int, region long, from long")


def pairs(asks: DataFrame, index: DataFrame) -> DataFrame:
    """dim, region, from: regions that the anchors of region ``from`` must search. Boxes meet in blocks of 1024."""
    block = lambda c: F.floor(F.col(c) / 1024)
    ends = index.groupBy("dim").agg(F.max(block("region")).alias("last"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    a = asks.select("dim", "region", "box_low", "box_high", "least", "most").join(ends, "dim").withColumn("y", every).withColumn("x", block("region")).drop("last")
    b = index.select("dim", "region", "low", "high").join(ends, "dim").withColumn("x", every).withColumn("y", block("region")).drop("last")
    keys, a = ["dim", "x", "y"], a.toDF(*a.columns)  # columns of its own, as both sides come from one table
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(reachable, "dim int, region long, from long")


def group_search(k: int, same: bool):
    def run(asks: pa.Table, trees: pa.Table) -> pa.Table:
        out = []
        for t in trees.to_pylist():
            tree = Tree(t, t["dim"])
            for a in asks.to_pylist():
                (anchor, window, found, score), _ = searched(tree, a, t["dim"], k, same)
                out.append((unpack(a["ids"], np.int64)[anchor], window, found, score))
        out = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table({c: pa.array(x) for c, x in zip(("anchor_id", "window", "found", "score"), out)})

    return run


def search(asks: DataFrame, index: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, window, found, score, place (from 1): the k best rows for each window over all regions."""
    links = materialise(pairs(asks, index), "pairs").withColumn("g", F.floor(F.col("from") / TOGETHER))
    sent = links.join(asks.withColumnRenamed("region", "from").select("dim", "from", "ids", "labels", "v", "low", "high"), ["dim", "from"])
    trees = links.select("dim", "region", "g").distinct().join(index.select("dim", "region", *(x.split(" ")[0] for x in TREE.split(", "))), KEYS)
    keys, sent = ["dim", "region", "g"], sent.toDF(*sent.columns)
    found = sent.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(group_search(k, same), "anchor_id long, window long, found long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "found"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the region of each; splits are fitted on about SAMPLE rows of the most frequent length, other
    lengths are dealt by hash."""
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    dim = max(counts, key=lambda d: (counts[d], d), default=0)
    every = max(1, counts.get(dim, 0) // SAMPLE)
    hashed = F.xxhash64("vec_id", F.lit(13))
    some = rows.where((F.col("dim") == dim) & (F.pmod(hashed, F.lit(every)) == 0)).select("v", hashed.alias("h")).toArrow()
    tree, spread = None, lambda h: (h.astype(np.uint64) >> np.uint64(11)) * 2.0**-53
    if some.num_rows and dim:
        regions = min(-(-counts[dim] // REGION), some.num_rows // DRAWN)
        tree = splits(matrix(some["v"], some.num_rows), spread(some["h"].to_numpy()), regions, 2 if regions <= 64 else 3)
    parts = {d: max(1, -(-n // (REGION * (size_of(tree) if d == dim else 1)))) for d, n in counts.items()}
    part = F.lit(1)
    for d, n in parts.items():
        if n > 1:
            part = F.when(F.col("dim") == d, n).otherwise(part)

    def run(batches):
        for b in batches:
            dims, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "h"))
            region = np.zeros(len(h), np.int64)
            on = np.flatnonzero(dims == dim)
            if len(on) and tree is not None:
                region[on] = dealt(tree, matrix(b.column("v").take(pa.array(on)), len(on)), spread(h[on]))
            yield b.append_column("region", pa.array(region))

    rows = rows.withColumn("h", hashed).mapInArrow(run, "vec_id long, label long, v array<long>, anchor boolean, dim int, h long, region long")
    return rows.withColumn("region", F.col("region") * part + F.pmod(F.xxhash64("vec_id", F.lit(14)), part)).drop("h")


def windowed(rows: pa.Table) -> pa.Table:
    """The anchors of a region with a window for each of their positives; missing ones are empty windows."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    lows, highs = rows["lows"].to_pylist(), rows["highs"].to_pylist()
    most = max(map(len, lows))
    low, high = np.full((len(ids), most), HIGHEST), np.full((len(ids), most), LOWEST)
    for i, (a, b) in enumerate(zip(lows, highs)):
        low[i, : len(a)], high[i, : len(b)] = a, b
    out = {"dim": rows["dim"][0].as_py(), "region": rows["region"][0].as_py()} | packed_anchors(ids, labels, matrix(rows["v"], len(ids)), low, high)
    return arrow([out], f"dim int, region long, {ANCHORS}")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its
    best other rows of its label, the best rows of other labels with a score of ``low`` to ``high`` per cent of the
    positive's.

    ``vectors``: vec_id, label and v (whole numbers); other columns are ignored. Rows with a null in one of the three or
    an empty vector take no part; of rows with the same vec_id the smallest vector, then label, counts. Ties go to the smaller vec_id.
    Vectors of different lengths are not compared. A positive score below zero has no window. An empty table, or
    anchors without others of their label, give an empty result. Positives of one anchor each have their own rows.
    """
    given = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct("v", F.col("label").cast("long").alias("label")).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    once = given.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("anchor").alias("anchor"))
    rows = materialise(once.select("vec_id", "x.label", "x.v", "anchor", F.size("x.v").alias("dim")), "labelled")
    regions = materialise(placed(rows), "regions")
    index = materialise(regions.groupBy(*KEYS).applyInArrow(indexed(positives), INDEX), "trees")
    asks = index.where("a_ids IS NOT NULL").select(*KEYS, *(F.col(f"a_{c}").alias(c) for c in (x.split(" ")[0] for x in ANCHORS.split(", "))))
    best = materialise(search(asks, index, positives, True).select("anchor_id", (F.col("place") - 1).cast("long").alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = F.struct("window", F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("long").alias("low"), F.floor(F.col("positive_score").cast("decimal(20,0)") * high / 100).cast("long").alias("high"))
    windows = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(bounds)).alias("w")).select(F.col("anchor_id").alias("vec_id"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    asked = regions.where("anchor").join(windows, "vec_id").groupBy(*KEYS).applyInArrow(windowed, f"dim int, region long, {ANCHORS}")
    found = search(materialise(asked, "windows"), index, negatives, False).join(best, ["anchor_id", "window"])
    discard(rows)
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), quantised(F.col("embedding"), 256).alias("v")), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""
