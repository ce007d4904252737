"""Whitening of embeddings by shifted CholeskyQR.

The centred rows C (n x d) are never gathered. Each pass over them sums the Gram matrix of what the factors so far
leave of a row: tasks subtract the mean, solve the triangular systems of the factors found so far, and add up their
rows' products; the d(d+1)/2 sums of each task are added by Spark. The driver takes the Cholesky factor of that one
d x d matrix. The first has a shift, so that it exists however ill conditioned C is; the next ones, of rows that are
nearly orthogonal by then, make Q orthogonal to rounding. The product of the factors is R with C = QR, and its
singular values and right vectors are those of C: eigenvalues and components of the covariance, with the relative
precision of C itself, where the covariance matrix would square its condition.

Nothing that the driver or a task holds grows with the rows: d x d numbers, and a batch of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.topk import matrix, quantised

COMPONENTS = 32
#: Passes at least (the usual three of the method) and at most (more only where C has nearly dependent columns).
PASSES, MOST_PASSES = 3, 8
#: How far a Gram matrix of orthogonal rows may be from the identity.
ORTHOGONAL = 1e-13
#: Eigenvalues below this share of the largest are rounding: such directions have no component.
RANK = 1e-24


class Centre:
    """n, and the sums S of each dimension, as whole part and rest of S / n; both exact."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.rest = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def less(self, v: np.ndarray) -> np.ndarray:
        """v - whole, whole numbers; v - S / n is that less rest / n, and n v - S is n times it less rest."""
        return v - self.whole

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self.less(v).astype(np.float64) - self.rest / self.n


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor, by forward substitution over the columns."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def batch_of(b: pa.RecordBatch) -> np.ndarray:
    return matrix(b.column(b.schema.get_field_index("v")), b.num_rows)


def totals(rows: DataFrame, dim: int) -> Centre | None:
    """n and exact sums over all rows; each task sends d of them."""

    def run(batches):
        n, sums = 0, np.zeros(dim, np.int64)
        for b in batches:
            if b.num_rows:
                n, sums = n + b.num_rows, sums + batch_of(b).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(sums), pa.array([n] * dim)], ["j", "s", "n"])

    exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    found = sorted(rows.select("v").mapInArrow(run, "j int, s long, n long").groupBy("j").agg(exact, F.sum("n").alias("n")).collect())
    return Centre(found[0].n, [int(r.s) for r in found]) if found else None


def gram(rows: DataFrame, make) -> np.ndarray:
    """The sum of X'X over the batches' matrices X = make(v), with a last column of ones: the sums stand there."""

    def run(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                x = make(batch_of(b))
                x = np.column_stack([x, np.ones(len(x))])
                total = total + x.T @ x
        if not isinstance(total, int):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    cells = rows.select("v").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    i, j, g = (c.to_numpy() for c in cells.columns)
    out = np.zeros((i.max() + 1,) * 2)
    out[i, j] = out[j, i] = g
    return out


def upper(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper triangular R with R'R = g, or g + shift where asked for or where g is not positive definite."""
    d = len(g)
    s = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.eigvalsh(g)[-1]
    s = min(s, 1e-4 * np.linalg.eigvalsh(g)[-1])  # the bound of the method, which n rows of real data do not need
    while True:
        try:
            return np.linalg.cholesky(g + (s if shift else 0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            s, shift = (10 * s if shift else s), True


def orthogonalised(rows: DataFrame, centre: Centre) -> np.ndarray | None:
    """R of the centred rows; None where they are all alike."""
    factors: list[np.ndarray] = []
    for k in range(MOST_PASSES):
        g = gram(rows, lambda v, done=tuple(factors): solved(centre(v), list(done)))[:-1, :-1]
        if not g.any():
            return None
        off = np.abs(g - np.eye(len(g))).max()
        factors.append(upper(g, centre.n, shift=not k))
        if k + 1 >= PASSES and off < ORTHOGONAL * len(g):
            break
    r = np.eye(len(factors[0]))
    for f in factors:
        r = f @ r
    return r


def fitted(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues, shares explained) from R; each component's largest entry is positive."""
    _, sigma, w = np.linalg.svd(r)
    e = sigma**2 / n
    keep = min(most, int((e > RANK * e[0]).sum()))
    w = w[:keep].T
    w = w * np.sign(w[np.abs(w).argmax(0), np.arange(keep)])
    return w, e[:keep], e[:keep] / e.sum()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal), whitened, explained, identity_error.

    ``vectors``: vec_id and v (whole numbers); other columns are ignored. Every row with a vector is a row of the fit
    and of the result: repeated ones count each, and a null vec_id stays null. Null and empty vectors take no part,
    nor do vectors that are not of the most frequent length (ties: the longer). Components along which the rows do not
    vary are left out; so a single row, equal rows, and an empty table give an empty result. Equal eigenvalues have
    components of the space that they share. Vectors of d entries need a few d x d matrices in each task.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    none = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = materialise(vectors.select("vec_id", "v").where("v IS NOT NULL AND size(v) > 0"), "whitening")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return none
    rows = rows.where(F.size("v") == usual.d)
    centre = totals(rows, usual.d)
    r = orthogonalised(rows, centre)
    if r is None:
        return none
    w, e, explained = fitted(r, centre.n, components)
    by = w / np.sqrt(e)
    g = gram(rows, lambda v: centre(v) @ by) / centre.n
    error = float(np.abs(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) - np.eye(len(e))).max())

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = batch_of(b)
                x = centre.less(v)
                out = (centre(v) @ by).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(e)), pa.array(out))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x * x).sum(1)), pa.array(x @ centre.rest), lists], ["vec_id", "xx", "xr", "w"])

    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    n, rest = centre.n, sum(int(x) ** 2 for x in centre.rest)
    deviation = F.col("xx") * whole(n * n) - F.col("xr") * whole(2 * n) + whole(rest)  # the sum of (n x - S)^2, multiplied out
    found = rows.mapInArrow(run, f"vec_id {kind}, xx long, xr long, w array<double>")
    found = found.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    shares = F.array(*map(F.lit, map(float, explained)))
    return found.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long cannot hold (beyond some 10 million rows of such vectors) is null here."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform(quantised(F.col("embedding")), lambda x: x + 1_000_000)
    return whiten(rows.select("vec_id", v.alias("v"))).withColumn("deviation", F.col("deviation").try_cast("long"))
