"""Text quality by a generalised additive model with pairwise interactions.

A text is described by FEATURES, each cut into at most BINS bins at the quantiles of the training sample. Boosting
goes through the features in turn, again and again; each step fits a tree of at most four leaves to one feature's
gradient histogram and adds it to that feature's table. Then the pairs that promise most get two-way tables in the
same way. Rounds end where an inner part of the sample, one row in five, stops getting better. A text's score is
the logistic value of a sum of table entries.

The model is fitted on at most ``most`` labelled rows (MAX_TRAIN by default), of which only the features reach the
driver: 19 numbers a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, text_bytes
from tidemark.llm.labelled import sample

MAX_TRAIN = 20_000
BINS, PAIRS, PAIR_BINS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, L2 = 200, 60, 0.1, 1.0

LETTERS, UPPER, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Shares of a text's bytes: one feature for each group.
GROUPS = {
    "digits": DIGITS, "symbols": b"#$%&*<>{}[]=~^\\@_/+`", "bars": b"|", "shouts": b"!?", "stops": b".", "commas": b",;:", "blanks": b" \t", "lines": b"\n", "brackets": b"()\"'",
    "not_ascii": bytes(range(128, 256)), "controls": bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
}
FEATURES = (*GROUPS, "bytes", "words", "word_bytes", "longest_word", "upper", "distinct_words", "repeated_lines", "line_bytes")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.float64).reshape(-1, 256)
    n = np.maximum(1, counts.sum(1))
    share = np.stack([counts[:, list(g)].sum(1) / n for g in GROUPS.values()], 1)
    upper, lower = counts[:, list(UPPER)].sum(1), counts[:, list(LETTERS)].sum(1)
    rest = np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        if words:
            distinct = set(words)
            rest[i] = len(t), len(words), len(t) / len(words), max(map(len, distinct)), 0, len(distinct) / len(words) ** 0.8, 1 - len(set(lines)) / len(lines), len(t) / len(lines)
    rest[:, [0, 1, 3, 7]] = np.log1p(rest[:, [0, 1, 3, 7]])
    rest[:, 4] = upper / np.maximum(1, upper + lower)
    return np.concatenate([share, rest], 1)


def feature_rows(rows: DataFrame, key: str, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = features(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], [key, "x"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, x array<double>")


@dataclass
class Model:
    bias: float
    edges: list = field(default_factory=list)  # of each feature
    tables: list = field(default_factory=list)  # of each feature: a value for each bin
    coarse: list = field(default_factory=list)  # of each feature: its bins' numbers in pair tables
    pairs: dict = field(default_factory=dict)  # (feature, feature): values by coarse bins

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.bias)
        for b, t in zip(bins, self.tables):
            out += t[b]
        for (i, j), t in self.pairs.items():
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def gain(g, h):
    return g * g / (h + L2)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a histogram in two (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    G, H = g.sum(), h.sum()
    v = gain(gl, hl) + gain(G - gl, H - hl) - gain(G, H)
    v[(hl < 1) | (H - hl < 1)] = 0
    k = int(v.argmax())
    return float(v[k]), k + 1 if v[k] > 0 else 0


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value for each bin: splits once, and each half once more."""
    out = np.zeros(len(g))

    def leaf(i: int, j: int, depth: int) -> None:
        _, k = best_cut(g[i:j], h[i:j]) if depth else (0, 0)
        if k:
            leaf(i, i + k, depth - 1)
            leaf(i + k, j, depth - 1)
        else:
            out[i:j] = -g[i:j].sum() / (h[i:j].sum() + L2)

    leaf(0, len(g), 2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the better of: split one axis, then each side on the other axis."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, k = best_cut(a.sum(1), b.sum(1))
        out, total = np.zeros(a.shape), -gain(a.sum(), b.sum())
        for i, j in ((0, k), (k, len(a))) if k else ((0, len(a)),):
            ga, ha = a[i:j].sum(0), b[i:j].sum(0)
            _, c = best_cut(ga, ha)
            for p, q in ((0, c), (c, len(ga))) if c else ((0, len(ga)),):
                total += gain(ga[p:q].sum(), ha[p:q].sum())
                out[i:j, p:q] = -ga[p:q].sum() / (ha[p:q].sum() + L2)
        if total > best[0]:
            best = (total, out.T if flip else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for features ``x`` and labels ``y``; with one kind of label, or none, a constant."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * min(s, PAIR_BINS) // s for s in sizes]
    inner = np.arange(len(y)) % 5 == 4
    weight = (~inner).astype(float)

    def loss(f):
        return float(np.logaddexp(0, np.where(y == 1, -f, f))[inner].mean()) if inner.any() else 0.0

    def slopes(f):
        p = 1 / (1 + np.exp(-f))
        return (p - y) * weight, p * (1 - p) * weight

    f = np.full(len(y), model.bias)
    best, kept, since = loss(f), [t.copy() for t in model.tables], 0
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes(f)
            step = RATE * tree(np.bincount(b, g, sizes[k]), np.bincount(b, h, sizes[k]))
            model.tables[k] += step
            f += step[b]
        now = loss(f)
        if now < best - 1e-6:
            best, kept, since = now, [t.copy() for t in model.tables], 0
        elif (since := since + 1) >= 15:
            break
    model.tables = kept
    f = model.margin(x)

    cells = {}
    g, h = slopes(f)
    for i, j in combinations(range(len(bins)), 2):
        shape = (model.coarse[i][-1] + 1, model.coarse[j][-1] + 1)
        at = model.coarse[i][bins[i]] * shape[1] + model.coarse[j][bins[j]]
        sums = [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
        cells[i, j] = (pair_tree(*sums)[0], at, shape)
    chosen = sorted(cells, key=lambda p: -cells[p][0])[:PAIRS]
    model.pairs = {p: np.zeros(cells[p][2]) for p in chosen}
    best, kept, since = loss(f), {p: t.copy() for p, t in model.pairs.items()}, 0
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            _, at, shape = cells[p]
            g, h = slopes(f)
            _, step = pair_tree(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))
            model.pairs[p] += RATE * step
            f += RATE * step.reshape(-1)[at]
        now = loss(f)
        if now < best - 1e-6:
            best, kept, since = now, {p: t.copy() for p, t in model.pairs.items()}, 0
        elif (since := since + 1) >= 10:
            break
    model.pairs = kept
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_TRAIN) -> Model:
    """A model of labels.quality from at most ``most`` labelled rows of ``docs`` for which ``learn`` holds."""
    rows = feature_rows(sample(docs, labels, "quality", learn, most), "label", "int").collect()
    rows = sorted((tuple(r.x), r.label) for r in rows)
    order = np.random.default_rng(0).permutation(len(rows))
    x, y = np.array([r[0] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float)
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: better text) of each row of ``docs`` (doc_id, text; others are ignored).

    A null or empty text is scored as one without words; features are taken of whole texts of any length. Repeated
    rows and null ids are rows like others. An empty table gives an empty result; a model from no labels gives 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = sent.value.score(features(text_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold("doc_id", 3, 1))
    return score(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
