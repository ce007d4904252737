"""The classifiers' parts against plain versions, and what they find of held-out labels."""

import math
from bisect import bisect_right

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity

TEXTS = [b"", b" \n\t ", b"One two two.\nOne two two.\nTHREE!? {x} 12,3", "Ünï cödé | – 9".encode(), b"word " * 500 + b"\x01\x7f", b"a" * 3000]


def plain_features(t: bytes) -> list[float]:
    n = max(1, len(t))
    share = [sum(c in group for c in t) / n for group in quality.GROUPS.values()]
    words, lines = t.split(), t.split(b"\n")
    upper, letters = sum(65 <= c <= 90 for c in t), sum(65 <= c <= 90 or 97 <= c <= 122 for c in t)
    if not words:
        return [*share, 0, 0, 0, 0, upper / max(1, letters), 0, 0, 0]
    return [
        *share, math.log1p(len(t)), math.log1p(len(words)), len(t) / len(words), math.log1p(max(map(len, words))), upper / max(1, letters), len(set(words)) / len(words) ** 0.8,
        1 - len(set(lines)) / len(lines), math.log1p(len(t) / len(lines)),
    ]


def test_features_of_a_text():
    assert quality.features(TEXTS).tolist() == [pytest.approx(plain_features(t)) for t in TEXTS]
    assert quality.features([]).shape == (0, len(quality.FEATURES))


def leaf_gain(g, h):
    return g.sum() ** 2 / (h.sum() + quality.L2)


def test_cuts_are_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) * 3
        all_cuts = [leaf_gain(g[:k], h[:k]) + leaf_gain(g[k:], h[k:]) - leaf_gain(g, h) for k in range(1, 9) if h[:k].sum() >= 1 and h[k:].sum() >= 1]
        value, at = quality.best_cut(g, h)
        assert value == pytest.approx(max([0, *all_cuts]), abs=1e-12)
        if at:
            assert value == pytest.approx(leaf_gain(g[:at], h[:at]) + leaf_gain(g[at:], h[at:]) - leaf_gain(g, h))
        steps = quality.tree(g, h)
        assert len(set(steps.tolist())) <= 4
        for level in set(steps.tolist()):  # each leaf has the value that is best for its bins
            on = steps == level
            assert level == pytest.approx(-g[on].sum() / (h[on].sum() + quality.L2))


def test_a_pair_table_gains_what_its_leaves_gain():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4)) * 3
        value, steps = quality.pair_tree(g, h)
        leaves = [steps == x for x in set(steps.reshape(-1).tolist())]
        assert len(leaves) <= 4 and value >= 0
        if value:
            assert value == pytest.approx(sum(leaf_gain(g[on], h[on]) for on in leaves) - leaf_gain(g, h))


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    model = quality.fit(x, y)
    for row, s in zip(x[:50], model.score(x[:50])):
        bins = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, row)]
        z = model.bias + sum(t[b] for t, b in zip(model.tables, bins))
        z += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_pairs_learn_what_single_features_cannot():
    """A label that is the exclusive or of two features: the pair's table carries it."""
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) != (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (2, 5) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    model.pairs = {}
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.65


def held_out(spark, sf, rows, column, threshold):
    """(precision, recall, number of positives) over held-out labelled documents."""
    labels = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet' WHERE {column} IS NOT NULL").fetchall())
    found = [(labels[r.doc_id], r.score >= threshold) for r in rows.where("held_out").collect() if r.doc_id in labels]
    hits = sum(y == 1 and p for y, p in found)
    return hits / max(1, sum(p for _, p in found)), hits / max(1, sum(y for y, _ in found)), sum(y for y, _ in found)


def test_toxic_documents_are_found(spark):
    """By recall and precision, which calling nothing toxic does not meet; few labels (sf0.01) allow less."""
    precision, recall, n = held_out(spark, "/root/testdata/sf0.01", toxicity.op10(spark, "/root/testdata/sf0.01"), "toxic", 0.3)
    assert n >= 10 and precision >= 0.75 and recall >= 0.5
    precision, recall, n = held_out(spark, "/root/testdata/sf0.1", toxicity.op10(spark, "/root/testdata/sf0.1"), "toxic", 0.3)
    assert n >= 100 and precision >= 0.95 and recall >= 0.9


def test_quality_is_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op7(spark, sf).withColumn("score", 1 - F.col("score"))  # the rarer kind, poor texts, as positives
    labels = dict(duckdb.sql(f"SELECT doc_id, 1 - quality FROM '{sf}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    found = [(labels[r.doc_id], r.score > 0.5) for r in rows.where("held_out").collect() if r.doc_id in labels]
    hits = sum(y == 1 and p for y, p in found)
    assert hits / sum(y for y, _ in found) > 0.9 and hits / sum(p for _, p in found) > 0.9
