"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the 3- to 5-grams of its distinct words, with word ends marked (none crosses a word's end),
hashed to BITS bits;
a feature's value is in how many of the distinct words it stands. Feature g is scaled by
r_g = log((1 + p_g) / sum(1 + p)) - log((1 + q_g) / sum(1 + q)), p and q its counts in toxic and other texts, and a
logistic model is fitted on the scaled features. What a word adds to a score depends on the word alone, so a text's
score is a sum over its distinct words.

The model is fitted on at most ``most`` labelled texts (MAX_TRAIN by default); the driver gets their distinct words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, parts, text_bytes
from tidemark.llm.labelled import sample
from tidemark.llm.license_scan import words_of

MAX_TRAIN = 6_000
BITS = 18
SIZES = (3, 4, 5)
STEPS, RATE, L2 = 150, 0.05, 1.0
#: Bytes of text scored at a time, and words remembered.
PART, MEMO = 1 << 18, 1 << 16
#: A text is called toxic from this score on.
THRESHOLD = 0.3


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, number of the word) of all n-grams of the words, repeats included."""
    marked = [b"<" + w + b">" for w in words]
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, marked), np.int64, len(marked)))
    found, places = [], []
    for n in SIZES:
        m = max(0, len(text) - n + 1)
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ text[j : j + m]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = of[:m] == of[len(of) - m :]
        found.append((h[inside] & np.uint32((1 << BITS) - 1)).astype(np.int32))
        places.append(of[:m][inside])
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # 2**BITS values, 1 MB

    def scorer(self):
        """Scores texts, remembering what words add. Texts are taken in parts of about PART bytes, whose distinct
        words are held at a time."""
        added: dict[bytes, float] = {}

        def part(texts: list[bytes]) -> np.ndarray:
            sets = [set(words_of(t)) for t in texts]
            if len(added) >= MEMO:
                added.clear()
            new = list(set().union(*sets).difference(added))
            if new:
                g, of = grams(new)
                added.update(zip(new, np.bincount(of, self.weights[g], len(new)).tolist()))
            z = self.bias + np.array([math.fsum(map(added.__getitem__, s)) for s in sets], np.float64)
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        def run(texts: list[bytes]) -> np.ndarray:
            ends = np.cumsum([len(t) + 1 for t in texts]) // PART
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            return np.concatenate([np.empty(0), *(part(texts[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i)])

        return run


def fit(texts: list[bytes], y: np.ndarray) -> Model:
    """The model for texts given as their distinct words with blanks between; with one kind of label, or none, a
    constant."""
    prior = (y.sum() + 1) / (len(y) + 20)
    model = Model(float(np.log(prior / (1 - prior))), np.zeros(1 << BITS, np.float32))
    if not 0 < y.sum() < len(y):
        return model
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [np.fromiter(map(number.__getitem__, t.split()), np.int32) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(w) for w in words])
    word = np.concatenate(words)
    distinct = len(number)
    gram, of = grams(list(number))
    del number, words
    size = 1 << BITS

    def counts(weight: np.ndarray) -> np.ndarray:
        return np.bincount(gram, np.bincount(word, weight[doc], distinct)[of], size)

    p, q = 1 + counts(y), 1 + counts(1 - y)
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[counts(np.ones(len(y))) == 0] = 0
    u, b = np.zeros(size), model.bias
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        added = np.bincount(of, (r * u)[gram], distinct)
        z = b + np.bincount(doc, added[word], len(y))
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g, gb = r * counts(slope) + L2 / len(y) * u, slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * min(1, 2 - 2 * t / STEPS) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        u -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    return Model(float(b), (r * u).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_TRAIN) -> Model:
    """A model of labels.toxic from at most ``most`` labelled rows of ``docs`` for which ``learn`` holds."""

    def run(batches):
        for b in batches:
            words = [b" ".join(sorted(set(words_of(t)))) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["label", "words"])

    rows = sample(docs, labels, "toxic", learn, most).select("label", "text").mapInArrow(run, "label int, words binary").toArrow()
    rows = sorted(zip(rows["words"].to_pylist(), rows["label"].to_pylist()))
    return fit([w for w, _ in rows], np.array([y for _, y in rows], float))


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` and its score (0 to 1, higher: likelier toxic) as ``name``.

    A null or empty text has the score of one without words. Very long texts are scored whole. Repeated rows and
    null ids are rows like others. ``name`` must be none of ``keep``; other columns are ignored. An empty table gives
    an empty result; a model from no labels gives 0.05.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    kept = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else None
    rows = docs.select(row, F.col("text").cast("string").alias("text")) if kept is None else docs.select(row)  # a text is sent once
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = sent.value.scorer()
        for b in batches:
            for part in parts(b):
                text = part.column(1) if kept is None else part.column(0).field(kept)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(text_bytes(text)))], schema.names)

    return rows.mapInArrow(run, schema).select("row.*", F.col("score").alias(name))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold("doc_id", 4, 2))
    return score(docs, model, "doc_id").select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
