"""The pipeline's stages, one by one, against plain Python and on awkward rows."""

import os
import re
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from tidemark.llm import decontam, near_dup, toxicity  # noqa: E402
from tidemark.llm.common import parts, text_bytes  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    text = "a text of some length that is given more than once for a test of the stages"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", None, 70), (3, text, "en", None, 70), (4, text + " x", "en", "b", 72), (None, "without an id", "en", "b", 13), (5, "mail x@y.example.org", None, "b", 20)]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_keep_the_columns(spark, small, docs, odd):
    for rows in (docs, odd, docs.where("false")):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, rows, small)
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes, name
            assert out.count() <= rows.count()
        assert cp.mix_sources(spark, rows, small).columns[:5] == COLUMNS


def test_stages_keep_clashing_columns(spark, small, docs):
    """Columns that carry names used inside the operators, and one with a dot."""
    names = ["score", "_before", "_text", "_id", "id", "key", "row", "_s", "cut", "cut_n", "part", "epochs", "range", "ranges", "rest", "before", "a.b", "row_number", "_pii_x", "label", "spans", "kept", "cls"]
    rows = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    rows = rows.union(rows.where("doc_id = 3"))
    for name, stage in cp.STAGES:
        out = stage(spark, rows, small)
        assert out.columns[: len(rows.columns)] == rows.columns, name
        for r in out.collect():
            assert all(r[n] == f"own {n}" for n in names), name


def test_near_duplicates_of_one_id(spark, docs, small):
    text = "a text of some length that is given more than once for a test of the stages"
    rows = [(7, text, None, None, 1), (3, text, None, None, 2), (7, "another text of the same id which must stay", None, None, 3), (7, text, None, None, 4)]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), small).collect()
    assert sorted(r.n_chars for r in out) == [2, 3]


def test_near_duplicates(spark, small, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found, _ = brute.near_duplicates(rows, 80)
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, small).collect()) == sorted(set(found.values()))
    assert sorted(str(r.doc_id) for r in cp.drop_near_duplicates(spark, odd, small).collect()) == ["1", "2", "3", "5", "None"]


def test_benchmark(spark, small, docs):
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = sorted(r.doc_id for r in docs.collect() if not any(t in r.text for t in items))
    assert sorted(r.doc_id for r in cp.drop_benchmark(spark, docs, small).collect()) == clean


def test_personal_data(spark, small, docs, odd):
    out = {r.doc_id: r for r in cp.mask_personal_data(spark, docs, small).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        assert not brute.base_pii(out[r.doc_id].text)
        if out[r.doc_id].text == r.text:
            assert out[r.doc_id].n_chars == r.n_chars
    assert [r.text for r in cp.mask_personal_data(spark, odd, small).where("doc_id = 5").collect()] == ["mail [EMAIL]"]


def test_toxicity_rejects_marked_texts(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.drop_toxic(spark, rows, sf)
    marked = rows.where("text RLIKE '(?i)\\\\b(idiot|moron|scum)\\\\b'")
    assert marked.count() > 10
    assert kept.join(marked.select(F.col("doc_id").alias("m")), F.col("doc_id") == F.col("m")).count() <= 0.1 * marked.count()
    assert kept.count() > 0.8 * rows.count()
    # the stage drops what the operator scores at the threshold or above, and nothing else
    from tidemark.llm import toxicity

    model = toxicity.train(rows, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score(rows, model, "doc_id").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in scores.items() if x < toxicity.THRESHOLD)
    # and the operator's score is the plain sum over the distinct words' n-grams
    for r in rows.limit(20).collect():
        words = sorted(set(brute.license_words(r.text)))
        z = model.bias + sum(float(model.weights[brute.gram_hash(w[k : k + n], n, toxicity.BITS)]) for w in (b"<" + x + b">" for x in words) for n in toxicity.SIZES for k in range(len(w) - n + 1))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + 2.718281828459045 ** -z), abs=1e-6)


def test_mixing(spark, small, docs):
    """What is taken of each document, against sources laid out in the order of the hash keys."""
    rows = docs.select("*", F.xxhash64("doc_id", F.lit(cp.mixing.SEED)).alias("k")).collect()
    out = {r.doc_id: r for r in cp.mix_sources(spark, docs, small).collect()}
    for source in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r.k, r.doc_id))
        sizes = [len(brute.words(r.text)) for r in own]
        target = next(round(out[r.doc_id].target) for r in own if r.doc_id in out)
        epochs, rest = divmod(target, sum(sizes))
        for r, size in zip(own, sizes):
            taken = epochs * size + min(size, max(0, rest))
            rest -= size
            assert (out[r.doc_id].taken if r.doc_id in out else 0) == taken


def test_run(spark, small, docs):
    out = cp.run(spark, small)
    rows = out.collect()
    assert out.columns == [*COLUMNS, "size", "source_size", "target", "taken"]
    assert 0 < len(rows) < docs.count() and all(0 < r.taken <= 3 * r.size for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_personal_data_keeps_columns_named_like_its_own(spark, docs, small):
    """The operator's own column names as names of the user's columns: values stay, nothing is left unmasked."""
    from tidemark.llm import pii

    names = ["_pii_text", "_PII_Email", "_pii_spans", "__pii_text", "_pii_card", "_before"]
    rows = spark.createDataFrame([(1, "mail a@b.co now", 15, *(f"v{k}" for k in range(len(names))))], f"doc_id long, text string, n_chars int, {', '.join(n + ' string' for n in names)}")
    for out in (pii.mask_pii(rows), cp.mask_personal_data(spark, rows, small)):
        assert out.columns == rows.columns
        row = out.collect()[0]
        assert row.text == "mail [EMAIL] now" and [row[n] for n in names] == [f"v{k}" for k in range(len(names))]
    found = pii.find_pii(rows)
    row = found.collect()[0]
    assert found.columns == [*rows.columns, "spans"] and [row[n] for n in names] == [f"v{k}" for k in range(len(names))]
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("email", 5, 11)]
    short = cp.mask_personal_data(spark, rows.select("doc_id", "text"), small)  # a table without n_chars
    assert short.columns == ["doc_id", "text"] and short.collect()[0].text == "mail [EMAIL] now"


class Caught:
    """Stands for a table; gives the function that its rows would be sent to."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "benchmark"])
def test_tasks_hold_a_part_of_a_batch(spark, stage):
    """A task of a stage that reads texts in Python needs less memory than two batches take."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(8_000)), pa.array([" ".join(f"w{i}x{k} of" for k in range(200)) for i in range(8_000)])], ["doc_id", "text"])
    if stage == "toxicity":
        scored = toxicity.Model(0.0, np.ones(1 << toxicity.BITS, np.float32)).scorer()
        run = lambda batches: (scored(text_bytes(part.column(1))) for b in batches for part in parts(b))
    elif stage == "near_duplicates":
        run = near_dup.sketches(Caught())
    else:
        run = decontam.cut_docs(Caught(), [decontam.WINDOW], 60, SimpleNamespace(value=np.zeros(decontam.FILTER_BITS // 8, np.uint8)))
    tracemalloc.start()
    n = sum(map(len, run(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (0 if stage == "benchmark" else 8_000)
    assert peak < 2 * batch.nbytes, f"{peak >> 20} MB for a batch of {batch.nbytes >> 20}"


def test_texts_are_sent_to_be_scored_once(spark, small):
    """A kept text is scored where it lies in its row; the scores are those of texts sent besides."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = np.random.default_rng(1)
    model = toxicity.Model(-0.5, rng.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32))
    whole = toxicity.score(docs, model, *docs.columns)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Project \[struct\(.*\) AS row#\d+, .*text", plan), plan
    least = toxicity.score(docs, model, "doc_id").collect()
    assert sorted(((r.doc_id, r.score) for r in whole.collect())) == sorted((r.doc_id, r.score) for r in least)
    assert sorted(map(str, whole.drop("score").collect())) == sorted(map(str, docs.collect()))
