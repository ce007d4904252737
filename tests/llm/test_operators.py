"""Each operator against plain Python on the smallest tables, and on rows made to be awkward."""

import hashlib
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm import common, decontam, katz, license_scan, mixing, near_dup, pii, quality, token_count, topk, toxicity  # noqa: E402

LONG = "word " * 3000 + "9" * 5000 + " 1" * 4000 + " a@b" + ".c" * 4000
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "  \t\n ", None), (4, "one", "b"), (5, "one two three four five six seven", "b"), (6, "ONE two three four five six seven", "b"),
    (6, "ONE two three four five six seven", "b"), (7, LONG, "a"), (8, LONG + " end", "a"), (None, "no id here at all", "b"), (9, "Ünïcode ▁ x  y\x0b\x0c z q", "c"),
    (10, "mail me: x.y@z.example.com, call +1 (555) 555-0100 or 4111 1111 1111 1111 at 10.0.0.255", "c"), (10, "other text of the same id", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use themselves."""
    rows = [(i, t, s, 1, "x", 2.0, "y", 3) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, cls string, score double, spans string, taken int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark, small, texts):
    found, sizes = brute.near_duplicates(texts, 85)
    rows = near_dup.op9(spark, small).collect()
    assert len(rows) == len(texts) and len(set(found.values())) < len(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (found[r.doc_id], sizes[r.doc_id], found[r.doc_id] == r.doc_id)


def test_near_duplicates_odd(odd, none):
    rows = near_dup.near_duplicates(odd, 80).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[1, 0].kept and by[3, 0].component_id == 3  # without words: linked with nothing
    assert by[6, 3].component_id == 5 and not by[6, 3].kept and by[5, 3].kept
    assert by[8, max(n for i, n in by if i == 8)].component_id == 7
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert near_dup.near_duplicates(none, 80).collect() == []


def test_needed_is_a_lower_bound(spark):
    """Random pairs at the threshold share at least as many retained values as the filters assume."""
    import numpy as np

    rng, k, t = np.random.default_rng(1), near_dup.K, 0.85
    cases = []
    for a, b in ((100, 110), (300, 350), (330, 386), (384, 400), (420, 480), (600, 600), (1000, 900), (5000, 5000), (4300, 5000)):
        both = int(np.ceil(t / (1 + t) * (a + b)))
        for _ in range(60):
            h = rng.permutation(a + b - both)
            A, B = np.sort(h[:a])[:k], np.sort(np.concatenate([h[:both], h[a:]]))[:k]
            cases.append((a, b, len(np.intersect1d(A, B)), int(near_dup.list_lengths(np.array([len(A)]), np.array([a]), k, t)[0])))
    rows = spark.createDataFrame(cases, "a long, b long, shared long, prefix long").withColumn("need", near_dup.needed(F.col("a"), F.col("b"), k, t))
    assert rows.where("shared < need").count() == 0
    assert rows.where(F.least("a", F.lit(k)) - F.col("need") + 1 > F.col("prefix")).count() == 0


def form_letters(n, rng):
    """Letters of one form of 104 words with three words filled in, at places that vary."""
    form = [f"w{k}" for k in range(104)]
    out = []
    for i in range(n):
        words = list(form)
        for at in (20, 50, 80):
            words[at] = f"name{rng.randrange(n)}"
        out.append((i, " ".join(words)))
    return out


def test_form_letters_are_not_all_compared(spark, monkeypatch):
    """Comparisons of the last round grow in proportion to the letters of a form; the result is that of plain Python."""
    import random

    made, written = {}, near_dup.materialise

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    monkeypatch.setattr(near_dup, "materialise", kept)
    monkeypatch.setattr(near_dup, "discard", lambda *tables: None)
    compared = {}
    for n in (2_000, 20_000):
        near_dup.near_duplicates(spark.createDataFrame(form_letters(n, random.Random(n)), "doc_id long, text string"), 85).collect()
        sides = made["lists"].groupBy("v").agg((F.count_if("own") * F.count("*")).alias("n"))
        compared[n] = sides.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert compared[20_000] <= 15 * max(compared[2_000], 2_000)
    rows = form_letters(150, random.Random(1))
    rows += [(1000 + i, t.replace("w90", "x90")) for i, t in rows[:40]]
    found, _ = brute.near_duplicates(rows, 85)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == found


def test_near_duplicates_of_long_texts(spark):
    """Sets above k shingles, at and around the threshold: recall of links against all pairs."""
    import random

    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(50_000)}"
    rows = []
    for base in range(30):
        text = [word() for _ in range(rng.choice((450, 700, 1500, 3000)))]
        for copy in range(6):
            words = [word() if rng.random() < copy * 0.0035 else w for w in text]
            rows.append((100 * base + copy, " ".join(words)))
    for percent in (80, 85):
        found, sizes = brute.near_duplicates(rows, percent)
        assert min(sizes.values()) > near_dup.K
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
        assert got == found and 30 < len(set(found.values())) < len(rows)


def test_long_lists_are_dealt_to_parts(spark, monkeypatch):
    """The same pairs however a list is dealt; each from its smaller member."""
    rows = spark.createDataFrame([(i, 100 + i % 5, 0, 90, 1, 7, i % 3 != 0, i if i % 4 else 4) for i in range(1, 60)], "cls long, size long, single int, ahead long, band int, v long, own boolean, comp long")
    pairs = lambda: {(r.cls, r.cls_b) for r in near_dup.rest_pairs(rows).collect()}
    whole = pairs()
    monkeypatch.setattr(near_dup, "PART", 7)
    assert pairs() == whole
    all_rows = rows.collect()
    assert whole == {(a.cls, b.cls) for a in all_rows if a.own for b in all_rows if a.cls != b.cls and a.size <= b.size and a.comp != b.comp}


def test_crowded_lists_by_differences(spark, monkeypatch):
    """Copies of one text with many edits each, of which many are linked to few others: the components of all pairs, and
    far fewer candidates than pairs of such copies, which all share most of the text."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for length in (300, 420):
        text, rows = [word() for _ in range(length)], []
        slips = [(rng.randrange(length), word()) for _ in range(24)]  # edits that several copies share
        for copy in range(160):
            words = list(text)
            for place, new in [(rng.randrange(length), word()) for _ in range(rng.randrange(9))] + rng.sample(slips, rng.randrange(5)):
                words[place] = new
            rows.append((copy, " ".join(words)))
        docs, met = spark.createDataFrame(rows, "doc_id long, text string"), []
        alike = near_dup.differing_alike
        monkeypatch.setattr(near_dup, "differing_alike", lambda *a, alike=alike: met.append(alike(*a).distinct().count()) or alike(*a))
        want, _ = brute.near_duplicates(rows, 85)
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 85).collect()} == want
        monkeypatch.setattr(near_dup, "differing_alike", alike)
        outside = len(rows) - max(list(want.values()).count(c) for c in want.values())
        assert outside > near_dup.OUTSIDE and met and met[-1] < outside * len(rows) / 4


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Every join of op9 deals out both sides, also those that look small to the planner, unless few rows are counted: they
    grow with the documents."""
    import random

    rng, plans, written = random.Random(5), {}, near_dup.materialise
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = [word() for _ in range(300)]
    slips = [(rng.randrange(300), word()) for _ in range(24)]
    rows = []
    for copy in range(160):
        words = list(text)
        for place, new in [(rng.randrange(300), word()) for _ in range(rng.randrange(9))] + rng.sample(slips, rng.randrange(5)):
            words[place] = new
        rows.append((copy, " ".join(words)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def kept(df, name):
        plans[name] = plans.get(name, "") + plan(df)
        return written(df, name)

    monkeypatch.setattr(near_dup, "materialise", kept)
    monkeypatch.setattr(near_dup, "SENT_ROWS", 0, raising=False)
    plans["result"] = plan(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    assert {"changes", "changed-lists", "links", "labels", "result"} <= set(plans)
    assert [name for name, text in plans.items() if "Broadcast" in text] == []


def test_components(spark):
    """A long chain and a large star."""
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 200)]
    rows = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.comp for r in rows} == {i: 1 if i < 100 else 100 for i in (*range(1, 61), *range(100, 300))}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_katz(spark, small, texts):
    want, total, sums = brute.katz(texts, lambda i: brute.crc(i) % 5 == 1)
    assert all(abs(x - 1) < 1e-9 for x in sums.values())
    rows = katz.op3(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.crc(r.doc_id) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-10) and r.score == pytest.approx(score, rel=1e-10)


@pytest.mark.parametrize("all_learnt", [True, False])
def test_katz_chunks_do_not_matter(spark, small, monkeypatch, all_learnt):
    learn = F.lit(True) if all_learnt else ~common.fold("doc_id", 5, 1)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    a = {r.doc_id: r.score for r in katz.katz_scores(docs, learn).collect()}
    small_chunks = katz.packed
    monkeypatch.setattr(katz, "packed", lambda d, learn: small_chunks(d, learn, 20_000))
    b = {r.doc_id: r.score for r in katz.katz_scores(docs, learn).collect()}
    assert a.keys() == b.keys() and all(b[i] == pytest.approx(x, rel=1e-10) for i, x in a.items())


def test_katz_odd(odd, none):
    rows = katz.katz_scores(odd, F.col("doc_id") > 4).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.held_out for r in rows if r.doc_id is None or r.doc_id <= 4)
    assert {r.score for r in katz.katz_scores(odd, F.lit(False)).collect()} == {0.0}  # nothing learnt
    assert katz.katz_scores(none, F.lit(True)).collect() == []


def test_token_counts(spark, small, odd, none):
    model = token_count.checked_model(token_count.model_path())
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.union(odd.select("doc_id", "text")).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in rows)
    got = token_count.token_counts(docs.union(odd.select("doc_id", "text")), token_count.model_path()).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_count.token_counts(none, token_count.model_path()).collect() == []


def wanted_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped, total = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    for rows in (docs, odd.select("doc_id", "text", "source"), docs.withColumn("source", F.when(F.col("doc_id") < 150, "big").otherwise(F.col("source")))):
        out = mixing.mix(rows).collect()
        again = mixing.mix(rows.repartition(5)).collect()
        key = lambda r: (str(r.doc_id), r.text or "", r.taken)
        assert sorted(map(key, out)) == sorted(map(key, again))
        sizes, taken, target = {}, {}, {}
        for r in out:
            assert r.size == len(brute.words(r.text)) and 0 <= r.taken <= 3 * r.size
            sizes[r.source], taken[r.source], target[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken, r.target
        for s, x in wanted_targets(sizes).items():
            assert target[s] == pytest.approx(x) and abs(taken[s] - x) <= 2  # repeated rows share a cut, rounded down
    assert mixing.mix(none).collect() == []


def test_personal_data(spark, small, odd, none, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts] + [(1000 + k, t) for k, (_, t, _) in enumerate(ODD)], "doc_id long, text string")
    want = {r.doc_id: brute.base_pii(r.text or "") for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert sorted((s.start, pii.BASE.index(s.kind), s.kind, s.end) for s in r.spans if s.kind in pii.BASE) == want[r.doc_id]
    assert pii.find_pii(none).collect() == []
    for r in pii.op8(spark, small).collect():
        spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_personal_data_kinds(spark):
    cases = {
        "IBAN GB82 WEST 1234 5698 7654 32 please": {"iban"},
        "IBAN GB82 WEST 1234 5698 7654 33 please": set(),
        "the token = " + "ab12" * 10: {"secret"},
        "a hash " + "ab12" * 10: set(),
        "4111-1111-1111-1111": {"card"},
        "4111-1111-1111-1112": set(),
        "1.2.3.4.5.6.7.8": {"ip"},
        "1.2.3.256": set(),
    }
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.text: {s.kind for s in r.spans} for r in rows} == cases


def test_personal_data_many_spans(spark):
    """As many spans as would never end if the work grew with their square; the words before spans close together."""
    n = 30_000
    text = "é " + "".join(f"x{i}@ab.org, " for i in range(n)) + "mail 4111 1111 1111 1111"
    rows = spark.createDataFrame([(1, text), (2, "phone a@b.c +15550100200"), (3, "phone " + "a@b.c " * 9 + "+15550100200")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_pii(rows).collect()}
    assert [(s.kind, s.start, s.end) for s in found[1]] == [(k, s, e) for s, _, k, e in brute.base_pii(text)] and len(found[1]) == n + 1
    assert found[2][-1].kind == "phone" and found[2][-1].score > 0.7 > found[3][-1].score
    masked = {r.doc_id: r.text for r in pii.mask_pii(rows).collect()}
    assert masked[1] == "é " + "[EMAIL], " * n + "mail [CARD]"


def test_masking(odd):
    rows = {(r.doc_id, r.source): r for r in pii.mask_pii(odd).collect()}
    assert rows[1, "a"].text is None and rows[2, "a"].text == ""
    text = [r.text for r in pii.mask_pii(odd).where("doc_id = 10").collect()]
    assert "mail me: [EMAIL], call [PHONE] or [CARD] at [IP]" in text and "other text of the same id" in text


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0], "q"), (20, [0.5, 0.5], "q"), (1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b"), (3, None, "c"), (4, [float("nan"), 1.0], "d"), (5, [float("inf"), 0.0], "e"), (6, [None, 1.0], "f"), (7, [-1.0, -3.0], "g"), (2, [1.0, 2.0], "again"), (None, [1.0, 1.0], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").select("vec_id", topk.quantised(F.col("embedding")).alias("v"), "rank")
    out = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert out == [(0, 1, 1, 20480), (0, 2, 2, 20480), (0, 3, 20, 6144), (0, 4, 7, -28672), (20, 1, 0, 6144), (20, 2, 1, 6144), (20, 3, 2, 6144), (20, 4, 7, -8192)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_stops_early_and_stays_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.integers(-60, 60, (20, 16))
    v = (centres[rng.integers(0, 20, 3000)] + rng.integers(-3, 4, (3000, 16))).astype(int)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, rows in got.items():
        s = v @ v[q]
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(rows) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert len(got) == 30


def test_top_k_counts_what_it_evaluates():
    """Clustered vectors: few pairs are evaluated; a far-off pivot and lengths beyond doubles change no result."""
    import numpy as np

    rng = np.random.default_rng(4)
    near = rng.integers(-60, 60, (50, 32))[rng.integers(0, 50, 4000)] + rng.integers(-3, 4, (4000, 32))
    far = near.copy()
    far[7] = 10**6
    huge = near * 2**20
    for v, share in ((near, 0.4), (far, 1), (huge, 1)):
        ids, q, k = np.arange(4000) * 3, np.arange(0, 4000, 40), 5
        d = topk.distances(v, topk.far_apart(v[:500], 32))
        number, found, score, evaluated = topk.searched(ids[q], v[q], d[q], np.full(100, np.iinfo(np.int64).min), ids, v, d, k)
        assert evaluated <= share * 100 * 4000
        for n, i in enumerate(q):
            s = v @ v[i]
            best = sorted((j for j in range(4000) if j != i), key=lambda j: (-int(s[j]), j))[:k]
            assert found[number == n].tolist() == ids[best].tolist() and score[number == n].tolist() == s[best].tolist()


def test_license_scan(spark, small, odd, none, texts):
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    all_texts = dict(texts)
    for r in license_scan.op6(spark, small).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), all_texts[r.doc_id]))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(at)) and r.base_labels == ",".join(sorted({x for _, x in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == len(ODD) and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert license_scan.license_scan(none).collect() == []


def test_license_join_finds_every_block(spark):
    """Blocks around the threshold, against set containment by hand."""
    import random

    rng, templates = random.Random(5), license_scan.TEMPLATES
    docs = []
    for k in range(300):
        words = templates[k % len(templates)][1].split()
        lines = [" ".join([w for w in words if rng.random() > k % 5 / 15] + rng.sample(["zeta", "eta", "theta"], 2)) for _ in range(2)]
        docs.append((k, "\n".join(lines)))
    word = lambda t: set(license_scan.words_of(t.encode()))
    want = {(i, label) for i, t in docs for label, x in templates for line in t.split("\n") if len(word(line) & word(x)) >= 0.8 * len(word(x)) - 1e-9}
    rows = license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, m.label) for r in rows for m in r.matches} == want and len(want) > 100


def test_license_scan_finds_wrapped_notices(spark):
    """Each template wrapped at 70 and at 30 columns, as a comment and deep inside a long text."""
    import textwrap

    docs, want = [], {}
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        for j, (width, before) in enumerate([(70, ""), (30, ""), (30, "some line of prose\n" * 29)]):
            docs.append((3 * k + j, before + "\n".join(" * " + x for x in textwrap.wrap("x " * 12 + text, width)) + "\nand more of it"))
            want[3 * k + j] = label
    rows = license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert want[r.doc_id] in r.labels and r.score == 1.0


def test_license_scan_finds_whole_notices(spark):
    """A template of 150 words, wrapped, within other text and with a tenth of its words replaced."""
    import random
    import textwrap

    rng = random.Random(2)
    notice = [f"term{k}" for k in range(150)]
    edited = [w if rng.random() > 0.1 else "other" for w in notice]
    half = notice[:75] + ["filler"] * 75
    around = " ".join(["prose"] * 333)
    docs = [(k, "\n".join(textwrap.wrap(f"{around} {' '.join(x)} {around}", 60))) for k, x in enumerate((notice, edited, half))]
    templates = (*license_scan.TEMPLATES, ("whole", " ".join(notice)))
    rows = license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates).collect()
    assert {r.doc_id: "whole" in r.labels for r in rows} == {0: True, 1: True, 2: False}


def test_decontamination(spark, small, odd, none):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in decontam.op1(spark, small).collect()} == want and want
    assert decontam.contaminated(odd, items).collect() == []
    assert decontam.contaminated(none, items).collect() == [] and decontam.contaminated(docs, items.where("false")).collect() == []


def test_decontamination_slots(spark):
    item = "On Monday morning the farmer Miller sold 12 crates of apples and 7 kg of pears to Smith, then Miller bought 12 more crates from the town market."
    other = item.replace("12", "35").replace("7 kg", "9 lbs").replace("Miller", "Baker").replace("Smith", "Jones")
    mixed = item.replace("12", "35", 1)  # the same slot value stands for two values
    docs = [(1, "Before it all. " + item + " After it all."), (2, other.upper().title() if False else other), (3, mixed), (4, "The farmer sold crates of apples and pears to the town market on Monday."), (5, None), (6, item), (6, item)]
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item), (None, item), (8, None), (7, "")], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert set(found) == {(1, 9), (2, 9), (6, 9)} and len(rows) == 3
    assert found[2, 9].reparameterised and found[2, 9].n_changed >= 4 and not found[1, 9].reparameterised


def copies(spark, docs, items):
    """(place in docs, place in items) of what is found."""
    rows = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id) for r in rows}


def test_decontamination_short_and_unspaced(spark):
    prose = "some words of a text that has nothing to do with any of the items here "
    items = ["which planet has most moons?", "太陽系で最も大きい惑星はどれですか。", "水的化学式是什么"]
    docs = [prose * 5 + "Question: Which planet has most moons? " + prose * 5, "これは長い文章です。" * 9 + items[1] + "次の文が続きます。" * 9, "前面有很多别的话，" * 9 + items[2] + "？后面还有", prose * 9, "which planet has the most moons", "别的话" * 30]
    assert copies(spark, docs, items) == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_dense_items(spark):
    prose = "some words of a text that has nothing to do with any of the items here. "
    dense = "Add 12 7 31 4 9 15 to 3 8 22 51 60 2 or 5 6 81 33"
    names = "Anna Smith, Bert Jones, Carl Brown, Dora White, Emil Green, Fred Black, Gina Stone"
    bridged = "the farmer took the old road to the town of Adam Bell Carl Dorn Emil Falk Gina Holt Ivan Junk and there he sold a basket of ripe red apples"
    docs = [prose * 3 + x + ". " + prose * 3 for x in (dense, names, bridged, dense.replace("31", "32").replace("15", "16").replace("60", "61"), bridged.replace("Bell", "Cole").replace("Emil", "Udo").replace("Holt", "Ross"))]
    assert copies(spark, docs, [dense, names, bridged]) == {(0, 0), (1, 1), (2, 2), (4, 2)}


def test_decontamination_edited_copies(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(40)]
    replaced = [word() if k in (13, 26) else w for k, w in enumerate(item)]
    put_in = [*item[:13], word(), *item[13:26], word(), *item[26:]]
    slots = "the old baker Smith sold fresh bread to every house in the lane for 12 silver coins and then walked slowly home before dark fell"
    other = slots.replace("Smith", "Mary Jones").replace("12", "1 200")
    filler = lambda n: " ".join(word() for _ in range(n))
    part = f"{' '.join(item[:13])} {filler(27)}"  # a third of the item only
    docs = [f"{filler(50)} {x} {filler(50)}" for x in (" ".join(replaced), " ".join(put_in), other, part)]
    assert copies(spark, docs, [" ".join(item), slots]) == {(0, 0), (1, 0), (2, 1)}


def test_decontamination_columns(spark, small):
    """All columns of exact copies, and a copy that is the whole document."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()} | {10**6 + i: t for i, t in items.items()}
    rows = decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    tokens = lambda t: len(decontam.TOKEN.findall(t.encode()))
    whole = 0
    for r in rows:
        doc, item = docs[r.doc_id], items[r.item_id]
        if doc.count(item) == 1:
            whole += 1
            assert (r.doc_at, r.n_words, r.coverage, r.n_changed, r.reparameterised) == (tokens(doc[: doc.index(item)]), tokens(item), 1.0, 0, False)
    assert whole >= len(items) and {10**6 + i for i in items} <= {r.doc_id for r in rows}


def test_decontamination_names_first(spark):
    """Questions whose sentences start with names, and with a common word that an edit replaces once."""
    item = "Alice has 3 apples. Bob has 5 pears. Carol eats 2 plums. How many pieces of fruit are left over for the three friends?"
    other = "Maria has 4 apples. Tom has 6 pears. Susan eats 1 plums. How many pieces of fruit are left over for the three friends?"
    swapped = "The red train left the station before noon. The slow bus stood there until the evening came. The driver was asleep all day."
    prose = "Some words of a text that has nothing to do with any of the items. It has 3 parts. They are short. "
    docs = [prose * 3 + other + " " + prose, prose * 2 + swapped.replace("The slow", "A slow") + prose, prose * 9]
    assert copies(spark, docs, [item, swapped]) == {(0, 0), (1, 1)}


def held_out_accuracy(spark, sf, rows, label):
    known = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("i"), label)
    pairs = rows.join(known, F.col("doc_id") == F.col("i")).where("held_out").select("predicted", label, "score").collect()
    assert all(0 <= p.score <= 1 for p in pairs)
    return sum(p.predicted == p[label] for p in pairs) / len(pairs), len(pairs)


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    accuracy, n = held_out_accuracy(spark, sf, quality.op7(spark, sf), "quality")
    assert n > 50 and accuracy > 0.9
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels, F.lit(True))
    assert len(quality.score(odd, model).collect()) == len(ODD) and quality.score(none, model).collect() == []
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.where("false"), F.lit(True))).collect()} == {0.5}


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    accuracy, n = held_out_accuracy(spark, sf, toxicity.op10(spark, sf), "toxic")
    assert n > 50 and accuracy > 0.9
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    assert len(toxicity.score(odd, model, "doc_id").collect()) == len(ODD) and toxicity.score(none, model, "doc_id").collect() == []
    unlearnt = toxicity.score(odd, toxicity.train(odd, labels.where("false"), F.lit(True)), "doc_id").collect()
    assert {round(r.score, 6) for r in unlearnt} == {0.05}


def shared_passage(n, rng, passage=30, own=120):
    """Texts of which every third holds one passage; pairs at, above and below the threshold among them."""
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(passage)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(own)]
        rows.append(text[:60] + common + text[60:] if i % 3 == 0 else text)
    for i in range(0, n, 5):
        copy = list(rows[i])
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_hot_values_stay_out_of_the_ranges(spark, monkeypatch):
    """A passage in a third of the classes: no key range has twice the entries of the median one, and no link is lost."""
    import random

    import numpy as np

    rows = shared_passage(1500, random.Random(3))
    monkeypatch.setattr(near_dup, "RANGE", 1024)
    seen = {}

    def kept(reps, buckets, k, t, hot):
        out = postings(reps, buckets, k, t, hot)
        sizes = [(r.bucket, len(common.unpack_sorted(r.v))) for r in out.collect()]
        for b, n in sizes:
            seen[b] = seen.get(b, 0) + n
        seen["hot"] = len(hot)
        return out

    postings = near_dup.postings
    monkeypatch.setattr(near_dup, "postings", kept)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 80).collect()}
    assert seen.pop("hot") >= 20  # the shingles inside the passage
    assert len(seen) >= 32 and max(seen.values()) <= 2 * np.median(list(seen.values()))
    found, _ = brute.near_duplicates(rows, 80)
    assert got == found and len(set(found.values())) < len(rows)


def test_hot_values_are_those_above_the_bound(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    common_ = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 30).astype(np.uint64), common_[rng.random(40) < np.linspace(0.02, 0.6, 40)]])) for _ in range(800)]
    counts = {int(v): sum(v in s for s in sets) for v in common_}
    df = spark.createDataFrame([(i, len(s), bytearray(common.pack_sorted(s))) for i, s in enumerate(sets)], "cls long, size long, sketch binary").repartition(6)
    for least in (100, 300, 900):
        assert near_dup.hot_values(df, least, len(sets)).tolist() == sorted(v for v, n in counts.items() if n >= least)


def test_exact_mode_of_long_texts(spark):
    """Sets far above K, many of them right at the threshold: with whole sets every link is found."""
    import random

    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**7)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(500, 1500))]
        shingles = len(base) - 4
        rows.append(base)
        for _ in range(2):  # each changed word takes five shingles of both: similarity a little above or below 0.85
            copy = list(base)
            changes = round(shingles * (0.15 / 1.85) / 5) + rng.choice((-1, 0, 1))
            for at in rng.sample(range(10, len(base) - 10, 6), changes):
                copy[at] = word()
            rows.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    found, _ = brute.near_duplicates(rows, 85)
    assert 20 < len(set(found.values())) < 110
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 85, exact=True).collect()} == found
    small = [(i, t) for i, t, _ in ODD if i is not None]
    odd = spark.createDataFrame(small, "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert key(near_dup.near_duplicates(odd, 80, exact=True).collect()) == key(near_dup.near_duplicates(odd, 80).collect())
    assert near_dup.near_duplicates(odd.where("false"), 80, exact=True).collect() == []


def test_very_short_items_are_reported_and_not_looked_for(spark):
    docs = spark.createDataFrame([(k, f"the cat number {k} sat on the mat and the dog did not") for k in range(20)] + [(99, "so the quick brown fox ran off with the hat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the cat sat"), (3, "quick brown fox ran off"), (4, ""), (5, None), (None, "a"), (6, "\u4eca\u5929")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(99, 3)]
    assert sorted(map(tuple, decontam.too_short(items).collect())) == [(1, 1), (2, 3), (4, 0), (6, 2)]
