"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Every document becomes the set of its distinct five-word shingles, hashed by one function to 64 bits. Its
   bottom-k sketch is the k smallest hashes. Documents with the same set are one class.
2. Inverted lists of retained values propose pairs. Two sets of similarity t or more share at least ``needed`` of
   their k retained values, a bound that is certain for sets no larger than k and otherwise missed about once in a
   million pairs at the threshold itself. So, with a sketch's values ordered from rare to frequent over the corpus,
   two such sketches meet early in both: the first value they share has at least ``needed`` values from it on in
   either (prefix and positional filter). Passages that many documents share are frequent values and stay out of
   the lists of documents that also have text of their own; copies with too many edits of their own meet nobody.
3. The SHORT smallest values of both sketches together estimate the similarity; pairs too low are dropped.
4. The remaining pairs are verified on the full sets, and verified links are joined to components.

A list is not compared with itself as a whole. First every member is paired with one leader of about its size, the one
with the fewest values of its own; then with DRAWN leaders drawn by hash; and only then are members outside the
list's largest component paired with members of other components, and of these only such as may link: the smaller of
two linked sets must have enough values from the list's on to match a set of its own size (``own``). So a value that
all letters of one form share costs nothing once each letter's own values have used up what may differ. Pairs inside
a component are not needed: they cannot change it. A long list is dealt to several tasks.

In a list with many members outside its largest component (``crowded``), copies of one text with too many edits each,
nearly all members would meet nearly all others, once in each list. They are compared by what they differ in from one
of that component, the anchor: the shingles that only one of the two has. Two sets differ in what stands in just one of
their differences. So one that is not linked to the anchor itself differs from it by more than a link allows, and any
partner must share some of that difference: it is looked for by inverted lists of differences, rarest first, with the same
two filters. Edits of its own, and those that few others made, are all that a member is found by there.

A value that a large share of the classes retain is no burden of one task: tasks name the values that are frequent
among their own documents, which every value of that share is somewhere, their counts are added up, and the entries of
those above a share of a key range go past the ranges, each from its own task. Joins on a list's value are salted.

No join sends a table through the driver, but for such as are counted first (SENT_ROWS): all of them grow with the documents,
and what packs to a few MB of Parquet (and a list's salted keys, of which the planner knows nothing) took up to 117 MB there
at 0.5 GB of text. Both sides are dealt out by key.

For sets above k shingles steps 2 and 3 are bounds of chance, not a proof; README has the measured recall. With ``exact``
whole sets take the place of sketches and no estimate is made: the filters are then certain for sets of any size, at the
price of entries for all shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Hashes, discard, materialise, pack, pack_sorted, parts, slices, text_bytes, unpack, unpack_sorted, window_hashes, word_hashes

SHINGLE = 5
K = 384
#: The variance of what a sketch lacks, against that of drawing without replacement from one set: the two sets' draws
#: end at a common value, which adds to it. Simulated pairs show up to 1.1 (tests); the rest is margin.
SPREAD = 1.2
#: Values that estimate a pair's similarity.
SHORT = 64
MISS = 1e-7
#: Leaders of a list in the second round.
DRAWN = 3
#: Members of a list that one task compares with those that may link to them.
PART = 4096
#: Retained values for each key range of the inverted lists.
RANGE = 1 << 20
#: A value is hot if it has more entries than this share of a key range; how many hot values are known at most (the most
#: frequent ones; others stay in their ranges, which changes no result).
HOT_SHARE, MOST_HOT = 0.25, 1 << 20
#: Members of a list outside its largest component, from which on they are compared by their differences from an anchor.
OUTSIDE = 16
#: Parts that the members of a list are dealt to where they are joined with what is known of the list.
SALT = 8
#: Words whose hashes a task remembers, and sketches of which it counts values at a time: bounds of its memory.
WORDS, COUNTED = 1 << 17, 2048
#: Rows of two numbers of which a join may send a table whole, if it has been counted.
SENT_ROWS = 1 << 17
#: Bits of the fixed-size filter with which the scan for full sets passes over uninvolved documents.
FILTER_BITS = 1 << 24


def shingle_set(text: bytes, memo: Hashes, n: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending; the whole sequence is one shingle if it is shorter."""
    h = word_hashes(text.lower().split(), memo)
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else h


def least_shared(k: int, t: float) -> int:
    """Greatest m such that fewer than m of k draws hit with probability t less often than MISS."""
    p, m = 0.0, 0
    while p < MISS:
        p += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        m += 1
    return max(1, m - 1)


def needed(a: Column, b: Column, k: int, t: float) -> Column:
    """How many values the sketches of sets of a and b shingles with similarity t or more share at least. Such sets
    share t / (1 + t) * (a + b) shingles. Of the larger set's k smallest, those that the other lacks are drawn
    without replacement, and so are the other's values up to there that the larger lacks; all others of the k are
    shared. The bound lies 5.2 standard deviations and 3 beyond the mean of the larger of the two."""
    large = F.greatest(a, b)
    both = F.ceil((a + b) * (t / (1 + t)) - 1e-9)
    mean = (large - both) * k / large
    return F.when(large <= k, both).otherwise(F.floor(k - (mean + 5.2 * F.sqrt(mean * SPREAD * (1 - k / large)) + 3)))


def list_lengths(kept: np.ndarray, sizes: np.ndarray, k: int, t: float) -> np.ndarray:
    """How many of its rarest values a sketch must be found by, whatever its partner's size."""
    mean = (1 - t) * k
    drawn = np.floor(k - (mean + 5.2 * np.sqrt(mean * SPREAD * np.maximum(0, 1 - k * t / np.maximum(1, sizes))) + 3)) - 1
    whole = np.ceil(t * sizes - 1e-9)
    least = np.where(sizes <= k * t, whole, np.where(sizes <= k, np.minimum(whole, drawn), drawn))
    return np.maximum(1, kept - least + 1).astype(np.int64)


def dealt(rows: DataFrame, count: int | None = None) -> DataFrame:
    """The right side of a join that deals out both sides by key, however small this one looks to the planner; one with at
    most SENT_ROWS rows by ``count`` is left to it."""
    return rows if count is not None and count <= SENT_ROWS else rows.hint("merge")


def sketches(docs: DataFrame, n: int = SHINGLE, k: int | None = K) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the full set; null if empty), sketch (packed, ascending; without k the
    whole set)."""

    def run(batches):
        memo = Hashes()
        memo.LIMIT = WORDS
        for b in (part for batch in batches for part in parts(batch)):
            sizes, keys, kept = [], [], []
            for text in text_bytes(b.column(1)):
                s = shingle_set(text, memo, n)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                kept.append(pack_sorted(s[:k]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def hot_values(reps: DataFrame, least: int, total: int) -> np.ndarray:
    """The values, ascending, that at least ``least`` of the ``total`` classes retain.

    Such a value is in some task's share of the classes as frequent as among all, so only values that reach this
    share in a task are named, with their counts in every task that names them: a lower bound of all. Those that it
    leaves below ``least`` are counted exactly where there is any doubt: by all tasks, among the named only."""
    if least > total:
        return np.empty(0, np.uint64)

    def counts_of(blobs):
        v, count = np.unique(np.concatenate([unpack_sorted(x) for x in blobs]), return_counts=True)
        on = count * total >= least * len(blobs)
        return pa.RecordBatch.from_arrays([pa.array(v[on].view(np.int64)), pa.array(count[on])], ["v", "n"])

    def frequent(batches):
        # a task's last classes are counted with those before them: among a few, every value is frequent
        blobs, each = [], COUNTED // 2
        for b in batches:
            blobs += b.column(0).to_pylist()
            whole = max(0, len(blobs) // each - 1) * each
            for first in range(0, whole, each):
                yield counts_of(blobs[first : first + each])
            blobs = blobs[whole:]
        if blobs:
            yield counts_of(blobs)

    some = reps.select("sketch").mapInArrow(frequent, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    rows = some.orderBy(F.desc("n"), "v").limit(MOST_HOT).select("v").toArrow()
    named = np.sort(rows["v"].to_numpy().view(np.uint64))
    if not len(named):
        return named

    def counted(batches):
        total = np.zeros(len(named), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                v = unpack_sorted(x)
                at = np.minimum(np.searchsorted(named, v), len(named) - 1)
                total[at[named[at] == v]] += 1
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["at", "n"])

    counts = reps.select("sketch").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("at").toArrow()
    return named[np.sort(counts["at"].to_numpy())]


def entries(columns: list, k: int, t: float):
    """v ascending, and for each its class, the class's size and how many of its rarest values must be in lists."""
    found = [unpack_sorted(x) for x in columns[2].to_pylist()]
    each = np.array([len(x) for x in found])
    sizes = np.asarray(columns[1])
    rows = [np.repeat(x, each) for x in (np.asarray(columns[0]), sizes, list_lengths(each, sizes, k, t))]
    v = np.concatenate(found)
    up = np.argsort(v, kind="stable")
    return v[up], [c[up].astype(np.int64) for c in rows]


def is_in(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(v), bool)
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v


def postings(reps: DataFrame, buckets: int, k: int, t: float, hot: np.ndarray) -> DataFrame:
    """The retained values of the classes (cls, size, sketch) that are not hot, packed by key range."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v, columns = entries(b.columns, k, t)
                on = ~is_in(v, hot)
                v, columns = v[on], [c[on] for c in columns]
                out = [(bucket, pack_sorted(v[i:j]), *(pack(c[i:j]) for c in columns)) for bucket, i, j in slices(v, buckets)] if len(v) else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], ["bucket", "v", "cls", "size", "prefix"])

    return reps.select("cls", "size", "sketch").mapInArrow(run, "bucket int, v binary, cls binary, size binary, prefix binary")


def hot_entries(reps: DataFrame, k: int, t: float, hot: np.ndarray, total: int) -> DataFrame:
    """The entries of hot values, as ``shared_values`` gives those of others; their number counts as ``total``, so that they
    come after all others in the order of rarity."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v, columns = entries(b.columns, k, t)
                on = is_in(v, hot)
                rows = [*(c[on] for c in columns), np.full(int(on.sum()), total), v[on].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["cls", "size", "prefix", "df", "v"])

    return reps.select("cls", "size", "sketch").mapInArrow(run, "cls long, size long, prefix long, df long, v long")


def shared_values(pdf: pd.DataFrame) -> pd.DataFrame:
    """The values of one key range that several classes retain, with their number."""
    v = np.concatenate([unpack_sorted(x) for x in pdf["v"]])
    _, number, count = np.unique(v, return_inverse=True, return_counts=True)
    df = count[number]
    on = df > 1
    columns = {c: np.concatenate([unpack(x, np.int64) for x in pdf[c]])[on] for c in ("cls", "size", "prefix")}
    return pd.DataFrame(columns | {"df": df[on], "v": v[on].view(np.int64)})


def short_sketches(reps: DataFrame) -> DataFrame:
    """cls, size and the SHORT smallest values as signed numbers in the same order."""

    def run(batches):
        for b in batches:
            kept = [(unpack_sorted(x)[:SHORT] ^ np.uint64(1 << 63)).view(np.int64) for x in b.column(2).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32))
            values = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, values)], ["cls", "size", "sketch"])

    return reps.select("cls", "size", "sketch").mapInArrow(run, "cls long, size long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, full set) of the documents whose ids are in ``ids``.

    A filter of fixed size (FILTER_BITS, at most 2 MB however many ids there are) is sent to the scan, so that
    texts are not shuffled to find them; the join that follows removes what passes it by chance.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(F.floor(place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        memo = Hashes()
        memo.LIMIT = WORDS
        for b in (part for batch in batches for part in parts(batch)):
            p = np.asarray(b.column(2))
            on = np.flatnonzero((sent.value[p >> 6] >> (p & 63)) & 1)
            b = b.take(pa.array(on))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack_sorted(shingle_set(x, memo, n)) for x in text_bytes(b.column(1))], pa.binary())], ["doc_id", "full"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("p"))
    return rows.mapInArrow(run, "doc_id long, full binary").dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each id over ``edges`` (a, b).

    Labels move along links and then jump to their label's label, until a round changes nothing; each round is a
    written table. The number of rounds grows with the logarithm of the longest chain.
    """
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "both")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    n = labels.count()  # of every round, and at most so many have a neighbour
    while True:
        near = both.join(dealt(labels, n), both.b == labels.id).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(dealt(near, n), labels.id == near.a, "left").select("id", F.least("comp", F.coalesce("low", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("id").alias("j"), F.col("comp").alias("up"))
        new = materialise(step.join(dealt(jump, n), step.comp == jump.j, "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"), "labels")
        moved = new.where("comp <> old").isEmpty()
        discard(labels)
        labels = new
        if moved:
            discard(both)
            return labels.select("id", "comp")


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE, k: int = K, exact: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_shingles,
    component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept says that it is the row's own. A null or
    empty text, or one of blanks only, has no shingles and is linked with nothing; repeated rows and equal texts
    are linked (similarity 1); rows that share a doc_id but not the text are linked by similarity alone; rows
    without doc_id take no part, their component_id is null and they are kept. Texts of any length count whole. An
    empty table gives an empty result. ``exact``: no link is left to chance, however large the sets (see above).
    """
    t = percent / 100
    sig = materialise(sketches(docs, n, None if exact else k), "sketches")
    if exact:  # sketches are whole sets, and so are those of any partner
        k = math.ceil((sig.agg(F.max("n_shingles")).first()[0] or 1) / t) + 1
    named = materialise(sig.select("doc_id", "n_shingles", "set_key"), "named")
    classes = materialise(named.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("cls")), "classes")
    # a class has the sketch of the document that it is named after
    reps = sig.join(dealt(classes.withColumnRenamed("cls", "doc_id")), ["set_key", "doc_id"]).select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("size"), "sketch")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        reps = reps.dropDuplicates()
    reps = materialise(reps, "reps")
    discard(sig)

    # inverted lists of the values a sketch must be found by: the rarest, of which those of one class need no list
    total, retained = reps.agg(F.count("*"), F.coalesce(F.sum(F.least("size", F.lit(k))), F.lit(0))).first()
    buckets = max(8, -(-retained // RANGE))
    hot = hot_values(reps, max(2, math.ceil(HOT_SHARE * retained / buckets)), total)
    values = postings(reps, buckets, k, t, hot).groupBy("bucket").applyInPandas(shared_values, "cls long, size long, prefix long, df long, v long")
    if len(hot):
        values = values.unionByName(hot_entries(reps, k, t, hot, total))
    found = values.groupBy("cls", "size", "prefix").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    single = F.least("size", F.lit(k)) - F.size("vs")
    room = F.col("prefix") - single
    band = F.floor(F.log("size") / math.log(1 / t)).cast("int")
    found = found.where(room > 0).select("cls", "size", single.alias("single"), band.alias("band"), F.posexplode(F.slice("vs", 1, room.cast("int"))).alias("n", "x"))
    # ahead: the sketch's values from this one on in the order of rarity, an upper bound of what a pair shares
    # that shares none before it
    ahead = F.least("size", F.lit(k)) - F.col("single") - F.col("n")
    # own: matches at its own size may still be met from here on; above that only by partners that are sketched
    found = found.select("cls", "size", "single", ahead.alias("ahead"), "band", "x.v")
    own = (F.col("ahead") >= needed(F.col("size"), F.col("size"), k, t)) | (F.col("size") > F.lit(k * t))
    lists = materialise(found.withColumns({"own": own, "salt": F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(SALT)).cast("int")}), "lists")

    size_ok = F.least("size", "size_b") * 100 >= F.greatest("size", "size_b") * percent
    size_ok = size_ok & (F.least("ahead", "ahead_b") >= needed(F.col("size"), F.col("size_b"), k, t))
    sk = None if exact else materialise(short_sketches(reps), "short")
    discard(reps)
    comps, edges, tried, linked = None, None, None, 0
    scratch = [lists] if exact else [lists, sk]

    def candidates(kind: str) -> DataFrame:
        rows = lists if comps is None else lists.join(dealt(comps, linked), lists.cls == comps.id, "left").select("cls", "size", "single", "ahead", "band", "v", "own", "salt", F.coalesce("comp", "cls").alias("comp"))
        if comps is None:
            rows = rows.withColumn("comp", F.col("cls"))
        if kind == "rest":
            crowds = materialise(crowded(rows), "crowds")
            scratch.append(crowds)
            pairs = rest_pairs(rows.join(dealt(salted(crowds)), ["v", "salt"], "left_anti")).where(size_ok).select("cls", "cls_b")
            if not crowds.isEmpty():
                changed = differences(docs, rows.join(dealt(salted(crowds)), ["v", "salt"]), percent, n)
                scratch.append(changed)
                pairs = pairs.union(differing_alike(changed, percent))
        else:
            by = [F.col("single")] if kind == "first" else [F.xxhash64("cls", "v", F.lit(seed)) for seed in range(DRAWN)]
            leads = F.array(*(F.min_by(F.struct("cls", "size", "ahead", "comp"), F.struct(x, F.col("cls"))) for x in by))
            lead = rows.groupBy("v", "band").agg(leads.alias("ls"), F.count("*").alias("c")).where("c > 1").select("v", "band", F.explode(F.array_distinct("ls")).alias("l"))
            lead = lead.select("v", "band", F.col("l.cls").alias("cls_b"), F.col("l.size").alias("size_b"), F.col("l.ahead").alias("ahead_b"), F.col("l.comp").alias("comp_b"))
            pairs = rows.join(dealt(salted(lead)), ["v", "band", "salt"]).where((F.col("comp") != F.col("comp_b")) & size_ok)
        return pairs.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct()

    for kind in ("first", "drawn", "rest"):
        pairs = candidates(kind)
        if tried is not None:
            pairs = pairs.join(dealt(tried), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        scratch.append(pairs)
        if comps is not None and pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        links = verified(docs, pairs if exact else estimated(pairs, sk, t), percent, n)
        scratch.append(links)
        edges = links if edges is None else edges.union(links)
        if comps is not None and links.isEmpty():
            continue
        if comps is not None:
            scratch.append(comps)
        comps = components(edges)
        linked = comps.count()
    discard(*scratch)

    own = named.join(dealt(classes), "set_key").select("doc_id", "n_shingles", "cls")
    own = own.join(dealt(comps, linked), own.cls == comps.id, "left").select("doc_id", "n_shingles", F.coalesce("comp", "cls").alias("component_id"))
    rest = named.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    own = own.where("doc_id IS NOT NULL")
    return own.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def salted(keys: DataFrame) -> DataFrame:
    """What is known of a list, once for each part of its members."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def crowded(rows: DataFrame) -> DataFrame:
    """(v, main) of the lists with more than OUTSIDE members outside their largest component, main: the pairs of all
    others grow in proportion to their members."""
    parts = rows.groupBy("v", "comp").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    lists = parts.groupBy("v").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("out"), F.sum("own").alias("own"))
    return lists.where(F.least("out", "own") > OUTSIDE).select("v", "main")


def differences(docs: DataFrame, rows: DataFrame, percent: int, n: int) -> DataFrame:
    """What the members of crowded lists (with main) differ in from the anchor of their list's largest component, its member with
    the fewest values of its own: anchor, frame (the anchor's set), cls, comp, size, d (number of shingles that only one
    of the two has), es (these), linked (the member is outside the component and meets the threshold with the anchor)."""
    anchors = rows.where("comp = main").groupBy("main").agg(F.min_by("cls", F.struct("single", "cls")).alias("anchor"))
    members = materialise(rows.select("main", "cls", "comp", "salt").distinct().join(dealt(anchors), "main"), "members")
    ids = members.select(F.col("cls").alias("doc_id")).distinct()
    sets = materialise(full_sets(docs, ids, n).join(dealt(ids), "doc_id", "left_semi"), "sets")
    frames = members.select(F.col("anchor").alias("doc_id")).distinct().join(dealt(sets), "doc_id").select(F.col("doc_id").alias("anchor"), F.col("full").alias("frame"))

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, COUNTED):
                b = whole.slice(first, COUNTED)
                pairs = [(unpack_sorted(x), unpack_sorted(a)) for x, a in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
                es = [np.setxor1d(x, a, assume_unique=True).view(np.int64) for x, a in pairs]
                d, size, both = (np.array(x, np.int64) for x in (list(map(len, es)), [len(x) for x, _ in pairs], [len(x) + len(a) for x, a in pairs]))
                linked = (d * (100 + percent) <= both * (100 - percent)) & (np.asarray(b.column(2)) != np.asarray(b.column(3)))
                frame = [xxhash.xxh3_64_intdigest(a) - (1 << 63) for a in b.column(5).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *d]).astype(np.int32)), pa.array(np.concatenate(es)))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(frame, pa.int64()), b.column(0), b.column(2), pa.array(size), pa.array(d), lists, pa.array(linked)], ["anchor", "frame", "cls", "comp", "size", "d", "es", "linked"])

    both = members.join(dealt(sets.select(F.col("doc_id").alias("cls"), "full")), "cls").join(dealt(salted(frames)), ["anchor", "salt"])
    schema = "anchor long, frame long, cls long, comp long, size long, d long, es array<long>, linked boolean"
    out = materialise(both.select("cls", "anchor", "comp", "main", "full", "frame").mapInArrow(run, schema), "changes")
    discard(members, sets)
    return out


def differing_alike(changed: DataFrame, percent: int) -> DataFrame:
    """(cls, cls_b): members linked to their anchor, and pairs of members of different components whose differences may
    share as much as a link needs. A link of sets of a and b shingles allows them to differ in a share of a + b, at most
    in size * (100 - percent) / percent where one of them is known; of the rest of a member's difference its partner has all."""
    most = F.floor(F.col("size") * (100 - percent) / percent + 1e-9).cast("long")
    who = ["anchor", "frame", "cls", "comp", "size", "d"]
    # rows of one id may differ in their text: their differences are told apart
    rows = changed.where("d > 0").select(*who, F.xxhash64("es").alias("text"), F.explode("es").alias("e"))
    rows = rows.withColumns({"v": F.xxhash64("anchor", "frame", "e"), "salt": F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(SALT)).cast("int")})
    several = rows.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(dealt(salted(several)), ["v", "salt"]).groupBy(*who, "text").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    single = F.col("d") - F.size("vs")
    room = F.least(F.col("d"), most + 1) - single
    rows = rows.where(room > 0).select("cls", "comp", "size", "d", single.alias("single"), F.posexplode(F.slice("vs", 1, room.cast("int"))).alias("n", "x"))
    rows = rows.select("cls", "comp", "size", "d", F.lit(True).alias("own"), (F.col("d") - F.col("single") - F.col("n")).alias("ahead"), "x.v")
    size_ok = F.least("size", "size_b") * 100 >= F.greatest("size", "size_b") * percent
    allowed = F.floor((F.col("size") + F.col("size_b")) * (100 - percent) / (100 + percent) + 1e-9)
    alike = rest_pairs(materialise(rows, "changed-lists"), ("d",)).where(size_ok & (2 * F.least("ahead", "ahead_b") >= F.col("d") + F.col("d_b") - allowed))
    return changed.where("linked").select("cls", F.col("anchor").alias("cls_b")).union(alike.select("cls", "cls_b"))


def rest_pairs(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a list's members of different components, each from its smaller member, which must be ``own``. At least
    one of the two is outside the list's largest component, so members of that are only compared with the others.
    ``more``: further columns of both members to keep."""
    most = rows.groupBy("v", "comp").agg(F.count("*").alias("n")).groupBy("v").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("c"), F.sum("n").alias("n"))
    most = most.where("c > 1").select("v", "main", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(SALT)).cast("int"))
    rows = rows.join(dealt(salted(most)), ["v", "salt"]).withColumn("out", F.col("comp") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    theirs = rows.select("v", "part", *(F.col(c).alias(f"{c}_b") for c in ("cls", "size", "ahead", "comp", "out", *more)))
    mine = rows.where("own").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("cls") != F.col("cls_b")))
    differ = order & (F.col("comp") != F.col("comp_b"))
    outside = mine.where("out").join(dealt(theirs), ["v", "part"]).where(differ)
    return outside.unionByName(mine.where("NOT out").join(dealt(theirs.where("out_b")), ["v", "part"]).where(differ))


def estimated(pairs: DataFrame, sk: DataFrame, t: float) -> DataFrame:
    """Pairs whose union sketch does not rule the threshold out; exact where both sketches are whole sets."""
    a = sk.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sa"))
    b = sk.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sb"))
    both = pairs.join(dealt(a), "a").join(dealt(b), "b").withColumn("common", F.array_intersect("sa", "sb")).withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SHORT))
    whole = (F.col("size_a") <= SHORT) & (F.col("size_b") <= SHORT)
    exact = F.size("common") >= t * (F.col("size_a") + F.col("size_b") - F.size("common")) - 1e-6
    likely = F.size(F.array_intersect("common", "u")) >= least_shared(SHORT, t) / SHORT * F.size("u")
    return both.where(F.when(whole, exact).otherwise(likely)).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs that meet the threshold on their full sets, as a written table."""
    pairs = materialise(pairs, "likely")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialise(full_sets(docs, ids, n).join(dealt(ids), "doc_id", "left_semi"), "sets")

    def run(batches):
        for x in batches:
            keep = []
            for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist()):
                a, b = unpack_sorted(a), unpack_sorted(b)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(dealt(sets.select(F.col("doc_id").alias("a"), F.col("full").alias("fa"))), "a").join(dealt(sets.select(F.col("doc_id").alias("b"), F.col("full").alias("fb"))), "b")
    links = materialise(rows.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long"), "links")
    discard(sets, pairs)
    return links


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85)
