"""Language-model scores of whole texts: a Katz back-off model of word triples over pairs over single words.

Counts of each order are Good-Turing discounted up to R_MAX; what a context leaves over goes to its unseen
continuations in proportion to the lower order, by a weight that makes the context sum to exactly one. What the
single words leave over is the probability of one unknown word.

    P(w | h) = d(c(h, w)) c(h, w) / (c(h) + RESERVE)     if the n-gram was seen
             = alpha(h) P(w | h')                         if only the context was seen
             = P(w | h')                                  otherwise;   h': h without its first word
    alpha(h) = (1 - sum over seen w of P(w | h)) / (1 - sum over seen w of P(w | h'))
    P(w)     = d(c(w)) c(w) / (N + RESERVE),  or 1 - sum of these for an unknown word

A text is preceded by one end token; its first token is scored by the pair with that, as nothing stands before it.

Katz discounts only counts up to R_MAX, so a context whose counts are all larger has nothing left for unseen words, and
a text with one would have probability zero. RESERVE, a hundredth of a count, is added to every context's total for
them: it changes a seen n-gram by less than c / (c + 0.01), and each context still sums to exactly one.

How it runs: documents are packed in chunks that hold their words as codes of a local dictionary. Each chunk asks
for the corpus counts of its own distinct n-grams, once each, however often they occur, so no n-gram is hot; the
askers of a key range meet in one group, which adds up the counts and answers; where the ranges are many, askers are
merged on their way to them (:mod:`tidemark.llm.ranges`). The answers are the count tables,
partitioned by order and key range and, within it, by chunk. Words and pairs are asked for first. A triple of which
one pair stands in no other chunk occurs in no other either, and one of which a pair is never learnt from has no
count, so these counts are known; the rest is asked for.

Only n-grams in texts that are not learnt from can be unseen. The chunk that owns a seen n-gram reports it for the
sums of its context if such a text has that context; the weights are exact, as these sums are whole numbers: how many
continuations have each count up to R_MAX, at this order and the next lower one, and the total of the larger counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, fold, materialise, mix, pack, pack_sorted, shuffle_buckets, slices, text_bytes, unpack, unpack_sorted
from tidemark.llm.ranges import Route, exchange, returned

R_MAX = 5
RESERVE = 0.01
CHUNK = 6 << 20
#: Bytes of text for each key range.
RANGE = 4 << 20
END = b"\n"


def packed(docs: DataFrame, learn: Column, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunks of documents: ids, learn flags, token counts, token codes, and the key of each code's word.

    Code 0 is the end token, which also stands before a text's first word."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0

        def row():
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            arrays = [[part * 1_000_000 + seq], [ids], [flags], [[len(c) for c in codes]], [pack(np.concatenate(codes))], [pack(keys)]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], ["chunk", "doc_id", "learn", "n_tokens", "codes", "keys"])

        def fresh():
            v = defaultdict()
            v.default_factory = v.__len__
            v[END]
            return v, [], [], [], 0

        vocab, ids, flags, codes, held = fresh()
        for b in batches:
            for i, text, flag in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                words = text.lower().split()
                words.append(END)
                ids.append(i)
                flags.append(flag)
                codes.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                held += len(text) + 64
                if held >= chunk_bytes:
                    yield row()
                    seq += 1
                    vocab, ids, flags, codes, held = fresh()
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), learn.alias("learn"))
    return rows.mapInArrow(run, "chunk long, doc_id array<long>, learn array<boolean>, n_tokens array<int>, codes binary, keys binary")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def pairs_of(codes: np.ndarray, keys: np.ndarray):
    """Each token's pair with the token before it, as a number; the words of each number; its key."""
    before = np.concatenate([codes[:1] * 0, codes[:-1]]).astype(np.int64)
    pairs, number = np.unique(before * len(keys) + codes, return_inverse=True)
    h, w = pairs // len(keys), pairs % len(keys)
    return number, h, w, joined(keys[h], keys[w])


def ask_rows(order: int, chunk: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    up = np.argsort(keys, kind="stable")
    keys, n = keys[up], n.astype(np.uint32)[up]
    return [(order, bucket, chunk, pack_sorted(keys[i:j]), pack(n[i:j])) for bucket, i, j in slices(keys, buckets)]


def asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk, order (1, 2) and key range: the chunk's distinct n-grams and, in ``n``, twice their count in
    what is learnt from, plus one where the n-gram stands in another text."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes, keys = unpack(r["codes"], np.int32), unpack(r["keys"], np.uint64)
                learn = np.repeat(r["learn"], r["n_tokens"]).astype(bool)
                number, _, _, pair_keys = pairs_of(codes, keys)
                for order, (at, k) in enumerate(((codes, keys), (number, pair_keys)), 1):
                    n = 2 * np.bincount(at[learn], minlength=len(k)) + (np.bincount(at[~learn], minlength=len(k)) > 0)
                    out = ask_rows(order, r["chunk"], k, n, buckets)
                    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["ord", "bucket", "chunk", "keys", "n"])

    return chunks.mapInArrow(run, "ord int, bucket int, chunk long, keys binary, n binary")


def histogram(counts: np.ndarray) -> list[int]:
    """How many of ``counts`` are 1, 2, .. R_MAX + 1."""
    return np.bincount(np.minimum(counts, R_MAX + 2), minlength=R_MAX + 3)[1 : R_MAX + 2].tolist()


ANSWERS = "ord int, bucket int, chunk long, totals binary, flags binary, counts array<long>, tokens long, types long"


TOLD = "ord int, bucket int, chunk long, totals binary, flags binary"
RELAYED = "ord int, bucket int, grp int, chunk long, keys binary, n binary, kids array<long>, places array<binary>"


def merged(pdf: pd.DataFrame, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The distinct keys of some rows, their counts, whether a text that is not learnt from has them; for each row, the
    places of its keys among them, and which of these no row before it has."""
    keys = [unpack_sorted(x) for x in pdf["keys"]]
    n = np.concatenate([unpack(x, dtype) for x in pdf["n"]])
    distinct, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    new, ends = np.zeros(len(number), np.uint8), np.cumsum([len(k) for k in keys])[:-1]
    new[first] = 1
    return distinct, np.bincount(number, n >> dtype(1)).astype(np.int64), np.bincount(number, n & dtype(1)) > 0, np.split(number, ends), np.split(new, ends)


def answered(route: Route):
    """The function that tells each asker of one key range its corpus counts; flags: 1 where the asker owns the n-gram, 2
    where a text that is not learnt from has it; and, in one row without chunk, how many n-grams have each count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        _, total, held, places, new = merged(pdf, np.uint32 if route.hops == 1 else np.uint64)
        order, bucket, held = pdf["ord"].iloc[0], pdf["bucket"].iloc[0], (held * 2).astype(np.uint8)
        out = [(order, bucket, c, pack(total[at]), pack(held[at] + own), None, None, None) for c, at, own in zip(pdf["chunk"], places, new)]
        out.append((order, bucket, None, None, None, histogram(total), int(total.sum()), int((total > 0).sum())))
        out = pd.DataFrame(out, columns=["ord", "bucket", "chunk", "totals", "flags", "counts", "tokens", "types"])
        return out.astype({"chunk": "Int64", "tokens": "Int64", "types": "Int64"})

    return run


def relayed(route: Route):
    """For each hop, the function that adds up what one group asks for and asks for it, once each."""

    def at(hop: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            order, bucket, group = (int(pdf[c].iloc[0]) for c in ("ord", "bucket", "grp"))
            keys, total, held, places, new = merged(pdf, np.uint32 if hop == 1 else np.uint64)
            sender, n = route.sender(hop, bucket, group), (2 * total + held).astype(np.uint64)
            out = [(order, b, group % route.groups(hop + 1), sender, pack_sorted(keys[i:j]), pack(n[i:j]), None, None) for b, i, j in slices(keys, route.ranges(hop + 1))]
            out.append((order, bucket, group, sender, None, None, pdf["chunk"].tolist(), [pack((2 * x + own).astype(np.uint32)) for x, own in zip(places, new)]))
            return pd.DataFrame(out, columns=[f.split()[0] for f in RELAYED.split(", ")])

        return run

    return at


def given(_: int):
    """The function that tells each asker of a group its counts; of those who have an n-gram, the first may own it."""

    def run(_, kept: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r, told, out = kept.iloc[0], told.sort_values("bucket"), []
        totals = np.concatenate([unpack(b, np.int64) for b in told["totals"]])
        flags = np.concatenate([unpack(b, np.uint8) for b in told["flags"]])
        for kid, place in zip(r["kids"], r["places"]):
            at = unpack(place, np.uint32)
            out.append((r["ord"], r["bucket"], kid, pack(totals[at >> 1]), pack(flags[at >> 1] & (2 + (at & 1)).astype(np.uint8))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in TOLD.split(", ")])

    return run


def corpus_counts(asks: DataFrame, route: Route, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The answers of all key ranges, what each chunk is told, and the tables behind both."""
    asks, kept = exchange(asks, route, name, relayed(route), RELAYED, ("ord",))
    answers = materialise(asks.groupBy("ord", "bucket").applyInPandas(answered(route), ANSWERS), name, drop_shuffles=True)
    told = returned(answers.where("chunk IS NOT NULL").select("ord", "bucket", "chunk", "totals", "flags"), kept, given, TOLD, ("ord",))
    if kept:
        told = materialise(told, f"{name}-told", drop_shuffles=True)
    return answers, told, [answers, *kept, *([told] if kept else [])]


def discounts(counts: list[int]) -> np.ndarray:
    """Factors for the counts 0..R_MAX; ``counts``: how many n-grams have the counts 1..R_MAX+1. Where the
    Good-Turing estimate is no discount (no or unevenly falling counts), half a count is taken instead."""
    n = [0, *counts]
    d = np.ones(R_MAX + 1)
    common = (R_MAX + 1) * n[R_MAX + 1] / n[1] if n[1] else 1
    for r in range(1, R_MAX + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, R_MAX + 1) % (R_MAX + 1)] * c


class Chunk:
    """A chunk's tokens and its distinct words, pairs and triples with what is known about their counts."""

    def __init__(self, chunk: pd.DataFrame, told: pd.DataFrame):
        r = chunk.iloc[0]
        self.id, self.doc_id, self.learn = int(r["chunk"]), list(r["doc_id"]), np.asarray(r["learn"], bool)
        self.sizes = np.asarray(r["n_tokens"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.codes, self.keys = unpack(r["codes"], np.int32), unpack(r["keys"], np.uint64)
        self.pair, self.h, self.w, self.pair_keys = pairs_of(self.codes, self.keys)
        self.told = told.sort_values(["ord", "bucket"])
        self.c, self.word_flags = self.answers(1, np.argsort(self.keys, kind="stable"), len(self.keys))
        self.cc, self.pair_flags = self.answers(2, np.argsort(self.pair_keys, kind="stable"), len(self.h))
        inner = np.ones(len(self.codes), bool)
        inner[self.first] = False
        #: Tokens that end a triple within their text; each one's triple; first and last pair of each triple.
        self.at = np.flatnonzero(inner)
        triples, self.triple = np.unique(self.pair[self.at - 1] * len(self.h) + self.pair[self.at], return_inverse=True)
        self.hh, self.ww = triples // len(self.h), triples % len(self.h)
        learnt = np.repeat(self.learn, self.sizes)
        self.ccc = np.bincount(self.triple[learnt[self.at]], minlength=len(triples))
        elsewhere = (self.cc > np.bincount(self.pair[learnt], minlength=len(self.h))) | ((self.cc > 0) & (self.pair_flags & 2 > 0))
        self.asked = np.flatnonzero(elsewhere[self.hh] & elsewhere[self.ww])
        self.asked_keys = joined(self.pair_keys[self.hh[self.asked]], self.pair_keys[self.ww[self.asked]])

    def answers(self, order: int, up: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and flags of ``n`` n-grams, of which those at ``up`` were asked for in this sequence."""
        out, told = [], self.told[self.told["ord"] == order]
        for column, dtype in (("totals", np.int64), ("flags", np.uint8)):
            x = np.zeros(n, dtype)
            if len(up):
                x[up] = np.concatenate([unpack(b, dtype) for b in told[column]])
            out.append(x)
        return out[0], out[1]


def asked_triples(buckets: int):
    """The function by which a chunk asks for its triples; those it knows the counts of are in one row without keys."""

    def run(_, chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        x = Chunk(chunk, told)
        rows = [(*r, None) for r in ask_rows(3, x.id, x.asked_keys, 2 * x.ccc[x.asked], buckets)]
        rows.append((3, None, x.id, None, None, histogram(np.delete(x.ccc, x.asked))))
        return pd.DataFrame(rows, columns=["ord", "bucket", "chunk", "keys", "n", "counts"]).astype({"bucket": "Int32"})

    return run


def reported(order: int, context: np.ndarray, upper: np.ndarray, lower: np.ndarray, keys: np.ndarray, buckets: int) -> list[dict]:
    """Sums over seen n-grams by context: how many have each count at their order and at the next lower one, and
    the total of the lower order's larger counts."""
    on, place = np.unique(context, return_inverse=True)
    k = keys[on]
    up = np.argsort(k, kind="stable")
    k = k[up]
    small = np.stack([np.bincount(place, x == r, len(on)) for x in (upper, lower) for r in range(1, R_MAX + 1)]).astype(np.uint32)[:, up]
    large = np.bincount(place, lower * (lower > R_MAX), len(on)).astype(np.int64)[up]
    return [{"kind": 1, "ord": order, "bucket": b, "keys": pack_sorted(k[i:j]), "x": pack(small[:, i:j].ravel()), "y": pack(large[i:j])} for b, i, j in slices(k, buckets)]


def wanted(order: int, doc: np.ndarray, context: np.ndarray, c: np.ndarray, lower: np.ndarray, keys: np.ndarray, buckets: int) -> list[dict]:
    """Weights that documents need: their contexts, how often, and the totals of the context and of the shorter one."""
    at, n = np.unique(doc * len(keys) + context, return_counts=True)
    k = keys[at % len(keys)]
    up = np.argsort(k, kind="stable")
    k, at, n = k[up], at[up], n[up].astype(np.uint32)
    doc, on = (at // len(keys)).astype(np.uint32), at % len(keys)
    return [
        {"kind": 2, "ord": order, "bucket": b, "keys": pack_sorted(k[i:j]), "x": pack(doc[i:j]), "y": pack(n[i:j]), "c": pack(c[on[i:j]]), "lower": pack(lower[on[i:j]])}
        for b, i, j in slices(k, buckets)
    ]


PARTS = "kind int, uid long, doc_id long, held boolean, n_tokens long, n_known long, base double, part double, ord int, bucket int, chunk long, keys binary, x binary, y binary, c binary, lower binary"


def scored(stats: dict, d: dict, buckets: int):
    """The function that scores a chunk from its own row and its answers, as far as no weight is needed (kind 0),
    reports the sums of contexts (1) and says which weights are needed (2)."""
    one = stats[1]
    N, V = one["tokens"], one["types"]
    left = (RESERVE + sum((1 - d[1][r]) * r * n for r, n in enumerate(one["counts"][:R_MAX], 1))) / (N + RESERVE)

    def run(_, chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        x = Chunk(chunk, told)
        own = x.ccc > 0
        up = x.asked[np.argsort(x.asked_keys, kind="stable")]
        totals, flags = x.answers(3, up, len(own))
        x.ccc[x.asked], own[x.asked] = totals[x.asked], (flags[x.asked] & 1) > 0
        own &= x.ccc > 0
        with np.errstate(divide="ignore"):
            p1 = np.where(x.c > 0, discounted(x.c, d[1]) / (N + RESERVE), left)
            pairs = np.log10(np.where(x.cc > 0, discounted(x.cc, d[2]) / (x.c[x.h] + RESERVE), p1[x.w]))
            triples = np.where(x.ccc > 0, np.log10(discounted(x.ccc, d[3]) / (x.cc[x.hh] + RESERVE)), pairs[x.ww])
        tokens = pairs[x.pair]
        tokens[x.at] = triples[x.triple]
        per_doc = lambda v: np.add.reduceat(v, x.first)
        docs = pd.DataFrame({"kind": 0, "uid": np.int64(x.id) * 1_000_000 + np.arange(len(x.sizes)), "doc_id": pd.array(x.doc_id, "Int64"), "held": ~x.learn, "n_tokens": x.sizes,
                             "n_known": per_doc((x.c > 0)[x.codes].astype(np.int64)), "base": per_doc(np.log10((x.c + 0.5) / (N + 0.5 * (V + 1)))[x.codes]), "part": per_doc(tokens)})
        mine = (x.cc > 0) & (x.pair_flags & 1 > 0) & (x.word_flags[x.h] & 2 > 0)
        rows = reported(2, x.h[mine], x.cc[mine], x.c[x.w[mine]], x.keys, buckets)
        mine = own & (x.pair_flags[x.hh] & 2 > 0)
        rows += reported(3, x.hh[mine], x.ccc[mine], x.cc[x.ww[mine]], x.pair_keys, buckets)
        at = np.flatnonzero(((x.cc == 0) & (x.c[x.h] > 0))[x.pair])
        rows += wanted(2, x.doc[at], x.h[x.pair[at]], x.c, np.full(len(x.c), N), x.keys, buckets)
        on = np.flatnonzero(((x.ccc == 0) & (x.cc[x.hh] > 0))[x.triple])
        rows += wanted(3, x.doc[x.at[on]], x.hh[x.triple[on]], x.cc, x.c[x.w], x.pair_keys, buckets)
        blobs = pd.DataFrame(rows, columns=["kind", "ord", "bucket", "keys", "x", "y", "c", "lower"]).assign(chunk=x.id)
        out = pd.concat([docs, blobs]).reindex(columns=[f.split()[0] for f in PARTS.split(", ")])
        return out.astype({f: "Int64" for f in ("uid", "n_tokens", "n_known", "ord", "bucket", "chunk")} | {"held": "boolean"})

    return run


WEIGHTS = "ord int, bucket int, chunk long, docs binary, back binary"
CONTEXTS = "kind int, ord int, bucket int, grp int, chunk long, keys binary, x binary, y binary, c binary, lower binary, kids array<long>, places array<binary>, docs array<binary>, times array<binary>"


def added(sums: pd.DataFrame, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of contexts from several rows: the distinct contexts, how many continuations have each count, and the totals
    of the larger counts."""
    on, place = np.unique(np.concatenate([unpack_sorted(k) for k in sums["keys"]]), return_inverse=True)
    small = np.concatenate([unpack(b, dtype).reshape(2 * R_MAX, -1) for b in sums["x"]], axis=1)
    small = np.stack([np.bincount(place, row, len(on)) for row in small])
    return on, small, np.bincount(place, np.concatenate([unpack(b, np.int64) for b in sums["y"]]), len(on))


def by_document(weights: np.ndarray, doc: bytes, n: bytes) -> tuple[bytes, bytes]:
    """Weights added up by the documents that need them, each as often as it does."""
    docs, number = np.unique(unpack(doc, np.uint32), return_inverse=True)
    return pack(docs), pack(np.bincount(number, unpack(n, np.uint32) * weights))


def weighed(d: dict, route: Route):
    """The function that adds up the contexts of one key range and gives each chunk's documents the weights that they
    need, as one packed row a chunk; or each group of chunks the weights that it asks for, where there are more hops."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order, bucket = pdf["ord"].iloc[0], pdf["bucket"].iloc[0]
        upper, lower = d[order][1:], d[order - 1][1:]
        sums, asks, out = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2], []
        if len(asks):
            on, small, large = added(sums, np.uint32 if route.hops == 1 else np.int64)
            r = np.arange(1, R_MAX + 1)
            kept, covered = RESERVE + ((1 - upper) * r) @ small[:R_MAX], (lower * r) @ small[R_MAX:] + large
        for chunk, keys, doc, n, c, low in zip(asks["chunk"], asks["keys"], asks["x"], asks["y"], asks["c"], asks["lower"]):
            k, c, low = np.searchsorted(on, unpack_sorted(keys)), unpack(c, np.int64) + RESERVE, unpack(low, np.int64) + RESERVE
            weights = np.log10(kept[k] / c / ((low - covered[k]) / low))
            out.append((order, bucket, chunk, *(by_document(weights, doc, n) if route.hops == 1 else (None, pack(weights)))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in WEIGHTS.split(", ")])

    return run


def relayed_contexts(route: Route):
    """For each hop, the function that adds up the sums of contexts that one group reports, and merges those of which it
    needs the weights."""

    def at(hop: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            order, bucket, group = (int(pdf[c].iloc[0]) for c in ("ord", "bucket", "grp"))
            sums, asks, rows, ranges = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2], [], route.ranges(hop + 1)
            to = {"grp": group % route.groups(hop + 1)}
            if len(sums):
                on, small, large = added(sums, np.uint32 if hop == 1 else np.int64)
                small, large = small.astype(np.int64), large.astype(np.int64)
                rows += [{"kind": 1, "bucket": b, **to, "keys": pack_sorted(on[i:j]), "x": pack(small[:, i:j].ravel()), "y": pack(large[i:j])} for b, i, j in slices(on, ranges)]
            if len(asks):
                keys = [unpack_sorted(k) for k in asks["keys"]]
                on, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                c, low = (np.concatenate([unpack(b, np.int64) for b in asks[name]])[first] for name in ("c", "lower"))
                rows += [{"kind": 2, "bucket": b, **to, "keys": pack_sorted(on[i:j]), "c": pack(c[i:j]), "lower": pack(low[i:j])} for b, i, j in slices(on, ranges)]
                places = [pack(x) for x in np.split(number.astype(np.uint32), np.cumsum([len(k) for k in keys])[:-1])]
                rows.append({"kind": 2, "bucket": bucket, "grp": group, "kids": asks["chunk"].tolist(), "places": places, "docs": asks["x"].tolist(), "times": asks["y"].tolist()})
            blank = dict.fromkeys(f.split()[0] for f in CONTEXTS.split(", "))
            return pd.DataFrame([blank | {"ord": order, "chunk": route.sender(hop, bucket, group)} | row for row in rows], columns=list(blank))

        return run

    return at


def given_contexts(_: int):
    """The function that gives each asker of a group its weights; a chunk's documents, theirs added up."""

    def run(_, kept: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r, out = kept.iloc[0], []
        weights = np.concatenate([unpack(b, np.float64) for b in told.sort_values("bucket")["back"]])
        for kid, place, doc, n in zip(r["kids"], r["places"], r["docs"], r["times"]):
            own = weights[unpack(place, np.uint32)]
            out.append((r["ord"], r["bucket"], kid, *((None, pack(own)) if doc is None else by_document(own, doc, n))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in WEIGHTS.split(", ")])

    return run


def backed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The weights of one chunk's documents from all key ranges, added up."""
    docs, number = np.unique(np.concatenate([unpack(b, np.uint32) for b in pdf["docs"]]), return_inverse=True)
    back = np.bincount(number, np.concatenate([unpack(b, np.float64) for b in pdf["back"]]))
    return pd.DataFrame({"uid": np.int64(pdf["chunk"].iloc[0]) * 1_000_000 + docs.astype(np.int64), "back": back})


def katz_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id, text; others are ignored), learning from the rows where
    ``learn`` holds: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is its end token alone. Repeated rows count as often as they occur. With nothing to
    learn from, every token is unknown with probability 1. Very long texts are scored whole (one makes a longer
    chunk). An empty table gives an empty result.
    """
    route = Route(shuffle_buckets(docs, "text", RANGE))
    chunks = materialise(packed(docs, F.coalesce(learn, F.lit(False))), "chunks")
    counted, told, tables = corpus_counts(asked(chunks, route.fan), route, "answers")
    asks = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(asked_triples(route.fan), "ord int, bucket int, chunk long, keys binary, n binary, counts array<long>")
    asks = materialise(asks, "triples", drop_shuffles=True)
    triples, told3, more = corpus_counts(asks.where("keys IS NOT NULL").drop("counts"), route, "triple_answers")
    rows = counted.union(triples).where("chunk IS NULL").select("ord", "counts", "tokens", "types").union(asks.where("keys IS NULL").select("ord", "counts", F.lit(0), F.lit(0)))
    totals = [F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(R_MAX + 1)]
    stats = {o: {"counts": [0] * (R_MAX + 1), "tokens": 0, "types": 0} for o in (1, 2, 3)}
    for r in rows.groupBy("ord").agg(*totals, F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect():  # three rows
        stats[r["ord"]] = {"counts": [r[f"n{i}"] for i in range(R_MAX + 1)], "tokens": r["tokens"], "types": r["types"]}
    d = {order: discounts(x["counts"]) for order, x in stats.items()}
    discard(asks)
    parts = materialise(chunks.groupBy("chunk").cogroup(told.union(told3).groupBy("chunk")).applyInPandas(scored(stats, d, route.fan), PARTS), "parts", drop_shuffles=True)
    discard(chunks, *tables, *more)
    contexts = parts.where("kind > 0").select("kind", "ord", "bucket", "chunk", "keys", "x", "y", "c", "lower")
    contexts, kept = exchange(contexts, route, "contexts", relayed_contexts(route), CONTEXTS, ("ord",))
    told = returned(contexts.groupBy("ord", "bucket").applyInPandas(weighed(d, route), WEIGHTS), kept, given_contexts, WEIGHTS, ("ord",))
    back = told.select("chunk", "docs", "back").groupBy("chunk").applyInPandas(backed, "uid long, back double")
    rows = parts.where("kind = 0").join(back, "uid", "left")
    return rows.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(stats[1]["tokens"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("part") + F.coalesce("back", F.lit(0.0))).alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return katz_scores(docs, ~fold("doc_id", 5, 1))
