"""License notices in texts: an exact set-similarity join of text blocks with notice templates.

A block is a line of a text, or a piece of BLOCK words of a longer line (pieces overlap by half). As notices are
often hard-wrapped, pieces of the whole word sequence that cross a line break are blocks too. Longer templates, whole
notices say, are looked for in blocks of their own length class. A block contains a
template if it holds at least CONTAINMENT of the template's distinct words. Template words are ordered from rare
to frequent by how many blocks of the corpus hold them. A block that contains a template holds one of the first
``size - needed + 1`` of its words in that order (prefix filter), has at least ``needed`` distinct template words
(length filter), and the words it can still share from that place on must suffice (positional filter); what
passes is compared on the whole sets. So the join sends on only blocks with a rare template word.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_bytes

CONTAINMENT = 0.8
#: Words of a block; templates of more than half of it get blocks of their own, twice as long as they are.
BLOCK = 64
#: Phrases that the contract counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings of well-known public notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
    ("reserved", "Copyright. All rights reserved"),
)
#: Bytes that are no word character become blanks; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def vocabulary(texts) -> dict[bytes, int]:
    """Numbers from 1 of the words of templates and phrases: a few hundred, whatever the corpus."""
    return {w: i for i, w in enumerate(sorted({w for t in texts for w in words_of(t.encode())}), 1)}


def block_of(n_words: int) -> int:
    """The length of the blocks in which a template of so many words is looked for: BLOCK, or doubled until it is at
    least twice as long as the template, so that with half overlap some block holds any stretch of that length."""
    size = BLOCK
    while size < 2 * n_words:
        size *= 2
    return size


def pieces(n: int, size: int = BLOCK) -> range:
    """First words of the pieces of n words."""
    return range(0, max(1, n - size // 2), size // 2) if n > size else range(min(n, 1))


def text_blocks(text: bytes, sizes=(BLOCK,)):
    """(size, first word, words, whether it crosses a line break) of each block of a text, for each of the sizes: those
    of its lines, then those of the whole text that are in no single line."""
    all_words, starts, lines = [], [], []
    for line in text.split(b"\n"):
        if words := words_of(line):
            starts.append(len(all_words))
            lines.append(words)
            all_words += words
    for size in sizes:
        for at, words in zip(starts, lines):
            for i in pieces(len(words), size):
                yield size, at + i, words[i : i + size], False
        for i in pieces(len(all_words), size):
            k = bisect_right(starts, i)
            if k < len(starts) and starts[k] < i + size:
                yield size, i, all_words[i : i + size], True


def block_frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> dict[int, int]:
    """In how many blocks of the corpus each template word stands."""

    def run(batches):
        total = np.zeros(len(vocab) + 1, np.int64)
        for b in batches:
            for text in text_bytes(b.column(0)):
                for _, _, words, _ in text_blocks(text):
                    hit = set(map(vocab.get, words, repeat(0)))
                    total[list(hit)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word int, n long")
    return {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scanned(docs: DataFrame, vocab: dict[bytes, int], phrases, prefixes: set[int], least: dict[int, int]) -> DataFrame:
    """docs' doc_id with n_words, phrase places (structs of start and phrase number) and the blocks that pass the
    prefix and length filters (structs of size, first word, distinct template words and whether the block crosses a line
    break). ``least``: for each size of blocks the fewest distinct template words that a template needs."""
    codes = [np.array([vocab[w] for w in words_of(p.encode())]) for p in phrases]

    def run(batches):
        for b in batches:
            n_words, places, kept = [], [], []
            for text in text_bytes(b.column(1)):
                c = np.fromiter(map(vocab.get, words_of(text), repeat(0)), np.int64)
                n_words.append(len(c))
                found = []
                for k, p in enumerate(codes):
                    on = np.flatnonzero(c[: max(0, len(c) - len(p) + 1)] == p[0])
                    for j in range(1, len(p)):
                        on = on[c[on + j] == p[j]]
                    found += [{"start": s, "phrase": k} for s in on.tolist()]
                places.append(found)
                blocks = []
                if prefixes.intersection(c.tolist()):
                    for size, at, words, crosses in text_blocks(text, tuple(least)):
                        hit = set(map(vocab.get, words, repeat(0))) - {0}
                        if len(hit) >= least[size] and hit & prefixes:
                            blocks.append({"size": size, "first": at, "words": sorted(hit), "crosses": crosses})
                kept.append(blocks)
            place, block = pa.struct([("start", pa.int64()), ("phrase", pa.int32())]), pa.struct([("size", pa.int32()), ("first", pa.int64()), ("words", pa.list_(pa.int32())), ("crosses", pa.bool_())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(place)), pa.array(kept, pa.list_(block))], ["doc_id", "n_words", "places", "blocks"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, places array<struct<start:long,phrase:int>>, blocks array<struct<size:int,first:long,words:array<int>,crosses:boolean>>")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_words, places
    (start and label of every phrase), matches (label, first word of the block, containment: of the blocks inside a
    line the best of each template met), wrapped (the same of the blocks that cross a line break), base_labels and
    labels (arrays, sorted; labels are of phrases, matches and wrapped), score.

    score: 1 with a phrase, else the highest containment met, else 0. A null or empty text has no words and no
    labels. Texts of any length are scanned whole, in overlapping blocks. Repeated rows are rows like others, null ids
    too. An empty table gives an empty result.
    """
    labels = list(phrases.values())
    vocab = vocabulary([*phrases, *(t for _, t in templates)])
    often = block_frequencies(docs, vocab)
    sets = []
    for number, (label, text) in enumerate(templates):
        words = sorted({vocab[w] for w in words_of(text.encode())}, key=lambda w: (often.get(w, 0), w))
        needed = math.ceil(containment * len(words) - 1e-9)
        sets.append((number, label, words, needed, words[: len(words) - needed + 1], block_of(len(words_of(text.encode())))))
    prefixes = {w for *_, prefix, _ in sets for w in prefix}
    least = {size: min(s[3] for s in sets if s[5] == size) for size in sorted({s[5] for s in sets})}
    rows = materialise(scanned(docs, vocab, phrases, prefixes, least).withColumn("row", F.monotonically_increasing_id()), "blocks")

    # one row for each template and prefix word: a few hundred, broadcast
    index = docs.sparkSession.createDataFrame([(w, size, n, label, words, needed, at) for n, label, words, needed, prefix, size in sets for at, w in enumerate(prefix)], "word int, size int, template int, label string, t_words array<int>, needed int, at int")
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.first", "b.words", "b.crosses", F.explode("b.words").alias("word"))
    pairs = blocks.join(F.broadcast(index), ["word", "size"])
    # at a template's at-th word the block can share at most what is left of the template
    pairs = pairs.where((F.size("words") >= F.col("needed")) & (F.size("t_words") - F.col("at") >= F.col("needed")))
    pairs = pairs.withColumn("both", F.size(F.array_intersect("words", "t_words"))).where(F.col("both") >= F.col("needed"))
    met = pairs.groupBy("row", "template", "label", "crosses").agg(F.max_by(F.struct(F.col("first"), (F.col("both") / F.size("t_words")).alias("share")), F.struct("both", -F.col("first"))).alias("best"))
    one = F.struct("label", F.col("best.first").alias("first"), F.col("best.share").alias("containment"))
    met = met.groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(on, one))).alias(c) for c, on in (("matches", ~F.col("crosses")), ("wrapped", F.col("crosses")))))

    name = F.array(*map(F.lit, labels))
    places = F.array_sort(F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.get(name, p["phrase"]).alias("label"))))
    none = F.array().cast("array<struct<label:string,first:long,containment:double>>")
    out = rows.drop("blocks").join(met, "row", "left").select("doc_id", "n_words", places.alias("places"), F.coalesce("matches", none).alias("matches"), F.coalesce("wrapped", none).alias("wrapped"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(F.transform("places", lambda p: p["label"]), F.transform(F.concat("matches", "wrapped"), lambda m: m["label"])))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(F.concat("matches", "wrapped"), lambda m: m["containment"])), F.lit(0.0)))
    return out.withColumns({"base_labels": base, "labels": both, "score": score})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
