"""Benchmark items in documents, also with other numbers, names or units put in.

Texts and items are brought to templates: numbers, names (capitalised words) and units (after a number) become typed
placeholders, other words are lower-cased; in scripts without blanks each character is a word. A capitalised word
that starts a sentence may be a name or not: it is a slot, but one that contradicts nothing.
Windows of WINDOW template words with enough literal ones (strong windows), and all windows as they stand, without
placeholders, are joined by hash; a shorter item is one window, and documents are cut into windows of these lengths
too. Matches open diagonals (place in the document minus place in the item). On a diagonal that a strong window has
opened, weak ones extend and bridge runs; on others only words that are equal as they stand count. The words of
the longest run, or of all runs on nearby diagonals where words were put in, left out or replaced, must cover enough of
the item, and the slots must be consistent: one value of the item always stands for one value of the document.
Slots that differ mark a re-parameterised question.

The item windows are few against the corpus; the scan of documents carries a bit table of fixed size made from
their hashes, so that only windows that may match are sent to the join. It grows with nothing, and lets
everything through in time if the items become many; the join decides.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, parts, text_bytes, window_hashes

WINDOW = 8
#: A copy covers this share of the item's template words, in one run or several near each other, or RUN of them.
COVER, RUN = 0.5, 25
#: Windows need so many words that are no placeholder.
LITERAL = 4
#: Items of fewer words say nothing: nearly every text holds them. They are reported by ``too_short``, not looked for.
FEWEST = 4
FILTER_BITS = 1 << 24
#: A hash has a bit for each of these shifts.
SHIFTS = (0, 32)
#: Seed of the hashes of windows as they stand, without placeholders.
PLAIN = 1 << 20
#: Diagonals so near belong together; a stretch of a document keeps so many words besides the item's length.
SLACK = 16
#: Runs of so many words or more are summed.
LEAST = 3
#: Words of stretches that one Arrow batch holds at most (a longer single text makes a longer batch).
PART_WORDS = 1 << 16

#: Unit words (after a number).
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    b"mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    b"s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    b"cent cents dollar dollars euro euros percent degrees mph kmh".split()
)
#: Words with the blanks and marks around them; a mark that ends a sentence is kept with its word.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+(?:[.,'][0-9A-Za-z\x80-\xff]+)*[.!?]?")
#: A character of a script without blanks: Thai, Lao, Burmese, Khmer, kana, Chinese.
UNSPACED = rb"(?:(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe3[\x81-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xef[\xa4-\xab]|\xf0[\xa0-\xb3][\x80-\xbf])[\x80-\xbf]|\xe3\x80[\x85-\x87])"
#: Marks of these scripts (CJK and full-width punctuation), which belong to no word.
MARK = rb"(?:\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5])"
#: TOKEN for texts that may hold such characters (SPECIAL: their first bytes).
SPECIAL = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
PART = rb"(?:[0-9A-Za-z\xc0-\xdf]|(?!%b|%b)[\xe0-\xff])(?:[0-9A-Za-z\x80-\xdf]+|(?!%b|%b)[\xe0-\xff])*" % (UNSPACED, MARK, UNSPACED, MARK)
MIXED = re.compile(rb"%b|%b(?:[.,']%b)*[.!?]?" % (UNSPACED, PART, PART))
NUMBER, NAME, UNIT = b"<number>", b"<name>", b"<unit>"
#: Kinds of words of a template; a doubtful slot may be a plain word at the start of a sentence.
LITERAL_WORD, SLOT, DOUBTFUL = 0, 1, 2


class Forms(dict):
    """token -> number, under which ``hash`` has the hash of its lower-case word and ``flags`` the sum of
    1: a number, 2: capitalised, 4: ends a sentence, 8: a unit."""

    def __init__(self, room: int = 1 << 17):
        self.room(room)

    def room(self, tokens: int) -> None:
        """Forget everything and make room for so many tokens."""
        self.clear()
        self.hash, self.flags = np.empty(tokens, np.uint64), np.empty(tokens, np.uint8)

    def __missing__(self, token: bytes) -> int:
        word = token.rstrip(b".!?")
        low = word.lower()
        capital = len(word) > 1 and word[:1].isupper() and not word[1:].isupper()
        k = self[token] = len(self)
        self.hash[k] = xxhash.xxh3_64_intdigest(low)
        self.flags[k] = word[:1].isdigit() | capital << 1 | (token != word) << 2 | (low in UNITS) << 3
        return k

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(tokens) > len(self.hash):
            self.room(max(len(self.hash), 2 * len(tokens)))
        k = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.hash[k], self.flags[k]


TYPED = [np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (NUMBER, NAME, UNIT)]


def template(text: bytes, forms: Forms):
    """(tokens, hash of each word in lower case, hash of each template word, its kind)."""
    tokens = (MIXED if SPECIAL.search(text) else TOKEN).findall(text)
    plain, flags = forms.of(tokens)
    h = plain.copy()
    number = (flags & 1).astype(bool)
    starts = np.ones(len(tokens), bool)
    starts[1:] = (flags[:-1] & 4) > 0
    name = ((flags & 2) > 0) & ~number
    unit = np.zeros(len(tokens), bool)
    unit[1:] = ((flags[1:] & 8) > 0) & number[:-1]
    for on, typed in zip((number, name, unit), TYPED):
        h[on] = typed
    kind = (number | name | unit).astype(np.int8)
    kind[name & starts & ~unit] = DOUBTFUL
    return tokens, plain, h, kind


class Text(NamedTuple):
    """Hashes of the words as they stand and as a template, their kinds and values."""

    plain: np.ndarray
    template: np.ndarray
    slot: np.ndarray
    value: list[str]

    @staticmethod
    def of(row: pa.StructScalar) -> Text:
        plain, h, slot = (row[c].values.to_numpy(zero_copy_only=False) for c in ("plain", "template", "slot"))
        return Text(plain, h, slot, row["value"].as_py())


def windows(h: np.ndarray, slot: np.ndarray, size: int):
    """(place, hash) of the windows of a template that have enough literal words."""
    if not 0 < size <= len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    literal = np.convolve(slot == LITERAL_WORD, np.ones(size, np.int64), "valid")
    on = np.flatnonzero(literal >= min(LITERAL, size))
    return on, window_hashes(h, size)[on]


def keys(plain: np.ndarray, h: np.ndarray, slot: np.ndarray, sizes):
    """(place, hash, strong) of the windows of a text: by template where they have enough literal words (strong),
    and all of them as they stand."""
    for size in sizes:
        on, w = windows(h, slot, size)
        yield on, w, True
        if 0 < size <= len(plain):
            yield np.arange(len(plain) - size + 1), window_hashes(plain, size, PLAIN), False


def value(token: bytes) -> str:
    return token.rstrip(b".!?").lower().decode("utf-8", "replace")


def lists(rows, kind) -> pa.Array:
    """A list array of numpy arrays."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *rows]).astype(kind)))


def cut_items(items: DataFrame, window: int) -> DataFrame:
    """id, plain, template (hashes of all words), slot, value (of all words), and at, hash, strong of the windows of
    ``window`` words; an item of fewer words is one window."""

    def run(batches):
        forms = Forms()
        for b in batches:
            out = [[] for _ in range(8)]
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                tokens, plain, h, slot = template(text, forms)
                found = [(a, x, y) for a, x, y in keys(plain, h, slot, [min(window, len(tokens))])]
                at = np.concatenate([np.empty(0, int), *(a for a, _, _ in found)])
                hashes = np.concatenate([np.empty(0, np.uint64), *(x for _, x, _ in found)])
                strong = np.repeat([y for *_, y in found], [len(a) for a, _, _ in found])
                for c, x in zip(out, (i, plain.view(np.int64), h.view(np.int64), slot, list(map(value, tokens)), at, hashes.view(np.int64), strong)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), lists(out[1], np.int64), lists(out[2], np.int64), lists(out[3], np.int8), pa.array(out[4], pa.list_(pa.string())), lists(out[5], np.int32), lists(out[6], np.int64), lists(out[7], bool)], ["id", "plain", "template", "slot", "value", "at", "hash", "strong"])

    return items.mapInArrow(run, "id long, plain array<long>, template array<long>, slot array<tinyint>, value array<string>, at array<int>, hash array<long>, strong array<boolean>")


def cut_docs(docs: DataFrame, sizes: list[int], reach: int, wanted) -> DataFrame:
    """id, first, plain, template, slot, value, at, hash: the stretches of each row (columns id, text) that hold windows
    whose bits are on in ``wanted``, a broadcast bit table, with ``reach`` words before and after. ``first``: the place
    in the text of the stretch's first word; at: of the windows, from there."""

    def run(batches):
        forms = Forms()
        for b in batches:
            out = [[] for _ in range(8)]

            def batch():
                made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), lists(out[2], np.int64), lists(out[3], np.int64), lists(out[4], np.int8), pa.array(out[5], pa.list_(pa.string())), lists(out[6], np.int32), lists(out[7], np.int64)], ["id", "first", "plain", "template", "slot", "value", "at", "hash"])
                for c in out:
                    c.clear()
                return made

            for i, text in ((i, text) for part in parts(b) for i, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)))):
                tokens, plain, h, slot = template(text, forms)
                ats, hashes = [], []
                for at, w, _ in keys(plain, h, slot, sizes):
                    for shift in SHIFTS:
                        p = (w >> np.uint64(shift) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        hit = ((wanted.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
                        at, w = at[hit], w[hit]
                    ats.append(at)
                    hashes.append(w)
                at, w = np.concatenate([np.empty(0, np.int64), *ats]), np.concatenate([np.empty(0, np.uint64), *hashes])
                if not len(at):
                    continue
                by = np.argsort(at, kind="stable")
                at, w = at[by], w[by]
                breaks = [0, *(np.flatnonzero(np.diff(at) > 2 * reach) + 1).tolist(), len(at)]
                for x, y in zip(breaks, breaks[1:]):
                    first, end = max(0, int(at[x]) - reach), min(len(tokens), int(at[y - 1]) + reach)
                    part = slice(first, end)
                    for c, v in zip(out, (i, first, plain[part].view(np.int64), h[part].view(np.int64), slot[part], list(map(value, tokens[part])), at[x:y] - first, w[x:y].view(np.int64))):
                        c.append(v)
                if sum(map(len, out[2])) > PART_WORDS:
                    yield batch()
            yield batch()

    return docs.mapInArrow(run, "id long, first int, plain array<long>, template array<long>, slot array<tinyint>, value array<string>, at array<int>, hash array<long>")


def bit_table(items: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, 2 MB: on for the hashes of ``items``. Gathered as at most FILTER_BITS / 64 words."""
    items = items.select(F.explode(F.array(*(F.shiftrightunsigned("hash", shift) for shift in SHIFTS))).alias("hash"))
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for w, b in items.select(F.floor(place / 64).cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        table[w] = b
    return table.view(np.uint8)


def stretches(on: np.ndarray, least: int):
    """(first, end) of the runs of at least ``least`` true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def slots_of(doc: Text, item: Text, pairs) -> tuple[int, int] | None:
    """How many slots of the item the (place in the item, place in the document) pairs hold and how many values are
    changed; nothing if one value of the item stands for two of the document."""
    stands, n, doubtful = {}, 0, set()
    for k, at in pairs:
        if item.slot[k] and doc.slot[at]:
            n += 1
            if DOUBTFUL in (item.slot[k], doc.slot[at]):
                doubtful.add((item.value[k], doc.value[at]))
            elif stands.setdefault(item.value[k], doc.value[at]) != doc.value[at]:
                return None
    return n, sum(x != y for x, y in doubtful.union(stands.items()))


def runs_on(doc: Text, item: Text, diagonal: int, strong: bool, window: int):
    """Pairs (place in the item, place in the document) of the longest runs on a diagonal: if a strong window has
    opened it, of words that are equal by template or as they stand, and of strong windows alone; else of words that
    are equal as they stand."""
    a, b = max(0, -diagonal), min(len(item.plain), len(doc.plain) - diagonal)
    size = min(window, len(item.plain))
    if b - a < size:
        return
    plain = item.plain[a:b] == doc.plain[a + diagonal : b + diagonal]
    ways = [plain]
    if strong:
        typed = item.template[a:b] == doc.template[a + diagonal : b + diagonal]
        literal = np.convolve(item.slot[a:b] == LITERAL_WORD, np.ones(size, np.int64), "valid") >= min(LITERAL, size)
        whole = np.convolve(typed, np.ones(size, np.int64), "valid") == size
        ways = [typed | plain, *windowed_runs(whole & literal, size)]
    for way in ways:
        for x, y in sorted(stretches(way, size), key=lambda r: (r[0] - r[1], r[0]))[:1]:
            yield [(k, k + diagonal) for k in range(a + x, a + y)]


def windowed_runs(starts: np.ndarray, size: int):
    """For each run of window starts, the longest first, the words that it covers."""
    for x, y in sorted(stretches(starts, 1), key=lambda r: (r[0] - r[1], r[0]))[:1]:
        way = np.zeros(len(starts) + size - 1, bool)
        way[x : y + size - 1] = True
        yield way


def groups(text: Text, first: int, end: int, strong: bool):
    """Keys and (first, end) of the words of a part of a text; by template, neighbouring slots of one type are one."""
    keys, places = [], []
    for k in range(first, end):
        key = (text.template if strong else text.plain)[k].item()
        if strong and keys and text.slot[k] and text.slot[k - 1] and keys[-1] == key:
            places[-1] = (places[-1][0], k + 1)
        else:
            keys.append(key)
            places.append((k, k + 1))
    return keys, places


def aligned(doc: Text, item: Text, lowest: int, highest: int, strong: bool):
    """An item laid on the diagonals from ``lowest`` to ``highest`` and SLACK around: (first place, n_words, n_slots,
    n_changed) of all runs of LEAST words or more that follow each other in both, or nothing if slots contradict."""
    mine, at = groups(item, 0, len(item.plain), strong)
    theirs, there = groups(doc, max(0, lowest - SLACK), min(len(doc.plain), highest + len(item.plain) + SLACK), strong)
    value = lambda text, part: " ".join(text.value[slice(*part)])
    stands, n, n_slots, first, doubtful = {}, 0, 0, None, set()
    for i, j, size in SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks():
        words = at[i + size - 1][1] - at[i][0] if size else 0
        if words < LEAST:
            continue
        first = there[j][0] if first is None else first
        n += words
        for a, b in zip(at[i : i + size], there[j : j + size]):
            if strong and item.slot[a[0]]:
                n_slots += a[1] - a[0]
                old, new = value(item, a), value(doc, b)
                if DOUBTFUL in (*item.slot[slice(*a)], *doc.slot[slice(*b)]):
                    doubtful.add((old, new))
                elif stands.setdefault(old, new) != new:
                    return None
    return first, n, n_slots, sum(x != y for x, y in doubtful.union(stands.items()))


def judged(doc: Text, item: Text, opened, window: int, cover: float, run_words: int):
    """The best match of an item in a stretch: (first place, n_words, n_slots, n_changed), or nothing."""
    best = None
    for diagonal, strong in opened:
        for pairs in runs_on(doc, item, diagonal, strong, window):
            n = len(pairs)
            if (n >= run_words or n >= cover * len(item.plain)) and (best is None or n > best[1]):
                slots = slots_of(doc, item, pairs)
                if slots is not None:
                    best = (pairs[0][1], n, *slots)
    if best and best[1] == len(item.plain):
        return best
    near = []
    for diagonal, strong in opened:  # ascending
        if near and diagonal - near[-1][1] <= SLACK:
            near[-1] = (near[-1][0], diagonal, near[-1][2] or strong)
        else:
            near.append((diagonal, diagonal, strong))
    for lowest, highest, strong in near:
        found = aligned(doc, item, lowest, highest, strong)
        if found and (found[1] >= run_words or found[1] >= cover * len(item.plain)) and (best is None or found[1] > best[1]):
            best = found
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, run_words: int = RUN) -> DataFrame:
    """One row for each document and benchmark item whose text it holds: doc_id, item_id, doc_at (first word),
    n_words (item words matched), coverage (share of the item), n_slots, n_changed, reparameterised.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Rows with null id or text and
    texts without words give nothing, nor do items of fewer than FEWEST words (``too_short`` tells which); items without
    enough literal words are found as they stand only; repeated rows give their result once; of several places the longest (first) is told. Of a very long text only the stretches
    that may match are sent on. An empty table on either side gives an empty result.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")).distinct()
    items = materialise(cut_items(items, window).where(F.size("plain") >= FEWEST).withColumn("item", F.monotonically_increasing_id()), "items")
    index = items.select("item", F.explode(F.arrays_zip("at", "hash", "strong")).alias("w")).select("item", "w.*")
    lengths = [r.n for r in items.select(F.least(F.size("plain"), F.lit(window)).alias("n")).distinct().collect()]
    reach = (items.select(F.max(F.size("plain"))).first()[0] or 0) + SLACK
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(index))
    found = cut_docs(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")), lengths, reach, wanted)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "windows")
    seeds = found.select("row", F.explode(F.arrays_zip("at", "hash")).alias("w")).select("row", F.col("w.at").alias("doc_at"), "w.hash")
    opened = seeds.join(index, "hash").groupBy("row", "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).agg(F.max("strong").alias("strong"))
    opened = opened.groupBy("row", "item").agg(F.sort_array(F.collect_list(F.struct("diagonal", "strong"))).alias("opened"))
    parts = ("plain", "template", "slot", "value")
    pairs = opened.join(found.select("row", F.col("id").alias("doc_id"), "first", F.struct(*parts).alias("doc")), "row").join(items.select("item", F.col("id").alias("item_id"), F.struct(*parts).alias("of")), "item")

    def run(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                doc, item = (Text.of(b.column(c)[r]) for c in (3, 4))
                best = judged(doc, item, [(o["diagonal"], o["strong"]) for o in b.column(5)[r].as_py()], window, cover, run_words)
                if best:
                    at, n, n_slots, n_changed = best
                    out.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(2)[r].as_py() + at, n, n / len(item.plain), n_slots, n_changed))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "doc_at", "n_words", "coverage", "n_slots", "n_changed"])

    lines = pairs.select("doc_id", "item_id", "first", "doc", "of", "opened").mapInArrow(run, "doc_id long, item_id long, doc_at long, n_words long, coverage double, n_slots long, n_changed long")
    best = F.max_by(F.struct("doc_at", "n_words", "coverage", "n_slots", "n_changed"), F.struct("n_words", -F.col("doc_at")))
    out = lines.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    return out.withColumn("reparameterised", F.col("n_changed") > 0)


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words of the benchmark items that ``contaminated`` does not look for, as they have fewer than FEWEST
    words; items without an id or a text are none."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")).distinct()
    return cut_items(items, 1).select(F.col("id").alias("item_id"), F.size("plain").alias("n_words")).where(F.col("n_words") < FEWEST)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
