"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums and digit counts confirm them, and words shortly before a span raise
its score. Kinds of the base contract (email, ip, card, phone) are kept whenever they are confirmed; the kinds
added here (iban, secret) also need a score of MIN_SCORE.

Java's matcher gives no offsets, so a text is split at a pattern's matches: the lengths of the pieces and of the
matches add up to the spans, and give the words before each. The work grows with a text's length and its number of
spans, not with their product. Patterns are written so that repeated groups are possessive or bounded, which keeps
the matcher's stack flat on texts of any length; they match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind, pattern, what a text must have before the pattern is tried, score of a confirmed span.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match starts where a run starts or the last match ended
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6),
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits: a run with at most one blank or hyphen between digits
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])", r"[0-9][0-9 -]{10}", 0.8),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.8),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])", r"[0-9a-f]{32}", 0.4),
)
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier when they stand within NEAR characters before a span.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|payment|credit", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank", "secret": "token|key|secret|password|auth",
}
NEAR, BONUS, MIN_SCORE = 40, 0.2, 0.5
#: Numbers summed at a time, characters of a piece of text, and the length of the shortest match of any kind.
PART, PIECE, SHORTEST = 512, 4096, 4
#: How the columns used while working begin; lengthened where a column of the rows does.
OWN = "_pii_"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(value))
    n = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(n, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.length(d).between(12, 19) & (total % 10 == 0)


def mod97(value: Column) -> Column:
    """The ISO 13616 check: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    s = F.regexp_replace(value, " ", "")
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97) == 1


def octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        part = F.ltrim(part, F.lit("0"))
        return F.when(F.length(part) <= 3, F.coalesce(part.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


CONFIRM = {"ip": octets, "card": luhn, "phone": lambda v: F.length(digits(v)).between(9, 15), "iban": mod97}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join, zero: int, levels: int = 2) -> Column:
    """For each number what ``join`` makes of all before it, ``zero`` for the first.

    An array grows by copying, so numbers are taken in parts of PART, the parts' totals again in parts: of n
    numbers about PART * n are copied, not n * n."""
    none = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

    def small(x: Column) -> Column:
        return F.aggregate(x, none, lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    if levels == 1:
        return small(values)

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda i: F.slice(x, i * PART + 1, F.lit(PART)))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, running(F.transform(ps, lambda p: F.aggregate(p, F.lit(zero), join)), join, zero, levels - 1), lambda p, s: F.transform(small(p), lambda v: join(v, s)))))

    return let(values, lambda x: F.when(F.size(x) <= PART, small(x)).otherwise(whole(x)))


def spans_of(found: Column, pieces: Column) -> Column:
    """start, end (exclusive) in code points and value of each match, and the NEAR characters before it."""
    length = lambda v: F.length(v)
    gaps = F.transform(F.slice(pieces, 1, F.size(found)), length)
    steps = F.zip_with(gaps, F.transform(found, length), lambda g, n: g + n)
    ends = lambda g, before: g + before
    starts = F.zip_with(gaps, running(steps, lambda a, v: a + v, 0), ends)
    # what stands before a match: the end of the piece before it, and as many matches and pieces as NEAR can hold
    tails = F.zip_with(F.transform(pieces, lambda p: F.right(p, F.lit(NEAR))), found, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))

    def made(ts: Column) -> Column:
        def before(i: Column, n: Column) -> Column:
            first = F.greatest(i - NEAR // SHORTEST, F.lit(0))
            text = F.array_join(F.slice(ts, first + 1, i - first + 1), "")
            return F.right(F.left(text, F.length(text) - n), F.lit(NEAR))

        return F.transform(F.arrays_zip(starts.alias("start"), found.alias("value")), lambda s, i: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), before(i, F.length(s["value"])).alias("before")))

    return let(tails, made)


def confirmed(kind: str):
    return lambda s: CONFIRM[kind](s["value"])


def scored(rank: int, kind: str, score: float):
    def run(s: Column) -> Column:
        likely = F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), F.lit(score + BONUS)).otherwise(F.lit(score))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.least(likely, F.lit(1.0)).alias("score"))

    return run


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names, which are none of its own: the text, and its spans as structs
    (start, rank, kind, end, score) by start, then kind as listed."""
    own = OWN
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn(own + "text", text)
    text = F.col(own + "text")
    first, second = {}, {}
    for rank, (kind, pattern, needs, score) in enumerate(KINDS):
        there = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
        first[own + kind] = F.when(there, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")))
        match = F.col(own + kind)

        good = spans_of(match["found"], match["pieces"])
        if kind in CONFIRM:
            good = F.filter(good, confirmed(kind))
        good = F.transform(good, scored(rank, kind, score))
        if kind not in BASE:
            good = F.filter(good, lambda s: s["score"] >= MIN_SCORE)
        second[own + kind] = F.when(F.size(match["found"]) > 0, good)
    docs = docs.withColumns(first).withColumns(second)
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    every = F.array_sort(F.concat(*(F.coalesce(F.col(own + k[0]), empty) for k in KINDS)))
    return docs.withColumn(own + "spans", every).drop(*(own + k[0] for k in KINDS)), own + "text", own + "spans"


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps an earlier span goes with it.

    The text is cut into pieces of PIECE characters first, so that what stands between two spans is found without
    counting characters from the text's start."""

    def made(pieces: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise("")

        def parts(ss: Column) -> Column:
            upto = running(F.transform(ss, lambda s: s["end"]), lambda a, v: F.greatest(a, v), 0)
            each = F.zip_with(ss, upto, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            last = F.array_max(F.transform(ss, lambda s: s["end"]))
            return F.concat(F.array_join(each, ""), between(last, F.length(text)))

        return let(spans, parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), made))


def find_pii(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with text) plus spans: an array of (kind, start, end, score), by start and then kind
    as listed in KINDS. A null or empty text has none; texts of any length are searched whole, in time that grows with
    their length and their spans. Repeated rows and other columns, whatever their names, stay as they are; a column
    spans is replaced. An empty table gives an empty result."""
    out, text, found = with_spans(docs.drop("spans"))
    out = out.withColumn("spans", F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))))
    return out.drop(text, found)


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns, whatever their names, with personal data in text replaced by [KIND]; a null text
    stays null, and texts of any length are masked whole."""
    out, text, found = with_spans(docs)
    new = F.when(F.col("text").isNotNull(), masked(F.col(text), F.col(found)))
    return out.withColumn("text", new).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
