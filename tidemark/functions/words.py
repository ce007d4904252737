"""Words that texts of the service must not hold, with the phrases in which they are allowed.

Texts are brought to NFKC; Korean words are found anywhere, the longest first, English ones as whole words in any case.
A word inside an allowed phrase (exact case) does not count. Positions are those of the NFKC text, so they are found in
Arrow batches: the overlap with allowed phrases needs offsets, which built-in functions do not give."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stored import written

#: Korean words.
KOREAN = (
    "강력 추천", "강력 매수", "강력 매도", "강력매수", "강력매도", "강력추천", "비중 확대", "비중 축소", "비중확대", "비중축소", "종목 픽", "종목픽", "관심 종목 픽", "관심종목픽", "목표 주가", "목표주가", "목표가",
    "투자 의견", "투자의견", "진입 시점", "진입시점", "추천종목", "유망종목", "유망주", "기대주", "강추", "탑픽", "추천", "유망", "기대", "주목할", "주목", "매수", "매도", "매집", "손절", "익절", "보유 권유", "보유권유", "관망",
    "사세요", "파세요", "고평가", "저평가", "베스트", "적기", "픽", "수익률 상위", "수익률상위", "검증된 전략", "검증된전략", "고수익 전략", "고수익전략", "아웃퍼폼", "언더퍼폼",
)
#: English words.
ENGLISH = (
    "Strong Buy", "Strong Sell", "Should Buy", "Worth Buying", "Worth Selling", "Top Pick", "Best Buy", "Price Target", "Target Price", "Conviction", "Recommended", "Recommendation", "Outperform", "Underperform",
    "Overweight", "Underweight", "Bullish", "Bearish", "Accumulate", "Upgrade", "Downgrade", "Hold", "Best", "Buy", "Sell", "Long", "Short",
)
#: Words of judgement, looked for only when asked.
SENTIMENT = ("호재", "악재", "긍정적", "부정적")
#: Phrases in which words are allowed. Left out are those that are lines of program text, which only a check
#: of source files meets.
ALLOWED = (
    "관심 종목", "관심종목", "조건에 부합하는 종목", "필터 통과 항목", "필터링 결과", "선택한 종목", "비교 대상", "추천하지 않", "추천 안 함", "추천이 아닙", "추천 시스템 없음", "추천 시스템 X", "추천 기능 없음", "추천 위젯 없음",
    "추천 위젯", "추천을 제공하지", "종목 추천을 제공", "alembic upgrade", "alembic downgrade", "베스트셀러", "이베스트", "기대산업", "기대치", "기대 수명", "기대수명", "적시 공시", "적시공시", "적기 공시", "주목받는", "주목받고",
    "매수자", "매수인", "매도자", "매도인", "단기 보유", "장기 보유", "보유 기간", "보유기간", "Buy-side", "Buy Side", "Best Practice", "Best Effort", "Best practices", "Hold On", "Holding", "Holdings", "Long-term", "Long term",
    "Long Term", "Short-term", "Short term", "Short Term", "매수/매도", "매도/매수", "매수·매도", "매도·매수", "매도 거래금액", "매수 거래금액", "매도 거래", "매수 거래", "매도세", "short-circuit", "--tb=short", "best-effort",
    "기대한", "기대했", "기대해", "기대:", "기대)", "기대값",
)
#: Scopes whose texts are not checked.
EXEMPT = ("user_private", "external_quote")
DEEPEST = 64
HIT = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("word", T.StringType()), ("canonical", T.StringType()), ("kind", T.StringType()), ("index", T.IntegerType()))]))


def alternatives(words) -> str:
    return "|".join(map(re.escape, sorted(set(words), key=lambda w: (-len(w), w))))


def allowed_around(words) -> dict[str, list[tuple[int, str]]]:
    """For each spelling in which a word stands in allowed phrases: the phrases, and where in them it begins."""
    around: dict[str, set[tuple[int, str]]] = {}
    for word in words:
        for phrase in ALLOWED:
            for m in re.finditer(f"(?={re.escape(word)})", phrase, re.IGNORECASE):
                around.setdefault(phrase[m.start() : m.start() + len(word)], set()).add((m.start(), phrase))
    return {spelling: sorted(places) for spelling, places in around.items()}


class Scanner:
    def __init__(self, sentiment: bool = False):
        first = "".join(sorted({w[0].lower() for w in ENGLISH}))  # most places are ruled out by their letter, before the words are tried
        self.parts = [("ko_absolute", re.compile(alternatives(KOREAN))), ("en_absolute", re.compile(rf"\b(?=[{first}])(?:{alternatives(ENGLISH)})\b", re.IGNORECASE))]
        if sentiment:
            self.parts.append(("ko_sentiment", re.compile(alternatives(SENTIMENT))))
        self.canonical = {w.lower(): w for w in ENGLISH}
        self.around = allowed_around(KOREAN + ENGLISH + (SENTIMENT if sentiment else ()))

    def __call__(self, text: str | None) -> list[dict]:
        """The words of a text, by place."""
        text = unicodedata.normalize("NFKC", text or "")
        hits = [(m.start(), m.end(), kind, m[0]) for kind, pattern in self.parts for m in pattern.finditer(text)]
        # a word is inside a phrase if the text has the phrase where it would have to begin: no search of the text for phrases
        hits = [h for h in hits if not any(h[0] >= before and text.startswith(p, h[0] - before) for before, p in self.around.get(h[3], ()))]
        return [{"word": w, "canonical": self.canonical.get(w.lower(), w), "kind": kind, "index": at} for at, _, kind, w in sorted(hits)]


def found(rows: DataFrame, key: str, text: str, words_of) -> DataFrame:
    """key, word, canonical, kind, index: a row for each hit that ``words_of`` gives for the column ``text``."""
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("hits", HIT)])
    kind = pa.list_(pa.struct([("word", pa.string()), ("canonical", pa.string()), ("kind", pa.string()), ("index", pa.int32())]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words_of(t) for t in b.column(1).to_pylist()], kind)], ["key", "hits"])

    hits = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return hits.select(F.col("key").alias(key), F.explode("hits").alias("h")).select(key, "h.*")


def scanned(texts: DataFrame, key: str, sentiment: bool = False) -> DataFrame:
    """The words of the column text; a null text has none."""
    scan = Scanner(sentiment)
    return found(texts, key, "text", scan)


def leaves(payloads: DataFrame, key: str, excluded: frozenset[str] = frozenset(), deepest: int = DEEPEST) -> DataFrame:
    """key, text, kind: the texts in the JSON of the column payload, but those below an excluded key. Nested values are
    opened level by level as variants, each level a written table, until none is left. A payload nested deeper than
    ``deepest`` levels, or that is no JSON, gives one row of the kind ``too_deep`` or ``no_json`` and no text; a null one nothing.
    Keys are unique."""
    spark = payloads.sparkSession
    rows = payloads.select(F.col(key).alias("key"), F.try_parse_json(F.col("payload").cast("string")).alias("value"), (F.col("payload").isNotNull()).alias("given"))
    no = lambda rows, kind: rows.select("key", F.lit(None).cast("string").alias("text"), F.lit(kind).alias("kind"))
    bad = no(rows.where("given AND value IS NULL"), "no_json")
    kind = lambda rows: rows.withColumn("_kind", F.substring_index(F.schema_of_variant("value"), "<", 1))
    level, texts, depth = written(kind(rows.where("value IS NOT NULL").select("key", "value")), "level"), [], 0
    while not level.isEmpty():
        texts.append(level.where("_kind = 'STRING'").select("key", F.col("value").cast("string").alias("text")))
        nested = level.where("_kind IN ('OBJECT', 'ARRAY')")
        if depth == deepest:
            break
        opened = nested.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("name"), F.col("value").alias("inner")))
        inside = opened.where(F.col("name").isNull() | ~F.col("name").isin(*excluded)) if excluded else opened
        level, depth = written(kind(inside.select("key", F.col("inner").alias("value"))), "level"), depth + 1
    else:
        nested = level.where("false")
    deep = written(nested.select("key").distinct(), "deep")  # what is open still has a level below
    found = bad.union(no(deep, "too_deep"))
    for t in texts:
        found = found.union(t.join(deep, "key", "left_anti").withColumn("kind", F.lit("text")))
    return found.withColumnRenamed("key", key)


def scanned_payloads(payloads: DataFrame, key: str, excluded: frozenset[str] = frozenset(), deepest: int = DEEPEST) -> DataFrame:
    """The words of all texts in the JSON of the column payload. One nested too deep gives a single hit of the kind
    ``too_deep``, one that is no JSON one of the kind ``no_json``."""
    rows = leaves(payloads, key, excluded, deepest)
    none = rows.where("kind <> 'text'").select(key, F.lit("").alias("word"), F.lit("").alias("canonical"), "kind", F.lit(0).alias("index"))
    return scanned(rows.where("kind = 'text'"), key).unionByName(none)


def unclean(texts: DataFrame, key: str, sentiment: bool = False) -> DataFrame:
    """key, n of texts (with scope) that hold words; texts of an exempt scope pass."""
    rows = texts.where(~F.coalesce("scope", F.lit("")).isin(*EXEMPT))
    return scanned(rows, key, sentiment).groupBy(key).agg(F.count("*").alias("n"))
