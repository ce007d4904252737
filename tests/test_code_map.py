"""The one-to-one map of codes against plain Python, in file order."""

import random

import pytest

from tidemark.sources import records


def in_order(entries):
    stocks, corps, out = set(), set(), {}
    for place, corp, stock in sorted(entries, key=lambda e: e[0]):
        s, c = (stock or "").strip(), (corp or "").strip()
        if not s:
            out[place] = "unlisted"
        elif not (len(s) == 6 and s.isdigit() and len(c) == 8 and c.isdigit()):
            out[place] = "bad_format"
        elif s in stocks:
            out[place] = "duplicate_stock"
        elif c in corps:
            out[place] = "duplicate_corp"
        else:
            stocks.add(s)
            corps.add(c)
            out[place] = "mapped"
    return out


def mapped(spark, entries):
    df = spark.createDataFrame([(*e, "x") for e in entries], "place long, corp_code string, stock_code string, _place string")
    rows = records.code_map(df.withColumnRenamed("_place", "note").repartition(4)).collect()
    assert len(rows) == len(entries) and {r.note for r in rows} <= {"x"}
    return {r.place: r.status for r in rows}


def chain(n):
    """Each entry shares a code with the one before and the one after, in turns of stock and corp."""
    return [(k, f"{(k + 1) // 2:08d}", f"{k // 2:06d}") for k in range(n)]


def test_a_chain_of_a_thousand(spark):
    entries = chain(1000)
    found = mapped(spark, entries)
    assert found == in_order(entries)
    assert sum(s == "mapped" for s in found.values()) == 500 and "undecided" not in found.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_and_file_order_agree(spark, monkeypatch, seed):
    """With a small bound the rounds decide most entries; the reasons are those of file order."""
    monkeypatch.setattr(records, "IN_ORDER", 25)
    rng = random.Random(seed)
    entries = [(k, f"{rng.randrange(60):08d}", f"{rng.randrange(80):06d}") for k in range(400)]
    entries += [(400 + k, f"{7:08d}", f"{rng.randrange(900):06d}") for k in range(200)]  # a code that a third of the entries share
    entries += [(700, "00000001", None), (701, None, "000001"), (702, "x", "000002"), (703, "00000003", " "), (704, " 00000999 ", " 000999 "), (705, "00000999", "000998")]
    assert mapped(spark, entries) == in_order(entries)


def test_nothing_to_map(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, [(1, "00000001", "")]) == {1: "unlisted"}
