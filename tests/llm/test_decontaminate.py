import hashlib
import re

import duckdb

from plumbago.llm import decontaminate as d
from plumbago.llm.entry import ORACLE_SQL, op2_decontamination

SF = "/root/testdata/sf0.001"


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            for s in range(max(1, len(x) - 9)) if x else []:
                win = x[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


DOCS = [(1, "x One two THREE, four"), (2, None), (3, ""), (4, "two three. two three two"), (5, "a b c d e f g h i j k l"), (6, "ñandú über é"), (7, "zz " * 4000 + "b c d e f g h i j k"), (7, "one two")]
ITEMS = [(10, "two three"), (2, "a b c d e f g h i j k"), (3, "..."), (4, None), (5, "ÑANDÚ"), (6, "über é"), (7, "three two"), (8, "Two Three")]


def frames(spark):
    docs = spark.createDataFrame([(*r, "c") for r in DOCS], "doc_id long, text string, n_words string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_equals_brute_force(spark):
    got = d.decontaminate(*frames(spark)).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute(DOCS, ITEMS))


def test_passes_give_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    docs = docs.where("text is null or not text like 'one%'")
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 150)
    got = d.decontaminate(docs, items).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute([x for x in DOCS if x[1] != "one two"], ITEMS))


def test_spans_are_offsets_of_the_original(spark):
    rows = {r["doc_id"]: r["spans"] for r in d.decontaminate(*frames(spark)).where("doc_id < 7").collect()}
    assert DOCS[0][1][slice(*rows[1][0])] == "two THREE" and rows[2] == []
    assert [DOCS[5][1][slice(*s)] for s in rows[6]] == ["über é"]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.decontaminate(docs.limit(0), items).count() == 0
    assert {r["contaminated"] for r in d.decontaminate(docs, items.limit(0)).collect()} == {False}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = op2_decontamination(spark, SF)
    want = con.sql(ORACLE_SQL["op2_decontamination"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_passes_keep_rows_of_one_id_apart(spark, monkeypatch):
    docs, items = frames(spark)
    docs = docs.unionByName(docs.where("doc_id in (1, 7)")).unionByName(spark.createDataFrame([(None, "two three"), (None, "clean"), (None, "clean")], "doc_id long, text string").selectExpr("*", "'k' as n_words"))
    items = items.unionByName(items.limit(1).selectExpr("cast(null as long) as item_id", "'clean' as text"))
    want = sorted(map(str, d.decontaminate(docs, items, keep=["n_words"]).collect()))
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 150)
    assert sorted(map(str, d.decontaminate(docs, items, keep=["n_words"]).collect())) == want and len(want) == 14


def test_items_without_an_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "a plain line"), (2, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "plain line")], "item_id long, text string")
    assert {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in d.decontaminate(docs, items).collect()} == {1: (True, 1), 2: (False, 0)}
