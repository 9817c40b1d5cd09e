import math
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from plumbago.llm import lexical
from plumbago.llm.entry import ORACLE_SQL, op11_lexical_search
from tests.test_entry import canonical

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            if not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            found += [(s, i)] if s > 0 else []
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k, i, s) for k, (s, i) in enumerate(found[:top], 1)]
    return out


DOCS = [
    (1, "alpha beta gamma"), (2, "ALPHA alpha delta"), (3, None), (4, ""), (5, "... !!"), (6, "beta"), (6, "beta"), (6, "beta gamma"), (None, "beta"), (None, "zeta eta theta"), (7, "Äpfel äpfel ÄPFEL 42"),
    (8, "alpha " * 40_000 + "rare"), (9, "x" * 100_000), *((100 + i, "alpha beta") for i in range(30)), *((200 + i, f"w{i} " * (i + 1)) for i in range(400)),
]
ITEMS = [("a", "alpha beta beta"), ("b", "rare alpha"), ("c", None), ("d", "nothing here"), ("e", "Äpfel 42"), ("a", "delta"), (None, "beta"), ("f", "w7 w8 w399 w399"), ("g", "x" * 100_000 + " zeta")]


@pytest.mark.parametrize("query_bytes", [30_000, 1_000_000])
def test_equals_brute_force_on_odd_rows(spark, query_bytes):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in DOCS], "doc_id long, text string, rank int, score string")
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id string, text string, doc_id long")
    got = [tuple(r) for r in lexical.ranked_search(docs, items, query_bytes=query_bytes).collect()]
    assert sorted(got, key=repr) == sorted(brute(DOCS, ITEMS), key=repr)
    assert lexical.ranked_search(docs.limit(0), items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_text_ids_and_another_top(spark):
    docs, items = [(f"n{i}", t) for i, t in DOCS if i], [(i, t) for i, t in ITEMS]
    given = spark.createDataFrame(docs, "name string, body string")
    got = lexical.ranked_search(given, spark.createDataFrame(items, "item_id string, text string"), "name", "body", top=3)
    plain = [(i, t) for i, t in docs]
    want = []
    for n, item in enumerate(items):
        want += brute(plain, [item], 10_000) if n >= 0 else []
    best = {}
    for item, k, i, s in want:
        best.setdefault((item, k), []).append((i, s))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == sum(k <= 3 for _, k, _, _ in want) and all(any(s == x[1] for x in best[item, k]) for item, k, _, s in rows)


def test_bytes_bound_the_impacts():
    import numpy as np

    tf, m = np.meshgrid(np.arange(1, 300), np.array([25, 26, 90, 1000, 10**6]))
    exact = lexical.impact(tf, m)
    byte = -(-exact * lexical.LEVELS // lexical.IMPACT)
    assert (exact * lexical.LEVELS <= byte * lexical.IMPACT).all() and (exact * lexical.LEVELS > (byte - 1) * lexical.IMPACT).all() and byte.max() <= 255 and exact.max() < lexical.IMPACT


def test_bounds_leave_most_documents_unscored(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    size = lexical.corpus_size(docs)
    index = lexical.build_index(docs, size)
    rows = [(r["item_id"], Counter(lexical.normal_words(r["text"]))) for r in items.collect()]
    names = sorted({t for _, c in rows for t in c})
    df = lexical.document_frequencies(index, names)
    import numpy as np

    weights = np.zeros((len(names), len(rows)), np.int64)
    for q, (_, c) in enumerate(rows):
        for t, n in c.items():
            weights[names.index(t), q] = n * lexical.term_weight(size[0], df[t])
    totals = [0]
    lexical._searched(iter(index.toArrow().to_batches()), {t: i for i, t in enumerate(names)}, weights, 10, totals)
    assert totals[0] < 0.05 * size[0] * len(rows)


def test_query_equals_brute_force_and_sql(spark):
    out = op11_lexical_search(spark, SF)
    got = out.collect()
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, got)) == sorted(brute(docs, items))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op11_lexical_search"])
    assert canonical(got, out.columns) == canonical(want.fetchall(), want.columns)


def test_index_row_groups_are_bounded(spark):
    # a reader or writer holds a row group; with Parquet's own bound, one of as many blocks as a task has
    docs = spark.createDataFrame([(i, "alpha " * 100_000) for i in range(20)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(docs, lexical.corpus_size(docs))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > lexical.BLOCK_GROUP >= max(groups)
