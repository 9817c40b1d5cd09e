import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from plumbago.llm import resampling
from plumbago.llm.entry import ORACLE_SQL, op13_resampling
from tests.test_entry import canonical

SF = "/root/testdata/sf0.001"


def features(text, n, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, n=1, least=20, percent=10, seed=2024):
    got = [(i, *features(t, n, buckets)) for i, t in docs]
    s, t = Counter(b for r in got for b in r[2]), Counter(b for _, x in target for b in features(x, n, buckets)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, words, f in got:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([words, i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[1:], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("args", [{}, {"buckets": 16, "ngram": 3, "least_words": 2, "percent": 60, "seed": 7}])
def test_equals_brute_force_on_odd_rows(spark, args):
    docs = [(i, f"word{i % 7} and more text about {'things ' * (i % 30)}") for i in range(150)] + [(3, None), (None, ""), (None, "a b c d e " * 6), (None, "a b c d e " * 6), (4, "a"), (5, "long text " * 50_000), (200, "Ärger ÄRGER é 9")]
    target = [("a", "things about text"), ("b", None), ("b", "things " * 40)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, weight double")
    want = brute(docs, target, args.get("buckets", 10_000), args.get("ngram", 1), args.get("least_words", 20), args.get("percent", 10), args.get("seed", 2024))
    other = spark.createDataFrame(target, "item_id string, text string")
    assert sorted((tuple(r) for r in resampling.resample(df, other, **args).collect()), key=repr) == sorted(want, key=repr)
    assert resampling.resample(df.limit(0), other, **args).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(df, other.limit(0), **args).collect()), key=repr) == sorted(brute(docs, [], *(args.get(k, d) for k, d in (("buckets", 10_000), ("ngram", 1), ("least_words", 20), ("percent", 10), ("seed", 2024)))), key=repr)


def test_ranks_over_many_parts(spark):
    rows = resampling.ranked(spark.range(5000).selectExpr("id", "id % 13 as score").repartition(7), "score", "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(range(5000), key=lambda i: (i % 13, i)) and {r["rank"] for r in rows} == set(range(1, 5001))


def test_matrix_is_in_blocks(spark):
    docs = spark.createDataFrame([(i, "a b b " * (i % 3)) for i in range(300)], "doc_id long, text string").repartition(1)
    matrix = resampling.count_matrix(docs).collect()
    assert len(matrix) == 5 and sum(len(r["ids"]) for r in matrix) == 300
    for r in matrix:
        assert len(r["indptr"]) == len(r["ids"]) + 1 and r["indptr"][-1] == len(r["indices"]) == len(r["counts"])


def test_query_equals_brute_force_and_sql(spark):
    out = op13_resampling(spark, SF)
    got = out.collect()
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, got)) == sorted(brute(docs, items))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op13_resampling"])
    assert canonical(got, out.columns) == canonical(want.fetchall(), want.columns)
