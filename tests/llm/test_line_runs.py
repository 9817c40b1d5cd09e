import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from plumbago.llm import line_runs
from plumbago.llm.entry import ORACLE_SQL, op12_line_dedup
from tests.test_entry import canonical

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            who = held[key(x)]
            last = max((w for w in who if w is not None), default=None)
            if len(key(x)) < chars or len(who) < docs or i == last:
                stay.append(x)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LONG = "This line is long enough to count as one of forty points"


def test_equals_brute_force_on_odd_rows(spark):
    rows = [(i, f"a\n{LONG}\nb {i}") for i in range(9)] + [(2, f"{LONG.upper()} \n{LONG}\n"), (2, "x"), (None, LONG), (None, None), (50, ""), (51, "\n\n"), (7, f"a\n{LONG}\nb 7")]
    rows += [(60 + i, "ÄÖ " * 20 + "\r\n" + "É" * 39 + f"\n\t{'É' * 40}\x0b") for i in range(5)] + [(70, "\n".join(["y" * 39, LONG, LONG] * 5_000))]
    rows += [(80 + i, f"{'z' * 44} {i // 4}") for i in range(8)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, pos int")
    assert rows_of(line_runs.line_dedup(df)) == sorted(brute(rows), key=repr)
    assert rows_of(line_runs.line_dedup(df, batches=1, least_docs=2, least_chars=1)) == sorted(brute(rows, 1, 2), key=repr)
    assert line_runs.line_dedup(df.limit(0)).count() == 0


def test_text_ids(spark):
    rows = [(f"d{i}", f"{LONG}\n{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "name string, body string")
    assert rows_of(line_runs.line_dedup(df, "name", "body")) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (9, 3), (6, 10)])
def test_runs_hold_every_key_whatever_the_levels(spark, batches, fanout):
    lines = spark.createDataFrame([(i, i % k, 0) for i in range(60) for k in (1, 7, 30, 60)], "id long, h1 long, h2 long").distinct()
    runs = line_runs.LineRuns(spark, 5, fanout)
    for k in range(batches):
        runs.add(lines.where(f"id % {batches} = {k}"))
    assert all(len(level) < fanout for level in runs.levels)
    held = defaultdict(set)
    for r in lines.collect():
        held[r["h1"], r["h2"]].add(r["id"])
    got = {(r["h1"], r["h2"]): r for r in runs.frequent().collect()}
    assert {k: r["last"] for k, r in got.items()} == {k: max(v) for k, v in held.items() if len(v) >= 5}
    assert {(r["h1"], r["h2"]): r["docs"] for r in runs.frequent(1).where("docs < 5").collect()} == {k: len(v) for k, v in held.items() if len(v) < 5}
    with pytest.raises(ValueError):
        runs.frequent(6)
    runs.close()


def test_settled_keys_add_no_entries(spark):
    runs = line_runs.LineRuns(spark, 3)
    runs.add(spark.createDataFrame([(i, 1, 1) for i in range(10, 20)] + [(11, 2, 2)], "id long, h1 long, h2 long"))
    runs.add(spark.createDataFrame([(i, 1, 1) for i in range(10)] + [(1, 2, 2)], "id long, h1 long, h2 long"))
    assert [spark.table(n).count() for n in runs.levels[0]] == [2, 1]
    runs.close()


def test_batch_meets_a_run_without_another_shuffle(spark):
    runs = line_runs.LineRuns(spark)
    lines = spark.range(5000).selectExpr("id", "id % 50 as h1", "id % 3 as h2")
    runs.add(lines)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = lines.groupBy("h1", "h2").count()
        plan = own.join(spark.table(runs.levels[0][0]), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    runs.close()


def test_plan_has_no_python(spark):
    plan = op12_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_brute_force_and_sql(spark):
    out = op12_line_dedup(spark, SF)
    got = out.collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_line_dedup"])
    assert canonical(got, out.columns) == canonical(want.fetchall(), want.columns)
