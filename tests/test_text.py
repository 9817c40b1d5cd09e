import duckdb
from pyspark.sql import functions as F

from plumbago.functions import bullets as B
from plumbago.functions import quality as Q
from plumbago.functions import text as T
from plumbago.operators import alignment as A
from plumbago.operators import narrative as N
from plumbago.plans import registry
from plumbago.plans.registry import rules


def test_first_letter_becomes_one_capital(spark):
    words = ["ßheit", "ŉa", "ᾀb", "ᾳc", "ﬁd", "ǆe", "étude", "ordinary", "Already", "1st", "", " "]
    rows = spark.createDataFrame(list(enumerate(words)), "k int, t string").select("k", T.capitalised(F.col("t"))).orderBy("k").collect()
    want = [duckdb.execute("SELECT upper(?[1]) || ?[2:]", [w, w]).fetchall()[0][0] for w in words]
    assert [r[1] for r in rows] == want


def test_sharp_s_first_in_a_polished_text(spark):
    assert spark.sql("SELECT 'ßheit  geht' AS t").select(T.polished(F.col("t"))).first()[0] == "ẞheit geht."


def test_lists_of_parts_are_no_lambdas(spark):
    # a lambda over the parts works the text out anew for each of them
    t = F.col("t")
    rules = (B.has_explanation(t), B.is_label_only(t), B.is_ownership(t), B.is_decorative(t, t), Q.is_fragment(t), A.category(t), N.topic(t), N.section_priority(t, F.lit(None).cast("int")))
    for rule in rules:
        plan = spark.sql("SELECT 'x' AS t").select(rule)._jdf.queryExecution().analyzed().toString()
        assert "exists(" not in plan.lower()


def test_parts_are_taken_literally(spark):
    rows = spark.createDataFrame([("a.b",), ("axb",), ("e\\Qf",), ("(g)",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.holds_any(F.col("t"), ("a.b", "\\Q", "(g)"))).collect()] == [True, False, True, True, None]


def test_a_line_is_left_out_when_its_plain_text_is_blank(spark, tmp_path):
    lines = ["", " \t\x0b\f\r", "́", " ́ ̀", " ", "\x85", "é", "a", "　", "\x00", "ß"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.createDataFrame(list(enumerate(lines)), "k long, line string").select("k", rules._plain_text(F.col("line")).alias("t")).where("t <> ''").collect()
    got = rules._bullets(spark, str(tmp_path))
    assert sorted((r["bullet_id"] - 1_000_000, r["t"]) for r in got.collect()) == sorted(tuple(r) for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1  # the text is made once


def test_words_are_taken_before_pairing(spark):
    # where two sets of words are compared, none is read from its sentence
    sf = "/root/testdata/sf0.001"
    for name in ("heading_likeness", "sentence_best_likeness", "sentence_anchors"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        compared = [line for line in plan if "array_intersect" in line]
        assert compared and not any("regexp_extract_all" in line or "split(" in line for line in compared), name
