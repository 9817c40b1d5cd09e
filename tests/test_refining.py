"""Triples of compound sentences, and texts said again."""

from plumbago.operators import refining as R


def sentences(spark, *texts):
    return spark.createDataFrame([(k, i, s, "x") for k, t in enumerate(texts) for i, s in enumerate(t)], "key int, pos int, sentence string, relation string").select("key", "pos", "sentence")


def test_triples_of_compound_sentences(spark):
    rows = sentences(spark, ["The stack has a top, supports push operations, LIFO order. A queue is a line of items.", "no relation here"], [None, "", "Is it on"], ["is it what it seems, the other uses xx, to the yy"])
    got = [(r["key"], r["subject"], r["relation"], r["object"]) for r in R.triples(rows).orderBy("key", "place").collect()]
    assert [r for r in got if r[0] < 2] == [(0, "stack", "has", "a top"), (0, "stack", "supports", "push operations"), (0, "stack", "related to", "LIFO order"), (0, "A queue", "is a", "line of items"), (1, "Is it", "is", "it on")]
    assert [r[2:] for r in got if r[0] == 2] == [("is", "it what it seems"), ("uses", "xx"), ("related to", "yy")]


def test_pairs_go_once_and_idle_triples_go(spark):
    rows = sentences(spark, ["alpha uses beta. Beta has Alpha. alpha has alpha. gamma is the. data has information. Raw data uses new information."])
    got = [(r["subject"], r["relation"], r["object"]) for r in R.clean_triples(R.triples(rows)).orderBy("place").collect()]
    assert got == [("Alpha", "uses", "Beta"), ("Data", "has", "Information")]


def test_one_sentence_a_subject(spark):
    rows = sentences(spark, ["Stack has a top, has a base, has items. stack is a list, uses arrays. Queue contains items and links"])
    got = [r["sentence"] for r in R.subject_sentences(R.clean_triples(R.triples(rows))).orderBy("place").collect()]
    assert got == ["Stack has A top, A base, and Items, is a type of List, and uses Arrays.", "Queue contains Items and links."]


def test_paragraphs(spark):
    rows = spark.createDataFrame([(0, i, f"Item {i} shows a feature of {'x' * i}.") for i in range(8)] + [(0, 8, "a feature of xx shows item 2."), (1, 0, "Alone.")], "key int, place int, sentence string")
    got = [(r["key"], r["sentence"]) for r in R.in_paragraphs(rows).orderBy("key", "place").collect()]
    assert len(got) == 9 and got[-1] == (1, "Alone.")
    assert [s.split(",")[0] if s.split(" ")[0] != "Item" else "" for _, s in got[:-1]] == ["", "", "", "In practice", "Furthermore", "", "For instance", ""]


def test_refined_texts(spark):
    rows = sentences(spark, ["The stack has a top. The stack uses arrays."], ["nothing to parse", None], [None])
    got = {r["key"]: r["text"] for r in R.refined(rows).collect()}
    assert got == {0: "Stack has A top and uses Arrays." + R.CLOSING.format("Stack"), 1: "nothing to parse ", 2: ""}
    assert R.refined(rows.limit(0)).count() == 0
