"""Layers and order against serial versions, cycles included; sections in the order of concepts."""

import random

from plumbago.operators import order as O
from plumbago.operators import tables


def frames(spark, nodes, links):
    return spark.createDataFrame(nodes, "id string, priority int, label string, pos long"), spark.createDataFrame(links, "source string, target string")


def brute(nodes, links):
    ids = {n[0] for n in nodes}
    before = {i: {a for a, b in links if b == i and a in ids} for i in ids}
    layer = {}
    while ready := {i for i in ids if i not in layer and before[i] <= layer.keys()}:
        layer |= {i: max((layer[b] + 1 for b in before[i]), default=0) for i in ready}
    key = lambda n: (n[0] not in layer, layer.get(n[0], 0), *((n[1], n[2]) if n[0] in layer else ()), n[3])
    return [(n[0], layer.get(n[0])) for n in sorted(nodes, key=key)]


def test_order_equals_a_serial_version(spark):
    rng = random.Random(3)
    nodes = [(f"n{i}", rng.randrange(3), rng.choice("abcdef"), i) for i in range(80)]
    links = [(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(80), 2)) for _ in range(90))]
    links += [("n70", "n71"), ("n71", "n70"), ("n71", "n79"), ("n5", "n5"), ("x", "n1"), ("n0", "n1"), ("n0", "n1")]
    got = [(r["id"], r["layer"]) for r in O.in_order(*frames(spark, nodes, links)).orderBy("place").collect()]
    assert got == brute(nodes, links) and any(x is None for _, x in got)
    assert O.in_order(*frames(spark, nodes[:1], [])).first()["place"] == 0


def test_numbers_over_many_parts(spark):
    rows = tables.numbered(spark.range(3000).selectExpr("id", "id % 7 as k").repartition(5), "n", "k", "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(range(3000), key=lambda i: (i % 7, i)) and {r["n"] for r in rows} == set(range(3000))


def test_sections_follow_the_concepts(spark):
    heads = ["Trees of things", "Stack", "Workflow Overview", "Additional queue", "Nothing known", "The queue types"]
    points = spark.createDataFrame([(1, i, h, f"p{j}") for i, h in enumerate(heads) for j in range(2)], "notes_id int, sec_pos int, sec_heading string, text string")
    concepts = spark.createDataFrame([("Queue", 0), ("stack", 1), ("binary trees", 2), ("of", 3)], "label string, place long")
    out = O.sections_in_order(points, concepts).select("sec_pos", "sec_heading").distinct().collect()
    assert [r["sec_heading"] for r in sorted(out)] == ["Workflow Overview", "The queue types", "Stack", "Trees of things", "Nothing known", "Additional queue"]
