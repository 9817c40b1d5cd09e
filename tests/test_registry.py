"""Queries without SQL run on whole graphs."""

from plumbago.plans import registry

SF = "/root/testdata/sf0.001"


def test_centrality_of_every_node(spark):
    got = {r["id"] for r in registry.concept_centrality(spark, SF).select("id").collect()}
    assert got == {r["id"] for r in registry._nodes(spark, SF, 1).collect()}


def test_alignment_asks_parties_too(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.fusion, "align", lambda n1, e1, v1, n2, e2, v2: asked.extend((n1, e1, v1, n2, e2, v2)))
    registry.alignment(spark, SF)
    for k, (nodes, edges, vectors) in ((1, asked[:3]), (2, asked[3:])):
        assert nodes.count() == registry._nodes(spark, SF, k).count() == vectors.count()
        assert edges.count() == registry._edges(spark, SF, k).count()


def test_headings_are_whole_turns(spark):
    texts = {(r["grp"], r["turn"]): r["text"] for r in registry._points(spark, SF).collect()}
    rows = registry.rewritten_texts(spark, SF).select("grp", "turn", "heading").collect()
    long = [(len(r["heading"]), len(texts[r["grp"], r["turn"]])) for r in rows if len(texts[r["grp"], r["turn"]] or "") > 80]
    assert long and all(a > 60 and a >= 0.8 * b for a, b in long)
