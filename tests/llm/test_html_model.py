import itertools
import math
import random

from plumbago.llm import dom
from plumbago.llm import html_model as h
from plumbago.llm.entry import op7_main_text


def test_marginals_equal_enumeration():
    model = h.trained(60, 5)
    for html in ("<body><nav><a>x</a></nav><article><p>Some words here.</p></article></body>", "<div class=ad>a b</div><p>c d e f g h.</p>", ""):
        page = dom.read(html)
        n, total, ones = len(page.tags), 0.0, [0.0] * len(page.tags)
        signs = h.evidence(page)
        for ys in itertools.product((0, 1), repeat=n):
            p = model.root[ys[0]]
            for k in range(n):
                p *= math.exp(sum(model.log_sign[s][ys[k]] for s in signs[k] if s in model.log_sign))
                if k:
                    p *= model.step(model.kind(page, k))[ys[page.parents[k]]][ys[k]]
            total += p
            for k in range(n):
                ones[k] += p * ys[k]
        for got, want in zip(model.marginals(page), ones, strict=True):
            assert abs(got - want / total) < 1e-9


def test_accuracy_on_unseen_layout_draws():
    model = h.trained()
    right = total = 0
    for page, labels in h.labelled_pages(80, seed=99):
        for text, p, y in zip(page.texts, model.marginals(page), labels, strict=True):
            if text:
                total += 1
                right += (p >= 0.5) == y
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script><style>p{}</style></head><body>
<header><div class="logo">My site</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav></header>
<div class="cookie-banner"><p>We use cookies on this site.</p><button>Fine</button></div>
<article><h1>A &amp; B</h1><p>First   paragraph of the&nbsp;text,<br>with a break.<p><b>Second one, unclosed &lt;tag&gt;.
<!-- no --><div class="ad">Buy now at a low price.</div><ul><li>Item one of the list.</li></ul></article>
<aside class="sidebar"><h3>Related</h3><a href=/c>Another story</a></aside>
<section id="comments"><div class="comment"><p>I liked this text very much, thank you.</p></div></section>
<footer>&copy; 2020 My site. All rights reserved.</footer></body></html>"""


def test_one_page():
    assert h.main_text(PAGE, h.trained()) == "A & B\nFirst paragraph of the text, with a break.\nSecond one, unclosed <tag>.\nItem one of the list."


def test_quotes_inside_values_swallow_nothing():
    for attrs in ("title=it's", "data-note=5'", "title='a > b'", 'title = "x > y" class=z', "a=\"", "a='"):
        page = dom.read(f"<article><p {attrs}>First of the words here.</p><p>Second of the words here.</p></article>")
        runs = [x for x in page.texts if x]
        assert runs == ["First of the words here.", "Second of the words here."] or attrs[-1] in "\"'" and attrs[2] in "\"'"
    page = dom.read("<div title=it's class=ad>x</div>")
    assert page.names[page.tags.index("div")][0] == "ad"


def test_reader_survives_anything():
    rng = random.Random(1)
    bits = ["<p", ">", "</", "<!--", "-->", "<a href='", "\"", "x", " ", "<script>", "</script>", "&amp", "&#x41;", "<li>", "</p>", "<table><tr><td>", "é", "<br/>", "<div class="]
    model = h.trained(60, 5)
    for _ in range(300):
        h.main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), model)
    deep = "<div>" * 5000 + "text of it." + "</div>" * 5000
    assert h.main_text(deep, model) in ("text of it.", "")


def test_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<article><p>Some words are here now.</p></article>", "t"), (3, "v", "<article>" + "<p>Long words of text here.</p>" * 3000 + "</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(h.extract(df).collect(), key=lambda r: str(r["page_id"]))
    assert [r["n_chars"] for r in got] == [0, 0, 3000 * 25 + 2999, 25] or [len(r["text"]) == r["n_chars"] for r in got]
    assert got[-1]["text"] == "Some words are here now." and got[2]["text"].count("\n") == 2999
    assert h.extract(df.limit(0)).count() == 0


def test_query_gives_the_article(spark):
    import html as lib
    import re

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(lib.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r["text"] for r in op7_main_text(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
