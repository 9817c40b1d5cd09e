"""Main text of web pages by a tree-structured graphical model over the page's elements.

Each element and text run is content or not. Parent-child potentials and the potentials of what a node shows are
estimated from labelled pages; sum-product messages upward and downward give each run's marginal.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, lean, slices
from .dom import Page, read

#: Pages drawn for training, and the seed they are drawn from.
TRAINING_PAGES, SEED = 600, 11
#: Parts of class, id and role names, by what they say about an element. Fixed values.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar links",
    "top": "header masthead banner logo branding hero",
    "bottom": "footer copyright colophon legal contentinfo bottom",
    "side": "sidebar aside widget related recommended promo rail complementary trending popular more",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored sponsors dfp adsense outbrain taboola",
    "notice": "cookie cookies notice consent gdpr popup modal alert newsletter subscribe subscription signup paywall toast overlay",
    "form": "form search login register contact",
    "reader": "comment comments reply replies respond disqus discussion feedback reviews",
    "share": "share sharing social follow tags tag meta byline toolbar",
    "body": "article content main post entry story text body prose page",
}
_CUE = {w: kind for kind, ws in CUES.items() for w in ws.split()}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@cache
def cues(name: str) -> frozenset[str]:
    return frozenset(_CUE[p] for p in (x.lower() for x in _PART.findall(name)) if p in _CUE)


def evidence(page: Page) -> list[list[str]]:
    """What each node shows: name cues of an element; length, links and ending of a run."""
    out = []
    for k, tag in enumerate(page.tags):
        if tag:
            found = set().union(*(cues(n) for n in page.names[k])) if any(page.names[k]) else set()
            out.append(sorted(found))
        else:
            text = page.texts[k]
            words = text.count(" ") + 1
            size = "1" if words == 1 else "2-4" if words < 5 else "5-12" if words < 13 else "13-40" if words < 41 else "41+"
            share = page.linked[k] / len(text)
            out.append([f"words {size}", "links all" if share > 0.8 else "links some" if share > 0.2 else "links none", "stop" if text[-1] in ".!?…:;\"'”»" else "open"])
    return out


class TreeModel:
    """P(root), P(child | parent, child's kind) and P(sign | node), each from counts of labelled pages."""

    def __init__(self, pages: list[tuple[Page, list[bool]]]):
        pair, sign, seen = Counter(), Counter(), Counter()
        for page, labels in pages:
            shown = evidence(page)
            for k, tag in enumerate(page.tags):
                y = labels[k]
                if page.parents[k] >= 0:
                    pair[self.kind(page, k), labels[page.parents[k]], y] += 1
                    pair[None, labels[page.parents[k]], y] += 1
                family = "run" if not tag else "element"
                seen[family, y] += 1
                for s in shown[k]:
                    sign[s, y] += 1
        first = sum(labels[0] for _, labels in pages)
        self.root = ((len(pages) - first + 0.5) / (len(pages) + 1), (first + 0.5) / (len(pages) + 1))
        self.signs = {s for s, _ in sign}
        self.log_sign = {s: tuple(math.log((sign[s, y] + 0.5) / (seen["run" if " " in s or s in ("stop", "open") else "element", y] + 1.0)) for y in (False, True)) for s in self.signs}
        self.pair, self.table = pair, {}

    @staticmethod
    def kind(page: Page, k: int) -> str:
        if not page.tags[k]:
            return f"run of {page.tags[page.parents[k]]}"
        return f"named {page.tags[k]}" if any(page.names[k]) and any(cues(n) for n in page.names[k]) else page.tags[k]

    def step(self, kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """P(child | parent) as [parent][child]; kinds seen seldom lean on all kinds together."""
        if kind not in self.table:
            rows = []
            for p in (False, True):
                base = (self.pair[None, p, True] + 0.5) / (self.pair[None, p, False] + self.pair[None, p, True] + 1.0)
                n0, n1 = self.pair[kind, p, False], self.pair[kind, p, True]
                q = (n1 + 4 * base) / (n0 + n1 + 4)
                q = min(0.999, max(0.001, q))
                rows.append((1 - q, q))
            self.table[kind] = tuple(rows)
        return self.table[kind]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node: messages pass from the last node to the first, then from the first to the last."""
        n = len(page.tags)
        own = []
        for signs in evidence(page):
            e = [0.0, 0.0]
            for s in signs:
                if s in self.log_sign:
                    e[0] += self.log_sign[s][0]
                    e[1] += self.log_sign[s][1]
            top = max(e)
            own.append([math.exp(e[0] - top), math.exp(e[1] - top)])
        up = [list(x) for x in own]  # evidence at and below a node
        steps = [self.step(self.kind(page, k)) if page.parents[k] >= 0 else None for k in range(n)]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = steps[k]
            u = up[k]
            m0, m1 = a * u[0] + b * u[1], c * u[0] + d * u[1]
            total = m0 + m1
            sent[k] = m0, m1 = m0 / total, m1 / total
            p = up[page.parents[k]]
            p[0] *= m0
            p[1] *= m1
            top = max(p) or 1.0
            p[0], p[1] = max(p[0] / top, 1e-300), max(p[1] / top, 1e-300)
        down: list[tuple[float, float]] = [self.root] * n
        out = [0.0] * n
        for k in range(n):
            if k:
                q = page.parents[k]
                x0, x1 = (down[q][i] * up[q][i] / sent[k][i] for i in (0, 1))
                (a, b), (c, d) = steps[k]
                d0, d1 = x0 * a + x1 * c, x0 * b + x1 * d
                total = d0 + d1
                down[k] = (d0 / total, d1 / total)
            y0, y1 = down[k][0] * up[k][0], down[k][1] * up[k][1]
            out[k] = y1 / (y0 + y1)
        return out


def main_text(html: str, model: TreeModel) -> str:
    page = read(html)
    return "\n".join(t for t, p in zip(page.texts, model.marginals(page), strict=True) if t and p >= 0.5)


class _Maker:
    """Draws pages of many layouts in which every text is known to be content or not."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.known: dict[str, bool] = {}
        self.count = 0

    def text(self, content: bool, least: int, most: int, stop: float = 0.9) -> str:
        r = self.rng
        self.count += 1
        words = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 9))) for _ in range(r.randint(least, most) - 1)]
        out = " ".join([f"w{self.count}", *words]) + ("." if r.random() < stop else "")
        self.known[out.split()[0].rstrip(".")] = content
        return out

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def maybe(self, p: float, s) -> str:
        return s() if self.rng.random() < p else ""

    def menu(self) -> str:
        items = "".join(f"<li><a href='/x'>{self.text(False, 1, 2, 0.1)}</a></li>" for _ in range(self.rng.randint(2, 9)))
        return self.pick("<nav><ul>%s</ul></nav>", "<div class='menu'><ul>%s</ul></div>", "<ul id='nav'>%s</ul>", "<nav class='breadcrumb'><ol>%s</ol></nav>", "<div role='navigation'><ul>%s</ul></div>", "<ul>%s</ul>") % items

    def advert(self) -> str:
        t = self.text(False, 2, 25)
        return self.pick("<div class='ad'>%s</div>", "<div class='advertisement'><p>%s</p></div>", "<div id='sponsored'><a href='/a'>%s</a></div>", "<aside class='promo'><p>%s</p></aside>", "<section class='ad-slot'><p>%s</p></section>") % t

    def notice(self) -> str:
        t = self.text(False, 5, 30)
        return self.pick("<div class='cookie-notice'><p>%s</p><button>w0</button></div>", "<div role='alert'>%s</div>", "<div id='gdpr-consent'>%s</div>", "<div class='newsletter'><p>%s</p></div>", "<div class='notice'>%s</div>", "<dialog><p>%s</p></dialog>") % t

    def form(self) -> str:
        return self.pick("<form class='search'><label>%s</label><input><button>%s</button></form>", "<form><p>%s</p><input><button>%s</button></form>", "<div class='subscribe'><form><label>%s</label><button>%s</button></form></div>") % (self.text(False, 1, 9, 0.5), self.text(False, 1, 2, 0))

    def side(self) -> str:
        inner = f"<h3>{self.text(False, 1, 3, 0)}</h3>" + self.pick(f"<p>{self.text(False, 5, 40)}</p>", "<ul>" + "".join(f"<li><a href='/r'>{self.text(False, 3, 9, 0.2)}</a></li>" for _ in range(self.rng.randint(2, 6))) + "</ul>")
        return self.pick("<aside>%s</aside>", "<div class='sidebar'>%s</div>", "<div id='related'>%s</div>", "<section class='related-posts'>%s</section>", "<aside class='widget'>%s</aside>") % inner

    def reader(self) -> str:
        one = lambda: self.pick("<div class='comment'><p>%s</p></div>", "<li class='comment'><p>%s</p></li>", "<article class='comment'><p>%s</p></article>", "<div class='reply'>%s</div>") % self.text(False, 3, 70)
        inner = f"<h3>{self.text(False, 1, 3, 0)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 6)))
        return self.pick("<section id='comments'>%s</section>", "<div class='comments'>%s</div>", "<ol class='comment-list'>%s</ol>", "<div id='disqus_thread'>%s</div>") % inner

    def share(self) -> str:
        return self.pick("<div class='share'>%s</div>", "<ul class='social'><li><a href='/s'>%s</a></li></ul>", "<div class='post-tags'><a href='/t'>%s</a></div>") % self.text(False, 1, 5, 0)

    def paragraph(self) -> str:
        size = self.rng.choice(((1, 4), (5, 30), (20, 120)))
        t = self.text(True, *size, stop=0.85)
        return self.pick("<p>%s</p>", "<p>%s</p>", "<p>%s</p>", "<p>%s", "<p><b>%s<br>", "<p><a href='/x'>q</a> %s</p>", "<div>%s</div>", "<blockquote><p>%s</p></blockquote>", "<h2>%s</h2>", "<h3>%s</h3>", "<pre>%s</pre>", "<figure><figcaption>%s</figcaption></figure>", "<ul><li>%s</li></ul>", "<ol><li>%s</ol>", "<table><tr><td>%s</td></tr></table>", "<section><p>%s</p></section>") % t

    def article(self) -> str:
        head = self.pick("<h1>%s</h1>", "<h1>%s</h1>", "<header><h1>%s</h1></header>", "<h2>%s</h2>", "") 
        head = head % self.text(True, 2, 14, 0.4) if head else ""
        parts = [self.paragraph() for _ in range(self.rng.choice((1, 2, 3, 6, 12, 25)))]
        for extra in (self.advert, self.side, self.share, self.notice, self.form):
            if self.rng.random() < 0.15:
                parts.insert(self.rng.randint(0, len(parts)), extra())
        return head + "".join(parts)

    def page(self) -> str:
        body = self.pick("<article>%s</article>", "<article>%s</article>", "<main><article class='post'>%s</article></main>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<div id='content'><div class='entry'>%s</div></div>", "<div class='article-body'>%s</div>", "<section class='story'>%s</section>", "<div>%s</div>", "<div id='main'>%s</div>", "<div role='main'>%s</div>") % self.article()
        name = lambda: self.text(False, 1, 6, 0.2)
        top = self.pick("<header>%s</header>", "<div id='header'>%s</div>", "<div class='masthead'>%s</div>", "%s") % (self.maybe(0.4, lambda: f"<div class='logo'>{name()}</div>") + self.maybe(0.8, self.menu))
        foot = self.pick("<footer>%s</footer>", "<footer><p>%s</p></footer>", "<div id='footer'>%s</div>", "<div class='copyright'><p>%s</p></div>") % self.text(False, 2, 40)
        inner = top + self.maybe(0.4, self.notice) + self.maybe(0.5, self.advert) + self.maybe(0.2, self.side) + body + self.maybe(0.3, self.side) + self.maybe(0.4, self.reader) + self.maybe(0.2, self.form) + self.maybe(0.15, self.advert) + self.maybe(0.9, lambda: foot)
        inner = self.pick("%s", "%s", "<div id='wrapper'>%s</div>", "<div class='container'><div class='row'>%s</div></div>", "<div class='page'>%s</div>") % inner
        return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[Page, list[bool]]]:
    """Drawn pages with a label for each node: a run's is known, an element is content if a run in it is."""
    out = []
    for k in range(n):
        maker = _Maker(random.Random(seed * 100_003 + k))
        page = read(maker.page())
        labels = [bool(t) and any(maker.known.get(w.rstrip("."), False) for w in t.split()[:2]) for t in page.texts]
        for i in range(len(labels) - 1, 0, -1):
            if labels[i]:
                labels[page.parents[i]] = True
        out.append((page, labels))
    return out


@cache
def trained(n: int = TRAINING_PAGES, seed: int = SEED) -> TreeModel:
    return TreeModel(labelled_pages(n, seed))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, url, text (blocks joined by newlines, empty if none), n_chars (its code points).

    A null html is empty and has no text. Repeated and null ids and urls pass through; other columns are ignored; an
    empty table gives an empty result. Each page is read whole where it is; the model is a few kilobytes. No shuffle.
    """
    lean(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, 64):
            texts = [main_text(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type(pages, id_col)}, `{url_col}` string, text string, n_chars long")
