"""Like texts, paths and formulas against plain versions of small size."""

import math
import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from plumbago.functions import formulas
from plumbago.operators import likeness as L
from plumbago.operators import paths as P


def cosines(texts):
    """{(i, j): cosine}, all pairs of texts with words."""
    bags = {i: Counter(w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in L.STOP_WORDS) for i, t in texts}
    n = sum(bool((t or "").strip()) for _, t in texts)
    df = Counter(w for b in bags.values() for w in b)
    vec = {i: {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in b.items()} for i, b in bags.items() if b}
    size = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    return {(i, j): sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / size[i] / size[j] for i in vec for j in vec if i < j}


def some_texts():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    texts = [" ".join(w if rng.random() > 0.08 else f"w{rng.randrange(60)}" for w in rng.choice(base)) for _ in range(150)]
    texts += ["w1 W2 w3"] * 60 + ["w3, w2; w1!"] * 5 + [None, "", "  ", "the of and", "the", "ärger über öl", "Ärger öl über", "word " * 30000 + "w1"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_and_rows_that_stay_equal_all_pairs(spark):
    texts = some_texts()
    near = {p for p, c in cosines(texts).items() if c > 0.85}
    stay = []
    for i, _ in texts:
        if not any((k, i) in near for k in stay):
            stay.append(i)
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "n int, text string, digest string, size int").repartition(3)
    out = L.distinct_texts(rows, "n")
    assert sorted(r["n"] for r in out.collect()) == stay and out.columns == rows.columns
    first = {r["first"] for r in L.classes(rows, "n").collect()}
    assert {(r["first"], r["later"]) for r in L.like_texts(rows, "n").collect()} == {p for p in near if set(p) <= first}
    assert len(near) > 500


def test_slices_and_rare_words_give_the_same_and_no_meeting_is_written(spark, monkeypatch):
    texts = some_texts()
    near = {p: c for p, c in cosines(texts).items() if c > 0.85}
    rows = spark.createDataFrame(texts, "n int, text string").repartition(3)
    for head, size, meetings in ((1 << 20, 300, 50), (7, 1 << 21, 1 << 20), (0, 30, 1)):  # many slices; words beyond the head; all of them
        written = {}
        monkeypatch.setattr(L, "stored", lambda df, label, written=written: written.setdefault(label, df.localCheckpoint()))
        for name, value in (("HEAD", head), ("SLICE", size), ("MEETINGS", meetings)):
            monkeypatch.setattr(L, name, value)
        first = {r["first"] for r in L.classes(rows, "n").collect()}
        written.clear()
        got = {(r["first"], r["later"]): r["cosine"] for r in L.like_texts(rows, "n").collect()}
        assert got.keys() == {p for p in near if set(p) <= first} and all(abs(c - near[p]) < 1e-9 for p, c in got.items())
        assert set(written) - {"bags"} == {"classes", "slices", "links"} and (head != 1 << 20 or written["slices"].count() > 1)


def test_rows_that_stay_are_read_once_and_move_no_text(spark, tmp_path):
    spark.createDataFrame([(i, "some like words", "x") for i in range(50)] + [(50, None, "y")], "n int, text string, more string").write.parquet(f"{tmp_path}/rows")
    out = L.distinct_texts(spark.read.parquet(f"{tmp_path}/rows"), "n")
    assert sorted(tuple(r) for r in out.collect()) == [(0, "some like words", "x"), (50, None, "y")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Union" not in plan and plan.count(f"{tmp_path}/rows") <= 1 and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_empty_and_wordless_tables(spark):
    for texts in ([], [(1, None)], [(1, "the"), (2, "the")]):
        rows = spark.createDataFrame(texts, "n int, text string")
        assert L.like_texts(rows, "n").count() == 0 and L.distinct_texts(rows, "n").count() == len(texts)


def shortest(links, a, b):
    """The least of the shortest paths."""
    out = {}
    for s, t in links:
        out.setdefault(s, set()).add(t)
    far, queue = {b: 0}, deque([b])
    into = {}
    for s, t in links:
        into.setdefault(t, set()).add(s)
    while queue:
        x = queue.popleft()
        for y in into.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    if a not in far:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min(y for y in out[path[-1]] if far.get(y) == far[path[-1]] - 1))
    return path


def test_shortest_paths_equal_a_serial_search(spark):
    rng = random.Random(2)
    ids = [f"n{i:02}" for i in range(60)]
    links = [tuple(rng.choices(ids, k=2)) for _ in range(160)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(9)]
    pairs = [tuple(rng.choices(ids, k=2)) for _ in range(30)] + [("a", "c"), ("a", "a"), ("c", "b"), ("c00", "c09"), ("c09", "c00"), ("a", "nowhere"), ("x", "x"), ("a", "c")]
    edges = spark.createDataFrame(links + chain + [(None, "a"), ("a", None)], "source string, target string")
    got = {(r["a"], r["b"]): r["path"] for r in P.shortest(edges, spark.createDataFrame(pairs + [(None, "a")], "a string, b string")).collect()}
    want = {p: w for p in pairs if (w := shortest(links + chain, *p))}
    assert got == want and max(map(len, want.values())) >= 10 and len(want) < len(set(pairs))
    assert P.shortest(edges.limit(0), spark.createDataFrame([("a", "b")], "a string, b string")).count() == 0


def test_walks_and_selected_paths(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]
    edges = spark.createDataFrame(links, "source string, target string")
    starts = spark.createDataFrame([(i, x) for i, x in enumerate("abcde" * 4)], "walk int, id string")
    got = {r["walk"]: r["path"] for r in P.walks(edges, starts, 4).collect()}
    assert len(got) == 20 and got == {r["walk"]: r["path"] for r in P.walks(edges.repartition(3), starts, 4).collect()}
    for k, path in got.items():
        assert path[0] == "abcde"[k % 5] and all(step in links for step in zip(path, path[1:])) and (len(path) == 5 or path[-1] == "d")
    assert len({tuple(p) for p in got.values()}) > 5  # walks of one start differ
    scores = spark.createDataFrame([("a", 3.0), ("d", 2.0), ("e", 1.0), ("b", 1.0)], "id string, score double")
    out = [tuple(r) for r in P.selected(edges, scores, most=5, central=2).orderBy("place").collect()]
    assert out[0] == (0, "shortest", ["a", "b", "c", "d"]) and all(k == "walk" and len(p) > 1 for _, k, p in out[1:]) and len(out) > 1
    assert P.selected(edges.limit(0), scores.limit(0)).count() == 0 and P.selected(edges, scores.limit(1)).count() == 0


def test_a_step_of_walks_moves_lists_and_no_row_for_each_neighbour(spark, monkeypatch):
    hub = [("h", f"n{i}") for i in range(300)] + [(f"n{i}", "h") for i in range(300)] + [("h", None)]
    edges = spark.createDataFrame(hub, "source string, target string")
    starts = spark.createDataFrame([(i, "h") for i in range(200)], "walk int, id string")
    sizes = []
    monkeypatch.setattr(P, "stored", lambda df, label="round": sizes.append((label, df.count())) or df.localCheckpoint())
    walked = {}
    for size in (4096, 7):  # lists of one node, and of parts of it
        monkeypatch.setattr(P, "NEIGHBOURS", size)
        walked[size] = {r["walk"]: r["path"] for r in P.walks(edges, starts, 3).collect()}
    assert walked[7] == walked[4096] and sizes[0] == ("lists", 301)
    rows = spark.createDataFrame([(k, f"n{i}") for k in range(200) for i in range(300)], "walk int, target string")
    want = rows.groupBy("walk").agg(F.min_by("target", F.xxhash64(F.lit(42), "walk", F.lit(1), "target")).alias("t"))
    first = {r["walk"]: r["t"] for r in want.collect()}
    assert {k: p[1] for k, p in walked[7].items() if p[1]} .items() <= first.items() and len({p[1] for p in walked[7].values()}) > 50


GOOD = ["x + 1", "2xy", "a*b/c", "-(x)", "--x", "f(x) + 2", "(a)(b)", "x^2 - 3.5", "2**10", "a//b", "1e5*k", ".5 - y", "a b", "sin(x)*cos(y)", "+x - -y", "((a))", "7 % 3", "1. + 2", "E mc^2"]
BAD = ["x", "x +", "* x y", "(x", "x)", "a = b", "()", "f()", "a..b", "for x", "the words of it", "a . b", "007 + 1", ")(", "a * / b", "a */ b", "(+)", "x!", "", "   ", None, "x and y", "a (* b)", "12", "2x"]


def parsed(text):
    """A serial parser by descent: sum of products of signed atoms."""
    tokens = re.findall(formulas.TOKEN, text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def atom():
        nonlocal at
        t = peek()
        if t == "(":
            at += 1
            total()
            if peek() != ")":
                raise ValueError
            at += 1
        elif t and re.match(r"\.?[0-9A-Za-z]", t) and t not in formulas.KEYWORDS and not re.fullmatch("0+[1-9][0-9]*", t):
            at += 1
        else:
            raise ValueError

    def signed():
        nonlocal at
        while peek() in ("+", "-"):
            at += 1
        atom()
        while (t := peek()) == "(" or t and re.match(r"\.?[0-9A-Za-z]", t):
            atom()

    def total():
        nonlocal at
        signed()
        while peek() in ("+", "-", "*", "/", "%", "^", "**", "//"):
            at += 1
            signed()

    try:
        total()
    except ValueError:
        return False
    return at == len(tokens)


def test_formulas(spark):
    rows = spark.createDataFrame([(t, True) for t in GOOD] + [(t, False) for t in BAD], "t string, want boolean")
    assert [r["t"] for r in rows.where(formulas.is_formula(F.col("t")) != F.col("want")).collect()] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_expressions_equal_a_parser(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["x", "2", "ab", "(", ")", "+", "-", "*", "**", "/", "^", " ", ".5", "(a)", "in", "=", "."][: rng.choice([9, 15, 17])]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", formulas.is_expression(F.col("t")).alias("x")).collect()
    assert [r["t"] for r in got if r["x"] != parsed(r["t"])] == [] and 200 < sum(r["x"] for r in got) < 2500


def test_a_long_text_takes_linear_time(spark):
    long = "(" * 200_000 + "x" + ")" * 200_000
    assert spark.createDataFrame([(long,), (long + ")",)], "t string").select(formulas.is_formula(F.col("t")).alias("x")).collect() == [(True,), (False,)]
