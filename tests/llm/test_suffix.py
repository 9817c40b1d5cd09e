import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbago.llm import suffix
from plumbago.llm.entry import op10_suffix_dedup


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=60))
def test_suffix_array(values):
    s = np.array(values, np.int64)
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: values[i:])


def test_suffix_array_of_large_alphabets():
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(1, 1 << 40, 200)] * 2)
    assert suffix.suffix_array(s).tolist() == sorted(range(400), key=lambda i: s[i:].tolist())


def test_anchors_follow_content():
    rng = random.Random(4)
    core = bytes(rng.randrange(97, 100) for _ in range(90))
    for _ in range(50):
        a, b = (bytes(rng.randrange(97, 100) for _ in range(rng.randint(0, 80))) for _ in range(2))
        places = []
        for text in (a + core + b, core):
            anchor, first, last = suffix.anchors(np.frombuffer(text, np.uint8), 60)
            chosen = np.repeat(anchor, last - first + 1)
            at = text.index(core)
            places.append((chosen[at : at + 31] - at).tolist())
        assert places[0] == places[1]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    texts = [None, "", "x", "ab" * 150, "ab" * 151, "é" * 90, "z" * 300, "z" * 70]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        if rng.random() < 0.4:
            p = rng.choice(passages)
            parts.append(p[: len(p) // 2] + rng.choice(["", "Q"]) + p[len(p) // 2 :])
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    return texts + rng.sample(texts, 6) + [texts[-1] + "!"]


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 2), (3, 2000), (4, 0)])
def test_equals_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, kept string").repartition(3)
    got = {r[0]: tuple(r)[1:5] for r in suffix.remove_repeats(df, length=80, hot=hot).collect()}
    assert got == dict(enumerate(brute(texts, 80)))


def brute_words(texts, length):
    runs = [[m.span() for m in re.finditer(rb"[^\t-\r ]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in r] for t, r in zip(texts, runs, strict=True)]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for t, r, w in zip(texts, runs, words, strict=True):
        data = (t or "").encode()
        gone, out = np.zeros(len(data), bool), np.zeros(len(w) + 1, bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                out[i : i + length] = True
        for i, (a, b) in enumerate(r):
            if out[i]:
                gone[a : r[i + 1][0] if out[i + 1] else b] = True
        yield int(gone.sum()), bytes(b for b, g in zip(data, gone, strict=True) if not g)


@pytest.mark.parametrize("seed,hot", [(11, 2000), (12, 1)])
def test_words_equal_brute_force(spark, seed, hot):
    texts = [*corpus(seed), "a " * 40, "\n".join("abcdefghijkl") + " q", "x\t" + "\n".join("abcdefghijkl")]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(df, length=12, words=True, hot=hot).collect()}
    want = dict(enumerate(brute_words(texts, 12)))
    assert got == want and sum(n > 0 for n, _ in want.values()) > 20


def test_long_and_uniform_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range((1 << 20) + 900))
    texts = [long, "<" + long[500_000:500_400] + ">", "<" + long[1_048_300:1_048_999] + ">", "<" + long[70:469] + ">", "y" * 300_000]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: (400 + 699, 2), 1: (400, 1), 2: (699, 1), 3: (0, 0), 4: (300_000, 1)}


def test_sorting_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SORT_STRETCHES", 5)
    texts = corpus(7)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:5] for r in suffix.remove_repeats(df, length=80).collect()}
    assert got == dict(enumerate(brute(texts, 80)))


def test_rows_and_kept_columns(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(500))
    df = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, "own", 3)], "doc_id long, text string, n int")
    got = sorted((r["n"], r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(df, keep=("n",)).collect())
    assert got == [(1, 500, b""), (2, 500, b""), (3, 0, b"own")]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op10_suffix_dedup(spark, sf).collect()
    assert {r[0]: tuple(r)[1:5] for r in rows} == dict(zip([r[0] for r in docs], brute([r[1] for r in docs], 400), strict=True))
    removed = {d: n for d, (n, _) in zip([r[0] for r in docs], brute_words([r[1] for r in docs], 50), strict=True)}
    assert {r["doc_id"] for r in rows if r["n_passage_words"]} == {d for d, n in removed.items() if n}
    assert all(r["n_passage_words"] == 0 or r["n_passage_words"] >= 50 for r in rows)
