import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from plumbago.llm import ctw

DOCS = [(1, "The cat sat"), (2, "the cat  ran\naway"), (3, None), (4, ""), (5, "Über cat"), (6, "the the the"), (7, "unseen words"), (8, "the cat sat"), (9, "x" * 600), (10, " \t "), (4, ""), (12, "a b " * 500)]


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(docs, depth):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = Counter()
    counts = defaultdict(lambda: [0, 0])
    for i, t in docs:
        if held[i]:
            continue
        tokens.update(words(t) + [None])
        body = b"\n" * depth + " ".join(words(t)).encode() + b"\n"
        for k in range(depth, len(body)):
            for l in range(8):
                p, bit = (1 << l) | (body[k] >> (8 - l)), body[k] >> (7 - l) & 1
                for d in range(depth + 1):
                    counts[body[k - d : k], p][bit] += 1
    children = defaultdict(set)
    for ctx, p in list(counts):
        if ctx:
            children[ctx[1:], p].add(ctx)

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(c) + 1)

    @cache
    def weighted(ctx, p):
        own = kt(counts.get((ctx, p), [0, 0]))
        if len(ctx) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, p) for c in children[ctx, p])) - math.log(2)

    def chance(ctx, d, p, bit):
        c = counts.get((ctx[len(ctx) - d :], p), [0, 0])
        own = (c[bit] + 0.5) / (sum(c) + 1)
        if d == depth:
            return own
        w = math.exp(kt(c) - weighted(ctx[len(ctx) - d :], p)) / 2
        return w * own + (1 - w) * chance(ctx, d + 1, p, bit)

    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, t in docs:
        body = b"\n" * depth + " ".join(words(t)).encode() + b"\n"
        lp = sum(math.log10(chance(body[k - depth : k], 0, (1 << l) | (body[k] >> (8 - l)), body[k] >> (7 - l) & 1)) for k in range(depth, len(body)) for l in range(8))
        seq = words(t) + [None]
        out.append((i, held[i], len(seq), sum(tokens[w] > 0 for w in seq), n, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in seq), lp))
    return out


@pytest.mark.parametrize("entries,slice_bytes", [(10**6, 1), (60, 300), (0, 10**9)])
def test_equals_brute_force(spark, entries, slice_bytes):
    df = spark.createDataFrame([(*d, "c") for d in DOCS], "doc_id long, text string, score string").repartition(3)
    got = sorted(tuple(r)[:7] for r in ctw.language_scores(df, depth=3, broadcast_entries=entries, slice_bytes=slice_bytes).collect())
    want = sorted(brute(DOCS, 3))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-8)


def test_chances_of_all_next_bytes_sum_to_one(spark):
    text = b"abracadabra abracadabra"
    window, _ = ctw.streams([[text[:11], text[12:]]], 2)
    seen = dict(zip(*np.unique(window, return_counts=True), strict=True))
    context = int(window[5]) >> 8
    rows = {(context << 8) | b: 0 for b in range(256)} | {int(k): int(n) for k, n in seen.items()}
    df = spark.createDataFrame([*rows.items()], "key long, n long")
    lp = {r["key"]: r["lp"] for r in ctw.byte_chances(df, 2).collect()}
    assert sum(10 ** lp[(context << 8) | b] for b in range(256)) == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10.5, 1e3, 1e9])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


def test_many_batches_and_slices(spark):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(i % 50)) for i in range(700)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    a, b = (sorted(map(tuple, ctw.language_scores(df, depth=2, broadcast_entries=e, slice_bytes=20_000).collect())) for e in (10**6, 0))
    assert len(a) == len(b) == 700
    assert all(x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9) for x, y in zip(a, b, strict=True))


def test_empty_table(spark):
    assert ctw.language_scores(spark.createDataFrame([], "doc_id long, text string"), broadcast_entries=-1).count() == 0
    assert ctw.language_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_id_trains_and_is_scored(spark):
    r = ctw.language_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), depth=3).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (False, 3, 3, 3)


def test_better_than_the_base_on_held_out_text(spark):
    rows = ctw.language_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
