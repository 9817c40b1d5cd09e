import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbago.llm import simhash
from plumbago.llm.components import components
from plumbago.llm.entry import op3_simhash

SF = "/root/testdata/sf0.001"


def slow_print(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius=4):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in prints}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r[0], slow_print(r[1])) for r in docs]
    comp = slow_components(prints)
    got = op3_simhash(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", comp[i]) for i, p in prints)


def test_edge_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (9, " \t\x0b", 1), (4, "One two", 1), (6, "one  TWO", 1), (7, "w " * 9000, 1), (7, "w w w w", 1), (None, "lone text here", 1)]
    got = {(r[0], r[1]): r[2] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    assert got[(5, "0" * 16)] == got[(3, "0" * 16)] == got[(9, "0" * 16)] == 3
    assert got[(6, f"{slow_print('one two'):016x}")] == 4
    assert len(got) == 7
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_near_pair_shares_a_shard():
    rng = random.Random(3)
    keys = simhash.shard_keys()
    pick = lambda v: [tuple(v >> a & ((1 << n) - 1) for a, n in k) for k in keys]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(x == y for x, y in zip(pick(a), pick(b), strict=True))


def test_large_shards_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    center, prints = rng.getrandbits(64), set()
    for _ in range(400):
        v = center
        for bit in rng.sample(range(64), rng.randint(1, 9)):
            v ^= 1 << bit
        prints.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    want = slow_components([(signed(v), v) for v in prints])
    monkeypatch.setattr(simhash, "TREE", 16)
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(df)).collect()}
    full = {signed(v): roots.get(signed(v), signed(v)) for v in prints}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == g) for g in set(m.values()))
    assert groups(full) == groups(want)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 20))
def test_tree_finds_what_brute_force_finds(values, radius):
    fp = np.array(values, np.uint64)
    tree = simhash.BKForest(np.zeros(len(fp), np.int64), fp)
    got = {(int(a), int(b)) for q, n in tree.near(fp, np.zeros(len(fp), np.int64), radius) for a, b in zip(q, n, strict=True)}
    assert got == {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= radius}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7, 7), (5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 1 and len(set(got.values())) == 3
    assert 5000 not in got
