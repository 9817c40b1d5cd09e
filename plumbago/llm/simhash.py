"""SimHash near-duplicates: fingerprints, and BK-trees over shards of them that must share bits to be near."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, carried, id_and_text, id_type, restored, slices, stored
from .components import Forest, components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one tree. A larger shard is held as several trees, and each of its fingerprints asks all of them.
TREE = 4096
#: (query, node) visits handled at once by a task: 16 MB for each of some five arrays.
FRONTIER = 1_000_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits as an unsigned number; a bit is set where it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, SEED)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: Sequence[str] = ()) -> DataFrame:
    """(id, fp long, keep0, ...): the 64 bits as a signed number, and carried columns. No shuffle."""
    extra, more, names = carried(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps), *(b.column(n) for n in names)], ["id", "fp", *names])

    return id_and_text(docs, id_col, text_col, extra).mapInArrow(run, f"id {id_type(docs, id_col)}, fp long{more}")


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of nearly equal blocks."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Bit ranges, each list making one shard key of a fingerprint.

    Of radius + 1 blocks, one is free of differing bits; the others hold them all, so of radius + 1 blocks of what is
    left, one is free too. Near fingerprints thus agree in at least one of (radius + 1)^2 keys of some 23 of 64 bits.
    """
    keys = []
    for first, n in _blocks(64, radius + 1):
        rest = [b for b in range(64) if not first <= b < first + n]
        for at, m in _blocks(len(rest), radius + 1):
            bits = rest[at : at + m]
            runs, start = [], bits[0]
            for x, y in zip(bits, [*bits[1:], -1], strict=True):
                if y != x + 1:
                    runs.append((start, x - start + 1))
                    start = y
            keys.append([(first, n), *runs])
    return keys


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """BK-trees of many shards at once: a node's children are keyed by their Hamming distance to it, one a distance."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: numbers 0..k-1 in ascending order; the first fingerprint of each is its root."""
        self.fp, n = fp, len(fp)
        self.root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        self.shard_of = shard
        at = self.root[np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1] if n else np.empty(0, np.int64)
        waiting = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        parents, edges, children = [], [], []
        at = at[waiting] if n else at
        while len(waiting):
            slot = at * 65 + distance(fp[waiting], fp[at])
            order = np.argsort(slot, kind="stable")
            slot, waiting = slot[order], waiting[order]
            first = np.r_[True, slot[1:] != slot[:-1]]
            child = waiting[first]
            parents.append(slot[first] // 65)
            edges.append(slot[first])
            children.append(child)
            at = child[np.cumsum(first) - 1][~first]
            waiting = waiting[~first]
        slots = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(slots)
        self.slot = slots[order]
        self.child = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def near(self, query: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) pairs within the radius, in pieces; root: the tree that each query asks."""
        work = [(np.arange(i, min(i + FRONTIER // 8, len(query))), root[i : i + FRONTIER // 8]) for i in range(0, len(query), FRONTIER // 8)]
        while work:
            q, node = work.pop()
            d = distance(query[q], self.fp[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), side="right")
            width = hi - lo
            total = np.cumsum(width)
            start = 0
            while start < len(q):
                base = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, base + FRONTIER, side="right")))
                w = width[start:stop]
                if w.sum():
                    offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                    work.append((np.repeat(q[start:stop], w), self.child[np.repeat(lo[start:stop], w) + offset]))
                start = stop


def _search(radius: int):
    """Rows (shard, tree, asks, fp) sorted by shard and tree -> links, a spanning forest for each run of trees."""

    def links(shard: np.ndarray, asks: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        values, row = np.unique(fp, return_inverse=True)
        change = np.r_[True, shard[1:] != shard[:-1]]
        number = np.cumsum(change) - 1
        forest, held = Forest(len(values)), ~asks
        tree = BKForest(number[held], fp[held].view(np.uint64))
        root_of = np.full(number[-1] + 1, -1)
        root_of[tree.shard_of[tree.root]] = tree.root
        node_row, root = row[held], root_of[number]
        live = root >= 0
        for q, node in tree.near(fp[live].view(np.uint64), root[live], radius):
            forest.join(row[live][q], node_row[node])
        r = forest.roots()
        moved = r != np.arange(len(values))
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[r[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "fp")]
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)] if rest else new
            last = int(np.searchsorted(rest[0], rest[0][-1]))
            if last > 200_000 or (last and len(rest[0]) > 400_000):
                yield links(*[x[:last] for x in rest])
                rest = [x[last:] for x in rest]
        if rest:
            yield links(*rest)

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of distinct fingerprints prints(fp long) that span the components of the radius.

    Each fingerprint goes to its (radius + 1)^2 shards. A shard of up to TREE fingerprints is one tree that all of them
    ask. Larger shards are held as several trees, each of which all fingerprints of the shard ask in blocks of
    8 * TREE: no task's memory grows with a shard, and no pair is lost.
    """

    def bits(runs):
        key = None
        for first, n in runs:
            part = F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << n) - 1}L")
            key = part if key is None else F.shiftleft(key, n).bitwiseOR(part)
        return key

    keys = F.array(*[F.shiftleft(bits(runs), 6).bitwiseOR(F.lit(i).cast("long")) for i, runs in enumerate(shard_keys(radius))])
    rows = prints.select("fp", F.explode(keys).alias("key"))
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    rows = rows.join(sizes, "key")
    trees = F.expr(f"cast(ceil(n / {TREE}) as int)")
    own = F.pmod(F.xxhash64("fp", "key"), trees).cast("int")
    block = F.expr(f"cast(pmod(xxhash64(fp, key, 1), cast(ceil(n / {8 * TREE}) as int)) as int)")
    blocks = F.expr(f"cast(ceil(n / {8 * TREE}) as int)")
    small = rows.where(f"n <= {TREE}").select(F.xxhash64("key").alias("shard"), F.col("key"), F.lit(0).alias("tree"), F.lit(0).alias("block"), F.lit(False).alias("asks"), "fp")
    large = rows.where(f"n > {TREE}")
    held = large.select("key", own.alias("tree"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(False).alias("asks"), "fp")
    asking = large.select("key", F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree"), block.alias("block"), F.lit(True).alias("asks"), "fp")
    big = held.unionAll(asking).select(F.xxhash64("key", "tree", "block").alias("shard"), "key", "tree", "block", "asks", "fp")
    dealt = small.unionAll(big).repartition("shard").sortWithinPartitions("shard", "key", "tree", "block")
    return dealt.select("shard", "asks", "fp").mapInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable by links).

    Fingerprints link at radius or fewer differing bits. Copies share a fingerprint, so the search sees each once;
    components are of fingerprints, and the least id of each is a partial aggregate. A text of fewer words than a
    shingle is one shingle; null, empty and blank texts have fingerprint zero and link like any other. Ids that are
    null keep their row and never name a component. Extra columns are ignored; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(_named(prints, radius), "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, least) of each distinct fingerprint of prints(id, fp): its component's root, its own least id."""
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(least.select("fp"), radius))
    return stored(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")


def _named(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of prints(id, fp)."""
    known = _roots(prints, radius)
    first = stored(known.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return stored(known.select("fp", "root").join(first, "root").select("fp", "component_id"), "names")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row, all columns, of each component: that with the least id, then the least digest of the text.

    Rows without an id stay only if no row with an id is linked to them, and then one a component. Rows that repeat an
    id in several components stay, one for each. What is compared are ids and digests; texts are not shuffled for it.
    """
    extra_names = docs.columns
    full = fingerprints(docs, id_col, text_col, size, extra_names)
    at = extra_names.index(text_col)
    full = full.withColumn("digest", F.sha2(F.coalesce(F.col(f"keep{at}").cast("string"), F.lit("")), 256))
    prints = stored(full.select("id", "fp", "digest"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "digest")).alias("m")
    roots = _roots(prints, radius)
    best = stored(prints.join(roots, "fp").groupBy("root").agg(first).select("root", F.col("m.id").alias("best_id"), F.col("m.digest").alias("best_digest")), "best")
    named = stored(roots.join(best, "root"), "named")
    kept = full.join(named, "fp").where(F.col("id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest")))
    copies = prints.join(named, "fp").where(F.col("id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest"))).groupBy("root").count().where("count > 1")
    if not copies.isEmpty():
        kept = kept.dropDuplicates(["root"])
    return kept.select(*restored([f"keep{i}" for i in range(len(extra_names))], extra_names))
