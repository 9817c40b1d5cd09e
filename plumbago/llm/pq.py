"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, exact cosine rerank."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, stored
from .components import Forest, components

THRESHOLD = 0.95
#: Vectors that the index is fitted on, those with the least hash, or EACH a cell if that is more (262,144 at most);
#: subspaces and codes of each; rows of a block.
SAMPLE, EACH, SUBSPACES, CODES, BLOCK = 20_000, 4, 8, 256, 2048
#: Cells: the square root of the number of distinct vectors, or one for each FULL of them if that is more. The centres
#: are broadcast, so they have a bound; beyond FULL * MOST_CELLS vectors cells grow and are searched in more blocks.
FULL, MOST_CELLS = 1024, 65_536
#: A cell is probed if its border is within so many standard deviations of what a near vector's offset, spread evenly
#: over the dimensions, has across that border.
SIGMAS = 3.0


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        full = n > 0
        centers[full] = sums[full] / n[full, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(1) / 2
    return np.concatenate([np.argmin(half - part @ centers.T, axis=1) for part in np.array_split(x, max(1, len(x) * len(centers) // 2_000_000))])


def cell_centers(x: np.ndarray, k: int) -> np.ndarray:
    """k centres: by k-means, or for many by k-means of the sqrt(k) parts that a first k-means makes, by their sizes."""
    if k <= 1024:
        return kmeans(x, k)
    top = nearest(x, kmeans(x, round(math.sqrt(k))))
    parts = [x[top == i] for i in np.unique(top)]
    return np.concatenate([kmeans(p, max(1, round(k * len(p) / len(x)))) for p in parts])[:MOST_CELLS]


@dataclass
class Index:
    centers: np.ndarray
    books: list[np.ndarray]
    reach: float

    @classmethod
    def fitted(cls, sample: np.ndarray, cells: int, threshold: float = THRESHOLD, sigmas: float = SIGMAS) -> Index:
        """sample: unit vectors. reach: the largest distance of two unit vectors at the threshold."""
        centers = cell_centers(sample, cells)
        residual = sample - centers[nearest(sample, centers)]
        books = [kmeans(residual[:, part], CODES) for part in _parts(sample.shape[1])]
        return cls(centers, books, math.sqrt(max(0.0, 2 - 2 * threshold)))

    def probes(self, x: np.ndarray, cell: np.ndarray, margin: float) -> list[np.ndarray]:
        """The cells whose border with each vector's own cell is within the margin, its own among them."""
        out: list[np.ndarray] = []
        norm = (self.centers * self.centers).sum(1)
        step = max(1, 2_000_000 // len(self.centers))
        for k in range(0, len(x), step):
            part, home = x[k : k + step], cell[k : k + step]
            square = norm - 2 * part @ self.centers.T
            apart = norm[home][:, None] + norm - 2 * self.centers[home] @ self.centers.T
            rows = np.arange(len(part))
            near = square - square[rows, home][:, None] <= 2 * margin * np.sqrt(np.maximum(apart, 1e-30))
            near[rows, home] = True
            out += [np.flatnonzero(row) for row in near]
        return out

    def coded(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector to what its code stands for)."""
        residual = x - self.centers[cell]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(_parts(x.shape[1]), self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((residual - back) ** 2).sum(1))

    def tables(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """Squared distances of each query's residual to every code of each subspace."""
        r = x - self.centers[cell]
        return [((r[:, p] ** 2).sum(1)[:, None] - 2 * r[:, p] @ b.T + (b * b).sum(1)) for p, b in zip(_parts(x.shape[1]), self.books, strict=True)]


def _parts(width: int) -> list[slice]:
    m = min(SUBSPACES, width)
    return [slice(width * i // m, width * (i + 1) // m) for i in range(m)]


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """(id, node, dim, vec): node names the exact vector; null where there is nothing to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                nodes, dims, blobs = [], [], []
                for value in part.column("vec").to_pylist():
                    x = np.array(value, np.float64) if value and None not in value else np.empty(0)
                    peak = np.abs(x).max(initial=0)
                    if not len(x) or not np.isfinite(x).all() or peak == 0:
                        nodes.append(None), dims.append(None), blobs.append(None)
                        continue
                    x = x / 2.0 ** np.frexp(peak)[1] + 0.0  # exact, and no square of it overflows or vanishes
                    blob = x.tobytes()
                    nodes.append(int.from_bytes(hashlib.sha256(blob).digest()[:8], "little", signed=True))
                    dims.append(len(x)), blobs.append(blob)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(nodes, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["id", "node", "dim", "vec"])

    return rows.mapInArrow(run, f"id {kind}, node long, dim int, vec binary")


def _assigner(shared, sigmas: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        margin = sigmas * index.reach / math.sqrt(index.centers.shape[1])
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                x = _unit(part.column("vec").to_pylist())
                cell = nearest(x, index.centers)
                codes, error = index.coded(x, cell)
                probes = index.probes(x, cell, margin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("size"), part.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(cell.astype(np.int32)), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))],
                    ["node", "size", "vec", "codes", "error", "home", "probes"],
                )

    return run


def _searcher(shared, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        index: Index = shared.value
        cell = table.column("cell")[0].as_py()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        held, query = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        none = pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "n"])
        if not len(held) or not len(query):
            return none
        hx, qx = _unit(held.column("vec").to_pylist()), _unit(query.column("vec").to_pylist())
        hn, qn = (t.column("node").to_numpy() for t in (held, query))
        hs, qs = (t.column("size").to_numpy() for t in (held, query))
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(hn), -1)
        limit = (index.reach + 1e-9 + held.column("error").to_numpy()) ** 2 + 1e-9
        tables = index.tables(qx, cell)
        home = query.column("home").to_numpy()
        counts_q, counts_h = np.zeros(len(qn), np.int64), np.zeros(len(hn), np.int64)
        homes, home = np.unique(home, return_inverse=True)
        back = np.zeros((len(hn), len(homes)), bool)  # whether a held vector asks a query's cell itself
        lists = held.column("probes").combine_chunks()
        row_of, asked = np.repeat(np.arange(len(hn)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(homes, asked), len(homes) - 1)
        back[row_of[homes[at] == asked], at[homes[at] == asked]] = True
        nodes, row = np.unique(np.concatenate([qn, hn]), return_inverse=True)
        forest = Forest(len(nodes))
        for start in range(0, len(qn), 256):
            q = slice(start, start + 256)
            near = tables[0][q][:, codes[:, 0]].copy()
            for m in range(1, len(tables)):
                near += tables[m][q][:, codes[:, m]]
            i, j = np.nonzero(near <= limit)
            i += start
            keep = qn[i] != hn[j]
            i, j = i[keep], j[keep]
            cosine = np.empty(len(i))
            for k in range(0, len(i), 65536):
                cosine[k : k + 65536] = np.einsum("ij,ij->i", qx[i[k : k + 65536]], hx[j[k : k + 65536]])
            hit = cosine >= threshold
            i, j = i[hit], j[hit]
            np.add.at(counts_q, i, hs[j])
            once = ~back[j, home[i]]
            np.add.at(counts_h, j[once], qs[i[once]])
            forest.join(row[i], row[len(qn) + j])
        roots = forest.roots()
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        full_q, full_h = counts_q > 0, counts_h > 0
        a = np.concatenate([qn[full_q], hn[full_h], nodes[moved]])
        n = np.concatenate([counts_q[full_q], counts_h[full_h], np.zeros(len(moved), np.int64)])
        b = pa.array(np.concatenate([np.zeros(len(a) - len(moved), np.int64), nodes[roots[moved]]]), mask=np.arange(len(a)) < len(a) - len(moved))
        return pa.table([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, sigmas: float = SIGMAS) -> DataFrame:
    """One row per row of table: id, n_links, component_id, kept (id = component_id).

    Vectors link at a cosine of the threshold or above, in double precision. Equal vectors are one class, searched
    once: n_links counts the rows of every linked class and the other rows of its own. Vectors that are null, empty or
    zero, or hold a null or non-finite component, link with nothing. Vectors of unequal length don't link; each length
    has an index of its own. Rows with a null id keep their row and never name a component.

    An index is fitted on `sample` vectors and holds all of them. Each vector asks the lists of the cells whose border
    is near (see SIGMAS); within a list, table look-ups give its distance to every coded vector, which may err by the
    coded vector's own quantisation error and no more: that bound loses no pair, and what passes is compared exactly.
    Recall is lost only where a near vector lies beyond an unprobed border. Lists and queries meet in blocks of BLOCK
    by BLOCK, so a crowded cell is many tasks; what leaves a block are counts and a spanning forest, never its pairs.
    """
    rows = stored(_vectors(table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")), id_type(table, id_col)), "vectors")
    facts = None
    for dim in sorted(r["dim"] for r in rows.where("node is not null").select("dim").distinct().collect()):
        classes = rows.where(F.col("dim") == dim).groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("id").alias("least"))
        found = _linked(stored(classes, "vector-classes"), threshold, sample, sigmas)
        facts = found if facts is None else facts.unionByName(found)
    if facts is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = F.col("k").isNotNull()
    component = F.when(known & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = rows.join(facts, (rows["node"] == facts["k"]) & (rows["dim"] == facts["d"]), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, threshold: float, sample: int, sigmas: float) -> DataFrame:
    """(k, d, n_links, component_id) of each distinct vector of classes(node, vec, size, least), all of one length."""
    spark = classes.sparkSession
    total = classes.count()
    n_cells = max(1, min(MOST_CELLS, max(round(math.sqrt(total)), total // FULL)))
    sample = max(sample, EACH * n_cells)
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vec").collect()
    index = Index.fitted(_unit([bytes(r["vec"]) for r in chosen]), n_cells, threshold)
    shared = spark.sparkContext.broadcast(index)
    coded = stored(classes.select("node", "size", "vec").mapInArrow(_assigner(shared, sigmas), "node long, size long, vec binary, codes binary, error double, home int, probes array<int>"), "coded")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    held = coded.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n_held"))
    asking = coded.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.count("*").alias("n_asking"))
    cells = F.broadcast(stored(held.join(asking, "cell").select("cell", blocks("n_held").alias("nh"), blocks("n_asking").alias("nq")), "cells"))  # MOST_CELLS rows at most
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    what = ["node", "size", "vec", "codes", "error", "home", "probes"]
    lists = coded.join(cells, coded["home"] == cells["cell"]).select("cell", own("nh").alias("h"), every("nq").alias("q"), F.lit(False).alias("asks"), *what)
    asked = coded.withColumn("cell", F.explode("probes")).join(cells, "cell").select("cell", every("nh").alias("h"), own("nq").alias("q"), F.lit(True).alias("asks"), *what)
    found = stored(lists.unionByName(asked).groupBy("cell", "h", "q").applyInArrow(_searcher(shared, threshold), "a long, b long, n long"), "found")
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "n")
    named = stored(classes.select("node", "size", "least").join(linked, "node", "left").join(roots, F.col("node") == F.col("n"), "left").select("node", "least", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    width = len(index.centers[0])
    return stored(named.join(least, "root").select(F.col("node").alias("k"), F.lit(width).alias("d"), "n_links", "component_id"), "facts")
