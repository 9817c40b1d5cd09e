"""Connected components by randomised contraction: linear space, a logarithmic number of rounds, no key that grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class Forest:
    """Union-find over the rows 0..n-1 of one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = q
                return q
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the sets of a[i] and b[i] for every i; the smaller row number becomes the root."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            keep = lo != hi
            if not keep.any():
                return
            a, b = lo[keep], hi[keep]
            np.minimum.at(self.parent, b, a)


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's links by a spanning forest of each batch."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        ids, rows = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        forest.join(rows[: len(a)], rows[len(a) :])
        roots = forest.roots()
        moved = roots != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a long, b long); every node of a component gets the same root, a node of it.

    Each round, every node takes the member of its closed neighbourhood with the least hash of that round, and the
    links are redrawn between what was taken. Nodes shrink by a constant factor a round whatever the graph's shape, so
    a chain of a billion nodes takes some tens of rounds. The neighbourhood's least member is a partial aggregate, and
    the redrawing joins two stored tables, which adaptive execution splits at a hot key. Finally the rounds' choices
    are composed from the last to the first. Null ends, self-links and repeated links are ignored.
    """
    edges = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(spanning, "a long, b long")
    edges = stored(edges.distinct(), "links")
    chosen: list[DataFrame] = []
    while not edges.isEmpty():
        rank = F.xxhash64("v", F.lit(len(chosen)))
        both = edges.select(F.col("a").alias("u"), F.explode(F.array("a", "b")).alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.explode(F.array("a", "b")).alias("v")))
        took = stored(both.groupBy("u").agg(F.min_by("v", rank).alias("t")), "choices")
        chosen.append(took)
        one = edges.join(took, edges["a"] == took["u"]).select(F.col("t").alias("a"), "b")
        two = stored(one, "half").join(took.withColumnRenamed("u", "w"), F.col("b") == F.col("w")).select("a", F.col("t").alias("b"))
        edges = stored(two.where("a <> b").mapInArrow(spanning, "a long, b long").distinct(), "links")
    if not chosen:
        return links.sparkSession.createDataFrame([], "node long, root long")
    out = chosen[-1].select(F.col("u").alias("node"), F.col("t").alias("root"))
    for took in reversed(chosen[:-1]):
        later = out.withColumnsRenamed({"node": "n", "root": "r"})
        out = stored(took.join(later, took["t"] == later["n"], "left").select(F.col("u").alias("node"), F.coalesce("r", "t").alias("root")), "roots")
    return out
