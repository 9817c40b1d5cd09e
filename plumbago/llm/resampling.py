"""Target-distribution importance resampling over a persisted sparse document-by-bucket count matrix in CSR blocks.

Column sums of the two matrices give the distributions, the product of the documents' matrix with the buckets' gains
gives the weights, and Gumbel noise by hash makes the draw one without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_GROUP, id_and_text, id_type, slices, small_batches, stored
from .decontaminate import normal_words

BUCKETS, NGRAM = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Documents of one CSR block at most; their distinct buckets bound its size.
BLOCK_ROWS = 64


def feature_buckets(words: list[bytes], buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """The bucket of every run of 1 to ngram consecutive words, joined by one blank."""
    grams = [crc32(w) for w in words]
    for n in range(2, ngram + 1):
        grams += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.asarray(grams, np.int64) % buckets


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """The stored matrix, a row for each CSR block: ids and n_words of its documents, indptr, indices, counts.

    A null text has no words; rows that repeat an id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK_ROWS):
            n_words, ptr, indices, counts = [], [0], [], []
            for text in b.column("text").to_pylist():
                words = normal_words(text)
                found, times = np.unique(feature_buckets(words, buckets, ngram), return_counts=True)
                n_words.append(len(words))
                ptr.append(ptr[-1] + len(found))
                indices.append(found)
                counts.append(times)
            cells = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (indices, counts)]
            row = [b.column("id"), pa.array(n_words, pa.int64()), pa.array(ptr, pa.int32()), pa.array(cells[0].astype(np.int32)), pa.array(cells[1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row], ["ids", "n_words", "indptr", "indices", "counts"])

    schema = f"ids array<{id_type(docs, id_col)}>, n_words array<long>, indptr array<int>, indices array<int>, counts array<int>"
    return stored(id_and_text(docs, id_col, text_col).mapInArrow(run, schema), "count-matrix", 8 * BLOCK_GROUP)


def _cells(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole matrix: a sum for each bucket leaves a task, whatever its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                np.add.at(total, _cells(b, "indices", i), _cells(b, "counts", i))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    with small_batches(matrix.sparkSession):
        rows = matrix.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        sums[r["bucket"]] = r["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of every bucket: add-one smoothed on both sides."""
    all_s, all_t, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def products(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sparse matrix times the vector of gains, block by block."""
    given = matrix.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                counts, ptr = _cells(b, "counts", i).astype(np.int64), _cells(b, "indptr", i)
                both = np.zeros((2, len(counts) + 1), np.int64)
                np.cumsum(counts, out=both[0, 1:])
                np.cumsum(counts * given.value[_cells(b, "indices", i)], out=both[1, 1:])
                sums = both[:, ptr[1:]] - both[:, ptr[:-1]]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("n_words")[i].values, pa.array(sums[0]), pa.array(sums[1])], ["id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"id {matrix.schema['ids'].dataType.elementType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with rank from 1 in the given order: sorted over all tasks and stored, then each row adds its place in its
    part to the number of rows in the parts before, of which there are as many as shuffle partitions."""
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33).cast("int")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for k, n in sizes:
        before.append((k, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(before, "part int, before long")
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    buckets: int = BUCKETS, ngram: int = NGRAM, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null: not drawn), all long.

    weight sums the gains of a row's features; score adds Gumbel noise from SHA-256 of "seed:id" (a null id: "seed:").
    Of the rows with least_words words or more, the percent with the highest scores are drawn; ties go to the smaller id,
    then to fewer features and the smaller weight. Null and empty texts have no features and weight 0. Rows that repeat
    an id share its noise and are drawn one by one; a null id comes last among ties. An empty target or table is smoothed
    like any other. Other columns are ignored. Texts are read once and never shuffled.
    """
    matrix = count_matrix(docs, id_col, text_col, buckets, ngram)
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, target_id, target_text, buckets, ngram), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    with small_batches(docs.sparkSession):
        rows = stored(products(matrix, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "weights")
    able = F.col("n_words") >= least_words
    drawn = percent * rows.where(able).count() // 100
    best = ranked(rows.where(able), F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = best.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
