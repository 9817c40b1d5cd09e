"""Ranked lexical search: a two-level quantised index, upper bounds from byte impacts and exact integer rescoring.

The index is dealt by document: each block holds inverted lists of its documents' terms, on the first level impacts
rounded up to a byte, on the second the exact number of occurrences and the length divisor. A search multiplies the
bytes of a block with the weights of a block of queries, which bounds every score from above and below; whatever can
reach the k-th best lower bound seen so far is scored again in exact integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLOCK_GROUP, id_and_text, id_type, new_table, slices, small_batches, stored
from .decontaminate import normal_words

TOP = 10
#: An impact lies below 10^6; a byte stands for up to IMPACT / 255 of it, rounded up.
IMPACT, LEVELS = 1_000_000, 255
#: Documents and bytes of text in one block of the index; a longer text is a block alone.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20
#: Bytes of query text searched at once: a block of queries, whose weights are broadcast, takes some tens of MB.
QUERY_BYTES = 100_000


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact part of a score that doesn't depend on the query: 10^9 tf div (1000 tf + 8 m)."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms): two sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in slices(batches):
            sizes = [len(normal_words(t)) for t in b.column("text").to_pylist()]
            n, total = n + sum(s > 0 for s in sizes), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    r = texts.mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return r["n"] or 0, r["total"] or 0


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all terms of all documents, a row for each block: ids and m of its documents, its terms
    (sorted, joined by blanks), and for each term, from ptr to ptr, the documents' numbers, byte impacts and tf."""
    n_docs, n_terms = size

    def block(ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        terms, tf, lengths, m = [], [], [], []
        for text in texts:
            words = normal_words(text)
            seen = Counter(words)
            terms.extend(seen)
            tf.extend(seen.values())
            lengths.append(len(seen))
            m.append(25 + 75 * len(words) * n_docs // max(n_terms, 1))
        names = sorted({*terms})
        number = {t: i for i, t in enumerate(names)}
        term = np.fromiter((number[t] for t in terms), np.int64, len(terms))
        doc, tf_ = np.repeat(np.arange(len(texts)), lengths), np.asarray(tf, np.int64)
        order = np.argsort(term, kind="stable")
        doc, tf_ = doc[order], tf_[order]
        bytes_ = -(-impact(tf_, np.asarray(m, np.int64)[doc]) * LEVELS // IMPACT)
        ptr = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        lists = [pa.concat_arrays(ids), pa.array(m, pa.int64()), pa.array(ptr.astype(np.int32)), pa.array(doc.astype(np.int16)), pa.array(tf_.astype(np.int32))]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        blobs = [pa.array([b" ".join(names)], pa.binary()), pa.array([bytes_.astype(np.uint8).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *blobs], ["ids", "m", "ptr", "doc", "tf", "terms", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in slices(batches, BLOCK_ROWS):
            for i, text in enumerate(b.column("text").to_pylist()):
                if texts and (len(texts) == BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(b.column("id").slice(i, 1))
                texts.append(text)
                size += len(text)
        if texts:
            yield block(ids, texts)

    schema = f"ids array<{id_type(docs, id_col)}>, m array<long>, ptr array<int>, doc array<short>, tf array<int>, terms binary, impacts binary"
    return stored(id_and_text(docs, id_col, text_col).mapInArrow(run, schema), "lexical-index", BLOCK_GROUP)


def _column(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False)


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms: sums of at most len(terms) rows a task, from two columns of the index."""
    given = index.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = given.value, np.zeros(len(given.value), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                sizes = np.diff(_column(b, "ptr", i))
                here = [(wanted[t], k) for k, t in enumerate(b.column("terms")[i].as_py().split(b" ")) if t in wanted]
                if here:
                    at = np.array(here)
                    total[at[:, 0]] += sizes[at[:, 1]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "df"])

    with small_batches(index.sparkSession):
        rows = index.select("terms", "ptr").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {t: 0 for t in terms} | {terms[r["term"]]: r["df"] for r in rows}


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))


class _Best:
    """The top documents of each query that a task has seen, under (score falling, id rising, null ids last)."""

    def __init__(self, queries: int, top: int):
        self.top, self.rows = top, [[] for _ in range(queries)]

    def add(self, query: int, found: list[tuple]) -> None:
        self.rows[query] = sorted([*self.rows[query], *found], key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[: self.top]


def _searched(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], weights: np.ndarray, top: int, totals: list[int]) -> _Best:
    """Search every block of a task for all queries of a block; weights: terms by queries. totals counts rescored pairs."""
    queries = weights.shape[1]
    best, lowest = _Best(queries, top), np.zeros((top, queries))
    real = weights.astype(np.float64)  # exact: sums stay far below 2^53
    for b in batches:
        for i in range(b.num_rows):
            here = [(number[t], k) for k, t in enumerate(b.column("terms")[i].as_py().split(b" ")) if t in number]
            if not here:
                continue
            at, ptr = np.array(here), _column(b, "ptr", i)
            m, doc, impacts = _column(b, "m", i), _column(b, "doc", i), np.frombuffer(b.column("impacts")[i].as_py(), np.uint8)
            lengths = ptr[at[:, 1] + 1] - ptr[at[:, 1]]
            cell = np.repeat(ptr[at[:, 1]] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            col, docs = np.repeat(np.arange(len(at)), lengths), doc[cell]
            first, w = np.zeros((len(m), len(at))), real[at[:, 0]]
            first[docs, col] = impacts[cell]
            upper = first @ w
            lower = upper - (first > 0) @ w
            lowest = -np.partition(-np.concatenate([lowest, lower]), top - 1, axis=0)[:top]
            bound = np.maximum(lowest[top - 1], 1)
            d, q = np.nonzero(upper >= bound)
            if not len(d):
                continue
            totals[0] += len(d)
            exact = np.zeros(first.shape, np.int64)
            exact[docs, col] = impact(_column(b, "tf", i)[cell].astype(np.int64), m[docs])
            whole, ids = weights[at[:, 0]].T.copy(), b.column("ids")[i].values
            scores = np.concatenate([np.einsum("ij,ij->i", exact[d[s : s + 4096]], whole[q[s : s + 4096]]) for s in range(0, len(d), 4096)])
            for k in np.unique(q):
                rows = np.flatnonzero((q == k) & (scores > 0))
                best.add(k, [(int(scores[r]), ids[int(d[r])].as_py()) for r in rows])
    return best


def search(index: DataFrame, size: tuple[int, int], items: DataFrame, item_id: str = "item_id", item_text: str = "text", id_name: str = "doc_id", top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item id, rank, document id, score): each item's top documents with a score above 0.

    Items are dealt by hash into blocks of about query_bytes of text, each searched over the whole index: terms, weights
    and running bounds of one block are all that a task holds besides a block of the index. Of every task come at most
    top rows for a query. Equal scores go by rising document id, null ids last. Items without terms find nothing; rows
    that repeat an item id are searched one by one, each with ranks of its own.
    """
    spark = items.sparkSession
    text = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    path = new_table(spark, "queries")
    count, total = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(1, min(count, -(-total // query_bytes)))
    numbered = items.select(F.col(item_id).alias("item"), text.alias("text"), F.monotonically_increasing_id().alias("number"))
    numbered.withColumn("block", F.pmod(F.xxhash64("text", "number"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    queries = spark.read.schema(f"item {id_type(items, item_id)}, text string, number long, block int").parquet(path)
    kind, found = index.schema["ids"].dataType.elementType.simpleString(), None
    for k in range(blocks):
        rows = [(r["number"], Counter(normal_words(r["text"]))) for r in queries.where(F.col("block") == k).select("number", "text").collect()]
        terms = sorted({t for _, c in rows for t in c})
        df = document_frequencies(index, terms)
        number = {t: i for i, t in enumerate(terms)}
        weights = np.zeros((len(terms), len(rows)), np.int64)
        for q, (_, c) in enumerate(rows):
            for t, times in c.items():
                weights[number[t], q] = times * term_weight(size[0], df[t])
        given = spark.sparkContext.broadcast((number, weights, [n for n, _ in rows]))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            number, weights, names = given.value
            best = _searched(batches, number, weights, top, [0])
            flat = [(names[q], score, doc) for q, rows in enumerate(best.rows) for score, doc in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], index_type)], ["number", "score", "doc"])

        index_type = _arrow_type(index)
        with small_batches(spark):
            part = stored(index.mapInArrow(run, f"number long, score long, doc {kind}"), "found")
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(queries.select("number", "item"), "number").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_name), "score")


def _arrow_type(index: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(index.schema["ids"].dataType.elementType)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Index all of docs, then search() it for every item.

    Null and empty texts have no terms and are never found; rows that repeat a document's id are documents of their own.
    Other columns are ignored; an empty table on either side gives an empty result. Texts are read twice (sizes, then
    the index) and never shuffled.
    """
    size = corpus_size(docs, text_col)
    return search(build_index(docs, size, id_col, text_col), size, items, item_id, item_text, id_col, top, query_bytes)
