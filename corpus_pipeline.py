"""A training-corpus pipeline of five operators: reject toxic documents, keep one of near copies, cut repeated passages,
drop documents that hold benchmark items, and tokenise what is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import decontaminate, pieces, simhash, suffix, toxicity
from plumbago.llm.common import new_table


OWN = ("doc_id", "text", "n_chars")


def _names(docs: DataFrame) -> list[str]:
    """A name for every column, in order: OWN keep theirs, the rest get names that no column of docs begins with."""
    mark = "carried"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [c if c in OWN else f"{mark}{i}" for i, c in enumerate(docs.columns)]


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all columns but OWN under names that no operator uses, and those names; columns go by position."""
    new = _names(docs)
    return docs.toDF(*new), [c for c in new if c not in OWN]


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order and by their names, from a result that carried them."""
    return out.select(*_names(docs)).toDF(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, does not call toxic.

    Null and empty texts have no features and stay or go by the intercept alone; rows that repeat an id are scored
    apart; rows with a null id stay unless toxic. Any further columns pass, whatever they are called.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given, names = _carried(docs)
    held = ["text", *(c for c in ("n_chars",) if c in docs.columns), *names]
    return _back(toxicity.score(given, toxicity.train(given, labels), keep=held).where("predicted = 0"), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the least id, and of several such rows one; null, empty
    and blank texts are copies of each other. Rows without an id stay only where no row with one is linked to them."""
    given, _ = _carried(docs)
    return _back(simhash.one_of_each(given), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that occur elsewhere too. No document goes: one that loses all its
    text stays with an empty one. Null texts become empty; texts without such a passage keep every byte. Rows repeating
    an id are texts of their own, so copies lose all that they share."""
    given, names = _carried(docs)
    left = suffix.remove_repeats(given, keep=names, words=True)
    return _back(left.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.char_length("text").cast("long")), docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts hold none and stay, as do rows that repeat
    an id or have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    given, names = _carried(docs)
    held = ["text", *(c for c in ("n_chars",) if c in docs.columns), *names]
    return _back(decontaminate.decontaminate(given, benchmark, keep=held).where("not contaminated"), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's piece ids, spans and decoded text; one row a row. A null text is empty, rows that repeat an
    id or have none are texts of their own, further columns are left out, and an empty table gives an empty result."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("sentencepiece", tokenise),
]

#: Viterbi decoding, byte strings and piece merges are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
