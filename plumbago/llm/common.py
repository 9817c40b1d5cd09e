"""Shared plumbing of the training-data operators: typed column picks, tables in the cluster's shared folder, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled per Python step, so that a worker's memory follows this and not the Arrow batch.
SLICE = 128


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, a local
    folder serves a local master, as in tests; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.plumbago.folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbago-")
        spark.conf.set("spark.plumbago.folder", base)
    return f"{base.rstrip('/')}/plumbago-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once the results that rest on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_table(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write df once and read it back: lineage ends here, so a lost executor never re-runs what came before. Where rows
    are of a megabyte each, group_rows bounds those that a writer or reader holds at once: neither goes beyond a row
    group, which else grows with the task's part of the table up to Parquet's 128 MB and more."""
    path = new_table(df.sparkSession, label)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch between the JVM and Python, where the session has Spark's own default: whole texts are long,
#: and both sides hold a batch or two of each running task.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Set the session's batch size to BATCH_ROWS unless the user has set another."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Bytes of an Arrow batch where rows are blocks of a matrix or an index, and such rows in a row group of their table.
BLOCK_BATCH, BLOCK_GROUP = "8m", 8
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BLOCK_BATCH for the jobs that run inside; the session's own setting comes back after them. Both sides
    hold a few batches of each running task, in buffers that grow by doubling."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, BLOCK_BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before) if before else spark.conf.unset(_BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Two columns, and extra ones, under fixed names whatever else the table holds; a null text counts as empty."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def carried(docs: DataFrame, keep: Sequence[str]) -> tuple[list[Column], str, list[str]]:
    """Columns that pass through a Python step beside its own: picks under safe names, their schema, those names."""
    names = [f"keep{i}" for i in range(len(keep))]
    schema = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return [F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], schema, names


def restored(names: Sequence[str], keep: Sequence[str]) -> list[Column]:
    return [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: 256-byte tables for bytes.translate: A-Z lowered; the same with all but word bytes made blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_table(is_word) -> bytes:
    return bytes(LOWER[b] if is_word(b) else 32 for b in range(256))
