"""Line dedup: levelled sorted runs of line hashes, compacted as they fill up; built-in functions only.

Documents come in batches. A batch's lines are known by 128 bits of hash; its entries (hash, documents, last document)
are anti-joined by merge with the runs stored before, which drops those that can't change a decision any more, and the
rest becomes a run of its own. A level that holds `fanout` runs is merged into one run of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_table, stored

#: A line counts from so many code points on, and goes if so many documents hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 8, 4
#: Parts that the lines of one key are dealt into where they meet its entry.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\f\r"
_KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased. Only ASCII is lower-cased by the faster lower()."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, row, pos, h1, h2) of every line whose key is long enough; row: hash of the text, which tells apart rows of one
    id; pos: the line's number from 0."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    long = rows.where(F.char_length(F.btrim("line", F.lit(_BLANKS))) >= least_chars).withColumn("key", line_key(F.col("line")))
    return long.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Sorted runs of (h1, h2, docs, last): how many documents hold a line, and the greatest of their ids.

    A run is a table bucketed and sorted by hash, a bucket for each shuffle partition: a batch meets
    them by merge without another shuffle. An entry of `settled` documents or more decides its key but for a later last
    document; what a batch adds to such a key is left out, so lines that are everywhere don't fill the runs.
    """

    def __init__(self, spark: SparkSession, settled: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._paths[name] = new_table(self.spark, f"line-run-{level}")
        entries.write.bucketBy(buckets, *_KEY).sortBy(*_KEY).option("path", self._paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The entries of several runs, one a key. The files are read as they are and not as tables: Spark 4.1 takes the
        buckets of a union of tables for its partitioning, and then groups some keys twice."""
        schema = self.spark.table(names[0]).schema
        entries = self.spark.read.schema(schema).parquet(*(self._paths[n] for n in names))
        return entries if len(names) == 1 else entries.groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, lines: DataFrame) -> None:
        """One batch of (id, h1, h2). All lines of an id must be in one batch; a null id is one document, before all others."""
        own = lines.groupBy(*_KEY, "id").agg(F.lit(1).alias("one")).groupBy(*_KEY).agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        for name in self._runs():
            run = self.spark.table(name).where(F.col("docs") >= self.settled).select(*_KEY, F.col("last").alias("known"))
            same = (own["h1"] == run["h1"]) & (own["h2"] == run["h2"]) & (own["last"].isNull() | (run["known"] >= own["last"]))
            own = own.join(run, same, "left_anti")
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._drop(full)
            level += 1

    def frequent(self, least_docs: int | None = None) -> DataFrame:
        """(h1, h2, docs, last) of the keys that least_docs documents (settled, or fewer) hold; docs is exact below
        settled and a lower bound from there on."""
        least = self.settled if least_docs is None else least_docs
        if least > self.settled:
            raise ValueError("entries are exact up to the settled number of documents only")
        return self._merged(self._runs()).where(F.col("docs") >= least)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Forget the runs; their files go with the application's folder (common.clean)."""
        self._drop(self._runs())
        self.levels = []


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """(id, row, dropped array of line numbers) of the texts that lose lines."""
    batch = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(batches)).cast("int").alias("batch")
    path = new_table(docs.sparkSession, "lines")
    line_hashes(docs, id_col, text_col, least_chars).select("*", batch).write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(f"id {docs.schema[id_col].dataType.simpleString()}, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(docs.sparkSession, least_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("id", *_KEY))
    salted = stored(runs.frequent().select(*_KEY, "last"), "frequent-lines").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    runs.close()
    dealt = lines.select("id", "row", "pos", *_KEY, F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = dealt.join(salted, [*_KEY, "salt"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return hits.groupBy("id", "row").agg(F.collect_set("pos").alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: id, n_lines and n_dropped long, kept (the text without its dropped lines).

    A line is dropped if its key (see line_key) has least_chars code points or more, is held by least_docs documents or
    more, and the document isn't the greatest id of those. Null and empty texts are one empty line. Rows that repeat an
    id are one document to the counts, each with its own lines; a null id is one document, less than all others. Repeats
    of a line within a document go or stay together. Other columns are ignored; an empty table gives an empty result.
    Texts are shuffled once, by id, to meet the numbers of their dropped lines; all else moves hashes only.
    """
    gone = stored(dropped_lines(docs, id_col, text_col, least_chars, least_docs, batches), "dropped-lines")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("own"), F.coalesce(text, F.lit("")).alias("text"))
    both = rows.join(gone.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("id")) & (F.col("own") == F.col("row")), "left")
    # The one-element array binds the split text, so that it is split once and not for every line that stays.
    once = F.array(F.struct(F.split("text", "\n").alias("line"), F.col("dropped").alias("gone")))
    left = F.transform(once, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["line"]) - 1), x["gone"]), lambda i: F.get(x["line"], i)), "\n"))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select(
        F.col("key").alias(id_col), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left[0]).alias("kept"),
    )
