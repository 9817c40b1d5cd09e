"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the normalised test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, id_and_text, id_type, restored, slices, word_table

#: A word is a run of these bytes: digits, letters and every byte of a non-ASCII character.
_TABLE = word_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Bytes of normalised windows in one automaton (some 50 times that in memory). Larger test sets are scanned in passes.
AUTOMATON_BYTES = 2_000_000

#: Sorted hits (runs, spans) of several passes, those that touch as one: what a single automaton finds.
_MERGED = """aggregate(hits, slice(hits, 1, 0), (a, h) -> CASE WHEN size(a) = 0 OR element_at(a, -1).runs[1] < h.runs[0] THEN concat(a, array(h))
ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('runs', array(element_at(a, -1).runs[0], greatest(element_at(a, -1).runs[1], h.runs[1])),
'spans', array(element_at(a, -1).spans[0], greatest(element_at(a, -1).spans[1], h.spans[1]))))) END)"""

_built: dict = {}


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str, window: int = WINDOW) -> list[str]:
    """The windows of one item, words single-spaced between blanks, one code point a byte."""
    words = normal_words(text)
    if not words:
        return []
    return [" " + b" ".join(words[i : i + window]).decode("latin-1") + " " for i in range(max(1, len(words) - window + 1))]


def build(patterns: list[tuple[str, list[str]]]):
    """The automaton; each pattern's value is (its words, the items that hold it)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, items in patterns:
        automaton.add_word(text, (text.count(" ") - 1, items))
    automaton.make_automaton()
    return automaton


def scan(automaton, text: str):
    """(number of words, hit runs of word numbers as [start, end) pairs, item ids)."""
    words = normal_words(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    runs: list[list[int]] = []
    items: set[str | None] = set()
    at = seen = 0
    for end, (n, ids) in automaton.iter(line):
        seen += line.count(" ", at, end + 1)
        at = end + 1
        stop = seen - 1
        start = stop - n
        items.update(ids)
        while runs and runs[-1][1] >= start:
            start = min(start, runs.pop()[0])
        runs.append([start, stop])
    return len(words), runs, items


def _patterns(items: DataFrame, shards: int) -> Iterator[list[tuple[str, list[str | None]]]]:
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else items
        found: dict[str, set[str | None]] = {}
        for row in part.collect():  # within AUTOMATON_BYTES of text, by the choice of shards
            for w in windows_of(row["text"]):
                found.setdefault(w, set()).add(row["id"])
        yield [(w, [*ids]) for w, ids in sorted(found.items())]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document and pass: id, n_words, runs (hit word ranges), spans (the same as [start, end) character
    offsets of the original text), items.

    The test set is measured first. Its windows are ten times its words, so a shard of the test set is broadcast only
    while its text is under AUTOMATON_BYTES / 10; beyond that the documents are scanned once for each shard.
    Null texts have no words. Items without words or text match nothing; items with a null id are one item, a null.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size * WINDOW // AUTOMATON_BYTES))
    extra, more, names = carried(docs, keep)
    texts, kind = id_and_text(docs, id_col, text_col, extra), id_type(docs, id_col)
    spark, passes = docs.sparkSession, []
    if shards > 1:
        texts, more, names = texts.withColumn("mark", _mark(docs, keep, names)), more + ", mark string", [*names, "mark"]
    for patterns in _patterns(items, shards):
        shared = spark.sparkContext.broadcast(patterns)
        passes.append(texts.mapInArrow(_scanner(shared, uuid.uuid4().hex, names), f"id {kind}, n_words long, runs array<array<int>>, spans array<array<int>>, items array<string>{more}"))
    out = passes[0]
    for other in passes[1:]:
        out = out.unionByName(other)
    return out if shards == 1 else out.withColumn("passes", F.lit(shards))


def _mark(docs: DataFrame, keep: Sequence[str], names: list[str]):
    """A digest of a row's text and carried columns: rows of one id and mark are copies."""
    plain = [F.to_json(F.struct(n)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(n) for n, c in zip(names, keep, strict=True)]
    return F.concat_ws(":", F.sha2("text", 256), F.xxhash64(F.lit(0), *plain).cast("string"))


def _scanner(shared, key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built.get(key)
        if automaton is None:
            _built.clear()
            automaton = _built[key] = build(shared.value)
        for b in slices(batches):
            n_words, all_runs, all_spans, all_items = [], [], [], []
            for text in b.column("text").to_pylist():
                n, runs, items = scan(automaton, text)
                spans = []
                if runs:
                    marks = [m.span() for m in _WORD.finditer(text)]
                    spans = [[marks[s][0], marks[e - 1][1]] for s, e in runs]
                n_words.append(n)
                all_runs.append(runs)
                all_spans.append(spans)
                all_items.append(sorted(items, key=lambda i: (i is None, i or "")))
            pairs = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(all_runs, pairs), pa.array(all_spans, pairs), pa.array(all_items, pa.list_(pa.string())), *(b.column(n) for n in names)], ["id", "n_words", "runs", "spans", "items", *names])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), **item_cols) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans, columns of keep.

    A test set within the bound needs no shuffle. Beyond it, the passes of a document meet by its id and a digest of
    its text and carried columns; their hit ranges are merged, and copies stay as many as they were. Ties: an item
    counts once however often it occurs.
    """
    found = contaminated_spans(docs, benchmark, id_col, text_col, keep=keep, **item_cols)
    names = carried(docs, keep)[2]
    if "passes" in found.columns:
        hits = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("runs", "spans")))))
        found = found.groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), hits.alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / F.max("passes")).cast("int").alias("copies"), *(F.first(n).alias(n) for n in names))
        found = found.withColumn("hits", F.expr(_MERGED)).withColumn("runs", F.expr("transform(hits, h -> h.runs)")).withColumn("spans", F.expr("transform(hits, h -> h.spans)"))
        found = found.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    hit = F.expr("aggregate(runs, 0, (a, r) -> a + r[1] - r[0])").cast("long")
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "spans", *restored(names, keep))


__all__ = ["contaminated_spans", "decontaminate", "scan", "build", "windows_of"]
