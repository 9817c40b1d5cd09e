"""Phrases that a text says twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the longest and the shortest phrase, and of the shortest text that is looked at.
LONGEST, SHORTEST, LEAST_WORDS = 6, 3, 6


def repeat(words: list[str], longest: int = LONGEST, shortest: int = SHORTEST) -> tuple[int, int] | None:
    """(start, length) of the second of two equal runs of words: the longest length that any two have, the run that
    starts first, and its next occurrence. One pass over the words for a length, a dictionary of runs seen."""
    for n in range(min(longest, len(words) - 1), shortest - 1, -1):
        first: dict[tuple[str, ...], int] = {}
        best: tuple[int, int] | None = None
        for i in range(len(words) - n + 1):
            at = first.setdefault(tuple(words[i : i + n]), i)
            if at < i and (best is None or at < best[0]):
                best = at, i
        if best:
            return best[1], n
    return None


def collapsed(text: str) -> str:
    words = text.split()
    found = repeat(words) if len(words) >= LEAST_WORDS else None
    if not found:
        return text
    start, n = found
    return " ".join(words[:start] + words[start + n :]).strip().rstrip(" .") + "."


def without_repeated_phrases(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, text) without the second of two equal phrases of LONGEST to SHORTEST words, the longest first; words then
    stand one blank apart and a full stop ends the text. Texts without one, or of under LEAST_WORDS words, stay as they
    are; null is empty. Time is linear in the text; other columns are ignored; rows that repeat a key stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([collapsed(t) for t in b.column("text").to_pylist()], pa.string())], ["key", "text"])

    given = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)
