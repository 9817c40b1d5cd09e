"""Scores of generated text: ROUGE recall, readability, order of concepts, verbs kept."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions import text as T

#: Tokens that a row of the table of common subsequences holds at once; longer texts take one strip after another.
STRIP = 4096
#: Relations whose source has to come first, found anywhere in a relation.
HIERARCHICAL = ("has", "includes", "contains", "consists", "composed", "divided into", "has concept of", "has type", "type of", "is a", "has part", "comprises", "has component")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table as the bits of a number. Strips of a pass what they
    carry on to the next at each place of b, so the bits held follow the strip and not the square of the texts."""
    carried = bytearray(len(b))
    length = 0
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        places: dict[str, int] = {}
        for i, w in enumerate(strip):
            places[w] = places.get(w, 0) | 1 << i
        full = (1 << len(strip)) - 1
        row = full
        for j, w in enumerate(b):
            hit = row & places.get(w, 0)
            if hit or carried[j]:
                added = row + hit + carried[j]
                carried[j] = added >> len(strip)
                row = (added | (row - hit)) & full
        length += len(strip) - row.bit_count()
    return length


def clipped(x: list[str], y: list[str], n: int) -> tuple[int, int]:
    """n-grams shared, counted no more often than on either side, and those of y."""
    a, b = (Counter(zip(*(side[k:] for k in range(n)), strict=False)) for side in (x, y))
    return (a & b).total(), b.total()


def _scored(pairs: DataFrame, key: str, fields: str, score: Callable[[list[str], list[str]], tuple[int, ...]]) -> DataFrame:
    """(key, fields) by the score of each pair's tokens. Both sides are in one row, so nothing is shuffled; pairs are
    scored some hundred at a time."""
    names = [key, *(f.split()[0] for f in fields.split(", "))]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [score(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)

    kind = pairs.schema[key].dataType.simpleString()
    tokens = pairs.select(key, T.tokens(F.col("generated")).alias("x"), T.tokens(F.col("reference")).alias("y"))
    return tokens.mapInArrow(scores, f"{key} {kind}, {fields}")


def _clipped(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """(key, shared, total): n-grams shared, counted no more often than on either side, and those of the reference; a
    pair without any on either side has no row. Keys are unique."""
    counts = _scored(pairs, key, "shared long, total long, own long", lambda x, y: (*clipped(x, y, n), max(len(x) - n + 1, 0)))
    return counts.where("own > 0 or total > 0").drop("own")


def rouge(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs(key, generated, reference) -> key, rouge1_recall, rouge2_recall, rougeL_recall, to four places.

    Keys are unique. An empty or null reference scores 0. A pair is scored in its row.
    """

    def score(x: list[str], y: list[str]) -> tuple[int, ...]:
        return lcs_length(y, x), *clipped(x, y, 1), *clipped(x, y, 2)

    counts = _scored(pairs, key, "lcs long, s1 long, t1 long, s2 long, t2 long", score)
    share = lambda a, b: F.bround(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return counts.select(key, share("s1", "t1").alias("rouge1_recall"), share("s2", "t2").alias("rouge2_recall"), share("lcs", "t1").alias("rougeL_recall"))


def readability(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, Flesch reading ease and its parts, Gunning fog and its parts; a text without words or sentences scores 0.

    One projection: nothing is shuffled.
    """
    words = T.letters(F.col(text_col))
    counts = docs.select(F.col(key), F.size(T.sentences(F.col(text_col))).alias("s"), F.transform(words, T.syllables).alias("syl"))
    base = counts.select(key, "s", F.size("syl").alias("w"), F.aggregate("syl", F.lit(0), lambda a, x: a + x).alias("y"), F.size(F.filter("syl", lambda x: x >= 3)).alias("c"))
    some = (F.col("s") > 0) & (F.col("w") > 0)
    asl, asw, share = F.col("w") / F.col("s"), F.col("y") / F.col("w"), F.col("c") / F.col("w")
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * asw))
    fog = F.lit(0.4) * (asl + 100 * share)
    or0 = lambda c, places: F.when(some, F.bround(c, places)).otherwise(0.0)
    return base.select(
        key, or0(ease, 2).alias("flesch"), or0(asl, 2).alias("asl"), or0(asw, 2).alias("asw"),
        F.when(~some, "N/A").when(ease >= 90, "Very Easy").when(ease >= 60, "Standard").when(ease >= 30, "Difficult").otherwise("Very Difficult").alias("flesch_label"),
        or0(fog, 2).alias("fog"), or0(share, 4).alias("complex_word_ratio"),
        F.when(~some, "N/A").when(fog <= 10, "Easy").when(fog <= 14, "Moderate").otherwise("Difficult").alias("fog_label"),
    )


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both lower-cased labels and whether the relation orders them; empty or equal labels are left out."""
    labels = nodes.where((F.col("id") != "") & (F.col("label") != "")).select("id", F.lower("label").alias("label"))
    a, b = (labels.select(F.col("id").alias(i), F.col("label").alias(n)) for i, n in (("source", "first"), ("target", "second")))
    relation = F.lower(F.trim(F.coalesce("relation", F.lit(""))))
    ordered = F.exists(F.array(*map(F.lit, HIERARCHICAL)), lambda v: F.contains(relation, v))
    return edges.join(a, "source").join(b, "target").where("first <> second").select("source", "target", "relation", "first", "second", ordered.alias("ordered"))


def dependency_score(texts: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, score, total, evaluated, violations, coverage of each text against one graph.

    The graph's dependencies are folded into one row and broadcast; it is a concept graph of a course or book, of at
    most some thousand edges, and its size is checked.
    """
    rows = dependencies(nodes, edges)
    if rows.count() > 100_000:
        raise ValueError("a concept graph of more than 100,000 dependencies: score the texts by parts of it")
    packed = rows.agg(F.collect_list(F.struct("first", "second", "ordered")).alias("deps"))
    both = texts.select(F.col(key), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).join(F.broadcast(packed))
    at = F.transform("deps", lambda d: F.struct(F.instr("t", d["first"]).alias("x"), F.instr("t", d["second"]).alias("y"), d["ordered"].alias("o")))
    seen = both.select(key, F.size("deps").alias("total"), F.filter(at, lambda p: (p["x"] > 0) & (p["y"] > 0)).alias("seen"))
    out = seen.select(key, F.col("total").cast("long").alias("total"), F.size("seen").cast("long").alias("evaluated"), F.size(F.filter("seen", lambda p: p["o"] & (p["y"] < p["x"]))).cast("long").alias("violations"))
    score = F.when(F.col("total") == 0, 1.0).when(F.col("evaluated") == 0, 0.5).otherwise(F.bround(1 - F.col("violations") / F.col("evaluated"), 4))
    return out.select(key, score.alias("score"), "total", "evaluated", "violations", F.when(F.col("total") > 0, F.bround(F.col("evaluated") / F.col("total"), 4)).otherwise(0.0).alias("coverage"))


def verb_fidelity(texts: DataFrame, edges: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, fidelity, matched, total: distinct relations of over two letters that a text holds."""
    verbs = edges.select(F.lower(F.trim("relation")).alias("v")).where("length(v) > 2").distinct()
    packed = verbs.agg(F.collect_list("v").alias("verbs"))
    both = texts.select(F.col(key), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).join(F.broadcast(packed))
    out = both.select(key, F.size(F.filter("verbs", lambda v: F.contains(F.col("t"), v))).cast("long").alias("matched"), F.size("verbs").cast("long").alias("total"))
    return out.select(key, F.when(F.col("total") > 0, F.bround(F.col("matched") / F.col("total"), 4)).otherwise(0.0).alias("fidelity"), "matched", "total")
