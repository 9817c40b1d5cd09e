"""Sentence scores, top-k selections and frequency-based headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import text as T


def top_then_in_order(rows: DataFrame, group: str, score: str, order: str, k: int) -> DataFrame:
    """The k best rows of each group, ties to the earlier, returned with their place in the original order."""
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), order))).where(F.col("_r") <= k)
    return best.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order))).drop("_r")


def informativeness(sentence: Column, labels: list[str]) -> Column:
    """Two for each label that the sentence holds and half for each of its words of over three letters in a label."""
    s = F.lower(sentence)
    known = F.array(*(F.lit(x.lower()) for x in labels)).cast("array<string>")
    words = F.array_distinct(F.flatten(F.transform(known, lambda x: F.split(x, r"\s+"))))
    held = F.size(F.filter(known, lambda x: F.contains(s, x)))
    shared = F.size(F.array_intersect(F.filter(T.tokens(s), lambda w: F.length(w) > 3), words))
    return 2.0 * held + 0.5 * shared


def canonical_choice(points: DataFrame, group: str, order: str, text_col: str = "text") -> DataFrame:
    """Of each group the text with the best 0.7 unique-word share + 0.3 min(words / 20, 1), ties to the first."""
    words = T.tokens(F.col(text_col))
    score = F.when(F.size(words) > 0, 0.7 * F.size(F.array_distinct(words)) / F.size(words) + 0.3 * F.least(F.size(words) / 20.0, F.lit(1.0))).otherwise(0.0)
    return points.withColumn("score", score).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), order))).where("_r = 1").select(group, order, text_col, "score")


def frequent_words(points: DataFrame, group: str, text_col: str = "text", longer_than: int = 4, k: int = 3) -> DataFrame:
    """(group, word, n, place): the k most frequent words of each group, ties by the word."""
    words = points.select(group, F.explode(T.letters(F.lower(F.col(text_col)))).alias("word")).where(F.length("word") > longer_than)
    counts = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "word"))).where(F.col("place") <= k)


def tfidf(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, word, weight): counts times 1 + ln((1 + n) / (1 + df)), each document scaled to length one."""
    counts = docs.select(key, F.explode(T.tokens(F.col(text_col))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    raw = counts.join(df, "word").join(F.broadcast(n)).select(key, "word", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
    return raw.join(size, key).select(key, "word", (F.col("x") / F.col("s")).alias("weight"))


#: Section roles and what a sentence of that role holds.
ROLES = {
    "definition": ("definition", "what is", "refers to", "means", "defined as", "is a", "overview", "introduction"),
    "structure": ("structure", "component", "consists of", "contains", "has", "includes", "made of", "parts", "elements"),
    "types": ("type", "kind", "category", "classification", "variant", "singly", "doubly", "circular", "primitive", "non-primitive"),
    "operations": ("operation", "function", "method", "traverse", "search", "sort", "insert", "delete", "access", "push", "pop"),
    "advantages": ("advantage", "benefit", "efficient", "fast", "dynamic", "flexible", "better"),
    "disadvantages": ("disadvantage", "limitation", "drawback", "slow", "overhead", "memory", "cannot"),
    "applications": ("application", "used for", "example", "practice", "implement", "real-world", "such as", "use case"),
}


def role(sentence: Column) -> Column:
    """The role with most hits, ties to the first listed, 'other' without any."""
    s = F.lower(F.coalesce(sentence, F.lit("")))
    hits = [F.struct(sum((F.contains(s, F.lit(c)).cast("int") for c in cues), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, cues) in enumerate(ROLES.items())]
    best = F.greatest(*hits)
    return F.when(best["n"] > 0, best["name"]).otherwise("other")
