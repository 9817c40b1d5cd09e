"""Topological order of concepts with priorities, and sections of notes in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.operators.tables import numbered, stored

#: Headings that come first; the place of a section that no concept places; words that place nothing.
FIRST_HEADINGS = ("concept workflow", "workflow overview")
UNKNOWN, BY_ROLE = 999, 500
LONG_WORD = 3


def layers(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, layer): 0 for a node that no link enters, else one more than the greatest layer of those that link to it; null
    for nodes on a cycle or after one. Links of unknown nodes and repeats don't matter.

    A round takes every node away that no link enters any more, however many, so there are as many rounds as layers; the
    numbers of entering links are partial aggregates, and each round's links are stored.
    """
    ids = nodes.select("id").distinct()
    left = links.select("source", "target").distinct().join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    left, waiting, done, layer = stored(left, "links"), stored(ids, "waiting"), None, 0
    while True:
        entered = left.select(F.col("target").alias("id")).distinct().withColumn("entered", F.lit(True))
        told = stored(waiting.join(entered, "id", "left"), "waiting")
        ready = told.where("entered is null").select("id", F.lit(layer).alias("layer"))
        if not ready.limit(1).count():
            rest = told.select("id", F.lit(None).cast("int").alias("layer"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        if layer % 16 == 15:  # a deep graph's plan stays small too
            done = stored(done, "layers")
        waiting = told.where("entered").select("id")
        left = stored(left.join(ready.select(F.col("id").alias("source")), "source", "left_anti"), "links")
        layer += 1


def in_order(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, layer, place) of nodes(id, priority, label, pos): every node after all that link to it; within a layer by
    priority, label and pos; nodes on cycles or after them last, by pos. place counts from 0 over all nodes, which are
    sorted over all tasks."""
    rows = nodes.select("id", "priority", "label", "pos").join(layers(nodes, links), "id")
    within = [F.when(F.col("layer").isNotNull(), F.col(c)) for c in ("priority", "label")]
    return numbered(rows, "place", F.asc_nulls_last("layer"), *(c.asc_nulls_first() for c in within), "pos").select("id", "layer", "place")


def sections_in_order(points: DataFrame, concepts: DataFrame, stops: tuple[str, ...] = (), role: str | None = None) -> DataFrame:
    """points(notes_id, sec_pos, sec_heading, ...) with sec_pos from 0 in the order of concepts(label, place).

    A section goes where the concept of its heading stands; else where the first of its long words (but stops) first
    stands in a label; else, from BY_ROLE on, by the column `role`. FIRST_HEADINGS come first and headings with
    "additional" last; ties keep their order. Concepts meet headings by an equi-join on whole labels and on words.
    """
    keys = ["notes_id", "sec_pos"]
    least = F.min(F.col(role)).alias("role") if role else F.lit(99).alias("role")
    sections = points.groupBy(*keys).agg(F.lower(F.trim(F.first("sec_heading"))).alias("h"), least)
    labels = concepts.select(F.lower(F.trim("label")).alias("h"), "place")
    words = lambda df, *more: df.select(*more, F.explode(F.filter(F.split("h", r"\s+"), lambda w: (F.length(w) > LONG_WORD) & ~w.isin(*stops) if stops else F.length(w) > LONG_WORD)).alias("word"))
    whole = labels.groupBy("h").agg(F.max("place").alias("whole"))
    known = words(labels, "place").groupBy("word").agg(F.min("place").alias("place")).unionByName(labels.select(F.col("h").alias("word"), "place")).groupBy("word").agg(F.min("place").alias("place"))
    near = words(sections, *keys).join(known, "word").groupBy(*keys).agg(F.min("place").alias("near"))
    rows = sections.join(whole, "h", "left").join(near, keys, "left")
    merit = (
        F.when(F.col("h").isin(*FIRST_HEADINGS), F.struct(F.lit(-1).cast("long").alias("a"), F.lit(0).alias("b")))
        .when(F.col("whole").isNotNull(), F.struct(F.col("whole").alias("a"), F.lit(0).alias("b")))
        .when(F.col("near") < UNKNOWN, F.struct(F.col("near").alias("a"), F.lit(1).alias("b")))
        .otherwise(F.struct((F.lit(BY_ROLE) + F.col("role")).cast("long").alias("a"), F.lit(2).alias("b")))
    )
    order = W.partitionBy("notes_id").orderBy(F.contains("h", F.lit("additional")), merit, "sec_pos")
    moved = rows.select(*keys, (F.row_number().over(order) - 1).alias("_new"))
    return points.join(moved, keys).withColumn("sec_pos", F.col("_new")).drop("_new")
