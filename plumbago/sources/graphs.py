"""Readers and writers of concept graphs, notes and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import text as T

#: The names that a field goes by, first to last.
NODE_FIELDS = {"id": ("id", "ID"), "label": ("label", "name", "title"), "description": ("description", "desc"), "type": ("type", "category")}
EDGE_FIELDS = {"source": ("source", "from", "subject"), "target": ("target", "to", "object"), "relation": ("relation", "rel", "label")}


def _read(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """The first of a field's names that is there and not empty, as text: arrays and objects as JSON. Names differ by
    case, so objects are read as maps. A file is one array, or an object a line."""
    kind = "map<string,string>"
    files = spark.read.text(path, wholetext=True)
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, kind))
    rows = files.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{kind}>")).otherwise(lines)).alias("m"))
    pick = lambda names: F.coalesce(*(F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")) for n in names), F.lit(""))
    return rows.select(*(pick(names).alias(field) for field, names in fields.items()))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, description, type) of a JSON array or lines of objects, under any of their usual names."""
    return _read(spark, path, NODE_FIELDS)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, relation), the same way."""
    return _read(spark, path, EDGE_FIELDS)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    nodes.write.mode(mode).json(f"{path}/nodes")
    edges.write.mode(mode).json(f"{path}/edges")


def triples_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text): 'label relation label.' for each edge whose ends are known."""
    names = nodes.select("id", "label")
    a, b = names.select(F.col("id").alias("source"), F.col("label").alias("s")), names.select(F.col("id").alias("target"), F.col("label").alias("t"))
    return edges.join(a, "source").join(b, "target").select(F.concat_ws(" ", "s", "relation", "t").alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows of both with the latest of each key; what a table format's MERGE would do."""
    both = old.unionByName(new)
    last = both.groupBy(key.alias("_k")).agg(F.max_by(F.struct(*both.columns), order).alias("_row"))
    return last.select("_row.*")


def notes_lines(points: DataFrame) -> DataFrame:
    """points(notes_id, sec_pos, sec_heading, sub_pos, sub_heading, pt_pos, text) -> (notes_id, text) as Markdown."""
    sec, sub = W.partitionBy("notes_id", "sec_pos").orderBy("sub_pos", "pt_pos"), W.partitionBy("notes_id", "sec_pos", "sub_pos").orderBy("pt_pos")
    first = points.withColumn("a", F.row_number().over(sec)).withColumn("b", F.row_number().over(sub))
    line = F.concat(F.when(F.col("a") == 1, F.concat(F.lit("## "), "sec_heading", F.lit("\n"))).otherwise(""), F.when(F.col("b") == 1, F.concat(F.lit("### "), "sub_heading", F.lit("\n"))).otherwise(""), F.lit("- "), F.col("text"))
    lines = first.select("notes_id", F.struct("sec_pos", "sub_pos", "pt_pos", line.alias("line")).alias("l"))
    return lines.groupBy("notes_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def by_stem(files: DataFrame, stem: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Of files(session_id, name, size) one a session: the largest whose stem is the given one, else the first by name
    with one of the suffixes."""
    named = F.lower(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)) == stem
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*suffixes)
    order = [F.when(named, 0).otherwise(1), F.when(named, -F.col("size")), F.col("name")]
    return files.where(named | suffix).withColumn("_r", F.row_number().over(W.partitionBy("session_id").orderBy(*order))).where("_r = 1").drop("_r")


def plain_text(notes: DataFrame, mark: str = "\u2022", title_rule: int | None = 40, rule: int = 30) -> DataFrame:
    """(notes_id, text) of nested notes(notes_id, title, sections): numbered headings over rules, points behind the mark.

    Without title_rule the title's rule is as long as the title.
    """
    number = lambda i: (i + 1).cast("string")
    points = lambda u: F.transform(F.filter(u["points"], lambda p: F.trim(p["text"]) != ""), lambda p: F.concat(F.lit(f"    {mark} "), p["text"]))
    sub = lambda s, i: F.flatten(F.transform(s["subsections"], lambda u, j: F.concat(F.array(F.concat(F.lit("  "), number(i), F.lit("."), number(j), F.lit(" "), u["heading"])), points(u), F.array(F.lit("")))))
    section = lambda s, i: F.concat(F.array(F.concat(number(i), F.lit(". "), s["heading"]), F.lit("-" * rule)), sub(s, i), F.array(F.lit("")))
    line = F.lit("=" * title_rule) if title_rule else F.repeat(F.lit("="), F.length("title"))
    return notes.select("notes_id", F.array_join(F.concat(F.array(F.col("title"), line, F.lit("")), F.flatten(F.transform("sections", section))), "\n").alias("text"))


def evaluations(rows: DataFrame) -> DataFrame:
    """rows(name, at, kg_rouge1, nonkg_rouge1, human_kg, human_nonkg) -> the latest of each file key, scores rounded to
    four and marks to two places."""
    places = {"kg_rouge1": 4, "nonkg_rouge1": 4, "human_kg": 2, "human_nonkg": 2}
    kept = upsert(rows.limit(0), rows, T.name_slug(F.col("name")), "at")
    return kept.select(T.name_slug(F.col("name")).alias("file_key"), "name", *(F.bround(c, n).alias(c) for c, n in places.items()))


def aggregated(evals: DataFrame) -> DataFrame:
    """One row: how many, and the keys and each score as arrays in the order of the keys."""
    columns = ["kg_rouge1", "nonkg_rouge1", "human_kg", "human_nonkg"]
    rows = F.array_sort(F.collect_list(F.struct("file_key", *columns)))
    packed = evals.agg(F.count("*").alias("dataset_size"), rows.alias("r"))
    return packed.select("dataset_size", F.col("r.file_key").alias("file_keys"), *(F.col(f"r.{c}").alias(c) for c in columns))
