"""Hierarchical notes as flat rows: points(notes_id, title, sec_pos, sec_heading, sub_pos, sub_heading, pt_pos, text).

A step is a projection, filter, window or union over these rows; empty parents vanish with their last point.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import bullets as B
from plumbago.functions import quality as Q
from plumbago.functions import repairs as R
from plumbago.functions import similarity as S
from plumbago.functions import text as T
from plumbago.operators import dedup
from plumbago.operators.tables import stored

#: Relations and the kind of subsection they belong to, looked up in this order.
SUBSECTIONS = {
    "is_a": "Definition", "is a": "Definition", "defines": "Definition", "defined_by": "Definition", "type_of": "Definition",
    "uses": "Protocols & Usage", "implemented_by": "Protocols & Usage", "achieves_via": "Protocols & Usage", "responsible_for": "Protocols & Usage", "provides": "Protocols & Usage", "ensures": "Protocols & Usage", "connects": "Protocols & Usage",
    "part_of": "Components & Structure", "comprises": "Components & Structure", "contains": "Components & Structure", "consists_of": "Components & Structure",
    "property": "Properties", "has_property": "Properties", "compares_to": "Properties",
    "causes": "Applications", "results_in": "Applications", "depends_on": "Applications",
}
OTHER_SUBSECTION = "Key Points"

#: Parts of section headings in teaching order; headings with none of them come last.
TEACHING_ORDER = (
    ("workflow", "pipeline", "overview", "compiler", "lexical", "syntax", "semantic", "process", "phases", "stage", "stages", "analysis"),
    ("definition", "what is", "classification", "types", "categories", "kinds", "grammar", "context free", "cfg", "formal", "language"),
    ("parser", "parsing", "descent", "recursive", "predictive", "top down", "bottom up", "ll", "lr", "slr"),
    ("production", "rule", "terminal", "non-terminal", "epsilon", "derivation", "leftmost", "rightmost", "symbol", "grammatical", "non terminal"),
    ("procedure", "function", "match", "lookahead", "look ahead", "variable", "input", "buffer", "token", "character", "char", "main function"),
    ("backtrack", "backtracking", "left recursion", "non-determinism", "ambiguity", "factoring", "elimination"),
    ("tree", "parse tree", "abstract syntax", "ast", "stack", "queue"),
    ("example", "grammar", "illustration", "walkthrough", "trace", "e ->", "e'", "conditional", "statement"),
)

#: Discourse roles of sentences in order, and what a sentence of the role holds.
DISCOURSE = (
    ("definition", ("definition", "what is", "refers to", "means", "defined as", "is a", "overview", "introduction", "purpose", "goal")),
    ("components", ("phase", "stage", "step", "component", "part", "includes", "consists of", "contains", "has", "comprises", "divided into")),
    ("process", ("first", "then", "next", "after", "before", "during", "finally", "input", "output", "takes", "produces", "converts")),
    ("supporting", ("table", "storage", "handler", "manager", "structure", "throughout", "across", "auxiliary", "helper", "support")),
    ("architecture", ("front end", "back end", "frontend", "backend", "split", "divided", "organization", "layer", "level", "tier")),
    ("tools", ("example", "such as", "like", "tool", "implementation", "lex", "yacc", "gcc", "application", "practice", "used in")),
    ("summary", ("summary", "conclusion", "overall", "in general", "thus", "therefore", "ultimately", "key", "main", "important")),
)

#: Levels of abstraction, each by a pattern; the first that matches counts, in the order tried.
LEVELS_TRIED = (
    ("example", r"(?i)\b(e\.g\.|for example|such as|like|real.?life|real.?world|instance|illustration)\b"),
    ("actor", r"(?i)\b(user|developer|programmer|engineer|designer|manager|administrator|analyst|operator|teacher|student|client|server)\b"),
    ("algorithm", r"(?i)\b(algorithm|procedure|method|approach|technique|strategy|step|process|routine)\b"),
    ("operation", r"(?i)\b(push|pop|insert|delete|remove|search|retrieve|traverse|sort|merge|split|enqueue|dequeue|peek|top|front|rear|size|empty|full)\b"),
    ("concept", r"(?i)\b(is a|is defined|property|characteristic|principle|rule|definition|abstract|type of|kind of)\b"),
)
LEVEL_ORDER = ("concept", "algorithm", "operation", "example", "actor")


def subsection_of(relation: Column) -> Column:
    """Exact, then with blanks, then the first entry that holds the relation or is held by it."""
    plain = F.lower(F.trim(F.coalesce(relation, F.lit(""))))
    key = F.replace(F.lower(F.trim(F.coalesce(relation, F.lit("")))), F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for pair in SUBSECTIONS.items() for x in pair))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SUBSECTIONS.items()))
    near = F.get(F.filter(entries, lambda e: F.contains(key, e["k"]) | F.contains(e["k"], key)), F.lit(0))["v"]
    return F.when(plain == "", OTHER_SUBSECTION).otherwise(F.coalesce(F.try_element_at(table, key), F.try_element_at(table, plain), near, F.lit(OTHER_SUBSECTION)))


def teaching_weight(heading: Column) -> Column:
    h, out = F.lower(F.trim(F.coalesce(heading, F.lit("")))), F.when(F.lit(False), 0)
    for weight, cues in enumerate(TEACHING_ORDER, 1):
        out = out.when(F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(h, c)), weight)
    return out.otherwise(len(TEACHING_ORDER) + 1)


def discourse_role(sentence: Column) -> Column:
    """struct(role, priority): most cues held, ties to the earlier role; ('other', 100) without any."""
    s = F.lower(F.coalesce(sentence, F.lit("")))
    hits = [F.struct(sum((F.contains(s, F.lit(c)).cast("int") for c in cues), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("role")) for i, (name, cues) in enumerate(DISCOURSE)]
    best = F.greatest(*hits)
    return F.when(best["n"] > 0, F.struct(best["role"].alias("role"), (1 - best["i"]).alias("priority"))).otherwise(F.struct(F.lit("other").alias("role"), F.lit(100).alias("priority")))


def abstraction_level(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in LEVELS_TRIED:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("concept")


def _dense(points: DataFrame, column: str, by: list[str], order: list) -> DataFrame:
    return points.withColumn(column, F.dense_rank().over(W.partitionBy(*by).orderBy(*order)) - 1)


def keep_points(points: DataFrame, condition: Column) -> DataFrame:
    """Points that meet the condition; positions close up."""
    return renumbered(points.where(condition))


def renumbered(points: DataFrame) -> DataFrame:
    out = _dense(points, "sec_pos", ["notes_id"], ["sec_pos"])
    out = _dense(out, "sub_pos", ["notes_id", "sec_pos"], ["sub_pos"])
    return out.withColumn("pt_pos", F.row_number().over(W.partitionBy("notes_id", "sec_pos", "sub_pos").orderBy("pt_pos")) - 1)


def rewrite(points: DataFrame, change: Callable[[Column], Column], column: str = "text", drop_empty: bool = True) -> DataFrame:
    """A column expression applied to every point or heading; points left empty go."""
    out = points.withColumn(column, change(F.col(column)))
    return keep_points(out, F.length(F.trim("text")) > 0) if drop_empty else out


def in_teaching_order(points: DataFrame) -> DataFrame:
    """Sections by teaching weight, then as they were."""
    return _dense(points.withColumn("_w", teaching_weight(F.col("sec_heading"))), "sec_pos", ["notes_id"], ["_w", "sec_pos"]).drop("_w")


def by_abstraction(points: DataFrame, more_than: int = 2) -> DataFrame:
    """Points of subsections with more than so many, from concept to actor, then as they were."""
    sub = W.partitionBy("notes_id", "sec_pos", "sub_pos")
    level = F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), abstraction_level(F.col("text")))
    out = points.withColumn("_l", F.when(F.count("*").over(sub) > more_than, level).otherwise(F.lit(0)))
    return out.withColumn("pt_pos", F.row_number().over(sub.orderBy("_l", "pt_pos")) - 1).drop("_l")


def promoted(points: DataFrame, least: int = 4) -> DataFrame:
    """Subsections of `least` points or more as sections of their own, before the section they stood in."""
    sub = W.partitionBy("notes_id", "sec_pos", "sub_pos")
    marked = points.withColumn("_up", F.count("*").over(sub) >= least)
    moved = marked.withColumn("_k", F.when(F.col("_up"), F.col("sub_pos")).otherwise(F.lit(2**31 - 1)))
    headed = moved.withColumn("sec_heading", F.when(F.col("_up"), F.col("sub_heading")).otherwise(F.col("sec_heading"))).withColumn("sub_heading", F.when(F.col("_up"), F.lit("Overview")).otherwise(F.col("sub_heading")))
    return renumbered(_dense(headed, "sec_pos", ["notes_id"], ["sec_pos", "_k"]).drop("_up", "_k"))


def merged_subsections(points: DataFrame) -> DataFrame:
    """Subsections of one section whose headings are equal but for case are one, without points repeated in it."""
    key = F.lower(F.trim("sub_heading"))
    same = W.partitionBy("notes_id", "sec_pos", key)
    first = points.withColumn("_s", F.min("sub_pos").over(same)).withColumn("_h", F.first("sub_heading").over(same.orderBy("sub_pos", "pt_pos")))
    place = F.row_number().over(W.partitionBy("notes_id", "sec_pos", "_s", F.lower(F.trim("text"))).orderBy("sub_pos", "pt_pos"))
    kept = first.withColumn("_r", place).where("_r = 1")
    kept = kept.withColumn("pt_pos", F.row_number().over(W.partitionBy("notes_id", "sec_pos", "_s").orderBy("sub_pos", "pt_pos")) - 1)
    return renumbered(kept.withColumn("sub_pos", F.col("_s")).withColumn("sub_heading", F.col("_h")).drop("_s", "_h", "_r"))


def distinct_points(points: DataFrame) -> DataFrame:
    """Points whose text, case and blanks aside, has not stood earlier in the notes."""
    place = F.row_number().over(W.partitionBy("notes_id", F.lower(T.collapse(F.col("text")))).orderBy("sec_pos", "sub_pos", "pt_pos"))
    return renumbered(points.withColumn("_r", place).where("_r = 1").drop("_r"))


def by_relation(points: DataFrame, relation_col: str = "relation") -> DataFrame:
    """Points of each section regrouped under the subsection kinds of their relations, in the order of first use."""
    kinds = [*dict.fromkeys(SUBSECTIONS.values()), OTHER_SUBSECTION]
    out = points.withColumn("_h", subsection_of(F.col(relation_col)))
    out = out.withColumn("_o", F.array_position(F.array(*map(F.lit, kinds)), F.col("_h")))
    out = out.withColumn("pt_pos", F.row_number().over(W.partitionBy("notes_id", "sec_pos", "_h").orderBy("sub_pos", "pt_pos")) - 1)
    return renumbered(out.withColumn("sub_pos", F.col("_o")).withColumn("sub_heading", F.col("_h")).drop("_h", "_o", relation_col))


def violations(notes: DataFrame) -> DataFrame:
    """(notes_id, rule, sec, sub, pt): what breaks the contract of nested notes(notes_id, title, sections).

    A title, two sections or more, a heading and a subsection for each section, a heading and a point for each
    subsection, and a text for each point.
    """
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    none = F.lit(None).cast("int")
    row = lambda df, rule, sec, sub, pt: df.select("notes_id", F.lit(rule).alias("rule"), sec.alias("sec"), sub.alias("sub"), pt.alias("pt"))
    sections = notes.select("notes_id", F.posexplode(F.coalesce("sections", F.array())).alias("i", "s"))
    subs = sections.select("notes_id", "i", F.posexplode(F.coalesce("s.subsections", F.array())).alias("j", "u"))
    points = subs.select("notes_id", "i", "j", F.posexplode(F.coalesce("u.points", F.array())).alias("k", "p"))
    size = lambda c: F.size(F.coalesce(c, F.array()))
    i, j, k = (F.col(c) + 1 for c in "ijk")
    found = [
        row(notes.where(blank(F.col("title"))), "title", none, none, none),
        row(notes.where(size("sections") < 2), "sections", none, none, none),
        row(sections.where(blank(F.col("s.heading"))), "section heading", i, none, none),
        row(sections.where(size("s.subsections") < 1), "subsections", i, none, none),
        row(subs.where(blank(F.col("u.heading"))), "subsection heading", i, j, none),
        row(subs.where(size("u.points") < 1), "points", i, j, none),
        row(points.where(blank(F.col("p.text"))), "text", i, j, k),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def flattened(notes: DataFrame) -> DataFrame:
    """Nested notes as points."""
    sections = notes.select("notes_id", "title", F.posexplode("sections").alias("sec_pos", "s"))
    subs = sections.select("notes_id", "title", "sec_pos", F.col("s.heading").alias("sec_heading"), F.posexplode("s.subsections").alias("sub_pos", "u"))
    return subs.select("notes_id", "title", "sec_pos", "sec_heading", "sub_pos", F.col("u.heading").alias("sub_heading"), F.posexplode("u.points").alias("pt_pos", "p")).select("*", F.col("p.text").alias("text")).drop("p")


def nested(points: DataFrame) -> DataFrame:
    """Points as notes(notes_id, title, sections): the children of a parent are gathered by partial aggregates."""
    strip = lambda c, f: F.transform(F.array_sort(F.collect_list(c)), f)
    subs = points.groupBy("notes_id", "title", "sec_pos", "sec_heading", "sub_pos", "sub_heading").agg(strip(F.struct("pt_pos", "text"), lambda p: F.struct(p["text"].alias("text"))).alias("points"))
    sections = subs.groupBy("notes_id", "title", "sec_pos", "sec_heading").agg(strip(F.struct("sub_pos", "sub_heading", "points"), lambda u: F.struct(u["sub_heading"].alias("heading"), u["points"].alias("points"))).alias("subsections"))
    return sections.groupBy("notes_id", "title").agg(strip(F.struct("sec_pos", "sec_heading", "subsections"), lambda s: F.struct(s["sec_heading"].alias("heading"), s["subsections"].alias("subsections"))).alias("sections"))


def _each(points: DataFrame, *by: str):
    return W.partitionBy("notes_id", *by)


def without(points: DataFrame, bad: Column, spare: Column | None = None) -> DataFrame:
    """Points that are not bad. With spare, a subsection that would lose all of them keeps those to be spared."""
    if spare is None:
        return keep_points(points, ~bad)
    marked = points.withColumn("_bad", bad)
    all_bad = F.min(F.col("_bad").cast("int")).over(_each(points, "sec_pos", "sub_pos")) == 1
    return renumbered(marked.withColumn("_all", all_bad).where(~F.col("_bad") | (F.col("_all") & spare)).drop("_bad", "_all"))


def without_meta_noise(points: DataFrame) -> DataFrame:
    return without(points, B.is_meta_noise(F.col("text")))


def without_triple_dumps(points: DataFrame) -> DataFrame:
    """Edges written out go, their suffixes go from others, and what is under three words then."""
    left = rewrite(without(points, B.is_triple_dump(F.col("text"))), R.without_edge_suffixes)
    return keep_points(left, F.size(B.words(F.col("text"))) >= 3)


def without_tautologies(points: DataFrame) -> DataFrame:
    """A subsection keeps its first point if all are circular."""
    first = F.col("pt_pos") == F.min("pt_pos").over(_each(points, "sec_pos", "sub_pos"))
    marked = points.withColumn("_first", first)
    return without(marked, B.is_tautology(F.col("text")), F.col("_first")).drop("_first")


def without_circular_definitions(points: DataFrame) -> DataFrame:
    """Circular definitions rewritten where they can be, else gone; a subsection of such only keeps them as they are."""
    text = F.col("text")
    marked = points.withColumn("_t", F.when(B.is_circular_definition(text), R.without_self_example(text)).otherwise(text))
    none = F.count("_t").over(_each(points, "sec_pos", "sub_pos")) == 0
    return renumbered(marked.withColumn("_n", none).where("_t is not null or _n").withColumn("text", F.coalesce("_t", "text")).drop("_t", "_n"))


def without_course_sections(points: DataFrame) -> DataFrame:
    """Sections that name a course or unit go, and those of three points or fewer that frame one."""
    counted = points.withColumn("_n", F.count("*").over(_each(points, "sec_pos")))
    return renumbered(counted.where(~B.is_course_heading(F.col("sec_heading"), F.col("_n"))).drop("_n"))


def without_navigation(points: DataFrame) -> DataFrame:
    return without(points, B.is_navigation(F.col("text")))


def without_takeaways(points: DataFrame) -> DataFrame:
    return without(points, B.is_takeaways(F.col("sub_heading")))


def without_ocr_noise(points: DataFrame) -> DataFrame:
    """Points that are clean text and no leak of graph or lecture."""
    return without(points, ~Q.is_clean(F.col("text")) | B.is_semantic_noise(F.col("text")))


def with_lesson_headings(points: DataFrame) -> DataFrame:
    return points.withColumn("sub_heading", R.heading_of_kind(F.col("sub_heading")))


def stub_sections(points: DataFrame, most: int = 2) -> DataFrame:
    """(notes_id, sec_pos, n): sections of so many points or fewer."""
    return points.groupBy("notes_id", "sec_pos").agg(F.count("*").alias("n")).where(F.col("n") <= most)


def headings_from_words(points: DataFrame, bad: Callable[[Column], Column] = B.is_generic_heading) -> DataFrame:
    """Section headings without noise; where one fits any section, the two commonest words of its points that it is not,
    ties to the earlier word. Words have four letters or more and are no stop words; without any the heading stays."""
    clean = points.withColumn("sec_heading", R.without_heading_noise(F.col("sec_heading")))
    lost = clean.where(bad(F.col("sec_heading")))
    words = lost.select("notes_id", "sec_pos", "sec_heading", F.struct("sub_pos", "pt_pos").alias("at"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("k", "word")).where(~F.col("word").isin(*HEADING_STOPS))
    counts = words.groupBy("notes_id", "sec_pos", "sec_heading", "word").agg(F.count("*").alias("n"), F.min(F.struct("at", "k")).alias("first"))
    order = _each(points, "sec_pos").orderBy(F.desc("n"), "first")
    top = counts.withColumn("r", F.row_number().over(order)).where("r <= 3").where(F.col("word") != F.lower(F.trim("sec_heading")))
    named = top.groupBy("notes_id", "sec_pos").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("r", F.initcap("word").alias("w")))), 1, 2), lambda x: x["w"]).alias("ws"))
    out = clean.join(named, ["notes_id", "sec_pos"], "left")
    return out.withColumn("sec_heading", F.coalesce(F.array_join("ws", " and "), F.when(bad(F.col("sec_heading")), F.initcap("sec_heading")).otherwise(F.col("sec_heading")))).drop("ws")


#: Words that name no topic.
HEADING_STOPS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "this", "that", "with", "from", "into", "and", "or", "but", "for", "to", "of", "in", "on", "at", "by", "data", "level", "system", "which", "what", "how", "when",
    "will", "can", "its", "their", "these", "those", "also", "some", "such", "each", "within", "between", "both", "used", "using", "use", "type", "types", "layer",
    "key", "concept", "domain", "additional", "notes", "general", "contextual", "relationships", "definition", "fundamental", "structure", "components",
    "header", "overview", "introduction", "summary", "conclusion", "services",
)


#: The steps of improve(), by name, in order.
STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "question_marks": lambda p: rewrite(p, T.without_question_marks),
    "polish": lambda p: rewrite(p, T.polished),
    "symbols": lambda p: keep_points(p, ~Q.is_symbols_only(F.col("text"))),
    "meta_noise": without_meta_noise,
    "triple_dumps": without_triple_dumps,
    "navigation": without_navigation,
    "takeaways": without_takeaways,
    "course_sections": without_course_sections,
    "self_loops": lambda p: keep_points(p, ~Q.is_self_loop(F.col("text"))),
    "circular_definitions": without_circular_definitions,
    "tautologies": without_tautologies,
    "lesson_headings": with_lesson_headings,
    "merge_subsections": merged_subsections,
    "distinct": distinct_points,
    "abstraction": by_abstraction,
    "teaching_order": in_teaching_order,
}


def improve(points: DataFrame, steps: Sequence[str] = ()) -> DataFrame:
    """The named steps, or all of them, one after the other."""
    for name, step in STEPS.items():
        if not steps or name in steps:
            points = step(points)
    return points


def chunked(docs: DataFrame, budget: int = 900, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, chunk, text): sentences in order, a new chunk where the next would pass the budget of words.

    A running sum cannot start anew, so each text is folded as one array; no text leaves its row.
    """
    parts = T.sentences(F.col(text_col))
    size = lambda s: F.size(F.split(s, r"\s+"))
    zero = F.expr("named_struct('done', cast(array() as array<array<string>>), 'open', cast(array() as array<string>), 'n', 0)")
    step = lambda a, s: F.when(
        (a["n"] > 0) & (a["n"] + size(s) > budget), F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.array(s).alias("open"), size(s).alias("n"))
    ).otherwise(F.struct(a["done"].alias("done"), F.array_append(a["open"], s).alias("open"), (a["n"] + size(s)).alias("n")))
    folded = F.aggregate(parts, zero, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))
    return docs.select(key, F.posexplode(folded).alias("chunk", "s")).select(key, "chunk", F.concat(F.array_join("s", ". "), F.lit(".")).alias("text"))


def count_points(points: DataFrame, *by: str) -> DataFrame:
    """Points of each notes, or of each of their parts."""
    return points.groupBy("notes_id", *by).agg(F.count("*").alias("n_points"))


def section_words(points: DataFrame, least: int = 4, stops: tuple[str, ...] = HEADING_STOPS) -> DataFrame:
    """(notes_id, sec_pos, word, n): how often words of `least` letters or more stand in a section's points."""
    words = points.select("notes_id", "sec_pos", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), 0)).alias("word"))
    return words.where(~F.col("word").isin(*stops)).groupBy("notes_id", "sec_pos", "word").agg(F.count("*").alias("n"))


def first_images(images: DataFrame) -> DataFrame:
    """images(notes_id, sec_pos, path) without those whose file name, its ending and case aside, an earlier section has."""
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.lower("path"), r"[/\\\\]+$", ""), r"([^/\\\\]*)$", 1), r"\.\w{2,4}$", "")
    place = F.row_number().over(W.partitionBy("notes_id", "_stem").orderBy("sec_pos"))
    return images.where("path <> ''").withColumn("_stem", name).withColumn("_r", place).where("_r = 1").drop("_stem", "_r")


def with_captions(assets: DataFrame, captions: DataFrame, default: str = "No caption available.") -> DataFrame:
    """assets(name, ...) with the caption of captions(name, caption), or the default; the last by name wins a tie."""
    one = captions.groupBy("name").agg(F.max("caption").alias("caption"))
    return assets.join(one, "name", "left").withColumn("caption", F.coalesce("caption", F.lit(default)))


#: What marks a definition.
DEFINITION = r"(?i)\b(is\s+a\b|is\s+an\b|is\s+defined|refers\s+to|known\s+as|is\s+described\s+as|is\s+considered)\b"


def like_pairs(headings: DataFrame, words: Column, like: Column) -> DataFrame:
    """(grp, first, later) of headings(grp, pos, heading) that are alike: words are an array of the heading's, `like` a
    condition on n, the words shared, and a and b, those of either. Headings meet by the words they share."""
    own = headings.select("grp", "pos", words.alias("ws"))
    each = lambda pos, size: own.select("grp", F.col("pos").alias(pos), F.size("ws").alias(size), F.explode("ws").alias("w"))
    pairs = each("first", "a").join(each("later", "b"), ["grp", "w"]).where("first < later")
    return pairs.groupBy("grp", "first", "later").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where(like).select("grp", "first", "later")


def owners(headings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, pos, owner): each heading's first like one before it that has no owner but itself, else itself."""
    at = lambda c: F.struct("grp", F.col(c).alias("pos"))
    kept = dedup.chain_kept(headings.select(at("pos").alias("id")), pairs.select(at("first").alias("first"), at("later").alias("later")))
    chosen = pairs.join(kept.select(F.col("id.grp").alias("grp"), F.col("id.pos").alias("first")), ["grp", "first"], "left_semi").groupBy("grp", F.col("later").alias("pos")).agg(F.min("first").alias("owner"))
    return headings.join(chosen, ["grp", "pos"], "left").select("grp", "pos", F.coalesce("owner", "pos").alias("owner"))


def _joined(points: DataFrame, owned: DataFrame) -> DataFrame:
    """Sections moved into their owners: subsections of one heading are one, texts of one stand once, case aside."""
    first = points.groupBy("notes_id", F.col("sec_pos").alias("owner")).agg(F.first("sec_heading").alias("_h"))
    moved = points.join(owned.withColumnsRenamed({"grp": "notes_id", "pos": "sec_pos"}), ["notes_id", "sec_pos"]).join(first, ["notes_id", "owner"])
    key = F.lower("sub_heading")
    sub = W.partitionBy("notes_id", "owner", key)
    moved = moved.withColumn("_sub", F.min(F.struct("sec_pos", "sub_pos", "sub_heading")).over(sub))
    place = F.row_number().over(W.partitionBy("notes_id", "owner", key, F.lower("text")).orderBy("sec_pos", "sub_pos", "pt_pos"))
    kept = moved.withColumn("_r", place).where("_r = 1")
    subs = W.partitionBy("notes_id", "owner").orderBy("_sub.sec_pos", "_sub.sub_pos")
    kept = kept.withColumn("_p", F.dense_rank().over(subs) - 1).withColumn("_k", F.row_number().over(W.partitionBy("notes_id", "owner", "_sub").orderBy("sec_pos", "sub_pos", "pt_pos")) - 1)
    return renumbered(kept.select("notes_id", "title", F.col("owner").alias("sec_pos"), F.col("_h").alias("sec_heading"), F.col("_p").alias("sub_pos"), F.col("_sub.sub_heading").alias("sub_heading"), F.col("_k").alias("pt_pos"), "text"))


def _sections(points: DataFrame) -> DataFrame:
    return points.select(F.col("notes_id").alias("grp"), F.col("sec_pos").alias("pos"), F.col("sec_heading").alias("heading")).distinct()


def merged_topics(points: DataFrame) -> DataFrame:
    """Sections whose headings are one topic, by half of all words or all of the smaller's, moved into the first."""
    headings = _sections(points)
    pairs = like_pairs(headings, S._long_words(F.col("heading"), S.TOPIC_STOPS), F.expr("n >= 0.5 * (a + b - n) or n = least(a, b)"))
    return _joined(points, owners(headings, pairs))


def merged_headings(points: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Sections whose headings share so many of the larger's words moved into the first."""
    headings = _sections(points)
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("heading"), r"[^a-z\s]", ""), r"\s+"), lambda w: w != ""))
    return _joined(points, owners(headings, like_pairs(headings, words, F.expr(f"n >= {threshold} * greatest(a, b)"))))


def merged_like_subsections(points: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Subsections of one section that share so many of the larger's words as one, under the shortest heading, without
    texts that stand there twice, case aside. They are compared by the headings that they came with."""
    grp = F.struct("notes_id", "sec_pos")
    headings = points.select(grp.alias("grp"), F.col("sub_pos").alias("pos"), F.col("sub_heading").alias("heading")).distinct()
    owned = owners(headings, like_pairs(headings, S._long_words(F.col("heading"), S.SUBSECTION_STOPS), F.expr(f"n >= {threshold} * greatest(a, b)")))
    moved = points.join(owned.select("grp.*", F.col("pos").alias("sub_pos"), "owner"), ["notes_id", "sec_pos", "sub_pos"])
    every = W.partitionBy("notes_id", "sec_pos", "owner")
    named = moved.withColumn("_h", F.min(F.struct(F.length("sub_heading").alias("n"), "sub_pos", "sub_heading")).over(every)["sub_heading"])
    kept = named.withColumn("_r", F.row_number().over(W.partitionBy("notes_id", "sec_pos", "owner", F.lower("text")).orderBy("sub_pos", "pt_pos"))).where("_r = 1")
    kept = kept.withColumn("pt_pos", F.row_number().over(every.orderBy("sub_pos", "pt_pos")) - 1)
    return renumbered(kept.withColumn("sub_pos", F.col("owner")).withColumn("sub_heading", F.col("_h")).drop("owner", "_h", "_r").select(*points.columns))


def without_repeated_definitions(points: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Of two definitions in different sections that share so many of the larger's words, the one in the section of fewer
    points goes, the later if both have as many.

    Two definitions that alike share a word among the rarest of each: one of n words is filed under its
    n - ceil(threshold n) + 1 rarest, and only those filed together are compared, so words that every definition holds
    bring nothing together.
    """
    sized = points.withColumn("_n", F.count("*").over(W.partitionBy("notes_id", "sec_pos"))).where(F.col("text").rlike(DEFINITION))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s]", ""), r"\s+"), lambda w: w != ""))
    own = stored(sized.select("notes_id", F.struct("sec_pos", "sub_pos", "pt_pos").alias("at"), "_n", words.alias("ws")), "definitions")
    each = own.select("notes_id", "at", F.explode("ws").alias("w"))
    rare = each.join(each.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("notes_id", "at").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    kept = F.size("ws") - F.ceil(threshold * F.size("ws") - 1e-9).cast("int") + 1
    filed = stored(rare.select("notes_id", "at", F.explode(F.slice("ws", F.lit(1), kept)).alias("f")).select("notes_id", "at", F.col("f.w").alias("w")), "filed")
    near = filed.withColumnRenamed("at", "x").join(filed.withColumnRenamed("at", "y"), ["notes_id", "w"]).where("x.sec_pos < y.sec_pos").select("notes_id", "x", "y").distinct()
    side = lambda at, n, ws: own.select("notes_id", F.col("at").alias(at), F.col("_n").alias(n), F.col("ws").alias(ws))
    both = near.join(side("x", "nx", "wx"), ["notes_id", "x"]).join(side("y", "ny", "wy"), ["notes_id", "y"])
    like = both.where(F.size(F.array_intersect("wx", "wy")) >= threshold * F.greatest(F.size("wx"), F.size("wy")))
    gone = like.select("notes_id", F.when(F.col("nx") >= F.col("ny"), F.col("y")).otherwise(F.col("x")).alias("at")).select("notes_id", "at.*").distinct()
    return renumbered(points.join(gone, ["notes_id", "sec_pos", "sub_pos", "pt_pos"], "left_anti"))
