"""Compound sentences as triples, and a text said again from them: one sentence a subject, by topic, in paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import text as T
from plumbago.operators import dedup, narrative

#: Relations in the order they are tried; how a relation is said, others being LOOSE; relations that class.
RELATIONS = (
    r"\b(includes|contains|has|comprises)\b",
    r"\b(is a|is an|is|are)\b",
    r"\b(uses|supports|provides|enables)\b",
    r"\b(defines|describes|represents)\b",
    r"\b(related to|associated with|connected to|covers)\b",
    r"\b(stores|manages|organizes|processes)\b",
    r"\b(implements|performs|allows)\b",
    r"\b(known as|also known as)\b",
)
RELATED = "related to"
PREDICATES = {
    "includes": "includes", "contains": "contains", "has": "has", "consists of": "consists of", "comprises": "comprises", "has part": "consists of",
    "is a": "is a type of", "is type of": "is a type of", "type": "is classified as", "is an": "is an", "is": "is", "are": "are", "is example of": "is an example of", "example of": "exemplifies",
    "uses": "uses", "supports": "supports", "provides": "provides", "enables": "enables", "allows": "allows", "performs": "performs", "implements": "implements",
    "for": "is used for", "used for": "is utilized for", "serves": "serves", "achieves": "achieves",
    "defines": "defines", "describes": "describes", "represents": "represents", "refers to": "refers to", "known as": "is also known as", "also known as": "is also referred to as", "means": "means",
    "causes": "causes", "results in": "results in", "leads to": "leads to", "affects": "affects", "influences": "influences",
    "related to": "is associated with", "associated with": "works with", "connected to": "connects to", "linked to": "is linked with", "covers": "covers",
    "stores": "stores", "holds": "holds", "manages": "manages", "organizes": "organizes", "operates on": "operates on", "processes": "processes", "transforms": "transforms", "optimizes": "optimizes",
}
LOOSE = "is associated with"
IDLE_OBJECTS = ("the", "a", "an", "to", "it", "is")
WEAK = ("is associated with", "is understood through", "combines to form program", "is related to")
#: What a sentence of a priority may begin with, by turns, and what any may; the closing sentence.
TRANSITIONS = {2: ("Additionally", "Furthermore", "Moreover"), 5: ("In practice", "Specifically", "For instance"), 6: ("Overall", "In summary", "Ultimately")}
ANY_TRANSITION = ("Additionally", "Furthermore", "Also")
CLOSING = " Overall, {} plays a fundamental role in forming the structural foundation and efficient management of the domain architecture."


def _either(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def cleaned(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with these columns without marks at the ends, with single blanks and full stops, their first letter a capital.
    Two steps, so that the plan holds each rewrite once."""
    bare = lambda c: F.regexp_replace(T.collapse(_without(T.stripped(F.col(c)), r"^[.,;:]+|[.,;:]+$")), r"\.+", ".")
    rows = rows.withColumns({c: bare(c) for c in columns})
    return rows.withColumns({c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(F.col(c), F.lit(2), F.greatest(F.length(c), F.lit(1)))) for c in columns})


def _with_relation(rows: DataFrame) -> DataFrame:
    """rows(part) with relation and object: the first of RELATIONS that begins the part, else the first that it holds,
    else RELATED and all of it."""
    whole = ["(?is)" + lead + p + "(.*)$" for lead in ("^()", "^(.*?)") for p in RELATIONS]
    rows = rows.withColumn("by", F.coalesce(*(F.when(F.col("part").rlike(p), F.lit(p)) for p in whole)))
    relation, obj = F.expr("lower(regexp_extract(part, by, 2))"), F.expr("regexp_extract(part, by, 3)")
    return rows.withColumns({"relation": F.coalesce(relation, F.lit(RELATED)), "object": F.coalesce(obj, F.col("part"))}).drop("by")


def triples(sentences: DataFrame) -> DataFrame:
    """(key, place, subject, relation, object) of sentences(key, pos, sentence), as written.

    What stands before the first relation is the subject of every part between commas from there on. A sentence that
    begins with a relation has its first two words as subject, if it has three; one without a relation has no triple.
    place orders the triples of a key.
    """
    parts = sentences.select("key", "pos", F.posexplode(F.split(T.stripped(F.col("sentence")), r"(?<=[.!?])\s+")).alias("k", "s"))
    rows = parts.select("key", "pos", "k", _without(T.stripped(F.col("s")), r"\.+$").alias("s")).where("s <> ''")
    at = F.regexp_instr("s", F.lit(_either(RELATIONS)))
    rows = rows.withColumn("at", at).where("at > 0")
    rows = rows.withColumn("lead", T.stripped(F.substring(F.col("s"), F.lit(1), F.col("at") - 1))).withColumn("words", F.split(T.stripped(F.col("s")), r"\s+"))
    subject = F.when(F.col("lead") != "", F.col("lead")).when(F.size("words") >= 3, F.array_join(F.slice("words", 1, 2), " "))
    rows = rows.withColumn("subject", T.stripped(_without(subject, r"(?i)^The\s+"))).where("lead <> '' or size(words) >= 3")
    rest = F.substring(F.col("s"), F.col("at"), F.length("s"))
    each = rows.select("key", "pos", "k", "subject", F.posexplode(F.split(rest, r",\s*")).alias("i", "part")).withColumn("part", T.stripped(F.col("part"))).where("part <> ''")
    found = _with_relation(each)
    bare = _without(_without(_without(T.stripped(F.col("object")), r"[.,;]+$"), r"(?i)^to\s+"), r"(?i)^the\s+")
    out = found.select("key", F.struct("pos", "k", "i").alias("place"), "subject", "relation", bare.alias("object"))
    return out.where(F.length("object") > 1)


def clean_triples(found: DataFrame) -> DataFrame:
    """triples() cleaned: ends of two characters or more that aren't equal, no idle object or weak relation; of equal ones
    the first, and of those between the same two ends, either way round, the first; data and information are one pair."""
    rows = cleaned(found.select("key", "place", "subject", F.lower(T.stripped(F.col("relation"))).alias("relation"), "object"), "subject", "object")
    s, o = F.lower("subject"), F.lower("object")
    rows = rows.where((F.length("subject") >= 2) & (F.length("object") >= 2) & (s != o) & ~o.isin(*IDLE_OBJECTS) & ~F.col("relation").isin(*WEAK))
    holds = lambda c, word: F.contains(c, F.lit(word))
    turned = (holds(s, "data") & holds(o, "information")) | (holds(s, "information") & holds(o, "data"))
    pair = F.when(turned, F.array(F.lit("data_transformation"))).otherwise(F.array_sort(F.array(s, o)))
    return rows.withColumn("pair", pair).groupBy("key", "pair").agg(F.min_by(F.struct("place", "subject", "relation", "object"), "place").alias("t")).select("key", "t.*")


def _listed(items: Column, last: str, many: str) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(items)
    return F.when(n == 1, items[0]).when(n == 2, F.concat(F.get(items, F.lit(0)), F.lit(last), F.get(items, F.lit(1)))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(many), F.element_at(items, -1)))


def subject_sentences(found: DataFrame) -> DataFrame:
    """(key, place, sentence): clean_triples() said again, one sentence for each subject, case aside, in the order that
    the subjects first stand in; one clause a relation, its objects listed."""
    subject = F.lower(T.stripped(F.col("subject")))
    said = found.withColumn("who", subject).groupBy("key", "who", "relation").agg(
        F.min("place").alias("first"), F.min_by("subject", "place").alias("subject"), F.transform(F.array_sort(F.collect_list(F.struct("place", "object"))), lambda x: x["object"]).alias("objects")
    )
    names = F.create_map(*(F.lit(x) for pair in PREDICATES.items() for x in pair))
    clause = F.concat_ws(" ", F.coalesce(F.element_at(names, F.col("relation")), F.lit(LOOSE)), _listed(F.col("objects"), " and ", ", and "))
    method = F.col("who").isin("data structure", "data structures") & F.contains(F.lower(F.array_join("objects", " ")), F.lit("type of particular way"))
    rows = said.withColumn("clause", F.when(method, F.lit("is a systematic method for organizing data")).otherwise(clause))
    whole = rows.groupBy("key", "who").agg(F.min("first").alias("place"), F.min_by("subject", "first").alias("subject"), F.transform(F.array_sort(F.collect_list(F.struct("first", "clause"))), lambda x: x["clause"]).alias("clauses"))
    text = F.concat(F.col("subject"), F.lit(" "), _listed(F.col("clauses"), " and ", ", and "), F.lit("."))
    return whole.select("key", "place", F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))).alias("sentence"))


def _first_priority(sentence: Column) -> Column:
    """The priority of the first cue of PRIORITIES, in their order, that a sentence holds; else 10."""
    low = F.lower(sentence)
    cues = F.array(*(F.struct(F.lit(cue).alias("cue"), F.lit(p).alias("p")) for cue, p in narrative.PRIORITIES.items()))
    return F.coalesce(F.get(F.filter(cues, lambda x: F.contains(low, x["cue"])), F.lit(0))["p"], F.lit(10))


def in_paragraphs(sentences: DataFrame) -> DataFrame:
    """(key, place from 0, sentence): sentences(key, place, sentence) without those that hold the same words, by topic,
    and with transitions: every third by its priority's, every fourth from the fourth on by any, by turns."""
    once = sentences.groupBy("key", dedup.sentence_key(F.col("sentence")).alias("same")).agg(F.min_by("sentence", "place").alias("sentence"), F.min("place").alias("place"))
    order = W.partitionBy("key").orderBy("topic", "place")
    rows = once.withColumn("topic", narrative.sentence_priority(F.col("sentence"))).withColumn("i", F.row_number().over(order) - 1)
    first = _first_priority(F.col("sentence"))
    own = (F.col("i") > 1) & first.isin(*TRANSITIONS) & (F.col("i") % 3 == 0)
    any_ = (F.col("i") > 3) & (F.col("i") % 4 == 0)
    rows = rows.withColumn("own", own).withColumn("lead", own | any_).withColumn("first", first)
    turn = F.coalesce(F.sum(F.col("lead").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 3
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("turn") + 1).cast("int"))
    word = F.coalesce(*(F.when(F.col("own") & (F.col("first") == p), pick(words)) for p, words in TRANSITIONS.items()), F.when(F.col("lead"), pick(ANY_TRANSITION)))
    rows = rows.withColumn("turn", turn).withColumn("word", word)
    start = F.substring("sentence", 1, 1)
    begun = F.concat(F.when((start == F.upper(start)) & (start != F.lower(start)), F.lower(start)).otherwise(start), F.substring(F.col("sentence"), F.lit(2), F.length("sentence")))
    return rows.select("key", F.col("i").alias("place"), F.when(F.col("word").isNotNull(), F.concat(F.col("word"), F.lit(", "), begun)).otherwise(F.col("sentence")).alias("sentence"))


def refined(sentences: DataFrame) -> DataFrame:
    """(key, text) of sentences(key, pos, sentence): their triples said again in paragraphs, and a closing sentence about
    the commonest subject, the first of equals; a key without triples keeps its sentences, joined by blanks.

    Null sentences count as empty. All of a key's sentences meet in its row: a key is one text.
    """
    clean = clean_triples(triples(sentences))
    said = in_paragraphs(subject_sentences(clean)).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("said"))
    counts = clean.groupBy("key", "subject").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    main = counts.groupBy("key").agg(F.max_by("subject", F.struct("n", (-F.col("place.pos")).alias("a"), (-F.col("place.k")).alias("b"), (-F.col("place.i")).alias("c"))).alias("main"))
    own = sentences.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("sentence", F.lit("")).alias("s")))), lambda x: x["s"]), " ").alias("own"))
    lead, tail = CLOSING.split("{}")
    out = own.join(said, "key", "left").join(main, "key", "left")
    return out.select("key", F.coalesce(F.concat("said", F.lit(lead), "main", F.lit(tail)), "own").alias("text"))
