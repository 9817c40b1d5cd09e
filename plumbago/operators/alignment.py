"""Sentences of a generated text against a reference: likeness, relevance, coverage and order.

sentences(key, pos, sentence) and references(key, pos, sentence) hold one text a key; concepts(key, concept) what a text
should speak of. Joins are by key, so only sentences of one text meet; what is kept is decided by partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import similarity as S
from plumbago.functions import text as T

#: Kinds of sentences in teaching order, and what a sentence of the kind holds.
STRUCTURE = {
    "definition": ("definition", "what is", "refers to", "means", "is a", "defined as", "overview"),
    "structure": ("structure", "component", "consists of", "contains", "has", "includes", "made of", "parts"),
    "types": ("type", "kind", "category", "classification", "classified", "primitive", "non-primitive", "linear", "non-linear"),
    "operations": ("operation", "function", "method", "process", "traverse", "search", "sort", "insert", "delete", "access"),
    "variants": ("variant", "singly", "doubly", "circular", "array-based", "linked"),
    "applications": ("application", "used for", "example", "practice", "implement", "real-world", "such as"),
    "properties": ("property", "advantage", "disadvantage", "efficient", "complexity", "performance", "time", "space"),
    "limitations": ("limitation", "drawback", "cannot", "not able", "overhead", "memory"),
}
#: What is said of a concept that nothing else is known of, by its kind.
COVERAGE = {
    "definition": "{concept} is a key concept in this domain.",
    "structure": "The structure involves {concept}.",
    "types": "{concept} is a type or classification in this context.",
    "operations": "{concept} is an important operation.",
    "applications": "{concept} is used in practical applications.",
    "properties": "{concept} is a relevant property or characteristic.",
    "default": "{concept} is discussed in this context.",
}
#: How texts say what something does.
FUNCTIONS = (
    r"([A-Za-z\s]+)\s+is\s+responsible\s+for\s+([^.]+)",
    r"([A-Za-z\s]+)\s+performs?\s+([^.]+)",
    r"([A-Za-z\s]+)\s+handles?\s+([^.]+)",
    r"([A-Za-z\s]+)\s+includes?\s+([^.]+)",
    r"([A-Za-z\s]+)\s+converts?\s+([^.]+)",
    r"([A-Za-z\s]+)\s+(?:checks?|validates?|verifies?)\s+([^.]+)",
)
#: Words that are no keywords.
STOPS = tuple(
    (
        "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by "
        "from as into through during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only "
        "own same so than too very just also now and but or if because until while this that these those it its they their them he she him her his we our you your which what who"
    ).split()
)


def words(text: Column) -> Column:
    """Distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z]+\b"), 0))


def likeness(a: Column, b: Column) -> Column:
    """Shared words over the larger set; 0 for a text without words."""
    return S.overlap_max(words(a), words(b))


def category(text: Column, default: str = "other") -> Column:
    """The first kind of STRUCTURE of which the text holds a cue."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.lit(False), "")
    for name, cues in STRUCTURE.items():
        out = out.when(T.holds_any(t, cues), name)
    return out.otherwise(default)


def placed(sentences: DataFrame, weight: Column) -> DataFrame:
    """sentences and their place, from 0, by weight and then as they stood."""
    return sentences.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(weight, "pos")) - 1)


def in_structure(sentences: DataFrame) -> DataFrame:
    return placed(sentences, F.array_position(F.array(*map(F.lit, (*STRUCTURE, "other"))), category(F.col("sentence"))))


def split_sentences(text: Column) -> Column:
    """Stretches up to a mark and white space, of over ten characters."""
    parts = F.transform(F.split(T.stripped(text), r"(?<=[.!?])\s+"), T.stripped)
    return F.filter(parts, lambda s: F.length(s) > 10)


def best_likeness(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """sentences and `best`, the greatest likeness to a reference sentence of the key; 0 without any."""
    own = sentences.select("key", "pos", words(F.col("sentence")).alias("a"))  # the words of each once, not of each pair
    pairs = own.join(references.select("key", words(F.col("sentence")).alias("b")), "key")
    best = pairs.groupBy("key", "pos").agg(F.max(S.overlap_max(F.col("a"), F.col("b"))).alias("best"))
    return sentences.join(best, ["key", "pos"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def _kept(marked: DataFrame, good: Column, given: Column, least: int = 3, first: int = 5) -> DataFrame:
    """Good sentences; the first ones if that leaves under `least` of as many or more; all where nothing is given to go by."""
    every = W.partitionBy("key")
    out = marked.withColumn("_good", good).withColumn("_n", F.sum(F.col("_good").cast("int")).over(every)).withColumn("_all", F.count("*").over(every)).withColumn("_k", F.row_number().over(every.orderBy("pos"))).withColumn("_given", given)
    few = (F.col("_n") < least) & (F.col("_all") >= least)
    return out.where(~F.col("_given") | (few & (F.col("_k") <= first)) | (~few & F.col("_good"))).drop("_good", "_n", "_all", "_k", "_given")


def precise(sentences: DataFrame, references: DataFrame, least: float = 0.4) -> DataFrame:
    """Sentences that are like a reference sentence; keys without any keep all of theirs."""
    known = references.select("key").distinct().withColumn("_known", F.lit(True))
    marked = best_likeness(sentences, references).join(known, "key", "left")
    return _kept(marked, F.col("best") >= least, F.coalesce("_known", F.lit(False))).drop("best", "_known")


def is_relevant(sentence: Column, concept: Column, least: float = 0.5) -> Column:
    """Holds the concept, or half of its words."""
    parts = F.array_distinct(T.tokens(concept))
    return F.contains(F.lower(sentence), F.lower(concept)) | (F.size(F.array_intersect(words(sentence), parts)) >= F.greatest(F.lit(1), F.ceil(least * F.size(parts))))


def relevant(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """Sentences that speak of a concept of their key; keys without concepts keep all of theirs."""
    pairs = sentences.join(concepts.select("key", "concept"), "key")
    hits = pairs.groupBy("key", "pos").agg(F.max(is_relevant(F.col("sentence"), F.col("concept")).cast("int")).alias("hit"))
    marked = sentences.join(hits, ["key", "pos"], "left")
    known = concepts.select("key").distinct().withColumn("_known", F.lit(True))
    return _kept(marked.join(known, "key", "left"), F.coalesce(F.col("hit") == 1, F.lit(False)), F.coalesce("_known", F.lit(False))).drop("hit", "_known")


def anchors(sentences: DataFrame, references: DataFrame, concepts: DataFrame, most: float = 0.7) -> DataFrame:
    """Reference sentences, each once, that hold a concept and that no sentence is more like than `most`."""
    holding = references.join(concepts.select("key", "concept"), "key").where(F.contains(F.lower("sentence"), F.lower("concept"))).groupBy("key", "sentence").agg(F.min("pos").alias("pos"))
    worded = holding.select("key", "pos", words(F.col("sentence")).alias("a"))
    near = worded.join(sentences.select("key", words(F.col("sentence")).alias("b")), "key").where(S.overlap_max(F.col("a"), F.col("b")) > most).select("key", "pos")
    return holding.join(near, ["key", "pos"], "left_anti").select("key", "pos", "sentence")


def whole_texts(sentences: DataFrame) -> DataFrame:
    """(key, text): a key's sentences in order, lower-cased, between blanks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"])
    return sentences.groupBy("key").agg(F.lower(F.array_join(parts, " ")).alias("text"))


def role_functions(references: DataFrame) -> DataFrame:
    """(key, entity, function, sentence): what reference sentences say that something does."""
    found = None
    for pattern in FUNCTIONS:
        pairs = F.arrays_zip(F.regexp_extract_all("sentence", F.lit("(?i)" + pattern), 1).alias("e"), F.regexp_extract_all("sentence", F.lit("(?i)" + pattern), 2).alias("f"))
        one = references.select("key", F.explode(pairs).alias("x")).select("key", T.stripped(F.col("x.e")).alias("entity"), F.regexp_replace(T.stripped(F.col("x.f")), r"\.+$", "").alias("function"))
        found = one if found is None else found.unionByName(one)
    out = found.where((F.length("entity") > 3) & (F.length("function") > 5)).distinct()
    return out.withColumn("sentence", F.concat("entity", F.lit(" is responsible for "), "function", F.lit(".")))


def missing_roles(sentences: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct sentences of roles whose entity a text names without what it does."""
    pairs = roles.join(whole_texts(sentences), "key")
    return pairs.where(F.contains("text", F.lower("entity")) & ~F.contains("text", F.lower("function"))).select("key", "sentence").distinct()


def covered(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """(key, concept): concepts that the text holds."""
    return concepts.select("key", "concept").join(whole_texts(sentences), "key").where(F.contains("text", F.lower("concept"))).select("key", "concept")


def missing(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """(key, concept): concepts of which the text holds neither the whole nor a word of over three letters."""
    pairs = concepts.select("key", "concept").join(whole_texts(sentences), "key", "left").withColumn("text", F.coalesce("text", F.lit("")))
    part = F.exists(F.filter(T.tokens(F.col("concept")), lambda w: F.length(w) > 3), lambda w: F.contains(F.col("text"), w))
    return pairs.where(~F.contains("text", F.lower("concept")) & ~part).select("key", "concept")


def coverage_sentence(concept: Column) -> Column:
    """What COVERAGE says of a concept of its kind."""
    templates = F.create_map(*(F.lit(x) for pair in COVERAGE.items() for x in pair))
    told = F.coalesce(F.try_element_at(templates, category(concept, "default")), F.lit(COVERAGE["default"]))
    return F.replace(told, F.lit("{concept}"), F.initcap(concept))


def capitalised_phrases(text: Column) -> Column:
    """Runs of words with a capital, of over three characters, in lower case."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1), lambda p: F.length(p) > 3), F.lower)


def hyphenated(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]+-[a-z]+)\b"), 1)


def compounds(text: Column) -> Column:
    """Runs of two to four words, one of them of over three letters and no stop word."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]+(?:\s+[a-z]+){1,3})\b"), 1)
    return F.filter(found, lambda p: F.exists(F.split(p, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOPS)))


def noun_phrases(text: Column) -> Column:
    return F.concat(capitalised_phrases(text), compounds(text), hyphenated(text))


def technical_terms(text: Column) -> Column:
    """Acronyms, hyphenated words, names of several words, and what is said to be called or defined, in lower case."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    told = F.concat(*(found("(?i)" + p) for p in (r"(?:called|known\s+as|referred\s+to\s+as|termed)\s+[\"']?([A-Za-z][A-Za-z\s]{2,30}?)[\"']?[.,]", r"([A-Za-z][A-Za-z\s]{2,30}?)\s+(?:is\s+defined\s+as|refers\s+to|means)")))
    plain = F.transform(F.concat(found(r"\b([A-Z]{2,6})\b"), found(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")), F.lower)
    return F.concat(plain, hyphenated(text), F.filter(F.transform(told, lambda t: F.lower(T.stripped(t))), lambda t: F.length(t) > 2))


def keywords(docs: DataFrame, key: str, text_col: str = "text", most: int = 20, least: int = 5) -> DataFrame:
    """(key, word, n, place): the commonest words of three letters or more but STOPS, ties to the earlier one; a text of
    under `least` such words, stop words counted, has none."""
    runs = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), 0)
    found = docs.select(key, F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$")).alias("w")).where(F.size("w") >= least)
    counts = found.select(key, F.posexplode("w").alias("p", "word")).where(~F.col("word").isin(*STOPS)).groupBy(key, "word").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("place") <= most).drop("first")
