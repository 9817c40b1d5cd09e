"""Set and vector similarities as column expressions; an empty side gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))).otherwise(0.0)


def overlap_max(a: Column, b: Column) -> Column:
    """Shared members over the larger set."""
    return _share(F.size(F.array_intersect(a, b)), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def overlap_min(a: Column, b: Column) -> Column:
    """Shared members over the smaller set."""
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def overlap_first(a: Column, b: Column) -> Column:
    """Shared members over the first set."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a shorter text is its own only member."""
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Words that headings, subsections, sections and sentences are compared without.
TOPIC_STOPS = ("the", "a", "an", "is", "are", "and", "or", "of", "in", "on", "at", "to", "for", "with", "that", "this", "which", "by", "from", "operations", "operation", "performed")
SUBSECTION_STOPS = ("of", "on", "the", "a", "an", "in", "for", "to", "by", "and", "or")
SECTION_STOPS = ("and", "the", "of", "in", "a", "an", "is", "for", "to", "with", "on", "at")
LABEL_STOPS = ("and", "or", "the", "a", "an", "of", "in", "for", "to", "is")
SENTENCE_STOPS = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "for", "and", "or", "that", "this")


def _long_words(text: Column, stops: tuple[str, ...]) -> Column:
    """Distinct words of three letters or more but the stops."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), 0)), F.array(*map(F.lit, stops)))


def _spaced_words(text: Column, stops: tuple[str, ...]) -> Column:
    """Distinct lower-case stretches between white space but the stops."""
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")), F.array(*map(F.lit, stops)))


def topic_jaccard(a: Column, b: Column) -> Column:
    """Of two headings, as topics."""
    return jaccard(_long_words(a, TOPIC_STOPS), _long_words(b, TOPIC_STOPS))


def subsection_overlap(a: Column, b: Column) -> Column:
    return overlap_max(_long_words(a, SUBSECTION_STOPS), _long_words(b, SUBSECTION_STOPS))


def section_overlap(a: Column, b: Column) -> Column:
    return overlap_min(_spaced_words(a, SECTION_STOPS), _spaced_words(b, SECTION_STOPS))


def label_jaccard(a: Column, b: Column) -> Column:
    return jaccard(_spaced_words(a, LABEL_STOPS), _spaced_words(b, LABEL_STOPS))


def are_like_sentences(a: Column, b: Column, threshold: float = 0.85) -> Column:
    return jaccard(_spaced_words(a, SENTENCE_STOPS), _spaced_words(b, SENTENCE_STOPS)) > threshold


def letter_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set, all but letters taken out of them."""
    return overlap_max(letter_words(a), letter_words(b))


def letter_words(text: Column) -> Column:
    """Distinct lower-case stretches between white space, all but letters taken out of them."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""), r"\s+"), lambda w: w != ""))
