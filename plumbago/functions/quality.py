"""Predicates and scores of lines and sentences: one Boolean or number each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions import text as T

#: Ends that leave a sentence open, parts that make one, and starts that need another before them.
DANGLING = (" by.", " of.", " in.", " on.", " to.", " for.", " with.", " as.")
VERB_PARTS = (
    " is ", " are ", " was ", " were ", " has ", " have ", " had ", " does ", " do ", " did ", " will ", " can ", " could ", " would ", " should ", " may ", " might ", " shall ", " must ",
    " means ", " refers ", " includes ", " contains ", " produces ", " generates ", " processes ", " converts ", " takes ", " reads ", " uses ", " performs ", " involves ", " requires ", " provides ",
    " creates ", " identifies ", " allocate", " optimize", " select", " called ", " known ",
)
CONNECTIVES = r"^(which|that|and|or|but|enabling|including|such)\b"
#: What defines something, and starts that point back.
DEFINING = (
    "is defined", "refers to", "is responsible", "is called", "is known", "is used", "is a", "means", "involves", "consists of", "includes", "processes", "converts", "generates", "produces", "performs", "allocates",
)
VAGUE = ("it ", "this ", "that ", "there ", "here ")
#: Lines of code, digits and slide frames that no summary needs; advertising, and talk around the matter.
CODE_LINES = (r"(?i)\b(DWORD|PTR|eax|ebx|ecx|edx|rbp|rsp|OFFSET|FLAT|mov|push|pop)\b", r"\b(int\s+main|printf|#include|return\s+\d|void\s+\w+\s*\()\b", r"\b[01]{6,}\b", r"(.)\1{3,}")
SLIDE_LINES = (r"(?i)\bOUTCOMES\b.*\bcompletion\b", r"(?i)\blearner\s+will\s+be\s+able\b", r"\|\s*\?_", r"\?_\s*$")
PROMOTION = (
    r"(refer|check|link|see|visit).*playlist", r"subscribe.*channel", r"link.*description", r"hit.*like", r"comment.*below", r"share.*video", r"follow.*instagram", r"join.*(group|channel)",
    r"whatsapp", r"telegram", r"contact.*number", r"helpline",
)
AROUND = (r"in this video", r"welcome back", r"thank you", r"hope you understood", r"let.*know", r"any doubts")
#: What optical recognition leaves where there was no text.
GARBAGE = r"[|@\[\]{}<>\\;!#$%^&*]{2,}|[oO0lI1]{5,}|(\w)\1{4,}"


def n_words(text: Column) -> Column:
    return F.size(T.tokens(text))


def is_clean(text: Column) -> Column:
    """Five characters or more, at least 0.55 of them letters, three words unless there is a colon, and no garbage that
    begins within the first forty characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 5) & (T.alpha_share(t) >= 0.55) & ((n_words(t) >= 3) | F.contains(t, F.lit(":"))) & ~t.rlike(rf"(?s)^.{{0,39}}?(?:{GARBAGE})")


def is_symbols_only(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) < 3) | ~t.rlike(r"[\p{L}\p{N}]")


def is_formula_like(text: Column) -> Column:
    """Digits, letters, arithmetic signs, full stops and blanks throughout, one at least."""
    return F.coalesce(T.stripped(text).rlike(r"^[0-9A-Za-z+\-=*/()^%.\s]+$"), F.lit(False))


def is_fragment(text: Column) -> Column:
    """Under four words, a lower-case start (but for i, e.g. and i.e.), a dangling end, or no verb in under eight words."""
    t = F.coalesce(text, F.lit(""))
    low, padded = F.lower(t), F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    verb = T.holds_any(padded, VERB_PARTS)
    lower = t.rlike(r"^\p{Ll}") & ~t.rlike(r"^(i |i'|e\.g|i\.e)")
    return (n_words(t) < 4) | lower | reduce(Column.__or__, (F.endswith(low, F.lit(e)) for e in DANGLING)) | (~verb & (n_words(t) < 8))


def starts_with_connective(text: Column) -> Column:
    return T.stripped(text).rlike("(?i)" + CONNECTIVES)


def is_loose_sentence(text: Column) -> Column:
    """Under twenty characters, or a connective or a lower-case letter first."""
    t = T.stripped(text)
    return (F.length(t) < 20) | starts_with_connective(t) | t.rlike(r"^\p{Ll}")


def is_self_loop(text: Column) -> Column:
    """'X is a type of X', 'X includes X', 'X contains X' or 'X encompasses X'."""
    return T.stripped(text).rlike(r"(?i)^(.+?)\s+(?:is\s+a\s+type\s+of|includes|contains|encompasses)\s+\1\s*\.?\s*$")


def has_open_bracket_tail(text: Column) -> Column:
    """More closing than opening brackets, and one of them at the end."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (count(")") > count("(")) & F.rtrim(text).rlike(r"\)\s*[.]?$")


def is_grounded(sentence: Column, labels: list[str], strict: bool = False) -> Column:
    """Holds a label; or a word of over three letters of one, or with strict over 0.3 of its own such words. Without a
    sentence or labels there is nothing to hold against it."""
    s, names = F.lower(sentence), sorted({x.lower().strip() for x in labels if x})
    if not names:
        return F.lit(True)
    known = F.array(*map(F.lit, names))
    parts = F.array(*map(F.lit, sorted({w for x in names for w in x.split() if len(w) > 3}))).cast("array<string>")
    own = F.array_distinct(T.tokens(s))
    content = F.size(F.filter(own, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$")))
    shared = F.size(F.array_intersect(own, parts))
    return F.coalesce(s == "", F.lit(True)) | F.exists(known, lambda x: F.contains(s, x)) | ((shared > 0.3 * content) & (content > 0) if strict else shared >= 1)


def is_filename(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^[\w\-./ ]+\.(png|jpe?g|gif|bmp|svg|pdf)$")


def binary_garbage_share(text: Column) -> Column:
    """Characters outside ASCII over all."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / n).otherwise(0.0)


def informative_score(sentence: Column) -> Column:
    """Length bands, a definition, capitalised terms inside, less a start that points back."""
    n, low = n_words(sentence), F.lower(sentence)
    length = F.when(n < 6, 0.3).when(n < 10, 0.6).when(n < 25, 1.0).when(n < 35, 0.8).otherwise(0.6)
    holds = lambda values, f: F.exists(F.array(*map(F.lit, values)), lambda v: f(low, v))
    terms = F.size(F.regexp_extract_all(F.substring(sentence, F.lit(2), F.length(sentence)), F.lit(r"(?<!\. )[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), 0))
    return length + F.when(holds(DEFINING, F.contains), 0.3).otherwise(0.0) + F.least(terms * 0.1, F.lit(0.3)) - F.when(holds(VAGUE, F.startswith), 0.15).otherwise(0.0)


def definition_confidence(sentence: Column, topic: Column) -> Column:
    """How surely a sentence defines a topic, from 0 for a question to 1."""
    s, t = F.lower(F.coalesce(sentence, F.lit(""))), F.lower(topic)
    holds = lambda *parts: T.holds_any(s, parts)
    starts = lambda *leads: F.exists(F.array(*(F.concat(F.lit(x), t) for x in leads)), lambda p: F.startswith(s, p))
    gain = lambda test, by: F.when(test, by).otherwise(0.0)
    score = (
        gain(holds(" is ", " are "), 0.35) + gain(holds("defined as", "refers to"), 0.3) + gain(holds("means", "represents"), 0.25) + gain(F.contains(s, t), 0.3)
        + gain(n_words(s).between(5, 50), 0.2) + gain(starts("", "a ", "the "), 0.2)
    )
    return F.when(T.stripped(s).rlike(r"\?$") | s.rlike(r"^(what|why|how|when|where|which) "), 0.0).otherwise(F.least(score, F.lit(1.0)))


def is_summary_line(line: Column) -> Column:
    """Three words or more, 0.55 letters, and no code, run of one sign or slide frame."""
    t = T.stripped(line)
    bad = [t.rlike(p) for p in (*CODE_LINES, *SLIDE_LINES)]
    return (T.alpha_share(t) >= 0.55) & (n_words(t) >= 3) & ~reduce(Column.__or__, bad)


def precleaned(text: Column) -> Column:
    """The lines of a text that a summary may use, as one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), T.stripped)
    return F.array_join(F.filter(lines, is_summary_line), " ")


def is_promotional(sentence: Column) -> Column:
    """Advertises, or talks around the matter in under fifteen words."""
    s = F.lower(F.coalesce(sentence, F.lit("")))
    any_of = lambda patterns: reduce(Column.__or__, (s.rlike(p) for p in patterns))
    return any_of(PROMOTION) | ((n_words(s) < 15) & any_of(AROUND))


def without_promotion(text: Column) -> Column:
    """A text's sentences that are not promotional, single-spaced."""
    return T.stripped(F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: ~is_promotional(s)), " "))
