"""Rewrites of bullets, headings and recognised text: one text in, one out. A null counts as an empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions import bullets as B
from plumbago.functions import text as T

# Fixed values from here to the functions: patterns, and what takes their place.

MISSING_VERBS = (
    (r"\bIt\s+visualized\b", "It is visualized"),
    (r"\bIt\s+implemented\b", "It is implemented"),
    (r"\bIt\s+used\b", "It is used"),
    (r"\bIt\s+defined\b", "It is defined"),
    (r"\bIt\s+stored\b", "It is stored"),
    (r"\bIt\s+represented\b", "It is represented"),
    (r"\bIt\s+classified\b", "It is classified"),
    (r"\bThey\s+used\b", "They are used"),
    (r"\bThey\s+defined\b", "They are defined"),
    (r"\bThey\s+stored\b", "They are stored"),
)
HEADINGS = {
    "key concepts": "Overview", "key points": "Key Points", "concept relationships": "How It Works", "components & structure": "Structure", "components and structure": "Structure",
    "process flow": "Process Flow", "process overview": "Process Overview", "definition": "Definition", "definition and fundamental concept": "Definition", "properties": "Properties",
    "applications": "Applications", "implementation and structure": "Implementation", "conceptual structure": "Conceptual Structure", "key notes and additional concepts": "Additional Notes",
    "contextual relationships": "How It Works", "top down": "Top-Down Approach", "structure": "Structure", "conceptual flow": "Concept Flow",
}
EDGE_SUFFIXES = (
    r"(?i)\s+during\s+its\s+operation\s*[-–—]\s*.{0,200}$",
    r"(?i)\s+during\s+its\s+operation\.?\s*$",
    r"(?i)\s*[-–—]\s*[Ii]ntroduced\s+in\s+a\s+previous\s+(?:session|chapter)[^.]*\.?",
    r"(?i)\s*[-–—]\s*[Pp]reviously\s+observed[^.]*\.?",
    r"(?i)\s*[-–—]\s*[A-Z][^.]{5,80}(?:used by|used in|introduced in)[^.]*\.\s*$",
    r"(?i)\s*[-–—]\s*[A-Z][a-z][^.]{5,80}that\s+(?:are|is)\s+(?:allowed|used|required)[^.]*\.\s*$",
)
HEADING_NOISE = r"[?→←↑↓~`\\|@«»#*\[\]{}<>]"
#: Stream operators and operands, quotes and dashes, symbols, control characters, question marks, runs of one sign.
OCR_SYMBOLS = (
    (r"\b(?:BT|ET|Td|TD|Tj|TJ|Tf|Tm|T\*)\b", " "),
    (r"\b\d+\.\d+\s+\d+\.\d+\s+Td\b", " "),
    (r"\b\d+\.\d+\s+[gGrRkKcs]\b", " "),
    (r"\s\*[a-z]\b", " "),
    ("[‘’‚‛]", "'"),
    ("[“”„‟]", '"'),
    ("[–—―]", "-"),
    ("[─-╿▀-▟■-◿☀-⛿←-⇿]", " "),
    ("[�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}­]", ""),
    (r"\s\?\s", " "),
    (r"^\?+\s*", ""),
    (r"\s*\?+$", ""),
    (r"([^a-zA-Z])\?", "$1"),
    (r"([A-Za-z])\?([A-Z])", "$1 $2"),
    (r"\?", ""),
    (r"([.\-_=*#@])\1{2,}", ""),
)
FRAMING = (
    r"(?i)\b(subscribe( to my channel)?|like and subscribe|hit the bell icon)\b",
    r"(?i)\b(thank you for watching|thanks for watching|thanks for joining)\b",
    r"(?i)\b(welcome to this( lecture| video| session)?)\b",
    r"(?i)\b(in this( lecture| video| session) we will( discuss)?)\b",
    r"(?i)\b(slide \d+|chapter \d+|unit \d+)\b",
    r"(?i)\b(important questions? for (sppu|exam)|exam oriented)\b",
    r"(?i)^(so basically|you know|kind of|now here|coming to|as I said|moving on(?: to)?)\s*[,.]?\s*",
    r"(?i)^(okay so|alright so|right so|well basically)\s*[,.]?\s*",
)


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, pair: F.regexp_replace(t, pair[0], pair[1]), pairs, F.coalesce(text, F.lit("")))


def with_missing_verbs(text: Column) -> Column:
    """'It used' and the like with their verb."""
    return _replaced(text, [("(?i)" + p, by) for p, by in MISSING_VERBS])


def heading_of_kind(heading: Column) -> Column:
    """A template's heading by its name in a lesson; others stay."""
    table = F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, T.stripped(F.lower(heading))), heading)


def without_edge_suffixes(text: Column) -> Column:
    """What edges leave at a bullet's end goes; an end mark is put where there is none."""
    t = T.collapse(_replaced(text, [(p, "") for p in EDGE_SUFFIXES]))
    return F.when((t == "") | t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def without_glued_tail(text: Column) -> Column:
    """A colon with a short lower-case tail, or at the end, is a full stop; full stops in a row are one."""
    return T.stripped(_replaced(text, [(r":\s*[a-z][\w\s]{0,25}\.\s*$", "."), (r":\s*$", "."), (r"\.{2,}", ".")]))


def primary_label(label: Column) -> Column:
    """Of 'A and B' A, unless B is a category word."""
    t = T.stripped(label)
    left, right = (T.stripped(F.regexp_extract(t, r"^(.{4,50})\s+[Aa]nd\s+(.{4,50})$", k)) for k in (1, 2))
    return F.when((left != "") & ~F.lower(right).isin(*B.CATEGORY_TAGS), left).otherwise(label)


def without_heading_noise(heading: Column) -> Column:
    """Signs of failed recognition as blanks, none at the ends, nor marks at the end."""
    return T.stripped(F.regexp_replace(T.collapse(F.regexp_replace(F.coalesce(heading, F.lit("")), HEADING_NOISE, " ")), r"[-–—:;.,]+$", ""))


def article_before_consonant(text: Column) -> Column:
    """'is an' before a consonant as 'is a'."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\bis\s+an\s+([BCDFGHJKLMNPQRSTVWXYZ])", "is a $1")


def without_truncated_start(text: Column) -> Column:
    """A first word of three to eight lower-case letters goes, and what follows begins with a capital."""
    t = F.coalesce(text, F.lit(""))
    rest = F.regexp_extract(t, r"(?s)^[a-z]{3,8}\s+(.+)$", 1)
    return F.when(rest == "", t).otherwise(T.capitalised(rest))


def without_self_example(text: Column) -> Column:
    """'A: B exemplified by A' as 'A: a type of B.'; null where no two words are left to say so."""
    t = F.regexp_replace(T.stripped(text), r"\.+$", "")
    label, said = (T.stripped(F.regexp_extract(t, r"(?s)^([^:]{1,40}):\s*(.{4,})", k)) for k in (1, 2))
    left = T.stripped(F.regexp_replace(said, r"(?i)\s*\b(?:exemplified by|as an example of|is an example of|such as)\s+.+$", ""))
    return F.when((label != "") & (F.size(B.words(left)) >= 2), F.concat(label, F.lit(": a type of "), left, F.lit(".")))


def without_ocr_symbols(text: Column) -> Column:
    return T.collapse(_replaced(text, OCR_SYMBOLS))


def ocr_line(line: Column) -> Column:
    """A recognised line without symbols; empty for up to five signs and digits, or under three characters."""
    t = T.stripped(line)
    noise = t.rlike(r"""^[\s\d.,;:!@#$%^&*()\[\]{}/\\|\-_=+~`'"]{1,5}$""") | (F.length(t) < 3)
    return F.when(noise, F.lit("")).otherwise(without_ocr_symbols(t))


def is_concept_dense(sentence: Column) -> Column:
    """Four words or more, and signs and blanks in 0.15 of the characters at most."""
    t = F.coalesce(sentence, F.lit(""))
    signs = F.length(F.regexp_replace(t, r"[^|/\\{}\[\]()<>*^%$#@!+= ]", ""))
    return (F.size(B.words(t)) >= 4) & (signs <= 0.15 * F.length(t))


def sanitised_sentence(sentence: Column) -> Column:
    """Without symbols and framing, contractions and number words written out."""
    t = T.number_words(T.expand_contractions(without_ocr_symbols(T.stripped(sentence))))
    return T.collapse(_replaced(t, [(p, "") for p in FRAMING]))
