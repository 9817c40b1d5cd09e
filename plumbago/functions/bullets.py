"""Predicates of bullets, headings and labels of notes: what a note should not hold, one Boolean column each.

A null counts as an empty text. Patterns are applied to the text without blanks at its ends.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions import similarity as S
from plumbago.functions.text import CATEGORY_TAGS, holds_any, stripped

# Fixed values from here to the functions: patterns and word lists, all without regard to case unless they say so.

META_NOISE = (
    r"^Afor\s+example\b",
    r"^[!\?]\s*=\s*[a-zA-Z]{3,}",
    r"(?:learned|mentioned|discussed|covered|introduced)\s+in\s+a\s+previous\s+(?:chapter|session|lecture)",
    r"procedures\s+for\s+its\s+removal\s+were",
    r"\bIT\s+Department\b|\bUnit\s+\d+\s*:",
    r"^(?:Down|Up|Top|Bottom)\s+\w[\w\s]{0,40}(?:generates|produces|uses|involves|allows)\s+",
    r"^Analysis\s+(?:generates|stores|followed\s+by)\s+",
    r"\brecognizes\s+Input\s+String\b",
    r"Anse\s*=>|Taken\s*\(\d+\)",
    r"usually\s+builds\s+a\s+data\s+structure\s+in\s+the\s+form\s+of\s+a\s+parse",
    r"\bcompiler\s+design\s+course\b",
    r"\b(?:this|the)\s+course\s+in\s+which\b",
)
TRIPLE_DUMP = (
    r"^.{3,80}\s+categorizes\s+.{3,80}$",
    r"^.{3,60}\s+encompasses\s+several\s+key\s+components",
    r"^(?:Down|Up|Top|Bottom)\s+\w[\w\s]{0,30}:\s+",
    r"introduced\s+in\s+a\s+previous\s+session",
    r"^previously\s+observed",
    r"^\w[\w\s]{2,40}\s+(?:categorizes|encompasses|observes|observed)\s+",
)
SEMANTIC_NOISE = (
    r"^Afor\s+example\b",
    r"^[!\?]\s*=\s*[a-zA-Z]{3,}",
    r"^Analysis\s+(?:generates|stores|followed\s+by)\s+\w",
    r"^(?:Down|Up|Top|Bottom)\s+\w[\w\s]{0,40}(?:generates|produces|uses|involves|allows)\s+",
    r"(?:learned|introduced|mentioned|discussed|covered)\s+in\s+a\s+previous\s+(?:chapter|session|lecture)",
    r"procedures\s+for\s+its\s+removal\s+were",
    r"\bcompiler\s+design\s+course\b",
    r"\bIT\s+Department\b|\bUnit\s+\d+\s*:\s*\w",
    r"System\s+Programming\s+Unit\s+\d+",
    r"\brecognizes\s+Input\s+String\b",
    r"usually\s+builds\s+a\s+data\s+structure\s+in\s+the\s+form\s+of\s+a\s+parse",
    r"Anse\s*=>|Taken\s*\(\d+\)",
    r"Forge!\s*eis\)",
    r"Procedures\s+learned\s+in\s+a\s+previous\b",
)
LECTURE_NOISE = (
    r"learned\s+in\s+a\s+previous\s+(?:chapter|session|lecture)",
    r"\b(?:compiler\s+design\s+course|this\s+course|the\s+course)\b",
    r"(?:mentioned|discussed|covered|introduced)\s+in\s+a\s+previous",
    r"procedures\s+for\s+its\s+removal\s+were",
    r"^[^a-zA-Z0-9('\"]{0,3}\s*[=!@#%^&*]{1,3}",
    r"^[!\?]\s*=\s*[a-z]{3,}",
    r"\bIT\s+Department\b|\bUnit\s+\d+\s*:\s*Parsers?\b",
    r"^Afor\s+example\b",
    r"Anse\s*=>\s*[\"']",
    r"Taken\s*\(\d+\)",
    r"usually\s+builds\s+a\s+data\s+structure\s+in\s+the\s+form\s+of\s+a\s+parse",
    r"^Down\s+\w[\w\s]{0,40}(?:generates|produces|uses|involves)\s+\w",
    r"^Afor\s+example,\s+Grammar\s+includes\b",
    r"^Analysis\s+(?:generates|followed\s+by|stores)\s+\w",
)
EXAM_NOISE = (
    r"\b(SPPU|GATE|GTU|VTU|NPTEL|Coursera|Udemy|YouTube)\b",
    r"\bexam\s+pattern\b",
    r"\bimportant\s+questions?\b",
    r"\btutorial\s+by\b",
    r"\bby\s+[A-Z][a-z]+\s+[0-9]",
    r"\bCS\s*&\s*IT\s+Tutorial",
)
CAPTION_BLEED = (
    r"(?i)\ba\s+(diagram|picture|photo|image|screenshot|pillow|sign|banner|blackboard)\s+(showing|of|with|that|depicting)",
    r"(?i)\b(enesoacademy|nesoacademy|Flv\s*\|)",
    r"\b[A-Z]{3,}\s+[A-Z]{2,}\s+[A-Z]{2,}\b.*\b[A-Z]{3,}\s+[A-Z]{2,}",
    r"(?i)\b(as\s+an?\s+\w+\s+\w+\s+ADT|J\s+Definition\s+of)",
    r"(?i)\ba\s+\w+\s+with\s+the\s+word\s+\w+\s+(written|on|in)\b",
)
NAVIGATION = (
    r"\b(discussed?\s+in\s+(?:the\s+)?(?:last|previous|prior|earlier)\s+(?:session|lecture|class|chapter|topic|video|unit)|"
    r"(?:will\s+be\s+)?discussed?\s+later|"
    r"covered?\s+in\s+(?:the\s+)?(?:next|upcoming|following|later|previous|last)\s+(?:session|lecture|class|chapter|topic|unit)|"
    r"(?:refer|see)\s+(?:the\s+)?(?:next|previous|last|upcoming)\s+(?:session|lecture|chapter)|"
    r"mentioned\s+in\s+(?:the\s+)?(?:last|previous|prior|earlier)\s+(?:session|lecture)|"
    r"we\s+(?:will|shall|have|had)\s+(?:discuss|cover|see|look\s+at)|"
    r"(?:already|previously)\s+(?:discussed|covered|seen|explained)|"
    r"to\s+be\s+(?:discussed|covered)\s+(?:later|next|soon)|"
    r"(?:recall|remember)\s+from\s+(?:last|previous|prior)\s+(?:session|lecture|class))",
)
PDF_OPERATORS = (
    r"\b(?:BT|ET|Td|TD|Tj|TJ|Tf|Tm|Tr|Tc|Tw|Tz|TL|T\*|cm|re|Do|BI|EI|EMC|BMC|BDC|[0-9]+\.[0-9]+\s+[0-9]+\.[0-9]+\s+Td|[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+\s+re)\b",
    r"\b\d+\.\d+\s+[gGrRkKcs]\b|\b\d+\s+\d+\s+\d+\s+[rRkK]\b",
)
TABLE_ROWS = r"\d{2,}.*\d{2,}.*\d{2,}"
TABLE_HEADER = r"(Employee\s+ID|Student\s+ID|Roll\s+No|Emp\s+Id|ID\s+Name|Name\s+ID|Sr\s+No|S\.?No\.?)"
TAKEAWAYS = r"\b(key\s+takeaway|takeaway|key\s+point|key\s+summary)\b"
COURSE_WORDS = r"\b(subject|course|unit|chapter|module|topic|lecture|syllabus|curriculum)\b"
COURSE_FRAMES = (r"^introduction\s+to\b", r"\b(overview|outline|agenda|objectives?|learning outcome)\b", r"^\d+[\.\\)]\s*\w{1,15}$")
HALF_SENTENCE = r"^(and |or |but |which |that |of |in |from |to )"
FRAGMENT_VERBS = r"\b(is|are|was|were|can|does|do|has|have|provides|uses|refers|means|represents|allows|enables|contains|consists|includes|defines|involves|requires|controls|manages|handles)\b"
RELATIVE_START = r"^(which|that|where|when|how|whether)\s+"
LABEL_ARTICLE = r"^(a|an|the|in|of|at|by|for|with|on|to|into|from|about|which|that|where|when|how|what|as|its|their)\s+"
LABEL_CLAUSE = r"\b(in which|where|that|which|are|is|was|were|can|may|will|shall)\b"
STUB_START = r"^(?:\d+\s+\w+|Each\s+\w+|Elements?\s+from|Particular\s+location)\b"
STUB_LEAD = r"^(each|every|some|any|the|a|an|of|in|at|on|to|for|by|from|into|with|without|between|through)\b"
VERB_ENDING = (
    r"(?:s|ed|ing|es|ize|izes|ized|en|ens|ened|fy|fies|fied|are|is|was|were|has|have|had|be|been|do|does|did|can|could|will|would|shall|should|may|might|must"
    r"|provide|provides|provided|store|stores|stored|allow|allows|allowed|use|uses|used|need|needs|needed|form|forms|formed|contain|contains|contained|represent|represents|define|defines|include|includes)$"
)
EXPLANATORY_VERBS = (
    "is", "are", "was", "were", "means", "refers", "defined", "represents", "allows", "enables", "provides", "performs", "stores", "converts", "checks", "manages", "handles", "generates", "produces", "detects",
    "implements", "uses", "supports", "ensures", "follows", "operates", "consists", "contains", "includes", "traverses", "processes", "returns", "removes", "inserts", "adds", "deletes", "retrieves", "calculates",
)
WHOLE_PLACEHOLDERS = (
    "components and structure", "components & structure", "key points", "applications", "database", "storage", "multiple", "components", "structure", "overview", "introduction", "summary", "conclusion",
    "misc", "general", "content", "other", "additional concepts", "visual representation", "figure", "diagram", "front end system", "necessary information",
)
PLACEHOLDER_HEADINGS = ("storage", "database", "multiple", "physical", "logical", "schema", "privileges", "components")
HEADING_STOPS = ("the", "a", "an", "of", "in", "on", "at", "by", "to", "for", "is", "are", "was", "and", "or", "with")
TEMPLATE_HEADING = r"^(components\s+(?:and|&)\s+structure|key\s+points|contextual\s+relationships?|concept\s+relationships?|applications?\s+and\s+examples?|properties?\s+and\s+usage)\s*[—\-–]\s*"
GENERIC_HEADINGS = (
    "definition and fundamental concept", "definition & fundamental concept", "key notes and additional concepts", "key notes & additional concepts", "contextual relationships", "components and structure",
    "components & structure", "key points", "applications", "overview", "introduction", "summary", "conclusion", "misc", "general", "content", "other", "additional concepts", "visual representation",
    "figure", "diagram", "header", "headers", "layer", "state", "error", "protocols",
)
GENERIC_TOKENS = (
    "definition", "fundamental", "concept", "key", "notes", "additional", "contextual", "relationships", "components", "structure", "overview",
    "header", "layer", "state", "error", "protocols", "services", "reference", "sequence", "physical", "logical",
)
MALFORMED_HEADINGS = ("inserted", "deleted", "removed", "added", "updated", "modified", "used", "applied", "performed", "executed", "called", "lexical", "phase", "target")
SINGLE_WORD_HEADINGS = ("overview", "definition", "properties", "applications", "operations", "components", "structure", "summary", "examples", "implementation", "types", "concepts", "relationships")
LOWER_LEADS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "as", "or", "and", "but", "if", "is", "it", "its", "be", "no", "not",
    "this", "that", "these", "those", "each", "every", "some", "any", "both", "all", "most", "more", "less", "few", "many", "also", "only",
)
OVERLAP_SUFFIXES = r"\b(function|operation|method|phase|process|procedure|step|component|module|type|kind|form|variant|mode|action|feature)\b"
CIRCULAR_AGENT = r"^(.+?)\s+(?:is handled by|is controlled by|is done by|is performed by|is managed by)\s+(.+?)\s*\.?\s*$"
CIRCULAR_GENERIC = ("phase", "stage", "process", "system", "module", "component", "handler", "controller", "generator", "analyzer", "manager")
SELF_EXAMPLE = r"^([^:]{1,40}):\s*.{3,120}?\b(?:exemplified by|as an example of|is an example of|such as an example of)\s+\1\b"
DIRECT_LOOP = r"^([A-Za-z][A-Za-z\s\-]{2,30})\s+is\s+(?:a|an|the)\s+\1\b"
TAUTOLOGIES = (
    r"^(\w[\w\s]{2,40})\s+is\s+(?:controlled|handled|managed|performed|done|executed|processed)\s+by\s+\1",
    r"^(\w[\w\s]{2,40})\s+(?:is|are)\s+\1(?:\s+\w+)?\.?\s*$",
)
TEMPLATE_LOOPS = (r"^([^:]{3,40}):\s+.+?\s+is\s+(?:a|an)\s+\1\s*$", r"^(.+?)\s+is\s+a\s+key\s+concept\s+within\s+\1")
CIRCULAR_STOPS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "this", "that", "with", "from", "into", "and", "or", "but", "for", "to", "of",
    "in", "on", "at", "by", "which", "what", "how", "when", "will", "can", "its", "their", "these", "those", "data", "level", "system",
)
OWNERSHIP = (
    "part of", "is part of", "sub-component", "sub component", "belongs to", "subset of", "member of", "has operation", "has function", "supports operation",
    "has device", "has component", "has mechanism", "has protocol", "has implementation", "has example", "has application",
)
DECORATIVE_WORDS = (
    "twitter", "facebook", "instagram", "youtube", "subscribe", "follow", "@", "nesoacademy", "neso", "academy", "like and share", "like, comment", "comment, share", "like comment share",
    "like comment subscribe", "thanks for watching", "thank you for watching", "logo", "icon", "watermark", "banner", "bell", "notification", "sticker with the word", "sticker with the words",
    "red and white sticker", "red and white shield", "shield with the letter", "a black and white photo", "a sign with", "a piece of paper with numbers", "visual representation",
)
IMPOSSIBLE_STARTS = (
    "bn bq bx bz cb cd cf cg cj ck cm cn cp cq cr cs cv cx cz db dc df dg dk dm dn dp dq dt dv dw dx dz fb fc fd ff fg fj fk fm fn fp fq fr fs ft fv fw fx fz "
    "gb gc gd gf gg gj gk gm gn gp gq gs gt gv gw gx gz hb hc hd hf hg hh hj hk hm hn hp hq hr hs ht hv hw hx hz jb jc jd jf jg jh jj jk jl jm jn jp jq jr js jt jv jw jx jy jz "
    "kb kc kd kf kg kh kj kk km kn kp kq kv kx kz lb lc ld lf lg lh lj lk lm ln lp lq lr ls lt lv lw lx lz mb mc md mf mg mh mj mk ml mm mn mp mq mr ms mt mv mw mx mz "
    "nb nc nd nf ng nh nj nk nl nm nn np nq nr ns nt nv nw nx nz"
).split()
DELEGATION = r"\b(?:is|are)\s+(?:controlled|handled|managed|performed|executed|done|implemented|run|processed|carried out)\s+by\b"
ROLE_SUFFIXES = r"\b(analyzer|analysis|generator|generation|optimizer|optimization|handler|manager|controller|checker|processor|compiler|parser|phase|stage|module|system|layer|component|unit)\b"
ROLE_STOPS = ("phase", "stage", "layer", "process", "system", "module", "analyzer", "analysis", "generator", "generation", "optimizer", "optimization", "handler", "manager", "controller", "checker")


# -- parts ----------------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def any_of(text: Column, patterns: Iterable[str], case: bool = False) -> Column:
    return reduce(Column.__or__, (text.rlike(("" if case else "(?i)") + p) for p in patterns))


def _among(word: Column, values: Iterable[str]) -> Column:
    return word.isin(*values)


def _is_lower(word: Column) -> Column:
    return (F.lower(word) == word) & (F.upper(word) != word)


def _long_words(text: Column, least: int = 2) -> Column:
    return F.size(F.filter(words(text), lambda w: F.length(w) >= least))


# -- bullets --------------------------------------------------------------------------------------------------------------


def is_meta_noise(text: Column) -> Column:
    """Fewer than five words of two characters or more, or talk about the lecture, or a leaked edge."""
    t = stripped(text)
    return (_long_words(t) < 5) | any_of(t, META_NOISE)


def is_semantic_noise(text: Column) -> Column:
    t = stripped(text)
    return (t == "") | any_of(t, SEMANTIC_NOISE)


def is_lecture_noise(text: Column) -> Column:
    """Fewer than four words of two characters or more, or course talk."""
    t = stripped(text)
    return (_long_words(t) < 4) | any_of(t, LECTURE_NOISE)


def is_triple_dump(text: Column) -> Column:
    return any_of(F.coalesce(text, F.lit("")), TRIPLE_DUMP)


def is_generic_description(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)abstract\s+data\s+type\s*\(adt\)")


def is_cut_off(text: Column) -> Column:
    """Empty, or a lower-case first word that is one letter, four or more, or not alone; or 'A is a ...' of eight words or fewer."""
    t = stripped(text)
    first, n = F.get(words(t), F.lit(0)), F.size(words(t))
    lower = _is_lower(first) & ((F.length(first) == 1) | (F.length(first) >= 4) | (n > 1))
    return (t == "") | F.coalesce(lower, F.lit(False)) | (t.rlike(r"(?i)^A\s+is\s+a\b") & (n <= 8))


def has_explanation(text: Column) -> Column:
    """Eight words or more, with an explaining verb between blanks or at the start."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = holds_any(F.concat(F.lit(" "), t, F.lit(" ")), [f" {v} " for v in EXPLANATORY_VERBS])
    return (F.size(words(stripped(t))) >= 8) & found


def is_label_only(text: Column) -> Column:
    """Four words or fewer without an explaining verb."""
    t = stripped(text)
    padded = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    return (F.size(words(t)) <= 4) & ~holds_any(padded, [f" {v} " for v in EXPLANATORY_VERBS])


def is_tautology(text: Column) -> Column:
    """The subject again as agent or predicate, half of its words as what does it, or six tenths of a copula's subject
    words in its predicate."""
    t = stripped(text)
    side = lambda k: stripped(F.regexp_replace(F.regexp_extract(t, rf"(?is)^(.*?){DELEGATION}(.*)$", k), "(?i)" + ROLE_SUFFIXES, ""))
    named = lambda part: F.array_except(F.filter(F.array_distinct(F.regexp_extract_all(F.lower(part), F.lit(r"\w+"), 0)), lambda w: F.length(w) > 2), F.array(*map(F.lit, (*CIRCULAR_STOPS, *ROLE_STOPS))))
    doer = F.regexp_replace(side(2), r"\s*\(.*?\)", "")
    delegated = (side(1) != "") & (doer != "") & (S.overlap_first(named(side(1)), named(doer)) >= 0.5)
    stops = F.array(*map(F.lit, CIRCULAR_STOPS))
    content = lambda part: F.array_except(F.array_distinct(words(F.lower(part))), stops)

    def copula(verb: str) -> Column:
        at = F.locate(f" {verb} ", F.lower(t))
        left, right = content(F.substring(t, F.lit(1), at - 1)), content(F.substring(t, at + len(verb) + 2, F.length(t)))
        return (at > 0) & (F.size(left) > 0) & (F.size(right) > 0) & (F.size(F.array_intersect(left, right)) / F.size(left) >= 0.6)

    return any_of(t, TAUTOLOGIES) | delegated | copula("is") | copula("are")


def is_circular_definition(text: Column) -> Column:
    """Done by an agent whose words stem from the subject's, an example of itself, or a direct loop."""
    t = F.regexp_replace(stripped(text), r"\.+$", "")
    side = lambda k: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract(t, "(?i)" + CIRCULAR_AGENT, k)), F.lit("[a-z]{4,}"), 0)), F.array(*map(F.lit, CIRCULAR_GENERIC)))
    akin = lambda s, a: (F.left(s, F.lit(5)) == F.left(a, F.lit(5))) | F.contains(a, s) | F.contains(s, a)
    agent = F.exists(side(1), lambda s: F.exists(side(2), lambda a: akin(s, a)))
    return agent | any_of(t, (SELF_EXAMPLE, DIRECT_LOOP))


def is_template_loop(text: Column) -> Column:
    """'Label: ... is a Label', or 'X is a key concept within X'."""
    return any_of(F.regexp_replace(stripped(text), r"\.+$", ""), TEMPLATE_LOOPS)


def has_pdf_artifacts(text: Column) -> Column:
    """Stream operators, or a quarter of more than ten characters that are no letters, digits or usual marks."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N} .,;:'\-/()]", ""))
    return any_of(t, PDF_OPERATORS, case=True) | ((F.length(t) > 10) & (odd > 0.25 * F.length(t)))


def has_encoding_garbage(text: Column) -> Column:
    """A fifth of characters outside printable ASCII; or tokens of letters and digits without vowels, one in up to twelve
    words or two in any text. A token of few vowels counts where letters and digits take turns three times."""
    t = F.coalesce(text, F.lit(""))
    noise = F.length(F.regexp_replace(t, r"[\x20-\x7E]", ""))
    mixed = F.filter(F.regexp_extract_all(t, F.lit(r"\b[a-zA-Z0-9]{4,}\b"), 0), lambda w: w.rlike("[0-9]") & w.rlike("[a-zA-Z]") & ~w.rlike(r"^[vV][0-9]+$"))
    vowels = lambda w: F.length(F.regexp_replace(w, "(?i)[^aeiou]", ""))
    turns = lambda w: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[0-9]+", "#"), "[a-zA-Z]+", "x"), r"^.", ""))
    bad = F.size(F.filter(mixed, lambda w: (vowels(w) == 0) | ((F.length(w) >= 5) & (vowels(w) < 0.15 * F.length(w)) & (turns(w) >= 3))))
    return (F.length(t) >= 5) & ((noise > 0.2 * F.length(t)) | ((bad >= 1) & (F.size(words(t)) <= 12)) | (bad >= 2))


def is_table_row(text: Column) -> Column:
    """Ten characters or more with two of: three long numbers, a third of eight words numbers, a table's header."""
    t = F.coalesce(text, F.lit(""))
    all_ = words(t)
    numbers = F.size(F.filter(all_, lambda w: w.rlike("^[0-9]+$")))
    signs = (t.rlike(TABLE_ROWS), (F.size(all_) >= 8) & (numbers > 0.35 * F.size(all_)), t.rlike("(?i)" + TABLE_HEADER))
    return (F.length(t) >= 10) & (sum((s.cast("int") for s in signs), F.lit(0)) >= 2)


def is_context_fragment(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    n = F.size(words(t))
    return (n < 3) | t.rlike("(?i)" + HALF_SENTENCE) | ((n <= 5) & ~t.rlike("(?i)" + FRAGMENT_VERBS))


def is_dangling(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike("^[a-z]") | any_of(t, (r"^(the|a|an)\s+", RELATIVE_START))


def is_navigation(text: Column) -> Column:
    return any_of(F.coalesce(text, F.lit("")), NAVIGATION)


def is_exam_noise(text: Column) -> Column:
    return any_of(F.coalesce(text, F.lit("")), EXAM_NOISE)


def is_caption_bleed(text: Column) -> Column:
    return any_of(F.coalesce(text, F.lit("")), CAPTION_BLEED, case=True)


def is_truncated_subject(text: Column) -> Column:
    """A short lower-case word before a capital that is no usual lead, or 'Of X'."""
    t = F.coalesce(text, F.lit(""))
    lead = F.regexp_extract(t, r"^([a-z]{2,10})\s+[A-Z]", 1)
    return ((lead != "") & ~_among(lead, LOWER_LEADS)) | t.rlike(r"^Of\s+[A-Z]")


def is_stub(text: Column) -> Column:
    """A start without a predicate, or under eight words that look like no verb after an article or preposition."""
    t = F.coalesce(text, F.lit(""))
    all_ = words(F.regexp_replace(t, r"[.!?]+$", ""))
    verbless = ~F.exists(all_, lambda w: w.rlike("(?i)" + VERB_ENDING))
    return t.rlike("(?i)" + STUB_START) | ((F.size(all_) < 8) & verbless & t.rlike("(?i)" + STUB_LEAD))


def is_misspelt(text: Column) -> Column:
    """Two tokens of three or more that begin with a digit and go on in letters, begin as no English word does, or hold
    one character four times."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0)
    odd = lambda w: w.rlike("^[0-9][a-z]+$") | _among(F.left(w, F.lit(2)), IMPOSSIBLE_STARTS) | w.rlike(r"(.)\1{3,}")
    return F.size(F.filter(tokens, odd)) >= 2


# -- headings and labels --------------------------------------------------------------------------------------------------


def is_fused_label(label: Column) -> Column:
    """'A and B' where B is a category word, or shares no content word with A."""
    t = stripped(label)
    left, right = (stripped(F.regexp_extract(t, r"^(.{4,50})\s+[Aa]nd\s+(.{4,50})$", k)) for k in (1, 2))
    stops = F.array(*map(F.lit, ("the", "a", "an", "of", "in", "and", "or", "for", "to", "with")))
    content = lambda part: F.array_except(F.array_distinct(words(F.lower(part))), stops)
    apart = F.size(F.array_intersect(content(left), content(right))) == 0
    return (F.length(left) >= 4) & (F.length(right) >= 4) & (_among(F.lower(right), CATEGORY_TAGS) | apart)


def is_placeholder_heading(heading: Column) -> Column:
    """A known placeholder, a template's heading, or one generic word besides stop words."""
    h = F.lower(stripped(heading))
    left = F.filter(words(h), lambda w: ~_among(w, HEADING_STOPS))
    return _among(h, WHOLE_PLACEHOLDERS) | stripped(heading).rlike("(?i)" + TEMPLATE_HEADING) | ((F.size(left) == 1) & F.coalesce(_among(F.get(left, F.lit(0)), PLACEHOLDER_HEADINGS), F.lit(False)))


def is_generic_heading(heading: Column) -> Column:
    """A heading that fits any section: a known one, one in brackets, or generic words throughout."""
    h = F.lower(stripped(heading))
    tokens = F.regexp_extract_all(h, F.lit("[a-z]+"), 0)
    long = F.filter(tokens, lambda w: F.length(w) > 2)
    return _among(h, GENERIC_HEADINGS) | F.startswith(h, F.lit("(")) | ((F.size(long) > 0) & F.forall(long, lambda w: _among(w, GENERIC_TOKENS)))


def is_malformed_heading(heading: Column) -> Column:
    """A mere verb, or one word that is no usual heading."""
    h = F.regexp_replace(F.lower(stripped(heading)), r"\.+$", "")
    return _among(h, MALFORMED_HEADINGS) | ((F.size(words(h)) == 1) & ~_among(h, SINGLE_WORD_HEADINGS))


def is_takeaways(heading: Column) -> Column:
    return F.coalesce(heading, F.lit("")).rlike("(?i)" + TAKEAWAYS)


def is_course_heading(heading: Column, n_points: Column) -> Column:
    """Names a course or unit, or frames one over three points or fewer."""
    h = stripped(heading)
    return h.rlike("(?i)" + COURSE_WORDS) | ((n_points <= 3) & any_of(h, COURSE_FRAMES))


def is_label_fragment(label: Column) -> Column:
    t = stripped(label)
    return any_of(t, (LABEL_ARTICLE, LABEL_CLAUSE)) | (F.size(words(t)) > 7)


def is_ownership(relation: Column) -> Column:
    """Says that the source holds the target; of relations neither known as holding nor as loose, those of two words or fewer."""
    r = stripped(F.replace(F.lower(F.coalesce(relation, F.lit(""))), F.lit("_"), F.lit(" ")))
    return F.when(holds_any(r, OWNERSHIP), True).when(holds_any(r, ASSOCIATIVE), False).otherwise(F.size(words(r)) <= 2)


#: Relations that tie without holding.
ASSOCIATIVE = (
    "related to", "is related to", "associated with", "connected to", "interacts with", "used in", "applied in", "depends on", "requires", "leads to", "causes", "results in", "co-occurs with", "similar to", "analogy",
)


def headings_overlap(a: Column, b: Column, least: float = 0.5) -> Column:
    """Shared words of three letters or more over the larger set, kinds of things left out."""
    return words_overlap(overlap_words(a), overlap_words(b), least)


def overlap_words(heading: Column) -> Column:
    """Distinct words of three letters or more, kinds of things left out."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(heading), OVERLAP_SUFFIXES, ""), F.lit("[a-z]{3,}"), 0))


def words_overlap(a: Column, b: Column, least: float = 0.5) -> Column:
    """headings_overlap of overlap_words."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (S.overlap_max(a, b) >= least)


def plain_heading(heading: Column) -> Column:
    """Lower case, a-z and 0-9 between single blanks."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def are_fragments(heading_a: Column, heading_b: Column, n_a: Column, n_b: Column) -> Column:
    """One heading begins the other, or they share six tenths of the larger's words and one holds three points or fewer."""
    a, b = plain_heading(heading_a), plain_heading(heading_b)
    return are_plain_fragments(a, b, plain_words(a), plain_words(b), n_a, n_b)


def plain_words(plain: Column) -> Column:
    """Distinct words of a plain heading."""
    return F.array_distinct(words(plain))


def are_plain_fragments(a: Column, b: Column, words_a: Column, words_b: Column, n_a: Column, n_b: Column) -> Column:
    """are_fragments of plain headings and their words."""
    near = S.overlap_max(words_a, words_b) >= 0.6
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a) | (near & (F.least(n_a, n_b) <= 3)))


# -- images ---------------------------------------------------------------------------------------------------------------


def is_opening_slide(path: Column) -> Column:
    """slide_000 to slide_004, by the file's name."""
    number = F.regexp_extract(F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)), r"^slide[_\-]?(\d+)", 1)
    return F.coalesce(F.expr("true") & (F.when(number != "", number.cast("decimal(38,0)")) <= 4), F.lit(False))


def is_decorative(path: Column, caption: Column) -> Column:
    """An opening slide, or a path or caption with a word of channels and calls to subscribe."""
    both = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(caption, F.lit(""))))
    return holds_any(both, DECORATIVE_WORDS) | is_opening_slide(path)


def box_centre(box: Column) -> Column:
    """The height at which struct(x, y, w, h) has its middle, halves rounded down."""
    return box["y"] + F.floor(box["h"] / 2)


def is_same_box(known: Column, new: Column) -> Column:
    """Not over twice as high, and its middle within the known height of the known middle."""
    return (new["h"] <= 2 * known["h"]) & (F.abs(box_centre(new) - box_centre(known)) <= known["h"])


def joined_box(a: Column, b: Column) -> Column:
    """The least box that holds both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, low = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))
