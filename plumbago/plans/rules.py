"""Registered queries of the rules for bullets, headings and recognised text, and their SQL.

Their input is every line of documents; the steps of notes run over documents as sections. The tests run them over a
small table of phrases too, in which every rule meets texts that break it and texts that don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import bullets as B
from plumbago.functions import quality as Q
from plumbago.functions import repairs as R
from plumbago.functions import text as T
from plumbago.operators import notes, phrases
from plumbago.plans.registry import _GARBAGE, _t, query

#: {x}: a nation's name; {n}: the same in lower case.
#: Characters of the lines that both engines' classes of letters, words and their borders treat alike; others become x.
_LIKE_ASCII = r"[^\x20-\x7E“”–—→’]"
#: What a line has that isn't blank as a plain text: asked of the line, so that the text is made once and not for a filter too.
_SHOWN = r"[^ \t\r\n\x0b\f\p{Mn}]"


#: What a text that isn't plain yet has: asked first, as most are, so that the others alone are made plain.
_ODD = r"[^\x20-\x7E]|  |^ | $"


def _plain_text(text):
    """A text as the rules see it: no accents, white space as single blanks."""
    return F.when(~text.rlike(_ODD), text).otherwise(_made_plain(text))


def _made_plain(text):
    return F.trim(F.regexp_replace(F.regexp_replace(T.without_accents(F.regexp_replace(text, r"[ \t\r\n\x0b\f]+", " ")), _LIKE_ASCII, "x"), " +", " "))


def _bullets(spark, sf) -> DataFrame:
    """(bullet_id, t): every line of every document that isn't blank, a million numbers for a document."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line")
    rows = _t(spark, sf, "documents").select("doc_id", lines)
    return rows.where(F.col("line").rlike(_SHOWN)).select((F.col("doc_id").cast("long") * 1_000_000 + F.col("k")).alias("bullet_id"), _plain_text(F.col("line")).alias("t"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain_sql(text: str) -> str:
    bare = f"regexp_replace(translate(regexp_replace({text}, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'), '{T.ACCENTED}', '{T.BARE}'), '\\p{{Mn}}+', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, {_q(_LIKE_ASCII)}, 'x', 'g'), ' +', ' ', 'g'))"


_B = f"""line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT * FROM (SELECT doc_id::BIGINT * 1000000 + k AS bullet_id, {_plain_sql("line")} AS t FROM line) WHERE t <> ''),
w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w, lower(t) AS l, rtrim(t, '.') AS u FROM b)"""


def _m(*patterns: str, of: str = "t", case: bool = False) -> str:
    """Whether any pattern is found."""
    return "(" + " OR ".join(f"regexp_matches({of}, {_q(p)}{'' if case else ', ' + _q('i')})" for p in patterns) + ")"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _holds(values, of: str) -> str:
    """Whether any value is a part."""
    return f"(len(list_filter({_list(values)}, lambda v: contains({of}, v))) > 0)"


def _same(pattern: str, test: str, of: str = "u") -> str:
    """A test of the two groups of a pattern, in lower case and without blanks at the ends."""
    g = lambda k: f"trim(lower(regexp_extract({of}, {_q(pattern)}, {k}, 'i')))"
    return f"({g(1)} <> '' AND {test.format(a=g(1), b=g(2))})"


_LONG = "len(list_filter(w, lambda x: length(x) >= 2))"
_LOW = "(w[1] = lower(w[1]) AND w[1] <> upper(w[1]))"
_VERBS = f"(len(list_filter({_list(B.EXPLANATORY_VERBS)}, lambda v: contains(' ' || l || ' ', ' ' || v || ' '))) > 0)"
_VOWELS = "length(regexp_replace(x, '[^aeiouAEIOU]', '', 'g'))"
_TURNS = "length(regexp_replace(regexp_replace(x, '[0-9]+', '#', 'g'), '[a-zA-Z]+', 'x', 'g')) - 1"
_MIXED = rf"len(list_filter(regexp_extract_all(t, '\b[a-zA-Z0-9]{{4,}}\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-zA-Z]') AND NOT regexp_matches(x, '^[vV][0-9]+$') AND ({_VOWELS} = 0 OR (length(x) >= 5 AND {_VOWELS} < 0.15 * length(x) AND {_TURNS} >= 3))))"


def _content(of: str, stops) -> str:
    return f"list_filter(list_distinct(string_split_regex(trim({of}), '\\s+')), lambda x: x <> '' AND NOT list_contains({_list(stops)}, x))"


def _copula(verb: str) -> str:
    left, right = (_content(f"substr(l, {a})" if k else f"substr(l, 1, strpos(l, ' {verb} ') - 1)", B.CIRCULAR_STOPS) for k, a in ((0, ""), (1, f"strpos(l, ' {verb} ') + {len(verb) + 2}")))
    return f"(strpos(l, ' {verb} ') > 0 AND len({left}) > 0 AND len({right}) > 0 AND len(list_intersect({left}, {right})) >= 0.6 * len({left}))"


_META = f"({_LONG} < 5 OR {_m(*B.META_NOISE)})"


@query(rf"""WITH {_B} SELECT bullet_id, {_META} AS meta_noise, {_m(*B.SEMANTIC_NOISE)} AS semantic_noise, {_LONG} < 4 OR {_m(*B.LECTURE_NOISE)} AS lecture_noise, {_m(*B.TRIPLE_DUMP)} AS triple_dump,
contains(l, 'abstract data type (adt)') AS generic_description, coalesce({_LOW} AND (length(w[1]) = 1 OR length(w[1]) >= 4 OR len(w) > 1), false) OR (starts_with(l, 'a is a ') AND len(w) <= 8) AS cut_off,
len(w) >= 8 AND ({_VERBS} OR len(list_filter({_list(B.EXPLANATORY_VERBS)}, lambda v: starts_with(l, v || ' '))) > 0) AS explanation, len(w) <= 4 AND NOT {_VERBS} AS label_only,
{_m(*B.NAVIGATION)} AS navigation, {_m(*B.EXAM_NOISE)} AS exam_noise, {" OR ".join(_m(p.replace("(?i)", ""), case="(?i)" not in p) for p in B.CAPTION_BLEED)} AS caption_bleed,
len(w) < 3 OR {_m(B.HALF_SENTENCE)} OR (len(w) <= 5 AND NOT {_m(B.FRAGMENT_VERBS)}) AS context_fragment, regexp_matches(t, '^[a-z]') OR regexp_matches(l, '^(the|a|an|which|that|where|when|how|whether)\s') AS dangling FROM w""")
def bullet_noise(spark, sf):
    t = F.col("t")
    rules = {
        "meta_noise": B.is_meta_noise, "semantic_noise": B.is_semantic_noise, "lecture_noise": B.is_lecture_noise, "triple_dump": B.is_triple_dump, "generic_description": B.is_generic_description, "cut_off": B.is_cut_off,
        "explanation": B.has_explanation, "label_only": B.is_label_only, "navigation": B.is_navigation, "exam_noise": B.is_exam_noise, "caption_bleed": B.is_caption_bleed, "context_fragment": B.is_context_fragment, "dangling": B.is_dangling,
    }
    return _bullets(spark, sf).select("bullet_id", *(f(t).alias(name) for name, f in rules.items()))


_CLEAN = rf"""(length(t) >= 5 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 0.55 * length(t) AND (len(w) >= 3 OR contains(t, ':')) AND NOT regexp_matches(t, '^.{{0,39}}?(?:{_GARBAGE})'))"""


@query(rf"""WITH {_B} SELECT bullet_id, {_m(*B.PDF_OPERATORS, case=True)} OR (length(t) > 10 AND length(regexp_replace(t, '[\p{{L}}\p{{N}} .,;:''\-/()]', '', 'g')) > 0.25 * length(t)) AS pdf_artifacts,
length(t) >= 5 AND (length(regexp_replace(t, '[\x20-\x7E]', '', 'g')) > 0.2 * length(t) OR ({_MIXED} >= 1 AND len(w) <= 12) OR {_MIXED} >= 2) AS encoding_garbage,
length(t) >= 10 AND CAST({_m(B.TABLE_ROWS)} AS INT) + CAST(len(w) >= 8 AND len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0.35 * len(w) AS INT) + CAST({_m(B.TABLE_HEADER)} AS INT) >= 2 AS table_row,
(regexp_matches(t, '^[a-z]{{2,10}}\s+[A-Z]') AND NOT list_contains({_list(B.LOWER_LEADS)}, w[1])) OR regexp_matches(t, '^Of\s+[A-Z]') AS truncated_subject,
{_m(B.STUB_START)} OR (len(w) < 8 AND {_m(B.STUB_LEAD)} AND len(list_filter(string_split_regex(regexp_replace(t, '[.!?]+$', ''), '\s+'), lambda x: regexp_matches(x, {_q(B.VERB_ENDING)}, 'i'))) = 0) AS stub,
len(list_filter(regexp_extract_all(l, '[a-z0-9]{{3,}}'), lambda x: regexp_matches(x, '^[0-9][a-z]+$') OR list_contains({_list(B.IMPOSSIBLE_STARTS)}, x[:2]) OR regexp_matches(x, '{"|".join(c + "{4,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")}'))) >= 2 AS misspelt,
{_m(r"^[0-9A-Za-z+\-=*/()^%.\s]+$", of="trim(t)")} AS formula_like,
len(w) < 4 OR (regexp_matches(t, '^[a-z]') AND NOT regexp_matches(t, '^(i |i''|e\.g|i\.e)')) OR regexp_matches(l, ' (by|of|in|on|to|for|with|as)\.$') OR (len(w) < 8 AND NOT {_holds(Q.VERB_PARTS, "(' ' || l || ' ')")}) AS fragment,
length(t) < 20 OR regexp_matches(l, '^(which|that|and|or|but|enabling|including|such)\b') OR regexp_matches(t, '^[a-z]') AS loose_sentence,
{_CLEAN} AS clean FROM w""")
def bullet_damage(spark, sf):
    t = F.col("t")
    rules = {
        "pdf_artifacts": B.has_pdf_artifacts, "encoding_garbage": B.has_encoding_garbage, "table_row": B.is_table_row, "truncated_subject": B.is_truncated_subject, "stub": B.is_stub, "misspelt": B.is_misspelt,
        "formula_like": Q.is_formula_like, "fragment": Q.is_fragment, "loose_sentence": Q.is_loose_sentence, "clean": Q.is_clean,
    }
    return _bullets(spark, sf).select("bullet_id", *(f(t).alias(name) for name, f in rules.items()))


_AGENT = rf"""len(list_filter(list_filter(list_distinct(regexp_extract_all(lower(regexp_extract(u, {_q(B.CIRCULAR_AGENT)}, 1, 'i')), '[a-z]{{4,}}')), lambda s: NOT list_contains({_list(B.CIRCULAR_GENERIC)}, s)),
 lambda s: len(list_filter(list_distinct(regexp_extract_all(lower(regexp_extract(u, {_q(B.CIRCULAR_AGENT)}, 2, 'i')), '[a-z]{{4,}}')), lambda a: NOT list_contains({_list(B.CIRCULAR_GENERIC)}, a) AND (s[:5] = a[:5] OR contains(a, s) OR contains(s, a)))) > 0)) > 0"""
_DELEGATED = (
    "(len({0}) > 0 AND trim(regexp_replace({1}, {2}, '', 'gi')) <> '' AND len(list_intersect({0}, {3})) >= 0.5 * len({0}))"
).format(
    *(lambda left, right, role: (
        f"list_filter(list_distinct(regexp_extract_all(regexp_replace({left}, {role}, '', 'gi'), '\\w+')), lambda x: length(x) > 2 AND NOT list_contains({_list((*B.CIRCULAR_STOPS, *B.ROLE_STOPS))}, x))",
        right, role,
        f"list_distinct(regexp_extract_all(regexp_replace({right}, {role}, '', 'gi'), '\\w+'))",
    ))(f"regexp_extract(l, {_q(f'^(.*?){B.DELEGATION}(.*)$')}, 1)", f"regexp_extract(l, {_q(f'^(.*?){B.DELEGATION}(.*)$')}, 2)", _q(B.ROLE_SUFFIXES))
)


_TAUTOLOGY = rf"""({_same(r"^(\w[\w\s]{2,40})\s+is\s+(?:controlled|handled|managed|performed|done|executed|processed)\s+by\s+(.*)$", "starts_with({b}, {a})", "t")}
 OR {_same(r"^(\w[\w\s]{2,40}?)\s+(?:is|are)\s+(.*?)\.?\s*$", "({b} = {a} OR (starts_with({b}, {a} || ' ') AND NOT contains(substr({b}, length({a}) + 2), ' ')))", "t")} OR {_DELEGATED} OR {_copula("is")} OR {_copula("are")})"""
_CIRCULAR = rf"""({_AGENT} OR {_same(r"^([^:]{1,40}):\s*.{3,120}?\b(?:exemplified by|as an example of|is an example of|such as an example of)\s+(.*)$", "starts_with({b}, {a})")} OR {_same(r"^([A-Za-z][A-Za-z\s\-]{2,30}?)\s+is\s+(?:a|an|the)\s+(.*)$", "starts_with({b} || ' ', {a} || ' ')")})"""


@query(rf"""WITH {_B} SELECT bullet_id, {_TAUTOLOGY} AS tautology,
{_CIRCULAR} AS circular,
{_same(r"^([^:]{3,40}):\s+.+?\s+is\s+(?:a|an)\s+(.*)$", "{a} = {b}")} OR {_same(r"^(.+?)\s+is\s+a\s+key\s+concept\s+within\s+(.*)$", "starts_with({b}, {a})")} AS template_loop,
{_same(r"^(.+?)\s+(?:is\s+a\s+type\s+of|includes|contains|encompasses)\s+(.+?)\s*\.?\s*$", "{a} = {b}", "t")} AS self_loop FROM w""")
def bullet_loops(spark, sf):
    t = F.col("t")
    return _bullets(spark, sf).select("bullet_id", B.is_tautology(t).alias("tautology"), B.is_circular_definition(t).alias("circular"), B.is_template_loop(t).alias("template_loop"), Q.is_self_loop(t).alias("self_loop"))


_FUSED = r"regexp_extract(t, '^(.{{4,50}})\s+[Aa]nd\s+(.{{4,50}})$', {})"


@query(rf"""WITH {_B}, f AS (SELECT *, trim({_FUSED.format(1)}) AS a, trim({_FUSED.format(2)}) AS z, list_filter(string_split_regex(l, '\s+'), lambda x: x <> '' AND NOT list_contains({_list(B.HEADING_STOPS)}, x)) AS c,
list_filter(regexp_extract_all(l, '[a-z]+'), lambda x: length(x) > 2) AS g FROM w)
SELECT bullet_id, length(a) >= 4 AND length(z) >= 4 AND (list_contains({_list(T.CATEGORY_TAGS)}, lower(z)) OR len(list_intersect({_content("lower(a)", "the a an of in and or for to with".split())}, {_content("lower(z)", "the a an of in and or for to with".split())})) = 0) AS fused,
l IN ('components and structure', 'components & structure', 'key points', 'applications', 'database', 'storage', 'multiple', 'components', 'structure', 'overview', 'introduction', 'summary', 'conclusion', 'misc', 'general', 'content', 'other', 'additional concepts', 'visual representation', 'figure', 'diagram', 'front end system', 'necessary information') OR {_m(B.TEMPLATE_HEADING)} OR (len(c) = 1 AND coalesce(list_contains({_list(B.PLACEHOLDER_HEADINGS)}, c[1]), false)) AS placeholder,
list_contains({_list(B.GENERIC_HEADINGS)}, l) OR starts_with(l, '(') OR (len(g) > 0 AND len(list_filter(g, lambda x: NOT list_contains({_list(B.GENERIC_TOKENS)}, x))) = 0) AS generic,
list_contains({_list(B.MALFORMED_HEADINGS)}, rtrim(l, '.')) OR (len(w) = 1 AND NOT list_contains({_list(B.SINGLE_WORD_HEADINGS)}, rtrim(l, '.'))) AS malformed,
{_m(B.TAKEAWAYS)} AS takeaways, {_m(B.COURSE_WORDS)} OR (bullet_id % 7 <= 3 AND {_m(*B.COURSE_FRAMES)}) AS course, {_m(B.LABEL_ARTICLE)} OR {_m(B.LABEL_CLAUSE)} OR len(w) > 7 AS label_fragment,
CASE WHEN {_holds(B.OWNERSHIP, "replace(l, '_', ' ')")} THEN true WHEN {_holds(B.ASSOCIATIVE, "replace(l, '_', ' ')")} THEN false ELSE len(string_split_regex(replace(t, '_', ' '), '\s+')) <= 2 END AS ownership, {_holds(B.DECORATIVE_WORDS, "('slide_00' || bullet_id % 9 || '.png ' || l)")} OR bullet_id % 9 <= 4 AS decorative FROM f""")
def heading_rules(spark, sf):
    t, n = F.col("t"), F.col("bullet_id") % 7
    path = F.concat(F.lit("out/slide_00"), (F.col("bullet_id") % 9).cast("string"), F.lit(".png"))
    rules = {"fused": B.is_fused_label, "placeholder": B.is_placeholder_heading, "generic": B.is_generic_heading, "malformed": B.is_malformed_heading, "takeaways": B.is_takeaways, "label_fragment": B.is_label_fragment, "ownership": B.is_ownership}
    return _bullets(spark, sf).select("bullet_id", *(f(t).alias(name) for name, f in rules.items()), B.is_course_heading(t, n).alias("course"), B.is_decorative(path, t).alias("decorative"))


def _chain(of: str, pairs) -> str:
    for pattern, by in pairs:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        of = f"regexp_replace({of}, {_q(pattern.removeprefix('(?i)'))}, {_q(by.replace('$', chr(92)))}, '{flags}')"
    return of


_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SUFFIXED = _COLLAPSED.format(_chain("t", [(p, "") for p in R.EDGE_SUFFIXES]))
_CASES = "CASE l " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.HEADINGS.items()) + " ELSE t END"
#: RE2 knows no references to groups (they are written out as _RUNS) and reads the controls' class by its code points.
_SYMBOLS = [(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}]", p[1]) if "\\x00" in p[0] else p for p in R.OCR_SYMBOLS if r"\1" not in p[0]]
_RUNS = [(c + "{3,}", "") for c in (r"\.", "-", "_", "=", r"\*", "#", "@")]
_PLAIN = _COLLAPSED.format(_chain("t", _SYMBOLS + _RUNS))


@query(rf"""WITH {_B} SELECT bullet_id, {_chain("t", [("(?i)" + p, by) for p, by in R.MISSING_VERBS])} AS verbs, {_CASES} AS kind, CASE WHEN {_SUFFIXED} = '' OR regexp_matches({_SUFFIXED}, '[.!?]$') THEN {_SUFFIXED} ELSE {_SUFFIXED} || '.' END AS suffixes,
trim({_chain("t", [(r":\s*[a-z][\w\s]{0,25}\.\s*$", "."), (r":\s*$", "."), (r"\.{2,}", ".")])}) AS tail, CASE WHEN {_FUSED.format(1)} <> '' AND NOT list_contains({_list(T.CATEGORY_TAGS)}, lower(trim({_FUSED.format(2)}))) THEN trim({_FUSED.format(1)}) ELSE t END AS primary_label,
trim(regexp_replace({_COLLAPSED.format(f"regexp_replace(t, {_q(R.HEADING_NOISE)}, ' ', 'g')")}, '[-–—:;.,]+$', '')) AS heading, regexp_replace(t, '\bis\s+an\s+([BCDFGHJKLMNPQRSTVWXYZ])', 'is a \1', 'gi') AS article,
CASE WHEN regexp_matches(t, '^[a-z]{{3,8}}\s+.') THEN upper(regexp_extract(t, '^[a-z]{{3,8}}\s+(.)', 1)) || regexp_extract(t, '^[a-z]{{3,8}}\s+.(.*)$', 1) ELSE t END AS start,
{_PLAIN} AS symbols, len(w) >= 4 AND length(regexp_replace(t, '[^|/\\{{}}\[\]()<>*^%$#@!+= ]', '', 'g')) <= 0.15 * length(t) AS dense FROM w""")
def repaired_bullets(spark, sf):
    t = F.col("t")
    rules = {
        "verbs": R.with_missing_verbs, "kind": R.heading_of_kind, "suffixes": R.without_edge_suffixes, "tail": R.without_glued_tail, "primary_label": R.primary_label, "heading": R.without_heading_noise,
        "article": R.article_before_consonant, "start": R.without_truncated_start, "symbols": R.without_ocr_symbols, "dense": R.is_concept_dense,
    }
    return _bullets(spark, sf).select("bullet_id", *(f(t).alias(name) for name, f in rules.items()))


_CONTRACTED = "array_to_string(list_transform(w, lambda x: CASE regexp_replace(lower(x), '[.,!?;:]+$', '') " + " ".join(f"WHEN {_q(k)} THEN {_q(v)} || regexp_extract(x, '[.,!?;:]+$')" for k, v in T.CONTRACTIONS.items()) + " ELSE x END), ' ')"


@query(rf"""WITH {_B}, q AS (SELECT *, trim(regexp_replace(regexp_replace(t, '(\w)\?s\b', '\1''s', 'g'), '(\w)\?t\b', '\1''t', 'g')) AS q FROM w),
h AS (SELECT *, trim(regexp_extract(q, '^(.+?)\s+\?\s+(.+)$', 1)) AS a, trim(regexp_extract(q, '^(.+?)\s+\?\s+(.+)$', 2)) AS z FROM q),
j AS (SELECT *, CASE WHEN a = '' THEN q WHEN list_contains({_list(T.CATEGORY_TAGS)}, lower(regexp_extract(z, '(\S+)$', 1))) THEN a ELSE a || ' ' || z END AS j FROM h)
SELECT bullet_id, {_CONTRACTED} AS contractions, CASE WHEN contains(t, '?') THEN trim(regexp_replace(replace(regexp_replace(j, '\s\?\s|\s\?$|^\?\s', ' ', 'g'), '?', ''), '\s+', ' ', 'g')) ELSE t END AS heading,
round(CASE WHEN len(w) < 6 THEN 0.3::DOUBLE WHEN len(w) < 10 THEN 0.6 WHEN len(w) < 25 THEN 1.0 WHEN len(w) < 35 THEN 0.8 ELSE 0.6 END + CASE WHEN {_holds(Q.DEFINING, "l")} THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(l, '^(it|this|that|there|here) ') THEN 0.15 ELSE 0 END
 + least(0.3::DOUBLE, 0.1 * len(regexp_extract_all(regexp_replace(substr(t, 2), '\. [A-Z]', '. #', 'g'), '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*'))), 6) AS score FROM j""")
def rewritten_bullets(spark, sf):
    t = F.col("t")
    return _bullets(spark, sf).select("bullet_id", T.expand_contractions(t).alias("contractions"), T.heading_question_marks(t).alias("heading"), F.round(Q.informative_score(t), 6).alias("score"))


# -- steps of notes -------------------------------------------------------------------------------------------------------

HEADING_CHARS = 60


def _points_of_rules(spark, sf) -> DataFrame:
    """Notes of ten documents each: a document is a section under its first line, ten of its lines a subsection under
    the first of them, cut to HEADING_CHARS; the other lines are points."""
    rows = _bullets(spark, sf).select(F.expr("bullet_id div 1000000").alias("key"), (F.col("bullet_id") % 1_000_000).cast("int").alias("k"), F.col("t").alias("text")).withColumn("sub", F.expr("cast(k div 10 as int)"))
    section, block = W.partitionBy("key").orderBy("k"), W.partitionBy("key", "sub").orderBy("k")
    rows = rows.select("*", F.substring(F.first("text").over(section), 1, HEADING_CHARS).alias("sec_heading"), F.substring(F.first("text").over(block), 1, HEADING_CHARS).alias("sub_heading"), F.row_number().over(block).alias("turn"))
    return rows.where("turn > 1").select(F.expr("key div 10").alias("notes_id"), F.lit("Notes").alias("title"), F.col("key").cast("int").alias("sec_pos"), "sec_heading", F.col("sub").alias("sub_pos"), "sub_heading", (F.col("k") % 10).alias("pt_pos"), "text")


_P = f"""{_B}, lined AS (SELECT *, bullet_id // 1000000 AS key, bullet_id % 1000000 AS k FROM w),
p AS MATERIALIZED (SELECT key // 10 AS notes_id, key AS sec_pos, substr(first_value(t) OVER (PARTITION BY key ORDER BY k), 1, {HEADING_CHARS}) AS sec_heading, k // 10 AS sub_pos, substr(first_value(t) OVER s, 1, {HEADING_CHARS}) AS sub_heading, k % 10 AS pt_pos, t AS text, t, w, l, u
 FROM lined WINDOW s AS (PARTITION BY key, k // 10 ORDER BY k) QUALIFY row_number() OVER s > 1)"""
_EXAMPLE = rf"trim(regexp_replace(regexp_extract(u, '^[^:]{{1,40}}:\s*(.{{4,}})', 1), '\s*\b(?:exemplified by|as an example of|is an example of|such as)\s+.+$', '', 'gi'))"
_REWRITTEN = rf"CASE WHEN NOT {_CIRCULAR} THEN t WHEN contains(u, ':') AND len(string_split_regex({_EXAMPLE}, '\s+')) >= 2 THEN trim(regexp_extract(u, '^([^:]{{1,40}}):', 1)) || ': a type of ' || {_EXAMPLE} || '.' END"
_ENDED = f"CASE WHEN {_SUFFIXED} = '' OR regexp_matches({_SUFFIXED}, '[.!?]$') THEN {_SUFFIXED} ELSE {_SUFFIXED} || '.' END"
_KEEP = "SELECT notes_id, sec_heading, sub_heading, text FROM p WHERE NOT "
_STEPS = {
    "notes_without_meta_noise": (notes.without_meta_noise, _KEEP + _META),
    "notes_without_triple_dumps": (notes.without_triple_dumps, f"SELECT notes_id, sec_heading, sub_heading, text FROM (SELECT * REPLACE ({_ENDED} AS text) FROM p WHERE NOT {_m(*B.TRIPLE_DUMP)}) WHERE len(string_split_regex(text, '\\s+')) >= 3"),
    "notes_without_tautologies": (notes.without_tautologies, f"""SELECT notes_id, sec_heading, sub_heading, text FROM (SELECT *, {_TAUTOLOGY} AS bad, min({_TAUTOLOGY}::INT) OVER s AS least, min(pt_pos) OVER s AS first FROM p WINDOW s AS (PARTITION BY notes_id, sec_pos, sub_pos))
 WHERE NOT bad OR (least = 1 AND pt_pos = first)"""),
    "notes_without_circular_definitions": (notes.without_circular_definitions, f"""SELECT notes_id, sec_heading, sub_heading, coalesce(r, text) AS text FROM (SELECT *, count(r) OVER (PARTITION BY notes_id, sec_pos, sub_pos) AS n FROM (SELECT *, {_REWRITTEN} AS r FROM p)) WHERE r IS NOT NULL OR n = 0"""),
    "notes_without_course_sections": (notes.without_course_sections, f"""SELECT notes_id, sec_heading, sub_heading, text FROM (SELECT *, count(*) OVER (PARTITION BY notes_id, sec_pos) AS n FROM p) WHERE NOT ({_m(B.COURSE_WORDS, of="sec_heading")} OR (n <= 3 AND {_m(*B.COURSE_FRAMES, of="sec_heading")}))"""),
    "notes_without_navigation": (notes.without_navigation, _KEEP + _m(*B.NAVIGATION)),
    "notes_without_takeaways": (notes.without_takeaways, _KEEP + _m(B.TAKEAWAYS, of="sub_heading")),
    "notes_without_ocr_noise": (notes.without_ocr_noise, _KEEP + f"(NOT {_CLEAN} OR {_m(*B.SEMANTIC_NOISE)})"),
    "notes_with_lesson_headings": (notes.with_lesson_headings, "SELECT notes_id, sec_heading, CASE lower(sub_heading) " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.HEADINGS.items()) + " ELSE sub_heading END AS sub_heading, text FROM p"),
}


def _step(name: str, step, sql: str) -> None:
    def run(spark, sf) -> DataFrame:
        return step(_points_of_rules(spark, sf)).select("notes_id", "sec_heading", "sub_heading", "text")

    run.__name__ = name
    query(f"WITH {_P} {sql}")(run)


for _name, (_run, _sql) in _STEPS.items():
    _step(_name, _run, _sql)


@query(f"WITH {_P} SELECT notes_id, sec_pos, count(*) AS n FROM p GROUP BY ALL HAVING count(*) <= 2")
def notes_stub_sections(spark, sf):
    points = _points_of_rules(spark, sf)
    return notes.stub_sections(points)


@query(f"""WITH {_P}, c AS (SELECT *, trim(regexp_replace({_COLLAPSED.format(f"regexp_replace(sec_heading, {_q(R.HEADING_NOISE)}, ' ', 'g')")}, '[-–—:;.,]+$', '')) AS h FROM p),
g AS (SELECT *, list_filter(regexp_extract_all(lower(h), '[a-z]+'), lambda x: length(x) > 2) AS g FROM c), x AS (SELECT * EXCLUDE (g), list_contains({_list(B.GENERIC_HEADINGS)}, lower(h)) OR starts_with(h, '(') OR (len(g) > 0 AND len(list_filter(g, lambda x: NOT list_contains({_list(B.GENERIC_TOKENS)}, x))) = 0) AS bad FROM g),
o AS (SELECT notes_id, sec_pos, h, sub_pos, pt_pos, unnest(a) AS word, generate_subscripts(a, 1) AS k FROM (SELECT *, regexp_extract_all(l, '[a-z]{{4,}}') AS a FROM x WHERE bad)),
n AS (SELECT notes_id, sec_pos, h, word, count(*) AS n, min(sub_pos * 1000000 + pt_pos * 1000 + k) AS first FROM o WHERE NOT list_contains({_list(notes.HEADING_STOPS)}, word) GROUP BY ALL),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY notes_id, sec_pos ORDER BY n DESC, first) <= 3), t2 AS (SELECT * FROM r WHERE word <> lower(h) QUALIFY row_number() OVER (PARTITION BY notes_id, sec_pos ORDER BY n DESC, first) <= 2),
m AS (SELECT notes_id, sec_pos, string_agg(upper(word[1]) || word[2:], ' and ' ORDER BY n DESC, first) AS w FROM t2 GROUP BY ALL)
SELECT notes_id, sec_pos, min(coalesce(m.w, CASE WHEN bad THEN upper(h[1]) || h[2:] ELSE h END)) AS sec_heading, count(*) AS n FROM x LEFT JOIN m USING (notes_id, sec_pos) GROUP BY notes_id, sec_pos""")
def notes_headings_from_words(spark, sf):
    out = notes.headings_from_words(_points_of_rules(spark, sf))
    return out.groupBy("notes_id", "sec_pos").agg(F.min("sec_heading").alias("sec_heading"), F.count("*").alias("n"))


def _second(n: int) -> str:
    """The start of the second of the first two equal runs of n words, from 1; null without any."""
    runs = f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    first = f"list_filter(range(1, len(r{n}) + 1), lambda i: list_position(r{n}[i + 1:], r{n}[i]) > 0)[1]"
    return f"SELECT *, {first} AS i{n} FROM (SELECT *, {runs} AS r{n} FROM {{of}})"


_REPEATS = _second(6).format(of="w")
for _n in (5, 4, 3):
    _REPEATS = _second(_n).format(of=f"({_REPEATS})")
_STARTS = ", ".join(f"WHEN i{n} IS NOT NULL THEN struct_pack(s := i{n} + list_position(r{n}[i{n} + 1:], r{n}[i{n}]), n := {n})".lstrip() for n in (6, 5, 4, 3)).replace(", WHEN", " WHEN")


@query(rf"""WITH {_B}, x AS (SELECT *, CASE WHEN len(w) < 6 THEN NULL {_STARTS} END AS f FROM ({_REPEATS}))
SELECT bullet_id, CASE WHEN f IS NULL THEN t ELSE regexp_replace(array_to_string(list_concat(w[:f.s - 1], w[f.s + f.n:]), ' '), '[ .]+$', '') || '.' END AS text FROM x""")
def collapsed_phrases(spark, sf):
    return phrases.without_repeated_phrases(_bullets(spark, sf), "bullet_id", "t")
