"""Registered queries of alignment, narrative order, topics, likeness and kinds, and their SQL.

Sentences are the lines of a document; its references are the sentences of an item of benchmark, whose first words are
its concepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.functions import bullets as B
from plumbago.functions import quality as Q
from plumbago.functions import similarity as S
from plumbago.functions import text as T
from plumbago.operators import alignment as A
from plumbago.operators import narrative as N
from plumbago.operators import notes, refining
from plumbago.plans.registry import _G, _edges, _nodes, _t, query
from plumbago.plans.rules import _B, _P, _bullets, _holds, _list, _m, _plain_sql, _plain_text, _points_of_rules, _q

def _sentences(spark, sf) -> DataFrame:
    return _bullets(spark, sf).select(F.expr("bullet_id div 1000000").alias("key"), (F.col("bullet_id") % 1_000_000).cast("int").alias("pos"), F.col("t").alias("sentence"))


def _references(spark, sf) -> DataFrame:
    """(key, pos, sentence): the sentences of each document's item of benchmark, the one at the document's number."""
    items = _t(spark, sf, "benchmark")
    told = F.split(F.regexp_replace(_plain_text(F.coalesce("text", F.lit(""))), r"([.!?]) +", "$1\u0001"), "\u0001")
    sentences = items.select("item_id", F.posexplode(told).alias("pos", "sentence")).where("sentence <> ''")
    docs = _t(spark, sf, "documents").crossJoin(F.broadcast(items.agg(F.count("*").alias("n")))).select(F.col("doc_id").cast("long").alias("key"), F.pmod("doc_id", "n").alias("item_id"))
    return docs.join(sentences, "item_id").select("key", "pos", "sentence")


def _concepts(spark, sf) -> DataFrame:
    """(key, pos, concept): the first two words of each reference sentence."""
    words = F.slice(F.split("sentence", " "), 1, 2)
    return _references(spark, sf).select("key", "pos", F.regexp_replace(F.array_join(words, " "), r"[^A-Za-z0-9 ]", "").alias("concept")).where("concept <> ''")


_S = f"""{_B}, s AS MATERIALIZED (SELECT bullet_id // 1000000 AS key, (bullet_id % 1000000)::INT AS pos, t AS sentence, w, l FROM w),
told AS (SELECT item_id, string_split(regexp_replace({_plain_sql("coalesce(text, '')")}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS a FROM benchmark),
r AS MATERIALIZED (SELECT doc_id::BIGINT AS key, pos, sentence FROM documents JOIN (SELECT item_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS pos FROM told) ON item_id = doc_id % (SELECT count(*) FROM benchmark) WHERE sentence <> ''),
c AS MATERIALIZED (SELECT * FROM (SELECT key, pos, regexp_replace(array_to_string(string_split(sentence, ' ')[1:2], ' '), '[^A-Za-z0-9 ]', '', 'g') AS concept FROM r) WHERE concept <> '')"""
_W = "list_distinct(regexp_extract_all(lower({}), '\\b[a-z]+\\b'))"


def _over(a: str, b: str, by: str = "greatest") -> str:
    whole = {"greatest": f"greatest(len({a}), len({b}))", "least": f"least(len({a}), len({b}))", "union": f"len(list_distinct(list_concat({a}, {b})))"}[by]
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / {whole} ELSE 0 END"


_LIKE = _over(_W.format("s.sentence"), _W.format("r.sentence"))
_CATEGORY = "CASE " + " ".join(f"WHEN {_holds(cues, 'lower({t})')} THEN {_q(name)}" for name, cues in A.STRUCTURE.items()) + " ELSE {d} END"


@query(f"WITH {_S} SELECT s.key, s.pos, round(coalesce(max({_LIKE}), 0), 6) AS best FROM s LEFT JOIN r ON r.key = s.key GROUP BY s.key, s.pos")
def sentence_best_likeness(spark, sf):
    return A.best_likeness(_sentences(spark, sf), _references(spark, sf)).select("key", "pos", F.round("best", 6).alias("best"))


@query(f"""WITH {_S}, m AS (SELECT s.key, s.pos, max({_LIKE}) >= 0.4 OR max(r.key) IS NULL AS good FROM s LEFT JOIN r ON r.key = s.key GROUP BY s.key, s.pos),
n AS (SELECT *, count(*) FILTER (good) OVER e AS n, count(*) OVER e AS a, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM m WINDOW e AS (PARTITION BY key)) SELECT key, pos FROM n WHERE CASE WHEN n < 3 AND a >= 3 THEN k <= 5 ELSE good END""")
def sentences_precise(spark, sf):
    return A.precise(_sentences(spark, sf), _references(spark, sf)).select("key", "pos")


@query(f"""WITH {_S}, p AS (SELECT s.key, s.pos, {_W.format("s.sentence")} AS a, list_distinct(list_filter(string_split_regex(lower(concept), '\\s+'), lambda x: x <> '')) AS b, contains(s.l, lower(concept)) AS whole FROM s LEFT JOIN c ON c.key = s.key),
g AS (SELECT key, pos, bool_or(whole IS NULL OR whole OR (len(list_intersect(a, b)) > 0 AND len(list_intersect(a, b)) >= 0.5 * len(b))) AS good FROM p GROUP BY key, pos),
n AS (SELECT *, count(*) FILTER (good) OVER e AS n, count(*) OVER e AS a, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM g WINDOW e AS (PARTITION BY key)) SELECT key, pos FROM n WHERE CASE WHEN n < 3 AND a >= 3 THEN k <= 5 ELSE good END""")
def sentences_relevant(spark, sf):
    return A.relevant(_sentences(spark, sf), _concepts(spark, sf)).select("key", "pos")


@query(f"""WITH {_S}, h AS (SELECT r.key, r.pos, r.sentence FROM r JOIN c USING (key) WHERE contains(lower(r.sentence), lower(concept)) GROUP BY ALL)
SELECT r.key, r.pos, r.sentence FROM h r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = r.key AND {_LIKE} > 0.7)""")
def sentence_anchors(spark, sf):
    return A.anchors(_sentences(spark, sf), _references(spark, sf), _concepts(spark, sf))


_ROLES = " UNION ALL ".join(f"SELECT key, trim(unnest(regexp_extract_all(sentence, {_q(p)}, 1, 'i'))) AS entity, rtrim(trim(unnest(regexp_extract_all(sentence, {_q(p)}, 2, 'i'))), '.') AS function FROM r" for p in A.FUNCTIONS)


@query(f"WITH {_S}, x AS ({_ROLES}) SELECT DISTINCT key, entity, function, entity || ' is responsible for ' || function || '.' AS sentence FROM x WHERE length(entity) > 3 AND length(function) > 5")
def role_functions(spark, sf):
    return A.role_functions(_references(spark, sf))


_WHOLE = "whole AS (SELECT key, lower(string_agg(sentence, ' ' ORDER BY pos)) AS text FROM s GROUP BY key)"


@query(f"""WITH {_S}, x AS ({_ROLES}), {_WHOLE} SELECT DISTINCT key, entity || ' is responsible for ' || function || '.' AS sentence FROM x JOIN whole USING (key) WHERE length(entity) > 3 AND length(function) > 5 AND contains(text, lower(entity)) AND NOT contains(text, lower(function))""")
def missing_roles(spark, sf):
    return A.missing_roles(_sentences(spark, sf), A.role_functions(_references(spark, sf)))


@query(f"WITH {_S}, {_WHOLE} SELECT key, concept FROM c JOIN whole USING (key) WHERE contains(text, lower(concept))")
def covered_concepts(spark, sf):
    return A.covered(_sentences(spark, sf), _concepts(spark, sf))


@query(f"""WITH {_S}, {_WHOLE}, m AS (SELECT key, concept FROM (SELECT c.key, concept, coalesce(text, '') AS text FROM c LEFT JOIN whole USING (key)) WHERE NOT contains(text, lower(concept)) AND len(list_filter(string_split_regex(lower(concept), '\\s+'), lambda x: length(x) > 3 AND contains(text, x))) = 0)
SELECT key, concept, replace(CASE {_CATEGORY.format(t="concept", d="'default'")} {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in A.COVERAGE.items())} ELSE {_q(A.COVERAGE["default"])} END, '{{concept}}',
 array_to_string(list_transform(string_split(lower(concept), ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS sentence FROM m""")
def coverage_sentences(spark, sf):
    lost = A.missing(_sentences(spark, sf), _concepts(spark, sf))
    return lost.withColumn("sentence", A.coverage_sentence(F.col("concept")))


@query(f"""WITH {_S}, o AS (SELECT key, pos, {_CATEGORY.format(t="sentence", d="'other'")} AS c FROM s)
SELECT key, pos, c AS category, CAST(row_number() OVER (PARTITION BY key ORDER BY list_position({_list((*A.STRUCTURE, "other"))}, c), pos) - 1 AS INT) AS place FROM o""")
def sentences_in_structure(spark, sf):
    return A.in_structure(_sentences(spark, sf)).select("key", "pos", A.category(F.col("sentence")).alias("category"), "place")


_HITS = "[" + ", ".join(f"len(list_filter({_list(cues)}, lambda v: contains(l, v)))" for _, cues in notes.DISCOURSE) + "]"
_ROLE = f"""d AS (SELECT *, {_HITS} AS h FROM s), e AS (SELECT *, CASE WHEN list_max(h) = 0 THEN 100 ELSE list_position(h, list_max(h)) END AS pri FROM d),
f AS (SELECT *, coalesce({_list([name for name, _ in notes.DISCOURSE])}[pri], 'other') AS role, CAST(row_number() OVER (PARTITION BY key ORDER BY pri, pos) - 1 AS INT) AS place FROM e)"""


@query(f"WITH {_S}, {_ROLE} SELECT key, pos, role, place FROM f")
def sentences_restructured(spark, sf):
    return N.restructured(_sentences(spark, sf)).select("key", "pos", "role", "place")


@query(f"""WITH {_S}, {_ROLE}, g AS (SELECT *, lag(role) OVER (PARTITION BY key ORDER BY place) AS before FROM f), i AS (SELECT *, CASE WHEN before <> role THEN CASE role {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in N.TRANSITIONS.items())} END END AS lead FROM g)
SELECT key, place, CASE WHEN lead IS NULL OR len(list_filter({_list([t.lower()[:10] for t in N.TRANSITIONS.values()])}, lambda v: starts_with(l, v))) > 0 THEN sentence ELSE lead || ' ' || lower(sentence[1]) || sentence[2:] END AS sentence FROM i""")
def sentences_with_transitions(spark, sf):
    return N.with_transitions(N.restructured(_sentences(spark, sf))).select("key", "place", "sentence")


_TOPIC = "CASE WHEN count(*) OVER (PARTITION BY key) <= 2 THEN 'main' " + " ".join(f"WHEN {_holds(cues, 'l')} THEN {_q(name)}" for name, cues in N.TOPICS.items()) + " ELSE 'other' END"
_NAMED = "CASE " + " ".join(f"WHEN {_holds(cues, 'l')} THEN {_q(name)}" for name, cues in N.TOPIC_NAMES.items()) + " ELSE 'Topic_' || pos END"


@query(f"WITH {_S} SELECT key, pos, {_TOPIC} AS topic, {_NAMED} AS name FROM s")
def sentence_topics(spark, sf):
    return N.topics(_sentences(spark, sf)).select("key", "pos", "topic", N.topic_name(F.col("sentence"), F.col("pos")).alias("name"))


@query(f"""WITH {_S}, x AS (SELECT *, {_TOPIC} AS topic, len(w) + CASE WHEN {_holds(N.DEFINING, "l")} THEN 10 ELSE 0 END AS score FROM s), y AS (SELECT *, count(*) OVER (PARTITION BY key, topic) AS n, row_number() OVER (PARTITION BY key, topic ORDER BY score DESC, sentence DESC, pos) AS r FROM x)
SELECT key, topic, string_agg(sentence, ' ' ORDER BY CASE WHEN n > 5 THEN r ELSE pos END, sentence) AS summary FROM y WHERE r <= 5 GROUP BY key, topic""")
def topic_summaries(spark, sf):
    return N.topic_summaries(N.topics(_sentences(spark, sf)))


_COMPOUND = f"list_filter(regexp_extract_all(lower(sentence), '\\b([a-z]+(?:\\s+[a-z]+){{1,3}})\\b', 1), lambda p: len(list_filter(string_split_regex(p, '\\s+'), lambda x: length(x) > 3 AND NOT list_contains({_list(A.STOPS)}, x))) > 0)"
_CAPITAL = "list_transform(list_filter(regexp_extract_all(sentence, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda p: length(p) > 3), lambda p: lower(p))"
_HYPHEN = "regexp_extract_all(lower(sentence), '\\b([a-z]+-[a-z]+)\\b', 1)"


@query(f"WITH {_S} SELECT key, pos, array_to_string(list_concat(list_concat({_CAPITAL}, {_COMPOUND}), {_HYPHEN}), '|') AS phrases FROM r")
def noun_phrases(spark, sf):
    return _references(spark, sf).select("key", "pos", F.array_join(A.noun_phrases(F.col("sentence")), "|").alias("phrases"))


_TOLD = " , ".join(f"regexp_extract_all(sentence, {_q(p)}, 1, 'i')" for p in (r"(?:called|known\s+as|referred\s+to\s+as|termed)\s+[\"']?([A-Za-z][A-Za-z\s]{2,30}?)[\"']?[.,]", r"([A-Za-z][A-Za-z\s]{2,30}?)\s+(?:is\s+defined\s+as|refers\s+to|means)"))


@query(f"""WITH {_S} SELECT key, pos, array_to_string(list_concat(list_concat(list_transform(list_concat(regexp_extract_all(sentence, '\\b([A-Z]{{2,6}})\\b', 1), regexp_extract_all(sentence, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1)), lambda x: lower(x)), {_HYPHEN}),
 list_filter(list_transform(list_concat({_TOLD}), lambda x: lower(trim(x))), lambda x: length(x) > 2)), '|') AS terms FROM r""")
def technical_terms(spark, sf):
    return _references(spark, sf).select("key", "pos", F.array_join(A.technical_terms(F.col("sentence")), "|").alias("terms"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$')) AS w FROM documents), o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w WHERE len(w) >= 5),
c AS (SELECT doc_id, word, count(*) AS n, min(p) AS first FROM o WHERE NOT list_contains({_list(A.STOPS)}, word) GROUP BY ALL)
SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INT) AS place FROM c QUALIFY place <= 20""")
def text_keywords(spark, sf):
    return A.keywords(_t(spark, sf, "documents"), "doc_id")


def _set(of: str, stops, long: bool) -> str:
    found = f"regexp_extract_all(lower({of}), '\\b[a-z]{{3,}}\\b')" if long else f"string_split_regex(lower({of}), '\\s+')"
    return f"list_filter(list_distinct({found}), lambda x: x <> '' AND NOT list_contains({_list(stops)}, x))"


def _pair(stops, long: bool, by: str) -> str:
    return f"round({_over(_set('s.sentence', stops, long), _set('r.sentence', stops, long), by)}, 6)"


_LETTERS = "list_filter(list_distinct(string_split_regex(regexp_replace(lower({}), '[^a-z\\s]', '', 'g'), '\\s+')), lambda x: x <> '')"
_SUFFIXLESS = f"list_distinct(regexp_extract_all(regexp_replace(lower({{}}), {_q(B.OVERLAP_SUFFIXES)}, '', 'g'), '[a-z]{{{{3,}}}}'))"
_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SPLIT = f"list_distinct(string_split({_NORMAL}, ' '))"


@query(f"""WITH {_S} SELECT s.key, s.pos, r.pos AS other, {_pair(S.TOPIC_STOPS, True, "union")} AS topic, {_pair(S.SUBSECTION_STOPS, True, "greatest")} AS subsection, {_pair(S.SECTION_STOPS, False, "least")} AS section, {_pair(S.LABEL_STOPS, False, "union")} AS label,
{_over(_set("s.sentence", S.SENTENCE_STOPS, False), _set("r.sentence", S.SENTENCE_STOPS, False), "union")} > 0.85 AS like_sentences, round({_over(_LETTERS.format("s.sentence"), _LETTERS.format("r.sentence"))}, 6) AS letters,
{_over(_SUFFIXLESS.format("s.sentence"), _SUFFIXLESS.format("r.sentence"))} >= 0.5 AS synonyms, {_NORMAL.format("s.sentence")} <> '' AND {_NORMAL.format("r.sentence")} <> '' AND (starts_with({_NORMAL.format("s.sentence")}, {_NORMAL.format("r.sentence")}) OR starts_with({_NORMAL.format("r.sentence")}, {_NORMAL.format("s.sentence")})
 OR ({_over(_SPLIT.format("s.sentence"), _SPLIT.format("r.sentence"))} >= 0.6 AND least(s.pos % 9, 5) <= 3)) AS fragments FROM s JOIN r USING (key)""")
def heading_likeness(spark, sf):
    """Each sentence meets the few of its document's item, so what is compared is taken from each once, after the shuffle."""
    sets = {
        "topic": lambda c: S._long_words(c, S.TOPIC_STOPS), "subsection": lambda c: S._long_words(c, S.SUBSECTION_STOPS), "section": lambda c: S._spaced_words(c, S.SECTION_STOPS), "label": lambda c: S._spaced_words(c, S.LABEL_STOPS),
        "like": lambda c: S._spaced_words(c, S.SENTENCE_STOPS), "letters": S.letter_words, "synonyms": B.overlap_words, "plain": B.plain_heading, "words": lambda c: B.plain_words(B.plain_heading(c)),
    }

    def side(rows: DataFrame, pos: str, end: str) -> DataFrame:
        dealt = rows.repartition("key")
        return dealt.select("key", F.col("pos").alias(pos), *(f(F.col("sentence")).alias(name + end) for name, f in sets.items()))

    pairs = side(_sentences(spark, sf), "pos", "_a").join(side(_references(spark, sf), "other", "_b"), "key")
    of = lambda measure, name: measure(F.col(name + "_a"), F.col(name + "_b"))
    return pairs.select(
        "key", "pos", "other", F.round(of(S.jaccard, "topic"), 6).alias("topic"), F.round(of(S.overlap_max, "subsection"), 6).alias("subsection"), F.round(of(S.overlap_min, "section"), 6).alias("section"), F.round(of(S.jaccard, "label"), 6).alias("label"),
        (of(S.jaccard, "like") > 0.85).alias("like_sentences"), F.round(of(S.overlap_max, "letters"), 6).alias("letters"), of(B.words_overlap, "synonyms").alias("synonyms"),
        B.are_plain_fragments(F.col("plain_a"), F.col("plain_b"), F.col("words_a"), F.col("words_b"), F.col("pos") % 9, F.lit(5)).alias("fragments"),
    )


_KIND = "CASE " + " ".join(f"WHEN {_m(a, of='label')} THEN {_q(name)}" for name, a, _ in N.KINDS) + " END"


@query(f"""WITH {_G}, k AS (SELECT source AS id, count(*) AS n FROM e1 WHERE regexp_matches(lower(relation), 'has operation|supports operation|has function|performs') GROUP BY source),
x AS (SELECT lower(label) AS label, pos, CASE WHEN type = 'party' THEN 'kind of ' || label ELSE label END AS l, coalesce(n, 0) AS n FROM n1 LEFT JOIN k USING (id))
SELECT label, coalesce(CASE {" ".join(f"WHEN {_m(a, of='label')} OR {_m(b, of='l')} THEN {_q(name)}" for name, a, b in N.KINDS)} END, CASE WHEN n >= 2 THEN 'operation' ELSE 'concept' END) AS kind FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY pos DESC) = 1""")
def kinds_by_label(spark, sf):
    nodes = _nodes(spark, sf, 1).withColumn("description", F.when(F.col("type") == "party", F.concat(F.lit("kind of "), "label")).otherwise(F.col("label")))
    return N.kinds_by_label(nodes, _edges(spark, sf, 1))


@query(f"WITH {_B} SELECT bullet_id, coalesce({_KIND.replace('label', 't')}, 'none') AS kind FROM w")
def bullet_kinds(spark, sf):
    return _bullets(spark, sf).select("bullet_id", F.coalesce(N.kind_of(F.col("t")), F.lit("none")).alias("kind"))


@query(f"""WITH {_G}, x AS (SELECT lower(label) AS word FROM n1 WHERE length(label) > 2 UNION SELECT unnest(list_filter(string_split_regex(lower(label), '\\s+'), lambda x: length(x) > 3)) FROM n1 WHERE length(label) > 2 UNION SELECT lower(relation) FROM e1 WHERE length(relation) > 3)
SELECT word FROM x WHERE NOT list_contains({_list(N.KEYWORD_STOPS)}, word)""")
def domain_keywords(spark, sf):
    return N.domain_keywords(_nodes(spark, sf, 1), _edges(spark, sf, 1))


@query(f"""WITH {_P}, o AS (SELECT notes_id, sec_pos, sub_pos, pt_pos, unnest(a) AS word, generate_subscripts(a, 1) AS k FROM (SELECT *, list_filter(w, lambda x: true) AS z, list_transform(list_filter(w, lambda x: length(x) > 4 AND NOT list_contains({_list(N.COMMON_WORDS)}, lower(x))), lambda x: lower(x)) AS a FROM p)),
c AS (SELECT notes_id, sec_pos, word, count(*) AS n, min(sub_pos * 1000000 + pt_pos * 1000 + k) AS first FROM o GROUP BY ALL), m AS (SELECT *, EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), word)) AS known FROM c)
SELECT notes_id, sec_pos, upper(word[1]) || word[2:] AS word FROM m QUALIFY row_number() OVER (PARTITION BY notes_id, sec_pos ORDER BY known DESC, n DESC, first) = 1""")
def section_commonest_words(spark, sf):
    labels = _t(spark, sf, "part").select(F.col("p_name").alias("label"))
    return N.commonest_words(_points_of_rules(spark, sf), ["notes_id", "sec_pos"], labels)


@query("""WITH e AS (SELECT event_id, struct_pack(x := event_id % 97, y := event_id % 53, w := 10 + event_id % 7, h := 5 + event_id % 11) AS a, struct_pack(x := event_id % 89, y := event_id % 47, w := 10 + event_id % 5, h := 5 + event_id % 29) AS b FROM events)
SELECT event_id, a.y + a.h // 2 AS centre, NOT (b.h > 2 * a.h) AND abs((b.y + b.h // 2) - (a.y + a.h // 2)) <= a.h AS same, least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h FROM e""")
def joined_boxes(spark, sf):
    box = lambda p, q, r, s: F.struct((F.col("event_id") % p).alias("x"), (F.col("event_id") % q).alias("y"), (10 + F.col("event_id") % r).alias("w"), (5 + F.col("event_id") % s).alias("h"))
    rows = _t(spark, sf, "events").select("event_id", box(97, 53, 7, 11).alias("a"), box(89, 47, 5, 29).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("event_id", B.box_centre(a).alias("centre"), B.is_same_box(a, b).alias("same"), B.joined_box(a, b).alias("j")).select("event_id", "centre", "same", "j.*")


@query(r"SELECT n_nationkey AS key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n_name || ' (Old/New) - ' || n_comment), '[/\\()\-]', ' ', 'g'), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g') AS slug FROM (SELECT n_nationkey, n_name, 'x y.' AS n_comment FROM nation)")
def name_slugs(spark, sf):
    name = F.concat("n_name", F.lit(" (Old/New) - x y."))
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), T.name_slug(name).alias("slug"))


_GAIN = " + ".join(f"CASE WHEN {test} THEN {by}::DOUBLE ELSE 0 END" for test, by in (
    ("contains(l, ' is ') OR contains(l, ' are ')", 0.35), ("contains(l, 'defined as') OR contains(l, 'refers to')", 0.3), ("contains(l, 'means') OR contains(l, 'represents')", 0.25), ("contains(l, 'item ' || key % 7)", 0.3),
    ("len(w) BETWEEN 5 AND 50", 0.2), ("starts_with(l, 'item ' || key % 7) OR starts_with(l, 'a item ' || key % 7) OR starts_with(l, 'the item ' || key % 7)", 0.2),
))
_ALPHA = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / greatest(length({0}), 1)"


@query(f"""WITH {_S} SELECT key, pos, round(CASE WHEN regexp_matches(trim(sentence), '\\?$') OR regexp_matches(l, '^(what|why|how|when|where|which) ') THEN 0 ELSE least({_GAIN}, 1.0) END, 6) AS confidence,
{_ALPHA.format("sentence")} >= 0.55 AND len(w) >= 3 AND NOT {" AND NOT ".join(f"regexp_matches(sentence, {_q(p)})" for p in (*Q.CODE_LINES[:3], *Q.SLIDE_LINES))} AND NOT regexp_matches(sentence, {_q("|".join(c + "{4,}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%&!-=."[:-1]))}) AS summary_line,
{_m(*Q.PROMOTION, of="l", case=True)} OR (len(w) < 15 AND {_m(*Q.AROUND, of="l", case=True)}) AS promotional, CAST(least(10, {", ".join(f"CASE WHEN contains(l, {_q(c)}) THEN {p} ELSE 10 END" for c, p in N.PRIORITIES.items())}) AS INT) AS priority FROM s""")
def sentence_scores(spark, sf):
    t = F.col("sentence")
    topic = F.concat(F.lit("Item "), (F.col("key") % 7).cast("string"))
    return _sentences(spark, sf).select("key", "pos", F.round(Q.definition_confidence(t, topic), 6).alias("confidence"), Q.is_summary_line(t).alias("summary_line"), Q.is_promotional(t).alias("promotional"), N.sentence_priority(t).alias("priority"))


@query(f"""WITH {_S}, ta AS (SELECT key, pos, {_set("sentence", S.SECTION_STOPS, False)} AS a FROM s), tb AS (SELECT key, pos AS target, {_set("sentence", S.SECTION_STOPS, False)} AS b FROM r),
x AS (SELECT key, pos, target, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS score FROM ta JOIN tb USING (key) WHERE len(list_intersect(a, b)) > 0)
SELECT key, pos, target, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY key, pos ORDER BY score DESC, target) = 1""")
def merge_targets(spark, sf):
    out = N.best_targets(_sentences(spark, sf).withColumnRenamed("sentence", "heading"), _references(spark, sf).withColumnRenamed("sentence", "heading"))
    return out.withColumn("score", F.round("score", 6))


_STOP9 = "['and','the','of','in','a','an','is','for','to']"


@query(f"""WITH {_S}, g AS (SELECT key, list(sentence ORDER BY pos) AS texts FROM r GROUP BY key), z AS (SELECT s.*, texts, lower(concept) AS c FROM s JOIN g USING (key) JOIN c ON c.key = s.key AND c.pos IN (1, 2, 4))
SELECT key, pos, c AS label, CASE WHEN contains(l, c) OR contains(c, l) THEN 3 WHEN len(list_filter(list_intersect(string_split_regex(c, '\\s+'), string_split_regex(l, '\\s+')), lambda x: NOT list_contains({_STOP9}, x))) > 0 OR contains(lower(texts[1]), c) THEN 2
 WHEN len(list_filter(texts, lambda x: contains(lower(x), c))) > 0 THEN 1 ELSE 0 END AS score FROM z""")
def section_match_scores(spark, sf):
    texts = _references(spark, sf).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("texts"))
    labels = _concepts(spark, sf).where("pos in (1, 2, 4)").select("key", F.lower("concept").alias("label"))
    return N.match_scores(_sentences(spark, sf).withColumnRenamed("sentence", "heading"), labels, texts.withColumn("subheadings", F.slice("texts", 1, 1)))


@query(f"""WITH {_P}, r AS (SELECT notes_id, sec_pos, sec_heading, any_value(CASE WHEN sec_pos % 4 = 0 THEN sec_pos END) AS root FROM p GROUP BY ALL), h AS (SELECT notes_id, sec_pos, lower(trim(sec_heading)) AS h, root FROM r)
SELECT notes_id, sec_pos, CAST(CASE WHEN h = 'additional concepts' THEN 9999 WHEN root IS NOT NULL THEN root WHEN {_holds(N.INTRODUCTIONS, "h")} THEN 0 ELSE 50 END AS INT) AS priority FROM h""")
def section_priorities(spark, sf):
    sections = _points_of_rules(spark, sf).select("notes_id", "sec_pos", "sec_heading").distinct()
    root = F.when(F.col("sec_pos") % 4 == 0, F.col("sec_pos"))
    return sections.select("notes_id", "sec_pos", N.section_priority(F.col("sec_heading"), root).alias("priority"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY ALL) SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p, role) - 1 AS INT) AS place FROM f")
def roles_in_order(spark, sf):
    return N.distinct_in_order(_t(spark, sf, "conversations"), "conv_id", "role", "turn")


@query(f"WITH {_P} SELECT notes_id, sec_pos, count(*) AS n_points FROM p GROUP BY ALL")
def notes_counts(spark, sf):
    return notes.count_points(_points_of_rules(spark, sf), "sec_pos")


@query(f"WITH {_P}, o AS (SELECT notes_id, sec_pos, unnest(regexp_extract_all(l, '[a-z]{{4,}}')) AS word FROM p) SELECT notes_id, sec_pos, word, count(*) AS n FROM o WHERE NOT list_contains({_list(notes.HEADING_STOPS)}, word) GROUP BY ALL")
def notes_section_words(spark, sf):
    return notes.section_words(_points_of_rules(spark, sf))


@query("""WITH i AS (SELECT page_id // 50 AS notes_id, page_id AS sec_pos, 'out/Slide_' || page_id % 7 || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '/' END AS path FROM pages)
SELECT notes_id, sec_pos, path FROM i QUALIFY row_number() OVER (PARTITION BY notes_id, regexp_replace(regexp_extract(rtrim(lower(path), '/'), '([^/]*)$', 1), '\\.\\w{2,4}$', '') ORDER BY sec_pos) = 1""")
def notes_first_images(spark, sf):
    kind = F.element_at(F.array(F.lit(".PNG"), F.lit(".jpg"), F.lit("/")), (F.col("page_id") % 3 + 1).cast("int"))
    images = _t(spark, sf, "pages").select(F.expr("page_id div 50").alias("notes_id"), F.col("page_id").alias("sec_pos"), F.concat(F.lit("out/Slide_"), (F.col("page_id") % 7).cast("string"), kind).alias("path"))
    return notes.first_images(images)


@query("""WITH c AS (SELECT n_name AS name, max('about ' || n_nationkey) AS caption FROM nation WHERE n_nationkey % 3 = 0 GROUP BY n_name) SELECT n_name AS name, n_nationkey, coalesce(caption, 'No caption available.') AS caption FROM nation LEFT JOIN c ON name = n_name""")
def captioned_assets(spark, sf):
    rows = _t(spark, sf, "nation")
    captions = rows.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("about "), F.col("n_nationkey").cast("string")).alias("caption"))
    return notes.with_captions(rows.select(F.col("n_name").alias("name"), "n_nationkey"), captions)


_TEXT = """u AS (SELECT notes_id, dense_rank() OVER (PARTITION BY notes_id ORDER BY sec_pos) AS i, sec_heading, dense_rank() OVER (PARTITION BY notes_id, sec_pos ORDER BY sub_pos) AS j, sub_heading, pt_pos, text FROM p),
v AS (SELECT notes_id, i, sec_heading, j, sub_heading, string_agg('    {mark} ' || text || chr(10), '' ORDER BY pt_pos) AS lines FROM u GROUP BY ALL),
x AS (SELECT notes_id, i, sec_heading, string_agg('  ' || i || '.' || j || ' ' || sub_heading || chr(10) || lines, chr(10) ORDER BY j) AS lines FROM v GROUP BY ALL)"""


@query(f"WITH {_P}, {_TEXT.format(mark='•')} SELECT notes_id, sha256('Notes' || chr(10) || repeat('=', 40) || chr(10) || chr(10) || string_agg(i || '. ' || sec_heading || chr(10) || repeat('-', 30) || chr(10) || lines || chr(10), chr(10) ORDER BY i)) AS digest FROM x GROUP BY notes_id")
def notes_plain_text(spark, sf):
    from plumbago.sources import graphs

    return graphs.plain_text(notes.nested(_points_of_rules(spark, sf))).select("notes_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_P}, {_TEXT.format(mark='-')} SELECT notes_id, sha256('Notes' || chr(10) || repeat('=', 5) || chr(10) || chr(10) || string_agg(i || '. ' || sec_heading || chr(10) || repeat('-', 40) || chr(10) || lines || chr(10), chr(10) ORDER BY i)) AS digest FROM x GROUP BY notes_id")
def notes_text_file(spark, sf):
    from plumbago.sources import graphs

    return graphs.plain_text(notes.nested(_points_of_rules(spark, sf)), "-", None, 40).select("notes_id", F.sha2("text", 256).alias("digest"))


_EVALS = """e AS (SELECT 'Video/' || event_type AS name, 'video_' || event_type AS file_key, event_id AS stamp, value / 1000.0::DOUBLE AS k, value / 3000.0::DOUBLE AS n, value / 7.0::DOUBLE AS hk, CASE WHEN event_id % 2 = 0 THEN value / 11.0::DOUBLE END AS hn FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY stamp DESC) = 1), g AS (SELECT file_key, name, round_even(k, 4) AS k, round_even(n, 4) AS n, round_even(hk, 2) AS hk, round_even(hn, 2) AS hn FROM f)"""


def _evaluations(spark, sf) -> DataFrame:
    from plumbago.sources import graphs

    v = F.col("value").cast("double")
    rows = _t(spark, sf, "events").select(F.concat(F.lit("Video/"), "event_type").alias("name"), F.col("event_id").alias("at"), (v / 1000.0).alias("kg_rouge1"), (v / 3000.0).alias("nonkg_rouge1"), (v / 7.0).alias("human_kg"), F.when(F.col("event_id") % 2 == 0, v / 11.0).alias("human_nonkg"))
    return graphs.evaluations(rows)


@query(f"WITH {_EVALS} SELECT file_key, name, k AS kg_rouge1, n AS nonkg_rouge1, hk AS human_kg, hn AS human_nonkg FROM g")
def stored_evaluations(spark, sf):
    return _evaluations(spark, sf)


@query(f"WITH {_EVALS} SELECT count(*) AS dataset_size, list(file_key ORDER BY file_key) AS file_keys, list(k ORDER BY file_key) AS kg_rouge1, list(n ORDER BY file_key) AS nonkg_rouge1, list(hk ORDER BY file_key) AS human_kg, list(hn ORDER BY file_key) AS human_nonkg FROM g")
def aggregated_evaluations(spark, sf):
    from plumbago.sources import graphs

    return graphs.aggregated(_evaluations(spark, sf))


def _first_wins(rows: str, like: str, most: int) -> str:
    """Rows of rows(grp, i, ...), i from 1: owners by the condition on x and y, settled one i after the other."""
    out = f"pr AS (SELECT y.grp, x.i AS f, y.i AS l FROM {rows} x JOIN {rows} y ON x.grp = y.grp AND x.i < y.i WHERE {like}), k1 AS (SELECT grp, i FROM {rows} WHERE i = 1)"
    for i in range(2, most + 1):
        out += f", k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT grp, i FROM {rows} h WHERE i = {i} AND NOT EXISTS (SELECT 1 FROM pr JOIN k{i - 1} k ON k.grp = pr.grp AND k.i = pr.f WHERE pr.grp = h.grp AND pr.l = {i}))"
    return out + f", ow AS (SELECT h.*, coalesce((SELECT min(f) FROM pr JOIN k{most} k ON k.grp = pr.grp AND k.i = pr.f WHERE pr.grp = h.grp AND pr.l = h.i), h.i) AS owner FROM {rows} h)"


_HEADS = "hd AS (SELECT notes_id AS grp, sec_pos, sec_heading AS heading, row_number() OVER (PARTITION BY notes_id ORDER BY sec_pos) AS i, {words} AS ws FROM (SELECT DISTINCT notes_id, sec_pos, sec_heading FROM p))"
_SHARED = "len(list_intersect(x.ws, y.ws))"
_MOVED = """mv AS (SELECT p.*, owner, sub_heading AS sh FROM p JOIN ow ON grp = notes_id AND ow.sec_pos = p.sec_pos),
ds AS (SELECT *, first_value(sub_heading) OVER (PARTITION BY notes_id, owner, lower(sub_heading) ORDER BY sec_pos, sub_pos) AS first_heading FROM mv QUALIFY row_number() OVER (PARTITION BY notes_id, owner, lower(sub_heading), lower(text) ORDER BY sec_pos, sub_pos, pt_pos) = 1)
SELECT ds.notes_id, h.heading AS sec_heading, lower(sub_heading) AS sub_heading, text FROM ds JOIN hd h ON h.grp = notes_id AND h.i = owner"""


def _lowered(df: DataFrame) -> DataFrame:
    return df.select("notes_id", "sec_heading", F.lower("sub_heading").alias("sub_heading"), "text")


@query(f"WITH {_P}, {_HEADS.format(words=_set('sec_heading', S.TOPIC_STOPS, True))}, {_first_wins('hd', f'{_SHARED} > 0 AND ({_SHARED} >= 0.5 * (len(x.ws) + len(y.ws) - {_SHARED}) OR {_SHARED} = least(len(x.ws), len(y.ws)))', 12)}, {_MOVED}")
def notes_merged_topics(spark, sf):
    return _lowered(notes.merged_topics(_points_of_rules(spark, sf)))


@query(f"WITH {_P}, {_HEADS.format(words=_LETTERS.format('sec_heading'))}, {_first_wins('hd', f'{_SHARED} > 0 AND {_SHARED} >= 0.65 * greatest(len(x.ws), len(y.ws))', 12)}, {_MOVED}")
def notes_merged_headings(spark, sf):
    return _lowered(notes.merged_headings(_points_of_rules(spark, sf)))


_SUBS = f"hd AS (SELECT notes_id * 1000 + sec_pos AS grp, notes_id, sec_pos, sub_pos, sub_heading AS heading, row_number() OVER (PARTITION BY notes_id, sec_pos ORDER BY sub_pos) AS i, {_set('sub_heading', S.SUBSECTION_STOPS, True)} AS ws FROM (SELECT DISTINCT notes_id, sec_pos, sub_pos, sub_heading FROM p))"


@query(f"""WITH {_P}, {_SUBS}, {_first_wins('hd', f'{_SHARED} > 0 AND {_SHARED} >= 0.55 * greatest(len(x.ws), len(y.ws))', 12)}, mv AS (SELECT p.*, owner FROM p JOIN ow USING (notes_id, sec_pos, sub_pos)),
nm AS (SELECT notes_id, sec_pos, owner, arg_min(sub_heading, length(sub_heading) * 1000 + sub_pos) AS h FROM mv GROUP BY ALL)
SELECT notes_id, sec_heading, h AS sub_heading, text FROM mv JOIN nm USING (notes_id, sec_pos, owner) QUALIFY row_number() OVER (PARTITION BY notes_id, sec_pos, owner, lower(text) ORDER BY sub_pos, pt_pos) = 1""")
def notes_merged_like_subsections(spark, sf):
    return notes.merged_like_subsections(_points_of_rules(spark, sf)).select("notes_id", "sec_heading", "sub_heading", "text")


@query(f"""WITH {_P}, z AS (SELECT *, count(*) OVER (PARTITION BY notes_id, sec_pos) AS n, {_LETTERS.format('text')} AS ws FROM p), df AS (SELECT * FROM z WHERE {_m(notes.DEFINITION.removeprefix("(?i)"), of="text")}),
pq AS (SELECT x.notes_id, CASE WHEN x.n >= y.n THEN y.sec_pos ELSE x.sec_pos END AS sec_pos, CASE WHEN x.n >= y.n THEN y.sub_pos ELSE x.sub_pos END AS sub_pos, CASE WHEN x.n >= y.n THEN y.pt_pos ELSE x.pt_pos END AS pt_pos FROM df x JOIN df y ON x.notes_id = y.notes_id AND x.sec_pos < y.sec_pos
 WHERE {_SHARED} >= 0.8 * greatest(len(x.ws), len(y.ws)))
SELECT notes_id, sec_heading, sub_heading, text FROM p ANTI JOIN pq USING (notes_id, sec_pos, sub_pos, pt_pos)""")
def notes_without_repeated_definitions(spark, sf):
    return notes.without_repeated_definitions(_points_of_rules(spark, sf)).select("notes_id", "sec_heading", "sub_heading", "text")


_RELATIONS = ("(includes|contains|has|comprises)", "(is a|is an|is|are)", "(uses|supports|provides|enables)", "(defines|describes|represents)", "(related to|associated with|connected to|covers)", "(stores|manages|organizes|processes)", "(implements|performs|allows)", "(known as|also known as)")
_FIRST_LEAD = r"regexp_extract(s, '^(.*?)\b(?:" + "|".join(_RELATIONS).replace("(", "(?:") + r")\b', 1, 'is')"
_TRIED = " ".join(rf"WHEN regexp_matches(part, '^{lead}\b{p}\b(.*)$', 'is') THEN struct_pack(r := lower(regexp_extract(part, '^{lead}\b{p}\b(.*)$', {k}, 'is')), o := regexp_extract(part, '^{lead}\b{p}\b(.*)$', {k + 1}, 'is'))" for lead, k in (("", 1), ("(.*?)", 2)) for p in _RELATIONS)
_NEAT = r"regexp_replace(trim(regexp_replace(regexp_replace(trim({0}), '^[.,;:]+|[.,;:]+$', '', 'g'), '\s+', ' ', 'g')), '\.+', '.', 'g')"
_BIG = "upper(left({0}, 1)) || substr({0}, 2)"
_TRIPLES = rf"""sp AS (SELECT key, pos, unnest(string_split(regexp_replace(sentence, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(sentence, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS k FROM s),
sq AS (SELECT key, pos, k, rtrim(trim(s), '.') AS s FROM sp WHERE rtrim(trim(s), '.') <> ''), sr AS (SELECT *, {_FIRST_LEAD} AS lead, string_split_regex(trim(s), '\s+') AS ws FROM sq WHERE regexp_matches(s, '\b(?:{"|".join(_RELATIONS)})\b', 'i')),
st AS (SELECT *, substr(s, length(lead) + 1) AS rest, trim(regexp_replace(CASE WHEN trim(lead) <> '' THEN trim(lead) WHEN len(ws) >= 3 THEN ws[1] || ' ' || ws[2] END, '^The\s+', '', 'i')) AS subject FROM sr),
su AS (SELECT key, pos, k, subject, trim(unnest(string_split_regex(rest, ',\s*'))) AS part, generate_subscripts(string_split_regex(rest, ',\s*'), 1) - 1 AS i FROM st WHERE subject IS NOT NULL),
sv AS (SELECT key, pos, k, i, subject, CASE {_TRIED} ELSE struct_pack(r := 'related to', o := part) END AS f FROM su WHERE part <> ''),
tr AS (SELECT key, pos, k, i, subject, f.r AS relation, regexp_replace(regexp_replace(rtrim(trim(f.o), '.,;'), '^to\s+', '', 'i'), '^the\s+', '', 'i') AS object FROM sv),
tn AS (SELECT key, pos, k, i, {_NEAT.format("subject")} AS s0, relation, {_NEAT.format("object")} AS o0 FROM tr WHERE length(object) > 1), tb AS (SELECT key, pos, k, i, {_BIG.format("s0")} AS subject, relation, {_BIG.format("o0")} AS object FROM tn),
tc AS (SELECT *, CASE WHEN (contains(lower(subject), 'data') AND contains(lower(object), 'information')) OR (contains(lower(subject), 'information') AND contains(lower(object), 'data')) THEN 'data_transformation' ELSE least(lower(subject), lower(object)) || chr(1) || greatest(lower(subject), lower(object)) END AS pair
 FROM tb WHERE length(subject) >= 2 AND length(object) >= 2 AND lower(subject) <> lower(object) AND lower(object) NOT IN ('the', 'a', 'an', 'to', 'it', 'is') AND relation NOT IN ('is associated with', 'is understood through', 'combines to form program', 'is related to')),
tt AS MATERIALIZED (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY key, pair ORDER BY pos, k, i) = 1)"""


@query(f"WITH {_S}, {_TRIPLES} SELECT key, pos, CAST(k AS INT) AS k, CAST(i AS INT) AS i, subject, relation, object FROM tt")
def text_triples(spark, sf):
    return refining.clean_triples(refining.triples(_sentences(spark, sf))).select("key", "place.*", "subject", "relation", "object")


_SAID = {k: v for k, v in (("is a", "is a type of"), ("known as", "is also known as"), ("also known as", "is also referred to as"), ("related to", "is associated with"), ("associated with", "works with"), ("connected to", "connects to"))}
_VERB = "CASE relation " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in _SAID.items()) + " ELSE relation END"
_JOINED = "CASE len({0}) WHEN 1 THEN {0}[1] WHEN 2 THEN {0}[1] || ' and ' || {0}[2] ELSE array_to_string(list_slice({0}, 1, len({0}) - 1), ', ') || ', and ' || {0}[len({0})] END"


@query(f"""WITH {_S}, {_TRIPLES}, o AS (SELECT *, (pos::BIGINT * 100000 + k) * 100000 + i AS pl FROM tt), ob AS (SELECT key, lower(trim(subject)) AS who, relation, min(pl) AS pl, arg_min(subject, pl) AS subject, list(object ORDER BY pl) AS os FROM o GROUP BY ALL),
cl AS (SELECT *, CASE WHEN who IN ('data structure', 'data structures') AND contains(lower(array_to_string(os, ' ')), 'type of particular way') THEN 'is a systematic method for organizing data' ELSE {_VERB} || ' ' || {_JOINED.format("os")} END AS clause FROM ob),
su2 AS (SELECT key, who, min(pl) AS pl, arg_min(subject, pl) AS subject, list(clause ORDER BY pl) AS cs FROM cl GROUP BY key, who)
SELECT key, {_BIG.format("subject")} || ' ' || {_JOINED.format("cs")} || '.' AS sentence FROM su2""")
def subject_sentences(spark, sf):
    return refining.subject_sentences(refining.clean_triples(refining.triples(_sentences(spark, sf)))).select("key", "sentence")


@query()
def refined_texts(spark, sf):
    return refining.refined(_sentences(spark, sf))
