"""The reference workload's queries by name, and the SQL each is held against.

Graph and notes inputs are derived from the relational tables: nations in regions and customers or suppliers in
nations are two concept graphs; conversations are sections, roles subsections, turns points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions import quality as Q
from plumbago.functions import similarity as S
from plumbago.functions import text as T
from plumbago.operators import dedup, evaluation, fusion, graph, ranking, statistics
from plumbago.sources import graphs
from plumbago.streaming import slides, timeline

FLAGSHIP = "fused_nodes"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived inputs -----------------------------------------------------------------------------------------------------


def _nodes(spark, sf, n: int) -> DataFrame:
    """Graph 1: regions, nations, customers; graph 2: the same regions and nations in lower case, suppliers."""
    label = (lambda c: F.col(c)) if n == 1 else (lambda c: F.lower(c))
    r, a = ("R", "N") if n == 1 else ("r", "n")
    third = _t(spark, sf, "customer").select("c_custkey", "c_name", F.lit("C").alias("p")) if n == 1 else _t(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit("S").alias("p"))
    third = third.toDF("key", "name", "p")
    one = lambda df, key, name, prefix, kind, base: df.select((F.col(key).cast("long") + base).alias("pos"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), name.alias("label"), F.lit("").alias("description"), F.lit(kind).alias("type"))
    rows = one(_t(spark, sf, "region"), "r_regionkey", label("r_name"), r, "region", 0).unionByName(one(_t(spark, sf, "nation"), "n_nationkey", label("n_name"), a, "nation", 1_000))
    return rows.unionByName(one(third, "key", F.col("name"), "C" if n == 1 else "S", "party", 1_000_000))


def _edges(spark, sf, n: int) -> DataFrame:
    r, a = ("R", "N") if n == 1 else ("r", "n")
    third = _t(spark, sf, "customer").select("c_custkey", "c_nationkey") if n == 1 else _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    third = third.toDF("key", "nation")
    up = _t(spark, sf, "nation").select(F.concat(F.lit(a), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit(r), F.col("n_regionkey").cast("string")).alias("target"), F.lit("is part of" if n == 1 else "part of").alias("relation"), F.col("n_nationkey").cast("long").alias("edge_idx"))
    return up.unionByName(third.select(F.concat(F.lit("C" if n == 1 else "S"), F.col("key").cast("string")).alias("source"), F.concat(F.lit(a), F.col("nation").cast("string")).alias("target"), F.lit("is located in").alias("relation"), (F.col("key") + 1_000_000).alias("edge_idx")))


_G = """
n1 AS (SELECT r_regionkey::BIGINT AS pos, 'R' || r_regionkey AS id, r_name AS label, 'region' AS type FROM region UNION ALL SELECT n_nationkey + 1000, 'N' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT c_custkey + 1000000, 'C' || c_custkey, c_name, 'party' FROM customer),
n2 AS (SELECT r_regionkey::BIGINT AS pos, 'r' || r_regionkey AS id, lower(r_name) AS label, 'region' AS type FROM region UNION ALL SELECT n_nationkey + 1000, 'n' || n_nationkey, lower(n_name), 'nation' FROM nation UNION ALL SELECT s_suppkey + 1000000, 'S' || s_suppkey, s_name, 'party' FROM supplier),
e1 AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'is part of' AS relation, n_nationkey::BIGINT AS edge_idx FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'is located in', c_custkey + 1000000 FROM customer),
e2 AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'part of' AS relation, n_nationkey::BIGINT AS edge_idx FROM nation UNION ALL SELECT 'S' || s_suppkey, 'n' || s_nationkey, 'is located in', s_suppkey + 1000000 FROM supplier)
"""
_FUSED = f"""{_G},
both_ AS (SELECT 1 AS g, * FROM n1 UNION ALL SELECT 2, * FROM n2),
firsts AS (SELECT lower(trim(label)) AS key, min(struct_pack(g := g, pos := pos, label := label)) AS f FROM both_ GROUP BY 1),
named AS (SELECT key, f.label AS label, 'N' || row_number() OVER (ORDER BY f.g, f.pos) AS id FROM firsts),
ids AS (SELECT g, both_.id AS old, named.id AS id FROM both_ JOIN named ON lower(trim(both_.label)) = named.key)"""


def _links(spark, sf) -> DataFrame:
    """Equal labels of both graphs, as an alignment."""
    a, b = _nodes(spark, sf, 1), _nodes(spark, sf, 2)
    return a.select(F.col("id").alias("id1"), fusion.label_key(F.col("label")).alias("k")).join(b.select(F.col("id").alias("id2"), fusion.label_key(F.col("label")).alias("k")), "k").select("id1", "id2")


_LINKS = "links AS (SELECT n1.id AS id1, n2.id AS id2 FROM n1 JOIN n2 ON lower(trim(n1.label)) = lower(trim(n2.label)))"


def _points(spark, sf) -> DataFrame:
    return _t(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("grp"), "conv_id", "role", "turn", "text")


def _pairs(spark, sf) -> DataFrame:
    items = _t(spark, sf, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    docs = _t(spark, sf, "documents").join(F.broadcast(n))
    return docs.select("doc_id", "text", F.pmod("doc_id", "n").alias("item_id")).join(items.withColumnRenamed("text", "reference"), "item_id").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("generated"), "reference")


_PAIRS = "pairs AS (SELECT d.doc_id AS pair_id, d.text AS generated, b.text AS reference FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"
_SYL = r"CASE WHEN length({w}) = 0 THEN 0 WHEN length({w}) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN {w} LIKE '%e' AND {w} NOT LIKE '%le' THEN 1 ELSE 0 END - CASE WHEN regexp_matches({w}, '[^dt]ed$') THEN 1 ELSE 0 END, 1) END"
_TOK = r"list_filter(string_split_regex(lower(coalesce({t}, '')), '\s+'), lambda x: x <> '')"


_GARBAGE = r"[|@\[\]{}<>\\;!#$%^&*]{2,}|[oO0lI1]{5,}|" + "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


# -- evaluation -----------------------------------------------------------------------------------------------------------


@query(rf"""
WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'), lambda x: lower(x)) AS w,
  len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(string_split_regex(s, '\s+')) >= 3)) AS s FROM documents),
m AS (SELECT doc_id, s, len(w) AS w, coalesce(list_sum(y), 0) AS y, len(list_filter(y, lambda q: q >= 3)) AS c FROM (SELECT doc_id, s, w, list_transform(w, lambda x: {_SYL.format(w="x")}) AS y FROM c)),
f AS (SELECT *, s > 0 AND w > 0 AS ok, w::DOUBLE / s AS asl, y::DOUBLE / w AS asw, c::DOUBLE / w AS share FROM m),
g AS (SELECT *, greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * asl - 84.6::DOUBLE * asw)) AS ease, 0.4::DOUBLE * (asl + 100 * share) AS fog FROM f)
SELECT doc_id, CASE WHEN ok THEN round_even(ease, 2) ELSE 0 END AS flesch, CASE WHEN ok THEN round_even(asl, 2) ELSE 0 END AS asl, CASE WHEN ok THEN round_even(asw, 2) ELSE 0 END AS asw,
 CASE WHEN NOT ok THEN 'N/A' WHEN ease >= 90 THEN 'Very Easy' WHEN ease >= 60 THEN 'Standard' WHEN ease >= 30 THEN 'Difficult' ELSE 'Very Difficult' END AS flesch_label,
 CASE WHEN ok THEN round_even(fog, 2) ELSE 0 END AS fog, CASE WHEN ok THEN round_even(share, 4) ELSE 0 END AS complex_word_ratio,
 CASE WHEN NOT ok THEN 'N/A' WHEN fog <= 10 THEN 'Easy' WHEN fog <= 14 THEN 'Moderate' ELSE 'Difficult' END AS fog_label FROM g
""")  # fmt: skip
def readability(spark, sf):
    return evaluation.readability(_t(spark, sf, "documents"))


def _ngrams_sql(n: int) -> str:
    gram = "list_transform(range(1, len(w) - {k} + 1), lambda i: array_to_string(list_slice(w, i, i + {k}), ' '))".replace("{k}", str(n - 1))
    return f"""
WITH {_PAIRS}, w AS (SELECT pair_id, 0 AS side, {_TOK.format(t="generated")} AS w FROM pairs UNION ALL SELECT pair_id, 1, {_TOK.format(t="reference")} FROM pairs),
g AS (SELECT pair_id, side, unnest({gram}) AS g FROM w), c AS (SELECT pair_id, g, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM g GROUP BY ALL)
SELECT pair_id, CAST(sum(least(x, y)) AS BIGINT) AS shared, CAST(sum(y) AS BIGINT) AS total FROM c GROUP BY pair_id"""


@query(_ngrams_sql(1))
def rouge1_counts(spark, sf):
    return evaluation._clipped(_pairs(spark, sf), "pair_id", 1)


@query(_ngrams_sql(2))
def rouge2_counts(spark, sf):
    return evaluation._clipped(_pairs(spark, sf), "pair_id", 2)


@query()
def rouge(spark, sf):
    return evaluation.rouge(_pairs(spark, sf))


@query(rf"SELECT word, CAST({_SYL.format(w='word')} AS INT) AS n FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'))) AS word FROM conversations)")
def word_syllables(spark, sf):
    words = _t(spark, sf, "conversations").select(F.explode(T.letters(F.lower("text"))).alias("word")).distinct()
    return words.select("word", T.syllables(F.col("word")).alias("n"))


#: A concept graph over common words of the invented prose.
_CONCEPTS = [("1", "the"), ("2", "and"), ("3", "of"), ("4", "in"), ("5", "der"), ("6", "les"), ("7", "absent")]
_RELATIONS = [("1", "2", "has"), ("2", "3", "uses"), ("3", "4", "is a"), ("5", "4", "contains"), ("6", "1", "purchases"), ("7", "1", "has"), ("9", "1", "has")]


def _concepts(spark):
    return spark.createDataFrame(_CONCEPTS, "id string, label string"), spark.createDataFrame(_RELATIONS, "source string, target string, relation string")


_CONCEPT_SQL = f"nodes AS (SELECT * FROM (VALUES {', '.join(map(str, _CONCEPTS))}) AS t(id, label)), edges AS (SELECT * FROM (VALUES {', '.join(map(str, _RELATIONS))}) AS t(source, target, relation))"


@query(f"""
WITH {_CONCEPT_SQL}, deps AS (SELECT a.label AS x, b.label AS y, regexp_matches(lower(relation), '{"|".join(evaluation.HIERARCHICAL)}') AS o FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.label <> b.label),
seen AS (SELECT doc_id, o, instr(lower(text), x) AS px, instr(lower(text), y) AS py FROM documents, deps),
s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (px > 0 AND py > 0) AS evaluated, count(*) FILTER (px > 0 AND py > 0 AND o AND py < px) AS violations FROM seen GROUP BY doc_id)
SELECT doc_id, CASE WHEN evaluated = 0 THEN 0.5 ELSE round_even(1 - violations::DOUBLE / evaluated, 4) END AS score, total, evaluated, violations, round_even(evaluated::DOUBLE / total, 4) AS coverage FROM s
""")
def dependency_score(spark, sf):
    return evaluation.dependency_score(_t(spark, sf, "documents"), *_concepts(spark))


@query(f"""
WITH {_CONCEPT_SQL}, v AS (SELECT DISTINCT lower(trim(relation)) AS v FROM edges WHERE length(trim(relation)) > 2)
SELECT doc_id, round_even(count(*) FILTER (contains(lower(text), v))::DOUBLE / count(*), 4) AS fidelity, count(*) FILTER (contains(lower(text), v)) AS matched, count(*) AS total FROM documents, v GROUP BY doc_id
""")
def verb_fidelity(spark, sf):
    return evaluation.verb_fidelity(_t(spark, sf, "documents"), _concepts(spark)[1])


# -- graphs ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_FUSED} SELECT id, label, '' AS description FROM named")
def fused_nodes(spark, sf):
    return fusion.fuse_exact(_nodes(spark, sf, 1), _edges(spark, sf, 1), _nodes(spark, sf, 2), _edges(spark, sf, 2))[0]


@query(f"""WITH {_FUSED}, e AS (SELECT 1 AS g, * FROM e1 UNION ALL SELECT 2, * FROM e2)
SELECT a.id AS source, b.id AS target, relation FROM e JOIN ids a ON a.g = e.g AND a.old = e.source JOIN ids b ON b.g = e.g AND b.old = e.target""")
def fused_edges(spark, sf):
    return fusion.fuse_exact(_nodes(spark, sf, 1), _edges(spark, sf, 1), _nodes(spark, sf, 2), _edges(spark, sf, 2))[1]


@query(f"""WITH {_G}, {_LINKS}
SELECT n1.id, n1.label, '' AS description, n1.type, CASE WHEN id2 IS NULL THEN 'kg1' ELSE 'kg1,kg2' END AS sources FROM n1 LEFT JOIN links ON id1 = n1.id
UNION ALL SELECT 'KG2_' || id, label, '', type, 'kg2' FROM n2 WHERE id NOT IN (SELECT id2 FROM links)""")
def merged_nodes(spark, sf):
    out = fusion.merge(_nodes(spark, sf, 1), _edges(spark, sf, 1), _nodes(spark, sf, 2), _edges(spark, sf, 2), _links(spark, sf))[0]
    return out.withColumn("sources", F.concat_ws(",", "sources"))


@query(f"""WITH {_G}, {_LINKS}, e AS (SELECT source, target, relation, 'kg1' AS g FROM e1 UNION ALL
SELECT coalesce(a.id1, 'KG2_' || source), coalesce(b.id1, 'KG2_' || target), relation, 'kg2' FROM e2 LEFT JOIN links a ON a.id2 = source LEFT JOIN links b ON b.id2 = target)
SELECT source, target, relation, string_agg(DISTINCT g, ',' ORDER BY g) AS sources, count(*) AS n_merged FROM e GROUP BY source, target, relation""")
def merged_edges(spark, sf):
    out = fusion.merge(_nodes(spark, sf, 1), _edges(spark, sf, 1), _nodes(spark, sf, 2), _edges(spark, sf, 2), _links(spark, sf))[1]
    return out.withColumn("sources", F.concat_ws(",", "sources"))


def _vectors(spark, sf, nodes: DataFrame) -> DataFrame:
    """The vector whose id is the node's pos modulo the number of vectors."""
    table = _t(spark, sf, "embeddings")
    n = table.agg(F.count("*").alias("n"))
    return nodes.join(F.broadcast(n)).select("id", F.pmod("pos", "n").alias("vec_id")).join(table, "vec_id").select("id", F.col("embedding").alias("vec"))


@query(f"""WITH {_G}, v AS (SELECT id, embedding AS vec FROM n1 JOIN embeddings ON vec_id = pos % (SELECT count(*) FROM embeddings)),
ends AS (SELECT source AS id, target AS other FROM e1 UNION ALL SELECT target, source FROM e1),
m AS (SELECT ends.id, k, avg(vec[k]::DOUBLE) AS x FROM ends JOIN v ON v.id = other, range(1, len(vec) + 1) AS r(k) GROUP BY ends.id, k)
SELECT id, CAST(k - 1 AS INT) AS k, round(x, 6) AS x FROM m""")
def structural_vectors(spark, sf):
    nodes = _nodes(spark, sf, 1)
    out = fusion.structural_vectors(nodes, _edges(spark, sf, 1), _vectors(spark, sf, nodes))
    return out.select("id", F.posexplode("vec").alias("k", "x")).select("id", "k", F.round("x", 6).alias("x"))


@query()
def alignment(spark, sf):
    n1, n2 = _nodes(spark, sf, 1), _nodes(spark, sf, 2)
    return fusion.align(n1, _edges(spark, sf, 1), _vectors(spark, sf, n1), n2, _edges(spark, sf, 2), _vectors(spark, sf, n2))


@query(f"""WITH {_G}, ends AS (SELECT source AS id, 1 AS o, 0 AS i FROM e1 UNION ALL SELECT target, 0, 1 FROM e1), s AS (SELECT id, sum(o) AS o, sum(i) AS i FROM ends GROUP BY id)
SELECT n1.id, CAST(coalesce(o, 0) AS BIGINT) AS n_out, CAST(coalesce(i, 0) AS BIGINT) AS n_in, CAST(coalesce(o + i, 0) AS BIGINT) AS degree FROM n1 LEFT JOIN s USING (id)""")
def graph_degrees(spark, sf):
    return graph.degrees(_nodes(spark, sf, 1), _edges(spark, sf, 1))


def _ranks_sql(rounds: int) -> str:
    """The power iteration written out, a stage a round."""
    out = f"WITH {_G}, k AS (SELECT source, count(*) AS k FROM e1 GROUP BY source), c AS (SELECT count(*)::DOUBLE AS n FROM n1), p0 AS (SELECT id, 1 / c.n AS r FROM n1, c)"
    for i in range(rounds):
        out += f", p{i + 1} AS MATERIALIZED (SELECT n1.id, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM p{i} WHERE id NOT IN (SELECT source FROM k))) / c.n + 0.85::DOUBLE * coalesce(g.got, 0) AS r FROM n1 CROSS JOIN c LEFT JOIN (SELECT target, sum(r / k) AS got FROM e1 JOIN k USING (source) JOIN p{i} ON p{i}.id = e1.source GROUP BY target) g ON g.target = n1.id)"
    return out + f" SELECT id, round(r, 9) AS rank FROM p{rounds}"


@query(_ranks_sql(30))
def graph_pagerank(spark, sf):
    return graph.pagerank(_nodes(spark, sf, 1), _edges(spark, sf, 1), rounds=30).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_G}, held AS (SELECT source, target, edge_idx FROM e1 WHERE relation LIKE '%part of%'),
down AS (SELECT id, 0 AS level FROM n1 WHERE id NOT IN (SELECT target FROM held) UNION ALL SELECT held.target, down.level + 1 FROM down JOIN held ON held.source = down.id WHERE down.level < 8)
SELECT d.id, CAST(min(d.level) AS INT) AS level, (SELECT arg_min(h.source, h.edge_idx) FROM held h WHERE h.target = d.id) AS parent FROM down d GROUP BY d.id""")
def hierarchy_levels(spark, sf):
    return graph.levels(_nodes(spark, sf, 1), _edges(spark, sf, 1))


@query(f"""WITH RECURSIVE {_G}, r AS (SELECT source AS root, target AS id FROM e1 UNION SELECT r.root, e1.target FROM r JOIN e1 ON e1.source = r.id) SELECT root, id FROM r""")
def graph_descendants(spark, sf):
    return graph.descendants(_edges(spark, sf, 1))


@query("""SELECT conv_id || ':' || min(turn) AS head, string_agg(conv_id || ':' || turn, '>' ORDER BY turn) AS steps FROM conversations GROUP BY conv_id HAVING count(*) >= 3""")
def flow_chains(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("target"))
    edges = turns.withColumnRenamed("id", "source").join(later, ["conv_id", "turn"]).select("source", "target", F.lit("then").alias("relation"), F.col("turn").alias("edge_idx"))
    return graph.chains(edges).select("head", F.array_join("steps", ">").alias("steps"))


@query(f"""WITH {_G}, d AS (SELECT id, count(*)::DOUBLE AS score FROM (SELECT source AS id FROM e1 UNION ALL SELECT target FROM e1) GROUP BY id),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM d QUALIFY place <= 50),
c AS (SELECT *, sum(score) OVER (ORDER BY place) AS s, (SELECT sum(score) FROM d) AS total FROM b) SELECT id, score, CAST(place AS INT) AS place FROM c WHERE place <= 3 OR s <= 0.4 * total""")
def salient_nodes(spark, sf):
    scores = graph.degrees(_nodes(spark, sf, 1), _edges(spark, sf, 1)).where("degree > 0").select("id", F.col("degree").cast("double").alias("score"))
    return graph.salient(scores, 50, mass=0.4)


@query(f"""WITH {_G}, d AS (SELECT id, count(*)::DOUBLE AS score FROM (SELECT source AS id FROM e1 UNION ALL SELECT target FROM e1) GROUP BY id QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 40),
e AS (SELECT DISTINCT source, target, x.score AS s, y.score AS t FROM e1 JOIN d x ON x.id = source JOIN d y ON y.id = target)
SELECT p.source AS a, p.target AS b, q.target AS c, p.s + q.s + q.t AS weight FROM e p JOIN e q ON p.target = q.source WHERE p.source <> q.target ORDER BY weight DESC, a, b, c LIMIT 8""")
def two_hop_paths(spark, sf):
    scores = graph.degrees(_nodes(spark, sf, 1), _edges(spark, sf, 1)).select("id", F.col("degree").cast("double").alias("score"))
    return graph.two_hop_paths(_edges(spark, sf, 1), scores, among=40)


@query(f"WITH {_G} SELECT a.label || ' ' || relation || ' ' || b.label AS text FROM e1 JOIN n1 a ON a.id = source JOIN n1 b ON b.id = target")
def graph_sentences(spark, sf):
    return graphs.triples_text(_edges(spark, sf, 1), _nodes(spark, sf, 1))


@query("SELECT user_id AS source, event_type AS target, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_edge(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("target"), F.col("event_id").alias("edge_idx"), F.col("value").alias("relation"))
    return graph.latest_edges(e).select("source", "target", F.col("relation").alias("value"), F.col("edge_idx").alias("event_id"))


# -- texts ----------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS line FROM documents)
SELECT line, count(*) AS n_docs FROM l WHERE length(line) > 4 GROUP BY line HAVING count(*) >= greatest(2, floor(0.002 * (SELECT count(*) FROM documents)))""")
def repeated_lines(spark, sf):
    return dedup.repeated_lines(_t(spark, sf, "documents"), share=0.002)


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lower(text)")
def first_of_equal_texts(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "source", F.sha2(F.lower("text"), 256).alias("k"))
    return dedup.first_of_each(docs, F.col("k"), ["doc_id"]).drop("k")


@query()
def greedy_points(spark, sf):
    return dedup.greedy(_points(spark, sf), "grp", "turn").select("grp", "turn")


@query(rf"""WITH p AS (SELECT conv_id || ':' || role AS grp, turn, text, {_TOK.format(t="text")} AS w FROM conversations),
s AS (SELECT grp, turn, text, CASE WHEN len(w) > 0 THEN 0.7::DOUBLE * len(list_distinct(w)) / len(w) + 0.3::DOUBLE * least(len(w) / 20.0::DOUBLE, 1) ELSE 0 END AS score FROM p)
SELECT grp, turn, text, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, turn) = 1""")
def canonical_points(spark, sf):
    return ranking.canonical_choice(_points(spark, sf).select("grp", "turn", "text"), "grp", "turn").withColumn("score", F.round("score", 9))


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w WHERE length(word) > 4 GROUP BY ALL)
SELECT source, word, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INT) AS place FROM c QUALIFY place <= 3""")
def frequent_words(spark, sf):
    return ranking.frequent_words(_t(spark, sf, "documents"), "source")


@query(rf"""WITH c AS (SELECT k, word, count(*) AS tf FROM (SELECT conv_id * 1000 + turn AS k, unnest({_TOK.format(t="text")}) AS word FROM conversations) GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM c GROUP BY word), x AS (SELECT k, word, tf * (ln((1 + (SELECT count(*) FROM conversations))::DOUBLE / (1 + df)) + 1) AS x FROM c JOIN d USING (word)), s AS (SELECT k, sqrt(sum(x * x)) AS s FROM x GROUP BY k)
SELECT k, word, round(x / s, 6) AS weight FROM x JOIN s USING (k)""")
def tfidf_weights(spark, sf):
    docs = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return ranking.tfidf(docs, "k").withColumn("weight", F.round("weight", 6))


@query(rf"""WITH s AS (SELECT doc_id, unnest(u) AS sentence, generate_subscripts(u, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(string_split_regex(s, '\s+')) >= 3) AS u FROM documents)),
b AS (SELECT *, len({_TOK.format(t="sentence")}) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3)
SELECT doc_id, CAST(pos AS INT) AS pos, sentence, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS place FROM b""")
def top_sentences(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return ranking.top_then_in_order(rows.withColumn("score", F.size(T.tokens(F.col("sentence")))), "doc_id", "score", "pos", 3)


@query(rf"""WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS t FROM documents),
a AS (SELECT doc_id, t, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::DOUBLE / length(t) ELSE 0 END AS share, len({_TOK.format(t="t")}) AS n FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(t) >= 5 AND share >= 0.55 AND (n >= 3 OR contains(t, ':')) AND NOT regexp_matches(t, '(?s)^.{{0,39}}?(?:{_GARBAGE})')) AS n_clean, count(*) FILTER (length(t) < 3 OR NOT regexp_matches(t, '[\p{{L}}\p{{N}}]')) AS n_symbols FROM a GROUP BY doc_id""")
def line_quality(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(Q.is_clean(F.col("t")).cast("long")).alias("n_clean"), F.sum(Q.is_symbols_only(F.col("t")).cast("long")).alias("n_symbols"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT doc_id, regexp_replace(regexp_replace(t, ' +([.,;:!?])', '\1', 'g'), '\.{2,}', '.', 'g') AS t FROM c),
u AS (SELECT doc_id, rtrim(upper(t[1]) || t[2:], ' ') AS t FROM p) SELECT doc_id, sha256(CASE WHEN t = '' OR regexp_matches(t, '[.!?:]$') THEN t ELSE t || '.' END) AS digest FROM u""")
def polished_texts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(T.polished(F.col("text")), 256).alias("digest"))


@query()
def rewritten_texts(spark, sf):
    t = F.col("text")
    return _points(spark, sf).select("grp", "turn", T.number_words(T.expand_contractions(t)).alias("plain"), T.heading_question_marks(t).alias("heading"), T.first_words(t, 25).alias("short"), Q.informative_score(t).alias("score"), Q.is_fragment(t).alias("fragment"), ranking.role(t).alias("section"))


_TRIGRAMS = "CASE WHEN length({0}) < 3 THEN [lower({0})] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3))) END"


@query(f"""WITH n AS (SELECT DISTINCT p_type AS name, {_TRIGRAMS.format("p_type")} AS a FROM part), p AS (SELECT p_partkey, {_TRIGRAMS.format("p_name")} AS b FROM part)
SELECT name, p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS likeness FROM n JOIN p ON len(list_intersect(a, b)) > 0""")
def label_likeness(spark, sf):
    """The few types of parts, the queries, against the names of all parts that share a trigram with one."""
    names = _t(spark, sf, "part").select(F.col("p_type").alias("name")).distinct().withColumn("a", S.trigrams(F.lower("name")))
    parts = _t(spark, sf, "part").select("p_partkey", S.trigrams(F.lower("p_name")).alias("b"))
    pairs = names.select("name", F.explode("a").alias("x")).join(parts.select("p_partkey", F.explode("b").alias("x")), "x").select("name", "p_partkey").distinct()
    return pairs.join(names, "name").join(parts, "p_partkey").select("name", "p_partkey", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("likeness"))


# -- statistics, upserts, streams -------------------------------------------------------------------------------------------


def _scores(spark, sf) -> DataFrame:
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    means = rows.groupBy("lang", "source").agg(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("a"), F.avg(F.when(F.col("quality") == 0, F.col("n_chars"))).alias("b"))
    return means


@query("""WITH m AS (SELECT lang, source, avg(n_chars) FILTER (quality = 1) AS a, avg(n_chars) FILTER (quality = 0) AS b FROM documents JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT lang, count(*) AS n_pairs, round(avg(a), 3) AS mean_a, round(avg(b), 3) AS mean_b, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM p GROUP BY lang HAVING count(*) >= 2""")
def paired_means(spark, sf):
    p = _scores(spark, sf).where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    out = p.groupBy("lang").agg(F.count("*").alias("n_pairs"), F.avg("a").alias("a"), F.avg("b").alias("b"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t")).where("n_pairs >= 2")
    return out.select("lang", "n_pairs", F.round("a", 3).alias("mean_a"), F.round("b", 3).alias("mean_b"), F.round("t", 6).alias("t"))


@query()
def paired_tests(spark, sf):
    return statistics.paired_tests(_scores(spark, sf), "lang", "a", "b")


@query("SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upserted_events(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return graphs.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), F.struct("user_id", "event_type"), "event_id")


@query("""WITH p AS (SELECT conv_id, role, turn, text, min(turn) OVER (PARTITION BY conv_id, role) AS sub, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sub, turn) AS j FROM p)
SELECT conv_id AS notes_id, sha256(string_agg(CASE WHEN j = 1 THEN '## Talk ' || conv_id || chr(10) ELSE '' END || CASE WHEN k = 1 THEN '### ' || role || chr(10) ELSE '' END || '- ' || text, chr(10) ORDER BY sub, turn)) AS digest FROM l GROUP BY conv_id""")
def notes_markdown(spark, sf):
    rows = _points(spark, sf)
    first = rows.groupBy("conv_id", "role").agg(F.min("turn").alias("sub_pos"))
    points = rows.join(first, ["conv_id", "role"]).select(F.col("conv_id").alias("notes_id"), F.lit(0).alias("sec_pos"), F.concat_ws(" ", F.lit("Talk"), "conv_id").alias("sec_heading"), "sub_pos", F.col("role").alias("sub_heading"), F.col("turn").alias("pt_pos"), "text")
    return graphs.notes_lines(points).select("notes_id", F.sha2("text", 256).alias("digest"))


@query()
def stable_frames(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("signal"), (F.col("event_type") != "error").alias("sharp"))
    return slides.stable_frames(e, tolerance=15.0)


def _frames(spark, sf) -> DataFrame:
    """Events as frames of their users; what is written on them is their type and rounded value."""
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("signal"), (F.col("event_type") != "error").alias("sharp"), F.concat_ws(":", "event_type", F.round("value").cast("string")).alias("text"))


@query()
def slide_timeline(spark, sf):
    return timeline.timeline(_frames(spark, sf), timeline.Rules(gap=60.0, stable=2, tolerance=25.0, idle=86400.0))


@query("SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang")
def source_profile(spark, sf):
    return _t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# -- notes ----------------------------------------------------------------------------------------------------------------


def _notes(spark, sf) -> DataFrame:
    """Each conversation is one section of the notes of its hundred, a role a subsection, a turn a point."""
    rows = _t(spark, sf, "conversations")
    first = rows.groupBy("conv_id", "role").agg(F.min("turn").alias("sub_pos"))
    return rows.join(first, ["conv_id", "role"]).select(
        F.expr("conv_id div 100").alias("notes_id"), F.lit("Talks").alias("title"), F.col("conv_id").alias("sec_pos"), F.concat_ws(" ", F.element_at(F.array(F.lit("Example"), F.lit("Parser"), F.lit("Other")), (F.col("conv_id") % 3 + 1).cast("int")), "conv_id").alias("sec_heading"), "sub_pos", F.col("role").alias("sub_heading"), F.col("turn").alias("pt_pos"), "text"
    )


_NOTES = """p AS (SELECT conv_id // 100 AS notes_id, conv_id AS sec_pos, CASE conv_id % 3 WHEN 0 THEN 'Example ' WHEN 1 THEN 'Parser ' ELSE 'Other ' END || conv_id AS sec_heading, CASE conv_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 9 END AS w, min(turn) OVER (PARTITION BY conv_id, role) AS sub_pos, role AS sub_heading, turn AS pt_pos, text FROM conversations)"""


@query(f"WITH {_NOTES} SELECT notes_id, sec_heading, CAST(dense_rank() OVER (PARTITION BY notes_id ORDER BY w, sec_pos) - 1 AS INT) AS sec_pos, pt_pos FROM p")
def notes_in_teaching_order(spark, sf):
    from plumbago.operators import notes

    return notes.in_teaching_order(_notes(spark, sf)).select("notes_id", "sec_heading", "sec_pos", "pt_pos")


@query(rf"""WITH {_NOTES}, d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY notes_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) ORDER BY sec_pos, sub_pos, pt_pos) = 1)
SELECT notes_id, sec_heading, sub_heading, count(*) AS n FROM d GROUP BY ALL""")
def notes_distinct_points(spark, sf):
    from plumbago.operators import notes

    return notes.distinct_points(_notes(spark, sf)).groupBy("notes_id", "sec_heading", "sub_heading").agg(F.count("*").alias("n"))


@query(f"""WITH {_NOTES}, c AS (SELECT *, count(*) OVER (PARTITION BY notes_id, sec_pos, sub_pos) AS n FROM p)
SELECT notes_id, CASE WHEN n >= 4 THEN sub_heading ELSE sec_heading END AS sec_heading, CASE WHEN n >= 4 THEN 'Overview' ELSE sub_heading END AS sub_heading, count(*) AS n_points FROM c GROUP BY ALL""")
def notes_promoted(spark, sf):
    from plumbago.operators import notes

    return notes.promoted(_notes(spark, sf)).groupBy("notes_id", "sec_heading", "sub_heading").agg(F.count("*").alias("n_points"))


@query()
def notes_improved(spark, sf):
    from plumbago.operators import notes

    return notes.improve(_notes(spark, sf))


@query()
def notes_nested(spark, sf):
    from plumbago.operators import notes

    return notes.nested(_notes(spark, sf)).select("notes_id", F.sha2(F.to_json("sections"), 256).alias("digest"))


@query(r"""WITH s AS (SELECT doc_id, len(string_split_regex(unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(string_split_regex(s, '\s+')) >= 3)), '\s+')) AS n FROM documents)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_sentences FROM s GROUP BY doc_id""")
def summary_chunks(spark, sf):
    from plumbago.operators import notes

    chunks = notes.chunked(_t(spark, sf, "documents"), 120)
    per = chunks.select("doc_id", F.size(F.split("text", r"\s+")).alias("w"), F.size(F.split("text", r"\.\s+")).alias("s"))
    return per.groupBy("doc_id").agg(F.sum("w").alias("n_words"), F.sum("s").alias("n_sentences"))


# -- concepts -------------------------------------------------------------------------------------------------------------


@query()
def concept_types(spark, sf):
    from plumbago.operators import concepts

    return concepts.node_types(_nodes(spark, sf, 1), _edges(spark, sf, 1))


@query()
def concept_centrality(spark, sf):
    from plumbago.operators import concepts

    nodes, edges = _nodes(spark, sf, 1), _edges(spark, sf, 1)
    return concepts.centrality(nodes, edges, "asia " * 12 + "united kingdom and europe are places in this text", rounds=30).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {_G}, s AS (SELECT source, min(a.label) AS s, CASE relation WHEN 'is part of' THEN 'is part of' ELSE relation END AS v, list(b.label ORDER BY edge_idx) AS o FROM e2 JOIN n2 a ON a.id = source JOIN n2 b ON b.id = target GROUP BY source, relation),
n AS (SELECT source, s, v || ' ' || o[1] AS c FROM s) SELECT source, s || ' ' || replace(c, 'part of ', 'is part of ') || '.' AS sentence FROM n ORDER BY source LIMIT 30""")
def concept_sentences(spark, sf):
    from plumbago.operators import concepts

    return concepts.sentences_of(_nodes(spark, sf, 2), _edges(spark, sf, 2))


@query("""WITH h AS (SELECT substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS label, min(doc_id) AS id FROM documents GROUP BY 1), w AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains(['a', 'an', 'the', 'of', 'in', 'for', 'to', 'and', 'or', 'is', 'are', 'was', 'were', 'its', 'this', 'that', 'by', 'as', 'from', 'with'], x))) AS w FROM h)
SELECT a.id AS first, b.id AS later FROM w a JOIN w b ON a.id < b.id WHERE len(a.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.72""")
def like_labels(spark, sf):
    """The beginnings of all documents, one for those that are equal: pairs between representatives."""
    from plumbago.operators import concepts

    label = F.substring(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)), 1, 80)
    heads = _t(spark, sf, "documents").groupBy(label.alias("label")).agg(F.min("doc_id").alias("id"))
    return concepts.same_labels(heads.select("id", F.col("id").alias("pos"), "label"))


from plumbago.plans import likeness, rules, structure, texts  # noqa: E402, F401  (they register their queries)
