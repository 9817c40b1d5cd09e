"""The registered queries opN_<name> and their oracle SQL; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_model import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import language_scores

    return language_scores(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import PASSAGE, remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), passage=PASSAGE).drop("kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import line_dedup

    rows = line_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_simhash, op4_toxicity, op5_pieces, op6_near_vectors, op7_main_text, op8_language_scores, op9_licenses, op10_suffix_dedup, op11_lexical_search, op12_line_dedup, op13_resampling)}

_OP2 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM pos) p JOIN win ON win.n = p.n AND win.s = p.s),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _op9() -> str:
    from .licenses import INSTEAD, TEMPLATES, THRESHOLD

    notices = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in row)) for i, row in enumerate(TEMPLATES))
    words = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH notice AS (SELECT template, license, {grams} AS g FROM (SELECT template, license, {words.format("notice")} AS w FROM (VALUES {notices}) AS t(template, license, notice)) WHERE len(w) > 1),
base AS (SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10)), list_filter(regexp_split_to_array(coalesce(text, ''), '\n(?:[^A-Za-z0-9\n]*\n)+'), lambda p: contains(p, chr(10)))) AS u FROM documents),
part AS (SELECT doc_id, list_concat(u, flatten(list_filter(list_transform(u, lambda p: string_split(regexp_replace(p, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))), lambda s: len(s) > 1))) AS u FROM base),
unit AS (SELECT doc_id, unit, {words.format("line")} AS w FROM (SELECT doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS unit FROM part)),
gram AS (SELECT doc_id, unit, {grams} AS g FROM unit WHERE len(w) > 1),
hit AS (SELECT doc_id, unit, template, license, 2.0::DOUBLE * len(list_intersect(gram.g, notice.g)) / (len(gram.g) + len(notice.g)) AS dice FROM gram JOIN notice
        ON len(gram.g) BETWEEN len(notice.g) * {THRESHOLD} / (2 - {THRESHOLD}) - 0.001 AND len(notice.g) * (2 - {THRESHOLD}) / {THRESHOLD} + 0.001),
best AS (SELECT * FROM hit WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) = 1),
named AS (SELECT *, license <> '{INSTEAD[1]}' OR NOT bool_or(license = '{INSTEAD[0]}') OVER (PARTITION BY doc_id) AS named FROM best),
doc AS (SELECT doc_id, first(license ORDER BY dice DESC, template) FILTER (named) AS license, max(dice) FILTER (named) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (named) AS licenses, count(*) AS n_units FROM named GROUP BY doc_id)
SELECT d.doc_id, doc.license, coalesce(doc.dice, 0.0) AS dice, coalesce(doc.licenses, '') AS licenses, coalesce(doc.n_units, 0) AS n_units FROM documents d LEFT JOIN doc USING (doc_id)
"""


_OP11 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM iw GROUP BY ALL),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM dw),
posting AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM posting, size GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM posting JOIN weight USING (term) JOIN wanted USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

_OP12 = r"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
"""

# CRC-32 by its table of 256 entries, which a recursion over the eight bits makes from the polynomial.
_OP13 = r"""
WITH RECURSIVE step(i, bit, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE bit < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE bit = 8),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM dw) GROUP BY ALL),
tf AS (SELECT f, count(*) AS n FROM iw GROUP BY f),
byte AS (SELECT f, list_concat([4294967295::BIGINT], list_transform(range(0, strlen(f)), lambda j: CAST((instr('0123456789ABCDEF', substr(hex(f), 2 * j + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(f), 2 * j + 2, 1)) - 1 AS BIGINT))) AS b
         FROM (SELECT f FROM df UNION SELECT f FROM tf)),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM byte, tab),
source AS (SELECT bucket, sum(n) AS s FROM df JOIN crc USING (f) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM tf JOIN crc USING (f) GROUP BY bucket),
size AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM source LEFT JOIN target USING (bucket), size),
weight AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM dw LEFT JOIN weight USING (doc_id)),
place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (10 * able) // 100 THEN rank END AS rank FROM scored LEFT JOIN place USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": _OP2, "op9_licenses": _op9(), "op11_lexical_search": _OP11, "op12_line_dedup": _OP12, "op13_resampling": _OP13}
