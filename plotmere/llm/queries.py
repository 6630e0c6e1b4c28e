"""The queries of this package: each takes (spark, sf_dir) and applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plotmere.llm import chat_format, collocations, decontaminate, language_id, license_scan, ngram_lm, phrase_fingerprint, piece_bpe, simhash_dedup, source_divergence, substring_dedup, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_held_out(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.cluster(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, templates=license_scan.NEIGHBOURS, best=True, sentences=True).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_held_out(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.round_trip(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_simhash_dedup, op3_license_scan, op4_toxicity, op5_document_fingerprints, op6_token_ids, op7_sentencepiece, op8_benchmark_decontamination, op9_substring_dedup, op10_language_id, op11_source_divergence, op12_collocations, op13_chat_format)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, places.n, item_id FROM places JOIN windows USING (win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT r, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
  SELECT win FROM places GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM places WHERE win IN (SELECT win FROM again)
), lost AS (
  SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r
), left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN left_over USING (r)
"""



def _op3(templates: list[tuple[str, str]] = license_scan.NEIGHBOURS, threshold: float = license_scan.THRESHOLD) -> str:
    """Every unit against every template, without the bounds and keys that prune. chr(1), a space anyway, stands between sentences."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    other, white = license_scan.OTHER, "[ \\t\\n\\x0B\\f\\r]"
    pairs = "unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    sentences = f"string_split(regexp_replace(regexp_replace(replace(t, chr(1), ' '), '([.!?]){white}+', '\\1' || chr(1), 'g'), '\\n{white}*\\n', chr(1), 'g'), chr(1))"
    plain = lambda u: f"regexp_replace({u}, '{other}', ' ', 'g')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), u AS (
  SELECT DISTINCT r, lower(trim(regexp_replace(replace({plain("u")}, chr(10), ' '), ' +', ' ', 'g'))) AS u
  FROM (SELECT r, unnest(string_split(t, chr(10)) || regexp_split_to_array({plain("t")}, '\\n *\\n') || [t] || {sentences}) AS u FROM d)
), ub AS (
  SELECT r, u, g, count(*) AS c FROM (SELECT r, u, {pairs} AS g FROM (SELECT r, u, string_split(u, ' ') AS w FROM u)) GROUP BY r, u, g
), sizes AS (
  SELECT r, u, sum(c) AS n FROM ub GROUP BY r, u
), t AS (
  SELECT k, name, g, count(*) AS c
  FROM (SELECT k, name, {pairs} AS g FROM (SELECT k, name, string_split(lower(trim(regexp_replace(text, '{other}', ' ', 'g'))), ' ') AS w FROM (VALUES {rows}) v(k, name, text)))
  GROUP BY k, name, g
), m AS (
  SELECT k, sum(c) AS m FROM t GROUP BY k
), every AS (
  SELECT r, u, name, 2.0 * c / (n + m) AS dice
  FROM (SELECT r, u, k, name, sum(least(ub.c, t.c)) AS c FROM ub JOIN t USING (g) GROUP BY r, u, k, name) JOIN sizes USING (r, u) JOIN m USING (k)
  WHERE 2.0 * c / (n + m) >= {threshold}
), best_of AS (
  SELECT * FROM every QUALIFY dice = max(dice) OVER (PARTITION BY r, u)
), hits AS (
  SELECT r, u, dice, CASE WHEN name = '{license_scan.BSD}' AND r IN (SELECT r FROM best_of WHERE name = 'BSD-3-Clause') THEN 'BSD-3-Clause' ELSE name END AS name FROM best_of
), best AS (
  SELECT r, max(dice) AS score FROM hits GROUP BY r
), lists AS (
  SELECT r, count(DISTINCT u) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hits GROUP BY r
), names AS (
  SELECT r, min(name) AS license FROM hits JOIN best USING (r) WHERE dice = score GROUP BY r
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses, license, CAST(score AS DOUBLE) AS score
FROM d LEFT JOIN lists USING (r) LEFT JOIN names USING (r) LEFT JOIN best USING (r)
"""


_OP11 = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), o AS (
  SELECT lang, source, r, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS all_c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v, sum(all_c) AS all_n FROM kept GROUP BY lang
), n AS (
  SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p,
    1 + (1000000000::HUGEINT * (all_c + 1)) // (all_n + v) AS q
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), found AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, j, l.a AS l, r.a AS r, n, (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN n ON n.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k) GROUP BY ALL
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

_OP13 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(text)) AS i,
    length(text) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|<role>|</role>')) AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 3 + 4 ELSE 6 + 7 + length(role) + 1 END + 3) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLE_SQL: dict[str, str] = {"op13_chat_format": _OP13, "op12_collocations": _OP12, "op11_source_divergence": _OP11, "op3_license_scan": _op3(), "op8_benchmark_decontamination": _OP8, "op9_substring_dedup": _OP9}
