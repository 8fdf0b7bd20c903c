"""Each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language, license_scan, ngram_join, phrases, pii, quality, rules, secret_scan, shard, suffix_dedup, token_align
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_table(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.digest(table(spark, sf_dir, "documents"), words=secret_scan.vocabulary(public_tokenizers.path("word_bpe_49k.json")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict:
    named = (
        op1_quality_classifier,
        op2_byte_bpe,
        op3_suffix_array_dedup,
        op4_license_scan,
        op5_pii,
        op6_quality_rules,
        op7_benchmark_decontamination,
        op8_sharding,
        op9_ngram_jaccard_join,
        op10_secret_scan,
        op11_tokenizer_alignment,
        op12_language_id,
        op13_phrase_mining,
        pipeline,
    )
    return {f.__name__: f for f in named}


#: op6 in SQL: the measures from their definitions, the host verdict from the fitted prior.
OP6 = r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(source), '^[a-z][a-z0-9+.-]*://', ''), '[/:?#][\s\S]*$', ''), '^www\.', '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 10 * word_chars, 100 * n_dup_lines > 30 * n_words, word_chars < 2 * n_words OR word_chars > 14 * n_words] AS bad FROM m),
h AS (SELECT host, rule, count(*)::DOUBLE AS n, count(*) FILTER (hit)::DOUBLE AS f FROM (SELECT host, unnest(range(6)) AS rule, unnest(list_append(bad, list_bool_or(bad))) AS hit FROM f) GROUP BY host, rule),
o AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS square, sum(n) AS n, count(*) AS k FROM h GROUP BY rule),
e AS (SELECT rule, mean, k, square - mean * mean - mean * (1 - mean) * k / n AS excess FROM o),
v AS (SELECT host, max(share) AS worst, max(share) FILTER (rule = 5) AS failing FROM (SELECT host, rule, CASE WHEN excess > 0 AND k > 1 THEN (f + mean * greatest(0.0::DOUBLE, mean * (1 - mean) / excess - 1)) / (n + greatest(0.0::DOUBLE, mean * (1 - mean) / excess - 1)) ELSE mean END AS share FROM h JOIN e USING (rule)) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed, NOT (bad[1] OR bad[2]) AND worst < 0.5 AS kept, round(failing, 6) AS host_failed_share, round(worst, 6) AS host_worst_share FROM f JOIN v ON v.host IS NOT DISTINCT FROM f.host
"""


#: op9 in SQL: all pairs that share a shingle, then reachability.
OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.c + ny.c - k)),
reach(d, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.d, l.y FROM reach JOIN l ON l.x = reach.r),
m AS (SELECT d AS doc_id, min(r) AS low FROM reach GROUP BY d),
k AS (SELECT x AS doc_id, count(*) AS met FROM l GROUP BY x)
SELECT doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id, CAST(coalesce(met, 0) AS BIGINT) AS n_links FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


#: op13 in SQL: every phrase counted in place, then cuts, longer phrases and ranks from their definitions.
OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
h AS (SELECT lang, g, max(a) AS held FROM (SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3] AS g, a FROM c WHERE k = 3) AS u GROUP BY lang, g),
u AS (SELECT c.lang, c.k, c.g, c.a, s.cut, c.g[1:s.cut] AS lg, c.g[s.cut + 1:c.k] AS rg FROM c JOIN (VALUES (1), (2)) AS s(cut) ON s.cut < c.k),
q AS (SELECT u.lang, u.k, u.g, u.a, u.cut, x.f AS l, y.f AS r, CAST((CAST(u.a AS HUGEINT) * u.a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.g = u.lg JOIN f y ON y.lang = u.lang AND y.g = u.rg),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS best FROM q),
t AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE best = 1 AND NOT (b.k = 2 AND coalesce(100 * held >= 50 * b.a, false))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6, "op9_ngram_jaccard_join": OP9, "op13_phrase_mining": OP13}
