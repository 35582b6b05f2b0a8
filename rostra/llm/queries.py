"""The registered queries of this package: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import decontaminate, lines, pieces, quality, rans, simhash, substring, toxicity, transport, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out():
    return ~toxicity.learnable(F.col("doc_id"))


#: The rules that op6 judges by: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = transport.store(_read(spark, sf_dir, "documents"))
    return transport.digests(stored).select("doc_id", "n_bytes", "digest.*")


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    ranker = quality.train(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), ranker)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept", 256).alias("kept_sha256"))


def op4_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "digest.*")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_removed").cast("long").alias("n_removed"), "kept_sha256")


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted"))


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write_new(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rans.read(spark, path, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_transport_stream,
        op2_bradley_terry_quality,
        op3_line_suffix_array,
        op4_prefix_filter_decontamination,
        op5_sentencepiece_transducer,
        op6_url_rules,
        op7_suffix_trees,
        op8_ftrl_toxicity,
        op9_simhash_bk_trees,
        op10_rans_tokens,
    )
    return {f.__name__: f for f in every}


#: Repeated runs of every length, each one line longer than one of the length before.
_OP3_SQL = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS uid, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     p AS (SELECT uid, s, sha256(l[s]) AS h, length(l[s]) AS chars FROM (SELECT uid, l, unnest(generate_series(1, len(l))) AS s FROM d)),
     r AS (SELECT uid, s, 1 AS n, h, chars FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)
           UNION ALL
           SELECT uid, s, n, h, chars FROM (
               SELECT r.uid, r.s, r.n + 1 AS n, sha256(r.h || p.h) AS h, r.chars + 1 + p.chars AS chars, count(*) OVER (PARTITION BY r.h, p.h) AS c
               FROM r JOIN p ON p.uid = r.uid AND p.s = r.s + r.n) WHERE c > 1),
     f AS (SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY uid, s) AS k FROM r),
     c AS (SELECT uid, s, max(n) AS n FROM f WHERE k > 1 AND (n >= 4 OR chars >= 200) GROUP BY uid, s),
     g AS (SELECT DISTINCT uid, unnest(generate_series(s, s + n - 1)) AS s FROM c),
     i AS (SELECT uid, s, s - row_number() OVER (PARTITION BY uid ORDER BY s) AS run FROM g),
     a AS (SELECT uid, count(*) AS n_runs, max(size) AS longest FROM (SELECT uid, run, count(*) AS size FROM i GROUP BY uid, run) GROUP BY uid),
     b AS (SELECT uid, list(s) AS gone FROM g GROUP BY uid)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed, CAST(coalesce(n_runs, 0) AS INTEGER) AS n_runs,
       CAST(coalesce(longest, 0) AS INTEGER) AS longest_run,
       sha256(array_to_string(list_filter(l, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN a USING (uid) LEFT JOIN b USING (uid)
"""

_OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
     i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
     j AS (SELECT item, words, least(13, len(words)) AS n FROM i WHERE len(words) > 0),
     v AS (SELECT item, n, array_to_string(words[k:k + n - 1], ' ') AS w FROM (SELECT item, words, n, unnest(generate_series(1, len(words) - n + 1)) AS k FROM j)),
     z AS (SELECT DISTINCT n FROM v),
     o AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS w
           FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS k FROM d JOIN z ON len(words) >= n)),
     x AS (SELECT doc_id, item, n, k FROM o JOIN v USING (n, w)),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM x) GROUP BY doc_id),
     t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM x GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP6_SQL = """
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
     h AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
     r(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
                  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
     m AS (SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, verdict,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC NULLS LAST) AS k
           FROM h LEFT JOIN r ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

_OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
     p AS (SELECT doc_id, unnest(generate_series(1, len(words) - 34)) AS s, words FROM w WHERE len(words) >= 35),
     g AS (SELECT doc_id, s, sha256(array_to_string(words[s:s + 34], ' ')) AS h FROM p),
     d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS k FROM g JOIN d USING (h)),
     n AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_suffix_array": _OP3_SQL, "op4_prefix_filter_decontamination": _OP4_SQL, "op6_url_rules": _OP6_SQL, "op7_suffix_trees": _OP7_SQL}
