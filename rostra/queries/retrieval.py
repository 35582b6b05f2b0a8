"""Keyword, vector and hybrid retrieval, reranking, evaluation, text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators import chunk, evaluate, index, report, retrieve, verify
from rostra.plans.size import if_small
from rostra.queries.registry import query, read

_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 1 OR t BETWEEN '0' AND '9')"
_CTE = f"""
     c AS (SELECT doc_id AS chunk_id, {_TOKENS.format("coalesce(text, '')")} AS terms FROM documents),
     s AS (SELECT count(*)::DOUBLE AS n, avg(len(terms))::DOUBLE AS a FROM c),
     p AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM c) GROUP BY ALL),
     d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
     q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format("coalesce(text, '')")}) AS term FROM benchmark),
     w AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
           FROM q JOIN d USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY ALL)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the source as speaker, the language as section, a made-up sitting day."""
    day = (F.lit(20240101) + F.col("doc_id") % 28).cast("int")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("speaker_id"), F.col("lang").alias("section"), day.alias("sitting_day"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_CTE} SELECT * FROM (SELECT query_id, chunk_id, score, {_RANK}::INTEGER AS rank FROM w) WHERE rank <= 8")
def bm25_topk(spark, sf_dir):
    return retrieve.bm25(_questions(spark, sf_dir), _chunks(spark, sf_dir), retrieve.TOP)


_FILTER = "lang = 'en' AND source IN ('src1', 'src2', 'src3') AND doc_id % 28 BETWEEN 4 AND 20"


@query(
    f"WITH {_CTE}, f AS (SELECT doc_id AS chunk_id FROM documents WHERE {_FILTER}) "
    f"SELECT * FROM (SELECT query_id, chunk_id, score, {_RANK}::INTEGER AS rank FROM w SEMI JOIN f USING (chunk_id)) WHERE rank <= 8"
)
def bm25_filtered_topk(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    filters = retrieve.Filters("2024-01-05", "2024-01-21", speaker_ids=("src1", "src2", "src3"), section="en")
    return retrieve.bm25(_questions(spark, sf_dir), chunks, retrieve.TOP, allowed=filters.apply(chunks))


@query(f"WITH {_CTE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_stats(spark, sf_dir):
    return index.term_stats(index.postings(_chunks(spark, sf_dir), "chunk_id"))


@query(f"WITH {_CTE} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avg_len FROM c")
def chunk_length(spark, sf_dir):
    own = index.with_tokens(_chunks(spark, sf_dir), "chunk_id")
    return own.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avg_len"))


@query()
def sparse_vectors(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return index.sparse_vectors(chunks, "chunk_id", index.stats(chunks, "chunk_id").avg_len)


_DENSE = """
     k AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
     v AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e), 6) AS score FROM k a, k b WHERE {})"""


@query(f"WITH {_DENSE.format('a.vec_id % 100 = 0')} SELECT * FROM (SELECT *, {_RANK}::INTEGER AS rank FROM v) WHERE rank <= 8")
def dense_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieve.dense(asked, vectors, retrieve.TOP)


def _branches(spark, sf_dir, sparse=True, dense=True):
    """Both branches over the documents; question i's vector is the vector i."""
    questions = _questions(spark, sf_dir)
    out = []
    if dense:
        vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        asked = vectors.withColumnRenamed("chunk_id", "query_id").join(if_small(questions.select("query_id")), "query_id", "left_semi")
        out.append(retrieve.dense(asked, vectors, retrieve.CANDIDATES))
    if sparse:
        out.append(retrieve.bm25(questions, _chunks(spark, sf_dir), retrieve.CANDIDATES))
    return questions, out


_HYBRID = f"""{_CTE},{_DENSE.format("a.vec_id IN (SELECT item_id FROM benchmark)")},
     b AS (SELECT * FROM (SELECT query_id, chunk_id, {_RANK} AS rank FROM w) WHERE rank <= 40 UNION ALL SELECT * FROM (SELECT query_id, chunk_id, {_RANK} AS rank FROM v) WHERE rank <= 40),
     f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM b GROUP BY ALL),
     h AS (SELECT query_id, chunk_id, score, {_RANK}::INTEGER AS rank FROM f)"""


@query(f"WITH {_HYBRID} SELECT * FROM h WHERE rank <= 30")
def hybrid_rrf(spark, sf_dir):
    _, branches = _branches(spark, sf_dir)
    return retrieve.fuse(branches, retrieve.POOL)


def _reranked(spark, sf_dir, k):
    questions, branches = _branches(spark, sf_dir)
    return questions, retrieve.rerank(retrieve.fuse(branches, retrieve.POOL), questions, _chunks(spark, sf_dir), k)


_RERANK = f"""{_HYBRID},
     t AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS asked FROM benchmark),
     r AS (SELECT query_id, chunk_id, h.rank AS fused_rank, h.score AS retrieval_score, round(1 / (1 + exp(-(10.0 * len(list_intersect(asked, terms)) / nullif(len(asked), 0) - 5.0))), 6) AS score
           FROM h JOIN t USING (query_id) JOIN c USING (chunk_id) WHERE h.rank <= 30),
     z AS (SELECT query_id, chunk_id, retrieval_score, fused_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank)::INTEGER AS rank FROM r)"""


@query(f"WITH {_RERANK} SELECT * FROM z WHERE rank <= 8")
def rerank_topk(spark, sf_dir):
    return _reranked(spark, sf_dir, retrieve.TOP)[1]


@query(f"""WITH {_RERANK}, g AS (SELECT query_id, count(*) AS n_hits, max(score) AS best FROM z WHERE rank <= 8 GROUP BY 1)
SELECT item_id AS query_id, coalesce(n_hits, 0) AS n_hits, best, coalesce(n_hits, 0) = 0 OR coalesce(best < 0.6, false) AS not_found FROM benchmark LEFT JOIN g ON item_id = query_id""")
def not_found_gate(spark, sf_dir):
    questions, hits = _reranked(spark, sf_dir, retrieve.TOP)
    return retrieve.gate(questions, hits, least=0.6)


@query(f"""WITH {_DENSE.format("a.vec_id IN (SELECT item_id FROM benchmark)")},
     o AS (SELECT query_id, chunk_id, score, {_RANK}::INTEGER AS rank FROM v) SELECT * FROM o WHERE rank <= 30""")
def single_branch(spark, sf_dir):
    _, branches = _branches(spark, sf_dir, sparse=False)
    return retrieve.fuse(branches, retrieve.POOL)


# --- evaluation ----------------------------------------------------------------------------------------------------

_RELEVANT = "rel AS (SELECT item_id AS query_id, doc_id AS turn_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = """
     e AS (SELECT query_id, count(*) AS k, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT query_id, chunk_id AS turn_id, rank FROM ranked) JOIN rel USING (query_id, turn_id) GROUP BY 1),
     n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
     m AS (SELECT item_id AS query_id, coalesce(n_relevant, 0) AS n_relevant, CASE WHEN n_relevant > 0 THEN coalesce(k, 0) / n_relevant END AS recall, coalesce(1 / first, 0.0) AS mrr,
                  CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 8)::INTEGER + 1), lambda i: 1 / log2(i + 1))) END AS ndcg
           FROM benchmark LEFT JOIN n ON item_id = n.query_id LEFT JOIN e ON item_id = e.query_id)"""


def _relevant(spark, sf_dir):
    """Documents that hold a question's passage verbatim.

    A passage's tokens but the first and last must be tokens of the document; only documents with the rarest of them are compared. Passages
    without such a token are compared with all documents.
    """
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("turn_id"), "text")
    raw = T.words(F.col("passage"))
    inner = F.filter(F.slice(raw, 2, F.greatest(F.size(raw) - 2, F.lit(0))), lambda t: F.length(t) > 1)
    terms = passages.select("query_id", F.explode(F.array_distinct(inner)).alias("term"))
    _, counts = index.frequencies(docs, "turn_id", terms.select("term").distinct())
    rarest = if_small(terms.join(counts, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term")))
    pairs = index.postings(docs, "turn_id").join(rarest, "term").select("query_id", "turn_id")
    holding = pairs.join(docs, "turn_id").join(if_small(passages), "query_id").where(F.contains("text", "passage")).select("query_id", "turn_id")
    bare = passages.join(terms.select("query_id").distinct(), "query_id", "left_anti")
    return holding.unionAll(docs.join(if_small(bare), F.contains("text", "passage")).select("query_id", "turn_id"))


def _rounded(df):
    return df.select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"WITH {_CTE}, ranked AS (SELECT * FROM (SELECT query_id, chunk_id, {_RANK} AS rank FROM w) WHERE rank <= 8), {_RELEVANT},{_METRICS} SELECT query_id, n_relevant, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def eval_metrics(spark, sf_dir):
    ranked = bm25_topk(spark, sf_dir).select("query_id", F.col("chunk_id").alias("turn_id"), "rank")
    return _rounded(evaluate.per_question(_questions(spark, sf_dir).select("query_id"), ranked, _relevant(spark, sf_dir), retrieve.TOP))


_MEANS = "count(*) AS n, round(avg(recall) FILTER (answerable), 6) AS recall, round(avg(mrr) FILTER (answerable), 6) AS mrr, round(avg(ndcg) FILTER (answerable), 6) AS ndcg, round(avg(not_found::INT) FILTER (NOT answerable), 6) AS refusal, round(avg(not_found::INT) FILTER (answerable), 6) AS false_refusal"


@query(f"""WITH {_RERANK}, ranked AS (SELECT * FROM z WHERE rank <= 8), {_RELEVANT},{_METRICS},
     g AS (SELECT query_id, max(score) < 0.9 AS not_found FROM ranked GROUP BY 1),
     x AS (SELECT m.*, coalesce(not_found, true) AS not_found, n_relevant > 0 AS answerable, CASE WHEN length(text) < 160 THEN 'short' ELSE 'long' END AS size FROM m LEFT JOIN g USING (query_id) JOIN benchmark ON item_id = m.query_id)
SELECT 'all' AS slice, 'all' AS value, {_MEANS} FROM x UNION ALL SELECT 'size', size, {_MEANS} FROM x GROUP BY size""")
def eval_slices(spark, sf_dir):
    questions, hits = _reranked(spark, sf_dir, retrieve.TOP)
    ranked = hits.select("query_id", F.col("chunk_id").alias("turn_id"), "rank")
    rows = evaluate.per_question(questions.select("query_id", F.when(F.length("text") < 160, "short").otherwise("long").alias("size")), ranked, _relevant(spark, sf_dir), retrieve.TOP)
    rows = rows.join(retrieve.gate(questions, hits, least=0.9).select("query_id", "not_found"), "query_id").withColumn("answerable", F.col("n_relevant") > 0)
    out = evaluate.summary(rows, ["size"])
    return out.select("slice", "value", "n", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "refusal", "false_refusal")])


@query(f"""WITH {_RERANK}, {_RELEVANT},
     a AS (SELECT 'dense' AS experiment, * FROM (SELECT query_id, chunk_id, {_RANK} AS rank FROM v) WHERE rank <= 8 UNION ALL SELECT 'sparse', * FROM (SELECT query_id, chunk_id, {_RANK} AS rank FROM w) WHERE rank <= 8
           UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM h WHERE rank <= 8 UNION ALL SELECT 'hybrid_rerank', query_id, chunk_id, rank FROM z WHERE rank <= 8),
     i AS (SELECT experiment, a.query_id AS query_id, min(rank) AS first FROM a JOIN rel ON a.query_id = rel.query_id AND chunk_id = turn_id GROUP BY ALL),
     u AS (SELECT DISTINCT experiment FROM a)
SELECT experiment, count(*) AS n, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM u CROSS JOIN (SELECT DISTINCT query_id FROM rel) k LEFT JOIN i USING (experiment, query_id) GROUP BY experiment""")
def experiment_matrix(spark, sf_dir):
    questions, (dense, sparse) = _branches(spark, sf_dir)
    pool = retrieve.fuse([dense, sparse], retrieve.POOL)
    runs = {"dense": dense, "sparse": sparse, "hybrid": pool, "hybrid_rerank": retrieve.rerank(pool, questions, _chunks(spark, sf_dir), retrieve.TOP)}
    relevant, out = _relevant(spark, sf_dir), None
    for name, hits in runs.items():
        ranked = hits.select("query_id", F.col("chunk_id").alias("turn_id"), "rank")
        rows = evaluate.per_question(questions.select("query_id"), ranked, relevant, retrieve.TOP).where("n_relevant > 0").select(F.lit(name).alias("experiment"), "mrr")
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("experiment").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("""WITH t AS (SELECT query_id, turn_id, min(rank) AS r FROM (SELECT vec_id % 7 AS query_id, label AS turn_id, vec_id AS rank FROM embeddings) GROUP BY ALL)
SELECT query_id, turn_id, row_number() OVER (PARTITION BY query_id ORDER BY r, turn_id)::INTEGER AS rank FROM t""")
def turn_dedupe(spark, sf_dir):
    hits = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("query_id"), F.col("label").alias("turn_id"), F.col("vec_id").alias("rank"))
    return retrieve.best_per_turn(hits)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = least(floor(n * 0.5), n - 1) + 1) AS p50, max(value) FILTER (k = least(floor(n * 0.95), n - 1) + 1) AS p95 FROM r GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return evaluate.nearest_rank(read(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


# --- chunks, languages, terms, prompts -----------------------------------------------------------------------------


@query()
def chunk_windows(spark, sf_dir):
    return chunk.windows(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, text, 0 AS part, 1 AS n_parts FROM documents WHERE length(text) BETWEEN 20 AND 2000")
def chunk_short(spark, sf_dir):
    return chunk.windows(read(spark, sf_dir, "documents").select("doc_id", "text")).where("n_parts = 1")


def _sql_count(text, words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: w IN ({listed})))"


_LANG = f"SELECT doc_id, lang, CASE WHEN ms + en < 3 THEN 'unknown' WHEN least(ms, en) / (ms + en) >= 0.25 THEN 'mixed' WHEN ms > en THEN 'ms' ELSE 'en' END AS tagged FROM (SELECT doc_id, lang, {_sql_count('text', T.STOP_MS)} AS ms, {_sql_count('text', T.STOP_EN)} AS en FROM documents)"


@query(_LANG)
def lang_tag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", T.language(F.col("text")).alias("tagged"))


@query(f"SELECT lang, tagged, count(*) AS n FROM ({_LANG}) GROUP BY ALL")
def lang_confusion(spark, sf_dir):
    return lang_tag(spark, sf_dir).groupBy("lang", "tagged").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, CASE WHEN ms > 0 AND en > 0 AND least(ms, en) / (ms + en) >= 0.4 THEN 'mixed' WHEN en > ms THEN 'en' ELSE 'ms' END AS asked FROM (SELECT conv_id, turn, {_sql_count('text', T.ASK_MS)} AS ms, {_sql_count('text', T.ASK_EN)} AS en FROM conversations WHERE role = 'user')")
def question_lang(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").where("role = 'user'")
    return own.select("conv_id", "turn", T.question_language(F.col("text")).alias("asked"))


_ASKED = ", ".join(f"'{w}'" for w in dict.fromkeys(T.ASK_MS + T.ASK_EN + T.ASK_OTHER))


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+'), 1) AS k FROM benchmark),
     t AS (SELECT item_id, trim(w, '''-') AS term, min(k) AS k FROM w GROUP BY ALL)
SELECT item_id, string_agg(term, ' ' ORDER BY k) AS terms FROM t WHERE length(term) >= 3 AND term NOT IN ({_ASKED}) GROUP BY 1""")
def highlight_terms(spark, sf_dir):
    own = read(spark, sf_dir, "benchmark")
    return own.select("item_id", F.array_join(T.highlight_terms(F.array("text")), " ").alias("terms")).where("terms <> ''")


@query()
def snippets(spark, sf_dir):
    """Where the best hit's snippet begins, with its terms marked."""
    best = bm25_topk(spark, sf_dir).where("rank = 1")
    asked = _questions(spark, sf_dir).select("query_id", T.highlight_terms(F.array("text")).alias("terms"))
    own = best.join(if_small(asked), "query_id").join(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    start = T.snippet_start(F.col("text"), F.col("terms"))
    return own.select("query_id", "chunk_id", start.alias("start"), T.highlight(F.substring("text", start + 1, F.lit(240)), F.col("terms")).alias("snippet"))


@query("SELECT count(*) AS turns, count(DISTINCT source) AS sittings FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def keyword_evidence(spark, sf_dir):
    return report.evidence(read(spark, sf_dir, "documents"), ["The", "and"], key="source")


_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS_MS)
_NOTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in verify.LANGUAGE_NOTE.items())


@query(f"""WITH s AS (SELECT doc_id // 3 AS query_id, doc_id % 3 + 1 AS rank, source, lang, text, make_date(2024, (doc_id % 12 + 1)::INTEGER, (doc_id % 28 + 1)::INTEGER) AS d, doc_id % 2 = 0 AS is_draft, doc_id FROM documents),
     b AS (SELECT query_id, rank, '[' || rank || '] ' || source || ' · ' || day(d) || ' ' || ([{_MONTHS}])[month(d)] || ' ' || year(d) || ' · ' || lang || ' · page ' || doc_id || CASE WHEN is_draft THEN ' · DRAFT (naskhah belum disemak)' ELSE '' END || chr(10)
             || CASE WHEN length(text) > 1400 THEN regexp_replace(left(text, 1400), ' [^ ]*$', '') || ' …' ELSE text END AS block FROM s),
     j AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS blocks FROM b GROUP BY 1),
     q AS (SELECT item_id AS query_id, text AS question, {_sql_count('text', T.ASK_MS)} AS ms, {_sql_count('text', T.ASK_EN)} AS en FROM benchmark)
SELECT query_id, 'Sources:' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10)
       || CASE CASE WHEN ms > 0 AND en > 0 AND least(ms, en) / (ms + en) >= 0.4 THEN 'mixed' WHEN en > ms THEN 'en' ELSE 'ms' END {_NOTES} END AS prompt FROM q JOIN j USING (query_id)""")
def prompt_blocks(spark, sf_dir):
    day = F.make_date(F.lit(2024), (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int"))
    hits = read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 3).alias("query_id"), (F.col("doc_id") % 3 + 1).alias("rank"), F.lit(False).alias("unattributed"), F.lit("label_name").alias("resolution"), F.col("source").alias("speaker_raw"),
        F.lit(None).cast("string").alias("section_heading"), F.col("lang").alias("section"), F.col("doc_id").cast("string").alias("page_label_start"), (F.col("doc_id") % 2 == 0).alias("is_draft"), day.alias("sitting_date"), "text",
    )
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return verify.prompts(hits, questions)


_ANSWERS = """(SELECT item_id, text, 'A "' || substr(text, 1, 60) || '" [1] and “' || substr(text, 5, 20) || ' ... ' || substr(text, 40, 20) || '” [3], "never said by anyone here" [2]' AS answer,
                      [text, 'other words'] AS sources FROM benchmark)"""


@query(rf"""WITH a AS {_ANSWERS}, q AS (SELECT item_id, sources, unnest(regexp_extract_all(answer, '["“”]([^"“”]{{3,600}})["“”]', 1)) AS q FROM a),
     p AS (SELECT item_id, q, sources, list_filter(list_transform(regexp_split_to_array(q, '\s*(?:\.\.\.|…)\s*'), lambda x: trim(trim(regexp_replace(x, '\s+', ' ', 'g')), ' .,')), lambda x: x <> '') AS parts FROM q
           WHERE len(string_split(trim(regexp_replace(q, '\s+', ' ', 'g')), ' ')) >= 4),
     u AS (SELECT item_id, q FROM p WHERE len(list_filter(parts, lambda x: len(list_filter(sources, lambda s: contains(trim(regexp_replace(s, '\s+', ' ', 'g')), x))) = 0)) > 0)
SELECT item_id, (SELECT count(*) FROM u WHERE u.item_id = a.item_id) AS n_unverified, '1,2' AS cited, '3' AS missing FROM a""")
def quote_check(spark, sf_dir):
    own = read(spark, sf_dir, "benchmark")
    answer = F.concat(F.lit('A "'), F.substring("text", 1, 60), F.lit('" [1] and “'), F.substring("text", 5, 20), F.lit(" ... "), F.substring("text", 40, 20), F.lit('” [3], "never said by anyone here" [2]'))
    checked = verify.check(own.select("item_id", answer.alias("answer"), F.array("text", F.lit("other words")).alias("sources")))
    return checked.select("item_id", F.size("unverified_quotes").cast("long").alias("n_unverified"), F.array_join("cited", ",").alias("cited"), F.array_join("missing_sources", ",").alias("missing"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS n FROM embeddings")
def hit_numbers(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("n"))
