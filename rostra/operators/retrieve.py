"""Filtered keyword, vector and hybrid retrieval of the top chunks for a table of queries, reranking and the not-found gate.

Every function takes all queries at once. Filters hold before any rank is taken and never score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rostra.functions import text as T
from rostra.operators import index
from rostra.plans.size import held, if_small

CANDIDATES, POOL, TOP, RRF_K, LEAST = 40, 30, 8, 60, 0.02
#: Query vectors that are matched in one pass over the chunks.
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Filters:
    """What chunks must be like; None: anything. Dates are ISO strings, both ends included."""

    date_from: str | None = None
    date_to: str | None = None
    speaker_id: str | None = None
    speaker_ids: tuple[str, ...] = field(default=())
    section: str | None = None

    def condition(self) -> Column | None:
        """A conjunction over sitting_day (yyyymmdd), speaker_id and section, or None."""
        parts = []
        if self.date_from:
            parts.append(F.col("sitting_day") >= int(self.date_from.replace("-", "")))
        if self.date_to:
            parts.append(F.col("sitting_day") <= int(self.date_to.replace("-", "")))
        if self.speaker_id:
            parts.append(F.col("speaker_id") == self.speaker_id)
        if self.speaker_ids:
            parts.append(F.col("speaker_id").isin(*self.speaker_ids))
        if self.section:
            parts.append(F.col("section") == self.section)
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def apply(self, chunks: DataFrame) -> DataFrame:
        condition = self.condition()
        return chunks if condition is None else chunks.where(condition)


def top(df: DataFrame, by: str, score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each ``by``, ranked from 1 by falling score (to six digits), then key."""
    own = df.withColumn(score, F.round(score, 6))
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return own.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25(queries: DataFrame, chunks: DataFrame | index.Index, k: int, qkey: str = "query_id", key: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """(qkey, key, score, rank): queries (qkey, text) against chunks (key, text) or a stored index of them, which spares both passes over their texts.

    The corpus statistics are those of all chunks; only ``allowed`` chunks (column key) are ranked. A query without tokens has no rows.
    """
    asked = queries.select(qkey, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    ids = None if allowed is None else allowed.select(key).distinct()
    if isinstance(chunks, index.Index):
        posted = chunks.of(if_small(terms))
        corpus, known = chunks.stats, held(posted.groupBy("term").agg(F.count("*").alias("df")))
        ranked = posted if ids is None else posted.join(ids, key, "left_semi")
    else:
        corpus, known = index.frequencies(chunks, key, terms)
        # What isn't allowed is left out before its text is taken apart.
        ranked = index.postings(chunks if ids is None else chunks.select(key, "text").join(ids, key, "left_semi"), key, terms=if_small(terms))
    weighed = asked.join(known, "term").select(qkey, "term", index.idf(corpus.n, F.col("df")).alias("idf"))
    scored = ranked.join(if_small(weighed), "term").groupBy(qkey, key).agg(F.sum(F.col("idf") * index.weight(F.col("tf"), F.col("dl"), corpus.avg_len)).alias("score"))
    return top(scored, qkey, "score", key, k)


def dense(queries: DataFrame, chunks: DataFrame, k: int, qkey: str = "query_id", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(qkey, key, score, rank) by inner product (cosine, for unit vectors), exact.

    Queries are broadcast as a matrix in blocks of QUERY_BLOCK; each Arrow batch of chunks keeps its own k best for each
    query, so what is shuffled is k rows a query and batch, not a row a pair.
    """
    spark, kinds = chunks.sparkSession, (queries.schema[qkey].dataType, chunks.schema[key].dataType)
    result = f"{qkey} {kinds[0].simpleString()}, {key} {kinds[1].simpleString()}, score double"
    arrow_kinds = tuple(map(to_arrow_type, kinds))
    out = None
    rows = queries.select(qkey, vector).where(F.col(vector).isNotNull()).orderBy(qkey)
    held: list = []

    def block(part: list) -> DataFrame:
        ids, matrix = [r[0] for r in part], np.array([r[1] for r in part], np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(np.argsort(keys, kind="stable"), kind="stable")  # of any type, for ties
                own = np.array(batch.column(1).to_pylist(), np.float64)
                scores = np.round(q @ own.T, 6)
                for i, name in enumerate(names):
                    best = np.lexsort((order, -scores[i]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), arrow_kinds[0]), batch.column(0).take(pa.array(best)), pa.array(scores[i][best])], names=[qkey, key, "score"])

        return chunks.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull()).mapInArrow(run, result)

    for row in rows.toLocalIterator():  # queries, not chunks: a stated set, block by block
        held.append(row)
        if len(held) == QUERY_BLOCK:
            out, held = (block(held) if out is None else out.union(block(held))), []
    if held or out is None:
        part = block(held) if held else spark.createDataFrame([], result)
        out = part if out is None else out.union(part)
    return top(out, qkey, "score", key, k)


def fuse(branches: list[DataFrame], k: int, qkey: str = "query_id", key: str = "chunk_id", rrf_k: int = RRF_K, candidates: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion of ranked branches, each cut to its first ``candidates``; a single branch keeps its own scores."""
    if len(branches) == 1:
        return branches[0].where(F.col("rank") <= k)
    every = None
    for b in branches:
        own = b.where(F.col("rank") <= candidates).select(qkey, key, "rank")
        every = own if every is None else every.unionAll(own)
    return top(every.groupBy(qkey, key).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score")), qkey, "score", key, k)


def lexical_logit(query: Column, passage: Column) -> Column:
    """The offline stand-in of a cross-encoder: a logit that rises with the share of the query's terms in the passage."""
    asked = F.array_distinct(T.tokens(query))
    share = F.size(F.array_intersect(asked, T.tokens(passage))) / F.nullif(F.size(asked), F.lit(0))
    return 10.0 * F.coalesce(share, F.lit(0.0)) - 5.0


def rerank(hits: DataFrame, versions: DataFrame, chunks: DataFrame, k: int, qkey: str = "query_id", key: str = "chunk_id", logit=lexical_logit) -> DataFrame:
    """hits rescored by the sigmoid of ``logit``, the best over a query's versions (qkey, text); ties keep the order of hits."""
    passages = hits.withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "fused_rank").join(chunks.select(key, F.col("text").alias("__passage")), key)
    each = passages.join(if_small(versions.select(qkey, F.col("text").alias("__query"))), qkey)
    scored = each.withColumn("__s", F.round(1 / (1 + F.exp(-logit(F.col("__query"), F.col("__passage")))), 6))
    best = scored.groupBy(qkey, key, "retrieval_score", "fused_rank").agg(F.max("__s").alias("score"))
    w = Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc("fused_rank"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gate(queries: DataFrame, hits: DataFrame, qkey: str = "query_id", reranked: bool = True, least: float = LEAST) -> DataFrame:
    """(qkey, n_hits, best, not_found): not found without hits or, after reranking, if the best score is below ``least``."""
    found = hits.groupBy(qkey).agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))
    joined = queries.select(qkey).join(found, qkey, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    weak = (F.col("best") < least) if reranked else F.lit(False)
    return joined.withColumn("not_found", (F.col("n_hits") == 0) | F.coalesce(weak, F.lit(False)))


def best_per_turn(hits: DataFrame, qkey: str = "query_id", turn: str = "turn_id") -> DataFrame:
    """(qkey, turn, rank): each turn once, at its best rank, ranks closed up."""
    least = hits.groupBy(qkey, turn).agg(F.min("rank").alias("__r"))
    return least.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy("__r", turn))).drop("__r")
