"""The API over a set of tables: ask and search for batches of questions, and the browse views."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators import index as stored
from rostra.operators import report, retrieve, verify
from rostra.operators.chunk import split_text
from rostra.plans.providers import Failover, ProviderError, extractive
from rostra.sources import files

MODES = ("dense", "sparse", "hybrid")


@dataclass
class Engine:
    """chunks: schemas.CHUNK_FIELDS with chunk_id (long or string), text, sitting_day; vectors: chunk_id, embedding; the rest as in schemas."""

    chunks: DataFrame
    documents: DataFrame | None = None
    turns: DataFrame | None = None
    people: DataFrame | None = None
    parties_table: DataFrame | None = None
    vectors: DataFrame | None = None
    log_path: str | None = None
    index: stored.Index | None = None  # of the chunks (operators.index.build); without it each search tokenises them

    def search(self, questions: DataFrame, filters: retrieve.Filters | None = None, top_k: int = retrieve.TOP, mode: str = "sparse", rerank: bool = True, query_vectors: DataFrame | None = None, versions: DataFrame | None = None, least: float = retrieve.LEAST) -> tuple[DataFrame, DataFrame]:
        """(hits, gate) for questions (query_id, text); versions (query_id, version, text) adds translations (version 1), each a keyword branch of its own, and,
        where query_vectors (query_id, embedding) has a version too, a vector branch."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        asked = versions if versions is not None else questions.withColumn("version", F.lit(0))
        filtered = filters is not None and filters.condition() is not None
        allowed = filters.apply(self.chunks) if filtered else None
        pool = max(top_k, retrieve.POOL) if rerank else top_k
        branches = []
        vectors = None
        if mode != "sparse":
            vectors = self.vectors if allowed is None else self.vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
            if query_vectors is None:
                raise ValueError(f"mode {mode} needs the questions' vectors")
        for v in range(2 if versions is not None else 1):
            if mode != "dense":
                branches.append(retrieve.bm25(asked.where(F.col("version") == v), self.index or self.chunks, max(pool, retrieve.CANDIDATES), allowed=allowed))
            if mode != "sparse" and (v == 0 or "version" in query_vectors.columns):
                own = query_vectors.where(F.col("version") == v).drop("version") if "version" in query_vectors.columns else query_vectors
                branches.append(retrieve.dense(own, vectors, max(pool, retrieve.CANDIDATES)))
        hits = retrieve.fuse(branches, pool)
        hits = retrieve.rerank(hits, asked.select("query_id", "text"), self.chunks, top_k) if rerank else hits
        return hits, retrieve.gate(questions, hits, reranked=rerank, least=least)

    def ask(self, question: str, filters: retrieve.Filters | None = None, party: str | None = None, writer: Failover | None = None, **options: Any) -> Iterator[tuple[str, Any]]:
        """The events of one answer, in order: sources, tokens, (error,) engine, check, done; or sources, not_found, done."""
        if not 2 <= len(question) <= 500:
            raise ValueError("a question has 2 to 500 characters")
        if party is not None:
            ids = report.members_of(party, self.parties_table)
            base = filters or retrieve.Filters()
            filters = retrieve.Filters(base.date_from, base.date_to, base.speaker_id, ids, base.section)
        spark, began = self.chunks.sparkSession, time.time()
        asked = spark.createDataFrame([(0, question)], "query_id long, text string")
        hits, gate = self.search(asked, filters, **options)
        rows = hits.join(self.chunks, "chunk_id").withColumn("terms", T.highlight_terms(F.array(F.lit(question)))).persist()
        verdict = gate.first()
        ms = int((time.time() - began) * 1000)
        self.log(question, rows, verdict, ms)
        if verdict.not_found:
            yield "sources", []
            yield "not_found", {"best_relevance": verdict.best}
            yield "done", {"retrieve_ms": ms, "generate_ms": 0}
            rows.unpersist()
            return
        yield "sources", [r.asDict() for r in verify.source_cards(rows, self.people, self.parties_table).orderBy("rank").collect()]  # top_k rows
        prompt = verify.prompts(rows, asked.select("query_id", F.col("text").alias("question"))).first().prompt
        writer, pieces = writer or Failover({"extractive": extractive}), []
        try:
            for piece in writer.stream(prompt):
                pieces.append(piece)
                yield "token", piece
        except ProviderError as error:
            yield "error", str(error)
        yield "engine", writer.used or "none"
        texts = [r.text for r in rows.orderBy("rank").select("text").collect()]
        checked = verify.check(spark.createDataFrame([("".join(pieces), texts)], "answer string, sources array<string>")).first()
        yield "check", {k: list(checked[k]) for k in ("unverified_quotes", "missing_sources", "cited")}
        yield "done", {"retrieve_ms": ms, "generate_ms": int((time.time() - began) * 1000) - ms}
        rows.unpersist()

    def log(self, question: str, hits: DataFrame, verdict, ms: int) -> None:
        """Append a record of the query, if a log path is set."""
        if self.log_path is None:
            return
        one = hits.agg(F.collect_list(F.struct("turn_id", F.col("chunk_id").cast("string").alias("chunk_id"), "speaker_id", F.round("score", 4).alias("rerank"))).alias("hits"))
        now = datetime.now(UTC).isoformat(timespec="seconds")
        files.append_log(one.select(F.lit(now).alias("at"), F.lit(question).alias("query"), F.lit(verdict.not_found).alias("not_found"), F.lit(verdict.best).alias("best_relevance"), F.create_map(F.lit("total"), F.lit(ms)).alias("ms"), "hits"), self.log_path)

    def status(self) -> DataFrame:
        return report.status(self.documents, self.chunks)

    def speakers(self) -> DataFrame:
        return report.speakers(self.people, self.chunks)

    def parties(self) -> DataFrame:
        return report.parties(self.parties_table)

    def sittings(self) -> DataFrame:
        return report.sittings(self.documents, self.turns)

    def sitting(self, doc_id: str) -> DataFrame:
        return report.sitting(self.turns.where(F.col("doc_id") == doc_id))


def register(spark) -> None:
    """A name for SQL callers: rostra_windows(text), by Arrow batches. Names are Column expressions (functions.names) and need none."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_text(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    spark.udf.register("rostra_windows", F.arrow_udf(run, "array<string>"))
