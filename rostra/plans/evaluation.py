"""A whole evaluation in one call: experiments over a golden set of questions, their rows, summaries and report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.operators import evaluate, report, retrieve
from rostra.plans import providers
from rostra.plans.engine import Engine
from rostra.plans.size import held
from rostra.sources import files


@dataclass(frozen=True)
class Experiment:
    """One way to search."""

    name: str
    mode: str
    rerank: bool = False
    translate: bool = False
    k: int = retrieve.TOP


EXPERIMENTS = [
    Experiment("dense", "dense"),
    Experiment("sparse", "sparse"),
    Experiment("hybrid", "hybrid"),
    Experiment("hybrid_rerank", "hybrid", rerank=True),
    Experiment("hybrid_rerank_translate", "hybrid", rerank=True, translate=True),
]


def _filters(engine: Engine, row) -> retrieve.Filters:
    """The filters of golden questions; an unknown party filters nothing."""
    if row is None:
        return retrieve.Filters()
    ids = report.members_of(row.party, engine.parties_table, strict=False) if row.party else ()
    return retrieve.Filters(row.date_from, row.date_to, row.speaker_id, ids)


def scored(engine: Engine, golden: DataFrame, experiment: Experiment, embedder: Callable, translate: Callable[[str], str | None] | None = None) -> DataFrame:
    """golden (schemas.GOLDEN) with recall, mrr, ndcg, best_relevance, not_found, ms and the ranked turns, by one experiment.

    Questions with the same filters are one batch; ms is a batch's time by question. Chunks of one turn count once, at their best rank.
    """
    relevant = golden.select(F.col("id").alias("query_id"), F.explode("relevant_turn_ids").alias("turn_id"))
    turns, out = engine.chunks.select("chunk_id", "turn_id"), None
    for batch in golden.select("filters").distinct().collect():  # of a hand-written set
        own = golden.where(F.col("filters").eqNullSafe(_literal(golden, batch.filters)))
        questions = own.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
        versions = providers.with_translations(questions, translate) if experiment.translate and translate else None
        vectors = providers.embed(questions if versions is None else versions, embedder).drop("text") if experiment.mode != "sparse" else None
        began = time.time()
        hits, gate = engine.search(questions, _filters(engine, batch.filters), experiment.k, experiment.mode, experiment.rerank, vectors, versions)
        ranked = retrieve.best_per_turn(hits.select("query_id", "chunk_id", "rank").join(turns, "chunk_id")).persist()
        ms = (time.time() - began + _seconds(ranked)) * 1000 / max(1, own.count())
        listed = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "turn_id"))), lambda r: r["turn_id"]).alias("ranked"))
        rows = evaluate.per_question(questions.select("query_id"), ranked, relevant.join(questions, "query_id", "left_semi"), experiment.k)
        rows = rows.join(gate.select("query_id", F.col("best").alias("best_relevance"), "not_found"), "query_id").join(listed, "query_id", "left").withColumn("ms", F.lit(int(ms)))
        part = own.select(F.col("id").alias("query_id"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("type", F.lit("?")).alias("type"), F.coalesce("answerable", F.lit(True)).alias("answerable")).join(rows, "query_id")
        part = held(part)
        ranked.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _seconds(df: DataFrame) -> float:
    began = time.time()
    df.count()
    return time.time() - began


def _literal(golden: DataFrame, row):
    kind = golden.schema["filters"].dataType
    if row is None:
        return F.lit(None).cast(kind)
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]).cast(kind)


def summarised(rows: DataFrame) -> DataFrame:
    """summary() of scored rows, over all and by language, with the median and the 95th percentile of ms."""
    shares = {"p50_ms": 0.5, "p95_ms": 0.95}
    times = evaluate.nearest_rank(rows.withColumn("value", F.lit("all")), ["value"], "ms", shares).withColumn("slice", F.lit("all"))
    times = times.unionByName(evaluate.nearest_rank(rows.withColumnRenamed("lang", "value"), ["value"], "ms", shares).withColumn("slice", F.lit("lang")))
    return evaluate.summary(rows, ["lang"]).join(times, ["slice", "value"], "left")


def run(engine: Engine, golden: DataFrame, embedder: Callable, translate: Callable[[str], str | None] | None = None, experiments: list[Experiment] = EXPERIMENTS, path: str | None = None) -> tuple[DataFrame, str]:
    """(summaries with a column experiment, a Markdown report); with a path, each experiment's rows are written below it. An empty golden set is an error."""
    if golden.isEmpty():
        raise ValueError("the golden set is empty")
    lines, out = [], None
    for e in experiments:
        rows = scored(engine, golden, e, embedder, translate)
        if path is not None:
            files.write_report(rows, f"{path}/{e.name}")
        table = summarised(rows)
        table = engine.chunks.sparkSession.createDataFrame(table.orderBy("slice", "value").collect(), table.schema)  # a few rows
        lines += [f"## {e.name}", "", *evaluate.markdown(table), ""]
        own = table.select(F.lit(e.name).alias("experiment"), "*")
        out = own if out is None else out.unionByName(own)
    return out, "\n".join(lines)
