"""Retrieval quality: recall, reciprocal rank and gain of ranked turns, refusals and latencies, by slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_question(questions: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int, qkey: str = "query_id", key: str = "turn_id") -> DataFrame:
    """questions with n_relevant, recall and ndcg (null without relevant turns) and mrr (0 without a hit).

    ranked: (qkey, key, rank from 1, at most k); relevant: (qkey, key).
    """
    wanted = relevant.select(qkey, key).distinct()
    counts = wanted.groupBy(qkey).agg(F.count("*").alias("n_relevant"))
    found = ranked.where(F.col("rank") <= k).join(wanted, [qkey, key]).groupBy(qkey)
    found = found.agg(F.count("*").alias("__n"), F.min("rank").alias("__first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("__dcg"))
    own = questions.join(counts, qkey, "left").join(found, qkey, "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    some = F.col("n_relevant") > 0
    return own.withColumns(
        {
            "recall": F.when(some, F.coalesce("__n", F.lit(0)) / F.col("n_relevant")),
            "mrr": F.coalesce(1 / F.col("__first"), F.lit(0.0)),
            "ndcg": F.when(some, F.coalesce("__dcg", F.lit(0.0)) / F.when(some, ideal)),
        }
    ).drop("__n", "__first", "__dcg")


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n, before, all): rows of each distinct value, rows of smaller ones, rows of the group; nulls are left out.

    Rows are counted before they are shuffled, so what a task orders is a group's distinct values.
    """
    w = Window.partitionBy(*by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("before", F.sum("n").over(w.orderBy(value)) - F.col("n")).withColumn("all", F.sum("n").over(w))


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., names...): for each share p the value at place floor(n * p) of the group's n sorted values, the last at most."""
    placed = counted(df, by, value)

    def at(p: float):
        place = F.least(F.floor(F.col("all") * p), F.col("all") - 1)
        return place.between(F.col("before"), F.col("before") + F.col("n") - 1)

    return placed.groupBy(*by).agg(*[F.max(F.when(at(p), F.col(value))).alias(name) for name, p in shares.items()])


def summary(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Means over all rows and by each slice column: one row a (slice, value), slice "all" for the whole.

    recall, mrr and ndcg over answerable questions with relevant turns, refusal over unanswerable, false_refusal over all answerable ones.
    """
    labelled = F.col("answerable") & F.col("recall").isNotNull()
    refused = F.col("not_found").cast("double")
    aggs = [
        F.count("*").alias("n"),
        *[F.avg(F.when(labelled, F.col(m))).alias(m) for m in ("recall", "mrr", "ndcg")],
        F.avg(F.when(~F.col("answerable"), refused)).alias("refusal"),
        F.avg(F.when(F.col("answerable"), refused)).alias("false_refusal"),
    ]
    out = rows.agg(*aggs).select(F.lit("all").alias("slice"), F.lit("all").alias("value"), "*")
    for column in slices:
        out = out.unionByName(rows.groupBy(F.col(column).cast("string").alias("value")).agg(*aggs).select(F.lit(column).alias("slice"), "*"))
    return out


def markdown(table: DataFrame) -> list[str]:
    """Lines of a Markdown table: nulls as a dash, fractions to three digits. For a summary's few rows."""
    shown = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(table.columns)} |", f"|{'---|' * len(table.columns)}"]
    return head + [f"| {' | '.join(shown(v) for v in r)} |" for r in table.collect()]
