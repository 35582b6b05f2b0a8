"""Ordered analytics over turns: carry-forward state, interjections, islands, counters, selections by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, by: list[str], order: list[str], update: Column, value: Column, column: str, inclusive: bool = False) -> DataFrame:
    """df with the value of the latest row on which ``update`` held, before this row (or up to it).

    The value travels inside a struct, so that an update to null is not taken for no update.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(column, F.last(F.when(update, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


def interjections(turns: DataFrame, by: list[str], order: list[str], key: Column, unattributed: Column, speech: Column, chair: Column, length: Column, most: int = 240) -> DataFrame:
    """turns with is_interjection: nameless, or a short speech, not the chair's, between two turns of one other speaker."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = turns.withColumns({"__k": key}).withColumns({"__p": F.lag("__k").over(w), "__n": F.lead("__k").over(w)})
    between = speech & ~chair & (length <= most) & F.col("__p").isNotNull() & (F.col("__p") == F.col("__n")) & (F.col("__p") != F.col("__k"))
    return own.withColumn("is_interjection", unattributed | F.coalesce(between, F.lit(False))).drop("__k", "__p", "__n")


def islands(df: DataFrame, by: list[str], order: list[str], value: str, column: str = "block") -> DataFrame:
    """df with the number (from 1) of the run of equal values a row is in; null equals null."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = df.withColumn("__v", F.struct(F.col(value).alias("v")))
    change = F.when(F.lag("__v").over(w).isNull() | ~F.lag("__v").over(w)["v"].eqNullSafe(F.col(value)), 1).otherwise(0)
    return own.withColumn("__c", change).withColumn(column, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__v", "__c")


def blocks(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., block, value, first, last, rows): one row a run of equal values."""
    return islands(df, by, [order], value).groupBy(*by, "block").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def counter(df: DataFrame, by: list[str], order: list[str], counts: Column, column: str) -> DataFrame:
    """df with the number of rows on which ``counts`` held, up to and with this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.sum(F.when(counts, 1).otherwise(0)).over(w).cast("int"))


def span_ends(df: DataFrame, by: list[str], start: str, end: Column, column: str = "end") -> DataFrame:
    """df with where each row's span ends: the next row's start, or ``end`` for the last."""
    return df.withColumn(column, F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), end))


def even_sample(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """At most k rows of each ``by``, spread evenly over its order (a sampling operator).

    Rows are counted by the first order column; only its values that hold a chosen place have their rows ordered.
    """
    key = [F.col(by).alias("__by"), F.col(order[0]).alias("__at")]
    counts = df.groupBy(*key).agg(F.count("*").alias("__m"))
    w = Window.partitionBy("__by")
    counts = counts.withColumn("__before", F.sum("__m").over(w.orderBy("__at")) - F.col("__m")).withColumn("__n", F.sum("__m").over(w))
    step = F.greatest(F.col("__n") / F.lit(float(k)), F.lit(1.0))
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("__n")).cast("int") - 1), lambda i: F.floor(i * step))
    own = F.filter(picks, lambda i: (i >= F.col("__before")) & (i < F.col("__before") + F.col("__m")))
    chosen = counts.select("__by", "__at", "__before", own.alias("__picks")).where(F.size("__picks") > 0)
    rows = df.join(chosen, F.col(by).eqNullSafe(F.col("__by")) & F.col(order[0]).eqNullSafe(F.col("__at")))
    place = F.row_number().over(Window.partitionBy("__by", "__at").orderBy(*order)) - 1 + F.col("__before")
    return rows.withColumn("__i", place).where(F.array_contains("__picks", F.col("__i").cast("long"))).select(*df.columns)


def newest(df: DataFrame, by: str, version: Column, order: str, url: str, column: str = "superseded_urls") -> DataFrame:
    """One row of each ``by``: the largest version (none counts as oldest, ties go to the earlier row); the others' urls in ``column``."""
    w = Window.partitionBy(by)
    ranked = df.withColumn("__v", F.coalesce(version, F.lit("")))
    ranked = ranked.withColumn("__k", F.row_number().over(w.orderBy(F.desc("__v"), F.asc(order))))
    urls = F.collect_set(F.when(F.col("__k") > 1, F.col(url))).over(w)
    return ranked.withColumn(column, F.array_sort(urls)).where("__k = 1").drop("__v", "__k")


def page(df: DataFrame, order: list[str], offset: int, limit: int = 200) -> DataFrame:
    """One page of rows (the limit is the feature)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, by: str, value: str, as_of: str) -> DataFrame:
    """(by, value): the value of the latest snapshot."""
    return df.groupBy(by).agg(F.max_by(value, as_of).alias(value))


def as_of(df: DataFrame, snapshots: DataFrame, key: str, at: str, as_of_: str, value: str) -> DataFrame:
    """df with the value of the last snapshot at or before each row's ``at`` (an extension: one sort of both sides, no range join)."""
    left = df.withColumn("__row", F.struct(*df.columns)).select(F.col(key).alias("__key"), F.col(at).alias("__at"), "__row", F.lit(None).cast(snapshots.schema[value].dataType).alias("__v"), F.lit(1).alias("__kind"))
    right = snapshots.select(F.col(key).alias("__key"), F.col(as_of_).alias("__at"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.lit(0).alias("__kind"))
    w = Window.partitionBy("__key").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionAll(right).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__kind = 1").select("__row.*", value)
