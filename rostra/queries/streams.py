"""Rate limits, caps, sessions: batch forms and Structured Streaming over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.plans import shared
from rostra.queries.registry import query, read
from rostra.streaming import limits


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query()
def rate_limit(spark, sf_dir):
    decided = limits.admitted(_events(spark, sf_dir), most=2, window=3600, cap=200)
    return decided.select("event_id", "user_id", "accepted", "reason")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS attempts FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
def rate_attempts(spark, sf_dir):
    return limits.attempts(_events(spark, sf_dir), 3600).select("event_id", "user_id", "attempts")


@query("SELECT ts::DATE AS day, count(*) AS n, greatest(count(*) - 300, 0) AS over FROM events GROUP BY 1")
def daily_cap(spark, sf_dir):
    return limits.daily(_events(spark, sf_dir), cap=300)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    own = limits.sessions(_events(spark, sf_dir))
    return own.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _drained(stream: DataFrame) -> DataFrame:
    """All that a stream of the available files gives in complete mode, by way of a memory table: for results of a row a day, they stay with the driver."""
    name = f"s{uuid.uuid4().hex}"
    run = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def _appended(stream: DataFrame) -> DataFrame:
    """All that a stream of the available files appends, by way of files in the shared folder, where its state is too: no row passes the driver."""
    spark = stream.sparkSession
    path, log = shared.new_path(spark, "stream"), shared.new_path(spark, "stream-log")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    shared.remove(spark, log)
    return spark.read.schema(stream.schema).parquet(path)


def _stream(spark, sf_dir):
    """events as a stream: one file or a folder of them."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT ts::DATE AS day, count(*) AS n, greatest(count(*) - 300, 0) AS over FROM events GROUP BY 1")
def stream_daily_cap(spark, sf_dir):
    return _drained(limits.daily(_stream(spark, sf_dir), cap=300))


@query()
def stream_rate_limit(spark, sf_dir):
    return _appended(limits.stream_limited(_stream(spark, sf_dir), most=2, window=3600))
