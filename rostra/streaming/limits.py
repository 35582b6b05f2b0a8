"""Streams of events: rate limits with feedback, daily counts, sessions, revisions, logs. Batch forms share the same rules."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PER_MINUTE, PER_DAY, WINDOW_S = 10, 500, 60
DECISION = "event_id long, user_id long, ts timestamp, accepted boolean, reason string"


class Limiter:
    """Accepts at most ``most`` events in any ``window`` seconds; only accepted ones count, entries as old as the window still do."""

    def __init__(self, most: int, window: float, times=()):
        self.most, self.window, self.times = most, window, deque(times)

    def full(self, t: float) -> bool:
        while self.times and t - self.times[0] > self.window:
            self.times.popleft()
        return len(self.times) >= self.most

    def accepts(self, t: float) -> bool:
        if self.full(t):
            return False
        self.times.append(t)
        return True


def _folded(events: DataFrame, most: int, window: float, closed: dict) -> DataFrame:
    """Events decided by user, in order of time; those after a day's last place (closed: day to (microseconds, event_id)) don't enter the windows.

    A partition's rows come sorted by user and time and are folded as they stream by; what is held is one user's accepted times, at most ``most``.
    """
    own = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("__t", F.unix_micros("ts")).withColumn("__day", F.to_date("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, limiter = None, None
        for batch in batches:
            reasons = []
            for event, who, t, day in zip(*(batch.column(c).to_pylist() for c in ("event_id", "user_id", "__t", "__day")), strict=True):
                if limiter is None or who != user:
                    user, limiter = who, Limiter(most, window)
                if limiter.full(t / 1e6):
                    reasons.append("per_minute")
                elif day in closed and (t, event) > closed[day]:
                    reasons.append("daily_cap")
                else:
                    limiter.times.append(t / 1e6)
                    reasons.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("event_id", "user_id", "ts")), pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], names=["event_id", "user_id", "ts", "accepted", "reason"])

    return own.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(run, DECISION)


def limited(events: DataFrame, most: int = PER_MINUTE, window: float = WINDOW_S) -> DataFrame:
    """events (event_id, user_id, ts) with accepted and reason by the users' windows alone, in order of time."""
    return _folded(events, most, window, {})


def _last_places(accepted: DataFrame, cap: int) -> dict:
    """Of each UTC day with ``cap`` events or more, the (microseconds, event_id) of the one that uses the cap up.

    Counts by minute tell the minute it is in; only that minute's events are put in order. One row a day reaches the driver.
    """
    own = accepted.select("event_id", F.unix_micros("ts").alias("t"), F.to_date("ts").alias("day")).withColumn("minute", F.floor(F.col("t") / 60_000_000))
    counts = own.groupBy("day", "minute").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("before", upto - F.col("n")).where((F.col("before") < cap) & (F.col("before") + F.col("n") >= cap)).select("day", "minute", "before")
    place = F.row_number().over(Window.partitionBy("day").orderBy("t", "event_id")) + F.col("before")
    return {r.day: (r.t, r.event_id) for r in own.join(F.broadcast(hit), ["day", "minute"]).withColumn("k", place).where(F.col("k") == cap).select("day", "t", "event_id").collect()}


def admitted(events: DataFrame, most: int = PER_MINUTE, window: float = WINDOW_S, cap: int = PER_DAY) -> DataFrame:
    """events (event_id, user_id, ts) with accepted and reason under both rules: an event counts for either only if both let it in.

    Until a day's cap is used up the daily rule refuses nothing, so users are folded apart, given where each day closes; where days close follows
    from the folds. A window reaches over midnight, hence a day depends on the one before: the two steps alternate until no day's close moves, which a day
    takes at most one round more than its predecessor for, and in practice two or three rounds do.
    """
    closed: dict = {}
    while True:
        decided = _folded(events, most, window, closed)
        found = _last_places(decided.where("accepted"), cap)
        if found == closed:
            return decided
        closed = found


def daily_capped(decided: DataFrame, cap: int = PER_DAY) -> DataFrame:
    """decided with events over the daily cap rejected: only those the first rule accepted count, by UTC day in order of time."""
    closed = _last_places(decided.where("accepted"), cap)
    over = F.lit(False)
    for day, (t, event) in closed.items():  # one term a day with more events than its cap
        over |= (F.to_date("ts") == F.lit(day)) & ((F.unix_micros("ts") > t) | ((F.unix_micros("ts") == t) & (F.col("event_id") > event)))
    own = decided.withColumn("__over", F.col("accepted") & over)
    return own.withColumns({"reason": F.when(F.col("__over"), "daily_cap").otherwise(F.col("reason")), "accepted": F.col("accepted") & ~F.col("__over")}).drop("__over")


def attempts(events: DataFrame, window: int = WINDOW_S) -> DataFrame:
    """events with the user's attempts in the last ``window`` seconds, this one included (whether accepted or not)."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-window, 0)
    return events.withColumn("attempts", F.count("*").over(w))


def stream_limited(events: DataFrame, most: int = PER_MINUTE, window: float = WINDOW_S) -> DataFrame:
    """The same as a stream: a user's accepted times are the state and go when the watermark has passed them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(most, window, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows["accepted"] = [limiter.accepts(t) for t in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6]
        rows["reason"] = [None if a else "per_minute" for a in rows["accepted"]]
        state.update((list(limiter.times),))
        state.setTimeoutTimestamp(int((max(limiter.times) + window) * 1000) + 1)
        yield rows[["event_id", "user_id", "ts", "accepted", "reason"]]

    own = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")
    return own.groupBy("user_id").applyInPandasWithState(step, DECISION, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def daily(events: DataFrame, cap: int = PER_DAY) -> DataFrame:
    """(day, n, over) of a stream or table: events a UTC day and those beyond the cap."""
    own = events.withColumn("__t", F.col("ts").cast("timestamp")).withWatermark("__t", "1 hour")
    counted = own.groupBy(F.window("__t", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "n", F.greatest(F.col("n") - cap, F.lit(0)).alias("over"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events with no gap of ``gap`` between them (an extension)."""
    own = events.withColumn("__t", F.col("ts").cast("timestamp")).withWatermark("__t", "1 hour")
    return own.groupBy(F.session_window("__t", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_by_hash(batch: DataFrame, path: str, spark, key: str = "doc_id", digest: str = "sha256") -> None:
    """For foreachBatch: write the documents whose content is new or changed, each to a partition of its own; a repeated batch changes nothing."""
    from rostra.sources.files import read_json, write_by_document

    last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "version").alias("r")).select(key, "r.*")
    known = read_json(spark, path, f"{key} string, {digest} string").select(key, F.col(digest).alias("__old")).distinct()
    fresh = last.join(known, key, "left").where(F.col("__old").isNull() | (F.col("__old") != F.col(digest))).drop("__old")
    write_by_document(fresh, path, key, "json")
