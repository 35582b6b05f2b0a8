"""Browse and report views: facets, status, people, parties, sittings, labels, spot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators import ordered
from rostra.operators.evaluate import counted
from rostra.operators.resolve import RESOLVED


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, indexed documents, chunks, first and last date."""
    own = documents.agg(F.count("*").alias("documents"), F.min("sitting_date").alias("first_date"), F.max("sitting_date").alias("last_date"))
    return own.join(chunks.agg(F.count_distinct("doc_id").alias("indexed"), F.count("*").alias("chunks")))


def coverage(indexed: Column, total: Column) -> Column:
    return F.when(indexed >= total, F.concat(F.lit("all "), total.cast("string"), F.lit(" sittings"))).otherwise(F.concat(indexed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" sittings")))


def proper_name(name: Column, core: Column) -> Column:
    """Whether a registry name can be shown: a core name, at most 80 characters, no digits, no replacement characters."""
    return (core != "") & (F.length(name) <= 80) & ~name.rlike("[0-9�]")


def speakers(people: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """(speaker_id, name, seat), by name: those who speak in the index (if it is given); the seat is the alphabetically last."""
    own = people.where(proper_name(F.col("name"), F.col("core_name")))
    own = own if indexed is None else own.join(indexed.select("speaker_id").distinct(), "speaker_id", "left_semi")
    return own.select("speaker_id", "name", F.get(F.reverse(F.array_sort(F.col("constituencies.constituency"))), F.lit(0)).alias("seat"), F.lower("core_name").alias("sort")).orderBy("sort").drop("sort")


def parties(members: DataFrame) -> DataFrame:
    """(party, members), the largest first."""
    return members.where(F.col("party").isNotNull()).groupBy("party").agg(F.count("*").alias("members")).orderBy(F.desc("members"), F.asc("party"))


def members_of(party: str, members: DataFrame, strict: bool = True) -> tuple[str, ...] | None:
    """Speaker ids of a party. An unknown party is an error, or (strict=False, as the evaluation harness has it) no filter."""
    ids = tuple(r.speaker_id for r in members.where(F.col("party") == party).select("speaker_id").distinct().orderBy("speaker_id").collect())  # one party's members
    if not ids and strict:
        raise ValueError(f"unknown party {party!r}")
    return ids


def sittings(documents: DataFrame, turns: DataFrame) -> DataFrame:
    """Parsed sittings with their numbers of turns, newest first."""
    counts = turns.groupBy("doc_id").agg(F.count("*").alias("turns"))
    return documents.join(counts, "doc_id").orderBy(F.desc("sitting_date"))


def sitting(turns: DataFrame) -> DataFrame:
    """(doc_id, block, section_heading, first, last, rows): the sections of sittings, one row a run of turns under one heading."""
    return ordered.blocks(turns, ["doc_id"], "seq", "section_heading")


def turn_report(turns: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.col(c).cast("int"))
    share = F.avg(F.col("resolution").isin(RESOLVED).cast("double"))
    light = F.when(F.col("resolved_share") >= 0.97, "ok").when(F.col("resolved_share") >= 0.9, "warn").otherwise("bad")
    own = turns.groupBy("doc_id").agg(F.count("*").alias("turns"), flag("unattributed").alias("unattributed"), flag("is_interjection").alias("interjections"), share.alias("resolved_share"))
    return own.withColumn("light", light)


def unresolved_labels(turns: DataFrame) -> DataFrame:
    own = turns.where(~F.col("resolution").isin([*RESOLVED, "unattributed", "ocr_unreadable"]))
    return own.groupBy("speaker_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("speaker_raw"))


def recent_turns(turns: DataFrame, speaker_id: str, most: int = 60) -> DataFrame:
    """A speaker's latest turns with text (the limit is the feature)."""
    own = turns.where((F.col("speaker_id") == speaker_id) & (F.length("text") > 0))
    return own.orderBy(F.desc("sitting_date"), F.asc("seq")).limit(most)


def spot_check(turns: DataFrame, n: int, seed: int, turn_ids: list[str] | None = None, method: str | None = None, unresolved: bool = False) -> DataFrame:
    """A seeded sample of n turns, in order; turns with text if there are any (a sampling operator)."""
    own = turns.where(F.col("turn_id").isin(turn_ids)) if turn_ids else turns
    own = own.where(F.col("resolution") == method) if method else own
    own = own.where(~F.col("resolution").isin(RESOLVED)) if unresolved else own
    spoken = own.where(F.length("text") > 0)
    own = own if spoken.isEmpty() else spoken
    return own.orderBy(F.xxhash64("turn_id", F.lit(seed)), "turn_id").limit(n).orderBy("turn_id")


def modal(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): the most frequent value, the first seen of ties."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("at"))
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select(by, value, "n")


def page_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, median_chars, thin): the upper median of page lengths, and pages under 50 characters."""
    own = pages.select("doc_id", F.length("text").alias("c"))
    thin = own.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum((F.col("c") < 50).cast("int")).alias("thin"))
    placed = counted(own, ["doc_id"], "c").where(F.floor(F.col("all") / 2).between(F.col("before"), F.col("before") + F.col("n") - 1))
    return thin.join(placed.select("doc_id", F.col("c").alias("median_chars")), "doc_id", "left")


def methods(turns: DataFrame) -> DataFrame:
    """(resolution, n), the most frequent first."""
    return turns.groupBy("resolution").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("resolution"))


def first_turns(turns: DataFrame, method: str, most: int = 100) -> DataFrame:
    """The first turns of a method, by document and place (the limit is the feature)."""
    return turns.where(F.col("resolution") == method).orderBy("doc_id", "seq").limit(most)


def registry_view(people: DataFrame) -> DataFrame:
    """Persons by name, those without a seat last."""
    return people.orderBy(F.size("constituencies") == 0, "name")


def meetings(sittings: DataFrame) -> DataFrame:
    """(meeting, sittings, newest): doc_ids of each meeting, newest sitting first; a meeting without a title is named by its numbers."""
    named = F.coalesce("mesyuarat_title", F.concat(F.lit("Penggal "), F.col("penggal").cast("string"), F.lit(" · Mesyuarat "), F.col("mesyuarat").cast("string")))
    both = F.reverse(F.array_sort(F.collect_list(F.struct("sitting_date", "doc_id"))))
    return sittings.groupBy(named.alias("meeting")).agg(both.alias("b")).select("meeting", F.transform("b", lambda s: s["doc_id"]).alias("sittings"), F.get("b", F.lit(0))["sitting_date"].alias("newest"))


def rests_on(answers: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, sittings): distinct dates of the sources that each answer cites; 0 if it cites none. answers: key, answer; sources: key, n, date."""
    cited = answers.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda n: n.cast("int")))).alias("n"))
    dates = sources.join(cited, [key, "n"], "left_semi").groupBy(key).agg(F.count_distinct("date").alias("sittings"))
    return answers.select(key).join(dates, key, "left").select(key, F.coalesce("sittings", F.lit(0)).alias("sittings"))


def evidence(turns: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """One row: turns, and distinct sittings, that hold all words."""
    own = turns
    for word in words:
        own = own.where(F.contains(F.lower("text"), F.lit(word.lower())))
    return own.agg(F.count("*").alias("turns"), F.count_distinct(key).alias("sittings"))


def initials_of(people: DataFrame) -> DataFrame:
    return people.select("speaker_id", T.initials(F.col("core_name")).alias("initials"))
