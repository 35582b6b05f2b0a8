"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame operations only.

A text's lines are what newlines separate; a line's ID is its two 64-bit hashes. All documents' lines, in order of doc_id (null first; rows
of one id in a fixed order), form one sequence of suffixes, each cut at its document's end.

Round d = 1, 2, 4, ... sorts the suffixes by their first d lines: those of d = 1 by line ID, later ones by the ranks at d/2 of the suffix
and of the one d/2 lines on. Equal prefixes are grouped before they are sorted (a hot line is one row) and get one
rank. A rank held by two suffixes or more is an interval of the suffix array whose longest common prefix is d or more; other suffixes
take part no longer. The lengths between two powers are ranked by the power below and the lines that
remain. So every length up to MIN_LINES has its intervals; the rounds end there, or when no interval is left.

In an interval, every suffix but the first in document order starts a later copy of d lines. A copy counts if it has
MIN_LINES lines or more, or MIN_CHARS characters or more (newlines between its lines included); the lines of copies that
count are deleted. Copies longer than MIN_LINES consist of copies of MIN_LINES lines that overlap, so they need no rounds of their own:
overlapping copies join into maximal runs, whatever their length. The first copy stays, also inside one document.

Null texts have one empty line, like empty ones. A document may lose all its lines; it stays with an empty text. Repeated rows are copies of each
other, in an order of their own. Very long texts are split into lines like any other; no task holds more than one. Empty tables give empty results.
Columns of docs may have any names, those that begin with ``__line_`` or ``__member_`` excepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.members import among, members
from rostra.llm.staging import drop, settle, stage

MIN_LINES, MIN_CHARS = 4, 200


def _ranked(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """Suffixes of repeated keys with the key's rank in sorted order and whether a suffix before them has the key."""
    groups = suffixes.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "uid", "line")).alias("first")).where("n > 1")
    # Ids that increase over the range-sorted groups are ranks: equal keys share one, larger keys have a larger one.
    ranks = groups.orderBy(*key).withColumn("order", F.monotonically_increasing_id())
    joined = suffixes.join(ranks, key)
    later = ~((F.col("first.uid") == F.col("uid")) & (F.col("first.line") == F.col("line")))
    return stage(joined.select("doc_id", "uid", "line", "chars", F.col("order").alias("rank"), later.alias("later")), "ranks")


def _longer(own: DataFrame, other: DataFrame, ahead: int) -> DataFrame:
    """Suffixes ranked by their first lines in ``own`` and, from ``ahead`` lines on, in ``other``: together a prefix without overlap."""
    rest = other.select("uid", (F.col("line") - ahead).alias("line"), F.col("rank").alias("next"), F.col("chars").alias("more"))
    pairs = own.join(rest, ["uid", "line"]).select("doc_id", "uid", "line", (F.col("chars") + 1 + F.col("more")).alias("chars"), "rank", "next")
    return _ranked(pairs, ["rank", "next"])


def intervals(lines: DataFrame, most: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """From (doc_id, uid, line, h1, h2, chars), for d = 1, 2, ..., most: (doc_id, uid, line, chars, rank, later) of the suffixes in intervals."""
    own, depth, out = _ranked(lines, ["h1", "h2"]), 1, []
    while not own.isEmpty():
        out.append((depth, own))
        by_length = dict(out)
        for length in range(depth + 1, min(2 * depth, most + 1)):
            out.append((length, _longer(own, by_length[length - depth], depth)))
        if 2 * depth > most:
            break
        own, depth = _longer(own, own, depth), 2 * depth
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row id, in the shared folder: ids stay the same whatever is computed again."""
    return stage(docs.withColumn("__line_uid", F.monotonically_increasing_id()), "numbered")


def deletions(numbered: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__line_uid, __line_gone array<int>) of the rows that lose lines: their numbers, from 0, in order. Staged; what led to it is removed."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    split = numbered.select(F.col("__line_uid").alias("uid"), "doc_id", F.posexplode(parts).alias("line", "value"))
    lines = split.select("doc_id", "uid", "line", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"), F.char_length("value").cast("long").alias("chars"))
    found, copies = intervals(lines, min_lines), None
    for depth, table in found:
        own = table.where("later").where(F.lit(depth >= min_lines) | (F.col("chars") >= min_chars)).select("uid", "line", F.lit(depth).alias("lines"))
        copies = own if copies is None else copies.union(own)
    if copies is None:
        return numbered.select("__line_uid", F.array().cast("array<int>").alias("__line_gone")).limit(0)
    # The longest copy that counts from each line on; then the lines of each row.
    longest = copies.groupBy("uid", "line").agg(F.max("lines").alias("lines"))
    each = longest.select("uid", F.explode(F.expr("sequence(line, line + lines - 1)")).alias("line")).groupBy(F.col("uid").alias("__line_uid"))
    gone = stage(each.agg(F.array_sort(F.collect_set("line")).alias("__line_gone")), "deletions")
    for _, table in found:
        drop(table)
    return gone


def _cut(docs: DataFrame, **options) -> DataFrame:
    """docs with __line_all, __line_gone and __line_kept (arrays; __line_gone is null where nothing goes)."""
    numbered = _numbered(docs)
    gone = deletions(numbered, **options)
    settle(docs.sparkSession)
    # One plan at every size: texts that lose lines meet their deletions by key, however few these are. The others stay where they are.
    losing, columns = members(gone, "__line_uid"), [*numbered.columns, "__line_gone"]
    some = among(numbered, "__line_uid", losing).join(gone.hint("merge"), "__line_uid").select(columns)
    rest = among(numbered, "__line_uid", losing, inside=False).withColumn("__line_gone", F.lit(None).cast("array<int>"))
    joined = some.union(rest).withColumn("__line_all", F.split(F.coalesce("text", F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__line_all") - 1), "__line_gone")
    return joined.withColumn("__line_kept", F.when(F.col("__line_gone").isNull(), F.col("__line_all")).otherwise(F.transform(left, lambda i: F.get("__line_all", i))))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, kept) of every row of docs: lines, deleted ones, their maximal runs and the longest of
    these, in lines; kept is the text without the deleted lines."""
    cut = _cut(docs.select("doc_id", "text"), **options)
    # A run's lines share the difference of line number and place in the array; sizes by difference are the runs' lengths.
    gone = F.coalesce("__line_gone", F.array().cast("array<int>"))
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("size"), F.lit(0).alias("runs"), F.lit(0).alias("longest"))

    def step(acc, line):
        size = F.when(line == acc["last"] + 1, acc["size"] + 1).otherwise(1)
        return F.struct(line.alias("last"), size.alias("size"), (acc["runs"] + F.when(size == 1, 1).otherwise(0)).alias("runs"), F.greatest(acc["longest"], size).alias("longest"))

    cut = cut.withColumn("__line_runs", F.aggregate(gone, start, step))
    return cut.select(
        "doc_id", F.size("__line_all").alias("n_lines"), F.size(gone).alias("n_removed"), F.col("__line_runs.runs").alias("n_runs"), F.col("__line_runs.longest").alias("longest_run"), F.array_join("__line_kept", "\n").alias("kept")
    )


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with the kept lines as text (a text that loses nothing stays as it is, null included) and n_chars, where there is one, their length."""
    some = F.col("__line_gone").isNotNull()
    cut = _cut(docs, **options).withColumn("__line_text", F.when(some, F.array_join("__line_kept", "\n")).otherwise(F.col("text")))
    new = {"text": F.col("__line_text"), "n_chars": F.when(some, F.char_length("__line_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
