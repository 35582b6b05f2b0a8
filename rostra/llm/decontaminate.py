"""Benchmark decontamination: prefix-filtered set join, in DataFrame operations only.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A benchmark item's windows are its runs of
WINDOW consecutive words; an item of fewer words, but not none, is one window. As a set, a window is its shingles of SHINGLE
words (a shorter window is one shingle). Containment is to be exact, so all shingles of a window must be in a text, and any one of
them is a sufficient prefix: the rarest, by its count over all documents, is the only one joined.

1. Rarity: positions whose shingle may be the benchmark's (by a bit table of fixed size) are counted by shingle.
2. Prefix: each window's rarest shingle, with its offset; windows that share it form one row.
3. Candidates: positions of prefix shingles, each with the WINDOW - 1 words on either side, meet their windows by an equi-join.
4. Bounds: the window must begin at or after word 0 and end at or before the last. Verification compares all its words.

A bit table has sixteen bits or more for each of the benchmark's shingles, from 2**BITS up to 2**MOST_BITS in all (2 MB); beyond a
million shingles it fills up and more positions reach the joins, none is lost. Documents are read twice and never shuffled; what moves
is contexts of prefix shingles.

Null and empty texts have no words and are never contaminated; very long ones are read whole, one row each. Null and wordless items have no window; a repeated item id counts once. Equal
documents are judged alike. Empty tables give empty or clean results. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import scratch, settle, stage

WINDOW, SHINGLE = 13, 3
#: A document is contaminated if this share (one in SHARE words) or more of its words is hit.
SHARE = 20
#: Bits of a bit table, as powers of two: the least and the most.
BITS, MOST_BITS = 20, 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; Unicode lower-casing is used only where the text is all ASCII, so that it equals A-Z's."""
    whole = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(window array<string>, items array<string>) of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = f"least({WINDOW}, size(words))"
    each = items.select("item", F.explode(F.expr(f"transform(sequence(1, size(words) - {length} + 1), k -> slice(words, k, {length}))")).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, items, m, j, g): the shingle g of m words at word j of each window."""
    m = f"least({SHINGLE}, size(window))"
    own = windows.select("window", "items", F.expr(m).alias("m"), F.posexplode(F.expr(f"transform(sequence(1, size(window) - {m} + 1), k -> array_join(slice(window, k, {m}), ' '))")).alias("j", "g"))
    return own


def _hash(words: str, at: str, m: int) -> str:
    return f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(m))})"


def _table(shingles: DataFrame, m: int, bits: int) -> str:
    """SQL of a constant array of longs: the bits (two for each) of the shingles of m words. At most 2**bits / 64 rows reach the driver."""
    hashed = shingles.where(F.col("m") == m).select(F.split("g", " ").alias("w")).distinct().selectExpr(f"{_hash('w', '0', m)} AS h")
    spots = hashed.select(F.explode(F.array(F.expr(f"h & {(1 << bits) - 1}"), F.expr(f"shiftright(h, {bits}) & {(1 << bits) - 1}"))).alias("bit"))
    rows = spots.selectExpr("cast(shiftright(bit, 6) AS int) AS word", "cast(bit & 63 AS int) AS b").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect()
    table = [0] * ((1 << bits) // 64)
    for r in rows:
        table[r.word] = r.v
    return f"cast(split('{','.join(map(str, table))}', ',') AS array<bigint>)"


def _bits(n_shingles: int) -> int:
    """Bits of a table for that many distinct shingles, as a power of two."""
    return min(MOST_BITS, max(BITS, (16 * n_shingles - 1).bit_length()))


def _positions(shingles: DataFrame, kinds: list[int]) -> Column:
    """array<struct<m, at>>: the positions of a row's words whose shingle may be among the shingles."""
    parts, bits = [], _bits(shingles.select("g").distinct().count())
    for m in kinds:
        table, low, high = _table(shingles, m, bits), f"(h & {(1 << bits) - 1})", f"(shiftright(h, {bits}) & {(1 << bits) - 1})"
        test = " AND ".join(f"(shiftright({table}[cast(shiftright({b}, 6) AS int)], cast({b} & 63 AS int)) & 1) = 1" for b in (low, high))
        hashes = f"transform(sequence(0, size(words) - {m}), i -> {_hash('words', 'i', m)})"
        flags = f"filter(transform({hashes}, (h, i) -> CASE WHEN {test} THEN named_struct('m', {m}, 'at', i) END), x -> x IS NOT NULL)"
        parts.append(f"CASE WHEN size(words) >= {m} THEN {flags} ELSE array() END")
    return F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")


_NONE = "cast(array() AS array<struct<m:int,at:int,g:string,before:array<string>,after:array<string>>>)"


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, items, contaminated) of every row of docs.

    k1 and k2 are two 64-bit hashes of the text; items are the ids, as sorted strings, of the items with windows in it.
    """
    shingles = stage(_shingles(windows_of(benchmark)), "shingles")
    kinds = sorted(r.m for r in shingles.select("m").distinct().collect())  # at most SHINGLE rows
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), words_of(F.col("text")).alias("words"))
    if not kinds:
        return worded.select("doc_id", "k1", "k2", F.size("words").alias("n_words"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))

    found = worded.select("words", _positions(shingles, kinds).alias("p"))
    seen = found.select(F.explode(F.expr("transform(p, x -> array_join(slice(words, x.at + 1, x.m), ' '))")).alias("g"))
    counts = seen.groupBy("g").agg(F.count("*").alias("n"))
    own = shingles.join(counts, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = own.groupBy("window", "items", "m").agg(F.min(F.struct("n", "j", "g")).alias("r")).where("r.n > 0")  # a shingle in no document settles its window
    prefix = stage(rarest.select("r.g", "m", F.col("r.j").alias("j"), "window", "items"), "prefix")

    context = f"transform(p, x -> named_struct('m', x.m, 'at', x.at, 'g', array_join(slice(words, x.at + 1, x.m), ' '), 'before', slice(words, greatest(x.at - {WINDOW - 2}, 1), least(x.at, {WINDOW - 1})), 'after', slice(words, x.at + 1, {WINDOW})))"
    marked = worded.select("doc_id", "k1", "k2", "words", _positions(prefix, kinds).alias("p"))
    rows = stage(marked.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "k1", "k2", F.size("words").alias("n_words"), F.expr(f"CASE WHEN size(p) > 0 THEN {context} ELSE {_NONE} END").alias("c")), "contexts")

    grouped = prefix.groupBy("g", "m").agg(F.collect_list(F.struct("j", "window", "items")).alias("windows"))
    spots = rows.select("uid", "n_words", F.explode("c").alias("c")).select("uid", "n_words", "c.*")
    near = spots.join(grouped, ["g", "m"])
    # before ends at word at - 1, after begins at word at: the window's words from at - j on.
    fits = "at - w.j >= 0 AND at - w.j + size(w.window) <= n_words AND w.window = concat(slice(before, size(before) - w.j + 1, w.j), slice(after, 1, size(w.window) - w.j))"
    hits = near.select("uid", "at", F.expr(f"filter(windows, w -> CASE WHEN at - w.j >= 0 THEN {fits} ELSE false END)").alias("hits")).where(F.size("hits") > 0)
    by_doc = hits.groupBy("uid").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("array_distinct(flatten(transform(hits, w -> sequence(at - w.j, at - w.j + size(w.window) - 1))))"))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("flatten(hits.items)"))))).alias("items"),
    )
    joined = rows.select("uid", "doc_id", "k1", "k2", "n_words").join(by_doc, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("doc_id", "k1", "k2", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (SHARE * n_hit.cast("long") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the contaminated texts. Of what is staged only their hashes stay."""
    settle(docs.sparkSession)
    with scratch(docs.sparkSession) as own:
        bad = stage(report(docs, benchmark).where("contaminated").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "contaminated")
        own.remove(bad.staged_path)
    settle(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.join(bad, (F.xxhash64(text) == F.col("__k1")) & (F.xxhash64(F.lit(1), text) == F.col("__k2")), "left_anti")
