"""Substring dedup: prefix-partitioned suffix trees over words.

Words are what ASCII white space separates, unchanged. A window is WINDOW consecutive words of one text; a word is removed if a
window that covers it also starts anywhere else, the same text included, judged on the input.

1. Sampling. Each window has one anchor, the group of words inside it with the least hash (the leftmost of ties), of the first of
   PREFIXES words. Equal windows have equal anchors at equal offsets, so a window whose anchor's words occur once is a leaf and goes
   no further.
2. Strings. The windows of one anchor lie side by side; the words they span are one string, and every window is the
   start of one of its suffixes. Equal strings are merged and counted: all the windows of a string that occurs twice are repeated.
3. Subtrees. Strings are partitioned by the anchor's words, the prefix that all their suffixes must share. In memory-sized batches
   of prefixes, the suffixes are put in order by prefix doubling; each run of suffixes that agree on WINDOW words is an
   internal node of at least that depth, so its leaves are repeats.
4. Variable length. A prefix with more than GROUP strings is lengthened to the next of PREFIXES: its strings are cut at anchors of that many words
   and go through steps 2 and 3 again. The last length is the whole window; strings of one such prefix are all equal.
5. Repeats go back to their texts and become spans of words; overlapping spans join into maximal ones.

What occurs often is merged where it is read, block by block, before it is shuffled: a text, a group of words or a string is one row
a block however often the block holds it, so no key gathers more rows than there are blocks.

Texts are handled once each, whatever their number of copies; a text that occurs twice or more is all repeat if it has a
window. Null texts have no words; an empty table gives an empty result. Long texts are whole; what a task holds is a block of texts and one
batch of strings. Repeated rows get equal results; columns of docs may have any names, those that begin with ``__sub_`` excepted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches, drop, settle, stage
from rostra.plans.size import if_small

WINDOW = 35
#: Lengths of the prefixes that strings are partitioned by, the last being the whole window.
PREFIXES = (12, 24, WINDOW)
#: Most rows of one prefix that are gathered; words of one batch of prefixes.
GROUP, BATCH_WORDS = 1_000, 600_000
#: What a task merges before it is shuffled: anchors, distinct texts, and bytes of text and strings.
BLOCK_ANCHORS, BLOCK_KEYS, BLOCK_BYTES = 1 << 20, 1 << 20, 32 << 20

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(words: list[bytes], window: int = WINDOW, gram: int = PREFIXES[0]) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window's anchor, hashes of all gram-word groups)."""
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = h[: n - gram + 1].copy()
    for k in range(1, gram):
        grams *= _BASE
        grams += h[k : n - gram + 1 + k]
    grams ^= grams >> np.uint64(32)
    grams *= _MIX
    grams ^= grams >> np.uint64(32)
    inside = window - gram + 1
    places = []
    for at in range(0, n - window + 1, 1 << 16):  # in slices, to bound the view's temporaries
        part = grams[at : at + (1 << 16) + inside - 1]
        part = part[: min(len(part), n - window + 1 - at + inside - 1)]
        places.append(np.lib.stride_tricks.sliding_window_view(part, inside).argmin(axis=1) + np.arange(at, at + len(part) - inside + 1))
    return np.concatenate(places), grams


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each anchor, from the anchors of consecutive windows."""
    cuts = np.flatnonzero(places[1:] != places[:-1]) + 1
    first = np.concatenate([[0], cuts])
    return places[first], first, np.concatenate([cuts, [len(places)]]) - 1


def repeated_starts(strings: list[list[int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each string of word numbers, whether the window at each start occurs again among all of them.

    The suffixes' ranks by their first 1, 2, 4, ... words, up to window, are those of the suffix tree's nodes at that depth.
    """
    lengths = np.array([len(s) for s in strings])
    flat = np.concatenate([np.array(s, np.int64) for s in strings]) + 1
    rank, depth = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < window:
        step = min(depth, window - depth)  # the last step overlaps
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    ends = np.cumsum(lengths)
    inside = np.ones(len(flat), bool)
    for k in range(1, window):
        own = ends - k
        inside[own[lengths >= k]] = False  # suffixes shorter than a window reach into the next string
    counts = np.bincount(rank[inside], minlength=len(rank) + 2)
    again = inside & (counts[rank] > 1)
    return [again[end - length : max(end - length, end - window + 1)] for end, length in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _mask(flags: np.ndarray) -> int:
    return sum(1 << k for k in np.flatnonzero(flags).tolist())


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


# --- anchors that occur twice --------------------------------------------------------------------------------------

_ANCHORS = "route long, gram long, k1 long, sure boolean"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of texts (k1, k2, text), block by block, dealt by ``route``.

    A group of words that a block's texts hold once is a row (gram, gram, text, false). One held twice is sure to be shared: a row
    (text, gram, text, true) for each of its texts, and one (gram, gram, null, true) that tells the other blocks.
    """
    grams, texts, size, seen = [], [], 0, set()

    def block() -> pa.RecordBatch:
        g, t = np.concatenate(grams), np.concatenate(texts)
        order = np.lexsort((t, g))
        g, t = g[order], t[order]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        starts = np.flatnonzero(first)
        again = np.repeat(np.diff(np.append(starts, len(g))) > 1, np.diff(np.append(starts, len(g))))
        pair = again & (first | np.concatenate([[True], t[1:] != t[:-1]]))
        mark = again & first
        parts = (~again, pair, mark)
        route = np.concatenate([g[parts[0]], t[pair], g[mark]])
        nulls = np.concatenate([np.zeros(int((~again).sum() + pair.sum()), bool), np.ones(int(mark.sum()), bool)])
        columns = [route, np.concatenate([g[p] for p in parts]), pa.array(np.concatenate([t[p] for p in parts]), mask=nulls), np.concatenate([np.full(int(p.sum()), k > 0) for k, p in enumerate(parts)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["route", "gram", "k1", "sure"])

    for batch in batches:
        for k1, k2, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            where, hashes = anchors(text.split())
            if len(where):
                own = hashes[runs(where)[0]].view(np.int64)
                grams.append(own)
                texts.append(np.full(len(own), k1))
                size += len(own)
            if size >= BLOCK_ANCHORS or len(seen) >= BLOCK_KEYS:
                if grams:
                    yield block()
                grams, texts, size, seen = [], [], 0, set()
    if grams:
        yield block()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, gram) of the rows of _find_anchors, in order of route, whose words are in two texts or are sure to be shared."""

    def told(route: np.ndarray, k1: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of whole runs of one route, the rows to tell."""
        starts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        several = np.minimum.reduceat(k1, starts) != np.maximum.reduceat(k1, starts)
        return np.repeat(several, np.diff(np.append(starts, len(route)))) & known

    held: list[np.ndarray] = []
    for batch in batches:
        route, gram, sure = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        k1 = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        done = sure & known
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(k1[done]), pa.array(gram[done])], names=["k1", "gram"])
        own = [x[~done] for x in (route, k1, known)]
        own[1] = np.where(own[2], own[1], ~own[0])  # a marker counts as a text of its own
        held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if cut:
                tell = told(*(x[:cut] for x in held))
                yield pa.RecordBatch.from_arrays([pa.array(held[1][:cut][tell]), pa.array(held[0][:cut][tell])], names=["k1", "gram"])
                held = [x[cut:] for x in held]
    if held and len(held[0]):
        tell = told(*held)
        yield pa.RecordBatch.from_arrays([pa.array(held[1][tell]), pa.array(held[0][tell])], names=["k1", "gram"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each distinct text (k1, k2, text) of a block at most two rows, the second without its text."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        if len(seen) >= BLOCK_KEYS:
            seen = {}
        times = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            times.append(n := seen.get(key, 0))
            seen[key] = min(n + 1, 2)
        n = np.array(times)
        kept = batch.filter(pa.array(n < 2))
        text = pc.if_else(pa.array(n[n < 2] == 0), kept.column(2).cast(pa.binary()), pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), text, pa.nulls(len(text), pa.int64())], names=["k1", "k2", "text", "gram"])


# --- strings -------------------------------------------------------------------------------------------------------

_ITEMS = pa.list_(pa.struct([("string_id", pa.binary()), ("first", pa.int32()), ("windows", pa.int64())]))
_STRINGS = "gram long, string_id binary, string binary, n long"
_CUTS = f"k1 long, k2 long, parent binary, n_words int, whole boolean, text binary, kept_sha256 string, items array<struct<string_id:binary,first:int,windows:long>>, {_STRINGS}"
_OWNER = {"k1": pa.int64(), "k2": pa.int64(), "parent": pa.binary(), "n_words": pa.int32(), "whole": pa.bool_(), "text": pa.binary(), "kept_sha256": pa.string(), "items": _ITEMS}
_STRING = {"gram": pa.int64(), "string_id": pa.binary(), "string": pa.binary(), "n": pa.int64()}


class _Block:
    """Rows of texts with their strings, and the block's distinct strings, each once with its number of occurrences."""

    def __init__(self, gram: int):
        self.gram, self.owners, self.strings, self.size = gram, [], {}, 0

    def add(self, owner: dict, words: list[bytes], shared: set[int] | None, n: int = 1) -> None:
        """owner with the strings of its words whose anchors are in ``shared`` (None: all)."""
        items = []
        where, hashes = anchors(words, gram=self.gram)
        for place, first, last in zip(*(x.tolist() for x in runs(where)), strict=True) if len(where) else ():
            gram = int(hashes[place].view(np.int64))
            if shared is None or gram in shared:
                string = b" ".join(words[first : last + WINDOW])
                key = hashlib.blake2b(b"%d " % (place - first) + string, digest_size=16).digest()
                items.append((key, first, last - first + 1))
                held = self.strings.get(key)
                if held:
                    held[2] += n
                else:
                    self.strings[key] = [gram, string, n]
                    self.size += len(string)
        self.owners.append((owner, items))
        self.size += len(owner.get("text") or b"")

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was added: rows of owners, then rows of strings. The windows of a string that occurs twice are all repeats."""
        every = lambda key, n: (1 << n) - 1 if self.strings[key][2] > 1 else None
        filled = {k: [o.get(k) for o, _ in self.owners] for k in _OWNER if k != "items"}
        filled["items"] = [[{"string_id": key, "first": first, "windows": every(key, n)} for key, first, n in items] for _, items in self.owners]
        made = {"gram": [v[0] for v in self.strings.values()], "string_id": list(self.strings), "string": [v[1] for v in self.strings.values()], "n": [v[2] for v in self.strings.values()]}
        for own, size in ((filled, len(self.owners)), (made, len(self.strings))):
            if size:
                columns = {k: pa.array(own[k], t) if k in own else pa.nulls(size, t) for k, t in (_OWNER | _STRING).items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        self.owners, self.strings, self.size = [], {}, 0


def _find_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (k1, k2, text, gram) in order of k1 and k2, shared word groups first: each distinct text, settled (kept_sha256 given) if
    it is all repeat or has no shared anchor, else with its strings; and the strings."""
    block, at, shared = _Block(PREFIXES[0]), None, set()
    key, text, copies = None, None, 0

    def finish() -> None:
        words = text.split()
        whole = copies > 1 and len(words) >= WINDOW
        owner = {"k1": key[0], "k2": key[1], "n_words": len(words), "whole": whole}
        settled = {"kept_sha256": hashlib.sha256(b"" if whole else b" ".join(words)).hexdigest()} if whole or not shared else {"text": text}
        block.add(owner | settled, words if shared else [], shared)

    for batch in batches:
        for k1, k2, own, gram in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key is not None and (k1, k2) != key:
                finish()
                key, text, copies = None, None, 0
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
            if k1 != at:
                at, shared = k1, set()
            if gram is not None:
                shared.add(gram)
            else:
                key, text, copies = (k1, k2), own if text is None else text, copies + 1
    if key is not None:
        finish()
    yield from block.rows()


def _recut(gram: int):
    """From strings (string_id, string, n), their strings by anchors of ``gram`` words, as _find_strings gives those of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(gram)
        for batch in batches:
            for string_id, string, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block.add({"parent": string_id}, string.split(), None, n)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
        yield from block.rows()

    return run


# --- subtrees ------------------------------------------------------------------------------------------------------


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (gram, string_id, string, n) in order of gram and string_id, (string_id, windows): a bit for each repeated window."""
    ids: list[bytes] = []
    strings: list[list[int]] = []
    counts: list[int] = []
    numbers: dict[bytes, int] = {}
    size, gram = 0, None

    def done() -> pa.RecordBatch:
        flags = repeated_starts(strings)
        masks = [(1 << len(f)) - 1 if n > 1 else _mask(f) for f, n in zip(flags, counts, strict=True)]
        kept = [k for k, m in enumerate(masks) if m]
        return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in kept], pa.binary()), pa.array([masks[k] for k in kept], pa.int64())], names=["string_id", "windows"])

    for batch in batches:
        for own, string_id, string, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own == gram and string_id == ids[-1]:
                counts[-1] += n
                continue
            if size >= BATCH_WORDS and own != gram:
                yield done()
                ids, strings, counts, numbers, size = [], [], [], {}, 0
            gram = own
            words = string.split()
            ids.append(string_id)
            counts.append(n)
            strings.append([numbers.setdefault(w, len(numbers)) for w in words])
            size += len(words)
    if ids:
        yield done()


def _repeated(strings: DataFrame, lengths: tuple[int, ...] = PREFIXES[1:]) -> DataFrame:
    """(string_id, windows) of the strings (gram, string_id, string, n): a bit for each repeated window. lengths: what prefixes may grow to."""
    rows = strings.select("gram", "string_id", "string", "n")
    trees = lambda own: own.repartition("gram").sortWithinPartitions("gram", "string_id").mapInArrow(_subtrees, "string_id binary, windows long")
    if not lengths:
        return trees(rows)
    crowded = stage(rows.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("gram"), "crowded")
    if crowded.isEmpty():
        return trees(rows)
    hot = if_small(crowded)
    cut = stage(rows.join(hot, "gram", "left_semi").select("string_id", "string", "n").mapInArrow(_recut(lengths[0]), _CUTS), "recut")
    parts = cut.where("parent IS NOT NULL").select("parent", F.explode("items").alias("i")).select("parent", "i.*")
    below = _repeated(cut.where("string_id IS NOT NULL"), lengths[1:]).withColumnRenamed("windows", "found")
    sure = parts.where("windows IS NOT NULL").select("parent", "first", "windows")
    open_ = parts.where("windows IS NULL").drop("windows").join(below, "string_id").select("parent", "first", F.col("found").alias("windows"))
    longer = sure.union(open_).groupBy(F.col("parent").alias("string_id")).agg(F.expr("bit_or(shiftleft(windows, first))").alias("windows"))
    return trees(rows.join(hot, "gram", "left_anti")).union(longer)


def covered(n_words: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans [start, end) of the words that the windows (first, bits) cover."""
    delta = np.zeros(n_words + 1, np.int64)
    for first, bits in found:
        for k in range(bits.bit_length()):
            if bits >> k & 1:
                delta[first + k] += 1
                delta[first + k + WINDOW] -= 1
    inside = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and kept text of the texts (k1, k2, n_words, whole, text, kept_sha256, items, found)."""
    for batch in batches:
        spans, removed, kept = [], [], []
        for n, whole, text, sha, items, found in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
            held = [(f["first"], f["windows"]) for f in [*(items or ()), *(found or ())] if f["windows"]]
            own = [(0, n)] if whole else covered(n, held) if held else []
            spans.append([{"start": a, "end": z} for a, z in own])
            removed.append(sum(z - a for a, z in own))
            if sha is None:
                words = text.split()
                rest = [w for (_, a), (z, _) in zip([(0, 0), *own], [*own, (len(words), 0)], strict=True) for w in words[a:z]]
                sha = hashlib.sha256(b" ".join(rest)).hexdigest()
            kept.append(sha)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int32()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], names=["k1", "k2", "n_words", "n_removed", "spans", "kept_sha256"]
        )


def repeats(docs: DataFrame) -> DataFrame:
    """(k1, k2, n_words, n_removed, spans, kept_sha256) of each distinct text, named by two 64-bit hashes (see _keyed)."""
    spark = docs.sparkSession
    bound_batches(spark)
    keyed = _keyed(docs).select("k1", "k2", "text")
    dealt = keyed.mapInArrow(_find_anchors, _ANCHORS).repartition("route").sortWithinPartitions("route")
    shared = stage(dealt.mapInArrow(_shared, "k1 long, gram long"), "shared")
    del dealt
    settle(spark)
    texts = keyed.mapInArrow(_once, "k1 long, k2 long, text binary, gram long")
    both = texts.union(shared.select("k1", F.lit(None).cast("long"), F.lit(None).cast("binary"), "gram"))
    cut = stage(both.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_find_strings, _CUTS), "strings")
    del texts, both
    drop(shared)
    settle(spark)

    owners = cut.where("k1 IS NOT NULL")
    items = owners.where("kept_sha256 IS NULL").select("k1", "k2", F.explode("items").alias("i")).where("i.windows IS NULL").select("k1", "k2", "i.string_id", "i.first")
    windows = _repeated(cut.where("string_id IS NOT NULL"))
    found = items.join(windows, "string_id").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "windows")).alias("found"))
    found = stage(found, "found")
    del items, windows
    settle(spark)
    wanted = ["k1", "k2", "n_words", "whole", "text", "kept_sha256", "items"]
    # Only texts with strings of their own meet what was found; settled ones don't move.
    none = F.lit(None).cast("array<struct<first:int,windows:long>>").alias("found")
    settled = owners.where("kept_sha256 IS NOT NULL").select(*wanted, none)
    every = settled.union(owners.where("kept_sha256 IS NULL").select(*wanted).join(found, ["k1", "k2"], "left").select(*wanted, "found"))
    return every.mapInArrow(_cut, "k1 long, k2 long, n_words int, n_removed int, spans array<struct<start:int,end:int>>, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256) of every row of docs."""
    found = repeats(docs)
    return _keyed(docs).select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "spans", "kept_sha256")


def remove(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the kept words of each text joined by blanks (null texts become empty)."""
    found = repeats(docs).select(F.col("k1").alias("__sub_f1"), F.col("k2").alias("__sub_f2"), F.col("spans").alias("__sub_spans"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__sub_k1": F.xxhash64(text), "__sub_k2": F.xxhash64(F.lit(1), text)})
    joined = keyed.join(found, (F.col("__sub_k1") == F.col("__sub_f1")) & (F.col("__sub_k2") == F.col("__sub_f2")))

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
            words, gone = (text or b"").split(), [(s["start"], s["end"]) for s in own]
            out.append(b" ".join(w for (_, a), (z, _) in zip([(0, 0), *gone], [*gone, (len(words), 0)], strict=True) for w in words[a:z]).decode())
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    cut = joined.withColumn("__sub_kept", F.arrow_udf(run, "string")("text", "__sub_spans"))
    return cut.select(*[F.col("__sub_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns])
