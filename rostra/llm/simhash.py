"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming radius through BK-trees.

A text's words (split at ASCII white space, A-Z lower-cased) form 3-word shingles, repeats included; a text of fewer words
is one shingle; one without words has fingerprint zero and links like any other. A bit is set if it is set in over half of
the shingles' XXH64 hashes.

Fingerprints are first made distinct, so copies cost nothing from there on. The search is sharded by pigeonhole: with
radius 2, two linked fingerprints agree on at least three of five bit blocks, so every link lies within a shard of
fingerprints that share three blocks (ten ways to choose them). Each shard is a BK-tree whose edges carry the integer
distance to the parent; a search follows only the edges within the radius. A shard over SHARD entries is split the same way on its remaining
bits, twice at most: 52 bits or more are then shared, so it holds at most 4,096 distinct fingerprints and no input can
make a tree outgrow a task. The trees travel by key instead of being broadcast, since all trees together grow with the corpus.

near_groups() links fingerprints and nothing else. keep_one() drops near copies: at a similarity of 0.8 fingerprints lie up to some 16 bits apart, too far for
pigeonhole shards, so it shards by min-hashes instead, searches the same trees with that radius and verifies by shingles.

Links become components by alternating large-star and small-star steps on tables in the shared folder.
Null and empty texts: fingerprint zero. Repeated rows and equal texts get equal results. A null doc_id is never the
smallest of its component unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.members import among, members
from rostra.llm.staging import bound_batches, scratch, settle, stage

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Largest shard that is searched without splitting it further.
SHARD = 2048
_ALL = (1 << 64) - 1
_CHUNK = 1 << 16
#: Near copies: words of a shingle, least similarity, bits within which they are searched, min-hashes, hashes kept, distinct texts searched together.
NEAR_WORDS, SIMILAR, NEAR_BITS, KEYS, SKETCH, NEAR_SHARD = 5, 0.8, 16, 3, 1024, 512
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins, ends = (ends - lengths)[: -(SHINGLE - 1)].tolist(), ends[SHINGLE - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text as a (signed) long."""
    bound_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(column, F.arrow_udf(run, "long")(F.col("text")))


class BKTree:
    """Distinct 64-bit values; each child hangs on the edge of its Hamming distance to the parent."""

    def __init__(self, root: int):
        self.values, self.edges = [root], [{}]

    def add(self, value: int) -> None:
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            below = self.edges[at].get(d)
            if below is None:
                self.edges[at][d] = len(self.values)
                self.values.append(value)
                self.edges.append({})
                return
            at = below

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius; only edges of distance d - radius to d + radius are followed."""
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.edges[at].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct values: (value, smallest of its linked group), as few as connect it."""
    tree, up = BKTree(values[0]), list(range(len(values)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, value in enumerate(values[1:], 1):
        for near in tree.near(value, radius):
            a, b = top(near), top(k)
            up[max(a, b)] = min(a, b)
        tree.add(value)
    return [(value, values[top(k)]) for k, value in enumerate(values) if top(k) != k]


def _split(mask: int, parts: int) -> list[int]:
    """The bits outside mask, in parts runs of nearly equal size."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in rest[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[dict[int, list[int]]]:
    """By level: the masks a shard of each mask of the level before is split into; level 0 splits the whole."""
    blocks = _split(0, 5)
    levels = [{0: [sum(c) for c in combinations(blocks, 3)]}]
    for _ in range(2):
        levels.append({m: [m | part for part in _split(m, RADIUS + 1)] for own in levels[-1].values() for m in own})
    return levels


def _shard_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (mask, value, fp) in order, the links of each shard; a shard may reach over batches."""
    held = [np.empty(0, np.int64)] * 3

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        masks, values, fps = columns
        cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (values[1:] != values[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(fps)]
        unsigned = fps.view(np.uint64).tolist()
        found: list[tuple[int, int]] = []
        for a, z in zip(bounds, bounds[1:], strict=False):
            if z - a == 2:
                if (unsigned[a] ^ unsigned[a + 1]).bit_count() <= RADIUS:
                    found.append((unsigned[a + 1], unsigned[a]))
            elif z - a > 2:
                found += shard_links(unsigned[a:z])
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        masks, values, _ = held
        last = np.flatnonzero((masks != masks[-1]) | (values != values[-1])) if len(masks) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links([h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield links(held)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) within the radius of each other."""
    levels, found = _masks(), []
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for depth, table in enumerate(levels):
        narrower = F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else x for m, own in table.items() for x in (_signed(m), F.array(*[F.lit(_signed(c)).cast("long") for c in own]))])
        keyed = rows.select("fp", F.explode(narrower[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = keyed if depth == 0 else keyed.distinct()  # shards of several levels may meet
        sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1")
        small = sizes if depth == len(levels) - 1 else sizes.where(F.col("size") <= SHARD)
        ready = keyed.join(small, ["mask", "value"]).select("mask", "value", "fp")
        found.append(ready.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_shard_edges, "u long, v long"))
        if depth < len(levels) - 1:
            rows = keyed.join(sizes.where(F.col("size") > SHARD), ["mask", "value"]).select("fp", "mask")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable. Roots list themselves too."""
    edges = stage(edges, "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of docs; root is the component's smallest fingerprint."""
    rows = stage(fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def sketch(text: bytes) -> tuple[list[int], bytes]:
    """Min-hashes of the text's distinct NEAR_WORDS-word shingles, and the SKETCH smallest of their 32-bit hashes (all, where there are fewer)."""
    words = text.lower().split()
    if not words:
        return [0] * KEYS, b""
    joined, at = b" ".join(words), [0]
    for word in words:
        at.append(at[-1] + len(word) + 1)
    last = max(len(words) - NEAR_WORDS + 1, 1)
    hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[at[k] : at[min(k + NEAR_WORDS, len(words))] - 1], SEED) for k in range(last)), np.uint64, last))
    keys = []
    for factor in _FACTORS:
        mixed = hashes * factor
        mixed = (mixed ^ mixed >> np.uint64(31)) * _FACTORS[0]
        keys.append(int(mixed.min().view(np.int64)))
    return keys, np.unique((hashes >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sketches: of the whole sets where both are whole, else by the smallest hashes of the union."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = len(a) + len(b) - len(both)
    if max(len(a), len(b)) < SKETCH:
        return len(both) / union if union else 1.0
    low = np.union1d(a, b)[:SKETCH]
    return int(np.searchsorted(both, low[-1], side="right")) / len(low)


def overlaps(sketches: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sketches have in common, by products of 0/1 matrices over the hashes that two or more hold."""
    rows = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    values, at, counts = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    wanted = counts[at] > 1
    rows, columns = rows[wanted], place[at[wanted]]
    order = np.argsort(columns, kind="stable")
    rows, columns, total = rows[order], columns[order], np.zeros((len(sketches), len(sketches)), np.float32)
    for low in range(0, int((counts > 1).sum()), 4096):
        a, z = np.searchsorted(columns, [low, low + 4096])
        part = np.zeros((len(sketches), 4096), np.float32)
        part[rows[a:z], columns[a:z] - low] = 1
        total += part @ part.T
    return total


def _sketched(rows: DataFrame) -> DataFrame:
    """rows with fp, keys and sketch of each whole text, in one pass."""
    bound_batches(rows.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        plain = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        made = [sketch(t) for t in plain]
        fps = pa.array(np.array([fingerprint(t) for t in plain], np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([fps, pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([b for _, b in made], pa.binary())], names=["fp", "keys", "sketch"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return rows.withColumn("made", F.arrow_udf(run, "struct<fp: bigint, keys: array<bigint>, sketch: binary>")(F.col("text"))).select("uid", "doc_id", "made.*")


def similar_links(members: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """From one shard's (uid, label, fingerprint, sketch): links (uid, first uid of its group) that connect all similar pairs its BK-tree finds.

    Texts of one label are known to be connected: they aren't compared, and no link between them is given.
    """
    sizes = Counter(label for _, label, _, _ in members)
    members = sorted(members, key=lambda m: -sizes[m[1]])  # the largest label comes first and needs no search
    first: dict[int, int] = {}
    up, tree, of = [first.setdefault(label, k) for k, (_, label, _, _) in enumerate(members)], None, {}
    common, asked, alone = None, 0, sum(k == 0 for k in up)

    def alike(a: np.ndarray, b: np.ndarray, j: int, k: int) -> bool:
        """similarity() >= SIMILAR; a shard that asks often counts what all its sketches have in common at once."""
        nonlocal common, asked
        asked += 1
        if common is None and asked > 4 * len(members):
            common = overlaps([m[3] for m in members])
        if common is not None:
            if max(len(a), len(b)) < SKETCH:
                both = int(common[j, k])
                union = len(a) + len(b) - both
                return not union or both / union >= SIMILAR
            if common[j, k] < SIMILAR * SKETCH:
                return False
        return similarity(a, b) >= SIMILAR

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, (_, _, value, own) in enumerate(members):
        if tree is None:
            tree = BKTree(value)
        for place in tree.near(value, NEAR_BITS) if k >= alone else ():
            for other in of.get(tree.values[place], ()):
                a, b = top(other), top(k)
                if a != b and alike(members[other][3], own, other, k):
                    up[max(a, b)] = min(a, b)
        tree.add(value)
        of.setdefault(value, []).append(k)
    return [(members[k][0], members[top(k)][0]) for k in range(len(members)) if members[top(k)][1] != members[k][1]]


def _similar_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (base, shard, uid, label, fp, sketch) in order of shard, the links (base, u, v) within each shard."""
    held, now, out = [], None, []

    def close() -> None:
        if len(held) > 1:
            out.extend((now[0], u, v) for u, v in similar_links(held))
        held.clear()

    def taken() -> pa.RecordBatch:
        rows = pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())
        out.clear()
        return pa.RecordBatch.from_arrays(list(rows), names=["base", "u", "v"])

    for batch in batches:
        for base, shard, uid, label, fp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (base, shard) != now:
                close()
                now = (base, shard)
            held.append((uid, label, fp & _ALL, np.frombuffer(data, "<u4")))
        yield taken()
    close()
    yield taken()


def _searched(places: DataFrame, classes: DataFrame) -> DataFrame:
    """(base, u, v): links found in the shards of places (base, shard, uid, label), each held by a task as a whole."""
    rows = places.join(classes.select("uid", "fp", "sketch"), "uid").select("base", "shard", "uid", "label", "fp", "sketch")
    return stage(rows.repartition("base", "shard").sortWithinPartitions("base", "shard", "uid").mapInArrow(_similar_edges, "base long, u long, v long"), "near")


def _shards(classes: DataFrame) -> DataFrame:
    """(base, uid, size): the min-hash shards of two texts or more."""
    rows = classes.select("uid", F.posexplode("keys").alias("way", "key")).select("uid", F.xxhash64("way", "key").alias("base"))
    return rows.join(rows.groupBy("base").agg(F.count("*").alias("size")).where("size > 1"), "base").select("base", "uid", "size")


def _neighbours(values: list[int]) -> list[int]:
    """Positions of the fingerprints with another, or an equal one, within NEAR_BITS; found by a BK-tree."""
    if len(values) == 2:
        return [0, 1] if (values[0] ^ values[1]).bit_count() <= NEAR_BITS else []
    tree, hit = BKTree(values[0]), set()
    for value in values[1:]:
        if near := tree.near(value, NEAR_BITS):
            hit.add(value)
            hit.update(tree.values[at] for at in near)
        tree.add(value)
    return [k for k, value in enumerate(values) if value in hit]


def _near_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (base, uid, fp) in order of base, the (base, uid) of those with a neighbour in their base; a base may reach over batches."""
    held = [np.empty(0, np.int64)] * 3

    def near(columns: list[np.ndarray]) -> pa.RecordBatch:
        bases, uids, fps = columns
        bounds = [0, *(np.flatnonzero(bases[1:] != bases[:-1]) + 1).tolist(), len(bases)]
        unsigned = fps.view(np.uint64).tolist()
        found = np.array([a + k for a, z in zip(bounds, bounds[1:], strict=False) if z - a > 1 for k in _neighbours(unsigned[a:z])], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bases[found]), pa.array(uids[found])], names=["base", "uid"])

    for batch in batches:
        held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        last = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield near([h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield near(held)


def _near_shards(classes: DataFrame) -> DataFrame:
    """(base, uid, size): the min-hash shards, staged; those of at most NEAR_SHARD texts without the texts that no other's fingerprint is near to."""
    places = stage(_shards(classes), "shards")
    rows = places.where(F.col("size") <= NEAR_SHARD).join(classes.select("uid", "fp"), "uid").select("base", "uid", "fp")
    near = stage(rows.repartition("base").sortWithinPartitions("base").mapInArrow(_near_places, "base long, uid long"), "shards")
    left = near.join(near.groupBy("base").agg(F.count("*").alias("size")), "base").select("base", "uid", "size")
    return stage(left.union(places.where(F.col("size") > NEAR_SHARD)), "shards")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (uid, sketch), a row (uid, n, token) for each of a sketch's n hashes."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            uids, sketches = (c.slice(at, 256).to_pylist() for c in batch.columns)
            sizes = [len(x) // 4 for x in sketches]
            tokens = np.frombuffer(b"".join(sketches), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(uids, np.int64), sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(tokens)], names=["uid", "n", "token"])


def _prefixes(texts: DataFrame) -> DataFrame:
    """(uid, token): each text's rarest hashes, so many that any two texts (uid, sketch) of SIMILAR or more have one in common.

    Such sketches share SIMILAR of the larger one at least, hence one of the first n - SIMILAR * n + 1 hashes of each in any order common to all.
    The order is by rarity among the texts; a hash of one text takes a place there but links nothing.
    """
    tokens = texts.select("uid", "sketch").mapInArrow(_tokens, "uid long, n long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared, "token").groupBy("uid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    places = F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1 - (F.col("n") - F.size("own"))
    return own.select("uid", F.explode(F.slice("own", 1, F.greatest(places, F.lit(0)).cast("int"))).alias("at")).select("uid", F.col("at.token").alias("token"))


def _mixed(places: DataFrame, key: str) -> DataFrame:
    """places (key, uid, label) of the keys whose texts have more than one label, with their number as size."""
    many = places.groupBy(key).agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select(key, "size")
    return places.join(many, key)


def _paired(places: DataFrame) -> DataFrame:
    """(base, shard, uid, label): places (base, uid, label, size) in shards of at most NEAR_SHARD texts that hold every pair of different labels of a base.

    A larger base is cut into blocks of half a shard in order of label, and each two of them make a shard, unless both hold one and the same label.
    """
    small = places.where(F.col("size") <= NEAR_SHARD).select("base", F.lit(0).cast("long").alias("shard"), "uid", "label")
    order = F.row_number().over(Window.partitionBy("base").orderBy("label", "uid")) - 1
    cut = places.where(F.col("size") > NEAR_SHARD).select("base", "uid", "label", F.floor(order / max(NEAR_SHARD // 2, 1)).alias("block"))
    blocks = cut.groupBy("base", "block").agg(F.min("label").alias("a"), F.max("label").alias("z"))
    other = blocks.select("base", F.col("block").alias("block2"), F.col("a").alias("a2"), F.col("z").alias("z2"))
    pairs = blocks.join(other, "base").where("block <= block2 AND (a <> z2 OR z <> a2)")
    sides = pairs.select("base", F.xxhash64("block", "block2").alias("shard"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return small.union(cut.join(sides, ["base", "block"]).select("base", "shard", "uid", "label"))


def near_links(classes: DataFrame) -> DataFrame:
    """(u, v): verified links that connect all similar texts among distinct ones (uid, fp, keys, sketch) that share a min-hash.

    Fingerprints are searched first, alone: the sketches that are verified, a kilobyte or more each, are moved only where a shard has near ones (or is large).
    A shard over NEAR_SHARD is dealt into chunks first; texts that linked to a smaller one leave, and those that stay meet again in new
    chunks, while that makes a shard smaller by a tenth. This only names most groups. Then every pair of a large shard's texts that aren't connected yet
    is searched, by way of the hashes that similar sketches can't but share (_prefixes), in as many shards as it takes (_paired).
    """
    places, found, turn = _near_shards(classes), None, 0
    classes = stage(among(classes.select("uid", "fp", "sketch"), "uid", members(places, "uid")), "asked")
    hot = places.where(F.col("size") > NEAR_SHARD).select("base", "uid")
    while True:
        chunk = F.pmod(F.xxhash64(F.lit(turn), "uid"), F.ceil(F.col("size") / NEAR_SHARD))
        new = _searched(places.select("base", chunk.alias("shard"), "uid", F.col("uid").alias("label")), classes)
        found = new.select("u", "v") if found is None else found.union(new.select("u", "v"))
        crowded = places.where(F.col("size") > NEAR_SHARD).select("base", "uid")
        rest = crowded.join(new.select("base", F.col("u").alias("uid")), ["base", "uid"], "left_anti")
        left = stage(rest.join(rest.groupBy("base").agg(F.count("*").alias("size")).where("size > 1"), "base").select("base", "uid", "size"), "shards")
        if left.isEmpty() or 10 * left.count() > 9 * crowded.count():
            break
        places, turn = left, turn + 1
    if hot.isEmpty():
        return found.distinct()
    roots = stage(components(found.distinct()), "roots")
    known = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    labelled = hot.join(roots, hot["uid"] == roots["node"], "left").select("base", "uid", F.coalesce("root", "uid").alias("label"))
    open_ = stage(_mixed(labelled, "base").select("uid", "label").distinct(), "open")
    shared = _prefixes(open_.join(classes, "uid").select("uid", "sketch")).join(open_, "uid").select(F.col("token").alias("base"), "uid", "label")
    return known.union(_searched(_paired(stage(_mixed(shared, "base"), "prefixes")), classes).select("u", "v")).distinct()


def _kept(numbered: DataFrame) -> DataFrame:
    """The __near_uid that keep_one() keeps, as a set."""
    with scratch(numbered.sparkSession) as own:
        rows = stage(_sketched(numbered.select(F.col("__near_uid").alias("uid"), "doc_id", "text")), "sketches")
        named = rows.select("uid", "doc_id", F.xxhash64("sketch").alias("h1"), F.xxhash64(F.lit(1), "sketch").alias("h2"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("least")
        texts = stage(named.groupBy("h1", "h2").agg(F.min("uid").alias("uid"), least), "texts")
        distinct = among(rows.select("uid", "fp", "keys", "sketch"), "uid", members(texts, "uid"))
        roots = components(near_links(distinct))
        groups = texts.select("uid", "least").join(roots, texts["uid"] == roots["node"], "left").groupBy(F.coalesce("root", "uid").alias("root"))
        kept = members(groups.agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid")), "uid")
        own.remove(kept.staged_path)
    return kept


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: that of its smallest doc_id (null last), one of equal ids.

    Two texts are near copies if the Jaccard similarity of their distinct NEAR_WORDS-word shingles is SIMILAR or more. They are searched by
    min-hash shards: two such texts share one of the KEYS min-hashes in 99.2 of 100 cases or more. Each shard is a BK-tree of op9's fingerprints searched within
    NEAR_BITS (every pair of a large shard too, see near_links), and what it finds is verified by shingles: all of them below SKETCH, the SKETCH smallest hashes (a standard error of 0.0125) beyond.
    Null and empty texts are copies of each other, so one of them stays; of repeated rows one stays. A very long text is one sketch of at most SKETCH
    hashes. An empty table gives an empty result. Columns may have any names but those that begin with ``__near_`` or ``__member_``.

    Texts aren't shuffled, nor sketches but those of candidates (a table beyond members.MOST_WORDS is, by key); of what is staged only the numbered rows and the kept ones' numbers stay.
    """
    numbered = stage(docs.withColumn("__near_uid", F.monotonically_increasing_id()), "numbered")
    kept = _kept(numbered)
    settle(docs.sparkSession)
    return among(numbered, "__near_uid", kept).select(docs.columns)
