import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rostra.llm import simhash as S
from tests.llm.data import docs, texts


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius=2):
    up = list(range(len(values)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(values))]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", low) if w]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def near_groups(found, least=0.8):
    """The first place of each place's group: places linked where the share of common shingles is high enough."""
    sets, up, holders = [shingles(t) for t in found], list(range(len(found))), defaultdict(list)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, own in enumerate(sets):
        for j in {j for s in own for j in holders[s]} if own else holders[None]:
            if not own or len(own & sets[j]) >= least * len(own | sets[j]):
                a, b = top(j), top(k)
                up[max(a, b)] = min(a, b)
        for s in own or [None]:
            holders[s].append(k)
    return [top(k) for k in range(len(found))]


def test_fingerprint():
    for _, text in texts():
        assert S.fingerprint((text or "").encode()) == brute(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = S.BKTree(values[0])
    for v in values[1:] + values[:5]:
        tree.add(v)
    assert len(tree.values) == len(values)
    for v in values[:40]:
        assert {tree.values[k] for k in tree.near(v, 2)} == {x for x in values if (x ^ v).bit_count() <= 2}


@pytest.mark.parametrize("shard", [4, S.SHARD])
def test_links_and_components(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values[:20]):
        for _ in range(6):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.append(v)
    values += [values[0] ^ 1 << b for b in range(30)]
    values = list(dict.fromkeys(values))
    signed = [S._signed(v) for v in values]
    roots = {r.node: r.root for r in S.components(S.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want, mine = groups(values), defaultdict(set)
    for v, t in zip(signed, want, strict=True):
        mine[t].add(roots.get(v, v))
    assert all(len(x) == 1 for x in mine.values()) and len(set(map(min, mine.values()))) == len(mine)


def test_groups_and_keep_one(spark):
    rows = texts()
    want = groups([brute(t) for _, t in rows])
    least = {}
    for (i, _), t in zip(rows, want, strict=True):
        least[t] = min([x for x in (least.get(t), i) if x is not None], default=None)
    expected = sorted(((i, least[t]) for (i, _), t in zip(rows, want, strict=True)), key=str)
    got = S.near_groups(docs(spark))
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == expected
    assert S.near_groups(docs(spark, [])).count() == 0 and S.keep_one(docs(spark, [])).count() == 0


def _kept(rows):
    least = {}
    for (i, _), t in zip(rows, near_groups([t for _, t in rows]), strict=True):
        least[t] = min([x for x in (least.get(t), i) if x is not None], default=None)
    return sorted(least.values(), key=str)


def test_keep_one(spark):
    kept = S.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == _kept(texts())


def test_sketches():
    long, other = (" ".join(f"w{k * 7 % n}" for k in range(n)) for n in (9000, 9001))
    for a, b in [("", " "), ("one", "ONE"), ("a b c d e f", "a b c d e g"), (long, other), (long, long + " x y z")]:
        want = len(shingles(a) & shingles(b)) / (len(shingles(a) | shingles(b)) or 1) if a.strip() else 1.0
        got = S.similarity(*(np.frombuffer(S.sketch(t.encode())[1], "<u4") for t in (a, b)))
        assert abs(got - want) < (0.05 if len(a) > 1000 else 1e-9)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_in_hot_shards(spark, monkeypatch):
    """A group of near copies and texts around one passage, both far larger than a shard, and texts of over 1,024 shingles."""
    monkeypatch.setattr(S, "NEAR_SHARD", 8)
    rng = random.Random(7)
    own = [f"x{rng.randrange(5000)}" for _ in range(200)]
    wide = [f"y{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(k, _edited(rng, own, 2)) for k in range(120)]
    rows += [(200 + k, f"{' '.join(own[:60])} {' '.join(str(rng.randrange(10**6)) for _ in range(60))}") for k in range(80)]
    rows += [(400 + k, _edited(rng, wide, 5)) for k in range(6)] + [(500, _edited(rng, wide, 600)), (None, "z")]
    got = S.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == _kept(rows)


def _hashes(rng, n):
    return [rng.getrandbits(32) for _ in range(n)]


def _sets():
    """Chains, near copies and unlike sets around common hashes, sets of few common hashes, and sets cut to SKETCH."""
    rng = random.Random(11)
    common, line, few, wide = _hashes(rng, 40), _hashes(rng, 300), _hashes(rng, 30), _hashes(rng, 2500)
    found = [common + _hashes(rng, 60) for _ in range(40)]
    found += [s[:97] + _hashes(rng, 3) for s in found[:12]]
    found += [line[5 * k : 5 * k + 100] for k in range(40)]  # only neighbours are similar
    found += [rng.sample(few, 18) for _ in range(40)] + [rng.sample(few, 27) for _ in range(6)]
    found += [wide[40 * k : 40 * k + 1500] for k in range(5)] + [_hashes(rng, 1)]
    return [np.unique(np.array(s, "<u4"))[: S.SKETCH] for s in found]


def test_overlaps():
    sets = _sets() + [np.array([], "<u4")]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert ((S.overlaps(sets) == want) | np.eye(len(sets), dtype=bool)).all()


@pytest.mark.parametrize("common_keys", [1, 3])
def test_near_links_lose_no_pair_of_a_hot_shard(spark, monkeypatch, common_keys):
    """All texts share one min-hash (or all), in shards far over their size: groups are those of all pairs."""
    monkeypatch.setattr(S, "NEAR_SHARD", 8)
    sets = _sets()
    order = random.Random(2).sample(range(len(sets)), len(sets))  # a uid tells nothing about a group
    rows = [(uid, uid & 7, [0] * common_keys + [uid * 3 + k for k in range(common_keys, 3)], bytearray(sets[at].tobytes())) for uid, at in enumerate(order)]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, a in enumerate(order):
        for j in range(k):
            if S.similarity(sets[order[j]], sets[a]) >= S.SIMILAR:
                up[max(top(j), top(k))] = min(top(j), top(k))
    links = S.near_links(spark.createDataFrame(rows, "uid long, fp long, keys array<long>, sketch binary"))
    roots = {r.node: r.root for r in S.components(links).collect()}
    assert [roots.get(k, k) for k in range(len(rows))] == [top(k) for k in range(len(rows))]
    assert 10 < len({top(k) for k in range(len(rows))}) < len(rows) - 50


def test_similar_links_skip_known_labels():
    sets = _sets()[52:60]  # a chain
    members = [(k, 0 if k < 5 else k, 0, s) for k, s in enumerate(sets)]
    assert S.similar_links(members) == [(k, 0) for k in (5, 6, 7)]
    assert S.similar_links([(k, 0, 0, s) for k, s in enumerate(sets)]) == []
