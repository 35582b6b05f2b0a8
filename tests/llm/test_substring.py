import hashlib
import random
from collections import Counter

import pytest

from rostra.llm import substring as S
from tests.llm.data import docs, texts


def brute(rows, w=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(x[k : k + w]) for x in words for k in range(len(x) - w + 1))
    out = []
    for (i, _), x in zip(rows, words, strict=True):
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if seen[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        out.append((i, len(x), sum(gone), hashlib.sha256(b" ".join(v for v, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.report(docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def rough(seed):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(3000)}" for _ in range(rng.choice([34, 35, 36, 60, 200]))] for _ in range(12)]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(0, max(1, len(b) - 30))
            parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 25))] + b[a : a + rng.randrange(20, 80)]
        rows.append((k, " ".join(parts)))
    return rows + rows[:3] + [(100, " ".join(["x y"] * 60)), (101, " ".join(["same"] * 36)), (102, " ".join(["same"] * 35))]


@pytest.mark.parametrize("group", [2, S.GROUP])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)  # 2: prefixes grow to the whole window
    check(spark, texts())
    check(spark, rough(1))


def test_blocks_and_batches(monkeypatch):
    """The steps by themselves, with blocks and batches of a few rows."""
    import pyarrow as pa

    for name, value in (("BATCH_WORDS", 200), ("BLOCK_ANCHORS", 5), ("BLOCK_KEYS", 3), ("BLOCK_BYTES", 400)):
        monkeypatch.setattr(S, name, value)
    rows = rough(3)
    keyed = [(hash(t) >> 3, hash(t) >> 5, t.encode()) for _, t in rows]
    batches = lambda own, kinds, size=7: [pa.RecordBatch.from_arrays([pa.array([r[k] for r in own[at : at + size]], t) for k, t in enumerate(kinds)], names=[str(k) for k in range(len(kinds))]) for at in range(0, len(own), size)]
    rows_of = lambda made: [tuple(r.values()) for b in made for r in b.to_pylist()]
    long, binary = pa.int64(), pa.binary()
    found = sorted(rows_of(S._find_anchors(batches(keyed, (long, long, binary)))), key=lambda r: r[0])
    shared = set(rows_of(S._shared(batches(found, (long, long, long, pa.bool_())))))
    grams = {}
    for k1, _, text in set(keyed):
        where, hashes = S.anchors(text.split())
        for g in hashes[S.runs(where)[0]].view("int64").tolist() if len(where) else ():
            grams.setdefault(g, []).append(k1)
    assert shared == {(k1, g) for g, own in grams.items() if len(own) > 1 for k1 in own}
    once = rows_of(S._once(batches(keyed, (long, long, binary))))
    both = sorted(once + [(k1, None, None, g) for k1, g in shared], key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    cut = [r for b in S._find_strings(batches(both, (long, long, binary, long))) for r in b.to_pylist()]
    strings = sorted((r["gram"], r["string_id"], r["string"], r["n"]) for r in cut if r["string_id"])
    windows = {}
    for key, bits in rows_of(S._subtrees(batches(strings, (long, binary, binary, long)))):
        assert windows.setdefault(key, bits) == bits
    removed = {}
    for r in cut:
        if r["k1"] is not None:
            held = [(i["first"], i["windows"] or windows.get(i["string_id"], 0)) for i in r["items"]]
            removed[r["k1"]] = r["n_words"] if r["whole"] else sum(z - a for a, z in S.covered(r["n_words"], held))
    expected = {hash(t) >> 3: n for (i, t) in rows for j, _, n, _ in brute(rows) if i == j}
    assert removed == expected


def test_very_long_text():
    """Over 65,536 windows, so that anchors come slice by slice."""
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(50) for _ in range(140_000)]
    where, hashes = S.anchors(words)
    inside = S.WINDOW - S.PREFIXES[0] + 1
    assert len(where) == len(words) - S.WINDOW + 1
    for at in (0, 1, 65_535, 65_536, 65_537, 131_071, 131_072, len(where) - 1):
        own = hashes[at : at + inside]
        assert where[at] == at + min(range(inside), key=lambda k: (own[k], k))


def test_many_blocks(spark):
    """Copies and passages spread over more partitions than there are texts of some."""
    rows = rough(4) * 2 + [(500 + k, " ".join(f"c{j}" for j in range(60)) + f" t{k}") for k in range(40)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.report(docs(spark, rows).repartition(9)).collect()), key=str)
    assert got == brute(rows)


def test_remove_and_empty(spark):
    rows = rough(2)
    kept = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in S.remove(docs(spark, rows)).collect()}
    assert kept == {(i, sha) for i, _, _, sha in brute(rows)}
    assert S.remove(docs(spark)).columns == docs(spark).columns
    check(spark, [])
    check(spark, [(1, None), (2, "")])
