import bisect
import math
import re
import zlib

import numpy as np
import pytest

from rostra.llm import quality, toxicity
from rostra.llm import queries as Q
from tests.llm.data import docs, texts

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label, at):
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    own = [(got[r.doc_id].predicted, r[label]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= at) for i, r in got.items())
    return np.mean([a == b for a, b in own]), np.mean([b for _, b in own])


def test_quality_on_held_out_rows(spark):
    accuracy, share = held_out(spark, Q.op2_bradley_terry_quality, "quality", 0.5)
    assert accuracy > 0.98 > max(share, 1 - share)


def test_toxicity_on_held_out_rows(spark):
    accuracy, share = held_out(spark, Q.op8_ftrl_toxicity, "toxic", toxicity.REJECT_AT)
    assert accuracy > 0.95 > max(share, 1 - share)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def test_awkward_rows_and_labels(spark):
    table = docs(spark)
    some = labelled(spark, [(i, int(i % 2), int(i % 2), "x") for i, _ in texts() if i] + [(None, 1, 1, "x"), (7, None, None, "x"), (999, 1, 0, "x")])
    for none in (labelled(spark, []), some):
        for module, scored in ((toxicity, toxicity.train(table, none)), (quality, quality.train(table, none))):
            rows = module.score(table, scored).collect()
            assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows)
            assert module.score(docs(spark, []), scored).count() == 0
    one = labelled(spark, [(6, 1, 1, "x"), (7, 1, 1, "x")])
    assert {r.score for r in quality.score(table, quality.train(table, one)).collect()} <= {0.5, 1.0}
    kept = toxicity.drop_toxic(table, some)
    assert kept.columns == table.columns


def test_ftrl_is_sparse_and_bradley_terry_orders():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(100, 50_000, 40), [7] if y else [9])), y) for y in rng.integers(0, 2, 400).tolist()]
    w = toxicity.fit(rows)
    dense = w.dense()
    assert dense[7] > 1 and dense[9] < -1 and len(w.ids) < 200
    x = rng.normal(size=(600, 3))
    y = (x[:, 1] > -1).astype(int)
    ranker = quality.fit(x, y)
    assert ((ranker.score(x) >= 0.5) == y).mean() > 0.95 and abs((ranker.score(x) < 0.5).mean() - (1 - y.mean())) < 0.01


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2):
    """The same updates, one coordinate at a time."""
    z, n, w, b, bn = {}, {}, {}, 0.0, 0.0
    for _ in range(epochs):
        for ids, y in rows:
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.get(i, 0.0) for i in ids) + b))))
            g = p - y
            for i in ids:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w.get(i, 0.0)
                n[i] = n.get(i, 0.0) + g * g
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
            bn += g * g
            b -= alpha / (beta + math.sqrt(bn)) * g
    return w, b


def plain_features(text, bits):
    """Words, pairs and skip-pairs, hashed one by one."""
    mask = (1 << 64) - 1
    words = [zlib.crc32(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    mixed = [*words, *((a * 0xC2B2AE3D27D4EB4F + b) & mask for a, b in zip(words, words[1:])), *((a * 0x165667B19E3779F9 + (b ^ 0x9E3779B97F4A7C15)) & mask for a, b in zip(words, words[2:]))]
    return {((x ^ x >> 29) * 0x9E3779B97F4A7C15 & mask) >> 64 - bits for x in mixed}


def test_toxicity_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10_001, None), (10_002, ""), (10_003, "word " * 200_000)]
    table, labels = docs(spark, rows), spark.createDataFrame([(i, i % 3 // 2) for i, _ in rows], "doc_id long, toxic int")
    options = {"bits": 14, "epochs": 3, "alpha": 1.0, "beta": 1.0, "l1": 0.5, "l2": 1.0}
    model = toxicity.train(table, labels, **options)
    rank = {r.doc_id: r.rank for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS rank").collect()}
    used = sorted((rank[i], plain_features(t, 14), i % 3 // 2) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    w, b = plain_ftrl([(sorted(f), y) for _, f, y in used], **options)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in plain_features(t, 14)) - b)), abs=1e-5)
    few = toxicity.train(table, labels, max_features=20_000, **options)
    assert 0 < len(few.ids) < len(model.ids)


def test_choose_reads_no_held_out_label(spark):
    rows = [(i, ("bad words " if i % 2 else "good text ") * 3 + f"w{i}") for i in range(60)]
    table = docs(spark, rows)
    labels = lambda flip: spark.createDataFrame([(i, (i + (flip and zlib.crc32(str(i).encode()) % 3 == 1)) % 2) for i, _ in rows], "doc_id long, toxic int")
    tried = [{"alpha": 1.0, "l1": 0.1, "bits": toxicity.BITS}, {"alpha": 1.0, "l1": 1000.0, "bits": toxicity.BITS}]
    first, flipped = ([tuple(r) for r in toxicity.choose(table, labels(f), settings=tried).collect()] for f in (False, True))
    assert first == flipped and [k for k, _ in first] == [0, 1]


def plain_measures(text):
    raw = (text or "").encode()
    n, words = len(raw), raw.split()
    m = len(words)
    if not m:
        return [math.log1p(n)] + [0.0] * 15
    count = lambda kept: sum(b in kept for b in raw) / n
    odd = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"}
    kinds = [count(set(range(65, 91))), count(set(range(97, 123))), count(set(range(48, 58))), count(odd), count(set(b".,\n "))]
    lines = raw.split(b"\n")
    return [
        math.log1p(n), math.log1p(m), *kinds, 1 - sum(kinds), n / m, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        1 - len(set(lines)) / len(lines), math.log1p(m / len(lines)), sum(w[-1] in odd for w in words) / m, sum(65 <= w[0] <= 90 for w in words) / m, len(set(words)) / m**0.75,
    ]


def test_quality_against_brute_force(spark):
    """Measures character by character, and the pairwise loss by plain loops over pairs and bins."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10_001, None), (10_002, ""), (10_003, "A word. " * 100_000)]
    table, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(table, quality.train(table, labels, steps=25)).collect()}
    rank = {r.doc_id: r.rank for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS rank").collect()}
    own = {i: quality.measures((t or "").encode()) for i, t in rows}  # to the last digit, since values lie at the edges of bins
    assert all(own[i] == pytest.approx(plain_measures(t), abs=1e-12) for i, t in rows)
    used = sorted((rank[i], own[i], int(i % 4 > 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    x, y = np.array([m for _, m, _ in used]), np.array([label for _, _, label in used])
    shares = [0.005, 0.02, *np.linspace(0, 1, 11)[1:-1].tolist(), 0.98, 0.995]
    edges = [sorted(np.quantile(x[:, k], shares)) for k in range(16)]
    code = lambda m: [k * 14 + bisect.bisect_right(edges[k], v) for k, v in enumerate(m)]
    good, bad = [k for k in range(len(y)) if y[k]], [k for k in range(len(y)) if not y[k]]
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    drawn = np.random.default_rng(7).choice(np.array(many), 4 * len(few)).tolist()
    pairs = [(p, o) if few is good else (o, p) for p, o in zip([p for p in few for _ in range(4)], drawn, strict=True)]
    codes = [code(m) for m in x]
    w, v = [0.0] * 224, [0.0] * 224
    for _ in range(25):
        ahead = [a + 0.9 * b for a, b in zip(w, v, strict=True)]
        grad = [-1e-4 * a for a in ahead]
        for p, o in pairs:
            pull = 1 / (1 + math.exp(sum(ahead[c] for c in codes[p]) - sum(ahead[c] for c in codes[o]))) / len(pairs)
            for c in codes[p]:
                grad[c] += pull
            for c in codes[o]:
                grad[c] -= pull
        v = [0.9 * a + 0.5 * g for a, g in zip(v, grad, strict=True)]
        w = [a + b for a, b in zip(w, v, strict=True)]
    strength = lambda m: sum(w[c] for c in code(m))
    ordered = sorted(map(strength, x))
    cut = (ordered[len(bad) - 1] + ordered[len(bad)]) / 2
    for i, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(strength(own[i]) - cut))), abs=1e-9)


def test_ties_at_the_cut():
    """Equal strengths on both sides of the cut: they score 0.5, which counts as good."""
    x = np.zeros((8, 3))
    ranker = quality.fit(x, np.array([0, 0, 1, 1, 1, 1, 1, 1]))
    assert (ranker.score(x) == 0.5).all()
