import random
import re

import pytest

from rostra.llm import decontaminate as D
from tests.llm.data import docs, passage, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for i, t in rows:
        own = words(t)
        hit, found = set(), set()
        for item, text in items:
            w = words(text)
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, words string")


def check(spark, rows, items):
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.report(docs(spark, rows), bench(spark, items)).collect()]
    assert sorted(got, key=str) == brute(rows, items)


ITEMS = [(1, passage(11, 30)), (2, passage(11, 60)), (10, passage(2, 13)), (11, None), (12, " .. "), (13, "one"), (14, "TWO words"), (15, "three short WORDS"), (16, "a b c a b c a b c a b c a"), (3, "Ünïcode ÉÉ ça"), (2, passage(9, 20))]


def test_against_brute_force(spark):
    check(spark, texts(), ITEMS)


@pytest.mark.parametrize("least, most", [(6, 6), (6, 24), (D.BITS, D.MOST_BITS)])
def test_random_and_full_tables(spark, monkeypatch, least, most):
    monkeypatch.setattr(D, "BITS", least)
    monkeypatch.setattr(D, "MOST_BITS", most)
    rng = random.Random(4)
    few = [f"s{k}" for k in range(6)]
    line = lambda n: " ".join(rng.choice(few) if rng.random() < 0.6 else f"r{rng.randrange(40)}" for _ in range(n))
    items = [(k, line(rng.randrange(1, 40))) for k in range(15)]
    rows = []
    for k in range(60):
        part = words(rng.choice(items)[1])
        a = rng.randrange(0, max(1, len(part) - 10))
        rows.append((k, f"{line(rng.randrange(0, 80))} {' '.join(part[a : a + 25]).upper()}, {line(rng.randrange(0, 9))}"))
    check(spark, rows + rows[:2], items)


def test_drop_and_empty(spark):
    table = docs(spark)
    kept = D.drop_contaminated(table, bench(spark, ITEMS))
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, _, _, bad in brute(texts(), ITEMS) if not bad), key=str)
    check(spark, texts(), [])
    check(spark, [], ITEMS)


def test_bits_grow_with_the_benchmark():
    assert [D._bits(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 1 << 19, 1 << 30)] == [20, 20, 20, 21, 23, 24]


def test_very_long_text(spark):
    rng = random.Random(9)
    own = [f"v{rng.randrange(2000)}" for _ in range(30_000)]
    item = " ".join(own[29_900:29_960])
    check(spark, [(1, " ".join(own)), (2, " ".join(own[29_890:29_980]))], [(1, item), (2, " ".join(own[100:113]))])
