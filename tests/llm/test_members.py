import os
import random

import pytest
from pyspark.sql import functions as F

from rostra.llm import decontaminate, lines, members, simhash, staging
from tests.llm.data import docs, texts


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_sets_of_ids(spark, monkeypatch, most):
    """Both plans, ids at the ends of words, in other partitions and below zero; repeated and null ids."""
    monkeypatch.setattr(members, "MOST_WORDS", most)
    rng = random.Random(3)
    ids = [0, 1, 62, 63, 64, 127, (1 << 33) + 63, (5 << 33) + 64, -1, -64, -65, (1 << 63) - 1, *rng.sample(range(1000), 200)]
    wanted = ids[::2]
    rows = spark.createDataFrame([(i, str(i)) for i in ids + [ids[0], 5000]], "id long, own string")
    own = members.members(spark.createDataFrame([(i,) for i in [*wanted, wanted[0], None]], "x long"), "x")
    for inside in (True, False):
        got = members.among(rows, "id", own, inside=inside)
        assert got.columns == ["id", "own"]
        assert sorted(r.id for r in got.collect()) == sorted(i for i in ids + [ids[0], 5000] if (i in wanted) == inside)


def _no_text_moves(spark, df):
    """Whether no shuffle of the plan has a text, Spark's own choice of broadcasts aside."""
    joins = [p for p in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p]
    return bool(joins) and all("rightHint=(strategy=broadcast)" in j for j in joins)


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_kept_rows_are_told_apart_in_place(spark, monkeypatch, most):
    """The rows of near copies leave without a join by key, or by one where the set is large; the result is the same."""
    monkeypatch.setattr(members, "MOST_WORDS", most)
    rows = texts() + [(900 + k, " ".join(f"w{j}" for j in range(60)) + f" e{k}") for k in range(20)]
    kept = simhash.keep_one(docs(spark, rows))
    assert _no_text_moves(spark, kept) == (most > 0)
    assert sum(r.doc_id is not None and r.doc_id >= 900 for r in kept.collect()) == 1


def test_only_texts_that_lose_lines_move(spark):
    rows = [(k, f"own {k}\n" + ("\n".join(f"same {j}" for j in range(6)) if k in (3, 7) else "end")) for k in range(200)]
    out = lines.remove(docs(spark, rows))
    shuffled = [p for p in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p and "strategy=broadcast" not in p]
    assert len(shuffled) == 1 and "Inner" in shuffled[0]  # deletions with the texts that have some
    assert {r.doc_id for r in out.where(F.col("text").contains("same")).collect()} == {3} and out.count() == 200


def test_sketches_move_only_where_fingerprints_are_near(spark, monkeypatch):
    """One shard of unlike texts, two of which have a copy with another fingerprint near theirs."""
    rng, stage, moved = random.Random(1), simhash.stage, []
    rows = [(k, rng.getrandbits(63), [7, 10 + k, 30 + k], bytearray(simhash.sketch(f"{k} b c d e f g".encode())[1])) for k in range(11)]
    assert all((a[1] ^ b[1]).bit_count() > simhash.NEAR_BITS for a in rows for b in rows if a != b)
    rows += [(100 + k, fp ^ 1, [7, 50 + k, 70 + k], own) for k, fp, _, own in rows[:2]]

    def watched(df, label):
        if "sketch" in df.columns:
            moved.append(sorted(r.uid for r in df.collect()))
        return stage(df, label)

    monkeypatch.setattr(simhash, "stage", watched)
    links = simhash.near_links(spark.createDataFrame(rows, "uid long, fp long, keys array<long>, sketch binary"))
    assert {(r.u, r.v) for r in links.collect()} == {(100, 0), (101, 1)}
    assert moved == [[0, 1, 100, 101]]


def test_neighbours():
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    for n in (2, 3, 40, 200):
        values = [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 3, 12, 30]))) for _ in range(n)]
        want = [k for k, a in enumerate(values) if any(j != k and (a ^ b).bit_count() <= simhash.NEAR_BITS for j, b in enumerate(values))]
        assert simhash._neighbours(values) == want


@pytest.mark.parametrize(("run", "most"), [(simhash.keep_one, 2), (lambda d: decontaminate.drop_contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(3)), 1)])
def test_what_stays_in_the_shared_folder(spark, run, most):
    """A stage leaves what its result reads and nothing else."""
    folder = f"{staging.shared_dir(spark).removeprefix('file://')}/rostra"
    own = docs(spark)
    own.count()
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = run(own)
    assert 1 <= len(set(os.listdir(folder)) - before) <= most
    out.count()
