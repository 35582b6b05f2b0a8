import random

import pytest

from rostra.llm import lines as L
from tests.llm.data import docs, texts


def brute(rows, min_lines=L.MIN_LINES, min_chars=L.MIN_CHARS):
    """Rows in order; of each, lines, deleted lines, their runs, the longest, kept lines: every run length is judged."""
    rows = sorted(((-1 if i is None else i, k, (t or "").split("\n")) for k, (i, t) in enumerate(rows)))
    seen, out = set(), []
    for i, _, lines in rows:
        gone = set()
        for p in range(len(lines)):
            for d in range(1, len(lines) - p + 1):
                run = tuple(lines[p : p + d])
                if run in seen and (d >= min_lines or len("\n".join(run)) >= min_chars):
                    gone |= set(range(p, p + d))
                seen.add(run)
        runs = "".join("x" if k in gone else " " for k in range(len(lines))).split()
        out.append((i, len(lines), len(gone), len(runs), max(map(len, runs), default=0), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows, **options):
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.kept) for r in L.report(docs(spark, rows), **options).collect()]
    assert sorted(got, key=str) == brute(rows, **options)


def rough(seed, n=40):
    rng = random.Random(seed)
    pool = [f"line {k} " + "x" * rng.choice([0, 10, 60, 250]) for k in range(25)] + [""]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    return [(k % 30, "\n".join(sum((rng.choice(blocks) if rng.random() < 0.6 else [f"own {rng.random()}"] for _ in range(rng.randrange(0, 6))), []))) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"min_lines": 2, "min_chars": 10**9}, {"min_lines": 1}, {"min_lines": 8, "min_chars": 40}])
def test_against_brute_force(spark, options):
    check(spark, rough(1), **options)


def test_awkward_rows(spark):
    check(spark, texts())
    check(spark, [])
    check(spark, [(1, None), (2, "")], min_lines=1)
    check(spark, [(1, "\n".join(["same"] * 50)), (2, "\n".join(["same"] * 9))])


def test_remove(spark):
    table = docs(spark, rough(2))
    got = L.remove(table)
    assert got.columns == table.columns and got.dtypes == table.dtypes
    rows = got.collect()
    assert sorted(r.text for r in rows) == sorted(x[5] for x in brute(rough(2))) and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in L.remove(docs(spark, [(1, None)])).collect()] == [None]


@pytest.mark.parametrize("options", [{}, {"min_lines": 8, "min_chars": 150}, {"min_lines": 3, "min_chars": 10**9}, {"min_lines": 7}])
def test_every_length(spark, options):
    """Copies of every number of lines, among them one of exactly three that counts by its characters only."""
    long = "a" * 195 + "\n\n" + "b" * 195
    runs = [f"x{k} " + "x" * 30 for k in range(7)]
    made = [(100, long), (101, f"own\n{long}\nother"), (102, "\n".join(runs)), *((110 + n, "\n".join(["first", *runs[:n], f"last {n}"])) for n in range(1, 8))]
    check(spark, rough(2) + made, **options)


def test_three_lines_go(spark):
    block = "\n".join(letter * 80 for letter in "abc")
    got = {r.doc_id: (r.n_removed, r.kept) for r in L.report(docs(spark, [(1, f"{block}\nx"), (2, f"y\n{block}")])).collect()}
    assert got == {1: (0, f"{block}\nx"), 2: (3, "y")}


def test_very_long_text_and_clashing_columns(spark):
    long = "\n".join(f"line {k % 30_000} of a long text" for k in range(60_000))
    table = docs(spark, [(1, long), (2, "line 7 of a long text")]).selectExpr("*", "1 AS uid", "2 AS line", "3 AS chars", "4 AS gone", "'x' AS h1", "5 AS n")
    out = L.remove(table)
    assert out.columns == table.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[1].count("\n") == 29_999 and rows[2] == "line 7 of a long text"
