"""Small hand-made tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

WORDS = [f"w{k}" for k in range(400)]


def passage(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 37 + k * (seed % 7 + 1) + k * k * seed) % 400] for k in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    shared = passage(11, 60)
    near = passage(5, 120)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, "Three Short words"),
        (7, near), (8, near.replace("w3", "w4", 1)), (9, near), (10, f"{passage(2, 40)} {shared} {passage(3, 30)}"),
        (11, f"{shared}\n{passage(4, 50)}"), (12, f"{passage(6, 20)}\n{shared}"), (13, "Ünïcode ÉÉ ça  va\u00a0bien \U0001f600 x"),
        (14, passage(8, 35)), (15, passage(8, 35)), (16, passage(9, 34)), (17, passage(9, 34)), (18, " ".join(["a b c"] * 30)),
        (19, "\n".join(["line one here", "line two here", "line three here", passage(1, 12)])),
        (20, "\n".join([passage(13, 9), "line one here", "line two here", "line three here"])),
        (21, passage(21, 3000)), (21, passage(21, 3000)), (None, passage(22, 50)), (None, None), (22, "<|endoftext|> it's 42's\x00end"),
    ]
    return rows


def docs(spark: SparkSession, rows=None) -> DataFrame:
    """With the columns of documents and others whose names operators might use inside."""
    rows = texts() if rows is None else rows
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, k1 int")
