"""Attendance lists: blocks under status titles, split at sequential numbers, each entry a role, a name and a seat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import labels as L
from rostra.functions.text import collapse

#: Titles of the lists, in the order in which they are tried; months of a date header; brackets that are no seat.
TITLES = [
    (r"senator.*turut hadir", "present_senator"),
    (r"tidak hadir.*peraturan mesyuarat\s*91", "absent_po91"),
    (r"yang tidak hadir", "absent"),
    (r"yang hadir", "present"),
    (r"kehadiran ahli", "present"),
    (r"digantung", "suspended"),
]
MONTHS = "januari|februari|mac|april|mei|jun|julai|ogos|september|oktober|november|disember"
NO_SEAT = ["dr.", "dr", "prof.", "prof"]
_NUMBER = r"(?<![\w.(/-])(\d{1,3})\.?(?=\s|$)"
_TITLE_MOST = 110


def title(line: Column) -> Column:
    """The status a list title gives, else null."""
    out = None
    for pattern, status in TITLES:
        out = (F.when if out is None else out.when)(line.rlike(f"(?i){pattern}"), status)
    return F.when((F.length(line) <= _TITLE_MOST) & ~line.rlike(f"^{_NUMBER}"), out)


def listed(lines: DataFrame) -> DataFrame:
    """(doc_id, block, status, line, text) of the lines in lists: a title opens a block, any other line with a colon at its end closes it."""
    own = lines.select("doc_id", "line", F.trim("text").alias("text")).where("text <> ''")
    own = own.withColumn("__s", title(F.col("text")))
    closes = F.col("__s").isNull() & F.endswith("text", F.lit(":")) & (F.length("text") < _TITLE_MOST)
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__e", F.when(F.col("__s").isNotNull() | closes, F.struct(F.col("__s").alias("v"))))
    own = own.withColumn("status", F.last("__e", ignorenulls=True).over(w)["v"])
    own = own.withColumn("block", F.sum(F.when(F.col("__s").isNotNull(), 1).otherwise(0)).over(w))
    return own.where(F.col("__e").isNull() & F.col("status").isNotNull()).select("doc_id", "block", "status", "line", "text")


def split_numbered(text: Column) -> Column:
    """The entries of a list's text, cut only at the numbers that continue the count; it may begin above 1 but must begin the text."""
    header = rf"(?i)^\s*\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}(?:\s*\([^)]*\))?"
    body = F.concat(F.regexp_replace(text, header, ""), F.lit(" "))
    # Alternating pieces: text, number, text, ...; a fold joins pieces until the expected number comes.
    marked = F.split(F.regexp_replace(body, _NUMBER, "\u0001$1\u0002"), "\u0001")
    start = F.struct(F.lit(None).cast("int").alias("next"), F.lit(True).alias("empty"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        number = F.nullif(F.regexp_extract(piece, "^(\\d{1,3})\u0002", 1), F.lit("")).cast("int")
        rest = F.regexp_replace(piece, "^\\d{1,3}\u0002", "")
        begins = F.coalesce((number == acc["next"]) | (acc["next"].isNull() & acc["empty"] & number.isNotNull()), F.lit(False))
        again = F.regexp_replace(piece, "\u0002", "")
        joined = F.when(F.size(acc["out"]) > 0, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["out"], -1), again)))).otherwise(acc["out"])
        return F.struct(
            F.when(begins, number + 1).otherwise(acc["next"]).alias("next"),
            (acc["empty"] & (F.trim(again) == "")).alias("empty"),
            F.when(begins, F.concat(acc["out"], F.array(rest))).otherwise(joined).alias("out"),
        )

    entries = F.aggregate(marked, start, step)["out"]
    return F.filter(F.transform(entries, lambda e: F.regexp_replace(collapse(e), r"^\.\s*", "")), lambda e: e != "")


def parse_entries(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with raw cleaned, role, name and constituency of each entry.

    A seat is a last bracket that holds no title. After a role, the name follows the last comma with a beginning of a name after it, else the first such
    beginning, else the last comma.
    """
    own = df.withColumn(raw, L.clean(F.col(raw)))
    paren = r"^(.*)\(([^()]+)\)\s*$"
    inner = F.regexp_extract(raw, paren, 2)
    seated = (inner != "") & ~F.lower(F.trim(inner)).isin(NO_SEAT)
    own = own.withColumn("__t", F.when(seated, F.regexp_replace(F.regexp_extract(raw, paren, 1), "^[ ,]+|[ ,]+$", "")).otherwise(F.col(raw)))
    comma, bare, last = rf"^(.*),\s*((?:{L.AFTER_ROLE})\b.*)$", rf"^(.*?)(?:(?<=[\s)]))((?:{L.AFTER_ROLE})\b.*)$", r"^(.*),\s*(.*)$"
    ladder = lambda k: F.when(F.col("__t").rlike(comma), F.regexp_extract("__t", comma, k)).when(F.col("__t").rlike(bare), F.regexp_extract("__t", bare, k)).when(F.col("__t").rlike(last), F.regexp_extract("__t", last, k))
    is_role = L.is_role(F.col("__t"))
    role, name = F.regexp_replace(ladder(1), "^[ ,]+|[ ,]+$", ""), F.trim(ladder(2))
    return own.withColumns({"role": F.when(is_role, role), "name": F.when(is_role, F.coalesce(name, F.col("__t"))).otherwise(F.col("__t")), "constituency": F.when(seated, L.clean(inner))}).drop("__t")


def parse(lines: DataFrame) -> DataFrame:
    """(doc_id, ordinal, status, raw, role, name, constituency) from front-matter lines (doc_id, line, text)."""
    blocks = listed(lines).groupBy("doc_id", "block", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("t"))
    entries = blocks.select("doc_id", "block", "status", F.posexplode(split_numbered(F.col("t"))).alias("__k", "raw"))
    w = Window.partitionBy("doc_id").orderBy("block", "__k")
    return parse_entries(entries).select("doc_id", F.row_number().over(w).alias("ordinal"), "status", "raw", "role", "name", "constituency")
