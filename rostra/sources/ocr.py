"""Recognised lines: rows of boxes, the best of several readings, styles put back by line shapes. The engine itself is a plug point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import labels as L
from rostra.functions import text as T

LEAST_SCORE, HEADING_UPPER, LABEL_MOST = 0.85, 0.7, 220
#: A wrapped label ends within so many characters of its second line.
WRAP_MOST = 120


def best_reading(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of several readings of a line (by resolution) the one with the best score, the lowest resolution of ties."""
    return lines.groupBy(*keys).agg(F.max_by(F.struct("text", "score", "x", "y", "h"), F.struct("score", -F.col("dpi"))).alias("b")).select(*keys, "b.*")


def rows_of_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., row, text, score, x, y, h): boxes whose centre is less than half the height of a row's first box away from its centre make one row, joined from left to right.

    The comparison is with the row's first box, so rows are a fold over a page's boxes in order of their centres.
    """
    box = F.struct((F.col("y") + F.col("h") / 2).alias("c"), "x", "y", "h", "text", "score")
    listed = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    start = F.struct(F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("h"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, b: Column) -> Column:
        same = F.coalesce(F.abs(b["c"] - acc["c"]) < acc["h"] / 2, F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(F.when(same, acc["c"]).otherwise(b["c"]).alias("c"), F.when(same, acc["h"]).otherwise(b["h"]).alias("h"), row.alias("row"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    rows = F.aggregate("boxes", start, step)["rows"]
    each = listed.select(*by, F.explode(F.arrays_zip(F.col("boxes").alias("b"), rows.alias("row"))).alias("z")).select(*by, "z.row", "z.b.*")
    ordered = F.array_sort(F.collect_list(F.struct("x", "text")))
    return each.groupBy(*by, "row").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"), F.min("score").alias("score"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("h").alias("h"))


def restyled(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """lines with kind and cut: what a line is by its shape, and how many of its first characters are the bold label or question.

    Kinds, the first that fits: unreadable (a boundary that nothing merges over), time_mark, label, label_start and label_end (a label over two lines), question, heading, stage, text.
    """
    w = Window.partitionBy(*by).orderBy(order)
    text = F.trim("text")
    own = lines.withColumn("__t", text).withColumns({"__next": F.coalesce(F.lead(text).over(w), F.lit("")), "__score": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    t, after = F.col("__t"), F.col("__next")
    begins = t.rlike(rf"^({L.BEGINNINGS})\b")
    colon, wrap = F.instr(t, ":"), F.instr(after, "]:")
    balanced = F.regexp_count(F.substring_index(t, ":", 1), F.lit(r"\[")) == F.regexp_count(F.substring_index(t, ":", 1), F.lit(r"\]"))
    asks = r"^(.*?\[[^\[\]]+\])\s*(?i:minta|meminta|bertanya)\b"
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    kind = (
        F.when(F.col("score") < LEAST_SCORE, "unreadable")
        .when(t.rlike(r"^■?\s*\d{4}$"), "time_mark")
        .when(begins & colon.between(3, LABEL_MOST) & balanced, "label")
        .when(begins & (colon == 0) & wrap.between(1, WRAP_MOST) & (F.col("__score") >= LEAST_SCORE), "label_start")
        .when(begins & t.rlike(asks), "question")
        .when((colon == 0) & (letters >= 4) & (T.upper_ratio(t) >= HEADING_UPPER), "heading")
        .when(t.rlike(r"(?s)^\[.*\]$"), "stage")
        .otherwise("text")
    )
    own = own.withColumn("__kind", kind)
    final = F.when(F.lag("__kind").over(w) == "label_start", "label_end").otherwise(F.col("__kind"))
    own = own.withColumn("kind", final)
    cut = F.when(F.col("kind") == "label", colon).when(F.col("kind") == "label_end", F.instr(t, "]:") + 1).when(F.col("kind") == "question", F.length(F.regexp_extract(t, asks, 1)))
    return own.withColumn("cut", F.when(F.col("kind").isin("label_start", "heading"), F.length(t)).otherwise(F.coalesce(cut, F.lit(0)))).drop("__t", "__next", "__score", "__kind")


def styled_spans(kinds: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., order, span, text, bold, italic) from restyled(): what the parser of styled pages takes."""
    t = F.when(F.col("kind") == "unreadable", "OCR tidak dapat dibaca:").when(F.col("kind") == "time_mark", F.concat(F.lit("■"), F.regexp_extract("text", r"(\d{4})", 1))).otherwise(F.trim("text"))
    bold = F.when(F.col("kind") == "unreadable", F.length(t)).otherwise(F.col("cut"))
    rest = F.regexp_extract_all(F.substring(t, bold + 1, F.length(t)), F.lit(r"(\[[^\[\]]{1,150}\]|[^\[]+|\[)"), F.lit(1))
    pieces = F.transform(rest, lambda p: F.struct(p.alias("text"), F.lit(False).alias("bold"), p.rlike(r"^\[.*\]$").alias("italic")))
    head = F.when(bold > 0, F.array(F.struct(F.substring(t, F.lit(1), bold).alias("text"), F.lit(True).alias("bold"), F.lit(False).alias("italic")))).otherwise(F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>"))
    return kinds.select(*by, order, F.posexplode(F.concat(head, pieces)).alias("span", "p")).select(*by, order, "span", "p.*")


def needs_ocr(pages: DataFrame, least: int = 200) -> DataFrame:
    """Pages (doc_id, page, text) with less text than ``least`` characters."""
    return pages.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") < least)
