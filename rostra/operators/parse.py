"""A whole parse: styled spans, attendance lists and catalog records to the rows of schemas.TURNS and a report of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import labels as L
from rostra.functions import text as T
from rostra.operators import ordered, resolve, segment
from rostra.schemas import SPANS, TURNS

_PLACE = ["doc_id", "page", "line"]


def pages(spans: DataFrame, header: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, page, line, text, kind) of lines, (doc_id, page, page_label, debate) of pages)."""
    parts = F.array_sort(F.collect_list(F.struct("span", "text")))
    lines = spans.groupBy(*_PLACE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    marked = segment.furniture(lines, header)
    return marked, segment.page_labels(marked)


def _marks(flat: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, at, time) of the time marks, at the last character of the text before them."""
    own = marked.where("kind = 'time_mark'").select(*_PLACE, F.regexp_extract("text", segment.TIME_MARK, 1).alias("time"), F.lit(None).cast("int").alias("end"))
    both = flat.select(*_PLACE, F.lit(None).cast("string").alias("time"), "end").unionByName(own)
    w = Window.partitionBy("doc_id").orderBy("page", "line", F.col("time").isNotNull(), "end").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("at", F.greatest(F.coalesce(F.last("end", ignorenulls=True).over(w), F.lit(0)) - 1, F.lit(0)))
    return placed.where(F.col("time").isNotNull()).select("doc_id", "at", "time")


def chairs(turns: DataFrame, preamble: DataFrame, attendance: DataFrame) -> DataFrame:
    """turns with chair: who was in it before each turn.

    A named chair's label changes it, then the turn's stage directions in their order; a direction without a name means the house's Speaker by the
    sitting's list, or nobody if the list has none. preamble: (doc_id, stage_directions) of what stands before a document's first turn.
    """
    speaker = attendance.where(F.lower("role").startswith("yang di-pertua")).groupBy("doc_id").agg(F.min_by("name", "ordinal").alias("__speaker"))
    before = preamble.select("doc_id", F.lit(-1).alias("seq"), "stage_directions")
    events = turns.select("doc_id", "seq", "stage_directions", "name", "role").unionByName(before, allowMissingColumns=True).join(speaker, "doc_id", "left")
    staged = F.filter(F.transform("stage_directions", L.chair_from_stage), lambda c: c["is_chair"])
    last = F.get(F.reverse(staged), F.lit(0))
    events = events.withColumn("__last", last)
    by_stage, by_label = F.col("__last").isNotNull(), L.is_chair(F.col("role")) & F.col("name").isNotNull()
    value = F.when(by_stage, F.coalesce("__last.name", "__speaker")).otherwise(F.col("name"))
    held = ordered.carried(events, ["doc_id"], ["seq"], by_stage | by_label, value, "chair")
    return turns.join(held.where("seq >= 0").select("doc_id", "seq", "chair"), ["doc_id", "seq"])


def run(spans: DataFrame, attendance: DataFrame, documents: DataFrame, header: str, curated: DataFrame | None = None, ocr: DataFrame | None = None) -> DataFrame:
    """The rows of schemas.TURNS. documents: doc_id, sitting_date, is_draft, source_url; curated: (variant, name); ocr: (doc_id, page) read by OCR."""
    spark = spans.sparkSession
    marked, numbered = pages(spans, header)
    spoken = marked.where("kind = 'text'").join(numbered.where("debate"), ["doc_id", "page"], "left_semi").select(*_PLACE)
    own = spans.join(spoken, _PLACE, "left_semi").select(*spark.createDataFrame([], SPANS).columns)
    flat = segment.flatten(own)
    found = segment.turns(own, times=_marks(flat, marked.join(numbered.where("debate"), ["doc_id", "page"], "left_semi")))
    found = L.parse_labels(found, "label").join(documents.select("doc_id", "sitting_date", "is_draft", "source_url"), "doc_id")
    found = resolve.resolve(chairs(found, segment.preamble(own), attendance), attendance, curated)
    found = ordered.interjections(found, ["doc_id"], ["seq"], F.coalesce("speaker_id", "label_raw"), F.col("unattributed"), F.col("kind") == "speech", L.is_chair(F.col("role")), F.length("text"))
    found = found.join(numbered.select("doc_id", F.col("page").alias("page_start"), F.col("page_label").alias("page_label_start")), ["doc_id", "page_start"], "left")
    read = spark.createDataFrame([], "doc_id string, page int") if ocr is None else ocr
    found = found.join(read.groupBy("doc_id").agg(F.collect_set("page").alias("__ocr")), "doc_id", "left")
    new = {
        "turn_id": F.format_string("%s:%04d", "doc_id", "seq"),
        "speaker_raw": F.col("label_raw"),
        "speaker_name": F.col("name"),
        "lang": T.language(F.col("text")),
        "ocr": F.coalesce(F.exists("__ocr", lambda p: p.between(F.col("page_start"), F.col("page_end"))), F.lit(False)),
    }
    fields = spark.createDataFrame([], TURNS).schema.fields
    return found.select(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def empty_pages(page_texts: DataFrame) -> DataFrame:
    """(doc_id, pages, empty): pages of each document, and the debate's pages without text; page_texts: doc_id, page, debate, text."""
    empty = F.col("debate") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return page_texts.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.array_sort(F.collect_set(F.when(empty, F.col("page")))).alias("empty"))


def report(turns: DataFrame, page_texts: DataFrame, attendance: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row a document: turns, unattributed, interjections, unreadable, attendance_entries, pages, empty, ocr_pages."""
    flag = lambda c: F.sum(c.cast("int"))
    own = turns.groupBy("doc_id").agg(
        F.count("*").alias("turns"), flag(F.col("unattributed")).alias("unattributed"), flag(F.col("is_interjection")).alias("interjections"), flag(F.col("resolution") == "ocr_unreadable").alias("unreadable")
    )
    listed = attendance.groupBy("doc_id").agg(F.count("*").alias("attendance_entries"))
    read = ocr.groupBy("doc_id").agg(F.count_distinct("page").alias("ocr_pages"))
    out = empty_pages(page_texts).join(own, "doc_id", "left").join(listed, "doc_id", "left").join(read, "doc_id", "left")
    return out.fillna(0, ["turns", "unattributed", "interjections", "unreadable", "attendance_entries", "ocr_pages"])
