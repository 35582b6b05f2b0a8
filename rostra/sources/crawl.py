"""Records of sittings from fetched pages: two crawl hierarchies and the page of the current meeting, as joins of tables of pages.

Fetching itself is the caller's: each function takes the pages that there are, and levels are joined on the parent's id. Each gives
(records, unparsed): what could be interpreted, and (what, title) of the rest, which is listed for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators import catalog
from rostra.sources import html

# How the listings name terms, meetings, files and parliaments.
REPOSITORY_TERM, REPOSITORY_MEETING = r"(?i)^\s*(\d+)\.\s*PENGGAL\b", r"(?i)^\s*MESYUARAT\s+([A-Z]+)\b"
TREE_TERM, TREE_MEETING, TITLE_TERM = r"(?i)^\s*Penggal\s+([A-Za-z]+)", r"(?i)^\s*Mesyuarat\s+([A-Za-z]+)", r"(?i)Penggal\s+([A-Za-z]+)"
CURRENT_TITLE, FILE = r'(?i)class="boxMesyuaratTextA"[^>]*>\s*(?:<strong>)?([^<]+)', r"(?i)loadResult\('([^']+\.pdf)'"
PARLIAMENTS = {14: "Keempat Belas", 15: "Kelima Belas", 16: "Keenam Belas"}

_FIELDS = ["parlimen", "penggal", "mesyuarat", "mesyuarat_title", "listing_url"]


def _ordinal(text: Column, pattern: str) -> Column:
    """The number of the ordinal word that the pattern finds, or null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, T.ORDINALS)), F.upper(F.regexp_extract(text, pattern, 1))).cast("int"), F.lit(0))


def _records(found: DataFrame, source: str, base: str, amended: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, unparsed) of files: the record's fields, path, filename and parsed name."""
    good, bad = catalog.split_rejects(found, "parsed")
    day = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    own = good.select(
        F.concat(F.lit("DR-"), day("parsed.sitting_date")).alias("doc_id"),
        day("parsed.sitting_date").alias("sitting_date"),
        *_FIELDS,
        F.col("parsed.bil").alias("bil"),
        F.lit(source).alias("source"),
        F.concat(F.lit(base), "path").alias("source_url"),
        "filename",
        F.col("parsed.note").alias("filename_note"),
        (day("parsed.amended_on") if amended else F.lit(None).cast("string")).alias("amended_on"),
    )
    return own, bad.select(F.concat(F.lit(base), "path").alias("what"), F.col("mesyuarat_title").alias("title"))


def repository(found: DataFrame, root: str, parlimen: int, base: str) -> tuple[DataFrame, DataFrame]:
    """From the links (page, position, href, text; page: the handle they are on) of a repository: terms on the root's page, meetings on the terms' pages,
    files on the meetings' pages; of a day with several files the newest version counts."""
    terms = html.numbered_links(found.where(F.col("page") == root), REPOSITORY_TERM).select(F.col("handle").alias("page"), F.col("number").alias("penggal"))
    meetings = html.numbered_links(found.join(terms.select("page"), "page", "left_semi"), REPOSITORY_MEETING, ordinals=True, by=("page",)).join(terms, "page")
    meetings = meetings.select(F.col("handle").alias("page"), "penggal", F.col("number").alias("mesyuarat"), F.col("text").alias("mesyuarat_title"))
    files = html.listed_files(found, by=("page",)).join(meetings, "page")
    named = files.withColumns({"parlimen": F.lit(parlimen), "listing_url": F.concat(F.lit(f"{base}/handle/"), "page")})
    records, unparsed = _records(named, "repositori", base)
    newest = records.groupBy("doc_id").agg(F.max_by(F.struct(*records.columns), F.struct(F.coalesce("amended_on", F.lit("")), "penggal", "mesyuarat", "source_url")).alias("r"))
    return newest.select("r.*"), unparsed


def tree(pages: DataFrame, parlimen: int, base: str) -> tuple[DataFrame, DataFrame]:
    """From the pages (id, url, body) of an XML tree, node by node: terms below the parliament's node, meetings below them, files below those.

    A meeting without an ordinal (a special one) has no number.
    """
    nodes = pages.select(F.col("id").alias("parent"), F.col("url").alias("listing_url"), F.explode(html.tree_items(F.col("body"))).alias("i")).select("parent", "listing_url", "i.*")
    terms = nodes.where(F.col("parent") == f"0_{parlimen}").select(F.col("id").alias("parent"), F.col("text").alias("title"), _ordinal(F.col("text"), TREE_TERM).alias("penggal"))
    meetings = nodes.join(terms.where("penggal IS NOT NULL").select("parent", "penggal"), "parent")
    meetings = meetings.select(F.col("id").alias("parent"), "penggal", F.col("text").alias("mesyuarat_title"), _ordinal(F.col("text"), TREE_MEETING).alias("mesyuarat"))
    files = nodes.where("url IS NOT NULL").join(meetings, "parent").select("penggal", "mesyuarat", "mesyuarat_title", "listing_url", F.col("url").alias("path"), F.lit(parlimen).alias("parlimen"))
    records, unparsed = _records(_named(files), "laman_web", base)
    return records, unparsed.unionAll(terms.where("penggal IS NULL").select(F.lit("penggal?"), "title"))


def current_meeting(pages: DataFrame, parlimen: int, base: str) -> tuple[DataFrame, DataFrame]:
    """From pages (url, html) that show the current meeting: its files, each once; nothing if it belongs to another parliament."""
    title = T.collapse(F.regexp_extract("html", CURRENT_TITLE, 1))
    own = pages.select(F.col("url").alias("listing_url"), title.alias("mesyuarat_title"), F.array_distinct(F.regexp_extract_all("html", F.lit(FILE), F.lit(1))).alias("paths"))
    own = own.where(F.contains(F.lower("mesyuarat_title"), F.lit(f"parlimen {PARLIAMENTS[parlimen]}".lower())) if parlimen in PARLIAMENTS else F.lit(False))
    own = own.withColumns({"penggal": _ordinal(F.col("mesyuarat_title"), TITLE_TERM), "mesyuarat": _ordinal(F.col("mesyuarat_title"), TREE_MEETING), "parlimen": F.lit(parlimen)})
    files = own.where("penggal IS NOT NULL").select("parlimen", "penggal", "mesyuarat", "mesyuarat_title", "listing_url", F.explode("paths").alias("path"))
    records, unparsed = _records(_named(files), "laman_web", base, amended=False)
    return records, unparsed.unionAll(own.where("penggal IS NULL").select(F.lit("penggal?"), "mesyuarat_title"))


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("filename", T.basename(F.col("path"))).withColumn("parsed", catalog.parse_filename(F.col("filename")))


def counters(attempts: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(requests, failed, unparsed): requests made and failed, from a log of attempts (status), and listings that could not be interpreted."""
    each = attempts.select(F.lit(1).alias("requests"), (F.col("status") != "ok").cast("int").alias("failed"), F.lit(0).alias("unparsed"))
    each = each.unionAll(unparsed.select(F.lit(0), F.lit(0), F.lit(1)))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns])
