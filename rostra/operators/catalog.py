"""The catalog of sittings: source preference, versions, merging a new listing into what is known, download planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import text as T

#: Sources in order of preference, and the shapes of a sitting's file name.
SOURCES = ["repositori", "laman_web"]
FILENAME = r"(?i)^DR(\d{1,3})?-(\d{8})(?:\.PINDAAN(\d{8}))?(?:\s*\(\d+\))?(\s+-\s+[^/\\]{1,60}?)?(?:\.pdf)?$"
#: What is known of a downloaded file.
DOWNLOADED = ["is_draft", "text_page_share", "sha256", "fetch_date", "local_path", "bytes"]
_NONE = "array<string>"


def parse_filename(name: Column) -> Column:
    """struct(bil, sitting_date, amended_on, note), or null if the name has another shape or an impossible date."""
    own = F.trim(name)
    group = lambda k: F.nullif(F.regexp_extract(own, FILENAME, k), F.lit(""))
    day = lambda k: F.try_to_date(group(k), "ddMMyyyy")
    note = F.regexp_replace(group(4), "^[ -]+|[ -]+$", "")
    good = own.rlike(FILENAME) & day(2).isNotNull() & (group(3).isNull() | day(3).isNotNull())
    return F.when(good, F.struct(group(1).cast("int").alias("bil"), day(2).alias("sitting_date"), day(3).alias("amended_on"), note.alias("note")))


def split_rejects(listed: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that could be interpreted, and the others, which are listed for review and never guessed."""
    return listed.where(F.col(parsed).isNotNull()), listed.where(F.col(parsed).isNull())


def _minus(urls: Column, *gone: Column) -> Column:
    return F.array_sort(F.array_compact(F.array_except(F.array_distinct(urls), F.array(*gone))))


def preferred(listed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row a doc_id, of the source that comes first; all other urls go to alternate_urls."""
    ranks = F.array_position(F.array(*map(F.lit, order or SOURCES)), F.col("source"))
    w = Window.partitionBy("doc_id")
    ranked = listed.withColumn("__k", F.row_number().over(w.orderBy(F.when(ranks > 0, ranks).otherwise(1 << 20), "source_url")))
    urls = F.concat(F.collect_set("source_url").over(w), F.flatten(F.collect_list(F.coalesce("alternate_urls", F.array().cast(_NONE))).over(w)))
    return ranked.withColumn("alternate_urls", _minus(urls, F.col("source_url"))).where("__k = 1").drop("__k")


def merge(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """All records: known ones that are no longer listed stay; listed ones take over what is known of their file.

    A copy that was once switched away from (source_note) stays switched while it is still offered. A new url keeps the old hash and file, only to tell whether the
    content changed, and the old url becomes superseded.
    """
    empty = F.array().cast(_NONE)
    n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    both = existing.alias("o").join(listed.alias("n"), F.expr("o.doc_id = n.doc_id"), "full_outer")
    known, new = o("doc_id").isNotNull(), n("doc_id").isNotNull()
    listed_urls = lambda t: F.coalesce(t("alternate_urls"), empty)
    switched = known & new & o("source_note").isNotNull() & F.array_contains(listed_urls(n), o("source_url"))
    url = F.when(switched, o("source_url")).otherwise(n("source_url"))
    same = o("source_url") == url
    superseded = F.array_union(F.coalesce(o("superseded_urls"), empty), F.coalesce(n("superseded_urls"), empty))
    pick = {
        "bil": F.coalesce(n("bil"), o("bil")),
        "source_url": url,
        "alternate_urls": F.when(switched, _minus(F.concat(listed_urls(n), F.array(n("source_url"))), o("source_url"))).otherwise(n("alternate_urls")),
        "superseded_urls": F.when(same, F.array_sort(superseded)).otherwise(_minus(F.concat(superseded, F.array(o("source_url"))), url)),
        "previous_sha256": o("previous_sha256"),
        **{c: F.when(switched, o(c)).otherwise(n(c)) for c in ("source", "filename", "source_note")},
        **{c: F.when(same | F.lit(c in ("sha256", "local_path")), o(c)).otherwise(n(c)) for c in DOWNLOADED},
    }
    columns = []
    for c in existing.columns:
        merged = pick.get(c, n(c))
        columns.append(F.when(known & new, merged).when(known, o(c)).otherwise(n(c)).alias(c))
    return both.select(*columns)


def only_new(listed: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    return listed.join(known.select(key).distinct(), key, "left_anti")


def best_alternate(copies: DataFrame) -> DataFrame:
    """(doc_id, url, share): of each document's other copies (url, position, share) the first with the largest share, if it exceeds ``current``."""
    better = copies.where(F.col("share") > F.col("current"))
    return better.groupBy("doc_id").agg(F.max_by(F.struct("url", "share"), F.struct("share", -F.col("position"))).alias("b")).select("doc_id", "b.*")


def revisions(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """(doc_id, status, sha256, previous_sha256): new, unchanged or revised, by the fetched content's hash (doc_id, new_sha256)."""
    joined = fetched.join(records.select("doc_id", "sha256", "previous_sha256"), "doc_id", "left")
    status = F.when(F.col("sha256").isNull(), "new").when(F.col("sha256") == F.col("new_sha256"), "unchanged").otherwise("revised")
    previous = F.coalesce("previous_sha256", F.array().cast(_NONE))
    return joined.select("doc_id", status.alias("status"), F.col("new_sha256").alias("sha256"), F.when(status == "revised", F.concat(previous, F.array("sha256"))).otherwise(previous).alias("previous_sha256"))


def needs_download(records: DataFrame) -> DataFrame:
    return records.where(F.col("fetch_date").isNull() | F.col("local_path").isNull() | (F.col("local_path") == ""))


def targets(records: DataFrame, parlimen: int, dates: list[str] | None = None, recheck_drafts: bool = False, limit: int | None = None) -> DataFrame:
    """What to fetch, by date; a limit takes the first by date."""
    missing = F.col("fetch_date").isNull() | F.col("local_path").isNull()
    wanted = missing | (F.lit(recheck_drafts) & F.coalesce("is_draft", F.lit(False)))
    own = records.where((F.col("parlimen") == parlimen) & wanted)
    own = own.where(F.col("sitting_date").isin(*dates)) if dates else own
    own = own.orderBy("sitting_date")
    return own.limit(limit) if limit else own


def cover(pages: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, bil, is_draft, text_page_share) from page texts (doc_id, page, text): the first page's number and draft note."""
    first = F.max(F.when(F.col("page") == 1, F.col("text")))
    own = pages.groupBy("doc_id").agg(first.alias("t"), F.round(F.avg((F.length("text") >= least).cast("double")), 3).alias("text_page_share"))
    return own.select("doc_id", F.nullif(F.regexp_extract("t", r"(?i)Bil\.?\s*(\d{1,3})", 1), F.lit("")).cast("int").alias("bil"), F.col("t").rlike(r"(?i)belum\s+disemak").alias("is_draft"), "text_page_share")


def title_case(records: DataFrame, column: str) -> DataFrame:
    return records.withColumn(column, T.heading_case(F.col(column)))


def download_counts(results: DataFrame) -> DataFrame:
    """(status, n) of download attempts."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def broken(records: DataFrame, least: float = 0.9) -> DataFrame:
    """Records whose file has too few pages with text; those not measured aren't judged."""
    return records.where(F.col("text_page_share").isNotNull() & (F.col("text_page_share") < least))


def unmeasured(records: DataFrame) -> DataFrame:
    """Records with a local file but without what is measured of it: to be computed again."""
    return records.where(F.col("local_path").isNotNull() & (F.col("text_page_share").isNull() | F.col("is_draft").isNull()))


def newest_first(records: DataFrame, most: int | None = None) -> DataFrame:
    """Records by date, the newest first; at most ``most`` of them, if given (the limit is the feature)."""
    own = records.orderBy(F.desc("sitting_date"), F.asc("doc_id"))
    return own if most is None else own.limit(most)
