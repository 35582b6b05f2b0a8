"""HTML and XML scans: links, members, profile values, trees. DOM forms use the standard parser in Arrow UDFs; links also have a regex form."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators.catalog import parse_filename

#: CSS classes of a member list's fields.
_CLASSES = {"first-name": "name", "constituency": "seat_code", "province": "constituency"}


class _Events(HTMLParser):
    """All start tags, texts and end tags, in order."""

    def __init__(self, page: str):
        super().__init__()
        self.events: list[tuple[str, str, dict[str, str]]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


def page_links(page: str) -> list[dict[str, str]]:
    out, href, held = [], None, []
    for kind, value, attrs in _Events(page).events:
        if (kind, value) == ("start", "a"):
            href, held = attrs.get("href"), []
        elif kind == "text":
            held.append(value)
        elif (kind, value) == ("end", "a") and href is not None:
            out.append({"href": href, "text": " ".join("".join(held).split())})
            href = None
    return out


def page_value(page: str, label: str) -> str | None:
    """The first cell with text after the cell that reads ``label``."""
    inside = found = False
    for kind, value, _ in _Events(page).events:
        if value == "td" and kind in ("start", "end"):
            inside = kind == "start"
        elif kind == "text" and inside and (text := " ".join(value.split())):
            if found:
                return text
            found = text.lower() == label.lower()
    return None


def _rows(f, fields: tuple[str, ...]):
    kind = pa.list_(pa.struct([(x, pa.string()) for x in fields]))

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([[] if p is None else f(p) for p in pages.to_pylist()], kind)

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<struct<{','.join(f'{x}:string' for x in fields)}>>")


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, href, text) of all links, by the parser."""
    return pages.select(key, F.posexplode(_rows(page_links, ("href", "text"))(html)).alias("position", "l")).select(key, "position", "l.*")


def links_by_pattern(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, href) of double-quoted links, without leaving the JVM."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('<a [^>]*?href="([^"]*)"'), F.lit(1))).alias("position", "href"))


def _plain(html: Column) -> Column:
    """The text of a piece of HTML: no tags, entities resolved, single blanks."""
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    return T.collapse(F.coalesce(T.arrow(unescape, "string")(F.when(F.contains(bare, F.lit("&")), bare)), bare))


def _absolute(base: str, link: Column) -> Column:
    """A link against the page's base: as it is, from the host's root, or below the base."""
    root = "/".join(base.split("/")[:3])
    whole = F.coalesce(T.arrow(unescape, "string")(F.when(F.contains(link, F.lit("&")), link)), link)
    return F.when(whole.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), whole).when(F.startswith(whole, F.lit("/")), F.concat(F.lit(root), whole)).otherwise(F.concat(F.lit(f"{base}/"), whole))


def members(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """Members, one for each list item that has all five fields, in the JVM: items are split, then each field is extracted by its own pattern."""
    item = pages.select(F.explode(F.slice(F.split(html, r"(?i)<li\b"), 2, 1 << 30)).alias("rest")).select(F.regexp_extract("rest", r"(?is)^(.*?)(</li\s*>|$)", 1).alias("item"))

    def tag(name: str, holds: str, attribute: str) -> Column:
        """An attribute of the last tag of that name which holds a pattern; empty if there is none."""
        tags = F.filter(F.regexp_extract_all("item", F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(holds))
        return F.regexp_extract(F.coalesce(F.get(tags, F.size(tags) - 1), F.lit("")), rf"(?is)\b{attribute}\s*=\s*[\"']([^\"']*)", 1)

    fields = {field: _plain(F.regexp_extract("item", rf"(?is)<(span|div)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{css}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>", 2)) for css, field in _CLASSES.items()}
    photo, profile = tag("img", r"(?is)\bclass\s*=\s*[\"'](?:[^\"']*\s)?picture[\s\"']", "src"), tag("a", r"(?is)\bhref\s*=\s*[\"'][^\"']*profile-ahli", "href")
    own = item.select(*[c.alias(f) for f, c in fields.items()], photo.alias("photo"), profile.alias("profile"))
    whole = own.where((F.least("name", "seat_code", "constituency", "photo", "profile") != ""))
    return whole.select("name", "seat_code", "constituency", _absolute(base, F.col("photo")).alias("photo_url"), _absolute(base, F.col("profile")).alias("profile_url"))


def profile_value(html: Column, label: str = "Parti") -> Column:
    return T.arrow(lambda p: page_value(p, label) or "", "string")(html)


def title(html: Column) -> Column:
    return T.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Fixed value: how a tree names a file.
_FILE = re.compile(r"(?i)loadResult\('([^']+\.pdf)'")


def page_items(body: str) -> list[dict[str, str | None]]:
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", body))
    out = []
    for item in root.findall("item"):
        link = item.find("userdata[@name='myurl']")
        file = _FILE.search((link.text if link is not None else None) or "")
        out.append({"id": item.get("id", ""), "text": " ".join(item.get("text", "").split()), "url": file and file.group(1)})
    return out


def tree_items(body: Column) -> Column:
    """array<struct(id, text, url)> of the direct item children of an XML tree; a declaration before it is skipped; url: the file an item opens, or null."""
    return _rows(page_items, ("id", "text", "url"))(body)


def numbered_links(found: DataFrame, pattern: str, ordinals: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., handle, text, number): links to handles whose text begins with a number or an ordinal word; of one handle (of each ``by``) the last counts."""
    token = F.upper(F.regexp_extract("text", pattern, 1))
    number = F.array_position(F.array(*map(F.lit, T.ORDINALS)), token).cast("int") if ordinals else F.try_to_number(token, F.lit("999")).cast("int")
    own = found.where(F.col("href").startswith("/handle/") & F.col("text").rlike(pattern)).withColumn("number", F.nullif(number, F.lit(0))).where("number IS NOT NULL")
    own = own.withColumn("handle", F.substring("href", 9, 1 << 20))
    return own.groupBy(*by, "handle").agg(F.max_by(F.struct("text", "number"), "position").alias("x")).select(*by, "handle", "x.*").orderBy("number")


def listed_files(found: DataFrame, prefix: str = "/bitstream/", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., path, filename, parsed) of links to sitting files, without their query strings; parsed is null where the name has another shape."""
    path = F.substring_index("href", "?", 1)
    own = found.where(F.col("href").startswith(prefix)).select(*by, path.alias("path"), F.url_decode(T.basename(path)).alias("filename")).distinct()
    own = own.where(F.lower("filename").endswith(".pdf") | ~F.contains("filename", F.lit(".")))
    return own.withColumn("parsed", parse_filename(F.col("filename")))
