"""Readers of feed payloads: RSS, annotation windows, article lists, pages, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import collapse, decode_entities, strip_html
from tidewire.sources import readable

# Positions of the fields of an annotation window's rows.
FIELDS = 27
GKG = {"record": 0, "seen": 1, "domain": 3, "url": 4, "themes": 8, "locations": 10, "persons": 12, "organizations": 14, "tone": 15, "extras": 26}
ARCHIVE_BYTES, CSV_BYTES = 64 << 20, 32 << 20
LEAST_BODY = 600
RSS_ITEM = "title string, link string, guid string, pubDate string, `dc:date` string, description string, `content:encoded` string"


def rss_items(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """(all columns, item): one row for each item of RSS payloads, with title, link, published text and body text.

    ``content:encoded`` goes before ``description``, ``pubDate`` before ``dc:date``, and the guid stands in for a missing link.
    Payloads without a channel give no rows; :func:`not_rss` lists them.
    """
    raw = F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    each = payloads.select("*", F.posexplode(raw).alias("position", "_item")).where(F.col(xml).rlike(r"(?s)<rss\b.*<channel\b"))

    def field(*names: str) -> Column:
        one = lambda n: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("_item", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1)), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"), F.lit(""))
        return F.coalesce(*[one(n) for n in names])

    return each.select(
        *payloads.columns, "position", collapse(strip_html(field("title"))).alias("title"), F.trim(field("link", "guid")).alias("link"),
        F.trim(field("pubDate", "dc:date")).alias("published"), strip_html(field("content:encoded", "description")).alias("body"),
    ).withColumn("link", F.regexp_replace("link", "&amp;", "&"))


def not_rss(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    return payloads.where(~F.coalesce(F.col(xml).rlike(r"(?s)<rss\b.*<channel\b"), F.lit(False)))


def read_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of a folder of RSS files by Spark's XML source, which splits on items."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


def stamp(digits: Column) -> Column:
    """A 14-digit UTC stamp as a timestamp; impossible dates are null, never rolled over."""
    return F.when(digits.rlike(r"^\d{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def gkg_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Scalar fields of annotation rows: record, seen_at, domain, url, title, published_at, tone, and the four raw annotation fields.

    Rows with another number of fields keep their record id alone, with ``malformed`` true.
    """
    part = F.split(value, "\t", -1)
    sound = F.size(part) == FIELDS
    at = lambda name: F.when(sound, F.get(part, F.lit(GKG[name])))
    extras = at("extras")
    title = decode_entities(F.nullif(F.trim(F.regexp_extract(extras, r"<PAGE_TITLE>([^<]*)</PAGE_TITLE>", 1)), F.lit("")))
    precise = stamp(F.regexp_extract(extras, r"<PAGE_PRECISEPUBTIMESTAMP>(\d*)</PAGE_PRECISEPUBTIMESTAMP>", 1))
    return lines.select(
        F.get(part, F.lit(0)).alias("record"), (~sound).alias("malformed"), stamp(at("seen")).alias("seen_at"), F.lower(F.trim(at("domain"))).alias("domain"), F.trim(at("url")).alias("url"),
        title.alias("title"), F.coalesce(precise, stamp(at("seen"))).alias("published_at"), F.get(F.split(at("tone"), ","), F.lit(0)).try_cast("double").alias("tone"),
        *[at(x).alias(x) for x in ("themes", "locations", "persons", "organizations")],
    )


def file_rejected(rows: DataFrame) -> bool:
    """Whether no row of a window has the right number of fields."""
    return rows.where("not malformed").isEmpty()


LOCATION = "struct<featureId:string,countryCode:string,latitude:double,longitude:double>"


def annotations(rows: DataFrame) -> DataFrame:
    """(record, kind, surface_name, char_offset, location_detail), one row an occurrence.

    Names are ``Name,offset`` with the offset behind the last comma.  Locations have nine parts; an empty coordinate is null,
    one that is no number or out of range drops the entry.
    """
    named = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("raw")) for kind, column in (("theme", "themes"), ("person", "persons"), ("organization", "organizations"))])
    entries = rows.select("record", F.explode(named).alias("a")).select("record", "a.kind", F.explode(F.split("a.raw", ";")).alias("entry"))
    pattern = r"^(.*),\s*(\d{1,9})\s*$"
    names = entries.select("record", "kind", F.regexp_extract("entry", pattern, 1).alias("surface_name"), F.regexp_extract("entry", pattern, 2).try_cast("int").alias("char_offset"), F.lit(None).cast(LOCATION).alias("location_detail"))
    part = lambda i: F.trim(F.get(F.split("entry", "#", -1), F.lit(i)))

    def coordinate(i: int, most: int) -> tuple[Column, Column]:
        number = part(i).try_cast("double")
        return F.when(part(i) != "", number), (part(i) == "") | (number.isNotNull() & (F.abs(number) <= most))

    (lat, lat_ok), (lon, lon_ok) = coordinate(5, 90), coordinate(6, 180)
    places = rows.select("record", F.explode(F.split("locations", ";")).alias("entry")).where((F.size(F.split("entry", "#", -1)) == 9) & lat_ok & lon_ok & part(8).rlike(r"^\d{1,9}$"))
    blank = lambda i: F.nullif(part(i), F.lit(""))
    detail = F.struct(blank(7).alias("featureId"), blank(2).alias("countryCode"), lat.alias("latitude"), lon.alias("longitude"))
    located = places.select("record", F.lit("location").alias("kind"), F.get(F.split("entry", "#", -1), F.lit(1)).alias("surface_name"), part(8).cast("int").alias("char_offset"), detail.cast(LOCATION).alias("location_detail"))
    return names.union(located).where((F.trim("surface_name") != "") & F.col("char_offset").isNotNull())


ARTICLE_LIST = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>>"


def article_list(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(all columns, failure, url, title, seen_at, domain): records of article lists; a malformed body is one row with ``failure``."""
    text = F.trim(body)
    parsed = F.from_json(text, ARTICLE_LIST)
    listed = F.get_json_object(text, "$.articles")
    failure = F.when(text.isNull() | (text == ""), "empty body").when(~text.startswith("{") | F.try_parse_json(text).isNull(), "not a JSON object").when(listed.isNotNull() & ~listed.startswith("["), "articles is not a list")
    each = payloads.withColumn("failure", failure).select("*", F.explode_outer(F.when(F.col("failure").isNull(), parsed["articles"])).alias("r"))
    seen = F.try_to_timestamp("r.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return each.where(F.col("failure").isNotNull() | F.col("r").isNotNull()).select(*payloads.columns, "failure", "r.url", "r.title", seen.alias("seen_at"), F.lower("r.domain").alias("domain"))


def list_request(url: str, records: int = 250) -> str:
    """The request for an article list: a query is required; mode, format and record count are forced."""
    parts = urlsplit(url)
    params = dict(parse_qsl(parts.query))
    if not params.get("query"):
        raise ValueError("the URL has no query parameter")
    return urlunsplit(parts._replace(query=urlencode(params | {"mode": "artlist", "format": "json", "maxrecords": str(records)})))


def window_url(listing: str, host: str) -> str:
    """The archive that a listing of the last window names."""
    found = [line.split()[-1] for line in listing.splitlines() if line.strip().endswith(".gkg.csv.zip")]
    if not found or urlsplit(found[-1]).hostname != host:
        raise ValueError("the listing names no archive of this host")
    return found[-1]


def list_requests(url: Column, records: int = 250) -> Column:
    """``list_request`` as a column: null without a query parameter; a forced parameter keeps its first place, a missing one is appended."""
    forced = {"mode": "artlist", "format": "json", "maxrecords": str(records)}
    pairs = F.filter(F.split(F.try_parse_url(url, F.lit("QUERY")), "&"), lambda p: p != "")
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), F.get(names, i).alias("name"), (F.array_position(names, F.get(names, i)) == i + 1).alias("first"))), lambda x: x["first"] | ~x["name"].isin(*forced))
    held = F.transform(kept, lambda x: F.coalesce(*[F.when(x["name"] == k, F.lit(f"{k}={v}")) for k, v in forced.items()], x["pair"]))
    missing = F.filter(F.array(*[F.lit(f"{k}={v}") for k, v in forced.items()]), lambda p: ~F.array_contains(names, F.substring_index(p, "=", 1)))
    asked = F.exists(pairs, lambda p: p.rlike("^query=."))
    return F.when(asked, F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), F.array_join(F.concat(held, missing), "&")))


def window_urls(listing: Column, host: str) -> Column:
    """``window_url`` as a column: null where the listing names no archive of this host."""
    last = F.try_element_at(F.regexp_extract_all(listing, F.lit(r"(?m)(\S+\.gkg\.csv\.zip)[^\S\n]*$"), 1), F.lit(-1))
    return F.when(F.lower(F.try_parse_url(last, F.lit("HOST"))) == host, last)


#: Lines of an archive that leave the reader at once.
LINES = 10_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, failure, value): lines of the zipped windows in a folder."""
    return archive_lines(spark.read.format("binaryFile").load(path))


def archive_slices(content: bytes) -> Iterator[tuple[str | None, list[str | None]]]:
    """(failure, lines) of one zipped window, slice by slice."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            csv = [x for x in z.infolist() if x.filename.lower().endswith(".csv")]
            if len(csv) != 1 or csv[0].file_size > CSV_BYTES:
                yield "archive out of bounds", [None]
                return
            lines = [x for x in z.read(csv[0]).decode("utf-8", "replace").split("\n") if x]
    except zipfile.BadZipFile:
        yield "not an archive", [None]
        return
    for i in range(0, max(1, len(lines)), LINES):
        yield None, lines[i : i + LINES] or [None]


def archive_lines(files: DataFrame) -> DataFrame:
    """(path, failure, value): lines of zipped windows (path, length, content); an archive must hold exactly one .csv and keep within the size limits.

    The content of an archive beyond the limit is never handed over, and lines leave in slices.
    """
    small = files.where(F.col("length") <= ARCHIVE_BYTES).select("path", "content")
    large = files.where(F.col("length") > ARCHIVE_BYTES).select("path", F.lit("archive out of bounds").alias("failure"), F.lit(None).cast("string").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                for failure, rows in archive_slices(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array([failure] * len(rows), pa.string()), pa.array(rows, pa.string())], ["path", "failure", "value"])

    return small.mapInArrow(run, "path string, failure string, value string").unionByName(large)


def main_text(html: Column, least: int = LEAST_BODY) -> Column:
    """The running text of a page by its node tree, white space collapsed; null below ``least`` characters, which is no reporting."""

    def long_enough(page: str | None) -> str | None:
        text = readable.main_text(page)
        return text if len(text) >= least else None

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(long_enough)

    return run(html)
