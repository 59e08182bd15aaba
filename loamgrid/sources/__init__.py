"""Readers of what a capture starts from: robots, sitemaps, exports, snapshot indexes, item lists."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut
from ..operators.captures import CAPTURE

INVALID_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a manifest JSON document ({records: [...]}); fields it lacks are NULL."""
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType([T.StructField("records", T.ArrayType(CAPTURE))])).option("multiLine", True).json(path).select(F.inline("records"))


def read_site(spark: SparkSession, path: str, glob: str = "*.{html,htm,css}") -> DataFrame:
    """(path, content) of the files of a site's folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)[ \t]*$"), F.lit(1))


def sitemap_entries(xml: Column) -> tuple[Column, Column]:
    """(pages, nested sitemaps) of a sitemap, whatever its namespace."""
    page = "/*[local-name()='urlset']/*[local-name()='url']/*[local-name()='loc']/text()"
    nested = "/*[local-name()='sitemapindex']/*[local-name()='sitemap']/*[local-name()='loc']/text()"
    return F.transform(F.xpath(xml, F.lit(page)), lambda x: F.trim(x)), F.transform(F.xpath(xml, F.lit(nested)), lambda x: F.trim(x))


def walk_sitemaps(documents: DataFrame, start: DataFrame, most: int = 50) -> DataFrame:
    """(url): pages reached from the ``start`` sitemaps (loc) over ``documents`` (loc, xml), each sitemap once."""
    pages, nested = sitemap_entries(F.col("xml"))
    front = start.select("loc").distinct()
    seen, found = front, None
    for _ in range(most):
        docs = cut(documents.join(front, "loc", "left_semi").select(pages.alias("p"), nested.alias("n")))
        here = docs.select(F.explode("p").alias("url"))
        found = here if found is None else found.union(here)
        front = cut(docs.select(F.explode("n").alias("loc")).distinct().join(seen, "loc", "left_anti"))
        if front.isEmpty():
            return found.distinct()
        seen = seen.union(front)
    raise RuntimeError(f"sitemaps nested more than {most} deep")


def rest_links(items: Column) -> Column:
    """Non-empty links of a page of REST items (JSON array of objects)."""
    parsed = F.from_json(items, "array<struct<id: bigint, link: string>>")
    return F.filter(F.transform(parsed, lambda i: i["link"]), lambda x: x.isNotNull() & (x != ""))


def snapshots(cdx: Column) -> Column:
    """(timestamp, status, original) of a snapshot index: an array of arrays whose first row names the columns; bad header: empty."""
    rows = F.from_json(cdx, "array<array<string>>")
    head = F.get(rows, F.lit(0))
    at = [F.array_position(head, F.lit(n)).cast("int") for n in ("timestamp", "statuscode", "original")]
    good = F.coalesce((at[0] > 0) & (at[1] > 0) & (at[2] > 0), F.lit(False))
    out = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.struct(*[F.get(r, a - 1).alias(n) for a, n in zip(at, ("timestamp", "status", "original"))]))
    return F.when(good, out).otherwise(F.array().cast("array<struct<timestamp: string, status: string, original: string>>"))


def log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(level, message) of ``<date> <time> LEVEL <message>`` lines from WARNING on; others are left out."""
    p = r"^\S+ \S+ (CRITICAL|ERROR|WARNING) (.*)$"
    return lines.where(F.col(value).rlike(p)).select(F.regexp_extract(value, p, 1).alias("level"), F.regexp_extract(value, p, 2).alias("message"))


def strip_invalid_xml(s: Column) -> tuple[Column, Column]:
    """The text without characters that XML forbids, and how many there were."""
    return F.regexp_replace(s, INVALID_XML, ""), F.regexp_count(s, F.lit(INVALID_XML))


def _wxr_rows(text: str) -> Iterator[tuple]:
    root = ET.fromstring(text)
    name = lambda e: e.tag.rpartition("}")[2]
    get = lambda e, n: next((c.text or "" for c in e if name(c) == n), "")
    channel = next((e for e in root if name(e) == "channel"), root)
    for e in channel:
        if name(e) == "author":
            yield "author", get(e, "author_login"), get(e, "author_id"), None, None, None, []
        elif name(e) == "category":
            yield "category", get(e, "category_nicename"), get(e, "term_id"), None, None, None, []
        elif name(e) == "item":
            terms = [[c.get("domain", ""), c.get("nicename", "")] for c in e if name(c) == "category"]
            yield "item", get(e, "creator"), get(e, "post_id"), get(e, "link"), get(e, "post_type"), get(e, "status"), terms


def read_wxr(documents: DataFrame, text: str = "text") -> DataFrame:
    """Authors, categories and items of RSS-XML exports: (kind, name, id, link, post_type, status, terms, pos). A broken document is one row of kind ``error``; the others are read."""
    clean, _ = strip_invalid_xml(F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc in batch.column(0).to_pylist():
                try:
                    rows = [(*r, i) for i, r in enumerate(_wxr_rows(doc))] if doc else []
                except ET.ParseError as e:
                    rows = [("error", str(e), None, None, None, None, [], 0)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:6]], pa.array(cols[6], pa.list_(pa.list_(pa.string()))), pa.array(cols[7], pa.int64())], names=["kind", "name", "id", "link", "post_type", "status", "terms", "pos"])

    return documents.select(clean.alias("text")).mapInArrow(run, "kind string, name string, id string, link string, post_type string, status string, terms array<array<string>>, pos long")


def wxr_urls(wxr: DataFrame, base: str) -> DataFrame:
    """(url): what an export says exists - kept items, their terms' and their authors' archives, distinct.

    Items are kept if published posts or pages, or attachments that inherit. A term or
    author that the export doesn't define is skipped; of equal definitions the last id wins.
    """
    base = base.rstrip("/")
    kept = wxr.where("kind = 'item' AND ((post_type IN ('post', 'page') AND status = 'publish') OR (post_type = 'attachment' AND status = 'inherit'))")
    posts = kept.where("link <> ''").select(F.col("link").alias("url"))
    ids = lambda kind: wxr.where(F.col("kind") == kind).groupBy("name").agg(F.max_by(F.col("id").cast("bigint"), "pos").alias("id"))
    used = kept.select(F.explode("terms").alias("t")).select(F.get("t", F.lit(0)).alias("domain"), F.get("t", F.lit(1)).alias("name")).where("domain = 'category'").distinct()
    terms = used.join(ids("category"), "name").select(F.concat(F.lit(base + "/?cat="), F.col("id").cast("string")).alias("url"))
    authors = kept.select("name").distinct().join(ids("author"), "name").select(F.concat(F.lit(base + "/?author="), F.col("id").cast("string")).alias("url"))
    return posts.union(terms).union(authors).distinct()
