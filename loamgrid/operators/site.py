"""What a site says about itself, held against what was captured: seeding, aliases, redirects, links to other sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..profile import SiteProfile

MEDIA = tuple("jpg jpeg png gif webp svg bmp tif tiff mp3 wav m4a aac ogg flac mp4 mov avi webm mkv m4v wmv pdf doc docx ppt pptx xls xlsx odt ods odp".split())
SHORTLINKED = ("posts", "pages", "media")
FETCHED = ("fetched", "fetched_wayback")


def seeded(found: DataFrame, profile: SiteProfile, exclusions: list[str], url: str = "url") -> DataFrame:
    """Each discovered URL with ``normalized`` and ``kept``: in scope and not excluded, both tested on the normal form."""
    n = urls.normalize_for(F.col(url), profile)
    out = found.withColumn("normalized", n)
    keep = urls.in_scope(F.col("normalized"), profile) & ~urls.excluded(F.col("normalized"), exclusions)
    return out.withColumn("kept", F.coalesce(keep, F.lit(False)))


def seed_counts(seeded_: DataFrame, source: str = "source") -> DataFrame:
    """(source, kept, rejected): how many of a source's URLs were entered, repeats included."""
    return seeded_.groupBy(source).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"))


def inventory(seeded_: DataFrame, source: str = "source") -> DataFrame:
    """(url, discovered_via): one row a kept URL, with its sources sorted."""
    return seeded_.where("kept").groupBy(F.col("normalized").alias("url")).agg(F.array_sort(F.collect_set(source)).alias("discovered_via"))


def shortlink_aliases(items: DataFrame, captures: DataFrame, base_url: str, profile: SiteProfile) -> DataFrame:
    """(url, alias): the ``?p=`` spelling of every listed post, page and medium that is known already.

    ``items``: collection, id, link; ``captures``: url. Items annotate captures and never make one.
    """
    link = urls.normalize_for(F.col("link"), profile)
    some = items.where(F.col("collection").isin(*SHORTLINKED) & F.col("id").isNotNull() & (F.col("link") != ""))
    alias = urls.normalize_for(F.concat(F.lit(base_url.rstrip("/") + "/?p="), F.col("id").cast("string")), profile)
    named = some.select(link.alias("url"), alias.alias("alias")).where(urls.in_scope(F.col("url"), profile)).distinct()
    return named.join(captures.select("url"), "url", "left_semi")


def redirect_map(captures: DataFrame) -> DataFrame:
    """(url, request, target): a permanent redirect for every other spelling of a page that was written.

    ``captures``: url, status, output_path, aliases, redirect_from. An origin with the
    page's own path and no query needs none. Ordered by url and origin when written.
    """
    ok = captures.where(F.col("status").isin(*FETCHED) & (F.col("output_path") != ""))
    empty = F.array().cast("array<string>")
    origins = F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("redirect_from", empty)))
    each = ok.select("url", "output_path", F.explode(origins).alias("origin"))
    slash = lambda u: F.when(urls.path(u) == "", F.lit("/")).otherwise(urls.path(u))
    o = F.col("origin")
    request = F.when(urls.query(o) == "", slash(o)).otherwise(F.concat(slash(o), F.lit("?"), urls.query(o)))
    each = each.where((slash(o) != slash(F.col("url"))) | (urls.query(o) != ""))
    return each.select("url", "origin", urls.htaccess_safe(request).alias("request"), urls.htaccess_safe(F.col("output_path")).alias("target"))


def redirect_lines(map_: DataFrame, base_path: str = "/") -> DataFrame:
    """(pos, line) of an htaccess file: what its writer orders by ``pos`` and ``line``."""
    own = base_path.strip("/")
    rules = ["RewriteEngine On", *([f"RewriteRule ^{own}/?$ /index.html [L]"] if own else []), "RewriteCond %{REQUEST_FILENAME} !-f", "RewriteRule ^(.*)/$ /$1.html [L]"]
    head = map_.sparkSession.createDataFrame(list(enumerate(rules)), "pos long, line string").withColumn("url", F.lit("")).withColumn("origin", F.lit(""))
    rest = map_.select(F.lit(len(rules)).cast("long").alias("pos"), F.concat(F.lit("Redirect 301 "), "request", F.lit(" "), "target").alias("line"), "url", "origin")
    return head.unionByName(rest)


def external_links(anchors: DataFrame, profile: SiteProfile, most_texts: int = 3) -> DataFrame:
    """(url, n_pages, texts): every address outside the scope that the built site links to, with its first wordings.

    ``anchors``: page, pos, href, text. Fragments are cut off, ``//`` counts as https.
    The pages of each are rows of ``external_link_pages``, since one address may be on all.
    """
    rows = _external(anchors, profile)
    first = rows.where("text <> ''").groupBy("url", "text").agg(F.min(F.struct("page", "pos")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("at"))).where(F.col("n") <= most_texts)
    texts = ranked.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"))
    pages = rows.groupBy("url").agg(F.countDistinct("page").alias("n_pages"))
    return pages.join(texts, "url", "left").select("url", "n_pages", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def external_link_pages(anchors: DataFrame, profile: SiteProfile) -> DataFrame:
    return _external(anchors, profile).select("url", "page").distinct()


def _external(anchors: DataFrame, profile: SiteProfile) -> DataFrame:
    h = F.trim("href")
    skipped = F.lower(h).rlike(r"^(?:data:|javascript:|mailto:|tel:|sms:|about:|#)")
    whole = F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).otherwise(h)
    url = F.regexp_replace(whole, "#.*$", "")
    rows = anchors.where((h != "") & ~skipped).select("page", "pos", url.alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(~urls.unparseable(F.col("url")) & (urls.scheme(F.col("url")) != "") & ~urls.in_scope(F.col("url"), profile))


def link_results(links: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """(url, ok, status, kind, reason) of every link that was asked for. ``outcomes_``: url, status, error, flag (one a URL)."""
    from . import outcomes

    j = links.select("url").join(outcomes_, "url", "left")
    ok = F.coalesce(F.col("error").isNull() & F.col("flag").isNull() & F.col("status").between(200, 299), F.lit(False))
    kind, text = outcomes.failure_kind(F.col("error"), F.col("flag")), outcomes.failure_text(F.col("error"), F.col("flag"), F.col("status"))
    return j.select("url", ok.alias("ok"), "status", F.when(~ok, kind).alias("kind"), F.when(~ok, text).alias("reason"))


def broken_by_page(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, url, kind): the broken links of each page. ``pages``: url, page."""
    return pages.join(results.where("NOT ok").select("url", "kind"), "url").select("page", "url", "kind")


def homepage(captures: DataFrame, base_url: str) -> DataFrame:
    """(url, status, folded): the capture whose URL or alias is the base URL, however spelled; no row if there is none.

    ``captures``: url, aliases, status. Of several, the smallest URL.
    """
    target = urls.comparable(F.lit(base_url))
    names = F.concat(F.array("url"), F.coalesce("aliases", F.array().cast("array<string>")))
    hit = captures.where(F.exists(names, lambda x: urls.comparable(x) == target))
    best = hit.agg(F.min(F.struct("url", "status", F.coalesce(F.size("aliases"), F.lit(0)).alias("folded"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.url", "b.status", F.greatest("b.folded", F.lit(0)).alias("folded"))


def provenance_presence(captures: DataFrame) -> DataFrame:
    """One row: which kinds of source found anything. ``captures``: discovered_via."""
    via = captures.select(F.explode("discovered_via").alias("v"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return via.agg(*[some(F.col("v") == k).alias(k) for k in ("sitemap", "rest_api", "xml_backup")], *[some(F.startswith("v", F.lit(k + ":"))).alias(k) for k in ("crawl", "wayback")])


def source_overlap(captures: DataFrame) -> DataFrame:
    """(sources, n): inventory URLs by the set of sources that list them."""
    listed = F.array_sort(F.filter("discovered_via", lambda v: v.isin("sitemap", "rest_api", "xml_backup")))
    return captures.select(F.array_join(listed, "+").alias("sources")).where("sources <> ''").groupBy("sources").agg(F.count("*").alias("n"))


def unresolved_exports(captures: DataFrame) -> DataFrame:
    """(url): what an export says exists and nothing could fetch."""
    return captures.where((F.col("status") == "missing") & F.array_contains("discovered_via", "xml_backup")).select("url")


def media_file(url: Column) -> Column:
    """Whether a URL's name has the suffix of something that a site's owner would miss."""
    name = urls.last_segment(urls.path(url))
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*MEDIA)


def missing_files(captures: DataFrame) -> DataFrame:
    """(url, media) of everything missing: media is asked for, the rest only counted."""
    return captures.where("status = 'missing'").select("url", media_file(F.col("url")).alias("media"))


def pages_of_missing(captures: DataFrame) -> DataFrame:
    """(url, page): the pages that refer to a missing file, by output path where one is known."""
    pages = captures.select(F.col("url").alias("page_url"), "output_path")
    via = captures.where("status = 'missing'").select("url", F.explode("discovered_via").alias("v")).where(F.startswith("v", F.lit("crawl:")))
    via = via.select("url", F.substring("v", 7, 1 << 30).alias("page_url"))
    return via.join(pages, "page_url", "left").select("url", F.coalesce("output_path", "page_url").alias("page")).distinct()


def partition_faults(whole: DataFrame, parts: list[DataFrame], key: str = "url") -> DataFrame:
    """(key, n): members that are not in exactly one part; none if the parts divide the whole."""
    each = whole.select(key, F.lit(0).alias("n"), F.lit(1).alias("w"))
    for p in parts:
        each = each.unionByName(p.select(key, F.lit(1).alias("n"), F.lit(0).alias("w")))
    return each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).where("n <> 1 OR w <> 1").select(key, "n")


def path_conflicts(rows: DataFrame, path: str = "output_path", key: str = "url") -> DataFrame:
    """(path, n): output paths of the site's own pages that more than one page claims, which must not be."""
    return rows.groupBy(path).agg(F.countDistinct(key).alias("n")).where("n > 1")


def rewrite_totals(events: DataFrame) -> DataFrame:
    """(outcome, n, n_pages) of a build's references. ``events``: page, outcome."""
    return events.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("page").alias("n_pages"))


def attachment_media(items: DataFrame, media: DataFrame) -> DataFrame:
    """(url, target): attachment pages led to their file. ``items``: url, file; ``media``: url, output_path (fetched files)."""
    return items.join(media.select(F.col("url").alias("file"), F.col("output_path").alias("target")), "file").select("url", "target")
