"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import captures, reports, resolve
from ..profile import SiteProfile
from . import query, table

_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_OWN = r"\.com$"  # hosts that the queries take for the site's own
_EXCLUDE = [r"/page/", r"[?&]utm_source=", r"\.php$"]


def _part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_RFC}', {n})"


def _host(u: str) -> str:
    return f"lower(regexp_extract({_part(u, 2)}, '^([^:]*)', 1))"


def _dots(p: str) -> str:
    stack = f"list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split({p}, '/'), lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END)"
    out = f"'/' || array_to_string({stack}, '/')"
    return f"CASE WHEN ends_with({p}, '/') AND NOT ends_with({out}, '/') THEN {out} || '/' ELSE {out} END"


_DIRLIKE = "NOT contains(regexp_extract({p}, '([^/]*)$', 1), '.')"
_PERMA = "array_to_string(list_filter(string_split({q}, '&'), lambda x: string_split(x, '=')[1] IN ('p', 'page_id', 'attachment_id', 'author', 'cat', 'tag', 'taxonomy', 'term')), '&')"
#: pages with the parts of their URL; n: its normalised form
_P = f"""p0 AS (SELECT page_id, url, html, lower({_part('url', 1)}) AS s, {_host('url')} AS h, {_part('url', 2)} AS auth, {_part('url', 3)} AS p, {_part('url', 4)} AS q, {_part('url', 5)} AS f, regexp_matches({_host('url')}, '{_OWN}') AS owned FROM pages),
p1 AS (SELECT *, {_dots('p')} AS d FROM p0),
p2 AS (SELECT *, CASE WHEN owned AND {_DIRLIKE.format(p='d')} AND NOT ends_with(d, '/') THEN d || '/' ELSE d END AS np, CASE WHEN owned THEN regexp_replace(h, '^(www|m|blog)\\.', '') ELSE h END AS nh, CASE WHEN owned THEN {_PERMA.format(q='q')} ELSE q END AS nq FROM p1),
n AS (SELECT *, (CASE WHEN owned THEN 'https' ELSE s END) || '://' || nh || np || (CASE WHEN nq <> '' THEN '?' || nq ELSE '' END) AS normalized FROM p2)"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _owned(url):
    return urls.host(url).rlike(_OWN)


def _normalized(url):
    return urls.normalize(url, _owned(url), F.regexp_replace(urls.host(url), r"^(www|m|blog)\.", ""))


@query(f"WITH {_P} SELECT page_id, s AS scheme, h AS host, regexp_extract(auth, ':(\\d+)$', 1) AS port, p AS path, q AS query, f AS fragment FROM p0")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.port(u).alias("port"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@query(f"WITH {_P} SELECT page_id, normalized FROM n")
def url_normalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", _normalized(F.col("url")).alias("normalized"))


@query(f"WITH {_P} SELECT page_id, (h IN ('ththre.example.com', 'www.ththre.example.com') AND (starts_with(p, '/fr/') OR p = '/fr')) OR h = 'm.ththth.example.net' AS in_scope, regexp_matches(url, '(?:/page/)|(?:[?&]utm_source=)|(?:\\.php$)') AS excluded FROM p0")
def url_in_scope(spark, sf_dir):
    profile = SiteProfile("ththre.example.com", frozenset({"www.ththre.example.com"}), base_path="/fr/", extra_hosts=frozenset({"m.ththth.example.net"}))
    return _pages(spark, sf_dir).select("page_id", urls.in_scope(F.col("url"), profile).alias("in_scope"), urls.excluded(F.col("url"), _EXCLUDE).alias("excluded"))


@query(f"WITH {_P}, x AS (SELECT *, CASE WHEN p = '' OR ends_with(p, '/') THEN p || 'index.html' ELSE p END AS f0 FROM p0), y AS (SELECT *, regexp_replace(f0, '^/+', '') AS f1 FROM x), z AS (SELECT *, regexp_extract(f1, '([^/]*)$', 1) AS name, regexp_replace(f1, '[^/]*$', '') AS folder FROM y), v AS (SELECT *, CASE WHEN q <> '' THEN folder || regexp_extract(name, '^(.+?)(\\.[^.]+)?$', 1) || '__q-' || sha256(q)[1:10] || regexp_extract(name, '^.+(\\.[^.]+)$', 1) ELSE f1 END AS f2 FROM z) SELECT page_id, CASE WHEN owned THEN f2 ELSE '_external/' || s || '_' || h || '/' || f2 END AS local_path FROM v")
def local_path(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.local_path(F.col("url"), _owned(F.col("url"))).alias("local_path"))


_OUT = r"o AS (SELECT *, regexp_replace(p, '/+$', '') AS b FROM p0), out AS (SELECT *, CASE WHEN b = '' THEN '/index.html' WHEN regexp_matches(b, '^(.*)/page/(\d+)$') THEN regexp_extract(b, '^(.*)/page/(\d+)$', 1) || '/page-' || regexp_extract(b, '^(.*)/page/(\d+)$', 2) || '.html' WHEN contains(regexp_extract(b, '([^/]*)$', 1), '.') THEN p ELSE b || '.html' END AS output_path FROM o)"


@query(f"WITH {_P}, {_OUT} SELECT page_id, output_path FROM out")
def output_path(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.internal_output_path(urls.path(F.col("url"))).alias("output_path"))


@query(f"WITH {_P}, {_OUT}, c AS (SELECT page_id, output_path, sha256(html) AS hash, row_number() OVER (PARTITION BY output_path ORDER BY page_id)::INT AS nth FROM out) SELECT page_id, nth, CASE WHEN nth = 1 THEN output_path ELSE regexp_replace(output_path, '(\\.[^./]*)?$', '') || '-' || hash[1:8] || regexp_extract(output_path, '(\\.[^./]*)$', 1) END AS claim FROM c")
def output_path_collisions(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", urls.internal_output_path(urls.path(F.col("url"))).alias("output_path"), F.sha2("html", 256).alias("hash"))
    return captures.claim_paths(rows, "output_path", "page_id", "hash").select("page_id", "nth", "claim")


@query(f"WITH {_P} SELECT page_id, coalesce(CASE WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.css') THEN '/assets/css/external/' WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.png', '.jpg', '.jpeg', '.gif', '.svg', '.webp', '.ico', '.bmp') THEN '/assets/img/external/' END, '/assets/external/' || h || '/') || name AS external_path FROM (SELECT *, coalesce(nullif(regexp_extract(regexp_replace(p, '/+$', ''), '([^/]*)$', 1), ''), 'index') AS name FROM p0)")
def external_output_path(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.external_output_path(F.col("url"), F.lit(""), F.lit(False)).alias("external_path"))


_VARIANTS = f"""{_P}, vh AS (SELECT page_id, url, owned, s, auth, q, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM p0),
vl AS (SELECT page_id, url, owned, [auth, CASE WHEN starts_with(auth, 'www.') THEN auth[5:] ELSE 'www.' || auth END] AS hosts, list_filter([p, CASE WHEN ends_with(p, '/') AND length(p) > 1 THEN regexp_replace(p, '/+$', '') WHEN NOT ends_with(p, '/') AND {_DIRLIKE.format(p='p')} THEN p || '/' END], lambda x: x IS NOT NULL) AS paths, CASE WHEN s = 'http' THEN ['http', 'https'] ELSE ['https', 'http'] END AS schemes, CASE WHEN owned AND q <> '' AND {_PERMA.format(q='q')} <> q THEN [q, {_PERMA.format(q='q')}] ELSE [q] END AS queries FROM vh),
ve AS (SELECT page_id, url, owned, iq, isx, ih, ip, schemes[isx] || '://' || hosts[ih] || paths[ip] || CASE WHEN queries[iq] <> '' THEN '?' || queries[iq] ELSE '' END AS spelling, paths FROM vl, unnest(range(1, len(queries) + 1)) AS a(iq), unnest(range(1, 3)) AS b(isx), unnest(range(1, 3)) AS c(ih), unnest(range(1, len(paths) + 1)) AS d(ip)),
variants AS (SELECT page_id, url, owned, (row_number() OVER (PARTITION BY page_id ORDER BY iq, isx, ih, ip) - 1)::INT AS rank, spelling FROM ve)"""


@query(f"WITH {_VARIANTS} SELECT page_id, rank, spelling FROM variants")
def lookup_variants(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(urls.lookup_variants(F.col("url"), _owned(F.col("url")))).alias("rank", "spelling"))


@query(f"WITH {_VARIANTS}, lk AS (SELECT spelling, page_id AS found FROM (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY rank, url) AS k FROM variants) WHERE k = 1), m AS (SELECT v.page_id, v.rank, lk.found, row_number() OVER (PARTITION BY v.page_id ORDER BY v.rank) AS k FROM variants v JOIN lk USING (spelling)) SELECT p.page_id, m.rank AS tier, m.found FROM pages p LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (page_id)")
def ref_resolution(spark, sf_dir):
    """Every page is a capture and its URL a reference."""
    pages = _pages(spark, sf_dir).select("page_id", "url", _owned(F.col("url")).alias("owned"))
    lookup = resolve.build_lookup(pages, "url", "page_id")
    return resolve.resolve_references(pages.withColumnRenamed("url", "ref"), lookup, ["page_id"]).select("page_id", "tier", F.col("target").alias("found"))


_CODE = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"
_FLAT = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_A = f"""aw AS (SELECT page_id, url, regexp_extract_all({_CODE}, '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS a FROM pages), al AS (SELECT page_id, url, unnest(range(1, len(a) + 1)) AS pos, a FROM aw), links AS (SELECT page_id, url, (pos - 1)::INT AS pos, regexp_extract(a[pos], '(?i)href="([^"]*)"', 1) AS href, {_FLAT.format(x="regexp_replace(a[pos], '(?s)<[^>]*>', ' ', 'g')")} AS text FROM al)"""


def _links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("pos", "a")).select("page_id", "url", "pos", "a.href", "a.text")


@query(f"WITH {_A} SELECT page_id, pos, href, text FROM links")
def links_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href", "text")


@query(f"WITH {_A} SELECT href, count(DISTINCT page_id) AS n_pages, count(*) AS n_links FROM links GROUP BY 1")
def link_targets(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("href").agg(F.countDistinct("page_id").alias("n_pages"), F.count("*").alias("n_links"))


@query(f"WITH {_A} SELECT page_id, pos, lower({_part('url', 1)}) || '://' || {_part('url', 2)} || href AS target FROM links WHERE starts_with(href, '/')")
def link_resolution(spark, sf_dir):
    return _links(spark, sf_dir).where(F.startswith("href", F.lit("/"))).select("page_id", "pos", urls.resolve(F.col("url"), F.col("href")).alias("target"))


@query(f"WITH {_A} SELECT page_id, pos, regexp_matches({_host('url')}, '{_OWN}') AS admitted, starts_with(href, '/') AS shaped, ends_with(href, '/') AS bare, contains(href, '.') AS dotted FROM links")
def link_admission(spark, sf_dir):
    """A link is admitted if it resolves to an owned host; extraction-side predicates beside it."""
    at = urls.resolve(F.col("url"), F.col("href"))
    return _links(spark, sf_dir).select("page_id", "pos", _owned(at).alias("admitted"), urls.url_shaped(F.col("href")).alias("shaped"), urls.bare_directory(F.col("href")).alias("bare"), F.contains("href", F.lit(".")).alias("dotted"))


@query(f"WITH {_A} SELECT href, count(DISTINCT page_id) AS n_pages, array_to_string(list_sort(list(DISTINCT text)), '|') AS wordings FROM links GROUP BY 1 HAVING count(DISTINCT page_id) > 1")
def link_wordings(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("href").agg(F.countDistinct("page_id").alias("n_pages"), F.array_join(F.array_sort(F.collect_set("text")), "|").alias("wordings")).where("n_pages > 1")


_VIA = f"{_A}, lt AS (SELECT DISTINCT lower({_part('url', 1)}) || '://' || {_part('url', 2)} || href AS u FROM links WHERE starts_with(href, '/')), via AS (SELECT url AS u, true AS listed, false AS linked FROM pages UNION ALL SELECT u, false, true FROM lt), m AS (SELECT u AS url, bool_or(listed) AS listed, bool_or(linked) AS linked FROM via GROUP BY 1)"


def _discovered(spark, sf_dir):
    linked = _links(spark, sf_dir).where(F.startswith("href", F.lit("/"))).select(urls.resolve(F.col("url"), F.col("href")).alias("url"), F.concat(F.lit("crawl:"), F.col("page_id").cast("string")).alias("via"))
    return captures.merge_discoveries(_pages(spark, sf_dir).select("url", F.lit("sitemap").alias("via")).unionByName(linked))


@query(f"WITH {_VIA} SELECT url, CASE WHEN listed AND NOT linked THEN 'orphan' WHEN linked AND NOT listed THEN 'unlisted' END AS finding FROM m")
def orphan_unlisted(spark, sf_dir):
    return _discovered(spark, sf_dir).select("url", captures.orphan_or_unlisted(F.col("discovered_via")).alias("finding"))


@query(f"WITH {_A}, x AS (SELECT url AS u, 'sitemap' AS via FROM pages UNION SELECT lower({_part('url', 1)}) || '://' || {_part('url', 2)} || href, 'crawl:' || page_id FROM links WHERE starts_with(href, '/')) SELECT u AS url, array_to_string(list_sort(list(DISTINCT via)), ',') AS provenance FROM x GROUP BY 1")
def provenance_merge(spark, sf_dir):
    return _discovered(spark, sf_dir).select("url", F.array_join("discovered_via", ",").alias("provenance"))


@query(f"WITH {_A} SELECT DISTINCT page_id, href AS ref, 'missing' AS reason FROM links WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE {_part('p.url', 3)} = href)")
def verify_references(spark, sf_dir):
    """Root-relative links with no page behind their path."""
    refs = _links(spark, sf_dir).select("page_id", F.lit("/index.html").alias("page"), F.col("href").alias("ref")).distinct()
    files = _pages(spark, sf_dir).select(urls.path(F.col("url")).alias("path")).distinct()
    return resolve.verify(refs.withColumn("page", F.concat(F.lit("/"), F.col("page_id").cast("string"))), files, "page", "ref").select(F.regexp_extract("page", r"(\d+)$", 1).cast("bigint").alias("page_id"), "ref", "reason")


@query(f"WITH {_P}, a AS (SELECT DISTINCT url AS f, normalized AS t FROM n WHERE url <> normalized) SELECT a.f AS from_url, coalesce(b.t, a.t) AS target FROM a LEFT JOIN a b ON b.f = a.t")
def alias_resolution(spark, sf_dir):
    """URLs redirect to their normal form, which is its own."""
    p = _pages(spark, sf_dir).select(F.col("url").alias("from_url"), _normalized(F.col("url")).alias("to_url")).where("from_url <> to_url").distinct()
    return captures.resolve_aliases(p).select("from_url", "target")


@query("WITH RECURSIVE e AS (SELECT o_custkey AS src, (o_custkey * 7 + 3) % 1500 AS dst FROM orders), r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def crawl_reachability(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_custkey") * 7 + 3, F.lit(1500)).alias("dst")).distinct()
    return captures.reachable(spark.range(1, 2).select(F.col("id").alias("node")), edges).select("node")


@query(f"SELECT page_id, {_FLAT.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def title_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_FLAT.format(x=f"regexp_replace({_CODE}, '(?s)<[^>]*>', ' ', 'g')")} AS text FROM pages")
def page_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS css FROM pages) SELECT sha256(css)[1:12] AS hash, max(strlen(css))::INT AS size, count(*) AS n, count(DISTINCT page_id) AS n_pages, (count(*) - 1) * max(strlen(css)) AS wasted FROM b GROUP BY 1 HAVING (count(*) - 1) * max(strlen(css)) >= 100 AND count(DISTINCT page_id) > 1""")
def inline_css_redundancy(spark, sf_dir):
    b = _pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("css"))
    return reports.redundant_blocks(b, "css", "page_id", least_bytes=100)


@query(r"""SELECT page_id, regexp_matches(html, '(?i)<form[\s>]') AS contains_form, regexp_matches(html, 'ngg-gallery|ngg_images|jetpack-slideshow|wpcf7|gform_wrapper|gform_\d+|rev_slider|n2-ss-slider|elementor-widget|wpforms-form') AS plugin_markup, regexp_matches(html, '(?i)<body[^>]*class="(?:[^"]*\s)?attachment(?:\s[^"]*)?"') AS attachment_page FROM pages""")
def markup_flags(spark, sf_dir):
    h = F.col("html")
    return _pages(spark, sf_dir).select("page_id", html.has_form(h).alias("contains_form"), html.has_plugin_markup(h).alias("plugin_markup"), html.attachment_body(h).alias("attachment_page"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<o:\w+')) AS n_office, len(regexp_extract_all(html, '(?i)<(?:a|img|object)\s[^>]*\bborder=')) AS n_border, len(regexp_extract_all(html, '&amp;')) AS n_entities, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS n_paragraphs FROM pages""")
def normalise_counts(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return _pages(spark, sf_dir).select("page_id", n(r"(?i)<o:\w+").alias("n_office"), n(r"(?i)<(?:a|img|object)\s[^>]*\bborder=").alias("n_border"), n("&amp;").alias("n_entities"), n(r"(?i)<p[\s>]").alias("n_paragraphs"))


@query("""SELECT page_id, 'ext-' || sha256('external_link' || chr(0) || url)[1:6] AS task_id FROM pages""")
def owner_task_ids(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", reports.task_id("external_link", F.col("url")).alias("task_id"))


@query(f"WITH {_A}, a AS (SELECT DISTINCT href FROM links WHERE page_id % 2 = 0), b AS (SELECT DISTINCT href FROM links WHERE page_id % 2 = 1) SELECT href, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT href, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_diff_extractions(spark, sf_dir):
    links = _links(spark, sf_dir).select("page_id", "href")
    a, b = (links.where(f"page_id % 2 = {i}").select("href").distinct() for i in (0, 1))
    return a.join(b, "href", "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, "href", "left_anti").withColumn("change", F.lit("added")))


@query("SELECT count(*) FILTER (contains(url, '/author/')) AS n_author, count(*) FILTER (contains(url, '/category/')) AS n_category, count(*) FILTER (contains(url, '/tag/')) AS n_tag, count(*) FILTER (regexp_matches(url, '/(?:19|20)\\d{2}/(?:\\d{2}/)?$')) AS n_date, count(*) FILTER (regexp_matches(url, '/page/\\d+|[?&]page=')) AS n_paged, count(*) FILTER (regexp_matches(url, '/feed/?$')) AS n_feed, count(*) FILTER (regexp_matches(url, '/author/|/category/|/tag/|/(?:19|20)\\d{2}/(?:\\d{2}/)?$|/page/\\d+|[?&]page=|/feed/?$')) AS n_any, count(*) AS n_urls FROM pages")
def low_value_archives(spark, sf_dir):
    return reports.archive_counts(_pages(spark, sf_dir), "url")


@query(f"WITH {_A} SELECT href AS target, count(DISTINCT page_id) AS n_pages, array_to_string(list_sort(list(DISTINCT page_id::VARCHAR)), ',') AS pages, min(CASE WHEN trim(text) <> '' AND NOT regexp_matches(text, '^[\\w-]+\\[|^script:') THEN text END) AS context FROM links GROUP BY 1")
def unresolved_by_target(spark, sf_dir):
    return reports.grouped_by_target(_links(spark, sf_dir).select("page_id", F.col("href").alias("target"), "text"), "target", "page_id", "text")


@query(f"WITH {_A} SELECT page_id, value, text FROM (SELECT page_id, href AS value, text FROM links)")
def html_elements(spark, sf_dir):
    """Anchors by the tolerant parser; the oracle finds them by expressions alone."""
    refs = html.extract_references(_pages(spark, sf_dir).select("page_id", "url", "html"))
    return refs.where("context = 'a[href]'").select("page_id", "value", "text")


@query(f"WITH {_A} SELECT page_id, pos, 'hyperlink' AS kind, 'a[href]' AS context, href AS value, CASE WHEN starts_with(href, '/') THEN {_part('url', 1)} || '://' || {_part('url', 2)} || href ELSE href END AS url, text FROM links")
def html_references(spark, sf_dir):
    """All references of all kinds, by the tolerant parser."""
    return html.extract_references(_pages(spark, sf_dir).select("page_id", "url", "html"))


@query(f"WITH {_P}, {_OUT}, x AS (SELECT DISTINCT regexp_replace(output_path, '^/', '') AS path FROM out) SELECT a.path FROM x a WHERE EXISTS (SELECT 1 FROM x b WHERE starts_with(b.path, a.path || '/'))")
def prefix_collisions(spark, sf_dir):
    """Output files that would also have to be a folder."""
    paths = _pages(spark, sf_dir).select(F.regexp_replace(urls.internal_output_path(urls.path(F.col("url"))), "^/", "").alias("path")).distinct()
    return captures.prefix_collisions(paths, "path")


@query(f"WITH {_P} SELECT page_id, (SELECT CASE WHEN regexp_matches(h, '^www\\.') THEN regexp_replace(h, '^www\\.', '') ELSE h END) AS bare, regexp_replace(regexp_replace(h, '^www\\.', ''), '[^a-z0-9]+', '-', 'g') AS slug FROM p0")
def site_slugs(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", F.regexp_replace(urls.host(u), r"^www\.", "").alias("bare"), urls.slug(u).alias("slug"))


def _task_sql(kind: str, prefix: str, target: str) -> str:
    return f"'{prefix}-' || sha256('{kind}' || chr(0) || {target})[1:6] AS task_id, '{kind}' AS kind, {target} AS target"


@query(f"WITH {_A} SELECT {_task_sql('internal_link', 'int', 'href')}, count(DISTINCT page_id) AS n_pages FROM links WHERE starts_with(href, '/') GROUP BY href UNION ALL SELECT {_task_sql('external_link', 'ext', 'href')}, count(DISTINCT page_id) FROM links WHERE NOT starts_with(href, '/') GROUP BY href UNION ALL SELECT {_task_sql('missing_file', 'mis', 'url')}, count(DISTINCT page_id) FROM pages GROUP BY url")
def owner_tasks(spark, sf_dir):
    """Root-relative links count as broken internal ones, others as broken external ones, pages as missing files."""
    from ..operators import checklist

    links = _links(spark, sf_dir).select(F.col("href").alias("target"), F.col("page_id").alias("page"))
    own = F.startswith("target", F.lit("/"))
    broken = links.where(~own).select(F.col("target").alias("url"), "page", F.lit("http").alias("kind"))
    missing = _pages(spark, sf_dir).select(F.col("url").alias("target"), F.col("page_id").alias("page"))
    return checklist.owner_tasks(missing, broken, links.where(own)).select("task_id", "kind", "target", "n_pages")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</?o:\w+[^>]*>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS html FROM pages""")
def markup_repairs(spark, sf_dir):
    from ..functions import rewrite

    return _pages(spark, sf_dir).select("page_id", rewrite.repair(F.col("html")).alias("html"))


@query(r"""SELECT page_id, regexp_replace(html, '(?is)<form\b.*?</form>', '', 'g') AS html, len(regexp_extract_all(html, '(?is)<form\b.*?</form>')) AS n_forms FROM pages""")
def policy_removals(spark, sf_dir):
    from ..functions import rewrite

    return _pages(spark, sf_dir).select("page_id", rewrite.apply_policy(F.col("html")).alias("html"), F.size(rewrite.forms(F.col("html"))).cast("bigint").alias("n_forms"))


@query(r"""SELECT page_id, regexp_replace(html, '(<a href=")(/[^"]*)"', '\1/site\2.html"', 'g') AS html FROM pages""")
def rewritten_pages(spark, sf_dir):
    """Every root-relative link moved below /site."""
    from ..functions import rewrite

    links = _links(spark, sf_dir).where(F.startswith("href", F.lit("/"))).select("page_id", F.col("href").alias("value"), F.concat(F.lit("/site"), F.col("href"), F.lit(".html")).alias("target"))
    return rewrite.rewrite_pages(_pages(spark, sf_dir), links)


@query(f"WITH {_A}, s AS (SELECT page_id AS page, href AS value, text AS context FROM links), d AS (SELECT DISTINCT page, value, context FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY page, value) AS k FROM d) SELECT page, value, CASE WHEN k > 1 THEN context END AS context FROM n")
def unresolved_distinct(spark, sf_dir):
    from ..operators import checklist

    return checklist.unresolved_references(_links(spark, sf_dir).select(F.col("page_id").alias("page"), F.col("href").alias("value"), F.col("text").alias("context")))


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'unread' WHEN page_id % 3 = 1 THEN 'trusted' ELSE 'changed' END AS bucket, count(*) AS n FROM pages GROUP BY 1 UNION ALL SELECT 'new_urls', (WITH " + _A + " SELECT count(DISTINCT href) FROM links WHERE page_id % 3 = 1)")
def rescan_accounting(spark, sf_dir):
    from ..operators import checklist

    p = _pages(spark, sf_dir).select(F.col("page_id").alias("url"), F.sha2("html", 256).alias("content_hash"), F.when(F.col("page_id") % 3 == 1, F.sha2("html", 256)).when(F.col("page_id") % 3 == 2, F.lit("other")).alias("bytes_hash"))
    found = _links(spark, sf_dir).select(F.col("page_id").alias("source"), F.col("href").alias("url"))
    return checklist.rescan(p, _pages(spark, sf_dir).select("url"), found)


@query("SELECT p.page_id, 'shape_mismatch' AS problem FROM pages p WHERE ends_with(p.url, '/') AND p.page_id % 2 = 0 UNION ALL SELECT page_id, 'file_missing' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'hash_mismatch' FROM pages WHERE page_id % 5 = 1")
def integrity_findings(spark, sf_dir):
    from ..operators import checklist

    p = _pages(spark, sf_dir)
    c = p.select("url", "page_id", F.col("page_id").cast("string").alias("local_path"), F.sha2("html", 256).alias("content_hash"), F.when(F.col("page_id") % 2 == 0, F.lit("Text/Plain; charset=x")).alias("content_type"))
    files = p.where("page_id % 5 <> 0").select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 5 == 1, F.lit("x")).otherwise(F.col("html")).cast("binary").alias("content"))
    return checklist.integrity(c, files, "page_id").select("page_id", "problem")


@query("SELECT b.text AS message, count(*) AS n, count(DISTINCT conv_id) AS n_pages FROM (SELECT conv_id, text FROM conversations WHERE role = 'user') b GROUP BY 1")
def validation_issues(spark, sf_dir):
    from ..operators import checklist

    m = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", F.lit("error")).otherwise(F.lit("info")).alias("type"), F.col("text").alias("message"), F.col("conv_id").alias("url"), F.col("text").alias("extract"))
    return checklist.markup_quirks(m).select("message", "n", "n_pages")


@query(f"WITH t AS (SELECT page_id, {_FLAT.format(x=f"regexp_replace({_CODE}, '(?s)<[^>]*>', ' ', 'g')")} AS x, html FROM pages) SELECT count(*) AS n_pages, count(*) FILTER (NOT contains(html, '<article')) AS no_body, count(*) FILTER (NOT regexp_matches(html, '(?i)<form[\\s>]')) AS no_form, count(*) FILTER (contains(html, 'class=\"ad\"')) AS excluded, count(*) FILTER (x = '') AS empty FROM t")
def search_coverage(spark, sf_dir):
    from ..operators import checklist, content

    h = F.col("html")
    return checklist.search_coverage(_pages(spark, sf_dir).select(F.contains(h, F.lit("<article")).alias("has_body"), html.has_form(h).alias("has_form"), F.size(content.words(html.visible_text(h))).alias("n_words"), F.contains(h, F.lit('class="ad"')).alias("excluded")))
