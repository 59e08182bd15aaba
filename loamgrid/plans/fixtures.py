"""Queries over small tables that hold the cases which the test tables lack; each oracle lists the rows that must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import html, rewrite, urls
from ..operators import captures, checklist, content, outcomes, reports, resolve, site
from ..profile import SiteProfile
from . import query

PROFILE = SiteProfile("e.org", frozenset({"e.org", "www.e.org"}), base_path="/blog/", extra_hosts=frozenset({"cdn.e.org"}))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    parts = x.split("\n")
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")"


def case(columns: str, *rows: tuple):
    """Registers a query whose rows must be those given; ``columns`` names them with their types."""
    names = [c.split() for c in columns.split(", ")]
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in names)

    def add(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark).select(*[F.col(n).cast(k).alias(n) for n, k in names])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(f"SELECT {cast} FROM (VALUES {body}) AS t({', '.join(n for n, _ in names)})")(run)

    return add


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


_PAGE = """<html><head><title> A
 page </title><link rel="shortcut icon" href="/i.ico"><link rel=canonical href="/blog/a/"><link rel=pingback href=/x>
<meta property="og:image" content="/o.png"><meta property="og:url" content="/blog/a"><style>@import "b.css"; p { background: url('c.png') }</style></head>
<body><a href="#top">up</a><a href=" /blog/b/ ">to <b>b</b></a><a href="mailto:x@e.org">m</a><form action="/go"><blockquote cite="/said">q</blockquote>
<img src=d.jpg srcset="d1.jpg 1x, d2.jpg 2x" data-lazy-srcset="l1.jpg 2x" data-full="/wp-content/uploads/f.jpg" style="background:url(e.png)">
<script>var u = "https:\\/\\/x.net\\/p.png", g = '/wp-content/*/'</script><script type="application/ld+json">{"a": ["/j.pdf", "/folder/", "no"]}</script>
<link rel=stylesheet href="/_static/??/wp-content/a.css,/wp-content/b.css"><iframe src="https://v.tv/1"></iframe></body></html>"""


@case(
    "kind string, context string, url string",
    ("render", "link[rel=icon|shortcut]", "https://e.org/i.ico"), ("hyperlink", "link[rel=canonical]", "https://e.org/blog/a/"),
    ("render", "meta[og:image]", "https://e.org/o.png"), ("hyperlink", "meta[og:url]", "https://e.org/blog/a"),
    ("render", "style:css:url()", "https://e.org/blog/c.png"), ("render", "style:css:@import", "https://e.org/blog/b.css"),
    ("hyperlink", "a[href]", "https://e.org/blog/b/"), ("hyperlink", "form[action]", "https://e.org/go"), ("hyperlink", "blockquote[cite]", "https://e.org/said"),
    ("render", "img[src]", "https://e.org/blog/d.jpg"), ("render", "img[srcset]", "https://e.org/blog/d1.jpg"), ("render", "img[srcset]", "https://e.org/blog/d2.jpg"),
    ("render", "img[style]", "https://e.org/blog/e.png"), ("render", "img[data-lazy-srcset]", "https://e.org/blog/l1.jpg"), ("render", "img[data-full]", "https://e.org/wp-content/uploads/f.jpg"),
    ("render", "script:regex", "https://x.net/p.png"), ("render", "script:regex", "https://x.net/p.png"),
    ("render", "script:json", "https://e.org/j.pdf"),
    ("render", "link[rel=stylesheet]->static-bundle", "https://e.org/wp-content/a.css"), ("render", "link[rel=stylesheet]->static-bundle", "https://e.org/wp-content/b.css"),
    ("render", "iframe[src]", "https://v.tv/1"),
)
def reference_kinds(spark):
    """Every place where a document refers to something."""
    return html.extract_references(_rows(spark, "page_id long, url string, html string", (1, "https://e.org/blog/", _PAGE)))


@case("n int, url string", (1, "https://e.org/blog/b/"), (2, None), (3, None), (4, "https://x.net/i.png"), (5, None), (6, "https://e.org/wp-content/s.js"), (7, None), (8, "https://www.x.net/other?q=1"))
def admitted_links(spark):
    d = _rows(spark, "n int, url string, kind string, context string",
              (1, "http://www.e.org/blog/b", "hyperlink", "a[href]"), (2, "https://e.org/shop/", "hyperlink", "a[href]"), (3, "https://x.net/", "hyperlink", "a[href]"), (4, "https://x.net/i.png", "render", "img[src]"),
              (5, "https://x.net/t.js", "render", "script:regex"), (6, "https://e.org/wp-content/s.js", "render", "script:json"), (7, "https://v.tv/1", "render", "iframe[src]"), (8, "https://www.x.net/other?q=1", "render", "img[src]"))
    return d.select("n", urls.admitted(F.col("url"), F.col("kind"), F.col("context"), PROFILE).alias("url"))


@case("n int, parsed boolean", (1, True), (2, False), (3, True), (4, False), (5, False))
def parsed_for_links(spark):
    d = _rows(spark, "n int, kind string, url string", (1, "html", "https://e.org/blog/x"), (2, "html", "https://e.org/shop/"), (3, "css", "https://www.e.org/wp-content/a.css"), (4, "css", "https://x.net/a.css"), (5, None, "https://e.org/blog/x"))
    return d.select("n", urls.parsed_for_links(F.col("kind"), F.col("url"), PROFILE).alias("parsed"))


@case(
    "url string, real boolean, target boolean",
    ("https://e.org/about", True, True), ("https://e.org/about/", False, True), ("https://e.org/wp-content/themes/x/images", False, False), ("https://e.org/wp-admin/x.php", False, False), ("http://[bad", False, False), ("https://e.org/wp-content/a.css", True, True),
)
def unlikely_urls(spark):
    d = _rows(spark, "url string", *[(x,) for x in ("https://e.org/about", "https://e.org/about/", "https://e.org/wp-content/themes/x/images", "https://e.org/wp-admin/x.php", "http://[bad", "https://e.org/wp-content/a.css")])
    return d.select("url", (~urls.unlikely_real(F.col("url"))).alias("real"), (~urls.unlikely_rewrite_target(F.col("url"))).alias("target"))


_FOUND = [("sitemap", "http://www.e.org/blog/a"), ("rest_api", "https://e.org/blog/a/"), ("sitemap", "https://e.org/other/"), ("sitemap", "https://e.org/blog/tag/x/"), ("xml_backup", "https://e.org/blog/b/?utm=1"), ("sitemap", "https://cdn.e.org/z.png"), ("rest_api", "http://[bad")]


def _seeded(spark):
    return site.seeded(_rows(spark, "source string, url string", *_FOUND), PROFILE, ["/tag/"])


@case("source string, kept long, rejected long", ("sitemap", 2, 2), ("rest_api", 1, 1), ("xml_backup", 1, 0))
def seed_counts(spark):
    return site.seed_counts(_seeded(spark))


@case("url string, sources string", ("https://e.org/blog/a/", "rest_api,sitemap"), ("https://e.org/blog/b/", "xml_backup"), ("https://cdn.e.org/z.png", "sitemap"))
def seeded_inventory(spark):
    return site.inventory(_seeded(spark)).select("url", F.array_join("discovered_via", ",").alias("sources"))


@case("sources string, n long", ("rest_api+sitemap", 1), ("sitemap", 1), ("xml_backup", 1))
def source_overlap(spark):
    return site.source_overlap(site.inventory(_seeded(spark)))


@case("url string, alias string", ("https://e.org/blog/a/", "https://e.org/blog/?p=7"))
def shortlink_aliases(spark):
    items = _rows(spark, "collection string, id long, link string", ("posts", 7, "http://e.org/blog/a"), ("posts", 8, "http://e.org/blog/unknown"), ("users", 9, "http://e.org/blog/a"), ("pages", None, "http://e.org/blog/a"), ("media", 5, ""))
    return site.shortlink_aliases(items, _rows(spark, "url string", ("https://e.org/blog/a/",)), "https://e.org/blog/", PROFILE)


_CAPTURES = "url string, status string, output_path string, aliases array<string>, redirect_from array<string>, discovered_via array<string>"


def _captures(spark):
    return _rows(spark, _CAPTURES,
                 ("https://e.org/blog/a/", "fetched", "/blog/a.html", ["https://e.org/blog/?p=7", "http://www.e.org/blog/a/"], ["https://e.org/blog/old name/"], ["sitemap", "crawl:https://e.org/blog/"]),
                 ("https://e.org/blog/", "fetched_wayback", "/index.html", ["https://www.e.org/blog"], [], ["base_url"]),
                 ("https://e.org/blog/b.jpg", "missing", None, [], [], ["crawl:https://e.org/blog/a/", "crawl:https://e.org/blog/gone/", "xml_backup"]),
                 ("https://e.org/blog/gone/", "missing", None, None, None, ["wayback:x"]))


@case("request string, target string", ("/blog/?p=7", "/blog/a.html"), ("/blog/old%20name/", "/blog/a.html"), ("/blog", "/index.html"))
def redirect_map(spark):
    return site.redirect_map(_captures(spark))


@case(
    "pos long, line string", (0, "RewriteEngine On"), (1, "RewriteRule ^blog/?$ /index.html [L]"), (2, "RewriteCond %{REQUEST_FILENAME} !-f"), (3, "RewriteRule ^(.*)/$ /$1.html [L]"),
    (4, "Redirect 301 /blog/?p=7 /blog/a.html"), (4, "Redirect 301 /blog/old%20name/ /blog/a.html"), (4, "Redirect 301 /blog /index.html"),
)
def redirect_lines(spark):
    return site.redirect_lines(site.redirect_map(_captures(spark)), "/blog/")


@case("url string, status string, folded long", ("https://e.org/blog/", "fetched_wayback", 1))
def homepage_record(spark):
    return site.homepage(_captures(spark), "HTTPS://www.e.org/blog/")


@case("sitemap boolean, rest_api boolean, xml_backup boolean, crawl boolean, wayback boolean", (True, False, True, True, True))
def provenance_presence(spark):
    return site.provenance_presence(_captures(spark))


@case("url string", ("https://e.org/blog/b.jpg",))
def unresolved_exports(spark):
    return site.unresolved_exports(_captures(spark))


@case("url string, media boolean", ("https://e.org/blog/b.jpg", True), ("https://e.org/blog/gone/", False))
def missing_files(spark):
    return site.missing_files(_captures(spark))


@case("url string, page string", ("https://e.org/blog/b.jpg", "/blog/a.html"), ("https://e.org/blog/b.jpg", "https://e.org/blog/gone/"))
def pages_of_missing(spark):
    return site.pages_of_missing(_captures(spark))


@case("url string, n long", ("b", 2), ("c", 0), ("x", 1))
def partition_faults(spark):
    one = lambda *x: _rows(spark, "url string", *[(y,) for y in x])
    return site.partition_faults(one("a", "b", "c"), [one("a", "b"), one("b", "x")])


_ANCHORS = [("p1", 0, "https://x.net/a#f", "An a"), ("p2", 0, "https://x.net/a", "other"), ("p2", 1, "//x.net/a", "third"), ("p3", 0, "https://x.net/a", "fourth"), ("p1", 1, "https://e.org/blog/c", "own"), ("p1", 2, "https://e.org/shop/", "sibling"), ("p1", 3, "../up", "rel"), ("p1", 4, "mailto:a@b", "m"), ("p1", 5, "http://[bad", "bad"), ("p1", 6, "https://x.net/b", "")]


@case("url string, n_pages long, texts string", ("https://x.net/a", 3, "An a|other|third"), ("https://e.org/shop/", 1, "sibling"), ("https://x.net/b", 1, ""))
def external_links(spark):
    return site.external_links(_rows(spark, "page string, pos int, href string, text string", *_ANCHORS), PROFILE).withColumn("texts", F.array_join("texts", "|"))


def _results(spark):
    links = _rows(spark, "url string", *[(x,) for x in "abcdef"])
    got = _rows(spark, "url string, status int, error string, flag string", ("a", 200, None, None), ("b", 404, None, None), ("c", 403, None, "auth_gated"), ("d", None, "('Connection aborted.', x)\nmore", None), ("e", 503, None, "retry_exhausted"))
    return site.link_results(links, got)


@case("url string, ok boolean, kind string, reason string", ("a", True, None, None), ("b", False, "http", "HTTP 404"), ("c", False, "auth", "HTTP 403 (auth-gated -- may not actually be broken)"), ("d", False, "refused", "unreachable (('Connection aborted.', x))"), ("e", False, "http", "HTTP 503 (retries exhausted)"), ("f", False, "http", "HTTP None"))
def link_results(spark):
    return _results(spark)


@case("page string, url string, kind string", ("p1", "b", "http"), ("p2", "b", "http"), ("p2", "c", "auth"))
def broken_by_page(spark):
    return site.broken_by_page(_results(spark), _rows(spark, "url string, page string", ("a", "p1"), ("b", "p1"), ("b", "p2"), ("c", "p2")))


@case("n int, rule string, severity string", (1, "nothing_discovered", "concern"), (1, "no_inventory_source", "concern"), (2, "single_live_source", "notice"), (3, "source_contributed_nothing", "concern"), (4, "source_underweight", "notice"), (4, "low_value_archives", "notice"), (5, "nothing_discovered", "concern"), (5, "source_contributed_nothing", "concern"))
def dry_run_rules(spark):
    def run(n, reachable, configured, *groups):
        rows = [(u.format(i), list(via)) for u, k, via in groups for i in range(k)]
        d = _rows(spark, "url string, discovered_via array<string>", *rows)
        return reports.dry_run_findings(d, dict(zip(("sitemap", "rest_api", "xml_backup"), reachable)), configured).select(F.lit(n).alias("n"), "rule", "severity")

    base = ("https://e.org/", 1, ["base_url"])
    out = run(1, (False, False, False), False, base)
    out = out.union(run(2, (True, False, False), False, base, ("/s{}", 30, ["sitemap"]))).union(run(3, (True, True, False), True, base, ("/s{}", 30, ["sitemap"])))
    out = out.union(run(4, (True, True, False), False, ("/s{}", 80, ["sitemap"]), ("/tag/{}", 20, ["sitemap"]), ("/r{}", 9, ["rest_api"])))
    return out.union(run(5, (True, False, False), False, base)).union(run(6, (True, True, False), False, ("/s{}", 30, ["sitemap"]), ("/r{}", 20, ["rest_api"])))


@case("n int, verdict string, n_findings long", (1, "attention", 2), (2, "review", 1), (3, "ready", 0))
def dry_run_verdicts(spark):
    f = lambda *x: _rows(spark, "severity string", *[(y,) for y in x])
    got = [reports.dry_run_verdict(x).select(F.lit(i).alias("n"), "verdict", "n_findings") for i, x in enumerate((f("concern", "notice"), f("notice"), f("notice").limit(0)), 1)]
    return got[0].union(got[1]).union(got[2])


@case("n int, path string", (1, "/assets/css/external/css.css"), (2, "/assets/fonts/f.woff2"), (3, "/assets/external/x.net/page"), (4, "/assets/img/external/i-01234567.bmp"), (5, "/assets/external/x.net/index"), (6, "/assets/js/external/a.mjs"), (7, "/assets/external/x.net/a.avif"))
def external_paths(spark):
    d = _rows(spark, "n int, url string, type string, again boolean", (1, "https://x.net/css?family=a", "text/css; charset=utf-8", False), (2, "https://x.net/f", "font/woff2", False), (3, "https://x.net/page", "text/html", False), (4, "https://x.net/i.bmp", None, True), (5, "https://x.net/", None, False), (6, "https://x.net/a.mjs", "text/plain", False), (7, "https://x.net/a.avif", "image/avif", False))
    return d.select("n", urls.external_output_path(F.col("url"), F.lit("0123456789"), F.col("again"), F.col("type")).alias("path"))


@case("output_path string, n long", ("/a.html", 2))
def path_conflicts(spark):
    return site.path_conflicts(_rows(spark, "url string, output_path string", ("/a", "/a.html"), ("/a/", "/a.html"), ("/b", "/b.html"), ("/b", "/b.html")))


@case("message string, kind string", ("HTTPSConnectionPool: NameResolutionError(x)", "dns"), ("SSLError(CERTIFICATE_VERIFY_FAILED)", "tls"), ("read timed out", "timeout"), ("RemoteDisconnected('closed')", "refused"), ("ConnectionResetError(104)", "refused"), ("TooManyRedirects", "redirect_loop"), ("the ssl word alone", "unreachable"))
def error_names(spark):
    d = _rows(spark, "message string", *[(x,) for x in ("HTTPSConnectionPool: NameResolutionError(x)", "SSLError(CERTIFICATE_VERIFY_FAILED)", "read timed out", "RemoteDisconnected('closed')", "ConnectionResetError(104)", "TooManyRedirects", "the ssl word alone")])
    return d.select("message", outcomes.error_kind(F.col("message")).alias("kind"))


@case("url string, tracker boolean", ("https://www.google-analytics.com/x.js", True), ("https://e.org/wp-content/plugins/google-analytics-for-wordpress/a.js", True), ("https://e.org/js/gtag/js?id=1", True), ("https://stats.wp.com/e.js", False), ("https://e.org/app.js", False), ("/ga.js", True))
def telemetry_references(spark):
    d = _rows(spark, "url string", *[(x,) for x in ("https://www.google-analytics.com/x.js", "https://e.org/wp-content/plugins/google-analytics-for-wordpress/a.js", "https://e.org/js/gtag/js?id=1", "https://stats.wp.com/e.js", "https://e.org/app.js", "/ga.js")])
    return d.select("url", rewrite.telemetry_reference(F.col("url"), ("stats.wp.com",)).alias("tracker"))


@case("n int, html string", (1, "<p>a</p>"), (2, "<p></p><script>app()</script>"), (3, "<img src=\"/i.png\">"), (4, "see <b>here</b>"), (5, "in"), (6, "<link rel=\"stylesheet\" href=\"/a.css\">"), (7, "x"))
def policy_cases(spark):
    d = _rows(spark, "n int, html string",
              (1, "<p>a</p><script src=\"https://www.googletagmanager.com/gtag/js?id=1\"></script>"), (2, "<p></p><script>window.x=1;fbq('init', 1)</script><script>app()</script>"), (3, "<img src=\"/i.png\"><img src=\"https://pixel.wp.com/g.gif\">"),
              (4, "see <a href=\"#respond\"><b>here</b></a>"), (5, "<a href=\"/wp-login.php?x=1\">in</a>"), (6, "<link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed/\"><link rel=\"stylesheet\" href=\"/a.css\">"), (7, "x<form action=\"/c\"><input></form>"))
    return d.select("n", rewrite.apply_policy(F.col("html")).alias("html"))


@case("n int, html string", (1, "<p>t</p>"), (2, "<img src=\"a\">"), (3, "ab"), (4, "<img src=\"a\" height=\"5\">"), (5, "<script async=\"\" src=\"x\"></script>"))
def repair_cases(spark):
    d = _rows(spark, "n int, html string", (1, "<p><o:p>t</o:p></p>"), (2, "<img border=\"0\" src=\"a\">"), (3, "a\x01\x0bb"), (4, "<img src=\"a\" width=\"auto\" height=\"5\">"), (5, "<script async=\"async\" src=\"x\"></script>"))
    return d.select("n", rewrite.repair(F.col("html")).alias("html"))


@case("n int, category string", (1, "comment"), (2, "password"), (3, "search"), (4, "newsletter"), (5, "other"))
def form_categories(spark):
    d = _rows(spark, "n int, html string", (1, "<form id=\"commentform\">"), (2, "<form class=\"post-password-form\">"), (3, "<form role=\"search\">"), (4, "<form class=\"mc4wp-form\">"), (5, "<form>"))
    return d.select("n", reports.form_category(F.col("html")).alias("category"))


@case("page string, plugins string", ("a", "contact_form_7,elementor"), ("b", "gravity_forms"), ("c", ""), ("d", "jetpack_slideshow"))
def plugin_groups(spark):
    d = _rows(spark, "page string, html string", ("a", "<div class=\"wpcf7 elementor-widget\">"), ("b", "<form id=\"gform_12\">"), ("c", "<div class=\"ad wp-block-x\">"), ("d", "jetpack-slideshow"))
    return d.select("page", F.array_join(html.plugins(F.col("html")), ",").alias("plugins"))


@case("url string", ("https://e.org/s1.xml",), ("https://e.org/s2.xml",))
def robots_sitemaps(spark):
    return _rows(spark, "text string", ("User-agent: *\nSitemap: https://e.org/s1.xml\n  sitemap:https://e.org/s2.xml  \n#Sitemap: no",)).select(F.explode(sources.robots_sitemaps(F.col("text"))).alias("url"))


@case("url string", ("https://e.org/a",), ("https://e.org/b",))
def sitemap_walk(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = _rows(spark, "loc string, xml string", ("i", f"<sitemapindex {ns}><sitemap><loc> s </loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>none</loc></sitemap></sitemapindex>"), ("s", f"<urlset {ns}><url><loc>https://e.org/a</loc></url><url><loc> https://e.org/b </loc></url></urlset>"), ("t", f"<urlset {ns}><url><loc>https://e.org/c</loc></url></urlset>"))
    return sources.walk_sitemaps(docs, _rows(spark, "loc string", ("i",)))


@case("url string", ("https://e.org/1",), ("https://e.org/2",))
def rest_item_links(spark):
    return _rows(spark, "items string", ('[{"id": 1, "link": "https://e.org/1"}, {"id": 2, "link": ""}, {"id": 3}, {"link": "https://e.org/2", "x": {}}]',)).select(F.explode(sources.rest_links(F.col("items"))).alias("url"))


@case("n int, timestamp string, status string, original string", (1, "20200101000000", "200", "http://e.org/"))
def snapshot_rows(spark):
    d = _rows(spark, "n int, cdx string", (1, '[["urlkey","timestamp","original","mimetype","statuscode"],["k","20200101000000","http://e.org/","text/html","200"]]'), (2, '[["a","b"],["1","2"]]'), (3, "[]"))
    return d.select("n", F.inline(sources.snapshots(F.col("cdx"))))


@case("n int, url string, taken string", (1, "https://web.archive.org/web/20200102030405id_/http://e.org/a", "2020-01-02 03:04:05"))
def snapshot_urls(spark):
    u = urls.snapshot_url(F.lit("20200102030405"), F.lit("http://e.org/a"))
    return _rows(spark, "n int", (1,)).select("n", u.alias("url"), urls.snapshot_time(u).cast("string").alias("taken"))


@case("request string", ("https://web.archive.org/cdx/search/cdx?url=http%3A%2F%2Fe.org%2Fa+b%3Fx%3D1&output=json",))
def snapshot_requests(spark):
    return _rows(spark, "u string", ("http://e.org/a b?x=1",)).select(urls.snapshot_query(F.col("u")).alias("request"))


@case("level string, message string", ("WARNING", "loam.fetch: slow"), ("ERROR", "x y"))
def log_rows(spark):
    return sources.log_lines(_rows(spark, "value string", ("2024-01-01 10:00:00 INFO a: b",), ("2024-01-01 10:00:00 WARNING loam.fetch: slow",), ("d t ERROR x y",), ("Traceback",)))


_WXR = """<rss xmlns:wp="w" xmlns:dc="d"><channel><wp:author><wp:author_login>al</wp:author_login><wp:author_id>9</wp:author_id></wp:author><wp:author><wp:author_login>al</wp:author_login><wp:author_id>3</wp:author_id></wp:author>
<wp:category><wp:category_nicename>news</wp:category_nicename><wp:term_id>5</wp:term_id></wp:category>
<item><link>https://e.org/p/</link><dc:creator>al</dc:creator><wp:post_type>post</wp:post_type><wp:status>publish</wp:status><category domain="category" nicename="news"/><category domain="category" nicename="lost"/></item>
<item><link>https://e.org/draft/</link><dc:creator>bo</dc:creator><wp:post_type>post</wp:post_type><wp:status>draft</wp:status></item>
<item><link>https://e.org/file/</link><dc:creator>bo</dc:creator><wp:post_type>attachment</wp:post_type><wp:status>inherit</wp:status></item></channel></rss>"""


@case("url string", ("https://e.org/p/",), ("https://e.org/file/",), ("https://e.org/?cat=5",), ("https://e.org/?author=3",))
def export_urls(spark):
    """An export with a definition that comes twice, undefined names and a draft; beside it one that is broken."""
    return sources.wxr_urls(sources.read_wxr(_rows(spark, "text string", (_WXR,), ("<rss><broken",))), "https://e.org/")


@case("n int, url string", (1, "/j.pdf"), (1, "https://e.org/k.png"), (2, "//x.net/l.js"))
def json_references(spark):
    rows = [(n, u) for n, v in ((1, {"a": ["/j.pdf", "/folder/", "no", {"b": "https://e.org/k.png"}], "c": 5}), (2, ["//x.net/l.js"])) for u in html.json_urls(v)]
    return _rows(spark, "n int, url string", *rows)


@case("n int, parts string", (1, "https://e.org/a.css|https://e.org/d/b.css"), (2, None), (3, None))
def bundle_parts(spark):
    import base64
    import zlib

    packed = base64.b64encode(zlib.compress(b"/a.css,/d/b.css")).decode().rstrip("=")
    given = ((1, f"https://e.org/_static/??-{packed}&cssminify=yes"), (2, "https://e.org/_static/??-!!"), (3, "https://e.org/a.css?x"))
    return _rows(spark, "n int, parts string", *[(n, "|".join(x) if (x := html.bundle_components(u)) else None) for n, u in given])


@case("text string, url string", ("a", "x.png"), ("a", "y.css"), ("b", "z.css"))
def css_urls(spark):
    d = _rows(spark, "text string, css string", ("a", "p { background: url( 'x.png' ) } q { src: url(data:abc) } @import url(\"y.css\");"), ("b", "@import 'z.css';"))
    return d.select("text", F.explode(html.css_references(F.col("css"))).alias("url"))


@case("host string, seq long, allowed_at double, cooldown double, strikes long", ("a", 1, 0.0, 60.0, 1), ("a", 2, 60.0, 120.0, 2), ("a", 3, 181.0, 10.0, 3), ("a", 4, 191.0, 0.0, 0), ("a", 5, 192.0, 60.0, 1), ("b", 1, 5.0, 1800.0, 1))
def rate_limit_steps(spark):
    """The keyed state's step on a table: two denials in a row are a lockout; a 429 between them does not count."""
    from ..streaming import limiter

    d = _rows(spark, "host string, seq long, status int, at double, retry_after double", ("a", 2, 429, 1.0, None), ("a", 1, 429, 0.0, None), ("a", 3, 429, 181.0, 10.0), ("a", 4, 403, 182.0, None), ("a", 5, 401, 183.0, None), ("b", 1, 429, 5.0, 86400.0))
    return d.groupBy("host").applyInPandas(limiter(threshold=2), "host string, seq long, status int, allowed_at double, cooldown double, strikes int")


@case("shingle string, df long", ("a b c d e", 2),)
def sitewide_shingles(spark):
    d = _rows(spark, "k int, t string", (1, "a b c d e " + " ".join(f"u{i}" for i in range(25))), (2, " ".join(f"v{i}" for i in range(25)) + " a b c d e"), (3, " ".join(f"w{i}" for i in range(30))), (4, "a b c d e"))
    return content.sitewide(content.shingle_table(d, "k", "t", strict=True), "k", 4)


@case("url string, outcome string", ("a", "rewritten"), ("https://e.org/blog/lost", "unresolved"), ("https://x.net/", "left_absolute"))
def reference_outcomes(spark):
    d = _rows(spark, "url string, target string", ("a", "/a.html"), ("https://e.org/blog/lost", None), ("https://x.net/", None))
    return resolve.classify_references(d, urls.in_scope(F.col("url"), PROFILE))


@case("flag string, n long", ("auth_gated", 2), ("orphan", 1))
def flag_histogram(spark):
    return reports.flag_histogram(_rows(spark, "flags array<string>", (["auth_gated", "orphan"],), (["auth_gated"],), ([],), (None,)))


@case("n int, gap boolean", (1, True), (2, True), (3, False), (4, False))
def capture_gaps(spark):
    d = _rows(spark, "n int, status string, flags array<string>", (1, "missing", []), (2, "fetched", ["auth_gated"]), (3, "fetched", ["orphan"]), (4, "pending", None))
    return d.select("n", captures.is_gap(F.col("status"), F.col("flags")).alias("gap"))


@case("n int, kind string", (1, "html"), (2, "css"), (3, None), (4, "html"))
def content_kinds(spark):
    d = _rows(spark, "n int, type string, url string", (1, "Text/HTML; charset=x", "u"), (2, None, "https://e.org/a.css"), (3, "image/png", "https://e.org/a.png"), (4, None, "https://e.org/a.htm"))
    return d.select("n", urls.content_kind(F.col("type"), F.col("url")).alias("kind"))


@case("page string, problem string", ("a", "shared_path"), ("b", "shared_path"))
def shared_paths(spark):
    c = _rows(spark, "url string, local_path string, content_hash string, content_type string", ("a", "x", None, None), ("b", "x", None, None), ("c", "y", None, None))
    return checklist.integrity(c, _rows(spark, "path string, content binary", ("x", b"1"), ("y", b"2"))).select(F.col("url").alias("page"), "problem")


@case("url string, target string", ("https://e.org/att/", "/f.jpg"))
def attachment_targets(spark):
    items = _rows(spark, "url string, file string", ("https://e.org/att/", "https://e.org/f.jpg"), ("https://e.org/att2/", "https://e.org/none.jpg"))
    return site.attachment_media(items, _rows(spark, "url string, output_path string", ("https://e.org/f.jpg", "/f.jpg")))


@case("outcome string, n long, n_pages long", ("rewritten", 2, 1), ("unresolved", 1, 1))
def rewrite_totals(spark):
    return site.rewrite_totals(_rows(spark, "page string, outcome string", ("a", "rewritten"), ("a", "rewritten"), ("b", "unresolved")))


@case("n int, value string", (1, "-2x"), (1, "a.jpg 1x, b.jpg 2x"))
def srcset_rewrites(spark):
    got = rewrite.rewrite_srcset("/a.jpg 1x, /b.jpg 2x", {"/a.jpg": "a.jpg", "/b.jpg": "b.jpg"}.get)
    return _rows(spark, "n int, value string", (1, got), (1, "-2x"))
