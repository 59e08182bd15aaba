from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import urls
from loamgrid.profile import SiteProfile

SITE = SiteProfile("example.com", frozenset({"www.example.com", "example.com"}), extra_hosts=frozenset({"cdn.example.com"}))
BARE = SiteProfile("example.com", frozenset({"www.example.com"}), use_https=False, trailing_slash=False)

NORMAL = [
    ("HTTP://WWW.Example.COM/Foo", SITE, "https://example.com/Foo/"),
    ("http://example.com:80/a/", SITE, "https://example.com/a/"),
    ("https://example.com:8443/a/", SITE, "https://example.com:8443/a/"),
    ("http://example.com/a/../b//c/./d.html#x", SITE, "https://example.com/b/c/d.html"),
    ("http://example.com/%7Euser/%2fx", SITE, "https://example.com/~user/%2Fx/"),
    ("http://example.com/a%%341", SITE, "https://example.com/a%41/"),
    ("http://example.com/?utm_source=x&p=12", SITE, "https://example.com/?p=12"),
    ("http://example.com", SITE, "https://example.com/"),
    ("http://example.com/a/..", SITE, "https://example.com/"),
    ("https://cdn.example.com/x.css?ver=1", SITE, "https://cdn.example.com/x.css"),
    ("http://other.org/css?family=Open+Sans:400", SITE, "http://other.org/css?family=Open+Sans%3A400"),
    ("http://example.com/foo/", BARE, "http://example.com/foo"),
    ("http://example.com/", BARE, "http://example.com/"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url,profile,want", NORMAL)
def test_normalize(spark, url, profile, want):
    got = one(spark, urls.normalize_for(F.lit(url), profile))
    assert got == want
    if "%%" not in url:  # one pass of decoding may leave what a second would decode
        assert one(spark, urls.normalize_for(F.lit(got), profile)) == want


def test_unparseable_is_null(spark):
    assert one(spark, urls.normalize_for(F.lit("http://[bad/"), SITE)) is None
    assert one(spark, urls.unlikely_real(F.lit("//]")))


@pytest.mark.parametrize("link", ["b.html", "../x/y", "/z?q=1", "?n=2", "//cdn.org/a.css", "https://a.org/b", "./c/"])
def test_resolve_as_urljoin(spark, link):
    base = "https://example.com/dir/page.html"
    assert one(spark, urls.resolve(F.lit(base), F.lit(link))) == urljoin(base, link)


def test_scope(spark):
    p = SiteProfile("example.com", frozenset(), base_path="/sub/", extra_hosts=frozenset({"cdn.org"}))
    for url, want in [("https://example.com/sub/a", True), ("https://example.com/sub", True), ("https://example.com/other", False), ("https://cdn.org/x", True), ("https://x.org/sub/", False)]:
        assert one(spark, urls.in_scope(F.lit(url), p)) is want


def test_paths(spark):
    assert one(spark, urls.internal_output_path(F.lit("/"))) == "/index.html"
    assert one(spark, urls.internal_output_path(F.lit("/sub/"), "/sub/")) == "/index.html"
    assert one(spark, urls.internal_output_path(F.lit("/category/essays/page/2/"))) == "/category/essays/page-2.html"
    assert one(spark, urls.internal_output_path(F.lit("/a/b.css"))) == "/a/b.css"
    assert one(spark, urls.internal_output_path(F.lit("/foo/bar"))) == "/foo/bar.html"
    assert one(spark, urls.local_path(F.lit("https://example.com/"), F.lit(True))) == "index.html"
    assert one(spark, urls.local_path(F.lit("http://o.org/x/a.css?v=1"), F.lit(False))).startswith("_external/http_o.org/x/a__q-")
    assert one(spark, urls.external_output_path(F.lit("http://o.org/f/x.woff2"), F.lit("abcdefghij"), F.lit(True))) == "/assets/fonts/x-abcdefgh.woff2"
    assert one(spark, urls.relative_link(F.lit("/a/b/c.html"), F.lit("/a/d.html"))) == "../d.html"
    assert one(spark, urls.relative_link(F.lit("/index.html"), F.lit("/a/d.html"))) == "a/d.html"
    assert one(spark, urls.relative_link(F.lit("/a/x.html"), F.lit("/a/y.html"))) == "y.html"


def test_variants(spark):
    got = one(spark, urls.lookup_variants(F.lit("https://example.com/style.css?ver=6"), F.lit(True)))
    assert got[0] == "https://example.com/style.css?ver=6"
    assert "http://www.example.com/style.css" in got
    foreign = one(spark, urls.lookup_variants(F.lit("https://f.org/css?family=x"), F.lit(False)))
    assert all("?family=x" in x for x in foreign)
    author = one(spark, urls.lookup_variants(F.lit("https://example.com/?author=6&v=1"), F.lit(True)))
    assert not any(x in ("https://example.com/", "http://example.com/") for x in author)


def test_small_functions(spark):
    assert one(spark, urls.duration_text(F.lit(3723))) == "1h02m03s"
    assert one(spark, urls.retry_after_seconds(F.lit("120"), F.lit("2024-01-01").cast("timestamp"))) == 120.0
    assert one(spark, urls.retry_after_seconds(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), F.lit("2024-01-01").cast("timestamp"))) == 60.0
    assert one(spark, urls.retry_after_seconds(F.lit("soon"), F.lit("2024-01-01").cast("timestamp"))) is None
    assert one(spark, urls.htaccess_safe(F.lit("a b"))) == "a%20b"
    assert str(one(spark, urls.snapshot_time(F.lit("https://w.org/web/20200102030405id_/http://x")))) == "2020-01-02 03:04:05"
    assert one(spark, urls.bare_asset_directory(F.lit("/wp-content/themes/x")))
    assert one(spark, urls.admin_infrastructure(F.lit("http://a.b/wp-admin/admin-ajax.php")))
