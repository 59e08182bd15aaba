import json
import zlib
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from loamgrid import sources
from loamgrid.functions import html
from loamgrid.operators import captures, content, outcomes, reports, resolve


def rows(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys).collect()) if keys else sorted(map(tuple, df.collect()))


def test_aliases_chains_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("in", "x"), ("self", "self")], "from_url string, to_url string")
    got = {r["from_url"]: r["target"] for r in captures.resolve_aliases(e).collect()}
    assert got == {"a": "c", "b": "c", "x": "x", "y": "y", "in": "x", "self": "self"}
    assert captures.resolve_aliases(e.limit(0)).count() == 0


def test_reachable(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 10)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(captures.reachable(start, e)) == [(1, 0), (2, 1), (3, 2)]


def test_duplicates_prefer_originals(spark):
    d = spark.createDataFrame([("a-300x200.jpg", "h", "1"), ("b.jpg", "h", "2"), ("c.jpg", "i", "1")], "url string, content_hash string, first_seen string")
    assert {r["canonical"] for r in captures.duplicate_groups(d).collect()} == {"b.jpg"}


def test_orphans(spark):
    d = spark.createDataFrame([(["sitemap"],), (["crawl:x"],), (["sitemap", "crawl:x"],), (["base_url"],)], "via array<string>")
    assert [r[0] for r in d.select(captures.orphan_or_unlisted(F.col("via"))).collect()] == ["orphan", "unlisted", None, None]


def test_upsert(spark):
    a = spark.createDataFrame([("u", ["x"], "pending", None, "1")], "url string, aliases array<string>, status string, last_fetched string, first_seen string")
    b = spark.createDataFrame([("u", ["y"], "fetched", "5", "3"), ("v", [], "pending", None, "4")], a.schema)
    got = {r["url"]: r for r in captures.upsert(a, b).collect()}
    assert got["u"]["aliases"] == ["x", "y"] and got["u"]["status"] == "fetched" and got["u"]["first_seen"] == "1" and "v" in got


def test_prefix_collisions(spark):
    p = spark.createDataFrame([("a",), ("a/b",), ("ab",)], "path string")
    assert rows(captures.prefix_collisions(p, "path")) == [("a",)]


def test_tiers(spark):
    c = spark.createDataFrame([("https://e.com/a", "/a.html", True), ("https://e.com/s.css", "/s.css", True)], "url string, output_path string, owned boolean")
    r = spark.createDataFrame([(1, "http://www.e.com/a/", True), (2, "https://e.com/s.css?ver=3", True), (3, "https://e.com/none", True)], "id int, ref string, owned boolean")
    got = {x["id"]: x["target"] for x in resolve.resolve_references(r, resolve.build_lookup(c), ["id"]).collect()}
    assert got == {1: "/a.html", 2: "/s.css", 3: None}


def test_verify(spark):
    refs = spark.createDataFrame([("/d/p.html", "x.css?v=1"), ("/d/p.html", "../y.css"), ("/p.html", "../../z"), ("/p.html", "https://o.org/")], "page string, ref string")
    files = spark.createDataFrame([("/d/x.css",)], "path string")
    assert rows(resolve.verify(refs, files, "page", "ref")) == [("/d/p.html", "../y.css", "missing"), ("/p.html", "../../z", "escapes the site root")]


def test_lockouts_ignore_429(spark):
    s = [403, 403, 429, 403, 200, 401, 401, 403, 403, 403, 403]
    d = spark.createDataFrame([("h", i, x) for i, x in enumerate(s)], "host string, seq int, status int")
    assert rows(outcomes.lockout_streaks(d, "host", "seq", "status", threshold=3)) == [("h", 3, 1), ("h", 7, 1), ("h", 10, 2)]


def test_nearest_takes_the_earlier_of_equals(spark):
    w = spark.createDataFrame([("k", 10), ("k", 100), ("l", 5)], "key string, t long")
    s = spark.createDataFrame([("k", 8), ("k", 12), ("k", 90)], "key string, s long")
    assert sorted((r["key"], r["t"], r["s"], r["distance"]) for r in outcomes.nearest(w, s, "key", "t", "s").collect()) == [("k", 10, 8, 2), ("k", 100, 90, 10), ("l", 5, None, None)]


def test_outcomes(spark):
    d = spark.createDataFrame([(200, None), (404, None), (429, None), (503, None), (403, None), (302, None), (None, "timed out")], "status int, error string")
    assert [r[0] for r in d.select(outcomes.outcome(F.col("status"), F.col("error"))).collect()] == ["success", "candidate", "retry_exhausted", "retry_exhausted", "auth_gated", "odd_response", "retry_exhausted"]
    assert spark.range(1).select(outcomes.error_kind(F.lit("getaddrinfo failed"))).first()[0] == "dns"


def test_echo_and_thin(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, shared), (2, shared + " tail"), (3, " ".join(f"u{i}" for i in range(40))), (4, "short"), (5, None)], "doc_id long, text string")
    assert rows(content.echoed(d, "doc_id", "text"), "doc_id") == [(1,), (2,)]
    assert rows(content.echoed(d, "doc_id", "text", strict=True), "doc_id") == [(1,), (2,)]
    assert rows(content.thin(d, "doc_id", "text")) == [(4, 1), (5, 0)]
    run = content.longest_echoed_run(d, "doc_id", "text").where("doc_id = 2").first()
    assert (run["start"], run["run_words"]) == (0, 40)
    assert content.echo_source_counts(d, "doc_id", "text").where("doc_id = 1").first()["source"] == 2


def test_echo_of_many_copies(spark):
    """Copies and ties: the same sources as by comparing all documents."""
    import random

    rng = random.Random(2)
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    docs = [(i, base[rng.randrange(3)] if rng.random() < 0.5 else " ".join(rng.sample(base, 2)) + f" tail{rng.randrange(4)}") for i in range(60)]
    runs = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in docs for w in [t.split()]}
    want = []
    for i, s in runs.items():
        n = sum(any(x in runs[j] for j in runs if j != i) for x in s)
        if n >= 0.5 * len(s):
            found = sorted((-len(s & runs[j]), j) for j in runs if j != i and s & runs[j])[:3]
            want += [(i, j, -m, r) for r, (m, j) in enumerate(found, 1)]
    got = content.echo_source_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text")
    assert rows(got, "doc_id", "source", "shared", "rank") == sorted(want)


def shuffled(spark, find):
    """Rows of ``find`` and the records that its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return find(), total() - before


def test_echo_of_a_crowded_line(spark):
    """A line of many documents, whose rests differ, makes no pairs of them."""
    line = " ".join(f"w{i}" for i in range(60))
    docs = [(i, line + " " + " ".join(f"u{i}x{j}" for j in range(20))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got, n = shuffled(spark, lambda: rows(content.echo_source_counts(d, "doc_id", "text"), "doc_id", "source", "shared", "rank"))
    assert got == sorted((i, j, 56, r) for i in range(400) for r, j in enumerate([x for x in range(4) if x != i][:3], 1))
    assert n < 100_000


@pytest.mark.parametrize("crowd", [1, 2, 4, 9])
def test_echo_by_levels(spark, monkeypatch, crowd):
    """Documents of crowded and rare lines in all mixtures: the same sources as by comparing all documents."""
    import random

    monkeypatch.setattr(content, "CROWD", crowd)
    rng = random.Random(crowd)
    lines = [" ".join(f"{c}{i}" for i in range(10 + n)) for n, c in enumerate("abcdefghij")]
    docs = [(i, " ".join([x for n, x in enumerate(lines) if rng.random() < 1 / (1 + n / 2)] + [f"r{rng.randrange(25)}q{j}" for j in range(rng.randrange(12))])) for i in range(80)]
    runs = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in docs for w in [t.split()] if len(w) >= 25}
    want = []
    for i, s in runs.items():
        if sum(any(x in runs[j] for j in runs if j != i) for x in s) >= 0.5 * len(s):
            found = sorted((-len(s & runs[j]), j) for j in runs if j != i and s & runs[j])[:3]
            want += [(i, j, -m, r) for r, (m, j) in enumerate(found, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(content.echo_source_counts(d, "doc_id", "text"), "doc_id", "source", "shared", "rank") == sorted(want)


def test_echo_of_repeated_keys(spark):
    """Rows of one key are one document; its repeated shingles count once."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    d = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (None, a + " " + a)], "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:3]) for r in content.echo_fractions(d, "doc_id", "text").collect()}
    assert got == {1: (52, 52), 2: (26, 26), None: (30, 26)}


@pytest.mark.parametrize("find", [content.echo_fractions, content.longest_echoed_run])
def test_echo_shuffles_shingles_once(spark, find):
    docs = [(i, " ".join(f"w{i // 2}x{j}" for j in range(500))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    _, n = shuffled(spark, lambda: find(d, "doc_id", "text").collect())
    # all shingles, then what their documents or runs need
    assert n < 2.2 * 40 * 496


def test_integrity_of_pages_with_one_url(spark, tmp_path):
    from loamgrid.plans import QUERIES

    pages = [(1, "http://a/x"), (2, "http://a/d/"), (5, "http://a/x"), (6, "http://a/d/"), (7, None), (10, None)]
    spark.createDataFrame([(*p, "<p>") for p in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = rows(QUERIES["integrity_findings"](spark, str(tmp_path)), "page_id", "problem")
    assert got == [(1, "hash_mismatch"), (2, "shape_mismatch"), (5, "file_missing"), (6, "hash_mismatch"), (6, "shape_mismatch"), (10, "file_missing")]


def test_report_files(spark, tmp_path):
    from loamgrid.operators import sinks

    d = spark.createDataFrame([("a|b", 2), (None, 1)], "url string, n long")
    sinks.write_report({"links": d, "none": d.limit(0)}, str(tmp_path))
    assert rows(sinks.read_report(spark, str(tmp_path), "links", "url string, n long"), "n", "url") == rows(d, "n", "url")
    assert sinks.read_report(spark, str(tmp_path), "none", "url string").count() == 0
    sinks.write_lines(sinks.as_lines(d, "Links", "url", "n"), str(tmp_path / "md"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["# Links", "", "| url | n |", "| --- | --- |", "|  | 1 |", "| a\\|b | 2 |"]


def test_references():
    page = '<a href="/a">x <b>y</b></a><img src="i.png" srcset="j.png 1x, k.png 2x"><style>p{background:url(b.png)}</style><script>var u="https:\\/\\/o.org\\/s.js";</script><link rel="canonical" href="/c"><a href="mailto:x">m</a>'
    got = [(r[0], r[3], r[4]) for r in html.references(page, "https://e.com/d/")]
    assert got == [("hyperlink", "https://e.com/a", "x y"), ("render", "https://e.com/d/i.png", ""), ("render", "https://e.com/d/j.png", ""), ("render", "https://e.com/d/k.png", ""), ("render", "https://e.com/d/b.png", ""), ("render", "https://o.org/s.js", ""), ("render", "https://o.org/s.js", ""), ("hyperlink", "https://e.com/c", "")]
    assert html.references(None, None) == []


def test_bundles():
    packed = b64encode(zlib.compress(b"/a.css,/b.css")).decode().rstrip("=")
    assert html.bundle_components("https://s.org/_static/??/a.css,/b.css?m=1") == ["https://s.org/a.css", "https://s.org/b.css?m=1"]
    assert html.bundle_components(f"https://s.org/_static/??-{packed}") == ["https://s.org/a.css", "https://s.org/b.css"]
    assert html.bundle_components("https://s.org/x.css") is None and html.bundle_components("https://s.org/_static/??-!!") is None


def test_sources(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(sources.robots_sitemaps(F.lit("User-agent: *\nSITEMAP: https://e/s.xml\n sitemap:https://e/t.xml "))) == ["https://e/s.xml", "https://e/t.xml"]
    docs = spark.createDataFrame([("i", '<sitemapindex xmlns="u"><sitemap><loc> a </loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>'), ("a", '<urlset xmlns="u"><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>')], "loc string, xml string")
    assert rows(sources.walk_sitemaps(docs, spark.createDataFrame([("i",)], "loc string"))) == [("p1",), ("p2",)]
    cdx = json.dumps([["urlkey", "timestamp", "original", "statuscode"], ["k", "2020", "http://x", "200"]])
    assert [tuple(x) for x in one(sources.snapshots(F.lit(cdx)))] == [("2020", "200", "http://x")]
    assert one(sources.snapshots(F.lit('[["nope"]]'))) == []
    assert one(sources.rest_links(F.lit('[{"id":1,"link":"l"},{"id":2,"link":""},{"id":3}]'))) == ["l"]


def test_wxr(spark):
    x = """<rss xmlns:wp="w" xmlns:dc="d"><channel><wp:author><wp:author_id>7</wp:author_id><wp:author_login>ann</wp:author_login></wp:author>
    <wp:category><wp:term_id>3</wp:term_id><wp:category_nicename>news</wp:category_nicename></wp:category>
    <item><link>https://e/p</link><dc:creator>ann</dc:creator><wp:post_id>1</wp:post_id><wp:post_type>post</wp:post_type><wp:status>publish</wp:status><category domain="category" nicename="news"/></item>
    <item><link>https://e/d</link><dc:creator>bob</dc:creator><wp:post_id>2</wp:post_id><wp:post_type>post</wp:post_type><wp:status>draft</wp:status></item>
    <item><link>https://e/m</link><dc:creator>bob</dc:creator><wp:post_id>4</wp:post_id><wp:post_type>attachment</wp:post_type><wp:status>inherit</wp:status></item></channel></rss>"""
    wxr = sources.read_wxr(spark.createDataFrame([(x + "\x0b",)], "text string"))
    assert rows(sources.wxr_urls(wxr, "https://e/")) == [("https://e/?author=7",), ("https://e/?cat=3",), ("https://e/m",), ("https://e/p",)]


def test_reports(spark):
    d = spark.createDataFrame([(f"https://e/tag/{i}", ["sitemap"]) for i in range(30)], "url string, discovered_via array<string>")
    seen = {"sitemap": True, "rest_api": True, "xml_backup": False}
    assert rows(reports.dry_run_findings(d, seen, False), "rule") == [("low_value_archives",), ("source_contributed_nothing",)]
    assert rows(reports.dry_run_findings(d.limit(0), {"sitemap": True}, False), "rule") == [("nothing_discovered",), ("source_contributed_nothing",)]
    b = spark.createDataFrame([("p1", "x" * 60), ("p2", "x" * 60), ("p3", "y")], "page string, css string")
    assert reports.redundant_blocks(b, "css", "page", least_bytes=60).select("wasted").collect()[0][0] == 60
    assert spark.range(1).select(reports.form_category(F.lit('<form id="commentform" role="search">'))).first()[0] == "comment"
