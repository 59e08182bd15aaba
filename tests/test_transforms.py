from pyspark.sql import functions as F

from loamgrid.functions import rewrite
from loamgrid.operators import checklist

MAP = {"/a": "a.html", "https://e.com/x.js": "js/x.js", "i.png": "img/i.png", "b.png": "img/b.png", "/p?q=1&r=2": "p.html"}.get


def test_html_in_place():
    page = """<!-- <a href="/a"> --><A HREF='/a#top' class=x>t</A><img srcset="i.png 1x, b.png 2x" alt="/a"><p style="background:url('b.png')"><style>p{background:url(b.png)}</style><script>var u="https:\\/\\/e.com\\/x.js", v="/a";</script><script type="application/json">{"k": ["/a", "x /a"]}</script><a href="/p?q=1&amp;r=2">"""
    want = """<!-- <a href="/a"> --><A HREF='a.html#top' class=x>t</A><img srcset="img/i.png 1x, img/b.png 2x" alt="/a"><p style="background:url('img/b.png')"><style>p{background:url(img/b.png)}</style><script>var u="js\\/x.js", v="/a";</script><script type="application/json">{"k": ["a.html", "x /a"]}</script><a href="p.html">"""
    assert rewrite.rewrite_html(page, MAP) == want
    assert rewrite.rewrite_html(page, lambda x: None) == page


def test_pages(spark):
    p = spark.createDataFrame([(1, '<a href="/a">'), (2, '<a href="/a">'), (3, None)], "page_id long, html string")
    t = spark.createDataFrame([(1, "/a", "x"), (2, "/a", None)], "page_id long, value string, target string")
    assert sorted((r[0], r[1]) for r in rewrite.rewrite_pages(p, t).collect()) == [(1, '<a href="x">'), (2, '<a href="/a">'), (3, None)]


def test_policy(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    html = '<script src="https://www.google-analytics.com/a.js"></script><script>gtag("x")</script><script>keep()</script><form role="search">s</form><form>o</form><link rel="alternate" type="application/rss+xml" href="/feed"><a href="/wp-login.php">Log in</a><a href="/x#respond">2 replies</a><div id="actionbar"><b>x</b></div>'
    assert one(rewrite.apply_policy(F.lit(html), keep_search=True)) == '<script>keep()</script><form role="search">s</form>Log in2 replies'
    assert one(F.size(rewrite.forms(F.lit(html)))) == 2
    assert one(rewrite.telemetry_reference(F.lit("https://stats.wp.com/e.js"))) and not one(rewrite.telemetry_reference(F.lit("https://stats.wp.com/e.js"), ("stats.wp.com",)))
    assert one(rewrite.comment_count(F.lit("12 Comments"))) == 12 and one(rewrite.comment_count(F.lit("none"))) is None
    assert one(rewrite.repair(F.lit('<o:p>a</o:p><img border="0" width="50%" src=x><input disabled="disabled">\x01'))) == 'a<img src=x><input disabled="">'


def test_bundles(spark):
    d = spark.createDataFrame([("b", 2, "two"), ("b", 1, "one"), ("b", 3, None)], "bundle string, pos int, text string")
    assert tuple(rewrite.reassemble_bundles(d).first()) == ("b", "one\ntwo", 3, 1)


def test_checklist(spark):
    rep = spark.createDataFrame([(None, None), (5, 0), (5, 2)], "checked int, broken int")
    assert [r["state"] for r in checklist.verification(rep).collect()] == ["not run", "clean", "broken"]
    rem = spark.createDataFrame([("p", "other"), ("p", "comment"), ("q", "comment"), ("q", "comment")], "page string, category string")
    assert [tuple(r) for r in checklist.excised(rem).collect()] == [("comment", "q", 2, False), ("comment", "p", 1, False), ("other", "p", 1, True)]
    v = spark.createDataFrame([("a-10x20.jpg",), ("a.jpg",), ("b-1x1.png",)], "url string")
    assert [tuple(r) for r in checklist.resized_variants(v).collect()] == [("a-10x20.jpg", "a.jpg")]
    t = checklist.thin_section(spark.createDataFrame([("p", 3), ("q", 1)], "page string, word_count int"), spark.createDataFrame([("p",)], "page string"))
    assert [tuple(r) for r in t.collect()] == [("q", 1, False), ("p", 3, True)]
    b = spark.createDataFrame([("u", "p", "auth"), ("u", "q", "auth")], "url string, page string, kind string")
    m = spark.createDataFrame([("f", "p")], "target string, page string")
    got = checklist.owner_tasks(m, b, m.withColumn("target", F.lit("/x")))
    assert {(r["kind"], r["target"], r["n_pages"], r["prefilled"]) for r in got.collect()} == {("missing_file", "f", 1, None), ("external_link", "u", 2, "keep"), ("internal_link", "/x", 1, None)}
    assert {r["task_id"][:4] for r in got.collect()} == {"mis-", "ext-", "int-"}
    assert "</" not in got.select(checklist.task_payload(got)).first()[0]
