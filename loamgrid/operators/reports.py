"""Findings as tables: counts, gaps, rules and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARCHIVES = (
    ("author", r"/author/"),
    ("category", r"/category/"),
    ("tag", r"/tag/"),
    ("date", r"/(?:19|20)\d{2}/(?:\d{2}/)?$"),
    ("paged", r"/page/\d+|[?&]page="),
    ("feed", r"/feed/?$"),
)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def flag_histogram(df: DataFrame, flags: str = "flags") -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def message_groups(df: DataFrame, level: str, message: str, top: int = 50) -> DataFrame:
    """(level, message, n), most frequent first: a top-k report."""
    return df.groupBy(level, message).agg(F.count("*").alias("n")).orderBy(F.desc("n"), level, message).limit(top)


def archive_counts(urls: DataFrame, url: str) -> DataFrame:
    """URLs by low-value archive kind, one row, and those of any kind."""
    hit = [F.col(url).rlike(p) for _, p in ARCHIVES]
    any_ = hit[0]
    for h in hit[1:]:
        any_ = any_ | h
    return urls.agg(*[F.count_if(h).alias(f"n_{n}") for (n, _), h in zip(ARCHIVES, hit)], F.count_if(any_).alias("n_any"), F.count("*").alias("n_urls"))


def dry_run_findings(records: DataFrame, reachable: dict[str, bool], export_configured: bool) -> DataFrame:
    """(rule, severity, detail) of what a look at the inventory alone finds.

    ``records``: url, discovered_via (array) of inventory records; ``reachable``: whether
    ``sitemap``, ``rest_api`` and ``xml_backup`` answered. A source that answered and
    lists nothing is a concern, and so is an inventory of the base URL alone, which
    leaves out the lesser notices. One source that lists under a tenth of the other's
    count is a notice, and so are archives from 20 and from a tenth of the inventory on.
    """
    sitemap, rest = reachable.get("sitemap", False), reachable.get("rest_api", False)
    has = lambda v: F.count_if(F.array_contains("discovered_via", v))
    archive = F.lit(False)
    for _, p in ARCHIVES:
        archive = archive | F.col("url").rlike(p)
    one = records.agg(F.count("*").alias("n"), has("sitemap").alias("sitemap"), has("rest_api").alias("rest_api"), F.countDistinct(F.when(archive, F.col("url"))).alias("archives"))
    c, some = F.col, F.col("n") > 1

    def rule(name: str, severity: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))

    low = F.when(c("sitemap") < c("rest_api"), F.lit("sitemap")).otherwise(F.lit("rest_api"))
    both = F.lit(sitemap and rest) & (c("sitemap") > 0) & (c("rest_api") > 0)
    rules = [
        rule("nothing_discovered", "concern", ~some, c("n")),
        rule("no_inventory_source", "concern", F.lit(not any(reachable.values())), F.lit("none")),
        rule("single_live_source", "notice", some & F.lit(sitemap != rest and not export_configured), F.lit("sitemap" if sitemap else "rest_api")),
        *[rule("source_contributed_nothing", "concern", F.lit(bool(reachable.get(k))) & (c(k) == 0), F.lit(k)) for k in ("sitemap", "rest_api")],
        rule("source_underweight", "notice", both & (F.least("sitemap", "rest_api") / F.greatest("sitemap", "rest_api") < 0.10), low),
        rule("low_value_archives", "notice", some & (c("archives") >= 20) & (c("archives") / c("n") >= 0.10), c("archives")),
    ]
    return one.select(F.inline(F.array_compact(F.array(*rules))))


def dry_run_verdict(findings: DataFrame) -> DataFrame:
    """One row: ``attention`` with a concern, ``review`` with a notice, else ``ready``."""
    n = lambda x: F.count_if(F.col("severity") == x) > 0
    return findings.agg(F.when(n("concern"), F.lit("attention")).when(n("notice"), F.lit("review")).otherwise(F.lit("ready")).alias("verdict"), F.count("*").alias("n_findings"))


TASK_PREFIX = {"external_link": "ext", "internal_link": "int", "missing_file": "mis"}


def task_id(kind: str, target: Column) -> Column:
    return F.concat(F.lit(TASK_PREFIX[kind] + "-"), F.substring(F.sha2(F.concat(F.lit(kind), F.lit("\x00"), target), 256), 1, 6))


def grouped_by_target(refs: DataFrame, target: str, page: str, context: str) -> DataFrame:
    """Per target: pages, their number and the first context that says something to a reader."""
    useful = F.when(F.col(context).isNotNull() & (F.trim(context) != "") & ~F.col(context).rlike(r"^[\w-]+\[|^script:"), F.col(context))
    return refs.groupBy(target).agg(F.countDistinct(page).alias("n_pages"), F.array_join(F.array_sort(F.collect_set(F.col(page).cast("string"))), ",").alias("pages"), F.min(useful).alias("context"))


def redundant_blocks(blocks: DataFrame, text: str, page: str, least_bytes: int = 51_200, emitted: str | None = None) -> DataFrame:
    """Blocks of text repeated over pages whose repetition wastes ``least_bytes`` or more: (hash, size, n, wasted).

    A block that is rewritten differently on different pages (``emitted``) is left out.
    """
    h = F.substring(F.sha2(F.col(text), 256), 1, 12)
    forms = F.countDistinct(emitted) if emitted else F.lit(1).cast("bigint")
    g = blocks.groupBy(h.alias("hash")).agg(F.max(F.octet_length(text)).alias("size"), F.count("*").alias("n"), F.countDistinct(page).alias("n_pages"), (forms if emitted else F.max(forms)).alias("forms"))
    return g.withColumn("wasted", (F.col("n") - 1) * F.col("size")).where((F.col("wasted") >= least_bytes) & (F.col("n_pages") > 1) & (F.col("forms") == 1)).drop("forms")


def headline(attention: Column, markup: Column, unrun: Column) -> Column:
    return F.when(attention > 0, F.lit("attention")).when(markup > 0, F.lit("markup only")).when(unrun > 0, F.lit("checks not run")).otherwise(F.lit("clean"))


def form_category(html: Column) -> Column:
    """Of a form's markup: comment before password before search before newsletter before other."""
    return (
        F.when(html.rlike(r"(?i)id=\"commentform\"|wp-comments-post"), F.lit("comment"))
        .when(html.rlike(r"(?i)post-password-form|type=\"password\""), F.lit("password"))
        .when(html.rlike(r"(?i)role=\"search\"|name=\"s\"|type=\"search\""), F.lit("search"))
        .when(html.rlike(r"(?i)newsletter|subscribe|mailchimp|mc4wp"), F.lit("newsletter"))
        .otherwise(F.lit("other"))
    )
