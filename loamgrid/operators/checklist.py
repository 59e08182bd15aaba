"""Sections of the clean-up checklist and the site owner's tasks, as tables of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Excised content in the order in which it is listed; the first three need nobody's attention.
CATEGORIES = ("comment", "password", "newsletter", "search", "other")


def unresolved_references(samples: DataFrame) -> DataFrame:
    """Distinct (page, value, context); the context only where a page has the value more than once."""
    d = samples.select("page", "value", "context").distinct()
    n = F.count("*").over(Window.partitionBy("page", "value"))
    return d.withColumn("__n", n).select("page", "value", F.when(F.col("__n") > 1, F.col("context")).alias("context"))


def remaining(samples: DataFrame, unresolved: int) -> Column:
    """How many unresolved references the samples don't show."""
    return F.lit(unresolved) - F.count("*")


def verification(report: DataFrame) -> DataFrame:
    """(state): a check that wasn't run is not a check without findings. ``report``: checked, broken (NULL: not run)."""
    return report.select(F.when(F.col("checked").isNull(), F.lit("not run")).when(F.col("broken") > 0, F.lit("broken")).otherwise(F.lit("clean")).alias("state"), "checked", "broken")


def excised(removals: DataFrame) -> DataFrame:
    """(category, page, n, attention) in category order, then most first. ``removals``: page, category."""
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    g = removals.groupBy("category", "page").agg(F.count("*").alias("n"))
    return g.withColumn("attention", ~F.col("category").isin(*CATEGORIES[:3])).orderBy(at, F.desc("n"), "page")


def kept_search(forms: DataFrame, index_ok: bool) -> DataFrame:
    """Search forms that stayed need attention unless a search index stands behind them."""
    return forms.where("category = 'search'").select("page", F.lit(not index_ok).alias("attention")).distinct()


def search_coverage(pages: DataFrame) -> DataFrame:
    """One row of per-page predicates. ``pages``: has_body, has_form, n_words, excluded."""
    return pages.agg(F.count("*").alias("n_pages"), F.count_if(~F.col("has_body")).alias("no_body"), F.count_if(~F.col("has_form")).alias("no_form"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("n_words") == 0).alias("empty"))


def thin_section(thin: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Thin pages, the acknowledged ones marked, fewest words first. ``acknowledged``: page."""
    known = acknowledged.select("page", F.lit(True).alias("acknowledged")).distinct()
    return thin.join(known, "page", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False))).orderBy("word_count", "page")


def markup_quirks(messages: DataFrame) -> DataFrame:
    """(message, n, n_pages, pages, extract) of a checker's errors, most frequent first. ``messages``: type, message, url, extract."""
    e = messages.where("type = 'error'")
    return e.groupBy("message").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_pages"), F.array_sort(F.collect_set("url")).alias("pages"), F.min_by("extract", "url").alias("extract")).orderBy(F.desc("n"), "message")


def integrity(captures: DataFrame, files: DataFrame, *keep: str) -> DataFrame:
    """(url, problem): missing files, changed bytes, shared paths, pages that aren't HTML.

    ``captures``: url, local_path, content_hash, content_type; ``files``: path, content.
    Columns of the captures named in ``keep`` go along, as several captures may have one URL.
    """
    own = ["url", *keep]
    f = files.select(F.col("path").alias("__p"), F.sha2("content", 256).alias("__h"))
    at = captures.where(F.col("local_path").isNotNull()).join(f, F.col("local_path") == F.col("__p"), "left")
    stored = at.select(*own, F.when(F.col("__p").isNull(), F.lit("file_missing")).when(F.col("__h") != F.col("content_hash"), F.lit("hash_mismatch")).alias("problem")).where("problem IS NOT NULL")
    shared = captures.where(F.col("local_path").isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy("local_path"))).where("__n > 1").select(*own, F.lit("shared_path").alias("problem"))
    shape = captures.where(F.col("url").endswith("/") & F.col("content_type").isNotNull() & ~F.lower(F.trim(F.substring_index("content_type", ";", 1))).isin("text/html", "application/xhtml+xml")).select(*own, F.lit("shape_mismatch").alias("problem"))
    return stored.unionByName(shared).unionByName(shape)


def machine_context(context: Column) -> Column:
    return context.rlike(r"^[\w-]+\[|^script:|^style")


def owner_tasks(missing: DataFrame, broken_links: DataFrame, broken_refs: DataFrame) -> DataFrame:
    """(task_id, kind, target, n_pages, prefilled): one task a missing file, a broken external link and a broken internal one.

    ``missing``: target, page; ``broken_links``: url, page, kind; ``broken_refs``: target, page.
    """
    from .reports import task_id

    def tasks(kind: str, rows: DataFrame, target: str, prefilled: Column) -> DataFrame:
        g = rows.groupBy(F.col(target).alias("target")).agg(F.countDistinct("page").alias("n_pages"), prefilled.alias("prefilled"))
        return g.select(task_id(kind, F.col("target")).alias("task_id"), F.lit(kind).alias("kind"), "target", "n_pages", "prefilled")

    none = F.max(F.lit(None).cast("string"))
    out = tasks("missing_file", missing, "target", none).unionByName(tasks("external_link", broken_links, "url", F.max(F.when(F.col("kind") == "auth", F.lit("keep")))))
    return out.unionByName(tasks("internal_link", broken_refs, "target", none))


def task_payload(tasks: DataFrame) -> Column:
    """A task as JSON that may stand inside a script element."""
    return F.replace(F.to_json(F.struct(*tasks.columns)), F.lit("</"), F.lit("<\\/"))


def resized_variants(files: DataFrame, url: str = "url") -> DataFrame:
    """(url, original): resized images whose original is known too."""
    original = F.regexp_replace(F.col(url), r"-\d+x\d+(\.\w+)$", "$1")
    cand = files.select(url, original.alias("original")).where(F.col("original") != F.col(url))
    return cand.join(files.select(F.col(url).alias("original")).distinct(), "original", "left_semi").select(url, "original")


def rescan(pages: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, n): every page once (trusted, changed, unread), and the new URLs that trusted pages link to.

    ``pages``: url, content_hash, bytes_hash (NULL: unreadable); ``found``: source, url; ``known``: url.
    """
    bucket = F.when(F.col("bytes_hash").isNull(), F.lit("unread")).when(F.col("bytes_hash") == F.col("content_hash"), F.lit("trusted")).otherwise(F.lit("changed"))
    p = pages.withColumn("bucket", bucket)
    trusted = p.where("bucket = 'trusted'").select(F.col("url").alias("source"))
    new = found.join(trusted, "source", "left_semi").select("url").distinct().join(known.select("url"), "url", "left_anti")
    return p.groupBy("bucket").agg(F.count("*").alias("n")).unionByName(new.agg(F.count("*").alias("n")).select(F.lit("new_urls").alias("bucket"), "n"))
