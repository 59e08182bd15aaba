"""References to resources: ranked spellings, tiers, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def build_lookup(captures: DataFrame, url: str = "url", target: str = "output_path") -> DataFrame:
    """(spelling, url, target): each spelling belongs to the capture that offers it at the best rank, then the smallest URL.

    ``captures`` has a boolean ``owned``.
    """
    src = captures.select(F.col(url).alias("url"), F.col(target).alias("target"), "owned")
    each = src.select("url", "target", F.posexplode(urls.lookup_variants(F.col("url"), F.col("owned"))).alias("rank", "spelling"))
    best = each.groupBy("spelling").agg(F.min(F.struct("rank", "url", "target")).alias("b"))
    return best.select("spelling", F.col("b.url").alias("url"), F.col("b.target").alias("target"))


def resolve_references(refs: DataFrame, lookup: DataFrame, key: list[str], url: str = "ref", owned: str = "owned") -> DataFrame:
    """Each reference with the target of its most specific spelling that is known, and the tier it was found at.

    Distinct references are spelled out and looked up once, however often they occur.
    """
    distinct = refs.select(url, owned).distinct()
    spelled = distinct.select(url, owned, F.posexplode(urls.lookup_variants(F.col(url), F.col(owned))).alias("tier", "spelling"))
    found = spelled.join(lookup.select("spelling", F.col("url").alias("__u"), F.col("target").alias("__t")), "spelling").groupBy(url, owned).agg(F.min(F.struct("tier", "__u", "__t")).alias("b"))
    found = found.select(url, owned, F.col("b.tier").alias("tier"), F.col("b.__u").alias("resource"), F.col("b.__t").alias("target"))
    return refs.join(found, [url, owned], "left").select(*key, url, owned, "tier", "resource", "target")


def classify_references(resolved: DataFrame, in_scope) -> DataFrame:
    """``outcome``: rewritten, unresolved (in scope, unknown) or left_absolute (another site's)."""
    return resolved.withColumn("outcome", F.when(F.col("target").isNotNull(), F.lit("rewritten")).when(in_scope, F.lit("unresolved")).otherwise(F.lit("left_absolute")))


def verify(refs: DataFrame, files: DataFrame, page: str, ref: str) -> DataFrame:
    """Local references with no file behind them: (page, ref, reason). ``files`` has ``path``."""
    local = refs.where(~F.col(ref).rlike(r"^(?:[a-z][a-z0-9+.-]*:|//|#)"))
    bare = F.regexp_replace(F.col(ref), r"[?#].*$", "")
    folder = F.regexp_replace(F.col(page), r"[^/]*$", "")
    whole = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    depth = F.aggregate(F.split(whole, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).otherwise(0)).alias("low")), lambda a: a["low"])
    at = local.withColumn("__escapes", depth < 0).withColumn("__path", urls.resolve_dots(whole))
    lost = at.where("NOT __escapes").join(files.select(F.col("path").alias("__path")), "__path", "left_anti").select(page, ref, F.lit("missing").alias("reason"))
    return lost.unionByName(at.where("__escapes").select(page, ref, F.lit("escapes the site root").alias("reason")))
