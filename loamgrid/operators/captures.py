"""The table of captures: schema, merging of provenance, redirects, flags, output paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut, new_folder

_S = T.StringType()
CAPTURE = T.StructType(
    [T.StructField("url", _S, False), T.StructField("aliases", T.ArrayType(_S)), T.StructField("status", _S), T.StructField("http_status", T.IntegerType()), T.StructField("source", _S), T.StructField("wayback_url", _S), T.StructField("content_hash", _S), T.StructField("content_type", _S)]
    + [T.StructField("local_path", _S), T.StructField("output_path", _S), T.StructField("discovered_via", T.ArrayType(_S)), T.StructField("redirect_from", T.ArrayType(_S)), T.StructField("flags", T.ArrayType(_S)), T.StructField("first_seen", _S), T.StructField("last_fetched", _S), T.StructField("fetch_attempts", T.IntegerType())]
)
GAP_STATUSES = ("missing", "external_unfetchable")
GAP_FLAGS = ("ambiguous_canonical", "auth_gated", "odd_response", "xml_unresolved")
INVENTORY = ("sitemap", "rest_api", "xml_backup", "base_url")


def is_gap(status: Column, flags: Column) -> Column:
    return status.isin(*GAP_STATUSES) | F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, GAP_FLAGS))), F.lit(False))


def merge_discoveries(found: DataFrame) -> DataFrame:
    """(url, via[, first_seen]) rows of any number of sources to one row a URL with its provenance set, sorted."""
    return found.groupBy("url").agg(F.array_sort(F.collect_set("via")).alias("discovered_via"), F.count("*").alias("times"))


def in_inventory(via: Column) -> Column:
    return F.arrays_overlap(via, F.array(*map(F.lit, INVENTORY)))


def orphan_or_unlisted(via: Column) -> Column:
    """``orphan``: listed, never linked; ``unlisted``: linked, never listed; else NULL. A rescan or the base URL counts as neither."""
    listed = F.exists(via, lambda v: v.isin("sitemap", "rest_api", "xml_backup"))
    linked = F.exists(via, lambda v: F.startswith(v, F.lit("crawl:")) | F.startswith(v, F.lit("wayback:")))
    return F.when(listed & ~linked, F.lit("orphan")).when(linked & ~listed, F.lit("unlisted"))


def resolve_aliases(redirects: DataFrame, most: int = 64) -> DataFrame:
    """(from_url, to_url) to (from_url, target, hops), cycle-safe.

    A chain resolves to its end; a node on a cycle to itself; a node that leads into
    a cycle to the node where it enters. One hop a round for all open chains, with
    the visited nodes carried along; a round's join is by key only.
    """
    edges = cut(redirects.groupBy("from_url").agg(F.min("to_url").alias("to_url")))  # one target a source
    step = edges.select(F.col("from_url").alias("__f"), F.col("to_url").alias("__t"))
    open_ = edges.select("from_url", F.col("to_url").alias("at"), F.array("from_url").alias("seen"))
    done = None
    for i in range(most):
        nxt = open_.join(step, open_["at"] == step["__f"], "left")
        looped = F.array_contains("seen", F.col("at"))
        ended = nxt.where(F.col("__t").isNull() & ~looped).select("from_url", F.col("at").alias("target"), F.size("seen").alias("hops"))
        turned = nxt.where(looped).select("from_url", F.col("at").alias("target"), (F.size("seen") - 1).alias("hops"))
        now = ended.unionByName(turned)
        done = now if done is None else done.unionByName(now)
        open_ = cut(nxt.where(F.col("__t").isNotNull() & ~looped).select("from_url", F.col("__t").alias("at"), F.concat("seen", F.array("at")).alias("seen")))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"chains of more than {most} redirects")


def reachable(start: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, depth) reached from ``start`` (node) over ``edges`` (src, dst).

    A frontier a round, anti-joined with all that is known. Each frontier is written
    below one folder, by depth, so what is known is that folder, whatever the rounds.
    """
    spark = start.sparkSession
    edges = cut(edges.select("src", "dst").distinct())
    uri = new_folder(spark)
    schema = start.select("node").schema.add("depth", T.IntegerType())
    start.select("node").distinct().write.parquet(f"{uri}/depth=0")
    for i in range(1, most):
        front = spark.read.schema(start.select("node").schema).parquet(f"{uri}/depth={i - 1}")
        if front.isEmpty():
            return spark.read.schema(schema).parquet(uri)
        seen = spark.read.schema(schema).parquet(uri).select("node")
        front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").write.parquet(f"{uri}/depth={i}")
    raise RuntimeError(f"not settled in {most} rounds")


def duplicate_groups(captures: DataFrame, key: str = "url", content_hash: str = "content_hash", first: str = "first_seen") -> DataFrame:
    """Members of groups with equal content: (key, hash, canonical, members).

    The canonical one is not a resized variant, else the first seen, else the smallest key.
    """
    resized = F.col(key).cast("string").rlike(r"-\d+x\d+\.\w+$")
    best = F.min(F.struct(resized.alias("r"), F.col(first).alias("f"), F.col(key).alias("k")))
    groups = captures.where(F.col(content_hash).isNotNull()).groupBy(content_hash).agg(best.alias("b"), F.count("*").alias("members")).where("members > 1")
    groups = groups.select(content_hash, F.col("b.k").alias("canonical"), "members")
    return captures.join(groups, content_hash).select(key, content_hash, "canonical", "members")


def claim_paths(rows: DataFrame, path: str, key: str, content_hash: str) -> DataFrame:
    """Adds ``claim``: the path for its first claimant by key; later ones get a hash in the name."""
    nth = F.row_number().over(Window.partitionBy(path).orderBy(key))
    named = F.regexp_replace(F.col(path), r"(\.[^./]*)?$", "")
    ext = F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1)
    return rows.withColumn("nth", nth).withColumn("claim", F.when(F.col("nth") == 1, F.col(path)).otherwise(F.concat(named, F.lit("-"), F.substring(F.col(content_hash), 1, 8), ext)))


def prefix_collisions(paths: DataFrame, path: str) -> DataFrame:
    """Paths that are also a folder of another path: ancestors by equi-join, not by comparing all pairs."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    folders = paths.select(F.explode(above).alias("folder")).where("folder <> ''").distinct()
    return paths.join(folders, paths[path] == folders["folder"], "left_semi")


def canonical_folds(pages: DataFrame, url: str, canonical: str, host_of) -> DataFrame:
    """(url, canonical) of pages that declare another page of their own host as canonical."""
    return pages.where(F.col(canonical).isNotNull() & (F.col(canonical) != F.col(url)) & (host_of(F.col(canonical)) == host_of(F.col(url)))).select(url, canonical)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Captures by URL: arrays are united, the later fetched row's scalars win, first_seen is the earliest."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    lists = [f.name for f in old.schema if isinstance(f.dataType, T.ArrayType)]
    late = F.struct(F.coalesce("last_fetched", F.lit("")), "__n")
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) if c in lists else F.min(c).alias(c) if c == "first_seen" else F.max_by(c, late).alias(c) for c in old.columns if c != "url"]
    return both.groupBy("url").agg(*aggs).select(*old.columns)
