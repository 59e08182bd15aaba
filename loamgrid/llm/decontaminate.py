"""Benchmark decontamination with DataFrame functions only.

Every benchmark item is held against the windows of a document that are as long as
the item: SimHash fingerprints of the windows' word shingles, multi-index Hamming
blocks, then the exact weighted (multiset) Jaccard similarity of the shingles.

Of fingerprints within ``RADIUS`` bits, cut into ``BLOCKS`` blocks, some block differs
in at most RADIUS // BLOCKS bits (17 // 6 = 2). Every item is indexed by each block's
value and the values within two bits of it, so a window that looks up its own six
blocks misses no item of its length within the radius, and meets about a fifth of the
others. Similar shingle multisets have near fingerprints: at similarity 0.8 they differ
in 9.7 bits on average, with a deviation of 2.9, so about one in 150 windows that are
just at the threshold lies beyond the radius, and fewer above it.

A window that shares no shingle with any item has similarity zero, so only windows
that start at a shingle of the benchmark are fingerprinted; which item a window
belongs to is left to the blocks. Words are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import read_table, scratch, written

WIDTH = 5
LEAST = 0.8
RADIUS = 17
BLOCKS = 6
#: Rows up to which the benchmark's shingles, or the keys of documents, are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def n_shingles(w: Column, width: int = WIDTH) -> Column:
    """A run of ``width`` words from each word on, repeats included; a shorter text is one run, no word none."""
    return F.greatest(F.size(w) - (width - 1), F.least(F.size(w), F.lit(1)))


def shingles(w: Column, width: int = WIDTH) -> Column:
    """The runs as structs of words, NULL beyond a shorter text's end."""
    return F.arrays_zip(*[F.slice(w, F.lit(i + 1), n_shingles(w, width)).alias(f"w{i}") for i in range(width)])


def _hash(shingle: Column, width: int) -> Column:
    return F.xxhash64(*[shingle[f"w{i}"] for i in range(width)])


def _hashed(df: DataFrame, keys: list[str], name: str, width: int) -> DataFrame:
    """``keys`` and the hashes of the text's shingles, in order."""
    w = df.select(*keys, words(F.col("text")).alias("__w"))
    return w.select(*keys, F.transform(shingles(F.col("__w"), width), lambda s: _hash(s, width)).alias(name))


_LANES = (1 << 32) | 1


def _lane_sums(h: str) -> Column:
    """How often each bit of ``h`` is set, as 32 sums of two 32-bit lanes: bits i and i + 32."""
    return F.expr("struct(" + ", ".join(f"sum(shiftrightunsigned({h}, {i}) & {_LANES}L) AS s{i}" for i in range(32)) + ")")


def _simhash(sums: str, size: str) -> Column:
    """64-bit SimHash of ``size`` hashes from their lane sums: a bit is 1 if it is set in over half of them."""
    low = " | ".join(f"if(2 * ({sums}.s{i} & {(1 << 32) - 1}L) > {size}, {1 << i}L, 0L)" for i in range(32))
    high = " | ".join(f"if(2 * shiftrightunsigned({sums}.s{i}, 32) > {size}, {1 << i}L, 0L)" for i in range(32))
    return F.expr(f"({low}) | shiftleft({high}, 32)")


def _layout(blocks: int) -> list[tuple[int, int]]:
    """(shift, bits) of each block."""
    size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(size[:i]), s) for i, s in enumerate(size)]


def _blocks(fp: str, blocks: int, flips: int = 0) -> Column:
    """(i, v) of every block and of every value within ``flips`` bits of it."""

    def spread(i: int, at: int, bits: int) -> str:
        v = f"shiftrightunsigned({fp}, {at}) & {(1 << bits) - 1}L"
        masks = [sum(1 << b for b in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)]
        return f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> struct({i} AS i, ({v}) ^ m AS v))"

    return F.expr(f"flatten(array({', '.join(spread(i, *x) for i, x in enumerate(_layout(blocks)))}))")


def window_fingerprints(windows: DataFrame, whole: DataFrame) -> DataFrame:
    """``windows`` (d, u, n, size, start) with the fingerprint ``wfp`` of the hashes of ``whole`` (d, u, all)."""
    keys = ["d", "u", "n", "size", "start"]
    each = _of_documents(windows, whole).select(*keys, F.explode(F.slice("all", F.col("start") + 1, F.col("size"))).alias("h"))
    return each.groupBy(*keys).agg(_lane_sums("h").alias("s")).select(*keys, _simhash("s", "size").alias("wfp"))


def _of_documents(rows: DataFrame, whole: DataFrame) -> DataFrame:
    w = whole.select(F.col("d").alias("__d"), F.col("u").alias("__u"), "all")
    return rows.join(w, rows["d"].eqNullSafe(w["__d"]) & (rows["u"] == w["__u"])).drop("__d", "__u")


def _if_few(keys: DataFrame) -> DataFrame:
    """A written table of keys, for a broadcast if it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def near_items(windows: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Every (window, item, distance) of one length within ``radius`` bits, found by their blocks.

    ``windows``: any columns, ``n`` and ``wfp``; ``items``: item, n, fp.
    """
    a = windows.withColumn("__b", F.explode(_blocks("wfp", blocks)))
    b = items.select("item", "n", "fp", F.explode(_blocks("fp", blocks, radius // blocks)).alias("__b"))
    near = a.join(b, ["n", "__b"]).withColumn("distance", F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp")))).where(F.col("distance") <= radius)
    return near.select(*windows.columns, "item", "distance").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start): the best window of each leaked item of each document.

    ``start`` counts words from 0. A window has as many words as the item, or is the
    whole of a shorter document. It counts with a similarity of ``least`` or more and a
    fingerprint within ``radius`` bits; ties go to the smallest distance, then the
    first window. Items or documents under ``width`` words are one shingle. Null and
    wordless texts, on either side, leak nothing. Items with equal words are
    answered each; rows with equal doc_id and text once; rows with one doc_id and
    different texts each; a null doc_id stays null. A very long text is so many
    windows as it shares shingles with the benchmark. Other columns, whatever their
    names, are not looked at. No item or no document: no rows.
    """
    uri = scratch(docs.sparkSession, "leaks")
    names = _hashed(benchmark.where(F.col("text").isNotNull()), ["item_id"], "h", width).where(F.size("h") > 0)
    items = written(names.groupBy("h").agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("names")), f"{uri}/texts")
    sums = items.select("item", F.size("h").alias("n"), F.explode("h").alias("h")).groupBy("item", "n").agg(_lane_sums("h").alias("s"))
    marks = written(sums.select("item", "n", _simhash("s", "n").alias("fp")), f"{uri}/items")
    known = written(items.select("item", F.size("h").alias("n"), F.explode("h").alias("h")).groupBy("h", "item", "n").agg(F.count("*").alias("times")), f"{uri}/known")
    lengths = known.select("h", "n").distinct()
    few = known.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda x: x)

    # every shingle of every document against the benchmark's; what stays is small
    flat = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("w"))
    flat = flat.select("doc_id", "t", n_shingles(F.col("w"), width).alias("len"), F.posexplode(shingles(F.col("w"), width)).alias("at", "s"))
    flat = flat.select("doc_id", "t", "len", "at", _hash(F.col("s"), width).alias("h"))
    hits = written(flat.join(small(known.select("h").distinct()), "h", "left_semi").distinct(), f"{uri}/hits")

    # a window can slide right to its first shared shingle without losing one, so windows start there;
    # beyond a broadcast's size a shingle that many documents hold is salted
    salt = 1 if few else 32
    lengths = lengths.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = hits.withColumn("__s", F.pmod(F.xxhash64("doc_id", "t", "at"), F.lit(salt)).cast("int")).join(small(lengths), ["h", "__s"])
    size = F.least("len", "n")
    windows = met.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "n", size.alias("size"), F.least("at", F.col("len") - size).alias("start")).distinct()

    # fingerprints of the windows, from the few documents that have one
    mine = _if_few(written(hits.select(F.col("doc_id").alias("d"), F.col("t").alias("u")).distinct(), f"{uri}/mine"))
    text = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text")
    text = text.join(mine, text["doc_id"].eqNullSafe(mine["d"]) & (text["t"] == mine["u"]), "left_semi").groupBy("doc_id", "t").agg(F.any_value("text").alias("text"))
    whole = written(_hashed(text, ["doc_id", "t"], "all", width).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "all"), f"{uri}/whole")
    near = written(near_items(window_fingerprints(windows, whole), marks, radius, blocks), f"{uri}/near")

    # exact weighted similarity of the shingle multisets
    keys = ["d", "u", "item", "n", "size", "start", "distance"]
    mass = _of_documents(near, whole).select(*keys, F.explode(F.slice("all", F.col("start") + 1, F.col("size"))).alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("c"))
    both = mass.join(known.select("item", "h", "times"), ["item", "h"]).groupBy(*keys).agg(F.sum(F.least("c", "times")).alias("both"))
    both = both.withColumn("similarity", F.col("both") / (F.col("n") + F.col("size") - F.col("both"))).where(F.col("similarity") >= least)
    best = both.groupBy("d", "u", "item").agg(F.max(F.struct("similarity", -F.col("distance"), -F.col("start"))).alias("k"))
    best = best.select(F.col("d").alias("doc_id"), "item", F.col("k.similarity").alias("similarity"), (-F.col("k.col2")).alias("distance"), (-F.col("k.col3")).alias("start"))
    return best.join(items.select("item", F.explode("names").alias("item_id")), "item").select("doc_id", "item_id", "similarity", "distance", "start")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, in whose text no item is found."""
    uri = scratch(docs.sparkSession, "leaked")
    bad = _if_few(written(find_leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__bad")).distinct(), f"{uri}/bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")


def op6_simhash_leaks(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity) of every leak."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc_id", "item_id", "similarity")


def _sql_shingles(table: str, key: str) -> str:
    words = f"SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table} WHERE text IS NOT NULL"
    return f"SELECT {key}, len, pos, array_to_string(w[pos + 1:pos + {WIDTH}], ' ') AS h FROM (SELECT {key}, w, CASE WHEN w = [''] THEN 0 ELSE greatest(len(w) - {WIDTH - 1}, 1) END AS len FROM ({words})), unnest(range(len)) AS u(pos)"


#: Every window by plain counting of shared shingles.
OP6_SQL = f"""WITH d AS ({_sql_shingles('documents', 'doc_id')}), i AS ({_sql_shingles('benchmark', 'item_id')}),
k AS (SELECT item_id, len AS n, h, count(*) AS times FROM i GROUP BY ALL),
hits AS (SELECT doc_id, item_id, len, n, pos, h, times, least(len, n) AS size FROM d JOIN k USING (h)),
s AS (SELECT DISTINCT doc_id, item_id, least(pos, len - size) AS start FROM hits),
c AS (SELECT doc_id, item_id, start, n, size, h, times, count(*) AS c FROM s JOIN hits USING (doc_id, item_id) WHERE pos >= start AND pos < start + size GROUP BY ALL),
b AS (SELECT doc_id, item_id, start, n, size, sum(least(c, times))::BIGINT AS shared FROM c GROUP BY ALL)
SELECT doc_id, item_id, max(shared / (n + size - shared)::DOUBLE) AS similarity FROM b GROUP BY 1, 2 HAVING max(shared / (n + size - shared)::DOUBLE) >= {LEAST}"""
