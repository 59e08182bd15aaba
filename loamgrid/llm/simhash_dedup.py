"""SimHash near-duplicates, found by pigeonring filtering.

Fingerprints of 64 bits are cut into ``SEGMENTS`` consecutive segments on a ring.
If two fingerprints differ in at most tau bits, then some segment starts a chain
whose first l segments differ in at most l * tau / SEGMENTS bits together, for
every l. With tau = 2 and five segments a chain starts with two equal segments, so
those two are the join key, and the rest of the chain prunes a pair before its
full Hamming distance is taken.

Only distinct fingerprints are compared. A join bucket with more than ``BUCKET`` of
them is not paired up: its members go by shared midpoints (two fingerprints within
two bits have a common neighbour within one bit), at most 65 fingerprints a
midpoint, which finds the same links without a quadratic step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import as_bytes, attach, read_table, scratch, slices, take_turn, written

RADIUS = 2
SEGMENTS = 5
BUCKET = 64
CROWD = 1_000_000
_RUN = 1 << 16


def shingle_hashes(raw: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words of the A-Z-lowered text, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [h(joined, 42)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = start[width - 1 :] + size[width - 1 :]
    return [h(joined[a:b], 42) for a, b in zip(start.tolist(), end.tolist())]


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; no word: zero. Signed 64 bits."""
    return majority(np.array(shingle_hashes(raw or b"", width), np.uint64))


def majority(a: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, signed; of none zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), _RUN):
        ones += np.unpackbits(a[i : i + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    """All columns and the fingerprint as a long."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn()
        for batch in batches:
            for b in slices(batch, text):
                fp = pa.array([fingerprint(x) for x in as_bytes(b.column(text))], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _layout(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    size = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(size[:i]), s) for i, s in enumerate(size)]


def _piece(x: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def pigeonring_keys(fp: Column, radius: int = RADIUS, segments: int = SEGMENTS) -> Column:
    """For every start, the start and the values of the segments that must be equal there."""
    lay = _layout(segments)
    equal = max(1, (segments - 1) // radius) if radius else segments
    return F.array(*[F.struct(F.lit(i).alias("start"), *[_piece(fp, *lay[(i + j) % segments]).alias(f"s{j}") for j in range(equal)]) for i in range(segments)])


def chain_holds(x: Column, start: Column, radius: int = RADIUS, segments: int = SEGMENTS) -> Column:
    """Whether the chain from ``start`` over the differing bits ``x`` keeps every budget l * radius / segments."""
    d = [F.bit_count(_piece(x, *s)) for s in _layout(segments)]
    ok = F.lit(False)
    for i in range(segments):
        run, mine = F.lit(0), F.lit(True)
        for n in range(1, segments + 1):
            run = run + d[(i + n - 1) % segments]
            mine = mine & (run <= n * radius // segments)
        ok = F.when(start == i, mine).otherwise(ok)
    return ok


def hamming_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b as longs, whose closure connects exactly the fingerprints within ``radius``.

    ``fps`` has one distinct non-null long ``fp``. Every link is within the radius;
    pairs inside a crowded bucket are linked through midpoints (``radius`` 2 only).
    """
    keyed = fps.select("fp", F.explode(pigeonring_keys(F.col("fp"), radius, segments)).alias("k"))
    sizes = keyed.groupBy("k").count().where(F.col("count") > 1)
    few = keyed.join(sizes.where(F.col("count") <= bucket).select("k"), "k", "left_semi") if radius == 2 else keyed
    a, b = few.select("k", F.col("fp").alias("a")), few.select("k", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = a.join(b, "k").where((F.col("a") < F.col("b")) & chain_holds(x, F.col("k.start"), radius, segments) & (F.bit_count(x) <= radius)).select("a", "b")
    if radius == 2:
        crowd = keyed.join(sizes.where(F.col("count") > bucket).select("k"), "k", "left_semi").select("fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        mids = crowd.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
        met = mids.groupBy("mid").agg(F.collect_list("fp").alias("all"), F.min("fp").alias("a")).where(F.size("all") > 1)  # 65 at most
        near = near.union(met.select("a", F.explode("all").alias("b")).where(F.col("a") < F.col("b")))
    return near.distinct()


def components(links: DataFrame, uri: str, rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``links`` (a, b) with the smallest node that it is connected to.

    Alternating large-star and small-star steps (Kiveris et al.), each written to
    ``uri``, so lost executors cost a step at most; nothing reaches the driver but
    a row count and a checksum. A node with more than ``CROWD`` edges, such as the root
    of a giant component, is looked up by broadcast, so its edges need not meet.
    """
    now = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), f"{uri}/0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for i in range(1, rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("w"))
        large = attach(both, low, "u", "w", "v", CROWD).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = attach(down, low, "u", "w", "v", CROWD).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, f"{uri}/{i}")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprint_classes(ids: DataFrame, uri: str) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, fp): the distinct fingerprints with their counts and component, as (fp, n, rep, component_id)."""
    groups = written(ids.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), f"{uri}/groups")
    roots = components(hamming_links(groups.select("fp")), f"{uri}/links")
    mine = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    mine = written(mine, f"{uri}/roots")
    least = written(mine.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("w")), f"{uri}/least")
    return written(attach(mine, least, "root", "w", "fp"), f"{uri}/classes"), least


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id that its links reach.

    Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows fall together; a component whose ids are all null has a
    null component_id. An empty table gives no rows.
    """
    uri = scratch(df.sparkSession, "simhash")
    src = with_fingerprint(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.col("__fp").alias("fp"))
    ids = written(src, f"{uri}/ids")
    classes, _ = fingerprint_classes(ids, uri)
    out = attach(ids, classes.select("fp", "n", "component_id"), "fp", "n", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, one a component: that with the smallest id (ties: any one of them)."""
    uri = scratch(docs.sparkSession, "dedup")
    name = "__fp" + "_" * max(map(len, docs.columns))  # no other column has it
    marked = written(with_fingerprint(docs, text, name), f"{uri}/docs")
    ids = marked.select(F.col(id_col).alias("doc_id"), F.col(name).alias("fp"))
    classes, _ = fingerprint_classes(ids, uri)
    # one fingerprint of each component holds its smallest id; of those that share it, the least
    best = classes.where(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("rep", "fp")).alias("k")).select("k.rep", "k.fp")
    on = marked[name].eqNullSafe(best["fp"]) & marked[id_col].eqNullSafe(best["rep"])
    return marked.join(best, on, "left_semi").dropDuplicates([id_col, name]).drop(name)


def op5_pigeonring_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
