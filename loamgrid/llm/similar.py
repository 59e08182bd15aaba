"""Near-duplicates: SimHash pigeonring first, exact similarity of word shingles throughout.

Two texts are near-duplicates if the Jaccard similarity of their sets of ``WIDTH``-word
shingles is ``LEAST`` or more. Sets whose SimHash fingerprints lie within two bits are found
by op5's pigeonring search and compared exactly; what is similar among them forms first
groups. Similar sets may differ in more bits than any search of fingerprints can promise,
so prefix filtering looks for links between the groups, which misses none:
with the shingles of every set in one order, similar sets share one of the first
n - ceil(LEAST * n) + 1. The order is that of the hashes with shingles that are frequent
in a sample last, by their counts, so few sets meet in a bucket; it has no influence on the
result. What lengths and positions leave open is compared shingle by shingle.

A large group of near-copies would make pairs by the square of its size. So the first groups
are also made of neighbours: of the sets that share one of their ``SMALLEST`` smallest
shingles, whether frequent or not, each with the next two by length, compared exactly too. Prefix filtering pairs no two sets of a
group, so what is left of such a group are pairs with the few sets that are not in it yet.

Equal sets are compared once. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, in_turn, open_fs, scratch, slices, written
from .simhash_dedup import components, hamming_links, majority
from .suffix_lm import MAPPED_FILES, _mapped, mix, word_hashes

WIDTH = 5
LEAST = (4, 5)
#: Rows whose shingles are counted for the order, a twelfth of them at least - a bucket that the sample doesn't notice must
#: not grow with the table - and how many frequent shingles are kept, a quarter as many as rows at least.
SAMPLE, THIN, FREQUENT = 20_000, 12, 200_000
#: Smallest shingles of a set, by which it gets neighbours for the first groups.
SMALLEST = 3
FEW_SETS = 2_000_000
_R = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
_OPEN = 16


def shingle_set(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of each run of ``width`` words, ascending; a shorter text is one run, no word none."""
    w = word_hashes(raw or b"")
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(len(w), width)):
        h = h * _R + w[i : i + n]
    return np.unique(mix(h))


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b members that share so many reach ``LEAST``, in whole numbers."""
    p, q = LEAST
    return (p + q) * shared >= p * (a + b)


def _longs(uri: str, *names: str) -> list[np.ndarray]:
    fs, path = open_fs(uri)
    table = pq.read_table(path, columns=list(names), filesystem=fs)
    return [table[c].to_numpy() for c in names]


def _pairs(h: np.ndarray, sig: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of sets of different groups that share a shingle and may be similar by length and position, as rows (a, b), a < b.

    Without ``group`` each set is one. The largest group of a bucket is not paired within
    itself, so the work follows what has to be compared.
    """
    p, q = LEAST
    group = sig if group is None else group
    order = np.lexsort((sig, n, h))
    h, sig, n, at, group = h[order], sig[order], n[order], at[order], group[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    h, sig, n, at, group = h[first], sig[first], n[first], at[first], group[first]
    bucket = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
    main = _largest(bucket, group)

    def met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (group[i] != group[j]) & similar(np.minimum(n[i] - at[i], n[j] - at[j]), n[i], n[j])
        return np.sort(np.column_stack([sig[i[ok]], sig[j[ok]]]), axis=1)

    rest, step = np.flatnonzero(~main), 1
    k = np.arange(len(rest))
    while len(k):
        k = k[k + step < len(rest)]
        i, j = rest[k], rest[k + step]
        near = (bucket[i] == bucket[j]) & (q * n[i] >= p * n[j])
        k = k[near]
        if len(both := met(i[near], j[near])):
            yield both
        step += 1
    there = np.flatnonzero(main)
    place = (bucket[there] << 32) + n[there]
    low = np.searchsorted(place, (bucket[rest] << 32) + -(-p * n[rest] // q), "left")
    size = np.searchsorted(place, (bucket[rest] << 32) + q * n[rest] // p, "right") - low
    rest, low, size = rest[size > 0], low[size > 0], size[size > 0]
    run, a = np.cumsum(size), 0
    while a < len(rest):
        b = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + _CHUNK, "right")))
        i, each = np.repeat(rest[a:b], size[a:b]), np.repeat(low[a:b] - (run[a:b] - size[a:b]), size[a:b])
        if len(both := met(i, there[each + np.arange(run[a] - size[a], run[b - 1])])):
            yield both
        a = b


def _largest(bucket: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each row, ordered by bucket, is of its bucket's largest group, where that has two rows or more."""
    order = np.lexsort((group, bucket))
    b, g = bucket[order], group[order]
    start = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (g[1:] != g[:-1]))[: len(b)])
    size = np.diff(np.append(start, len(b)))
    ranked = np.lexsort((size, b[start]))
    last = ranked[np.append(b[start][ranked][1:] != b[start][ranked][:-1], True)[: len(ranked)]]
    chosen = np.zeros(len(start), bool)
    chosen[last] = size[last] > 1
    out = np.empty(len(b), bool)
    out[order] = np.repeat(chosen, size)
    return out


def _neighbours(marks: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets that are next or next but one by length among those with one of their smallest shingles."""
    some = marks.select("sig", "n", F.explode("low").alias("h"))
    p, q = LEAST
    order = Window.partitionBy("h").orderBy("n", "sig")
    two = F.array(*[F.struct(F.lead("sig", i).over(order).alias("next"), F.lead("n", i).over(order).alias("m")) for i in (1, 2)])
    both = some.select("sig", "n", two.alias("x")).select("sig", "n", F.explode("x").alias("x")).select("sig", "n", "x.*").where((F.col("sig") != F.col("next")) & (q * F.col("n") >= p * F.col("m")))
    return both.select(F.least("sig", "next").alias("a"), F.greatest("sig", "next").alias("b"))


def similar_sets(rows: DataFrame, uri: str) -> tuple[DataFrame, DataFrame]:
    """From (k, id, text): (sig, rep) of each distinct set, and the links (a, b) of similar ones.

    ``k`` tells rows with different ids or texts apart; ``rep`` is a struct that starts
    with the smallest id of the set's rows and ends with that row's k. Up to ``FEW_SETS``
    sets in pairs are looked up in every task's memory (16 bytes each); more are joined.
    """
    kind = rows.schema["id"].dataType.simpleString()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    thin = max(1, min(THIN, total // SAMPLE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                h = [shingle_set(x) for x in as_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    some = rows.where(F.pmod("k", F.lit(thin)) == 0).mapInArrow(in_turn(count), "h long")
    written(some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(max(FREQUENT, total // 4)), f"{uri}/frequent")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, often = _longs(f"{uri}/frequent", "h", "count")
        late = late.view(np.uint64)
        order = np.argsort(late)
        late, often = late[order], often[order]
        p, q = LEAST
        for batch in batches:
            for b in slices(batch):
                sig, size, head, low, fp = [], [], [], [], []
                for raw in as_bytes(b.column("text")):
                    s = shingle_set(raw)
                    n = len(s)
                    sig.append(int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                    size.append(n)
                    low.append(s[:SMALLEST].view(np.int64))
                    fp.append(majority(s))
                    if n and len(late):
                        place = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        there = late[place] == s
                        s = np.concatenate([s[~there], s[there][np.argsort(often[place[there]], kind="stable")]])
                    head.append(s[: n - -(-p * n // q) + 1].view(np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (head, low)]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("id"), pa.array(sig, pa.int64()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), *lists], names=["k", "id", "sig", "n", "fp", "head", "low"])

    marks = written(rows.mapInArrow(in_turn(sign), f"k long, id {kind}, sig long, n int, fp long, head array<long>, low array<long>"), f"{uri}/marks")
    classes = written(marks.groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k")).alias("rep"), F.first("fp").alias("fp")), f"{uri}/sets")

    # the pigeonring's pairs: sets of one fingerprint with the least of them, and the least ones of linked fingerprints
    least = written(classes.groupBy("fp").agg(F.min("sig").alias("least")), f"{uri}/fingerprints")
    ends = hamming_links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = classes.join(least, "fp").where("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    ring = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same).union(_neighbours(marks)).distinct(), f"{uri}/ring-pairs")
    near = similar_pairs(rows, classes, ring, f"{uri}/ring")
    groups = written(components(near, f"{uri}/ring-roots"), f"{uri}/groups")
    grouped = groups.count() <= FEW_SETS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        h, sig, n, at, *more = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in got[0].schema.names)
        del got
        group = more[0] if more else sig
        if grouped:
            node, root = _longs(f"{uri}/groups", "node", "root")
            if len(node):
                order = np.argsort(node)
                place = order[np.minimum(np.searchsorted(node[order], sig), len(node) - 1)]
                group = np.where(node[place] == sig, root[place], sig)
        held, size = [], 0
        for both in chain(_pairs(h, sig, n.astype(np.int64), at.astype(np.int64), group), [None]):
            if both is not None:
                held.append(both)
                size += len(both)
            if held and (both is None or size >= _CHUNK):
                x = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
                held, size = [], 0

    known = marks if grouped else marks.join(groups, marks["sig"] == groups["node"], "left")
    heads = known.select(F.posexplode("head").alias("at", "h"), "sig", "n", *([] if grouped else [F.coalesce("root", "sig").alias("group")])).select("h", "sig", "n", "at", *([] if grouped else ["group"])).repartition(tasks, "h")
    pairs = written(heads.mapInArrow(in_turn(meet), "a long, b long").distinct(), f"{uri}/pairs")
    return classes, near.union(similar_pairs(rows, classes, pairs, f"{uri}/rest"))


def similar_pairs(rows: DataFrame, classes: DataFrame, pairs: DataFrame, uri: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, compared shingle by shingle."""
    nodes = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = written(classes.join(nodes, "sig").select("sig", F.col("rep.k").alias("k")), f"{uri}/wanted")
    few = wanted.count() <= FEW_SETS

    folder = f"{uri}/sets-of-pairs"
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets that pairs ask for go to a file a task; its rows say where each lies. A lost attempt's file is never listed."""
        if few:
            sig, k = _longs(f"{uri}/wanted", "sig", "k")
            order = np.argsort(k)
            sig, k = sig[order], k[order]
        fs, path = open_fs(folder)
        attempt, at, out = TaskContext.get().taskAttemptId(), 0, None
        for batch in batches:
            if few:
                mine = batch.column("k").to_numpy()
                near = np.minimum(np.searchsorted(k, mine), len(k) - 1)
                batch = batch.take(pa.array(np.flatnonzero(k[near] == mine) if len(k) else np.zeros(0, np.int64)))
            for b in slices(batch):
                name = sig[np.searchsorted(k, b.column("k").to_numpy())] if few else b.column("sig").to_numpy()
                sets = [shingle_set(x) for x in as_bytes(b.column("text"))]
                size = np.array([len(x) for x in sets], np.int64)
                out = out or fs.open_output_stream(f"{path}/{attempt}")
                for x in sets:
                    out.write(x.tobytes())
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), attempt)), pa.array(start), pa.array(size)], names=["sig", "file", "start", "n"])
        if out:
            out.close()

    texts = rows.select("k", "text") if few else rows.select("k", "text").join(wanted, "k")
    sets = written(texts.mapInArrow(in_turn(fetch), "sig long, file long, start long, n long").dropDuplicates(["sig"]), f"{uri}/members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        local = fs.type_name == "local"
        opened: OrderedDict = OrderedDict()

        def members(file: int, start: int, n: int) -> np.ndarray:
            if not n:
                return np.zeros(0, np.uint64)
            if file not in opened:
                opened[file] = np.frombuffer(_mapped(f"{path}/{file}"), np.uint64) if local else fs.open_input_file(f"{path}/{file}")
                if len(opened) > (MAPPED_FILES if local else _OPEN):
                    opened.popitem(last=False)
            opened.move_to_end(file)
            return opened[file][start : start + n] if local else np.frombuffer(opened[file].read_at(8 * n, 8 * start), np.uint64)

        last, x = None, None
        for batch in batches:
            keep = []
            for *one, p, q, n in zip(*(batch.column(c).to_pylist() for c in ("xf", "xs", "xn", "yf", "ys", "yn"))):
                if one != last:
                    last, x = one, members(*one)
                keep.append(bool(similar(len(np.intersect1d(x, members(p, q, n), assume_unique=True)), len(x), n)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    where = lambda end, k: sets.select(F.col("sig").alias(end), F.col("file").alias(k + "f"), F.col("start").alias(k + "s"), F.col("n").alias(k + "n"))
    both = pairs.join(where("b", "y"), "b").join(where("a", "x"), "a").select("a", "b", "xf", "xs", "xn", "yf", "ys", "yn").sortWithinPartitions("a")
    return written(both.mapInArrow(in_turn(compare), "a long, b long"), f"{uri}/links")


def keep_one_similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, one a group of near-duplicates: that with the smallest id (ties: any one of them).

    A group is what pairs of similar texts connect. Null, empty and wordless texts
    are one group. ``docs`` is read more than once and must give the same rows.
    """
    uri = scratch(docs.sparkSession, "similar")
    key = F.xxhash64(F.col(id_col), F.col(text))
    classes, links = similar_sets(docs.select(key.alias("k"), F.col(id_col).alias("id"), F.col(text).alias("text")), uri)
    roots = components(links, f"{uri}/roots")
    mine = classes.join(roots, classes["sig"] == roots["node"], "left").select("rep", F.coalesce("root", "sig").alias("root"))
    best = mine.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.k").alias("__best"))
    marked = docs.withColumn("__k", key)
    return marked.join(best, marked["__k"] == best["__best"], "left_semi").dropDuplicates(["__k"]).drop("__k")
