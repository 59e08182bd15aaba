import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loamgrid.llm import decontaminate as dc
from loamgrid.llm import simhash_dedup as sd


def naive_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, fps, radius=2):
    parent = {f: f for f in set(fps)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, fps):
        least[root(f)] = min(i, least.get(root(f), i))
    return {i: least[root(f)] for i, f in zip(ids, fps)}


def test_op5(spark, small):
    got = {r["doc_id"]: r for r in sd.op5_pigeonring_simhash(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    fps = [naive_fingerprint(d["text"]) for d in docs]
    want = naive_components([d["doc_id"] for d in docs], fps)
    assert {i: r["fingerprint"] for i, r in got.items()} == {d["doc_id"]: f"{f:016x}" for d, f in zip(docs, fps)}
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_find_every_pair(spark, bucket):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:40]:
        for k in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sd.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    if bucket == 64:
        assert {(r["a"], r["b"]) for r in links} == near
    else:  # through midpoints: the same closure
        from loamgrid.llm._shared import scratch

        got = {r["node"]: r["root"] for r in sd.components(spark.createDataFrame([tuple(r) for r in links], "a long, b long"), scratch(spark, "test")).collect()}
        want = naive_components(signed, [f & (1 << 64) - 1 for f in signed])
        assert all(got.get(a, a) == got.get(b, b) for a, b in near)
        assert len({got.get(f, f) for f in signed}) == len(set(want.values()))


def test_op5_edges(spark):
    d = spark.createDataFrame([(4, None), (3, ""), (9, "one two"), (8, "One  TWO"), (None, "one two"), (7, "long " * 30_000), (7, "long " * 30_000)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in sd.near_duplicates(d).collect())
    assert got == [(0, 8), (3, 3), (4, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert sd.near_duplicates(d.limit(0)).count() == 0
    kept = sd.keep_one_of_each(d.withColumn("fp", F.lit("x")).withColumn("n", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp", "n"] and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert sd.keep_one_of_each(nulls).count() == 1


def naive_leaks(docs, items, width=5, least=0.8):
    import re
    from collections import Counter

    def runs(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])

    out = {}
    for i, t in docs:
        d = runs(t)
        for j, u in items:
            b = runs(u)
            if not b or not d:
                continue
            size = min(len(b), len(d))
            best = max(sum((Counter(d[s : s + size]) & Counter(b)).values()) for s in range(len(d) - size + 1))
            sim = best / (len(b) + size - best)
            if sim >= least:
                out[i, j] = sim
    return out


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([8, 30, 60, 120, 3])]
    body = lambda n: " ".join(word() for _ in range(n))
    swapped = items[3][1].split()
    docs = [(j, f"{body(40)} {t.upper()}, {body(20)}") for j, t in items]
    docs += [(10, body(100)), (11, " ".join(items[2][1].split()[:-4])), (12, items[3][1].replace(" ", ", ", 7)), (13, " ".join(swapped[60:] + swapped[:60])), (14, None), (15, ""), (16, items[4][1])]
    one = items[3][1].split()
    one[50] = "changed"
    docs += [(17, body(30) + " " + " ".join(one) + " " + body(30)), (18, " ".join(items[1][1].split()[::2]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (7, None), (8, items[1][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(d, b).collect()}
    assert got == pytest.approx(naive_leaks(docs, [*items, (8, items[1][1])]))
    assert (17, 3) in got and (13, 3) in got and (1, 8) in got
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0
    kept = dc.drop_leaks(d.withColumn("start", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "start"] and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_op6_has_no_python(spark, small):
    df = dc.op6_simhash_leaks(spark, small)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert {(r["doc_id"], r["item_id"]) for r in df.collect()} == set(naive_leaks(docs, items))


def test_blocks_miss_no_fingerprint_within_the_radius(spark):
    rng = random.Random(8)
    items = [(j, 20 + j % 3, rng.getrandbits(64)) for j in range(60)]
    windows = []
    for j, (_, n, fp) in enumerate(items):
        for k in range(25):  # 0 to 24 bits away
            x = fp
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            windows.append((j * 100 + k, n, x))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = spark.createDataFrame([(i, n, signed(x)) for i, n, x in windows], "w long, n int, wfp long")
    b = spark.createDataFrame([(i, n, signed(x)) for i, n, x in items], "item long, n int, fp long")
    got = {(r["w"], r["item"], r["distance"]) for r in dc.near_items(w, b).collect()}
    want = {(i, j, (x ^ y).bit_count()) for i, n, x in windows for j, m, y in items if n == m and (x ^ y).bit_count() <= dc.RADIUS}
    assert got == want and len(want) >= 60 * 18
    # a random fingerprint meets about a fifth of the items of its length
    met = sum(any(((x ^ y) >> at & (1 << bits) - 1).bit_count() <= dc.RADIUS // dc.BLOCKS for at, bits in dc._layout(dc.BLOCKS)) for _, _, x in windows[:200] for _, _, y in items[20:])
    assert met < 0.3 * 200 * 40


def test_radius_holds_the_similarity(spark):
    """Recall of the fingerprints against exact similarity, over items with words changed here and there."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(j, " ".join(word() for _ in range(rng.randint(20, 90)))) for j in range(36)]
    docs = []
    for j, t in items:
        for k in range(4):
            w = t.split()
            for at in rng.sample(range(len(w)), max(1, len(w) * k // 100)):
                w[at] = word()
            docs.append((j * 10 + k, f"{word()} {' '.join(w)} {word()}"))
    want = naive_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(want) > 80 and len(got) >= 0.98 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_leaks_of_ties_repeats_and_long_texts(spark):
    t = "one two three four five six seven eight nine ten"
    long = "filler words of no use " * 1000
    docs = [(1, f"{t} and again {t}", "a", 1), (1, f"{t} and again {t}", "b", 2), (2, long + t + " " + long, "c", 3), (None, t, "d", 4), (3, t.upper(), "e", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, start int")
    got = sorted(((r["doc_id"] or 0), r["item_id"], r["similarity"], r["distance"], r["start"]) for r in dc.find_leaks(d, spark.createDataFrame([(9, t, 0)], "item_id long, text string, n int")).collect())
    assert got == [(0, 9, 1.0, 0, 0), (1, 9, 1.0, 0, 0), (2, 9, 1.0, 0, 5000), (3, 9, 1.0, 0, 0)]
