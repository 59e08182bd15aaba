import random

import corpus_pipeline as cp
import numpy as np

from loamgrid.llm import similar as sm


def runs(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def naive_kept(rows, p=4, q=5):
    """The smallest id of each group that similar pairs connect."""
    sets = {i: runs(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and q * len(a & b) >= p * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return {i for i in sets if root(i) == i}


def test_near_copies_go(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 9, 40, 100, 300]))]
        for _ in range(4):
            v = w[:]
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(3000)}"
            rows.append(" ".join(v[: len(v) - rng.randint(0, 2)]))
    rows += ["same line here again and again " * rng.randint(1, 40) + f"end{i % 3}" for i in range(15)]
    rows += [rows[0].upper().replace(" ", "\n"), None, "", "  "]
    rows = list(enumerate(rows))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = naive_kept(rows)
    assert {r[0] for r in sm.keep_one_similar(d).select("doc_id").collect()} == want
    monkeypatch.setattr(sm, "FREQUENT", 0)  # the order of the shingles has no influence
    monkeypatch.setattr(sm, "FEW_SETS", 0)  # nor has the way to the texts
    assert {r[0] for r in sm.keep_one_similar(d).select("doc_id").collect()} == want


def test_pipeline_stage_takes_one_changed_word_of_a_hundred(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:50], "other", *w[51:]])), (3, " ".join([*w[:20], "x", *w[21:50], "y", *w[51:80], "z", *w[81:]]))]
    d = spark.createDataFrame([*rows, (1, rows[0][1])], "doc_id long, text string")
    assert sorted(r[0] for r in cp.deduplicated(spark, d, "").collect()) == sorted(naive_kept(rows)) == [1, 3]


def test_stage_on_a_table(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    want = naive_kept([(r["doc_id"], r["text"]) for r in d.collect()])
    assert {r["doc_id"] for r in cp.deduplicated(spark, d, small).collect()} == want


def test_stage_searches_fingerprints_by_pigeonring_first(spark, monkeypatch):
    """Pairs within two bits come from op5's search, and are compared exactly like all others."""
    w = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "z"])), (3, " ".join(w[:300])), (4, "a b"), (5, "a  b"), (6, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen, search = [], sm.hamming_links
    monkeypatch.setattr(sm, "hamming_links", lambda fps, *a: seen.append({r[0] for r in fps.collect()}) or search(fps, *a))
    assert {r[0] for r in cp.deduplicated(spark, d, "").collect()} == naive_kept(rows)
    assert seen == [{sm.majority(sm.shingle_set((t or "").encode())) for _, t in rows}]


def test_a_large_group_of_near_copies_makes_few_pairs(spark, tmp_path):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(f"x{rng.randrange(9999)}" if k in {c, 299 - c} else x for k, x in enumerate(w)), c) for i, c in enumerate(rng.randrange(150) for _ in range(80))]
    d = spark.createDataFrame([r[:2] for r in rows], "id long, text string").selectExpr("id as k", "id", "text")
    classes, links = sm.similar_sets(d, f"file://{tmp_path}")
    assert classes.count() == 80 and links.count() < 600  # of 3,160 pairs, all of which are similar
    assert spark.read.parquet(f"file://{tmp_path}/pairs").count() < 600
    assert [r[0] for r in sm.keep_one_similar(d.select("id", "text"), id_col="id").collect()] == [0]


def test_pairs_of_different_groups_as_by_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        m = int(rng.integers(1, 60))
        sig = np.arange(m)
        h, n, at, group = rng.integers(0, 4, m), rng.integers(5, 12, m), rng.integers(0, 2, m), rng.integers(0, 5, m)
        got = [tuple(x) for both in sm._pairs(h, sig, n, at, group) for x in both.tolist()]
        want = {(i, j) for i in range(m) for j in range(i + 1, m) if h[i] == h[j] and group[i] != group[j] and sm.similar(min(n[i] - at[i], n[j] - at[j]), n[i], n[j])}
        assert len(got) == len(set(got)) and set(got) == want
